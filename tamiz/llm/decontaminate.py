"""Benchmark decontamination with a generalised suffix automaton over the words of the test items.

A document's words are streamed through the automaton, which gives the longest match that ends at each word. Matches of ``window``
words or more (or of a whole item that is shorter than that) mark their words; marked spans are removed, and documents of which
too much is marked are dropped.

The automaton is built from items a block of bounded size at a time and kept as sorted arrays: some 50 MB for 200,000 words. All blocks are
scanned in one pass over the documents, one after another over each Arrow batch, so a worker holds one block. Many runs of words go through
the automaton side by side; a run is cut into pieces that overlap by ``window`` - 1 words, which loses no window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamiz.llm.common import bound_batches

#: Bytes of words: digits, a-z and all above ASCII; A-Z is lowered, everything else separates.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Words of a run that go through the automaton as one.
PIECE = 256


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


@dataclass
class _Builder:
    """States are numbers; state 0 is the root."""

    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [0])
    length: list[int] = field(default_factory=lambda: [0])

    def _state(self, length: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """A clone of ``q`` for the words that reach it from ``p`` and from its suffixes."""
        clone = self._state(self.length[p] + 1, dict(self.step[q]), self.link[q])
        self.link[q] = clone
        while self.step[p].get(c) == q:
            self.step[p][c] = clone
            if not p:
                break
            p = self.link[p]
        return clone

    def extend(self, last: int, c: int) -> int:
        q = self.step[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while c not in self.step[p]:
            self.step[p][c] = new
            if not p:
                return new
            p = self.link[p]
        q = self.step[p][c]
        self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new


@dataclass
class Automaton:
    """The automaton of one block of items.

    A step from a state by a word's code is found in ``keys`` (state * codes + code, sorted). ``anchor`` of a state is the state of its last
    ``window`` words, 0 if it has fewer; ``output`` is the first state, on the way over suffix links, that is a whole short item. States that
    are an anchor or a whole item have items: (state, item) pairs, sorted.
    """

    window: int
    least: int
    ids: dict[bytes, int]
    keys: np.ndarray
    to: np.ndarray
    link: np.ndarray
    length: np.ndarray
    anchor: np.ndarray
    output: np.ndarray
    pair_state: np.ndarray
    pair_item: np.ndarray

    @classmethod
    def build(cls, items: list[list[bytes]], window: int) -> Automaton:
        ids: dict[bytes, int] = {}
        coded = [[ids.setdefault(w, len(ids)) for w in words] for words in items]
        made, whole, pairs = _Builder(), set(), []
        for words in coded:
            last = 0
            for c in words:
                last = made.extend(last, c)
        link, length = made.link, made.length
        for k, words in enumerate(coded):
            at = 0
            for n, c in enumerate(words, 1):
                at = made.step[at][c]
                if n >= window:
                    up = at
                    while length[link[up]] >= window:
                        up = link[up]
                    pairs.append((up, k))
            if 0 < len(words) < window:
                whole.add(at)
                pairs.append((at, k))
        anchor, output = [0] * len(link), [0] * len(link)
        for s in sorted(range(1, len(link)), key=length.__getitem__):  # links lead to shorter states
            anchor[s] = 0 if length[s] < window else s if length[link[s]] < window else anchor[link[s]]
            output[s] = s if s in whole else output[link[s]]
        codes = max(len(ids), 1)
        keys = np.fromiter((s * codes + c for s, step in enumerate(made.step) for c in step), np.int64)
        to = np.fromiter(chain.from_iterable(step.values() for step in made.step), np.int32)
        order = np.argsort(keys)
        own = np.unique(np.array(pairs, np.int64).reshape(-1, 2), axis=0)
        least = min((min(window, len(x)) for x in coded if x), default=1 << 30)
        small = lambda x: np.array(x, np.int32)
        return cls(window, least, ids, keys[order], to[order], small(link), small(length), small(anchor), small(output), small(own[:, 0]), small(own[:, 1]))

    def _step(self, states: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and whether there is one."""
        wanted = states.astype(np.int64) * len(self.ids) + codes
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return self.to[at], self.keys[at] == wanted

    def _pieces(self, codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and lengths, longest first, of what goes through side by side; no match crosses a word that no item has or a document's end."""
        known = codes >= 0
        begins = np.zeros(len(codes) + 1, bool)
        begins[first] = True
        starts = np.flatnonzero(known & (begins[:-1] | ~np.concatenate(([False], known[:-1]))))
        begins[-1] = True
        ends = np.flatnonzero(known & (begins[1:] | ~np.concatenate((known[1:], [False])))) + 1
        keep = ends - starts >= self.least
        starts, ends = starts[keep], ends[keep]
        over = self.window - 1
        each = np.maximum(1, -(-(ends - starts - over) // PIECE))
        k = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        begin = np.repeat(starts, each) + k * PIECE
        length = np.minimum(PIECE + over, np.repeat(ends, each) - begin)
        order = np.argsort(-length, kind="stable")
        return begin[order], length[order]

    def scan(self, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each word of all documents, one after another, is hit; and (document, item) for items with a window that occurs."""
        counts = np.fromiter(map(len, docs), np.int64, len(docs))
        ends = np.cumsum(counts)
        total, get = int(counts.sum()), self.ids.get
        none = np.zeros(total, bool), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not self.ids or not total:
            return none
        codes = np.fromiter((get(w, -1) for w in chain.from_iterable(docs)), np.int64, total)
        begin, length = self._pieces(codes, np.unique((ends - counts)[counts > 0]))
        if not len(begin):
            return none
        state, matched = np.zeros(len(begin), np.int32), np.zeros(len(begin), np.int32)
        seen: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # the position after a hit, its length, the state that has the items
        some_whole = bool(self.output.any())
        for t in range(int(length[0])):
            k = int(np.searchsorted(-length, -t))  # pieces longer than t
            at, code, s, m = begin[:k] + t, codes[begin[:k] + t], state[:k], matched[:k]
            to, ok = self._step(s, code)
            lost = np.flatnonzero(~ok)
            while len(lost):  # the root has a step for every known word
                s[lost] = up = self.link[s[lost]]
                m[lost] = self.length[up]
                more, ok = self._step(up, code[lost])
                to[lost[ok]] = more[ok]
                lost = lost[~ok]
            s[:] = to
            m += 1
            hit = np.flatnonzero(m >= self.window)
            if len(hit):
                seen.append((at[hit] + 1, m[hit].copy(), self.anchor[to[hit]]))
            if some_whole:
                out = np.where(self.length[to] == m, self.output[to], self.output[self.link[to]])
                while len(hit := np.flatnonzero(out)):
                    at, out = at[hit], out[hit]
                    seen.append((at + 1, self.length[out], out))
                    out = self.output[self.link[out]]
        if not seen:
            return none
        after, size, of = (np.concatenate(x) for x in zip(*seen, strict=True))
        open_ = np.bincount(after - size, minlength=total + 1) - np.bincount(after, minlength=total + 1)
        own = np.unique(np.stack((np.searchsorted(ends, after - 1, "right"), of), axis=1), axis=0)
        lo, hi = np.searchsorted(self.pair_state, own[:, 1]), np.searchsorted(self.pair_state, own[:, 1], "right")
        each = hi - lo
        places = np.repeat(lo, each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        return np.cumsum(open_)[:total] > 0, np.repeat(own[:, 0], each), self.pair_item[places].astype(np.int64)


def _blocks(benchmark: DataFrame, block_words: int, window: int) -> Iterator[tuple[list[str], list[list[bytes]]]]:
    """Items, a block of at most ``block_words`` words at a time: the driver holds one block, not the table.

    An item that is longer goes into several blocks, in parts that overlap by ``window`` - 1 words, which have all its windows.
    """
    names, items, size = [], [], 0
    part = max(block_words, 2 * window)
    for row in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        words = words_of(row.text.encode())
        for a in range(0, max(len(words) - window + 1, 1), part - window + 1):
            piece = words[a : a + part]
            if items and size + len(piece) > block_words:
                yield names, items
                names, items, size = [], [], 0
            names.append(str(row.item_id))
            items.append(piece)
            size += len(piece)
    yield names, items


def _shared(docs: DataFrame, benchmark: DataFrame, window: int, block_words: int) -> list[Broadcast]:
    """The automaton and the item names of each block, broadcast; each is of bounded size."""
    context = docs.sparkSession.sparkContext
    return [context.broadcast((Automaton.build(items, window), names)) for names, items in _blocks(benchmark, block_words, window)]


def _found(shared: list[Broadcast], texts: list[bytes | None]) -> tuple[list[int], list[list[list[int]]], list[list[str]]]:
    """For each text its number of words, spans of hit words and ids of items, over all blocks. Of several blocks one is held at a time."""
    docs = [words_of(x or b"") for x in texts]
    counts = [len(x) for x in docs]
    hit, names = np.zeros(sum(counts), bool), [set() for _ in docs]
    for block in shared:
        automaton, own = block.value
        more, doc, item = automaton.scan(docs)
        hit |= more
        for d, k in zip(doc.tolist(), item.tolist(), strict=True):
            names[d].add(own[k])
        if len(shared) > 1 and getattr(block, "_path", None):
            automaton = own = None
            vars(block).pop("_value", None)  # read from the executor's disk again for the next batch
    spans, at = [], 0
    for n, found in zip(counts, names, strict=True):
        spans.append(_spans(hit[at : at + n]).tolist() if found else [])
        at += n
    return counts, spans, [sorted(x) for x in names]


def _spans(hit: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8))).reshape(-1, 2)


def _scanner(shared: list[Broadcast]):
    """(doc_id, text) -> (doc_id, n_words, spans, items)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, spans, items = _found(shared, [x.as_py() for x in batch.column(1).cast(pa.binary())])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(items, pa.list_(pa.string()))],
                ["doc_id", "n_words", "spans", "items"],
            )

    return scan


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = 200_000) -> DataFrame:
    """(doc_id, n_words, spans, items): spans are [start, end) word positions that are hit, items those with a window in the document.

    One pass over the documents without a shuffle: each row is judged in its place, so any doc_id, repeated or null, keeps its rows, and
    ``block_words`` (see ``_blocks``) bounds memory and does not change results. Null texts have no words. Items without words match
    nothing. No items: no hits. Items that repeat an id are that id once.
    """
    bound_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_scanner(_shared(docs, benchmark, window, block_words)), "doc_id long, n_words long, spans array<array<long>>, items array<string>")


def digest(found: DataFrame) -> DataFrame:
    """The counts and the hash of item ids that sum up ``matches``."""
    return found.select(
        "doc_id",
        "n_words",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x[1] - x[0]).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def _cut(text: bytes, spans: list[list[int]]) -> bytes:
    """``text`` without the words in ``spans`` and what separates them; a space stays where a span was."""
    plain = text.translate(_TABLE)
    is_word = np.frombuffer(plain, np.uint8) != 32
    bounds = np.flatnonzero(np.diff(np.concatenate(([False], is_word, [False])).astype(np.int8))).reshape(-1, 2)
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : bounds[a][0]])
        at = int(bounds[b - 1][1])
    return b"".join([*out, text[at:]])


def _cleaner(shared: list[Broadcast], max_coverage: float):
    """Texts cut, without rows of too much coverage."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index("text")
            values = [x.as_py() for x in batch.column(k).cast(pa.binary())]
            counts, found, _ = _found(shared, values)
            keep = [sum(b - a for a, b in spans) <= max_coverage * n for n, spans in zip(counts, found, strict=True)]
            texts = [_cut(text, spans) if spans else text for text, spans in zip(values, found, strict=True)]
            made = [pa.array(texts, pa.binary()).cast(pa.string()) if i == k else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(made, schema=pa.schema([pa.field(f.name, c.type) for f, c in zip(batch.schema, made)])).filter(pa.array(keep, pa.bool_()))

    return clean


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.5, block_words: int = 200_000) -> DataFrame:
    """``docs`` without hit spans; documents with more than ``max_coverage`` of their words hit are dropped. Other columns stay as they are.

    Spans of all blocks of items (see ``matches``) are found on the text as given; then it is cut once and its coverage judged once, so
    the result does not depend on ``block_words``.
    """
    bound_batches(docs.sparkSession)
    return docs.mapInArrow(_cleaner(_shared(docs, benchmark, window, block_words), max_coverage), docs.schema)


def sha256_of_ids(ids: list[str]) -> str:
    """What ``digest`` gives for these ids; for tests."""
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
