"""Packing of token streams into fixed windows, in the documents' order.

Documents are laid one after another in the order of their partition. A dynamic programme chooses where windows of at most ``size``
tokens are cut: a window costs its padding, and a cut costs a penalty: nothing at a document's end, little at a sentence's end, more
inside a sentence. The best predecessor of a cut is the least value among the cuts within ``size`` tokens before it, so a monotone
queue gives it in constant time. A last window that is far from full is cut into powers of two, which need no padding, if those cuts
cost less than its padding.
"""

from __future__ import annotations

import functools
import json
import re
import sys
import types
import zlib
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tamiz.llm.common import bound_batches

# The pre-tokenisation pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A space beside other white space: there the pieces between spaces can't be encoded one by one.
_ODD_SPACE = re.compile(r" \s|\s ")


class _Pieces(dict):
    """Ids of text pieces with the space before them; keeps at most ``most`` short ones."""

    def __init__(self, encode, most: int):
        self.encode, self.most = encode, most

    def __missing__(self, piece: str) -> bytes:
        ids = array("I", self.encode(" " + piece)).tobytes()
        if len(self) < self.most and len(piece) <= 40:
            self[piece] = ids
        return ids


class Encoder:
    """Ids of the tokenizer in a byte-level BPE file of the tokenizers library, as little-endian 32-bit numbers.

    The file's merges run in tiktoken, which gives the same ids several times as fast; texts with a special token's string, and
    files that are no plain byte-level BPE, go to the tokenizers library itself.
    """

    def __init__(self, path: str, most: int = 100_000):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path, vocab = path, spec["model"].get("vocab")
        added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.specials = list(added)
        kept = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or 174 <= c <= 255]
        shown = {chr(c): c for c in kept} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in kept)}
        before, merges = spec.get("pre_tokenizer") or {}, spec["model"].get("merges", [])
        joined = [vocab.get(m.replace(" ", "") if isinstance(m, str) else "".join(m), -1) for m in merges] if isinstance(vocab, dict) else [-1]
        self.plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and spec.get("normalizer") is None and all(a < b for a, b in zip(joined, joined[1:]))
        if self.plain:
            ranks = {bytes(shown[c] for c in token): k for token, k in vocab.items() if token not in added}
            self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            self.pieces = _Pieces(self.fast, most)
            said = {k: raw.decode("utf-8", "replace") for raw, k in ranks.items()} | {k: x for x, k in added.items()}
        else:
            said = {k: self.slow.decode([k], skip_special_tokens=False) for k in range(self.slow.get_vocab_size())}
        ends, size = re.compile(r"[.!?\n]\s*$"), max(said) + 1
        self.is_end = np.fromiter((bool(ends.search(said.get(k, ""))) for k in range(size)), bool, size)

    @functools.cached_property
    def slow(self):
        """The tokenizers library's own tokenizer, loaded at first need: most workers never meet a text that needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def __call__(self, text: str) -> bytes:
        if not self.plain or any(x in text for x in self.specials):
            return array("I", self.slow.encode(text, add_special_tokens=False).ids).tobytes()
        if _ODD_SPACE.search(text):
            return array("I", self.fast(text)).tobytes()
        first, *rest = text.split(" ")
        return b"".join([array("I", self.fast(first)).tobytes(), *map(self.pieces.__getitem__, rest)])


def encoder(path: str) -> Encoder:
    """The encoder of a file, loaded once in each Python worker."""
    held = sys.modules.setdefault("_tamiz_encoders", types.ModuleType("_tamiz_encoders")).__dict__
    if path not in held:
        held[path] = Encoder(path)
    return held[path]


def choose_cuts(places: list[int], penalties: list[int], size: int) -> list[int]:
    """Least-cost window ends among ``places`` (ascending, from 0, at most ``size`` apart), as indexes; penalties are per place."""
    n = len(places)
    value, before, queue = [0] * n, [0] * n, deque([0])
    for j in range(1, n):
        floor = places[j] - size
        while places[queue[0]] < floor:
            queue.popleft()
        i = before[j] = queue[0]
        v = value[j] = value[i] + size + penalties[j]
        while queue and value[queue[-1]] >= v:
            queue.pop()
        queue.append(j)
    cuts, j = [], n - 1
    while j:
        cuts.append(j)
        j = before[j]
    return cuts[::-1]


def _windows(ids: np.ndarray, doc_ends: np.ndarray, is_end: np.ndarray, size: int, sentence: int, inner: int, grid: int) -> np.ndarray:
    """Window ends over a block of documents' ids, the block's end included."""
    n = len(ids)
    penalty = np.full(n + 1, -1, np.int64)
    penalty[grid::grid] = inner
    penalty[1:][is_end[ids]] = sentence
    penalty[doc_ends] = 0
    penalty[0] = 0
    places = np.flatnonzero(penalty >= 0)
    ends = places[choose_cuts(places.tolist(), penalty[places].tolist(), size)].tolist()
    out, start = [], 0
    for end in ends:
        length = end - start
        if size - length > inner * (length.bit_count() - 1) > 0:
            for k in range(length.bit_length() - 1, -1, -1):
                if length >> k & 1:
                    start += 1 << k
                    out.append(start)
        else:
            out.append(end)
        start = end
    return np.array(out, np.int64)


def _packer(path: str, size: int, block: int, sentence: int, inner: int, grid: int, with_ids: bool):
    def emit(names: list, parts: list[bytes], first: int, enc: Encoder) -> tuple[pa.RecordBatch, int]:
        ids = np.frombuffer(b"".join(parts), "<u4")
        doc_ends = np.cumsum([len(x) // 4 for x in parts])
        ends = _windows(ids, doc_ends, enc.is_end, size, sentence, inner, grid)
        starts = np.unique(np.concatenate(([0], doc_ends[:-1], ends[:-1])))
        stops = np.append(starts[1:], len(ids))
        doc, window = np.searchsorted(doc_ends, starts, "right"), np.searchsorted(ends, starts, "right")
        doc_starts, window_starts = np.concatenate(([0], doc_ends[:-1])), np.concatenate(([0], ends[:-1]))
        raw = memoryview(ids.tobytes())
        sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
        columns = {
            "doc_id": pa.array([names[k] for k in doc.tolist()], pa.int64()),
            "start": pa.array(starts - doc_starts[doc]),
            "length": pa.array(stops - starts),
            "ids_crc32": pa.array(sums, pa.int64()),
            "doc_tokens": pa.array((doc_ends - doc_starts)[doc]),
            "sequence_id": pa.array(window + first),
            "offset": pa.array(starts - window_starts[window]),
        }
        if with_ids:
            columns["ids"] = pa.array([ids[a:b].astype(np.int32) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)], pa.list_(pa.int32()))
        return pa.RecordBatch.from_pydict(columns), first + len(ends)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, names, parts, held = encoder(path), [], [], 0
        first = TaskContext.get().partitionId() << 40
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = enc(text.as_py() or "") + b"\0\0\0\0"
                names.append(name)
                parts.append(ids)
                held += len(ids) // 4
                if held >= block:
                    made, first = emit(names, parts, first, enc)
                    yield made
                    names, parts, held = [], [], 0
        if names:
            yield emit(names, parts, first, enc)[0]

    return pack


def pack(docs: DataFrame, tokenizer_path: str, size: int = 1024, block: int = 1_000_000, sentence: int = 2, inner: int = 16, grid: int = 16, with_ids: bool = False) -> DataFrame:
    """A row per piece of a document in a sequence: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for.

    Each partition packs its own documents in their order, ``block`` ids (or one longer document) at a time, so memory is bounded and
    nothing is shuffled; sequence_id starts from the partition's number times 2^40. A document's ids end with id 0. Null and empty texts
    are that id alone. Equal texts and repeated rows are packed as often as they come; an empty table gives no rows.
    ``grid``, in ids, is where windows may be cut inside a sentence, at penalty ``inner``; ``size`` is a multiple of it.
    """
    if size % grid:
        raise ValueError("size must be a multiple of grid")
    bound_batches(docs.sparkSession)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(_packer(tokenizer_path, size, block, sentence, inner, grid, with_ids), schema)
