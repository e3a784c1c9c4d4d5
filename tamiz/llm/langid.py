"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

Each direction has one update gate: h = h + z * (c - h), with z a hard sigmoid and c = x / (1 + |x|) of the byte's and the last state's
contributions: there is no reset gate. Both states at a position give it a probability for each language; a document's probabilities are
the mean over its positions. Texts are read in windows of ``WINDOW`` bytes, which lets many run side by side; every byte of every text is in
one. A window is read with ``CONTEXT`` bytes before and after it, in which the states form; beyond these no state is carried.
Training is backpropagation through time with Adam, on windows from a bounded sample of the labelled rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamiz.llm.common import bound_batches

WINDOW, CONTEXT, HIDDEN = 64, 8, 8
READ = WINDOW + 2 * CONTEXT
#: Windows that run side by side: bounds a worker's arrays to a few MB.
SIDE = 4096
UNKNOWN = "und"


def start(languages: int, hidden: int = HIDDEN, seed: int = 0) -> dict[str, np.ndarray]:
    """Weights. e: a byte's contribution to gate and candidate, u: the last state's, both per direction; o, b: to the languages."""
    r = np.random.default_rng(seed)
    e = r.normal(0, 0.5, (2, 2 * hidden, 256))
    e[:, :hidden] -= 0.5
    u = r.normal(0, 0.5 / np.sqrt(hidden), (2, 2 * hidden, hidden))
    return {k: v.astype(np.float32) for k, v in {"e": e, "u": u, "o": r.normal(0, 0.3, (languages, 2 * hidden)), "b": np.zeros((languages, 1))}.items()}


def _states(w: dict, codes: np.ndarray, direction: int) -> np.ndarray:
    """(time, hidden, windows) states of one direction; codes is (time, windows)."""
    steps, n = codes.shape
    e, u = w["e"][direction], w["u"][direction]
    hidden = u.shape[1]
    h, states = np.zeros((hidden, n), np.float32), np.empty((steps, hidden, n), np.float32)
    x, g, a = np.empty((2 * hidden, n), np.float32), np.empty((2 * hidden, n), np.float32), np.empty((hidden, n), np.float32)
    z, c = g[:hidden], g[hidden:]
    for t in range(steps) if direction == 0 else range(steps - 1, -1, -1):
        np.take(e, codes[t], axis=1, out=x, mode="clip")
        np.matmul(u, h, out=g)
        g += x
        np.maximum(z, -1, out=z)
        np.minimum(z, 1, out=z)
        z += 1
        np.abs(c, out=a)
        a += 1
        c /= a
        c -= h
        c *= z
        c *= 0.5
        h += c
        states[t] = h
    return states


def position_probabilities(w: dict, codes: np.ndarray) -> np.ndarray:
    """(WINDOW, languages, windows): the probability of each language at each byte of the windows in codes (READ, windows)."""
    hidden, core = w["u"].shape[2], slice(CONTEXT, CONTEXT + WINDOW)
    p = np.matmul(w["o"][:, :hidden], _states(w, codes, 0)[core])
    p += np.matmul(w["o"][:, hidden:], _states(w, codes, 1)[core])
    p += w["b"]
    p -= p.max(axis=1, keepdims=True)
    np.exp(p, out=p)
    p /= p.sum(axis=1, keepdims=True)
    return p


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (windows, READ) with zeros beyond the text, the bytes in each window, and each text's number of windows."""
    counts = np.array([-(-len(x) // WINDOW) for x in texts], np.int64)
    edge = bytes(CONTEXT)
    raw = np.frombuffer(b"".join(edge + x.ljust(k * WINDOW, b"\0") + edge for x, k in zip(texts, counts.tolist(), strict=True) if k), np.uint8)
    lengths = np.full(int(counts.sum()), WINDOW, np.int64)
    some = counts > 0
    last = np.cumsum(counts)[some] - 1
    lengths[last] = np.array([len(x) for x in texts], np.int64)[some] - (counts[some] - 1) * WINDOW
    starts = np.arange(len(lengths)) * WINDOW + 2 * CONTEXT * np.repeat(np.arange(int(some.sum())), counts[some])
    whole = np.lib.stride_tricks.sliding_window_view(raw, READ)[starts] if len(starts) else np.zeros((0, READ), np.uint8)
    return whole, lengths, counts


def loss_and_gradient(w: dict, codes: np.ndarray, lengths: np.ndarray, wanted: np.ndarray, first: int = 0) -> tuple[float, dict]:
    """Mean cross-entropy over ``lengths`` positions from ``first`` on, and its gradient by backpropagation through time; codes is (time, windows)."""
    steps, n = codes.shape
    hidden = w["u"].shape[2]
    at = np.arange(steps)[:, None] - first
    mask = ((at >= 0) & (at < lengths)).astype(np.float32)
    total = mask.sum()
    kept, states = [], []
    for d in (0, 1):
        h, own, out = np.zeros((hidden, n), np.float32), {}, np.empty((steps, hidden, n), np.float32)
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            g = w["u"][d] @ h + w["e"][d][:, codes[t]]
            zp, cp = g[:hidden], g[hidden:]
            z, c = (np.clip(zp, -1, 1) + 1) / 2, cp / (1 + np.abs(cp))
            own[t] = (h, zp, cp, z, c)
            h = h + z * (c - h)
            out[t] = h
        kept.append(own)
        states.append(out)
    logits = np.matmul(w["o"][:, :hidden], states[0]) + np.matmul(w["o"][:, hidden:], states[1]) + w["b"]
    logits -= logits.max(axis=1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=1, keepdims=True)
    right = p[:, wanted, np.arange(n)]
    loss = float(-(np.log(right + 1e-9) * mask).sum() / total)
    p[:, wanted, np.arange(n)] -= 1
    p *= mask[:, None, :] / total
    grad = {k: np.zeros_like(v) for k, v in w.items()}
    grad["b"] = p.sum(axis=(0, 2))[:, None]
    for d in (0, 1):
        part = slice(d * hidden, (d + 1) * hidden)
        grad["o"][:, part] = np.einsum("tln,thn->lh", p, states[d])
        back = np.matmul(w["o"][:, part].T, p)
        dh = np.zeros((hidden, n), np.float32)
        gates = np.empty((steps, 2 * hidden, n), np.float32)
        for t in range(steps - 1, -1, -1) if d == 0 else range(steps):
            h, zp, cp, z, c = kept[d][t]
            dh = dh + back[t]
            dg = np.concatenate((dh * (c - h) * 0.5 * (np.abs(zp) < 1), dh * z / (1 + np.abs(cp)) ** 2))
            gates[t] = dg
            grad["u"][d] += dg @ h.T
            dh = dh * (1 - z) + w["u"][d].T @ dg
        flat = codes.ravel()
        for k in range(2 * hidden):
            grad["e"][d][k] = np.bincount(flat, gates[:, k].ravel(), 256)
    return loss, grad


def train(snippets: list[bytes], wanted: list[int], languages: int, steps: int = 400, batch: int = 256, rate: float = 0.02, seed: int = 0) -> dict[str, np.ndarray]:
    """Adam on batches that hold each language about equally often."""
    w, r = start(languages, seed=seed), np.random.default_rng(seed)
    codes, lengths, counts = windows_of(snippets)
    labels = np.repeat(np.array(wanted, np.int64), counts)
    of = [np.flatnonzero(labels == k) for k in range(languages)]
    of = [x for x in of if len(x)]
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    for t in range(1, steps + 1):
        picked = np.concatenate([r.choice(x, max(1, batch // len(of))) for x in of])
        _, grad = loss_and_gradient(w, codes[picked].T.astype(np.intp), lengths[picked], labels[picked], CONTEXT)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        now = rate * min(1.0, 2 * (1 - t / (steps + 1)))
        for k, g in grad.items():
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            w[k] = (w[k] - now * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return w


def held_out(doc_id):
    """Rows without an id are never learnt from."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(True))


def sample(docs: DataFrame, per_language: int = 500, snippets: int = 2, most_rows: int = 32_000) -> tuple[list[bytes], list[int], list[str]]:
    """Training texts of two windows: about ``per_language`` labelled documents of each language, fewer if there are so many languages that it
    would be more than ``most_rows`` in all; ``snippets`` from each document.

    Documents are picked by a hash of doc_id, held-out ones never; a document's snippets start at hashed places of the whole text.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()  # a row per language
    if not counts:
        return [], [], []
    each = min(per_language, most_rows / len(counts))
    share = F.element_at(F.from_json(F.lit(json.dumps({r.lang: min(1.0, each / r.n) for r in counts})), "map<string,double>"), F.col("lang"))
    dice = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("pick")), F.lit(1_000_000)) / 1e6
    room = F.greatest(F.length("text") - 2 * WINDOW, F.lit(0)) + 1
    places = F.explode(F.array_distinct(F.array(*[F.pmod(F.xxhash64(F.col("doc_id"), F.lit(k)), room).cast("int") for k in range(snippets)])))
    rows = labelled.where(dice < share).select("doc_id", "lang", "text", places.alias("at")).select("doc_id", "lang", "at", F.substr("text", F.col("at") + 1, F.lit(2 * WINDOW)).alias("snippet"))
    found = sorted((r.doc_id, r.at, r.lang, r.snippet) for r in rows.collect() if r.snippet)
    names = sorted({x[2] for x in found})
    return [x[3].encode()[: 2 * WINDOW] for x in found], [names.index(x[2]) for x in found], names


def pooled(w: dict, texts: list[bytes]) -> np.ndarray:
    """(texts, languages): the mean over each text's positions."""
    codes, lengths, counts = windows_of(texts)
    sums = np.zeros((len(texts), len(w["b"])))
    owner = np.repeat(np.arange(len(texts)), counts)
    for k in range(0, len(codes), SIDE):
        p = position_probabilities(w, np.ascontiguousarray(codes[k : k + SIDE].T).astype(np.intp))
        own, length = owner[k : k + SIDE], lengths[k : k + SIDE]
        for j in np.flatnonzero(length < WINDOW):
            p[length[j] :, :, j] = 0
        per = p.sum(axis=0)
        for j in range(sums.shape[1]):
            sums[:, j] += np.bincount(own, per[j], len(texts))
    return sums / np.maximum(sums.sum(axis=1, keepdims=True), 1e-9)


def _probabilities(w: dict, column: pa.Array) -> np.ndarray:
    """``pooled`` over a column, a few MB of texts at a time (or one longer text)."""
    out, held, size = [], [], 0
    for x in column.cast(pa.binary()):
        held.append(x.as_py() or b"")
        size += len(held[-1])
        if size > 4 * SIDE * WINDOW:
            out.append(pooled(w, held))
            held, size = [], 0
    return np.concatenate([*out, pooled(w, held)])


def _predictor(shared):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, names = shared.value
        for batch in batches:
            p = _probabilities(w, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([names[k] for k in p.argmax(axis=1)], pa.string()), pa.array(p.max(axis=1))], ["doc_id", "letters", "best", "score"])

    return predict


def _keeper(shared, least: float):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, _ = shared.value
        for batch in batches:
            p = _probabilities(w, batch.column(batch.schema.get_field_index("text")))
            yield batch.filter(pa.array(p.max(axis=1) >= least))

    return keep


def _model(docs: DataFrame, per_language: int, steps: int):
    """The trained network and its languages, broadcast; None if nothing is labelled. A few kB."""
    bound_batches(docs.sparkSession)
    snippets, wanted, names = sample(docs, per_language)
    return docs.sparkSession.sparkContext.broadcast((train(snippets, wanted, len(names), steps), names)) if names else None


def identify(docs: DataFrame, per_language: int = 500, steps: int = 400) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): the language with the greatest mean probability over all bytes of the text, and that mean.

    ``und`` with score 0 if the text is null, has no letter, or if no row is labelled. Ties go to the first language by name. Repeated
    rows are predicted each, and those with a null id count as held out; an empty table gives no rows; further columns are not read.
    """
    shared = _model(docs, per_language, steps)
    plain = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    if shared:
        found = plain.mapInArrow(_predictor(shared), "doc_id long, letters boolean, best string, score double")
    else:
        found = plain.select("doc_id", F.lit(False).alias("letters"), F.lit(UNKNOWN).alias("best"), F.lit(0.0).alias("score"))
    sure = F.col("letters")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.when(sure, F.col("best")).otherwise(UNKNOWN).alias("lang_pred"), F.when(sure, F.col("score")).otherwise(0.0).alias("score"))


def keep_identified(docs: DataFrame, least: float = 0.5, per_language: int = 500, steps: int = 400) -> DataFrame:
    """``docs`` whose language is identified with a score of at least ``least``; rows and columns that stay are unchanged.

    Rows that ``identify`` gives ``und`` go. Nothing is shuffled. If no row is labelled, no language is known and all rows go.
    """
    shared = _model(docs, per_language, steps)
    some = docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return some.mapInArrow(_keeper(shared, least), docs.schema) if shared else docs.limit(0)
