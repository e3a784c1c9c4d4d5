"""Secrets in texts: three fixed patterns, and strings of high entropy. DataFrame functions only.

Candidates for entropy are runs of at least ``WINDOW`` characters of a base-64 alphabet. A window slides along a candidate; the counts of
its characters are updated by the one that enters and the one that leaves, and with them the sum of c log2 c, from which the window's
Shannon entropy follows. Each character class has its own threshold: windows of hexadecimal digits only, and windows of the whole
alphabet. Two allow lists: candidates that look like words or numbers as a whole are not reported, and windows that touch a listed word do
not count, so that a key beside such a word is still found. Work grows with the text's length.

Positions are code points, ends exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamiz.llm.common import let, unused

# The patterns of the base kinds, in the order in which spans with one start are listed.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "entropy")
#: Hexadecimal digits come first.
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"
HEX_DIGITS, WINDOW = 16, 20
CANDIDATE = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{WINDOW},}}"
#: Bits a window needs, by class.
HEX_BITS, TEXT_BITS = 3.0, 3.8
#: Candidates that are no secrets: words without digits, numbers.
ALLOWED = r"^[A-Za-z+/_=-]*$|^[0-9/_=-]*$"
#: What no window of a secret may touch: examples, runs through the alphabet.
LISTED = r"(?i)example|0123456789|abcdefghijklm"

#: A long candidate is looked at in pieces of so many characters, each with the end of the piece before it.
PIECE = 4096

_SPANS = "array<struct<start:int,end:int,found:string>>"
_INTS = "array<int>"


def groups(values: Column) -> Column:
    """The array cut into about as many parts as each has elements, so that a fold with a growing result copies little."""
    size = lambda v: F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(v))).cast("int"))
    cut = lambda v, n: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / n).cast("int")), lambda k: F.slice(v, k * n + 1, n))
    return let(values, lambda v: F.when(F.size(v) > 0, let(size(v), lambda n: cut(v, n))).otherwise(F.slice(F.array(v), 1, 0)))


def running(values: Column, add, start: Column) -> Column:
    """(at, out): the fold of an int array by ``add``, and for each element the value before it."""
    step = lambda s, x: F.struct(add(s["at"], x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
    return F.aggregate(values, F.struct(start.alias("at"), F.array().cast(_INTS).alias("out")), step)


def sums_before(values: Column) -> Column:
    """For each element of an int array the sum of those before it."""
    plus = lambda a, x: a + x
    zero = F.lit(0)
    joined = lambda parts: F.flatten(F.zip_with(parts, running(F.transform(parts, lambda p: p["at"]), plus, zero)["out"], lambda p, h: F.transform(p["out"], lambda x: x + h)))
    return let(F.transform(groups(values), lambda v: running(v, plus, zero)), joined)


def found(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches with their positions, from the pieces between them."""
    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, m: F.struct(F.length(gap).alias("gap"), m.alias("m"), F.length(m).alias("n")))
    span = lambda x, before: F.struct((before + x["gap"]).alias("start"), (before + x["gap"] + x["n"]).alias("end"), x["m"].alias("found"))
    spans = let(F.filter(pairs, lambda x: x["m"].isNotNull()), lambda v: F.zip_with(v, sums_before(F.transform(v, lambda x: x["gap"] + x["n"])), span))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(_SPANS))


def _is_high(piece: Column) -> Column:
    """Whether some window of a piece reaches its class's bits.

    The counts of a window's characters are one letter each in a short text ("A" for none), so a step changes two letters. The sum of
    c log2 c is kept in whole numbers, which do not drift.
    """
    scale = 1 << 40
    weight = [round(c * math.log2(c) * scale) if c else 0 for c in range(WINDOW + 1)]
    more = F.array(*[F.lit(b - a).cast("bigint") for a, b in zip(weight, weight[1:])])
    codes = F.transform(F.filter(F.split(piece, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))
    event = lambda code, come, full: F.struct(code.alias("code"), F.lit(come).alias("come"), full.alias("full"))
    gone = lambda v, i: F.when(i >= WINDOW, F.array(event(F.get(v, i - WINDOW), False, F.lit(False)))).otherwise(F.array().cast("array<struct<code:int,come:boolean,full:boolean>>"))
    events = let(codes, lambda v: F.flatten(F.transform(v, lambda c, i: F.concat(gone(v, i), F.array(event(c, True, i >= WINDOW - 1))))))
    most = F.lit(1 << 62).cast("bigint")
    start = F.struct(F.lit("A" * len(ALPHABET)).alias("counts"), F.lit(0).cast("bigint").alias("sum"), F.lit(0).alias("digits"), F.lit(False).alias("full"), most.alias("hex"), most.alias("text"))
    # sums of windows that end with the last event
    hexes = lambda s: F.when(s["full"] & (s["digits"] == WINDOW), F.least(s["hex"], s["sum"])).otherwise(s["hex"])
    texts = lambda s: F.when(s["full"], F.least(s["text"], s["sum"])).otherwise(s["text"])

    def slide(s, x):
        n = F.ascii(F.substr(s["counts"], x["code"], F.lit(1))) - 65
        step = F.when(x["come"], 1).otherwise(-1)
        gain = F.when(x["come"], F.get(more, n)).otherwise(-F.get(more, n - 1))
        return F.struct(
            F.overlay(s["counts"], F.char((n + step + 65).cast("bigint")), x["code"], F.lit(1)).alias("counts"), (s["sum"] + gain).alias("sum"),
            (s["digits"] + F.when(x["code"] <= HEX_DIGITS, step).otherwise(0)).alias("digits"), x["full"].alias("full"), hexes(s).alias("hex"), texts(s).alias("text"),
        )

    within = lambda sums, bits: sums <= int((math.log2(WINDOW) - bits) * WINDOW * scale)
    return F.aggregate(events, start, slide, lambda s: within(hexes(s), HEX_BITS) | within(texts(s), TEXT_BITS))


def is_high(candidate: Column) -> Column:
    """Whether some window of the candidate that touches no listed word reaches its class's bits; looks no further than the first piece that has one."""
    pieces = lambda part: F.regexp_extract_all(part, F.lit(f".{{1,{PIECE}}}"), F.lit(0))
    joined = lambda v: F.transform(v, lambda p, i: F.concat(F.when(i > 0, F.right(F.get(v, i - 1), F.lit(WINDOW - 1))).otherwise(""), p))
    parts = F.filter(F.split(candidate, LISTED, -1), lambda part: F.length(part) >= WINDOW)
    return let(F.flatten(F.transform(parts, lambda part: let(pieces(part), joined))), lambda v: F.exists(v, _is_high))


def _of_kind(spans: Column, kind: str) -> Column:
    rank = KINDS.index(kind)
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end")))


def with_spans(docs: DataFrame, name: str = "_secrets") -> DataFrame:
    """``docs`` and a column ``name``: base and entropy spans as array<struct<start, rank of kind, end>>, by start and kind.

    Null and empty texts have none. Works row by row: other columns, repeated rows and ties are left as they are.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    assign = F.filter(found(text, ASSIGN), lambda x: F.length(F.regexp_extract(x["found"], ASSIGN, 2)) >= 12)
    high = F.filter(found(text, CANDIDATE), lambda x: ~x["found"].rlike(ALLOWED) & is_high(x["found"]))
    every = F.concat(_of_kind(assign, "assign"), _of_kind(found(text, ACCESS), "access"), _of_kind(found(text, HEX), "hex"), _of_kind(high, "entropy"))
    return docs.withColumn(name, F.array_sort(every))


def listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["rank"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, the hash of the base spans, and all spans as kind:start:end, comma-joined."""
    spans = with_spans(docs.select("doc_id", "text")).select("doc_id", F.col("_secrets"))
    base = F.filter("_secrets", lambda x: x["rank"] < 3)
    count = lambda k: F.size(F.filter("_secrets", lambda x: x["rank"] == k)).cast("long")
    return spans.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("_secrets")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every reported span of the text replaced by ``mark``; overlapping spans are replaced once, all else stays.

    Spans are taken in groups, each with the part of the text that it covers, so work grows with the text's length and hardly with the
    number of spans.
    """
    columns, own = docs.columns, unused(docs, "_secrets")

    def replace(text, base):
        def one(done, x):
            start, end = F.greatest(x["start"] - base, done["at"]), x["end"] - base
            said = F.when(x["start"] - base < done["at"], "").otherwise(mark)
            return F.when(end <= done["at"], done).otherwise(F.struct(end.alias("at"), F.concat(done["text"], F.substr(text, done["at"] + 1, start - done["at"]), said).alias("text")))

        return one

    def group(spans, base, end):  # text from base, where all groups before have ended, to this group's end
        none = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))
        return let(F.substr("text", base + 1, end - base), lambda part: F.aggregate(spans, none, replace(part, base), lambda done: done["text"]))

    def joined(parts):
        ends = running(F.transform(parts, lambda v: F.array_max(F.transform(v, lambda x: x["end"]))), lambda a, x: F.greatest(a, x), F.lit(0))
        whole = lambda r: F.concat(F.array_join(F.transform(parts, lambda v, k: group(v, F.get(r["out"], k), F.coalesce(F.get(r["out"], k + 1), r["at"]))), ""), F.substr("text", r["at"] + 1))
        return let(ends, whole)

    marked = let(groups(F.col(own)), joined)
    return with_spans(docs, own).withColumn("text", F.when(F.size(own) > 0, marked).otherwise(F.col("text"))).select(*columns)
