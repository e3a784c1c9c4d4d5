"""License notices in documents, by MinHash bands over overlapping windows. DataFrame functions only.

A template of s shingles of five words is looked for in windows of s + stride - 1 shingles, a stride of s / 4 apart, so that any
occurrence lies whole in a window. Template and window each have ``bands`` MinHash values of one row; they are a candidate pair if any
band agrees. A whole occurrence has a resemblance of at least 0.8 to its window, so a band agrees with probability 1 - 0.2^8 > 0.99999;
one that keeps only 80 % of the shingles has at least 0.53, which gives 1 - 0.47^8 > 0.997. Candidates are verified by the exact share
of the template's shingles that the window contains.

A band can only agree where the window holds the template's least shingle of that band. Windows are therefore evaluated only around
shingles that are the least of some template, which leaves out no pair that the bands would retrieve.
"""

from __future__ import annotations

import json
import re
import struct

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiz.llm.common import let
from tamiz.llm.license_texts import TEXTS

WORDS = 5
# Short public license notices, by SPDX-like name. Whole texts are beside this file.
NOTICES = {
    "all-rights-reserved": "All rights reserved.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
TEMPLATES = NOTICES | TEXTS


def word_hashes(text: Column) -> Column:
    """Hashes of a text's words: lower-cased runs of digits, a-z and characters beyond ASCII."""
    words = F.split(F.lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def shingles(hashes: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` words; none if there are fewer words."""
    runs = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - size), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(size)]))
    return let(hashes, lambda h: F.when(F.size(h) >= size, runs(h)).otherwise(F.array().cast("array<bigint>")))


def band(j: int):
    """The hash of band ``j``. A function of one parameter: Spark would fill a second one with the element's index."""
    return lambda x: F.xxhash64(x, F.lit(j))


def minima(of: Column, bands: int) -> Column:
    """The least value of each band's hash over the shingles."""
    return F.array(*[F.array_min(F.transform(of, band(j))) for j in range(bands)])


def _long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _chain(values: list[int], form: str = "<q") -> int:
    """What Spark's xxhash64 gives for these numbers as columns."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack(form, v), seed)
    return _long(seed)


def band_value(shingle: int, band: int) -> int:
    seed = xxhash.xxh64_intdigest(struct.pack("<q", shingle), 42)
    return _long(xxhash.xxh64_intdigest(struct.pack("<i", band), seed))


def prepared(templates: dict[str, str], bands: int) -> list[dict]:
    """For each template its shingle size, shingles, band values, the shingles that have them, and the windows to look in."""
    out = []
    for name, notice in sorted(templates.items()):
        h = [_long(xxhash.xxh64_intdigest(w, 42)) for w in re.split(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", notice.lower().encode()) if w]
        if h:
            words = min(len(h), WORDS)
            of = [_chain(h[i : i + words]) for i in range(len(h) - words + 1)]
            least = [min(of, key=lambda x, j=j: band_value(x, j)) for j in range(bands)]
            stride = max(1, len(of) // 4)
            out.append({"license": name, "words": words, "of": sorted(set(of)), "bands": [band_value(x, j) for j, x in enumerate(least)], "least": sorted(set(least)), "stride": stride, "length": len(of) + stride - 1})
    return out


def _table(spark: SparkSession, known: list[dict]) -> DataFrame:
    """(shingle, template...): a row for each shingle that is the least of a template in some band. One text literal, so plans stay short."""
    rows = [{"shingle": x} | {k: r[k] for k in ("license", "of", "bands", "stride", "length")} for r in known for x in r["least"]]
    kind = "array<struct<shingle:bigint,license:string,of:array<bigint>,bands:array<bigint>,stride:int,length:int>>"
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), kind)).alias("t")).select("t.*")


def scan(docs: DataFrame, templates: dict[str, str] | None = None, bands: int = 8, share: float = 0.8) -> DataFrame:
    """(doc_id, license, containment, n_windows, first_word): notices of which a window contains at least ``share`` of the shingles.

    Templates of fewer than five words are one shingle of their own length. Null, empty and short texts have no notice. Rows that repeat a
    doc_id are reported together. An empty table or no templates give no rows; further columns are not read.
    ``templates`` is a short list that fits in a query plan, such as the one above.
    """
    spark, rows = docs.sparkSession, []
    known = prepared(TEMPLATES if templates is None else templates, bands)
    for words in sorted({r["words"] for r in known}):
        own = [r for r in known if r["words"] == words]
        wanted, reach = sorted({x for r in own for x in r["least"]}), max(r["length"] for r in own)
        made = docs.select("doc_id", word_hashes(F.coalesce("text", F.lit(""))).alias("h")).select("doc_id", shingles(F.col("h"), words).alias("s"))
        hits = F.filter(F.transform("s", lambda x, i: F.when(x.isin(wanted), i)), lambda i: i.isNotNull())
        places = made.select("doc_id", "s", hits.alias("hits"))
        # of a long document, only what lies around a hit goes on; no filter before, or Spark would work the shingles out twice
        places = places.select(
            "doc_id",
            F.explode_outer(F.transform("hits", lambda p: F.struct(p.alias("at"), F.get("s", p).alias("shingle"), F.greatest(p - reach, F.lit(0)).alias("base"), F.slice("s", F.greatest(p - reach, F.lit(0)) + 1, F.lit(2 * reach + 1)).alias("near")))).alias("p"),
        ).where("p.at is not null").select("doc_id", "p.*")
        windows = places.join(F.broadcast(_table(spark, own)), "shingle").withColumn(
            "start", F.explode(F.expr("sequence(cast(ceil(greatest(at - length + 1, 0) / stride) * stride as int), cast(floor(at / stride) * stride as int), stride)"))
        )
        windows = windows.withColumn("window", F.expr("slice(near, start - base + 1, length)"))
        agree = F.exists(F.zip_with(minima(F.col("window"), bands), "bands", lambda a, b: a == b), lambda x: x)
        candidates = windows.where(agree)
        held = F.size(F.array_intersect("of", "window")) / F.size("of")
        rows.append(candidates.select("doc_id", "license", "start", held.alias("held")).where(F.col("held") >= share))
    if not rows:
        return spark.createDataFrame([], "doc_id long, license string, containment double, n_windows long, first_word int")
    every = rows[0]
    for part in rows[1:]:
        every = every.unionAll(part)
    return every.groupBy("doc_id", "license").agg(F.max("held").alias("containment"), F.countDistinct("start").alias("n_windows"), F.min("start").alias("first_word"))
