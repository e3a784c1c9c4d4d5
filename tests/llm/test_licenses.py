"""License scans: bands, every template on its own, and recall under edits."""

import random

import pytest
from pyspark.sql import functions as F

from tamiz.llm import licenses

PLAIN = "the report of this spring tells how rivers rose in the north and what was done about it by the people who live there".split()


def test_minima_equal_the_templates_band_values(spark):
    of = [3, -7, 1 << 60, 12345, -(1 << 62)]
    got = spark.range(1).select(licenses.minima(F.array(*[F.lit(x).cast("bigint") for x in of]), 8).alias("m")).first().m
    assert got == [min(licenses.band_value(x, j) for x in of) for j in range(8)]
    assert len(set(got)) == 8


def test_every_template_alone_is_found(spark):
    names = sorted(licenses.TEMPLATES)
    rows = [(k, " ".join(PLAIN[: k % 20]) + " " + licenses.TEMPLATES[n] + " " + " ".join(PLAIN)) for k, n in enumerate(names)]
    got = {(r.doc_id, r.license) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).where("containment = 1").collect()}
    assert {(k, n) for k, n in enumerate(names)} <= got


@pytest.mark.parametrize("share", [0.9, 0.82])
def test_recall_under_edits(spark, share):
    """Words of whole texts are changed, as long as the text keeps ``share`` of its shingles; of such texts 99 % or more are found."""
    r, rows = random.Random(3), []
    for name in sorted(licenses.TEXTS):
        words = licenses.TEXTS[name].split()
        for _ in range(40):
            now = list(words)
            of = {tuple(licenses_words(words)[i : i + 5]) for i in range(len(licenses_words(words)) - 4)}
            while True:
                k = r.randrange(len(now))
                was, now[k] = now[k], f"zz{r.randint(0, 9999)}"
                own = licenses_words(now)
                if len({tuple(own[i : i + 5]) for i in range(len(own) - 4)} & of) < share * len(of):
                    now[k] = was
                    break
            rows.append((len(rows), name, " ".join(PLAIN[: r.randrange(20)] + now + PLAIN)))
    found = licenses.scan(spark.createDataFrame([(k, t) for k, _, t in rows], "doc_id long, text string"))
    got = {(x.doc_id, x.license) for x in found.collect()}
    assert sum((k, n) in got for k, n, _ in rows) >= 0.99 * len(rows)


def licenses_words(words):
    import re

    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ".join(words).lower()) if w]
