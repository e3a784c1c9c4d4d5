import difflib
import random

from pyspark.sql import functions as F

from tamiz.operators import preflight


def best(asked, known, top=3):
    return sorted((k, j, p, -x) for k, a in asked for j, (x, p) in enumerate(sorted((-difflib.SequenceMatcher(None, a, b).ratio(), p) for p, b in known)[:top], 1))


def ranked(pairs, top=3):
    found = {}
    for r in pairs.collect():
        found.setdefault(r.document_id, []).append((-difflib.SequenceMatcher(None, r.a, r.b).ratio(), r.path))
    return sorted((k, j, p, -x) for k, v in found.items() for j, (x, p) in enumerate(sorted(v)[:top], 1))


def test_path_candidates_of_numbered_names_are_few(spark):
    known = [(f"p{k}", f"supplier {k:09d}") for k in range(2000)]
    asked = [(k, f"suplier {k * 37:09d}") for k in range(0, 400, 10)]
    pairs = preflight.candidates(spark.createDataFrame(asked, "document_id int, a string"), spark.createDataFrame(known, "path string, b string"), 0.0, 3)
    assert pairs.count() < 0.02 * len(asked) * len(known)
    assert ranked(pairs) == best(asked, known)


def test_path_candidates_of_long_and_odd_texts(spark, monkeypatch):
    for name, n in (("KNOWN", 16), ("ASKED", 2), ("CELLS", 600)):
        monkeypatch.setattr(preflight, name, n)
    r = random.Random(3)
    said = ["".join(r.choice("abcd ñ😀\x00") for _ in range(r.choice((0, 3, 63, 64, 65, 130, 230)))) for _ in range(60)]
    known = [(f"p{k}", t) for k, t in enumerate(said)] + [(f"q{k}", said[3]) for k in range(5)]  # five more paths of one text
    asked = [(k, "".join(c for c in t if r.random() > 0.2)) for k, t in enumerate(said[::5])] + [(90, said[3]), (91, said[3])]
    pairs = preflight.candidates(spark.createDataFrame(asked, "document_id int, a string"), spark.createDataFrame(known, "path string, b string"), 0.0, 3)
    assert ranked(pairs) == best(asked, known)
    assert pairs.where(F.col("ratio").isNull()).count() == 0
