import re

import numpy as np

import corpus_pipeline
from pyspark.sql import functions as F

from tamiz.llm import common, langid
from tests.llm.test_operators import base_spans, entropy_spans, hits, words_of


def cut_hits(text, items):
    """The text without hit words and what stands between them, or None if most words are hit."""
    hit, _ = hits(words_of(text), items)
    if len(hit) > 0.5 * len(words_of(text)):
        return None
    places = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
    gone = np.zeros(len(text), bool)
    for k in sorted(hit):
        gone[places[k][0] : places[k + 1][0] if k + 1 in hit else places[k][1]] = True
    return "".join(c for c, g in zip(text, gone, strict=True) if not g)


def redacted(text):
    out, at = "", 0
    for a, _, b in sorted(base_spans(text) + entropy_spans(text)):
        if b > at:
            out += text[at : max(a, at)] + ("" if a < at else "[SECRET]")
            at = b
    return out + text[at:]


def near_classes(texts):
    """The smallest id of each class of texts joined by links of 0.8 or more between their sets of five-word shingles."""
    sets = {}
    for d, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in ids}


def test_stages_match_brute_force(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    items = [(r.item_id, words_of(r.text)) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    stays = {r.doc_id for r in langid.identify(docs).where("lang_pred <> 'und' and score >= 0.5").collect()}
    want = {r.doc_id: r.text for r in docs.collect() if r.doc_id in stays}
    assert len(want) > 0.9 * docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, small)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k == 1:
            want = {d: want[d] for d in set(near_classes(want.items()).values())}
        if k == 2:
            want = {d: c for d, t in want.items() if (c := cut_hits(t, items)) is not None}
        if k == 3:
            want = {d: redacted(t) for d, t in want.items()}
        got = {r.doc_id: r for r in docs.collect()}
        assert {d: r.text for d, r in got.items()} == want, name
        assert all(r.n_chars == len(r.text) for r in got.values()) and docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    pieces = corpus_pipeline.run(spark, small).collect()
    assert {p.doc_id for p in pieces} == set(want) and sum(p.length for p in pieces) == sum({p.doc_id: p.doc_tokens for p in pieces}.values())


def test_stages_take_odd_rows(spark, odd, tmp_path):
    """Nulls, empty and repeated rows, ties, an empty table, and columns whose names the stages use themselves."""
    plain = "the long report of this spring tells how the rivers rose in the north and what was done about it by people who live there " * 3
    rows = [(None, plain + "token=abcdefgh12345678", "en", "a", 7, "x"), (None, plain + "token=abcdefgh12345678", "en", "a", 8, "y"), (3, None, None, None, 9, "z"), (4, "", "en", "a", 10, None), (5, "été " * 40, None, None, 11, "w")]
    rows += [(100 + k, f"{plain} {k} " + " ".join(f"w{k}x{j}" for j in range(200)), "en", "a", k, "v") for k in range(4)] + [(100, rows[0][1], "en", "a", 1, "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _row int, _secrets string").withColumn("n_chars", F.length("text").cast("long"))
    docs = docs.withColumns({"node": F.lit(1), "keys": F.lit("k"), "spans": F.lit("s"), "start": F.lit(0)})
    bench = spark.createDataFrame([(1, None), (2, "")], "item_id long, text string")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    for df in (docs, docs.limit(0)):
        found = df
        for name, stage in corpus_pipeline.STAGES[:-1]:
            found = stage(spark, found, str(tmp_path))
            assert found.columns == df.columns, name
            found.write.parquet(str(tmp_path / f"{name}-{df is docs}"))
            found = spark.read.schema(found.schema).parquet(str(tmp_path / f"{name}-{df is docs}"))
        got = found.collect()
        if df is docs:
            assert sorted((r.doc_id, r._row, r._secrets) for r in got if r.doc_id and r.doc_id < 104 and r.doc_id > 99 and r._row < 4) and {r.doc_id for r in got} >= {101, 102, 103}
            assert sum("[SECRET]" in r.text for r in got) == 1 and all(r.keys == "k" and r.spans == "s" for r in got)
            assert [r._secrets for r in got if "[SECRET]" in r.text] == ["u"]  # of equal texts the row with the least doc_id, nulls last
        else:
            assert not got
        assert corpus_pipeline.STAGES[-1][1](spark, found, str(tmp_path)).count() >= len(got)


def test_run_leaves_no_tables_behind(spark, small):
    import os

    def folders():
        at = f"{common.shared_folder(spark)}/tamiz"
        return set(os.listdir(at)) if os.path.isdir(at) else set()

    before = folders()
    out = corpus_pipeline.run(spark, small)
    assert [x.split("-")[0] for x in folders() - before] == ["secret_scan"]  # the last stage's input
    assert out.count()
