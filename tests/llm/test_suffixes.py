"""The family of suffix arrays: order, levels, new batches; and odd rows against brute force."""

import random
import uuid

from tamiz.llm import suffixes
from tamiz.llm.common import shared_folder
from tests.llm.test_operators import check_repeats, without_repeats


def texts_of(r, passages, n):
    some = lambda k: "".join(r.choice("abcdefghij ") for _ in range(k))
    return [some(r.randint(0, 400)) + (r.choice(passages) if r.random() < 0.6 else "") + some(r.randint(0, 400)) for _ in range(n)]


def test_sampled_suffixes_are_in_byte_order():
    r = random.Random(1)
    text = bytes(r.choice(b"\x00a\x7f\x80\xff") for _ in range(5000))
    first, count, anchor, hi, lo, head = suffixes.runs(text)
    assert count.sum() == len(text) - 199 and (anchor >= first + count - 1).all() and (anchor + suffixes.HEAD <= first + 200).all()
    order = sorted(range(len(anchor)), key=lambda k: (hi[k], lo[k]))
    heads = [text[anchor[k] : anchor[k] + 16] for k in order]
    assert heads == sorted(heads)


def test_levels_are_logarithmic_and_take_new_batches(spark):
    r = random.Random(2)
    passages = ["".join(r.choice("abcdefghij ") for _ in range(600)) for _ in range(4)]
    batches = [texts_of(r, passages, 40) for _ in range(7)]
    family, seen = suffixes.Family(spark), []
    for k, texts in enumerate(batches):
        found = f"{shared_folder(spark)}/found-{uuid.uuid4().hex}"
        runs = suffixes.sampled(spark.createDataFrame([(100 * k + j, t) for j, t in enumerate(texts)], "doc_id long, text string"))
        family.add(runs, found)
        got = {x.head for x in spark.read.schema("head long, several boolean").parquet(found).collect()}
        own = [h for t in texts for h in suffixes.runs(t.encode())[5].tolist()]
        assert got == {h for h in own if h in seen or own.count(h) > 1}
        seen += own
    assert len(family.levels) == 3 and [x.size for x in family.levels] == sorted((x.size for x in family.levels), reverse=True)
    assert sum(x.size for x in family.levels) == len(seen)
    array = spark.table(family.levels[0].name)
    assert array.where("n > 1").count() and not array.where("several and n < 2").count()
    one = array.select("own", "position", "hi", "lo").first()
    text = batches[one.own // 100][one.own % 100].encode()
    assert [int.from_bytes(text[one.position + k : one.position + k + 8], "big") - (1 << 63) for k in (0, 8)] == [one.hi, one.lo]
    family.add(runs.limit(0), found)
    assert len(family.levels) == 3
    family.close()
    assert not family.levels


def test_many_batches_give_the_same_result(spark):
    r = random.Random(3)
    passages = ["".join(r.choice("abcdefghij ") for _ in range(k)) for k in (201, 260, 500)]
    check_repeats(spark, texts_of(r, passages, 60), batches=7)


def test_repeats_of_odd_rows(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()] + [(None, "q" * 150 + "é" * 100), (None, "q" * 150 + "é" * 100), (None, None), (7, "z" + "é" * 110)]
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, text string, doc int, own int")
    got = sorted(map(str, ((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(df).collect())))
    want = without_repeats([(t or "").encode() for _, t in rows])
    assert got == sorted(str((d, *w)) for (d, _), w in zip(rows, want, strict=True))
    kept = suffixes.remove_repeats(df, with_text=True).collect()
    assert all(len(r.kept) == r.n_bytes - r.n_removed for r in kept)
