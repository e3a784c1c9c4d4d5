"""Secrets in long texts: one long run, and very many matches."""

import hashlib
import random
import time

from tamiz.llm import secrets
from tests.llm.test_operators import check_secrets
from tests.llm.test_pipeline import redacted

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def test_long_runs_and_many_matches(spark):
    r = random.Random(4)
    run = "".join(r.choice(ALPHABET) for _ in range(1_000_000))
    low = "aB3-" * 50_000
    many = " ".join(f"token={hashlib.md5(str(k).encode()).hexdigest()[:14]}" for k in range(50_000))
    texts = {0: "x " + run + " y", 1: low, 2: many, 3: "key " + low[:5000] + run[:40] + " end", 4: "é" * 70_000 + " " + "0f" * 40_000}
    df = spark.createDataFrame(list(texts.items()), "doc_id int, text string")
    began = time.time()
    got = {x.doc_id: x for x in secrets.scan(df).collect()}
    cleaned = {x.doc_id: x.text for x in secrets.redact(df).collect()}
    assert time.time() - began < 90
    assert got[0].spans.split(",")[-1] == "entropy:2:1000002" and got[1].spans == "" and got[2].n_assign == 50_000 and got[3].spans == "entropy:4:5044"
    check_secrets({k: got[k].asDict() for k in (2, 4)}, {k: texts[k] for k in (2, 4)})
    assert cleaned == {k: redacted(t) for k, t in texts.items()}


def test_overlapping_spans_in_groups(spark):
    r = random.Random(9)
    part = lambda: r.choice(["token=", "AKIA", "password: ", " ", "é", "=", "".join(r.choice("0123456789abcdef") for _ in range(r.randint(1, 30))), "".join(r.choice(ALPHABET) for _ in range(r.randint(1, 40)))])
    texts = {k: "".join(part() for _ in range(r.randint(0, 700))) for k in range(60)}
    df = spark.createDataFrame(list(texts.items()), "doc_id int, text string")
    check_secrets({x.doc_id: x.asDict() for x in secrets.scan(df).collect()}, texts)
    assert {x.doc_id: x.text for x in secrets.redact(df).collect()} == {k: redacted(t) for k, t in texts.items()}
