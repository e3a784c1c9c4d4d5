"""The automaton against brute force on its own, its size, and blocks that split long items."""

import pickle
import random

import numpy as np
import pytest

from tamiz.llm import decontaminate
from tests.llm.test_operators import hits


def test_scan_equals_brute_force():
    r = random.Random(8)
    for trial in range(60):
        letters = "abc" if trial % 2 else "abcdefghij"
        text = lambda n: [r.choice(letters).encode() for _ in range(n)]
        items = [text(r.choice([0, 1, 3, 8, 9, 10, 11, 30, 80])) for _ in range(8)]
        docs = [text(r.choice([0, 2, 30, 900])) + (r.choice(items) if trial % 3 else []) + text(5) for _ in range(6)]
        hit, doc, item = decontaminate.Automaton.build(items, 10).scan(docs)
        at = 0
        for k, words in enumerate(docs):
            want, found = hits(words, list(enumerate(items)))
            assert set(np.flatnonzero(hit[at : at + len(words)]).tolist()) == want
            assert sorted(str(x) for x in set(item[doc == k].tolist())) == found
            at += len(words)


def test_a_block_of_items_is_small():
    r = np.random.default_rng(0)
    vocabulary = [f"word{k}".encode() for k in range(50_000)]
    items = [[vocabulary[k] for k in r.integers(0, 50_000, 100)] for _ in range(500)]
    made = decontaminate.Automaton.build(items, 10)
    arrays = sum(v.nbytes for v in vars(made).values() if isinstance(v, np.ndarray))
    assert arrays < 60 * 50_000 and len(pickle.dumps(made)) < 6_000_000  # 60 bytes a word, and the words themselves


@pytest.mark.parametrize("block", [25, 60, 1_000_000])
def test_a_long_item_may_lie_in_several_blocks(spark, block):
    words = [f"w{k}" for k in range(300)]
    bench = spark.createDataFrame([(1, " ".join(words)), (1, "again the first id with other words that are enough here"), (2, " ".join(words[290:]) + " tail")], "item_id long, text string")
    rows = [(k, "x " + " ".join(words[a : a + n]) + " y") for k, (a, n) in enumerate([(0, 9), (0, 10), (17, 10), (55, 30), (120, 180), (291, 9)])]
    got = {r.doc_id: (r.n_words, r.spans, r["items"]) for r in decontaminate.matches(spark.createDataFrame(rows, "doc_id long, text string"), bench, block_words=block).collect()}
    assert got == {0: (11, [], []), 1: (12, [[1, 11]], ["1"]), 2: (12, [[1, 11]], ["1"]), 3: (32, [[1, 31]], ["1"]), 4: (182, [[1, 181]], ["1", "2"]), 5: (11, [], [])}
