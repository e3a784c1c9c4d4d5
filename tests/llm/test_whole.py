"""What the operators owe to whole inputs: near copies by five words, blocks of items, repeated and null ids."""

import random

import numpy as np
import pytest

import corpus_pipeline
from tamiz.llm import common, decontaminate, quality, shingles, simhash
from tamiz.llm.components import components


def similarity(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def changed(words, places):
    return " ".join(f"x{k}" if k in places else w for k, w in enumerate(words))


def test_near_copies_stage_drops_copies_of_similarity_four_fifths(spark):
    r = random.Random(5)
    base = [[f"w{r.randint(0, 999)}" for _ in range(200)] for _ in range(12)]
    texts = [t for w in base for t in (" ".join(w), changed(w, {0, 40, 90}), changed(w, {20, 60, 100, 140, 180}))]
    assert all(similarity(*texts[k : k + 2]) >= 0.8 > similarity(texts[k], texts[k + 2]) for k in range(0, 36, 3))
    assert sum((simhash.fingerprint_of(texts[k].encode()) ^ simhash.fingerprint_of(texts[k + 1].encode())).bit_count() > 3 for k in range(0, 36, 3)) > 3
    got = corpus_pipeline.near_copies(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "").collect()
    assert sorted(r.doc_id for r in got) == [k for k in range(36) if k % 3 != 1] and all(r.text == texts[r.doc_id] for r in got)


def test_near_copies_join_a_long_list(spark):
    words = [f"w{k}" for k in range(300)]
    rows = [(k, changed(words, {k})) for k in range(100)]
    assert len({shingles.shingles_of(t.encode()).tobytes() for _, t in rows}) == 100
    assert [r.doc_id for r in shingles.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [0]


def test_classes_of_long_lists_are_whole(spark, monkeypatch):
    """One list of chains whose links reach four nodes only, and strangers: few are similar to the least, and pivots come in several rounds."""
    monkeypatch.setattr(shingles, "TOGETHER", 100)
    r = random.Random(6)
    sets = [list(range(1000 * c + k, 1000 * c + k + 40)) for c in range(3) for k in range(0, 320, 4)]
    sets += [[10_000 + 50 * k + j for j in range(40)] for k in range(60)]
    sets = dict(zip(r.sample(range(10**9), len(sets)), sets, strict=True))
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 5 * len(set(sets[a]) & set(sets[b])) >= 4 * len(set(sets[a]) | set(sets[b])):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    want = {d: find(d) for d in sets}
    assert len(set(want.values())) == 63
    nodes = spark.createDataFrame([(d, 40, [7, 8]) for d in sets], "node long, size long, keys array<long>")
    members = common.cut(shingles._members(nodes), "members")
    assert members.count() == len(sets)  # of two equal lists one
    got = {r.node: r.root for r in shingles._classes(members, spark.createDataFrame(list(sets.items()), "node long, set array<long>")).collect()}
    assert all(got.get(d, d) == x for d, x in want.items())


@pytest.mark.parametrize("block", [1_000_000, 15])
def test_decontaminate_does_not_depend_on_blocks(spark, block):
    words = [f"w{k}" for k in range(200)]
    part = lambda a, b: " ".join(words[a:b])
    bench = spark.createDataFrame([(1, part(0, 15)), (2, part(7, 22)), (3, part(100, 112)), (4, part(120, 132))], "item_id long, text string")
    # 22 words that two items cover; a stranger on each side of a cut; 12 of 40 words hit by each of two items
    rows = [(1, f"a {part(0, 22)} " + part(30, 60)), (2, part(100, 107) + " " + part(0, 15) + " " + part(107, 112) + " " + part(40, 60)), (None, part(100, 112) + " z " + part(120, 132) + " " + part(40, 55)), (None, "q")]
    got = decontaminate.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), bench, block_words=block).collect()
    want = [(None, "q"), (1, f"a  {part(30, 60)}"), (2, part(100, 107) + "  " + part(107, 112) + " " + part(40, 60))]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("block", [1_000_000, 12])
def test_matches_keep_rows_of_repeated_and_null_ids(spark, block):
    items = [" ".join(f"{c}{k}" for k in range(12)) for c in "ab"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = [(1, items[0]), (1, "x " + items[1]), (1, "y"), (None, items[1]), (None, "z z"), (None, None)]
    got = decontaminate.matches(spark.createDataFrame(rows, "doc_id long, text string"), bench, block_words=block).collect()
    want = [(1, 12, [[0, 12]], ["0"]), (1, 13, [[1, 13]], ["1"]), (1, 1, [], []), (None, 12, [[0, 12]], ["1"]), (None, 2, [], []), (None, 0, [], [])]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


@pytest.mark.parametrize("keep", [simhash.keep_one, shingles.drop_near_copies])
def test_one_row_stays_with_repeated_and_null_ids(spark, keep):
    one, two, three = (" ".join(f"{c}{k}" for k in range(30)) for c in "abc")
    rows = [(None, one), (None, one), (1, two), (1, two), (1, three), (2, three), (None, two)]
    got = keep(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(None, one), (1, two), (1, three)]))


def test_keep_good_with_repeated_and_null_ids(spark):
    one, two = (" ".join(f"{c}{k}" for k in range(30)) for c in "ab")
    rows = [(None, one, "en", "s"), (None, "short", "en", "s"), (1, two, "en", "s"), (1, "short", "en", "s")]
    got = quality.keep_good(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert sorted(r.text for r in got) == sorted([one, two])


def test_fences_differ_between_groups(spark):
    def text(k, dup, symbols):
        lines = [" ".join(f"{c}{k}w{n}" for c in "abcde") for n in range(20)]
        return "\n".join(lines[: 20 - dup] + ["same end"] * dup) + "".join(f" #{n}" for n in range(symbols))

    rows = [(k, text(k, 4 if k % 5 == 0 else 0, 0), "en", "a") for k in range(100)] + [(100 + k, text(k, 0, 90 if k % 5 == 0 else 0), "en", "b") for k in range(100)]
    rows += [(200, text(200, 4, 0), "en", "b"), (201, text(201, 0, 90), "en", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    a, b = quality.fences(quality.measures(df)).orderBy("source").collect()
    assert a.dup_lines_upper > b.dup_lines_upper and b.symbols_upper > a.symbols_upper
    kept = {r.doc_id for r in quality.judged(df).where("kept").collect()}
    assert 50 in kept and 150 in kept and not kept & {200, 201}


def test_long_lists_of_fingerprints_are_dealt_out_whole(spark):
    """3,000 fingerprints with five bytes in common, as one list and in sublists: the classes of brute force."""
    r = random.Random(11)
    base = 0x0123456789ABCDEF
    low = r.sample(range(1 << 24), 2600)
    low += [v ^ (1 << r.randrange(8)) ^ (1 << r.randrange(8, 16)) ^ (1 << r.randrange(16, 24)) for v in low[:200]] + [v ^ 7 for v in low[200:400]]
    prints = np.array(sorted({(base << 24 | v) & (1 << 64) - 1 for v in low}), np.uint64).view(np.int64)
    root = {int(f): int(f) for f in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, one in enumerate(prints):
        for other in prints[i + 1 :][np.bitwise_count((prints[i + 1 :] ^ one).view(np.uint64)) <= 3]:
            x, y = sorted((find(int(one)), find(int(other))))
            root[y] = x
    want = {f: find(f) for f in root}
    assert len(set(want.values())) < len(want) - 400
    for long in (100, 10**6):
        got = {r.node: r.root for r in components(simhash.links(spark.createDataFrame([(int(f),) for f in prints], "fp long"), long)).collect()}
        assert {f: got.get(f, f) for f in root} == want


def test_dissimilar_texts_of_one_template_make_few_pairs(spark, monkeypatch):
    """Texts with 300 words in common and 50 of their own have a similarity of 0.75: all share lists, none is a near copy, and hardly a pair is verified."""
    counted = []
    verified = shingles._verified
    monkeypatch.setattr(shingles, "_verified", lambda pairs, sets: (counted.append(pairs.count()), verified(pairs, sets))[1])
    common = [f"c{k}" for k in range(300)]
    made = {}
    for n in (150, 300):
        rows = [(k, " ".join(common + [f"own{k}w{j}" for j in range(50)])) for k in range(n)]
        assert shingles.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).count() == n
        made[n], counted[:] = sum(counted), []
    assert made[300] < 40 * 300 and made[300] < 2.5 * made[150]


def test_near_copies_come_from_the_simhash_index(spark, monkeypatch):
    """Copies at most three bits apart are found by SimHash's index without any other list; equal fingerprints of dissimilar texts link nothing."""
    r = random.Random(8)
    bases = [[f"w{r.randint(0, 999)}" for _ in range(300)] for _ in range(30)]
    texts = [t for w in bases for t in (" ".join(w), changed(w, {150}))]
    cycle = " ".join([f"c{k}" for k in range(11)] * 200)
    texts += [f"{cycle} {c}0 {c}1 {c}2" for c in "xyz"]
    prints = [simhash.fingerprint_of(t.encode()) for t in texts]
    apart = [(prints[k] ^ prints[k + 1]).bit_count() for k in range(0, 60, 2)]
    assert 5 < sum(0 < d <= 3 for d in apart) < 30 and len(set(prints[60:])) == 1 and similarity(*texts[60:62]) < 0.8
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    odds = set(range(1, 60, 2))
    assert {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()} == set(range(63)) - odds
    members = shingles._members
    monkeypatch.setattr(shingles, "_members", lambda nodes: members(nodes).limit(0))
    found = {2 * k + 1 for k, d in enumerate(apart) if d <= 3}
    assert {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()} == set(range(63)) - found
