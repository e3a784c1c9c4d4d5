"""Alignment against a plain walk over both tokenizers' tokens."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tamiz.llm import alignment, queries


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(queries.tokenizer_path())
    a.encode_special_tokens = True
    kept = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or 174 <= c <= 255]
    shown = {chr(c): c for c in kept} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in kept)}
    return a, {c: bytes([b]) for c, b in shown.items()}, sentencepiece.SentencePieceProcessor(model_file=queries.piece_path())


def expected(rows, tokenizers):
    a, shown, b = tokenizers
    docs, count = [], Counter()
    for doc_id, text in rows:
        ta = [(k, b"".join(shown[c] for c in a.id_to_token(k))) for k in a.encode(" " + text, add_special_tokens=False).ids] if text else []
        tb = [(k, bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode()) for k in b.encode(text)] if text else []
        if not text or not b"".join(x for _, x in ta) == b"".join(x for _, x in tb) == (" " + text).encode():
            ta = tb = []
        at, ends = [0, 0], []
        for side, tokens in enumerate((ta, tb)):
            ends.append({})
            for k, (i, x) in enumerate(tokens):
                at[side] += len(x)
                ends[side][at[side]] = (k, i)
        shared = sorted(ends[0].keys() & ends[1].keys())
        links = [(ends[0][e][1], ends[1][e][1]) for e in shared]
        groups, i, j = [], 0, 0
        for e in shared:
            x, y = ends[0][e][0] + 1, ends[1][e][0] + 1
            groups.append(",".join(str(k) for k, _ in ta[i:x]) + "|" + ",".join(str(k) for k, _ in tb[j:y]))
            i, j = x, y
        count.update(links)
        docs.append((doc_id, len(ta), len(tb), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    most = Counter()
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    return sorted(str((d, x, y, g, len(ls), sum(count[p] == most[p[1]] for p in ls), sum(count[p] for p in ls), h)) for d, x, y, g, ls, h in docs)


def told(df):
    return sorted(str((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)) for r in df.collect())


def test_documents_equal_a_plain_walk(spark, small, tokenizers):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert told(queries.op12_alignment(spark, small)) == expected(rows, tokenizers)


def test_odd_texts(spark, odd, tokenizers):
    """Null, empty, blank, long and repeated texts, other white space, special tokens' strings, U+2581, a NUL, null ids, over several blocks."""
    more = ["<|endoftext|> and <s> x </s>", "a▁b", "\x00a", "a   b \n\n\t c ", "ﬁ é 日本 😀", " ", "  lead", "　", "don't", "x" * 5000, "<unk>"]
    df = odd.select("doc_id", "text", F.lit(1).alias("block"), F.lit("x").alias("links")).unionByName(spark.createDataFrame([(None if k == 3 else 100 + k, t, 2, "y") for k, t in enumerate(more)], "doc_id long, text string, block int, links string"))
    rows = [(r.doc_id, r.text) for r in df.collect()]
    want = expected(rows, tokenizers)
    assert told(alignment.align(df.repartition(5), queries.tokenizer_path, queries.piece_path)) == want
    assert sum("''" in x for x in want) == 3
    assert alignment.align(df.limit(0), queries.tokenizer_path, queries.piece_path).count() == 0
