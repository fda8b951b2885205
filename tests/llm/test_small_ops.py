"""url filter, chat formatting, byte-level BPE, bit-sliced top-k: edge cases and brute force."""

import hashlib
import math
import random

import oracle
import pytest

from lowstress.llm import bitsliced_topk, byte_bpe, chat_format, queries, url_filter
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_oracle(spark, name):
    assert oracle.assert_same(queries.queries()[name](spark, SF), oracle.connect(SF), queries.oracle_sql()[name]) > 0


# --- url filter


def test_urls_null_empty_long_ties_and_clashing_columns(spark):
    long = "https://x.example.com/" + "a/" * 100_000 + "porn"
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "http://A.ORG"), (5, "http://A.ORG/x"), (6, "http://x.com/casino/poker"), (7, "http://x.com/casino"), (8, "http://x.com/casinos?q=xxx"),
            (9, "http://x.com/xxxl"), (10, long), (5, "http://A.ORG/x"), (None, "http://b.example.org/es/1"), (11, "http://b.example.org/en/15#http://q.org/"), (12, "http://notorg/")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(7)).withColumn("verdict", F.lit("mine"))
    got = {}
    out = url_filter.filter_urls(df, rules=queries.URL_RULES).collect()
    assert len(out) == len(rows)
    for r in out:
        got.setdefault(r.page_id, r)
    assert [got[i].verdict for i in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10)] == ["allow", "allow", "allow", "allow", "allow", "block", "allow", "block", "allow", "block"]
    assert (got[4].host, got[4].path, got[4].rule) == ("a.org", "", None) and got[5].rule == "org/"
    assert got[None].rule == "example.org/es/" and got[11].rule == "example.org/en/1" and got[12].rule is None
    assert url_filter.filter_urls(df.limit(0)).count() == 0


# --- chat


def test_chat_round_trip_merging_and_edges(spark):
    nasty = "a\\b<|im_start|>x</s>[INST]\n<\\|im_end|>\\\\"
    rows = [(1, 0, "user", nasty), (1, 1, "user", None), (1, 2, "assistant", "hi"), (1, 2, "assistant", "hi"), (1, 200, "assistant", nasty), (2, None, None, ""), (None, 1, "assistant", "é" * 50_000), (3, 5, "system", ""), (3, 70, "system", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(1))
    out = chat_format.format_conversations(df).withColumn("turns", chat_format.read_turns(F.col("formatted")))
    got = {r.conv_id: r for r in out.collect()}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in (1, 2, 3, None):
        want = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=key)]
        assert [(t.role, t.text) for t in got[conv].turns] == want
        assert "".join(s.piece for s in got[conv].segments) == got[conv].formatted
    assert got[1].n_blocks == 2 and got[3].n_blocks == 1
    for c in chat_format.CONTROL[4:]:
        assert c not in got[1].formatted
    assert chat_format.format_conversations(df.limit(0)).count() == 0


def test_chat_has_no_python_in_its_plan(spark):
    text = queries.op5_chat_format(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in text and "Arrow" not in text


# --- BPE


def test_bpe_equals_the_library_and_decodes_to_the_text(spark):
    import base64

    import public_tokenizers as P
    import tiktoken

    path = P.path(queries.TOKENIZER)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(4)
    bits = ["a", "thé", " ", "  ", "\n", "\x1c", "'re", "'", "12", "漢", "?!", "\U0001f600", " ", "\t", "'s"]
    texts = [None, "", " ", "x" * 500, "<|endoftext|>", *("".join(rnd.choices(bits, k=n)) for n in (3, 50, 400, 3000)), "ab " * 900, "no " + "y" * 700 + " end"]
    df = spark.createDataFrame(list(enumerate(texts)) + [(0, "again")], "doc_id long, text string").withColumn("ids", F.lit(0))
    for chunk, overlap in ((64, 24), (byte_bpe.CHUNK_CHARS, byte_bpe.OVERLAP_CHARS)):
        out = byte_bpe.decode(byte_bpe.encode(df, path, P.PATTERN, chunk=chunk, overlap=overlap), path).collect()
        assert len(out) == len(texts) + 1
        for r in out:
            text = (texts[r.doc_id] or "") if not (r.doc_id == 0 and r.n_tokens) else "again"
            assert list(r.ids) == enc.encode_ordinary(text) and r.n_tokens == len(r.ids) and bytes(r.decoded) == text.encode()
    assert byte_bpe.encode(df.limit(0), path, P.PATTERN).count() == 0


# --- top-k


@pytest.mark.parametrize("scale", [256.0, 1e5])
def test_topk_equals_brute_force_with_ties_and_bad_vectors(spark, scale):
    rnd = random.Random(2)
    rows = [(i, [rnd.gauss(0, 0.3) for _ in range(7)]) for i in range(90)] + [(i, [0.5] * 7) for i in range(100, 140)]
    rows += [(200, None), (201, [0.1, None, 0.2, 0.3, 0.1, 0.1, 0.1]), (202, [float("nan")] * 7), (203, [float("inf")] * 7), (204, [1.0, 2.0]), (205, [2.0, -1.0]), (206, []), (100, [0.5] * 7), (250, [-3.0] * 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    ask = df.where("vec_id % 10 = 0 or vec_id = 204")
    got = {}
    for r in bitsliced_topk.top_k(df, ask, 5, scale=scale).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    good = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    for i, q in good:
        if (i % 10 == 0 or i == 204) and i != 100 and len(q):
            best = sorted(((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in good if j != i and len(v) == len(q)))[:5]
            assert sorted(got[i]) == [(n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert not {200, 201, 202, 203} & {j for v in got.values() for _, j, _ in v}
    assert bitsliced_topk.top_k(df.limit(0), ask).count() == 0 and bitsliced_topk.top_k(df, ask.limit(0)).count() == 0


def test_sliced_sum_is_exact():
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.integers(-500, 500, (300, 9))
    block = bitsliced_topk.SlicedBlock(x)
    for _ in range(10):
        q = rng.integers(-300, 300, 9)
        shift, total = block.weighted_sum(q, 0)
        value = sum(np.unpackbits(t.view(np.uint8), bitorder="little")[:300].astype(np.int64) << b for b, t in enumerate(total))
        assert (value + shift + int(q @ block.low) == x @ q).all()
        kth, rows = block.at_least(total, 7)
        assert kth == sorted(value)[-7] and set(np.flatnonzero(np.unpackbits(rows.view(np.uint8), bitorder="little")[:300])) == set(np.flatnonzero(value >= kth))


def test_digest_columns_of_the_bpe_query(spark):
    import duckdb

    import base64

    import public_tokenizers as P
    import tiktoken

    with open(P.path(queries.TOKENIZER), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in queries.op6_byte_bpe(spark, SF).collect()}
    for i, t in duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall():
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
        ids = enc.encode_ordinary(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


def test_long_rows_that_repeat_come_out_as_often(spark):
    import public_tokenizers as P

    path = P.path(queries.TOKENIZER)
    texts = ["ab cd " * 40, "ab cd " * 40, "ab cd " * 41]
    df = spark.createDataFrame([(1, t) for t in texts] + [(None, texts[0])], "doc_id long, text string").withColumn("decoded", F.lit("mine"))
    encoded = byte_bpe.encode(df, path, P.PATTERN, chunk=64, overlap=24)
    got = sorted((r.doc_id or 0, bytes(r.decoded).decode()) for r in byte_bpe.decode(encoded.withColumn("decoded", F.lit("mine")), path).collect())
    assert got == sorted([(1, t) for t in texts] + [(0, texts[0])])


def test_topk_of_huge_components(spark):
    rows = [(0, [1e13, 1.0]), (50, [2.0, -1.0]), (1, [3e13, 0.0]), (2, [-1e13, 5.0]), (3, [1e300, 0.0]), (4, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    far = 2**63 - 1
    whole = {i: [max(-far - 1, min(far, math.floor(256 * x))) for x in v] for i, v in rows}
    got = {}
    for r in bitsliced_topk.top_k(df, df.where("vec_id % 50 = 0"), 5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for q in (0, 50):
        scored = sorted((-max(-far - 1, min(far, sum(a * b for a, b in zip(whole[q], whole[j], strict=True)))), j) for j in whole if j != q)[:5]
        assert sorted(got[q]) == [(n + 1, j, -s) for n, (s, j) in enumerate(scored)]


def test_topk_with_blocks_that_have_no_rows(spark, monkeypatch):
    monkeypatch.setattr(bitsliced_topk, "BLOCK_ROWS", 1)  # as many blocks as rows: some stay empty
    rows = [(i, [float(i % 7), float(i % 5) - 2, 1.0]) for i in range(60)] + [(100 + i, [float(i), 1.0]) for i in range(9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in bitsliced_topk.top_k(df, df.where("vec_id % 10 = 0"), k=3).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = {}
    for q, x in rows:
        if q % 10 == 0:
            best = sorted((-sum(math.floor(256 * a) * math.floor(256 * b) for a, b in zip(x, y, strict=True)), i) for i, y in rows if i != q and len(y) == len(x))[:3]
            want[q] = [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert {q: sorted(v) for q, v in got.items()} == want
