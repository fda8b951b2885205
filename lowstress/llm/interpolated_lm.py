"""Deleted interpolation: n-gram maximum-likelihood estimates mixed by context-frequency buckets.

Counts are exact 64-bit-hash counts over all training texts. Texts are dealt into blocks; a block
sends the distinct n-grams of its texts, with its own counts, once to the bucket that owns them
(sorted and packed, so a row is an array, not an n-gram); buckets add up the blocks' counts and send
the totals back; blocks then look up every token locally.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lowstress.llm import text as T
from lowstress.llm.blocks import by_block, unblock
from lowstress.llm.sampling import crc_mod
from lowstress.storage import materialize

#: Context-frequency buckets: powers of two up to this many; bins of a component's log-ratio for the EM statistics.
BUCKETS, BINS, ROUNDS = 24, 48, 60
#: Rows of a block; one training text in HELD has its counts deleted while the mixture weights are learned.
BLOCK_ROWS, HELD = 4096, 10
END = T.mix(np.array([0x656E64], np.uint64))[0]
START = T.mix(np.array([0x7374617274], np.uint64))[0]
_TAIL = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def token_stream(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts' tokens (words, then one end each), the token before (a start), and the token offsets."""
    words, offs = T.word_hashes(column)
    n = np.diff(offs)
    out = np.concatenate([[0], np.cumsum(n + 1)])
    tokens = np.full(int(out[-1]), END, np.uint64)
    tokens[np.repeat(out[:-1], n) + T.ramp(n)] = words
    before = np.concatenate([[START], tokens[:-1]]).astype(np.uint64)
    before[out[:-1][: len(n)]] = START
    return tokens, before, out


def pair_keys(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return T.mix(before * _TAIL[0] + tokens * _TAIL[1])


def pack(sorted_keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys as bytes: their differences in as many bytes as the largest needs."""
    if not len(sorted_keys):
        return b""
    d = np.diff(sorted_keys, prepend=np.uint64(0))
    rest = d[1:]
    width = max(1, -(-int(rest.max()).bit_length() // 8)) if len(rest) else 1
    return bytes([width]) + d[:1].tobytes() + np.ascontiguousarray(rest.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    width = data[0]
    rest = np.frombuffer(data, np.uint8, -1, 9).reshape(-1, width)
    body = np.zeros((len(rest) + 1, 8), np.uint8)
    body[0] = np.frombuffer(data, np.uint8, 8, 1)
    body[1:, :width] = rest
    return np.cumsum(body.view(np.uint64).ravel())


def pack_counts(x: np.ndarray) -> bytes:
    """Counts, mostly 0 to 2: two bits each, and those of 3 or more in full."""
    small = np.minimum(x, 3).astype(np.uint8)
    pad = np.zeros(-(-len(x) // 4) * 4, np.uint8)
    pad[: len(x)] = small
    quads = pad.reshape(-1, 4)
    head = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    large = x[x >= 3]
    kind = np.uint16 if not len(large) or large.max() < 1 << 16 else np.uint64
    return np.int64(len(x)).tobytes() + bytes([np.dtype(kind).itemsize]) + head.astype(np.uint8).tobytes() + large.astype(kind).tobytes()


def unpack_counts(data: bytes) -> np.ndarray:
    n, size = int(np.frombuffer(data, np.int64, 1)[0]), data[8]
    quads = np.frombuffer(data, np.uint8, -(-n // 4), 9)
    out = np.stack([quads & 3, quads >> 2 & 3, quads >> 4 & 3, quads >> 6], axis=1).ravel()[:n].astype(np.int64)
    out[out == 3] = np.frombuffer(data, np.uint16 if size == 2 else np.uint64, -1, 9 + len(quads))
    return out


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Owners by equal ranges of the key, so that sorted keys stay contiguous."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def frequency_bucket(count: np.ndarray) -> np.ndarray:
    """0 for an unseen context, then one bucket per power of two."""
    return np.minimum(BUCKETS - 1, np.where(count > 0, np.log2(np.maximum(count, 1)).astype(np.int64) + 1, 0))


def em(table: np.ndarray, ratio2: np.ndarray, ratio1: np.ndarray) -> np.ndarray:
    """Mixture weights of (pair, word, uniform) in each bucket from counts by binned likelihood ratios.

    ``table`` counts held-out tokens by bucket and by the bins of pair/uniform and word/uniform
    likelihood. A bucket's prior is the overall mixture, worth ten tokens, so empty ones are defined.
    """

    def run(t: np.ndarray, prior: np.ndarray) -> np.ndarray:
        w = np.full(3, 1 / 3)
        for _ in range(ROUNDS):
            parts = np.stack([w[0] * ratio2[:, None] + 0 * ratio1[None], w[1] * ratio1[None] + 0 * ratio2[:, None], np.full((BINS, BINS), w[2])])
            share = (t * parts / parts.sum(axis=0)).sum(axis=(1, 2)) + 10 * prior
            w = share / share.sum()
        return w

    overall = run(table[1:].sum(axis=0), np.array([0.2, 0.6, 0.2]))
    out = np.stack([run(t, overall) for t in table])
    out[0, 1:] /= out[0, 1:].sum()  # no pair estimate in an unseen context
    out[0, 0] = 0
    return out


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", split: int = 10) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row's whole text.

    Learned from the texts whose crc32(id) mod ``split`` is not 0. base_score: add-0.1 unigrams;
    score: sum of log10 of w2 * c(v,t)/c(v) + w1 * c(t)/N + w0 / (V+1) with the weights of v's frequency
    bucket; an unknown token is one outcome, of which only the last part remains. Weights come from
    expectation-maximisation on one training text in HELD, with its own counts taken away; the
    statistics are a histogram of fixed size.

    Null texts are empty (one token, the end); repeated ids stay separate rows; other columns are not
    read; an empty table gives no rows, and without training texts every token is unknown. Blocks and
    buckets are dealt by hash: neither a common word nor a common source makes one larger, since a
    block sends an n-gram once. Two writes to the shared folder cut the lineage.
    """
    spark = docs.sparkSession
    id_type = docs.select(id_col).schema[0].dataType.simpleString()
    n_rows = docs.count()
    blocks = max(1, -(-n_rows // BLOCK_ROWS))
    buckets = int(min(20_000, max(8, blocks)))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("held_out", crc_mod("id", split) == 0)
    # held-out counts are deleted from training texts only; such texts have blocks of their own
    rows = rows.withColumn("deleted", ~F.col("held_out") & (F.pmod(F.xxhash64("id", F.lit(5)), F.lit(HELD)) == 0))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) * 2 + F.col("deleted").cast("int"))

    packed = rows.mapInArrow(by_block, "block long, body binary")

    def ask(table: pa.Table) -> pa.Table:
        block, table = table["block"][0].as_py(), unblock(table)
        tokens, before, offs = token_stream(table["text"])
        learn = np.repeat(~table["held_out"].to_numpy().astype(bool), np.diff(offs))
        out = []
        for order, keys in ((1, tokens), (2, pair_keys(before, tokens))):
            distinct, inverse = np.unique(keys, return_inverse=True)
            counts = np.bincount(inverse[learn], minlength=len(distinct))
            cuts = np.searchsorted(bucket_of(distinct, buckets), np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(cuts)):
                part = slice(cuts[b], cuts[b + 1])
                out.append((b, block, order, pack(distinct[part]), pack_counts(counts[part])))
        cols = list(zip(*out, strict=True)) or [[]] * 5
        return pa.table([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "block", "n", "keys", "counts"])

    def answer(table: pa.Table) -> pa.Table:
        out = []
        bucket = table["bucket"][0].as_py()
        blk, order = table["block"].to_numpy(), table["n"].to_numpy()
        for n in (1, 2):
            rows_n = np.flatnonzero(order == n)
            if not len(rows_n):
                continue
            keys = [unpack(table["keys"][int(r)].as_py()) for r in rows_n]
            counts = [unpack_counts(table["counts"][int(r)].as_py()) for r in rows_n]
            gone = [c * int(blk[r] % 2) for c, r in zip(counts, rows_n, strict=True)]
            distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(inverse, np.concatenate(counts), len(distinct)).astype(np.int64)
            deleted = np.bincount(inverse, np.concatenate(gone), len(distinct)).astype(np.int64)
            if n == 1:
                out.append((-1, n, -1, int(total.sum()), int((total > 0).sum()), int(deleted.sum()), b"", b""))
            at = 0
            for r, k in zip(rows_n, keys, strict=True):
                own = inverse[at : at + len(k)]
                at += len(k)
                odd = blk[r] % 2  # only these blocks need the counts without the deleted texts
                out.append((int(blk[r]), n, bucket, 0, 0, 0, pack_counts(total[own]), pack_counts((total - deleted)[own]) if odd else b""))
        cols = list(zip(*out, strict=True))
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["block", "n", "bucket", "tokens", "words", "deleted", "total", "kept"])

    asked = packed.groupBy("block").applyInArrow(ask, "bucket int, block long, n int, keys binary, counts binary")
    answers = asked.groupBy("bucket").applyInArrow(answer, "block long, n int, bucket int, tokens long, words long, deleted long, total binary, kept binary")
    answers = materialize(answers, "ngram-counts")
    told = answers.where("block = -1").agg(F.sum("tokens"), F.sum("words"), F.sum("deleted")).first()
    n_all, v_all, n_deleted = (int(x or 0) for x in told)
    replies = answers.where("block >= 0").select("block", "n", "bucket", "total", "kept")

    def components(texts: pa.Array, found: pa.Table, kept: bool, n_tokens: int):
        """Per token: own count, pair estimate, word estimate, context bucket. Replies are in the order of the block's distinct n-grams."""
        tokens, before, offs = token_stream(texts)
        names, order, bucket = found["kept" if kept else "total"], found["n"].to_numpy(), found["bucket"].to_numpy()

        def count(n: int, keys: np.ndarray) -> np.ndarray:
            pick = np.flatnonzero(order == n)
            told = np.concatenate([unpack_counts(names[int(r)].as_py()) for r in pick[np.argsort(bucket[pick])]])
            return told[np.unique(keys, return_inverse=True)[1]]

        own, pairs = count(1, tokens), count(2, pair_keys(before, tokens))
        context = np.empty(len(own), np.int64)
        context[1:] = own[:-1]
        context[offs[:-1]] = own[offs[1] - 1]  # a start precedes as many texts as there are ends
        p2 = np.where(context > 0, pairs / np.maximum(context, 1), 0)
        return own, p2, own / max(1, n_tokens), frequency_bucket(context), offs

    uniform = 1 / (v_all + 1)
    top = np.log2(1 / uniform) + 1

    def bins(p: np.ndarray) -> np.ndarray:
        return np.where(p > 0, np.clip(np.round((np.log2(np.maximum(p, 1e-300) / uniform) + 4) / (top + 4) * (BINS - 2)), 0, BINS - 2) + 1, 0).astype(np.int64)

    def histogram(key, texts: pa.Table, found: pa.Table) -> pa.Table:
        flat = np.zeros(0, np.int64)
        if len(texts):
            texts = unblock(texts)
            _, p2, p1, bucket, _ = components(texts["text"], found, True, n_all - n_deleted)
            flat = (bucket * BINS + bins(p2)) * BINS + bins(p1)
        cell, n = np.unique(flat, return_counts=True)
        return pa.table({"cell": pa.array(cell, pa.int64()), "n": pa.array(n, pa.int64())})

    learn = rows.where("deleted").mapInArrow(by_block, "block long, body binary").groupBy("block").cogroup(replies.where("block % 2 = 1").groupBy("block"))
    cells = learn.applyInArrow(histogram, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    counted = np.zeros(BUCKETS * BINS * BINS)
    counted[cells["cell"].to_numpy(np.int64)] = cells["n"].to_numpy(float)
    ratio = np.concatenate([[0], 2 ** np.linspace(-4, top, BINS - 1)])
    weights = em(counted.reshape(BUCKETS, BINS, BINS), ratio, ratio)

    def judge(key, texts: pa.Table, found: pa.Table) -> pa.Table:
        if not len(texts):
            return pa.table([pa.array([], f.type) for f in result], schema=result)
        texts = unblock(texts)
        own, p2, p1, bucket, offs = components(texts["text"], found, False, n_all)
        w = weights[bucket]
        p = np.log10(w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] * uniform)
        base = np.log10((own + 0.1) / (n_all + 0.1 * (v_all + 1)))
        total = lambda x: np.add.reduceat(x, offs[:-1])
        return pa.table(
            [texts["id"], texts["held_out"], pa.array(np.diff(offs)), pa.array(total((own > 0).astype(np.int64))), pa.array(np.full(len(texts), n_all)), pa.array(total(base)), pa.array(total(p))],
            schema=result,
        )

    from pyspark.sql.pandas.types import to_arrow_type

    result = pa.schema([("id", to_arrow_type(docs.select(id_col).schema[0].dataType)), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    met = packed.groupBy("block").cogroup(replies.groupBy("block"))
    out = met.applyInArrow(judge, f"id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id_col)
