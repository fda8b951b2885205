"""Importance resampling towards a target distribution, on hashed n-gram features.

A feature's bucket comes from the CRC-32 of its text, but the text of an n-gram is never built: every
word's CRC is computed once, and the CRC of "A B" follows from those of its parts, since a CRC is
linear over GF(2). With crc(X) of X and n bytes of Y, crc(XY) = Z^n crc(X) xor crc(Y), where Z is the
32 x 32 bit matrix that one zero byte applies. Z^n is a product of the matrices Z^(2^j), each kept as
four tables of 256 entries (one for each byte of the CRC), so that a column of CRCs is shifted by
four look-ups for each bit of the length.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lowstress.llm.blocks import lean
from lowstress.llm.text import NON_ALNUM, token_spans, utf8
from lowstress.operators.ranking import ranked
from lowstress.storage import materialize

#: Bytes of text whose words are held as arrays at once (one longer text is worked on whole).
SLICE = 1 << 22
#: Words of up to so many bytes are hashed column by column, longer ones each by itself.
SHORT = 48
_POLY = 0xEDB88320
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _byte_table() -> np.ndarray:
    """What eight bit steps make of each byte."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = (t >> np.uint32(1)) ^ np.where(t & np.uint32(1), np.uint32(_POLY), np.uint32(0))
    return t


_STEP = _byte_table()


def _apply(matrix: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A GF(2) matrix, given as four tables by byte, times every element of x."""
    b = np.uint32(255)
    return matrix[0][x & b] ^ matrix[1][(x >> np.uint32(8)) & b] ^ matrix[2][(x >> np.uint32(16)) & b] ^ matrix[3][x >> np.uint32(24)]


def _zero_matrices(bits: int = 40) -> list[np.ndarray]:
    """Z^(2^j) for j = 0, 1, ...: what 2^j zero bytes do to a CRC register."""
    by_byte = np.arange(256, dtype=np.uint32)[None, :] << (np.uint32(8) * np.arange(4, dtype=np.uint32))[:, None]
    out = [_STEP[by_byte & np.uint32(255)] ^ (by_byte >> np.uint32(8))]
    while len(out) < bits:
        out.append(_apply(out[-1], out[-1]))  # a matrix applied to the columns of itself: its square
    return out


_ZEROS = _zero_matrices()


def shift(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each CRC moved past so many bytes: Z^length times crc."""
    out = crc.copy()
    for j in range(int(lengths.max(initial=0)).bit_length()):
        at = np.flatnonzero((lengths >> j) & 1)
        out[at] = _apply(_ZEROS[j], out[at])
    return out


def word_crcs(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of every span of ``raw``, as ``zlib.crc32`` gives it; all spans advance by one byte together."""
    n = ends - starts
    out = np.empty(len(n), np.uint32)
    for i in np.flatnonzero(n > SHORT):
        out[i] = zlib.crc32(raw[starts[i] : ends[i]])
    short = np.flatnonzero(n <= SHORT)
    short = short[np.argsort(-n[short], kind="stable")]
    begin, size = starts[short], n[short]
    state = np.full(len(short), 0xFFFFFFFF, np.uint32)
    for i in range(int(size[0]) if len(size) else 0):
        live = int(np.searchsorted(-size, -i, "left"))  # the spans with more than i bytes come first
        state[:live] = _STEP[(state[:live] ^ raw[begin[:live] + i]) & np.uint32(255)] ^ (state[:live] >> np.uint32(8))
    out[short] = ~state
    return out


def ngram_crcs(words: np.ndarray, lengths: np.ndarray, row: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n = 1..most: (CRC of each run of n words of one row, joined by a space; the row)."""
    yield words, row
    run = words
    for n in range(2, most + 1):
        if len(words) < n:
            return
        head = ~run[:-1]
        spaced = ~(_STEP[(head ^ np.uint32(32)) & np.uint32(255)] ^ (head >> np.uint32(8)))  # one more byte: a space
        run = shift(spaced, lengths[n - 1 :]) ^ words[n - 1 :]
        same = row[: len(run)] == row[n - 1 :]
        yield run[same], row[: len(run)][same]


def _slices(offs: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about SLICE bytes."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + SLICE, "right")) - 1)
        yield i, j
        i = j


def _features(column: pa.Array, most: int, buckets: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """By slice of rows i..j: the words of each row, and the buckets of all features with their rows (from 0)."""
    raw, offs = utf8(column)
    for i, j in _slices(offs):
        part, cuts = _LOWER[raw[offs[i] : offs[j]]], offs[i : j + 1] - offs[i]
        starts, ends = token_spans(part, cuts, NON_ALNUM)
        row = np.searchsorted(cuts, starts, "right") - 1
        found = list(ngram_crcs(word_crcs(part, starts, ends), ends - starts, row, most))
        where = np.concatenate([r for _, r in found])
        bucket = np.concatenate([c % np.uint32(buckets) for c, _ in found])
        yield i, j, np.bincount(row, minlength=j - i), bucket, where


def bucket_counts(texts: DataFrame, text_col: str = "text", most: int = 2, buckets: int = 10000) -> DataFrame:
    """(bucket, n): features of all texts by bucket; a row for each bucket that has any, added up in each task first."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, _, bucket, _ in _features(batch.column(0), most, buckets):
                total += np.bincount(bucket, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    return texts.select(text_col).mapInArrow(lean(count), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def _vector(counts: DataFrame, buckets: int) -> list[int]:
    """The counts as a list: one number for each bucket, whatever the size of the table."""
    out = [0] * buckets
    for r in counts.collect():
        out[r["bucket"]] = r["n"]
    return out


def log_gains(raw: list[int], target: list[int]) -> np.ndarray:
    """floor(1000 ln of the smoothed ratio of target to raw share) of each bucket, in doubles."""
    s_all, t_all, k = sum(raw), sum(target), len(raw)
    return np.array([math.floor(1000 * math.log((float(t + 1) * float(s_all + k)) / (float(s + 1) * float(t_all + k)))) for s, t in zip(raw, target, strict=True)], np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text", most: int = 2) -> DataFrame:
    """(id_col, n_words, n_features, weight): the floored mean of the gains of a row's features; 0 without features."""
    buckets = len(gains)

    def score(batches):
        for batch in batches:
            words, number, total = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for i, j, n, bucket, where in _features(batch.column(1), most, buckets):
                words[i:j] = n
                number[i:j] = np.bincount(where, minlength=j - i)
                order = np.argsort(where, kind="stable")
                run = np.concatenate([[0], np.cumsum(gains[bucket[order]])])
                at = np.concatenate([[0], np.cumsum(number[i:j])])
                total[i:j] = run[at[1:]] - run[at[:-1]]
            weight = np.where(number > 0, total // np.maximum(number, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(number), pa.array(weight)], names=["id", "n_words", "n_features", "weight"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(lean(score), f"id {kind}, n_words long, n_features long, weight long").withColumnRenamed("id", id_col)


def noise(id_col: str, seed: int) -> Column:
    """floor(1000 x a Gumbel variable) from the first 32 bits of sha256("seed:id")."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(
    docs: DataFrame, target: DataFrame, share: tuple[int, int] = (25, 100), id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
    most: int = 2, buckets: int = 10000, seed: int = 7, least_words: int = 20,
) -> DataFrame:
    """(id_col, n_features, weight, score, rank) of every row of ``docs``; rank is null where it is not drawn.

    Rows look like the target if their n-grams (1 to ``most`` words; ASCII letters and digits and all that is not
    ASCII, A-Z as a-z) are commoner there than in ``docs``. weight is the floored mean of the buckets' log gains;
    score adds Gumbel noise that depends on the seed and the id alone, so the highest scores are a weighted sample
    without replacement. Of the N rows with ``least_words`` words or more, floor(N * share) are drawn; ranks are in
    descending order of score, ties go to the smaller id (null last), then to equal rows in any order.

    Null and empty texts, and texts without words, have no features, weight 0, and are not drawn (unless
    ``least_words`` is 0). Repeated ids share their noise and are rows of their own; a null id counts as an empty
    one. An empty target leaves the gains of the smoothing; empty ``docs`` give no rows. Extra columns are not read.
    The texts are read twice: for the counts, of which ``buckets`` numbers reach the driver, and for the weights.
    """
    raw = _vector(bucket_counts(docs, text_col, most, buckets), buckets)
    wanted = _vector(bucket_counts(target, target_col, most, buckets), buckets)
    scored = weigh(docs, log_gains(raw, wanted), id_col, text_col, most).withColumn("score", F.col("weight") + noise(id_col, seed))
    scored = materialize(scored, "importance-scores")
    able = scored.where(F.col("n_words") >= least_words)
    drawn = able.count() * share[0] // share[1]
    order = [F.desc("score"), F.asc_nulls_last(id_col), F.desc("weight"), F.desc("n_features")]
    chosen = ranked(able, "rank", *order).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return chosen.unionByName(rest).select(id_col, "n_features", "weight", "score", "rank")
