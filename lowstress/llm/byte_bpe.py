"""Byte-level BPE: texts are pre-tokenised in overlapping chunks, stitched, then encoded piece by piece."""

from __future__ import annotations

import base64
import functools
from array import array
from collections.abc import Callable, Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lowstress.llm.blocks import lean

#: Characters of a chunk and of its overlap with the next; a match is trusted only MARGIN before a cut.
CHUNK_CHARS, OVERLAP_CHARS, MARGIN = 32768, 1024, 8
#: Pieces whose ids a worker remembers at once.
CACHE_PIECES = 200_000


@functools.lru_cache(2)
def _vocabulary(path: str) -> tuple[dict[bytes, int], list[bytes]]:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    table = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        table[rank] = piece
    return ranks, table


class Encoder:
    """Splits by the pattern and encodes pieces, remembering the ids of recent ones."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        # \s as in the pattern's other engines: the White_Space property, without U+001C to U+001F
        self.match = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        own = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=_vocabulary(path)[0], special_tokens={})
        self.known = Known(own.encode_ordinary)

    def pieces(self, text: str) -> list[str]:
        return self.match.findall(text)

    def ids(self, pieces: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, one after another, and how many each piece has."""
        if len(self.known) > CACHE_PIECES:
            self.known.forget()
        codes = np.fromiter(map(self.known.__getitem__, pieces), np.int64)
        offs, flat = np.frombuffer(self.known.offs, np.int64), np.frombuffer(self.known.flat, np.int32)
        first = offs[codes]
        n = offs[codes + 1] - first
        return flat[np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))], n


class Known(dict):
    """Numbers of pieces by first use; ``flat[offs[n]:offs[n + 1]]`` are the ids of piece n."""

    def __init__(self, encode: Callable[[str], list[int]]):
        super().__init__()
        self.encode = encode
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.flat, self.offs = array("i"), array("q", [0])

    def __missing__(self, piece: str) -> int:
        self.flat.extend(self.encode(piece))
        self.offs.append(len(self.flat))
        self[piece] = len(self.offs) - 2
        return len(self.offs) - 2


@functools.lru_cache(2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def chunks_of(n_chars: int, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[tuple[int, int]]:
    """[start, end) of the overlapping chunks of a text."""
    return [(s, min(n_chars, s + chunk + overlap)) for s in range(0, max(1, n_chars), chunk)]


def split_chunk(enc: Encoder, text: str, start: int, last: bool) -> tuple[list[str], np.ndarray]:
    """The pieces of a chunk and their starts in the whole text; of a chunk that is cut, only trusted ones."""
    pieces = enc.pieces(text)
    starts = start + np.concatenate([[0], np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))])
    if last:
        return pieces, starts
    n = int(np.searchsorted(starts[1:], start + len(text) - MARGIN, "right"))
    return pieces[:n], starts[: n + 1]


def stitch(bounds: list[np.ndarray]) -> list[int] | None:
    """Where each chunk takes over from the one before: the first boundary that both found.

    What the pattern matches from a position on depends on the text from there on only, so after a
    common boundary both chunks agree. None: two chunks have no common boundary.
    """
    takes = [0]
    for a, b in zip(bounds, bounds[1:], strict=False):
        common = np.intersect1d(a[a >= takes[-1]], b)
        if not len(common):
            return None
        takes.append(int(common[0]))
    return takes


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """(id, n_tokens, ids array<int>) for every row: the ids of the whole text by the ranks in ``path``.

    Chunks are pre-tokenised, then their pieces are encoded. A text of one chunk needs no stitching: both happen where it is
    read. The overlapping chunks of a longer one are dealt out and worked on in parallel; per text, they then meet and
    each takes over at the first piece boundary it shares with its predecessor. If two chunks share none (one
    piece longer than the overlap), that text is pre-tokenised whole. Null texts are empty and give no ids;
    repeated ids stay separate rows (equal rows are encoded once and come out as often as they went in); other columns are not read; an empty table
    gives no rows. Keys of the shuffle depend on id and text alone, so a recomputed task deals alike. The
    rank file is read from ``path`` on every executor.
    """
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = f"id {kind}, n_tokens long, ids array<int>"

    def short(batches):
        enc = encoder(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                pieces = [enc.pieces(t) for t in part.column(1).to_pylist()]
                ids, n = enc.ids(chain.from_iterable(pieces))
                ends = np.cumsum(n)[np.cumsum([len(p) for p in pieces]) - 1] if len(n) else np.zeros(len(pieces), np.int64)
                ends[: next((i for i, p in enumerate(pieces) if p), len(pieces))] = 0
                yield _batch(part.column(0), ids, np.append(0, ends))

    def cut(batches):
        for batch in batches:
            for i, key, times, t in zip(*batch.columns, strict=True):
                text = t.as_py()
                spans = chunks_of(len(text), chunk, overlap)
                for k, (s, e) in enumerate(spans):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([i.as_py()], batch.schema[0].type), pa.array([key.as_py()]), pa.array([times.as_py()]), pa.array([k], pa.int32()), pa.array([s], pa.int64()), pa.array([k == len(spans) - 1]), pa.array([text[s:e]])],
                        names=["id", "key", "times", "k", "start", "last", "text"],
                    )

    def split(batches):
        enc = encoder(path, pattern)
        for batch in batches:
            for i, key, times, k, s, last, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pieces, bounds = split_chunk(enc, t, s, last)
                ids, counts = enc.ids(pieces)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([i], batch.schema[0].type), pa.array([key]), pa.array([times]), pa.array([k], pa.int32()), pa.array([t[: chunk] if not last else t]),
                        pa.array([bounds.tolist()], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int32())), pa.array([ids], pa.list_(pa.int32())),
                    ],
                    names=["id", "key", "times", "k", "text", "bounds", "counts", "ids"],
                )

    def join(table: pa.Table) -> pa.Table:
        table = table.sort_by("k")
        bounds = [np.asarray(x.values) for x in table["bounds"]]
        takes = stitch(bounds)
        if takes is None:
            enc = encoder(path, pattern)
            ids, _ = enc.ids(enc.pieces("".join(table["text"].to_pylist())))
        else:
            ids = []
            for j, b in enumerate(bounds):
                counts = np.concatenate([[0], np.cumsum(np.asarray(table["counts"][j].values))])
                first = int(np.searchsorted(b, takes[j]))
                until = int(np.searchsorted(b, takes[j + 1])) if j + 1 < len(takes) else len(b) - 1
                ids.append(np.asarray(table["ids"][j].values)[counts[first] : counts[until]])
            ids = np.concatenate(ids)
        out = pa.Table.from_batches([_batch(pa.array([table["id"][0].as_py()], table.schema.field("id").type), np.asarray(ids), np.array([0, len(ids)]))])
        return out.append_column("times", table["times"].slice(0, 1))

    one = rows.where(F.length("text") <= chunk).mapInArrow(lean(short), schema)
    key = F.concat_ws("-", F.coalesce(F.col("id").cast("string"), F.lit("null")), F.xxhash64("text"), F.xxhash64("text", F.lit(1)))
    # equal rows are one from here to the end, however many there are
    long = rows.where(F.length("text") > chunk).groupBy("id", "text").agg(F.count("*").alias("times"))
    parts = long.select("id", key.alias("key"), "times", "text").mapInArrow(lean(cut), f"id {kind}, key string, times long, k int, start long, last boolean, text string")
    parts = parts.repartition("key", "k").mapInArrow(lean(split), f"id {kind}, key string, times long, k int, text string, bounds array<long>, counts array<int>, ids array<int>")
    whole = parts.groupBy("key").applyInArrow(join, f"{schema}, times long")
    whole = whole.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select("id", "n_tokens", "ids")
    return one.unionByName(whole).withColumnRenamed("id", id_col)


def _batch(rows: pa.Array, ids: np.ndarray, offs: np.ndarray) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(ids.astype(np.int32)))
    return pa.RecordBatch.from_arrays([rows, pa.array(np.diff(offs)), lists], names=["id", "n_tokens", "ids"])


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The input's columns and ``decoded``: the bytes of the ids, concatenated (null ids: null). An id without a rank is an error.

    A column ``decoded`` of the input is replaced; an empty table gives no rows.
    """
    encoded = encoded.drop("decoded")

    def turn(batches):
        table = _vocabulary(path)[1]
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids_col))
            out = [b"".join(map(table.__getitem__, x.values.to_numpy(zero_copy_only=False).tolist())) if x.is_valid else None for x in column]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema) + ", decoded binary"
    return encoded.mapInArrow(lean(turn), schema)
