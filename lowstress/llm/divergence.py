"""Audit of sources: how far the term shares of each source are from those of its language's other sources.

Every group (a language and one of its sources) gives each term a whole-number share p; two groups
differ by the sum over all terms of f(p, q) = floor((p - q)^2 / (p + q)). A group that lacks a term
gives it its base share, so the sum starts from f of the two base shares times the number of terms,
and only terms that occur add a correction to it. Those are split:

* *heavy* terms, which occur in more than ``heavy`` groups, fill dense tiles (a block of groups by a
  block of terms), whose pairs of rows are compared as numpy arrays;
* *light* terms keep postings. What a posting adds against a group that lacks the term depends on its
  share alone, so a group's light postings are counted by share first; what two postings of one
  term add to that is worked out pair by pair, at most heavy * (heavy - 1) / 2 pairs a term.

All parts are whole numbers (sums may go on as long as a bigint holds them), so they add up exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lowstress.llm.blocks import lean
from lowstress.llm.text import token_spans, utf8
from lowstress.storage import materialize

#: Shares are in parts of this.
WHOLE = 1_000_000_000
#: Terms in more groups of their language than this are heavy.
HEAVY = 8
#: Groups and terms of a dense tile.
TILE_GROUPS, TILE_TERMS = 64, 512
#: Bytes of text whose words are held as arrays at once.
SLICE = 1 << 22
#: Separators of terms: every ASCII byte that is no letter.
_NO_LETTER = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _terms(raw: np.ndarray, offs: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All terms of the rows as one string column, and the row of each."""
    starts, ends = token_spans(raw, offs, _NO_LETTER)
    inside = np.zeros(len(raw) + 1, np.int8)
    inside[starts] = 1
    inside[ends] -= 1  # a row's last term may end where the next row's first begins
    packed = _LOWER[raw[np.cumsum(inside[:-1], dtype=np.int8).view(bool)]]
    cuts = np.concatenate([[0], np.cumsum(ends - starts)])
    terms = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(packed)])
    return terms, np.searchsorted(offs, starts, "right") - 1


def term_counts(docs: DataFrame, lang_col: str, source_col: str, text_col: str) -> DataFrame:
    """(lang, source, term, n, df): occurrences and documents of each term in each group; tasks add up their own slices first."""

    def count(batches):
        for batch in batches:
            raw, offs = utf8(batch.column(2))
            names = pa.table({"lang": batch.column(0), "source": batch.column(1)})
            i, rows = 0, len(offs) - 1
            while i < rows:
                j = max(i + 1, int(np.searchsorted(offs, offs[i] + SLICE, "right")) - 1)
                terms, row = _terms(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                coded = terms.dictionary_encode()
                size = max(1, len(coded.dictionary))
                # occurrences in each document, then in each group
                both, n = np.unique(row * size + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
                part = names.slice(i, j - i).take(pa.array(both // size)).append_column("term", coded.dictionary.cast(pa.large_string()).take(pa.array(both % size)))
                summed = part.append_column("n", pa.array(n)).append_column("df", pa.array(np.ones(len(n), np.int64))).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("df", "sum")])
                summed = summed.rename_columns([c.removesuffix("_sum") for c in summed.column_names]).select(["lang", "source", "term", "n", "df"])
                yield from summed.cast(pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("df", pa.int64())])).to_batches(10_000)
                i = j

    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]
    found = docs.select(*text).mapInArrow(lean(count), "lang string, source string, term string, n long, df long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 terms)) by long division in three steps of a thousand, so that no step leaves a bigint."""
    d = total + 2 * terms
    rest, p = count + 2, F.lit(0).cast("long")
    for _ in range(3):
        rest = rest * 1000
        p, rest = p * 1000 + F.call_function("div", rest, d), rest % d
    return p + 1


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _pair_sums(a: np.ndarray, b: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of whole numbers by (a, b)."""
    order = np.lexsort((b, a))
    a, b, values = a[order], b[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
    return a[first], b[first], np.add.reduceat(values, first) if len(a) else values


_SUMS = "lang string, a long, b long, value long"


def _emit(lang: str, a: np.ndarray, b: np.ndarray, values: np.ndarray) -> pa.Table:
    return pa.table([pa.array([lang] * len(a), pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(values, pa.int64())], names=["lang", "a", "b", "value"])


def _blocks(gid: np.ndarray, p0: np.ndarray, x: int, y: int, size: int):
    """For each group of block x: its position, and the positions of the groups that it is compared with (of block y; after it, if x is y)."""
    block = gid // size
    other = np.flatnonzero(block == y)
    for i in np.flatnonzero(block == x):
        js = other[gid[other] > gid[i]]
        if len(js):
            yield i, js, _f(p0[i], p0[js])


def dense_tile(key, table, size=TILE_GROUPS):
    """Corrections of the heavy terms of one tile of ``size`` groups a side. Rows: a group's base share (tid -1) or its share of a term."""
    lang, _, x, y = (k.as_py() for k in key)
    gid, tid, p = (table[c].to_numpy() for c in ("gid", "tid", "p"))
    base = tid < 0
    order = np.argsort(gid[base])
    groups, p0 = gid[base][order], p[base][order]
    terms, column = np.unique(tid[~base], return_inverse=True)
    shares = np.repeat(p0[:, None], len(terms), axis=1)
    shares[np.searchsorted(groups, gid[~base]), column] = p[~base]
    out = [(np.zeros(0, np.int64),) * 3]
    for i, js, f0 in _blocks(groups, p0, x, y, size):
        out.append((np.repeat(groups[i], len(js)), groups[js], (_f(shares[i], shares[js]) - f0[:, None]).sum(axis=1)))
    return _emit(lang, *(np.concatenate(c) for c in zip(*out, strict=True)))


def single_tile(key, table, size=TILE_GROUPS):
    """What light postings add against groups that lack the term, by share and how often it occurs (k); part 0 adds the base sum over all v terms."""
    lang, x, y, part = (k.as_py() for k in key)
    gid, p, k, v = (table[c].to_numpy() for c in ("gid", "p", "k", "v"))
    base = k == 0
    order = np.argsort(gid[base])
    groups, p0, n_terms = gid[base][order], p[base][order], v[base][order]
    at = np.searchsorted(groups, gid[~base])
    by_group = np.argsort(at, kind="stable")
    cuts = np.searchsorted(at[by_group], np.arange(len(groups) + 1))
    own = [(p[~base][rows], k[~base][rows]) for rows in (by_group[s:e] for s, e in zip(cuts[:-1], cuts[1:], strict=True))]

    def against(i: int, j: int, f0: int) -> int:
        """Of the postings of group i, against group j."""
        return int(((_f(own[i][0], p0[j]) - f0) * own[i][1]).sum())

    out = [(np.zeros(0, np.int64),) * 3]
    for i, js, f0 in _blocks(groups, p0, x, y, size):
        sums = np.array([against(i, j, f) + against(j, i, f) for j, f in zip(js, f0, strict=True)], np.int64)
        out.append((np.repeat(groups[i], len(js)), groups[js], sums + (n_terms[i] * f0 if part == 0 else 0)))
    return _emit(lang, *(np.concatenate(c) for c in zip(*out, strict=True)))


def _posting_pairs(batches):
    """Of the postings of each light term: what two groups that both have it add to what each adds alone."""
    for batch in batches:
        lists = batch.column(1)
        if not len(lists):
            continue
        size = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten()
        gid, p, p0 = (np.asarray(flat.field(c)) for c in ("gid", "p", "p0"))
        term = np.repeat(np.arange(len(size)), size)
        found = []
        for d in range(1, int(size.max())):
            i = np.flatnonzero(term[:-d] == term[d:])
            j = i + d
            found.append((term[i], gid[i], gid[j], _f(p[i], p[j]) - _f(p[i], p0[j]) - _f(p0[i], p[j]) + _f(p0[i], p0[j])))
        if not found:
            continue
        term, a, b, values = (np.concatenate(c) for c in zip(*found, strict=True))
        names, code = np.unique(np.array(batch.column(0).to_pylist(), object), return_inverse=True)
        for n, lang in enumerate(names):
            of = code[term] == n
            yield from _emit(lang, *_pair_sums(a[of], b[of], values[of])).to_batches()


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = 10, top_terms: int = 10, heavy: int = HEAVY, parts: int = 16, tile: tuple[int, int] = (TILE_GROUPS, TILE_TERMS)) -> DataFrame:
    """(lang, source, part, item, value, rank): what sets a source apart, ranked from 1 for each group and part.

    Part ``pair``: every other source of the language, with the divergence of the two over all kept terms (0 without
    kept terms). Part ``term``: the ``top_terms`` terms of the group whose share is above that of the whole language,
    with what each adds to the divergence from it. Values fall with the rank; ties go to the smaller item (UTF-8).

    Terms are runs of ASCII letters (A-Z as a-z) and of all that is not ASCII; a language keeps those of ``least_docs``
    of its documents or more. Null texts, languages and sources count as empty ones; a repeated row is a document of
    its own; a group without terms has base shares only; an only source has no pairs; an empty table gives no rows.
    Extra columns are not read. Texts are read once; from then on there is a row for a term and group at most. A
    hot source costs nothing extra after its texts are counted; a language's terms and groups are dealt in tiles (``tile``:
    groups a side, terms), and ``parts`` deals the light terms' shares further.
    """
    tile_groups, tile_terms = tile
    counts = materialize(term_counts(docs, lang_col, source_col, text_col), "divergence-counts")
    by_term = counts.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("df").alias("df"), F.count("*").alias("n_groups")).where(F.col("df") >= least_docs)
    vocab = materialize(by_term.drop("df").withColumn("tid", F.monotonically_increasing_id()), "divergence-terms")
    langs = vocab.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n_lang").alias("total_lang"), F.count_if(F.col("n_groups") > heavy).alias("n_heavy"))
    kept = counts.select("lang", "source", "term", "n").join(vocab, ["lang", "term"])
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    names = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source")))).distinct()
    v = F.coalesce("v", F.lit(0))
    groups = names.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").select(
        "lang", "source", v.alias("v"), F.coalesce("total", F.lit(0)).alias("total"), "total_lang", F.ceil(F.coalesce("n_heavy", F.lit(0)) / tile_terms).alias("term_blocks"),
        (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long").alias("gid"), F.count("*").over(Window.partitionBy("lang")).alias("n"),
    )
    base = F.when(F.col("v") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("v"))).otherwise(1)
    groups = materialize(groups.select("lang", "source", "gid", "v", "total", "total_lang", "term_blocks", base.alias("p0"), F.ceil(F.col("n") / tile_groups).alias("group_blocks")), "divergence-groups")
    p, q = share(F.col("n"), F.col("total"), F.col("v")), share(F.col("n_lang"), F.col("total_lang"), F.col("v"))
    shares = materialize(kept.join(groups, ["lang", "source"]).select("lang", "source", "gid", "term", "tid", "n_groups", "p0", p.alias("p"), q.alias("q"), "group_blocks", "term_blocks"), "divergence-shares")

    # every row of a group goes to the tiles of its block with every other block
    own = F.floor(F.col("gid") / tile_groups)
    unit = F.transform(F.sequence(F.lit(0).cast("long"), F.col("group_blocks") - 1), lambda o: F.struct(F.least(o, own).alias("x"), F.greatest(o, own).alias("y")))
    numbered = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    at = lambda df: df.withColumn("u", F.explode(unit)).withColumns({"x": F.col("u.x"), "y": F.col("u.y")})

    dense_rows = at(shares.where(F.col("n_groups") > heavy)).select("lang", F.pmod(F.xxhash64("tid"), "term_blocks").alias("tb"), "x", "y", "gid", "tid", "p")
    dense_base = at(groups.where("term_blocks > 0").withColumn("tb", numbered(F.col("term_blocks")))).select("lang", "tb", "x", "y", "gid", F.lit(-1).cast("long").alias("tid"), F.col("p0").alias("p"))
    dense = dense_rows.unionByName(dense_base).groupBy("lang", "tb", "x", "y").applyInArrow(lambda key, table: dense_tile(key, table, tile_groups), _SUMS)

    light = shares.where(F.col("n_groups") <= heavy)
    by_share = light.groupBy("lang", "gid", "group_blocks", "p").agg(F.count("*").alias("k"))
    single_rows = at(by_share).select("lang", "x", "y", F.pmod(F.xxhash64("p"), F.lit(parts)).alias("part"), "gid", "p", "k", F.lit(0).cast("long").alias("v"))
    single_base = at(groups.withColumn("part", numbered(F.lit(parts).cast("long")))).select("lang", "x", "y", "part", "gid", F.col("p0").alias("p"), F.lit(0).cast("long").alias("k"), "v")
    single = single_rows.unionByName(single_base).groupBy("lang", "x", "y", "part").applyInArrow(lambda key, table: single_tile(key, table, tile_groups), _SUMS)

    postings = light.groupBy("lang", "tid").agg(F.sort_array(F.collect_list(F.struct("gid", "p", "p0"))).alias("postings")).where(F.size("postings") > 1)
    sparse = postings.select("lang", "postings").mapInArrow(lean(_posting_pairs), _SUMS)

    sums = dense.unionByName(single).unionByName(sparse).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    each = F.explode(F.array(F.struct(F.col("a").alias("gid"), F.col("b").alias("other")), F.struct(F.col("b").alias("gid"), F.col("a").alias("other"))))
    ways = sums.select("lang", "value", each.alias("w")).select("lang", "value", "w.gid", "w.other")
    named = groups.select("lang", "gid", "source")
    pairs = ways.join(named, ["lang", "gid"]).join(named.select("lang", F.col("gid").alias("other"), F.col("source").alias("item")), ["lang", "other"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    worth = F.call_function("div", (F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("p") + F.col("q"))
    terms = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), worth.alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).cast("int")
    return pairs.withColumn("rank", rank).unionByName(terms.withColumn("rank", rank).where(F.col("rank") <= top_terms))
