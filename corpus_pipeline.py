"""A corpus pipeline of five stages over ``documents``; each reads what its predecessor wrote.

toxicity -> line dedup -> n-gram Jaccard join -> benchmark decontamination -> byte-level BPE.
Ids are those of ``documents``; all stages but the last return its columns.

Common to all stages: decisions are made for each row, not for each id, so rows that share an id (or have none) go or stay
on their own; rows that are equal in all columns share their fate. Extra columns of any name pass through untouched (only
``n_chars`` follows the text). Null and empty texts are kept by every stage that filters; very long texts are
worked on whole; an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lowstress.llm import byte_bpe, decontaminate, line_dedup, ngram_join, toxicity
from lowstress.storage import materialize, rest

TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The table with columns c0, c1, ..., so that none can clash with those of an operator, and the name of its text column."""
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))), f"c{docs.columns.index('text')}"


def _row_key(docs: DataFrame) -> Column:
    """64 bits of all columns: names a row however often its id occurs."""
    return F.xxhash64(*(F.col(c) for c in docs.columns), *(F.col(c).isNull() for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier (learned from ``labels``) scores 0.5 or more go.

    A null or empty text is scored as one without words. With no labelled row the model is the neutral one of
    ``toxicity.fit``.
    """
    rest(spark)
    model = toxicity.fit_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows, text = _numbered(docs)
    return toxicity.score(rows, model, text_col=text).where("score < 0.5").drop("score").toDF(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that occur before (alike or nearly) leave the texts; a document of which only blank lines are left by that goes with them.

    A document without lines to compare (null, empty, blank) loses none and stays.
    """
    rest(spark)
    rows, text = _numbered(docs)
    out = line_dedup.dedup_lines(rows, f"c{docs.columns.index('doc_id')}", text)
    out = out.where((F.size("dropped") == 0) | F.col(text).rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        at = f"c{docs.columns.index('n_chars')}"
        out = out.withColumn(at, F.when(F.size("dropped") > 0, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(at)))
    return out.select(*rows.columns).toDF(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by 0.8 or more of their 5-word shingles, the document with the smallest id stays (ties: one of them).

    Texts without words are linked with nothing and stay; of rows that are equal in all columns one stays if they have words.
    """
    rest(spark)
    rows, text = _numbered(docs)
    own = f"c{docs.columns.index('doc_id')}"
    keyed = materialize(rows.select(_row_key(rows).alias("key"), F.col(own).alias("own"), F.col(text).alias("text")), "pipeline-keys")
    found = ngram_join.join_components(keyed.select("key", "text"), k=5, num=80, den=100, id_col="key")
    sized = found.groupBy("key").agg(F.max("component_id").alias("component"), F.max("n_shingles").alias("n")).where("n > 0")
    ids = keyed.groupBy("key").agg(F.min("own").alias("own"))
    first = sized.join(ids, "key").groupBy("component").agg(F.min(F.struct(F.col("own").isNull(), "own", "key")).alias("first"))
    gone = sized.join(first, "component").where("key <> first.key").select("key")
    left = rows.withColumn("key", _row_key(rows)).join(gone, "key", "left_anti")
    # equal rows with words: one stays
    twice = keyed.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).groupBy("key").count().where("count > 1").select("key")
    again = left.join(twice, "key", "left_semi").dropDuplicates(["key"])
    return left.join(twice, "key", "left_anti").unionByName(again).drop("key").toDF(*docs.columns)


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain an item of ``benchmark`` go. Null and empty texts contain none; an empty benchmark takes nothing."""
    rest(spark)
    rows, text = _numbered(docs)
    keyed = rows.withColumn("key", _row_key(rows))
    leaks = decontaminate.find_leaks(keyed.select("key", text), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "key", text).select("key").distinct()
    return keyed.join(leaks, "key", "left_anti").drop("key").toDF(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256): the ids of each text (null: empty), and the digest of the bytes they decode to."""
    rest(spark)
    path = public_tokenizers.path(TOKENIZER)
    encoded = byte_bpe.encode(docs.select("doc_id", "text"), path, public_tokenizers.PATTERN)
    return byte_bpe.decode(encoded, path).select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_leaked),
    ("byte-level BPE", tokenize),
]

#: No stage but the last can be written in SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
