"""Bounded, repeatable samples of labelled rows for fitting classifiers on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Classes that a sample covers (the most frequent ones); bounds what is broadcast.
MOST_CLASSES = 1000


def crc_mod(col, m: int):
    """crc32 of a value's text (null: of the empty text), modulo m."""
    return F.pmod(F.crc32(F.coalesce(F.col(col).cast("string"), F.lit(""))), F.lit(m))


def per_class_sample(rows: DataFrame, by: list[str], id_col: str, most: int, classes: int = MOST_CLASSES, total: int | None = None) -> DataFrame:
    """At most ``most`` rows of each of the ``classes`` most frequent values of ``by`` (ties: the smaller value): those with the smallest hash of the id.

    With ``total``, classes share it: none has more than total // (their number) rows, one at least. Classes are counted first; rows whose hash is beyond what about twice ``most`` rows of their class
    need are left out where they are read, so that what meets to be ranked is bounded whatever the
    number of rows and partitions. Classes of up to twice ``most`` rows are ranked whole.
    """
    sizes = rows.groupBy(*by).agg(F.count("*").alias("_size")).select(*[F.col(c).alias(f"_{c}") for c in by], "_size")
    sizes = sizes.orderBy(F.desc("_size"), *[f"_{c}" for c in by]).limit(classes)
    if total is not None:
        most = max(1, min(most, total // max(1, sizes.count())))
    sizes = F.broadcast(sizes)  # ``classes`` rows at most
    same = [rows[c].eqNullSafe(sizes[f"_{c}"]) for c in by]
    share = F.pmod(F.xxhash64(F.col(id_col), F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    few = rows.join(sizes, same).where(share * F.col("_size") <= 2 * most).drop("_size", *[f"_{c}" for c in by])
    order = Window.partitionBy(*by).orderBy(F.pmod(F.xxhash64(F.col(id_col), F.lit(11)), F.lit(1 << 30)), F.col(id_col))
    return few.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")
