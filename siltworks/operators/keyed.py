"""Joins and reductions on a key that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The most frequent keys, answered by a broadcast: a key outside them holds less than 1/500 of all rows, and the list is
# safe to broadcast whatever the size of the table.
HOT_KEYS = 500


def compact_key(key: Column, is_text: bool) -> Column:
    """Long texts are compared by digest, so that a shuffle carries 65 characters and not whole documents.

    The digest form is 65 characters long and texts up to 64 stay as they are, so the two never collide.
    """
    if not is_text:
        return key
    return F.when(F.length(key) > 64, F.concat(F.lit("#"), F.sha2(key, 256))).otherwise(key)


def by_shuffle(df: DataFrame) -> DataFrame:
    """A side of a join that is never to be broadcast, though Spark's estimate of its size may be small.

    That estimate follows the bytes of the files below: it knows nothing of the rows that an explode makes of them."""
    return df.hint("merge")


def key_counts(df: DataFrame, key: Column) -> DataFrame:
    """(_k, _n): rows per key, combined map-side; null is a key like any other."""
    return df.select(key.alias("_k")).groupBy("_k").agg(F.count(F.lit(1)).alias("_n"))


def attach_marks(df: DataFrame, key: Column, counts: DataFrame, out: str) -> DataFrame:
    """Add boolean `out` to every row: the mark `_m` of its key in `counts` (_k unique, _n, _m).  Null keys match null.

    The `HOT_KEYS` most frequent keys are answered by a broadcast, and their rows carry a null key plus a salt (the task's
    partition number, stable when a task is retried) through the shuffle of the others.  Only marked keys enter that
    shuffle; whether it becomes a broadcast is up to Spark's size check.
    """
    hot = counts.orderBy(F.desc("_n"), "_k").limit(HOT_KEYS).select(F.col("_k").alias("_hk"), F.col("_m").alias("_hm"))
    # the zero is computed: a literal would be folded into the condition and the salt would be no join key any more.  It is
    # never null: a null check of it would be pushed below the counts, which then were no longer those of `hot` and not reused
    zero = F.hash("_k").bitwiseAND(F.lit(0))
    cold = counts.where("_m").select(F.col("_k").alias("_ck"), zero.alias("_cs"), F.lit(True).alias("_cm"))
    keyed = df.withColumn("_key", key).join(F.broadcast(hot), F.col("_key").eqNullSafe(F.col("_hk")), "left")
    keyed = keyed.withColumns({
        "_salt": F.when(F.col("_hm").isNotNull(), F.spark_partition_id() + 1).otherwise(0),
        "_key": F.when(F.col("_hm").isNull(), F.col("_key")),
    })
    joined = keyed.join(cold, F.col("_key").eqNullSafe(F.col("_ck")) & (F.col("_salt") == F.col("_cs")), "left")
    mark = F.coalesce("_hm", "_cm", F.lit(False))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], mark.alias(out))


def mark_repeated(df: DataFrame, key: Column, out: str, is_text: bool = False, source: DataFrame | None = None) -> DataFrame:
    """Boolean `out` on every member of a group of equal keys (two nulls are equal).

    The keys are counted on `source` (by default `df`): the table that `df` only adds columns to."""
    key = compact_key(key, is_text)
    return attach_marks(df, key, key_counts(df if source is None else source, key).withColumn("_m", F.col("_n") > 1), out)


def mark_orphans(df: DataFrame, key: Column, parents: DataFrame, parent_key: str, out: str, source: DataFrame | None = None) -> DataFrame:
    """Boolean `out` on rows whose non-null key has no row in `parents`; `source` as in `mark_repeated`."""
    known = parents.select(F.col(parent_key).alias("_pk")).where("_pk is not null").distinct()
    counts = key_counts(df if source is None else source, key).join(known, F.col("_k") == F.col("_pk"), "left")
    return attach_marks(df, key, counts.select("_k", "_n", (F.col("_k").isNotNull() & F.col("_pk").isNull()).alias("_m")), out)


def first_per_key(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column]) -> DataFrame:
    """One row per key, first in `order`.

    Written as row_number() = 1 so that Spark cuts every map task to one row per key before the shuffle.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def first_n_per_key(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column], n: int, rank: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)
