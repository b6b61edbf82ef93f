"""Small helpers the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.plans.scratch import scratch_path

# Fixed: what separates words in every contract of this subpackage, for Java's and for Python's patterns.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared scratch folder and read back: a cut in the lineage that survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(column: str | Column) -> Column:
    """The text with null read as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def whole_row(df: DataFrame, name: str = "_doc") -> Column:
    """All columns in one struct, so that an operator's own columns cannot clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)


def row_back(df: DataFrame, results: tuple[str, ...] = (), name: str = "_doc") -> list[Column]:
    """The columns of `df` out of that struct, but for those that results of an operator replace."""
    replaced = {r.lower() for r in results}
    return [F.col(name)[c].alias(c) for c in df.columns if c.lower() not in replaced]


def crc32_mod(column: str | Column, n: int) -> Column:
    """crc32 of the value as text, modulo n; a null value counts as the empty text."""
    c = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % n


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable over undirected edges, for every node that has an edge.

    Each round hangs every node below the smallest node it sees (a minimum, combined map-side) and then follows the
    hanging once more, so that chains shrink by half.  All state is a table of edges, checkpointed each round; the
    loop ends when a round changes nothing.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    both = stored(both.union(both.select("v", "u")).distinct(), "component-edges")
    labels = stored(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("c")), "component-labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("v"), "c"), "v").groupBy("u").agg(F.min("c").alias("m"))
        step = stored(labels.join(seen, labels["node"] == seen["u"]).select("node", "c", F.least("c", "m").alias("d")), "component-step")
        # the label's own label: a jump along the hanging
        up = step.groupBy(F.col("c").alias("r")).agg(F.min("d").alias("best"))
        roots = step.select(F.col("node").alias("k"), F.col("d").alias("kd"))
        low = up.join(roots, up["r"] == roots["k"], "left").select("r", F.least("best", F.coalesce("kd", "best")).alias("low"))
        moved = step.join(low, step["c"] == low["r"]).select("node", F.col("c").alias("old"), F.least("d", "low").alias("c"))
        moved = stored(moved, "component-labels")
        labels = moved.select("node", "c")
        if moved.where("c <> old").isEmpty():
            return labels.withColumnRenamed("c", "component")
