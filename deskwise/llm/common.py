"""What the operators share: input columns, written tables between steps, links to components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deskwise.sources.shared import fresh_path, written

__all__ = ["bounded", "components", "free_name", "fresh_path", "partitions", "salted", "table", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def salted(left: DataFrame, right: DataFrame, key: str | list[str], by: str, salts: int = 16, how: str = "inner") -> DataFrame:
    """Join on ``key`` in which a frequent key of ``left`` is dealt to ``salts`` tasks by the column ``by``.

    ``right`` has one row for each key.
    """
    keys = [key] if isinstance(key, str) else key
    left = left.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    right = right.withColumn("_salt", F.explode(F.array(*(F.lit(i) for i in range(salts)))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def bounded(df: DataFrame, most: int = 1_000_000, cells: Column | None = None) -> DataFrame:
    """The table, to be broadcast if it has at most ``most`` rows, or values if ``cells`` gives how many a row has; a
    larger one is shuffled."""
    if cells is None:
        return F.broadcast(df) if df.limit(most + 1).count() <= most else df
    held = df.agg(F.coalesce(F.sum(cells), F.lit(0))).first()[0]
    return F.broadcast(df) if held <= most else df


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the table hasn't, upper and lower case being one."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def components(links: DataFrame) -> DataFrame:
    """``node, component`` of every node of ``links`` (u, v): the smallest node it reaches.

    Alternating stars: each round hangs every node's larger neighbours, then its smaller ones, on its
    smallest, until nothing changes; a number of rounds logarithmic in the longest path. Minima are
    combined before the shuffle, and a node of many links is dealt by salt.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        ways = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        if large:
            ways = ways.union(ways.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ways.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        hung = salted(ways, least, "u", "v")
        if large:
            hung = hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            hung = hung.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        return hung.where("u <> v").distinct()

    def state(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = written(links.select("u", "v").where("u <> v").distinct(), "links")
    was = state(edges)
    while was[0]:
        edges = written(star(star(edges, True), False), "stars")
        if (now := state(edges)) == was:
            break
        was = now
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
