"""Helpers that the training-data operators share: word splitting, column binding, durable tables, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.tables import durable

#: A-Z lower-cased; every ASCII byte that is neither digit nor letter becomes a space. Bytes from 0x80 on are kept.
_FOLD = bytes(
    (b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20)
    for b in range(256)
)
#: A-Z lower-cased, all else as it is.
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def alnum_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased, as UTF-8."""
    return encoded(text).translate(_FOLD).split()


def space_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, as UTF-8."""
    return encoded(text).translate(_LOWER).split()


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once for each row, also where ``body`` uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python workers in batches of at most 8 MB, unless the session has limits of its own."""
    for key, usual, value in (("maxBytesPerBatch", ("67108864b", "64MB", str(2**26)), "8m"), ("maxRecordsPerBatch", ("10000",), "2000")):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}") in usual:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", value)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small(df: DataFrame, most_rows: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most_rows`` rows (counted); else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b: long): one row (node, component), component the smallest node reached.

    Alternates large-star and small-star steps, each a grouped minimum that is combined before the shuffle, until no
    edge changes. No task or driver holds a component. Loops and repeated edges are allowed; no edges give no rows.
    """
    spark = edges.sparkSession
    edges = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    sign = None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.where("a > b").distinct()
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        edges = durable(
            down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").union(low.select("a", F.col("m").alias("b"))).distinct(),
            "edges",
        )
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == sign:
            break
        sign = now
    else:
        raise RuntimeError(f"components haven't settled after {rounds} rounds")
    tops = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(tops)
