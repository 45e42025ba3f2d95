"""Counts up to a moment, and components, over groups of any size: no group is ever one task's."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def counted(items: DataFrame, queries: DataFrame, keys: list[str], bucket: int) -> DataFrame:
    """queries (keys, x, strict, ...) with n, the items (keys, x) of the same group with an x up to theirs, or below it where strict.

    Whole numbers x are divided into buckets; inside a bucket a window counts, and before it the buckets' sums do, so that a large
    group is as many partitions as it has buckets."""
    both = items.select(*keys, "x", F.lit(1).alias("one")).unionByName(queries.withColumn("one", F.lit(0)), allowMissingColumns=True).withColumn("bucket", F.floor(F.col("x") / bucket).cast("bigint"))
    w = Window.partitionBy(*keys, "bucket").orderBy("x")
    upto = lambda end: F.coalesce(F.sum("one").over(w.rangeBetween(Window.unboundedPreceding, end)), F.lit(0))
    inside = both.withColumn("inside", F.when(F.col("strict"), upto(-1)).otherwise(upto(0))).where("one = 0").drop("one")
    sums = both.groupBy(*keys, "bucket").agg(F.sum("one").alias("own"))
    before = F.coalesce(F.sum("own").over(Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = inside.join(sums.select(*keys, "bucket", before.alias("before")), [*keys, "bucket"])
    return out.withColumn("n", F.col("inside") + F.col("before")).drop("inside", "before", "bucket")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; on a local master without one, a folder of this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is unset: a cluster needs a folder there that all executors share")
        named = tempfile.mkdtemp(prefix="recordloom-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again."""
    path = f"{shared_dir(df.sparkSession)}/recordloom/{df.sparkSession.sparkContext.applicationId}/core-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_layers: dict[tuple, DataFrame] = {}


def layered(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """The table of a layer that others stand on (beliefs, patterns, hints, concepts), stored when it is first asked for and rebuilt only when the documents' files are others than then."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/documents.parquet")
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = tuple(sorted((str(f.getPath()), f.getLen(), f.getModificationTime()) for f in fs.listStatus(p)))
    key = (spark.sparkContext.applicationId, name, files)
    if key not in _layers:
        _layers[key] = stored(build())
    return _layers[key]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root (the smallest node of its component) for every end of an edge, by large-star and small-star steps until nothing changes."""
    e = stored(edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).where("v <> u").distinct())
    mark = None
    while (now := e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("v", "u")), F.sum(F.xxhash64("u", "v") % 1000003)).first()) != mark:
        mark = now
        both = e.unionByName(e.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = both.where("u > v").join(low, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(least.select("v", F.col("m").alias("u")))
        e = stored(small.where("v <> u").distinct())
    star = e.groupBy("v").agg(F.min("u").alias("root"))
    return star.select(F.col("v").alias("node"), "root").unionByName(star.select(F.col("root").alias("node"), "root").distinct())


def bucketed(df: DataFrame, x: str, width: int) -> DataFrame:
    return df.withColumn("bucket", F.floor(F.col(x) / width).cast("bigint"))


def neighbour(df: DataFrame, keys: list[str], x: str, tie: str, width: int, after: bool = False) -> DataFrame:
    """df with `near`, struct(x, tie) of the row before in its group (or after it), in the order of x and tie; null at the end.

    Found in buckets of x, and across them by each bucket's last (first) row, so that a large group is many partitions."""
    d = bucketed(df, x, width)
    own = F.struct(F.col(x).alias("x"), F.col(tie).alias("tie"))
    w = Window.partitionBy(*keys, "bucket").orderBy(x, tie)
    ends = d.groupBy(*keys, "bucket").agg((F.min(own) if after else F.max(own)).alias("end"))
    g = Window.partitionBy(*keys).orderBy("bucket") if keys else Window.orderBy("bucket")
    ends = ends.withColumn("far", (F.lead("end") if after else F.lag("end")).over(g)).drop("end")
    step = (F.lead(own) if after else F.lag(own)).over(w)
    return d.withColumn("step", step).join(ends, [*keys, "bucket"]).withColumn("near", F.coalesce("step", "far")).drop("step", "far", "bucket")


def running(df: DataFrame, keys: list[str], x: str, tie: str, width: int, value: str) -> DataFrame:
    """df with `upto`, the sum of value over the rows of its group up to each, in the order of x and tie; in buckets of x as above."""
    d = bucketed(df, x, width)
    inside = F.sum(value).over(Window.partitionBy(*keys, "bucket").orderBy(x, tie).rowsBetween(Window.unboundedPreceding, 0))
    sums = d.groupBy(*keys, "bucket").agg(F.sum(value).alias("own"))
    before = F.coalesce(F.sum("own").over(Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return d.withColumn("inside", inside).join(sums.select(*keys, "bucket", before.alias("before")), [*keys, "bucket"]).withColumn("upto", F.col("inside") + F.col("before")).drop("inside", "before", "bucket")
