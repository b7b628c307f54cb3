"""Spark helpers shared by the training-data operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The folder of the session's spark.checkpoint.dir. Where that is unset, one of our own, but on a single machine only."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        told = spark.conf.get("spark.checkpoint.dir", None)
        if not told and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(told or os.path.join(tempfile.gettempdir(), "keratoline-checkpoints"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage in the cluster's shared checkpoint folder.

    With spark.cleaner.referenceTracking.cleanCheckpoints the files go when the
    driver no longer holds the frame.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """The rows, written as Parquet in the shared folder and read again; the path, to be removed when nothing reads it any more."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    """Deletes what written() has written."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def may_be_among(rows: DataFrame, key: str, ids: DataFrame, count: int, most: int = 1 << 28) -> DataFrame:
    """The rows whose key is among `ids` (column `id`, `count` of them), and about one in seventeen of the others.

    Ids set bits by their hash, 16 to 32 bits for each, up to `most` bits (32 MB),
    which go to every task, so that the rows need not be moved to be looked up.
    With more ids than that allows more of the others pass, and none of the ids'
    rows is lost. Rows without a key do not pass.
    """
    width = 32_768  # bits of one of bitmap_construct_agg's bitmaps
    bits = min(most, max(width, 1 << (16 * count - 1).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(F.lit(16), c), F.lit(bits))
    part = lambda c: F.shiftright(place(c), width.bit_length() - 1)
    at = lambda c: F.pmod(place(c), F.lit(width))
    told, kept = unused(rows.columns, "__part"), unused(rows.columns, "__bits")
    set_bits = ids.select(part(F.col("id")).alias(told), at(F.col("id")).alias("at")).repartition(shuffle_partitions(rows.sparkSession), told)
    maps = set_bits.groupBy(told).agg(F.bitmap_construct_agg("at").alias(kept))
    byte = F.conv(F.hex(F.substring(F.col(kept), (at(F.col(key)) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    met = rows.where(F.col(key).isNotNull()).withColumn(told, part(F.col(key))).join(F.broadcast(maps), told)
    return met.where(F.getbit(byte, F.pmod(at(F.col(key)), F.lit(8)).cast("int")) == 1).select(*[F.col(f"`{c}`") for c in rows.columns])


def unused(columns: list[str], name: str) -> str:
    """A column name that no column has, upper and lower case being alike."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def unit_of(doc_id: str, text: str, units: int) -> Column:
    """Spreads documents evenly over units, by id and text, so rows of one id with different texts are spread too."""
    return F.pmod(F.xxhash64(F.col(doc_id), F.col(text)), F.lit(units)).cast("int")


def text_bytes(docs: DataFrame, text: str) -> int:
    return docs.agg(F.sum(F.octet_length(F.col(text)).cast("long"))).first()[0] or 0


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(v, component): the smallest vertex reachable, for each vertex of edges (a, b).

    Each round every vertex takes the smallest label around it, then the label
    of its label, so long chains halve. A hub's edges are pre-aggregated by
    min() before they are shuffled. A round reads the one before it from the
    checkpoint folder; only a count comes to the driver.
    """
    given = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    # Every vertex keeps its smallest neighbour, and hands its others on to it: a group met in many buckets shrinks to a star.
    lowest = given.groupBy("b").agg(F.min("a").alias("low"))
    kept = checkpoint(given.join(lowest, "b").select("a", "b", "low"))
    thin = kept.where("a = low").select("low", "b").union(kept.where("a <> low").select("low", F.col("a").alias("b")).distinct())
    both = checkpoint(thin.select(F.col("low").alias("a"), "b").union(thin.select(F.col("b").alias("a"), F.col("low").alias("b"))).distinct())
    labels = checkpoint(both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("c")))
    for _ in range(rounds):
        near = (
            both.join(labels, both.b == labels.v)
            .groupBy("a")
            .agg(F.min("c").alias("near"))
        )
        met = labels.join(near, labels.v == near.a, "left").select("v", "c", F.least("c", F.coalesce("near", "c")).alias("n"))
        up = labels.select(F.col("v").alias("p"), F.col("c").alias("pc"))
        new = checkpoint(
            met.join(up, met.n == up.p, "left").select("v", "c", F.least("n", F.coalesce("pc", "n")).alias("n"))
        )
        changed = new.where("n <> c").limit(1).count()
        labels = new.select("v", F.col("n").alias("c"))
        if not changed:
            return labels.select("v", F.col("c").alias("component"))
    raise RuntimeError("connected components did not settle")


def fresh(df: DataFrame) -> DataFrame:
    """The same rows under columns of their own, so that frames of one origin can be cogrouped."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])
