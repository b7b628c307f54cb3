"""Sharding by histogram sort: splitters of near-equal bytes are found by counting, then rows move once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keratoline.llm import _spark as S

BUCKETS = 256


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    t = F.col(text)
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.coalesce(F.octet_length(t), F.lit(0)).cast("long") + 1).alias("size"),
        F.coalesce(F.crc32(t), F.lit(0)).cast("long").alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(t, t.isNull()), 2).alias("key"),
    )


def _large_groups(rows: DataFrame, least: float) -> list[tuple[int, int]]:
    """(bytes, key) of the groups of equal texts above `least` bytes, the largest first: at most all bytes / least of them."""
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > least)
    return sorted(((r["bytes"], r["key"]) for r in groups.collect()), reverse=True)


def _level(loads: list[int], rest: int) -> float:
    """The height to which `rest` fills columns that hold `loads`."""
    order = sorted(loads)
    for n in range(len(order), 0, -1):
        level = (rest + sum(order[:n])) / n
        if level >= order[n - 1]:
            return level
    return 0.0


def splitters(rows: DataFrame, goals: list[float], near: float) -> list[int]:
    """Keys below which the bytes come within `near` of each goal, or as near as the keys allow.

    Each round counts, exactly and in place, the bytes in BUCKETS ranges of
    every interval that still holds a goal, and goes on in the range that does.
    """
    t = rows.agg(F.min("key").alias("lo"), F.max("key").alias("hi")).first()
    if t["lo"] is None:
        return [0] * len(goals)
    found: dict[int, int] = {}
    open_ = {s: (t["lo"], t["hi"] + 1, 0) for s in range(len(goals))}  # s: from key, to key, bytes below
    while open_:
        spans = sorted({(lo, hi) for lo, hi, _ in open_.values()})
        bucket: Column = F.lit(None).cast("int")
        for j, (lo, hi) in enumerate(spans):
            step = -(-(hi - lo) // BUCKETS)
            bucket = F.when((F.col("key") >= lo) & (F.col("key") < hi), (F.expr(f"(key - {lo}L) div {step}L") + j * BUCKETS).cast("int")).otherwise(bucket)
        counted = rows.select(bucket.alias("bucket"), "key", "size").where("bucket is not null").groupBy("bucket").agg(F.sum("size").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()
        by_span: dict[int, list] = {}
        for r in sorted(counted, key=lambda r: r["bucket"]):
            by_span.setdefault(r["bucket"] // BUCKETS, []).append(r)
        for s, (lo, hi, below) in list(open_.items()):
            for r in by_span[spans.index((lo, hi))]:
                if below + r["n"] >= goals[s]:
                    break
                below += r["n"]
            else:
                below -= r["n"]
            ends = sorted([(abs(below - goals[s]), r["lo"]), (abs(below + r["n"] - goals[s]), r["hi"] + 1)])
            if ends[0][0] <= near or r["lo"] == r["hi"]:
                found[s] = ends[0][1]
                del open_[s]
            else:
                open_[s] = (r["lo"], r["hi"] + 1, below)
    return [found[s] for s in range(len(goals))]


def shard(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = 8, tolerance: float = 0.001) -> DataFrame:
    """Deals documents into shards of near-equal bytes (law `bytes`).

    Returns doc_id, size (UTF-8 bytes plus 1; null: 1), text_crc32, law, shard,
    slot (gapless from 0 in each shard) and grown_shard (null under this law).
    Equal texts share a shard unless together they exceed one; null texts are
    equal to each other and not to the empty text. Repeated rows are rows of
    their own; null ids are allowed; other columns are not read; an empty table
    gives an empty one; some shards stay empty when there are fewer texts than
    shards; of a very long text only size and checksum are kept. Groups of equal
    texts above a hundredth of a shard (at most 100 * shards of them) are placed
    first, the largest on the emptiest shard, as one range would hold them
    unevenly; one larger than a shard is spread by id. All else is dealt by the
    histogram. Each round of counting sends at most (shards - 1) * BUCKETS sums
    to the driver and needs no exchange of rows.
    """
    spark = docs.sparkSession
    rows = S.checkpoint(_keyed(docs, doc_id, text))
    total = rows.agg(F.sum("size")).first()[0] or 0
    ideal = total / shards
    loads = [0] * shards
    homes = []
    for n, key in _large_groups(rows, ideal * 0.01):
        if n > ideal:  # can't stay together: its rows are spread by id
            homes.append((key, None))
            continue
        s = loads.index(min(loads))
        homes.append((key, s))
        loads[s] += n
    home = spark.createDataFrame(homes, "key long, home int").withColumn("large", F.lit(True))
    spread = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(1)), 2)
    rows = rows.join(F.broadcast(home), "key", "left").withColumn("key", F.when(F.col("large") & F.col("home").isNull(), spread).otherwise(F.col("key"))).drop("large")
    level = _level(loads, total - sum(loads))
    goals, at = [], 0.0
    for load in loads[:-1]:
        at += max(0.0, level - load)
        goals.append(at)
    cuts = splitters(rows.where("home is null"), goals, tolerance * ideal)
    place = F.lit(0)
    for cut in cuts:
        place = place + F.when(F.col("key") >= cut, 1).otherwise(0)
    place = F.coalesce("home", place)
    subs = max(1, S.shuffle_partitions(spark) // 2)
    dealt = rows.select("doc_id", "size", "text_crc32", "key", place.cast("int").alias("shard"), F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(subs)).cast("int").alias("sub"))
    counts = sorted((r["shard"], r["sub"], r["count"]) for r in dealt.groupBy("shard", "sub").count().collect())
    offsets, at, own = [], 0, None
    for s, sub, n in counts:
        at = at if s == own else 0
        offsets.append((s, sub, at))
        at, own = at + n, s
    before = spark.createDataFrame(offsets, "shard int, sub int, before long")
    from pyspark.sql import Window

    order = Window.partitionBy("shard", "sub").orderBy("key", "doc_id", "text_crc32")
    return (
        dealt.withColumn("i", F.row_number().over(order))
        .join(F.broadcast(before), ["shard", "sub"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("i") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
