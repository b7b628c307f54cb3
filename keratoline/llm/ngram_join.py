"""Near-duplicate documents by a chosen-path join on word shingles.

Documents with the same set of shingles form a class. Each run puts all classes
into buckets by one sampled shared token (the smallest shingle under a hash
drawn for the run). A bucket of few classes is compared by brute force. A larger
one is split again, recursively, on tokens drawn for each of its paths: a bucket
takes 1 / threshold paths in expectation, so a pair at the threshold keeps one
path alive on average while others die out. A member that is as like its whole
bucket as the threshold asks can't be told apart by splitting: it is compared
with the whole bucket at once and leaves. Runs, and trials of the paths below a
large bucket, are repeated until a pair at the threshold is missed with a
probability below MISS.

A bucket that fits a task is split there; one that does not is split by an
exchange on the paths' tokens. What sketches connect is then compared on the
whole sets, each pair exactly, in tiles, so links are counted without being
listed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keratoline.llm import _hashing as H
from keratoline.llm import _spark as S
from keratoline.llm._kept import only

TOKENS = 48  # of a sketch
MISS, TRIAL_MISS = 1e-6, 0.01  # of a pair at the threshold: by all runs; by the trials below one large bucket that holds it
BUCKET = 200  # classes compared by brute force
HELD = 16_384  # classes of a bucket that one task splits
DEPTH = 4  # splits below a bucket; what is left then is compared whole
LIKE = 0.9  # share of the threshold which a member's mean likeness to its bucket needs to leave the split
TILE = 400_000  # shingles of one side of a tile
FEW = 200_000  # classes that met another, up to which they go to the texts; beyond, texts that may be theirs go to them
_MULTIPLIERS = H.mix(np.arange(1, TOKENS + 1, dtype=H.U64) * H.U64(0xD1342543DE82EF95)) | H.U64(1)


def shingle_sets(column: pa.ChunkedArray | pa.Array, n: int) -> list[np.ndarray]:
    """The distinct shingles of each text, ascending. A text with fewer words is one shingle; none if it has no words."""
    words, starts = H.words(column)
    grams = H.rolling(words, n)
    out = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            out.append(H.runs_hash(words[a:b], np.array([0]), np.array([b - a])))
        else:
            out.append(np.empty(0, H.U64))
    return out


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Row per set: its smallest shingle, by 32 bits, under each of the hashes."""
    out = np.full((len(sets), TOKENS), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero([len(s) > 0 for s in sets])
    if len(full):
        every = np.concatenate([sets[i] for i in full])
        first = np.concatenate([[0], np.cumsum([len(sets[i]) for i in full])[:-1]])
        for j, m in enumerate(_MULTIPLIERS):
            out[full, j] = np.minimum.reduceat(((every * m) >> H.U64(32)).astype(np.uint32), first)
    return out


def set_key(s: np.ndarray) -> int:
    """A signed 64-bit fingerprint of a set."""
    return int((H.mix(s ^ H.U64(0x5851F42D4C957F2D)).sum(dtype=H.U64) + H.U64(len(s))).view(np.int64))


def _signed(docs: DataFrame, doc_id: str, text: str, n: int) -> DataFrame:
    """doc_id, row (a hash of all columns), v (the set's fingerprint), n (its size) and sketch of each row."""

    def run(batches):
        only("ngram_join")
        for batch in batches:
            for s in range(0, batch.num_rows, 1000):
                part = batch.slice(s, 1000)
                sets = shingle_sets(part.column(2), n)
                sig = sketches(sets)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1),
                    pa.array([set_key(x) if len(x) else None for x in sets], pa.int64()),
                    pa.array([len(x) for x in sets], pa.int32()),
                    pa.array([r.tobytes() for r in sig], pa.binary()),
                ], names=["doc_id", "row", "v", "n", "sketch"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), _row_hash(docs).alias("row"), F.col(text)).mapInArrow(run, "doc_id long, row long, v long, n int, sketch binary")


def _row_hash(docs: DataFrame):
    return F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])


def _token(j: int):
    return F.substring("sketch", 4 * j + 1, 4)


def _matches(a: str, b: str):
    """How many tokens two sketches share."""
    same = F.lit(0)
    for j in range(TOKENS):
        same = same + (F.substring(a, 4 * j + 1, 4) == F.substring(b, 4 * j + 1, 4)).cast("int")
    return same


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest row reachable from each of n rows over the pairs a - b."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def _join(root: np.ndarray, x: int, others: np.ndarray) -> None:
    """Puts row x and the others into one tree of `root`, in which every row names the smallest of its tree."""
    trees = np.unique(np.append(root[others], root[x]))
    if len(trees) > 1:
        root[np.isin(root, trees)] = trees[0]


def _by_key(batches, keys: list[str]):
    """Arrow batches sorted by key, cut anew so that each holds whole groups."""
    rest = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rest = rows if rest is None else pa.concat_tables([rest, rows])
        if not rest.num_rows:
            continue
        same = np.ones(rest.num_rows, bool)
        for k in keys:
            x = rest[k].to_numpy()
            same &= x == x[-1]
        cut = rest.num_rows - (int(np.argmin(same[::-1])) if not same.all() else rest.num_rows)
        if cut:
            yield rest.slice(0, cut)
            rest = rest.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest


def survival(threshold: float, depth: int) -> float:
    """The chance that a pair at the threshold still shares a path after so many splits."""
    whole, part = _branches(threshold)
    p = 1.0
    for _ in range(depth):
        lost = 1 - threshold * p
        p = 1 - lost**whole * (1 - part + part * lost)
    return p


def _branches(threshold: float) -> tuple[int, float]:
    """Paths that a bucket always takes, and the chance of one more: 1 / threshold together."""
    return int(1 / threshold), 1 / threshold - int(1 / threshold)


def repeats(threshold: float) -> tuple[int, int]:
    """(runs, trials below a large bucket) that the recall asked for needs."""
    trials = math.ceil(math.log(TRIAL_MISS) / math.log(1 - survival(threshold, DEPTH)))
    return math.ceil(math.log(MISS) / math.log(1 - threshold * (1 - TRIAL_MISS))), trials


class Paths:
    """The recursive split of one bucket. root: for each of its rows, the smallest row it is connected to."""

    def __init__(self, sketch: np.ndarray, threshold: float, least: int, seed: int):
        self.sketch, self.threshold, self.least = sketch, threshold, least
        self.root = np.arange(len(sketch))
        rng = np.random.default_rng(seed)
        rows = self.leave(np.arange(len(sketch)))
        for _ in range(repeats(threshold)[1]):
            self.split(rows, 0, rng)

    def compare(self, one: np.ndarray, rows: np.ndarray) -> None:
        """Connects what is alike between one and rows; pairs that are connected already need no look."""
        for x in one:
            far = rows[self.root[rows] != self.root[x]]
            if len(far):
                alike = far[(self.sketch[far] == self.sketch[x]).sum(1) >= self.least]
                if len(alike):
                    _join(self.root, x, alike)

    def leave(self, rows: np.ndarray) -> np.ndarray:
        """The rows that the split goes on with, after those like the whole bucket are compared with all of it."""
        likeness = np.zeros(len(rows))
        for j in range(TOKENS):
            _, at, count = np.unique(self.sketch[rows, j], return_inverse=True, return_counts=True)
            likeness += count[at] - 1
        like = likeness >= LIKE * self.threshold * TOKENS * (len(rows) - 1)
        self.compare(rows[like], rows)
        return rows[~like]

    def split(self, rows: np.ndarray, depth: int, rng: np.random.Generator) -> None:
        if len(rows) <= BUCKET or depth == DEPTH:
            self.compare(rows, rows)
            return
        whole, part = _branches(self.threshold)
        for _ in range(whole + (rng.random() < part)):
            token = self.sketch[rows, rng.integers(TOKENS)]
            order = np.argsort(token, kind="stable")
            for group in np.split(rows[order], np.flatnonzero(np.diff(token[order])) + 1):
                if len(group) > BUCKET:
                    group = self.leave(group)
                if len(group) > 1:
                    self.split(group, depth + 1, rng)


def _compare_buckets(threshold: float, least: int):
    def run(batches):
        for rows in _by_key(batches, ["bucket"]):
            key, v = rows["bucket"].to_numpy(), rows["v"].to_numpy()
            sketch = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint32).reshape(len(key), TOKENS)
            cut = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
            size = np.diff(cut)
            found_a, found_b = [], []
            for i in np.flatnonzero(size > BUCKET):
                root = Paths(sketch[cut[i] : cut[i + 1]], threshold, least, int(key[cut[i]]) & 0xFFFFFFFF).root
                found_a.append(cut[i] + root)
                found_b.append(np.arange(cut[i], cut[i + 1]))
            at = np.flatnonzero(np.repeat(size <= BUCKET, size))
            for step in range(1, BUCKET):
                at = at[at + step < len(key)]
                at = at[key[at] == key[at + step]]
                if not len(at):
                    break
                for s in range(0, len(at), 65536):
                    x = at[s : s + 65536]
                    x = x[(sketch[x] == sketch[x + step]).sum(1) >= least]
                    found_a.append(x)
                    found_b.append(x + step)
            a = np.concatenate(found_a) if found_a else np.empty(0, np.int64)
            b = np.concatenate(found_b) if found_b else a
            root = _forest(a, b, len(key))
            edge = np.flatnonzero(v[root] != v)
            yield pa.RecordBatch.from_arrays([pa.array(v[root[edge]]), pa.array(v[edge])], names=["a", "b"])

    return run


def candidates(classes: DataFrame, threshold: float) -> DataFrame:
    """Edges (a, b) that connect all classes v that a bucket of the chosen paths shows to be alike."""
    runs, trials = repeats(threshold)
    least = max(1, math.floor(TOKENS * threshold - 5 * math.sqrt(TOKENS * threshold * (1 - threshold))))
    narrow = classes.select("v", "sketch")
    parts = S.shuffle_partitions(classes.sparkSession)
    level = narrow.select("v", F.explode(F.array(*[F.struct(F.lit(r).alias("run"), F.xxhash64(F.lit(r), _token(r % TOKENS)).alias("bucket")) for r in range(runs)])).alias("x"))
    level = level.select("v", "x.run", "x.bucket", F.lit(True).alias("open"))
    edges = None

    def compared(rows: DataFrame) -> DataFrame:
        dealt = rows.join(narrow, "v").repartition(parts, "bucket").sortWithinPartitions("bucket", "v")
        return dealt.select("bucket", "v", "sketch").mapInArrow(_compare_buckets(threshold, least), "a long, b long")

    for depth in range(DEPTH + 1):
        sizes = level.groupBy("bucket").agg(F.count("*").alias("size"), F.count_if("open").alias("others")).where("size > 1 and others > 0")
        sized = S.checkpoint(level.join(sizes, "bucket"))
        own = compared(sized.where(F.col("size") <= HELD).select("bucket", "v"))
        edges = own if edges is None else edges.union(own)
        large = sized.where(F.col("size") > HELD).select("v", "run", "bucket")
        if not large.limit(1).count():
            return edges
        # Too large for a task. All are compared with one member; those like it are connected by that, so of their pairs
        # only those with the others (open) are still to be looked at.
        turn = F.xxhash64("v", "bucket")
        pivots = large.join(narrow, "v").groupBy("bucket").agg(F.min_by("v", turn).alias("a"), F.min_by("sketch", turn).alias("pivot"))
        facing = large.join(narrow, "v").join(pivots, "bucket").withColumn("open", _matches("sketch", "pivot") < least)
        facing = S.checkpoint(facing.select("v", "run", "bucket", "a", "open", "sketch"))
        edges = edges.union(facing.where(~F.col("open") & (F.col("v") != F.col("a"))).select("a", F.col("v").alias("b")))
        half = max(1, HELD // 2)
        met = facing.groupBy("bucket").agg(F.ceil(F.count_if("open") / half).cast("int").alias("side"), F.ceil(F.count("*") / half).cast("int").alias("sides")).where("side > 0")
        facing = facing.join(met, "bucket")
        # Few others, or no split left: blocks of the others meet blocks of all.
        rest = facing.where((F.col("side") == 1) | F.lit(depth == DEPTH))
        place = lambda n: F.pmod(F.xxhash64("v", "bucket"), F.col(n)).cast("int")
        key = lambda i, j: F.xxhash64("bucket", i, j)
        every = rest.select("v", place("sides").alias("j"), "bucket", F.explode(F.sequence(F.lit(0), F.col("side") - 1)).alias("i"))
        others = rest.where("open").select("v", place("side").alias("i"), "bucket", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)).alias("j"))
        edges = edges.union(compared(every.select(key("i", "j").alias("bucket"), "v").unionByName(others.select(key("i", "j").alias("bucket"), "v")).distinct()))
        if depth == DEPTH:
            return edges
        paths = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(trials if depth == 0 else 1)), lambda t: _paths(t, depth, threshold)))
        level = facing.where("side > 1").select("v", "run", "open", F.explode(F.transform(paths, lambda p: F.xxhash64("bucket", p, F.substring("sketch", F.pmod(p, F.lit(TOKENS)).cast("int") * 4 + 1, F.lit(4))))).alias("bucket"))
    return edges


def _paths(trial, depth: int, threshold: float):
    """Numbers drawn for the paths that a bucket takes: 1 / threshold of them in expectation, the same for all members."""
    whole, part = _branches(threshold)
    drawn = [F.xxhash64("bucket", trial, F.lit(depth), F.lit(i)) for i in range(whole + 1)]
    more = F.pmod(F.xxhash64("bucket", trial, F.lit(depth), F.lit(-1)), F.lit(1 << 20)) < int(part * (1 << 20))
    return F.when(more, F.array(*drawn)).otherwise(F.array(*drawn[:-1]))


def _differences(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sets as differences from the tokens that most of them have: tokens in order of the sets, starts, sizes of the sets.

    Two sets differ by the tokens in which their differences differ, and among
    near copies a difference is a few tokens where a set is hundreds.
    """
    size = np.array([len(x) for x in sets])
    _, every = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), size)
    count = np.bincount(every)
    usual = np.flatnonzero(count > len(sets) / 2)
    number = np.full(len(count), -1)
    number[usual] = np.arange(len(usual))
    own = number[every]
    lacks = np.ones((len(sets), len(usual)), bool)
    lacks[row[own >= 0], own[own >= 0]] = False
    lack_row, lack = np.nonzero(lacks)
    row, token = np.concatenate([row[own < 0], lack_row]), np.concatenate([every[own < 0], lack + len(count)])
    order = np.argsort(row, kind="stable")
    return token[order], np.searchsorted(row[order], np.arange(len(sets) + 1)), size


def linked(sets: list[np.ndarray], side: np.ndarray, within: bool, weight: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For each set: the weights of the sets it is linked to, summed, and the smallest set it is connected to.

    within: pairs of one side count; else only pairs of two sides.
    """
    m = len(sets)
    token, first, size = _differences(sets)
    differs = np.diff(first)
    order = np.argsort(token, kind="stable")
    holder = np.repeat(np.arange(m), differs)[order]
    names, at = np.unique(token[order], return_index=True)
    begin = np.append(at, len(token))[np.searchsorted(names, token)] if len(token) else token
    end = np.append(at[1:], len(token))[np.searchsorted(names, token)] if len(token) else token
    links, root = np.zeros(m, np.int64), np.arange(m)
    for x in range(m - 1):
        lists = [holder[begin[t] : end[t]] for t in range(first[x], first[x + 1])]
        shared = np.bincount(np.concatenate(lists), minlength=m)[x + 1 :] if lists else 0
        apart = differs[x] + differs[x + 1 :] - 2 * shared
        total = size[x] + size[x + 1 :]
        both = (total - apart) // 2
        hit = both >= threshold * (total - both) - 1e-9
        if not within:
            hit &= side[x + 1 :] != side[x]
        hit = np.flatnonzero(hit) + x + 1
        if len(hit):
            links[x] += weight[hit].sum()
            links[hit] += weight[x]
            _join(root, x, hit)
    return links, root


def _compare_tiles(threshold: float):
    def run(batches):
        for rows in _by_key(batches, ["component", "i", "j"]):
            keys = np.stack([rows[k].to_numpy() for k in ("component", "i", "j")], 1)
            cut = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            v, size, part = rows["v"].to_numpy(), rows["size"].to_numpy(), rows["part"].to_numpy()
            out_v, out_n, out_root = [], [], []
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(v)], strict=True):
                if b - a < 2:
                    continue
                sets = [np.cumsum(H.unpack(x), dtype=H.U64) for x in rows["set"].slice(a, b - a).to_pylist()]
                links, root = linked(sets, part[a:b], keys[a, 1] == keys[a, 2], size[a:b], threshold)
                some = np.flatnonzero(links)
                out_v.append(v[a:b][some])
                out_n.append(links[some])
                out_root.append(v[a:b][root[some]])
            if out_v:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_v, out_n, out_root)], names=["v", "links", "root"])

    return run


def _sharing_rare(rows: DataFrame, threshold: float) -> DataFrame:
    """Edges (a, b) that connect the sets (component, v, set) which may link, by the prefix filter, which loses none.

    Of two sets that link, each holds all but a share of 1 - threshold of the
    other. Put in one order, by how many sets of the component have them, one of
    the first n - threshold * n + 1 shingles of either is then the other's too.
    What a template shares with all comes late in that order, so documents that
    have only the template in common stay apart. Each shingle is counted and met
    once a set; sets that share one are connected to the smallest, never paired.
    """
    tokens = rows.select("component", "v", F.size("set").alias("n"), F.explode("set").alias("token"))
    often = tokens.groupBy("component", "token").agg(F.count(F.lit(1)).alias("often"), F.min("v").alias("a")).where("often > 1")
    first = (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int")
    met = tokens.join(often, ["component", "token"]).groupBy("component", "v", "n").agg(F.array_sort(F.collect_list(F.struct("often", "token", "a"))).alias("shared"))
    # Shingles that no other set has come first in the order, and connect nothing.
    left = F.greatest(first - (F.col("n") - F.size("shared")), F.lit(0))
    edges = met.select(F.explode(F.transform(F.slice("shared", F.lit(1), left), lambda x: x["a"])).alias("a"), F.col("v").alias("b"))
    return edges.where("a <> b").distinct()


def _grouped(docs: DataFrame, doc_id: str, text: str, shingle: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(the signed rows, each class with its size, links and group)."""
    spark = docs.sparkSession
    parts = S.shuffle_partitions(spark)
    signed = S.checkpoint(_signed(docs, doc_id, text, shingle))
    linkable = signed.where("v is not null and doc_id is not null")
    classes = S.checkpoint(linkable.groupBy("v").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("size"), F.max("n").alias("n"), F.max("sketch").alias("sketch")))
    met = S.connected_components(candidates(classes, threshold))

    # Whole sets, of one document per class that met another, in tiles of its component.
    known = S.checkpoint(met.join(classes.select("v", "class_id", "size", "n"), "v").withColumnRenamed("class_id", "id"))
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    repeated = bool(signed.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count())

    def with_sets(members: DataFrame, kind: str, made) -> DataFrame:
        """The members with `set`, made of the distinct shingles of their texts."""
        kept = [c for c in members.columns if c != "id"]

        def sets(batches):
            for batch in batches:
                for s in range(0, batch.num_rows, 1000):
                    part = batch.slice(s, 1000)
                    found = shingle_sets(part.column(part.schema.get_field_index("text")), shingle)
                    vs = part.column(part.schema.get_field_index("v")).to_pylist()
                    own = [i for i, x in enumerate(found) if len(x) and set_key(x) == vs[i]]
                    rows = part.select(kept).take(pa.array(own, pa.int64()))
                    yield pa.RecordBatch.from_arrays([*rows.columns, made([found[i] for i in own])], names=[*kept, "set"])

        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in members.schema.fields if f.name != "id")
        count = members.count()
        some = F.broadcast(members).join(texts, "id") if count <= FEW else members.join(S.may_be_among(texts, "id", members, count), "id")
        out = some.mapInArrow(sets, f"{schema}, set {kind}")
        return out.dropDuplicates(["v"]) if repeated else out  # rows that repeat an id may hold one set twice

    tiles_of = F.ceil(F.sum("n") / TILE).cast("int").alias("tiles")
    wide = S.checkpoint(known.groupBy("component").agg(tiles_of))
    if wide.where("tiles > 1").limit(1).count():
        # Members of a component that a tile can't hold meet only where they share one of their rarest shingles.
        large = with_sets(known.join(wide.where("tiles > 1"), "component").select("component", "v", "id"), "array<bigint>", lambda sets: pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64())))
        parted = S.connected_components(_sharing_rare(large, threshold))
        small = known.join(wide.where("tiles = 1"), "component").select("component", "v", "id", "size", "n")
        known = S.checkpoint(small.unionByName(known.drop("component").join(parted, "v").select("component", "v", "id", "size", "n")))
        wide = known.groupBy("component").agg(tiles_of)
    members = known.join(wide, "component").select("component", "v", "size", "id", "tiles")
    whole = with_sets(members, "binary", lambda sets: pa.array([H.pack(np.diff(x, prepend=H.U64(0))) for x in sets], pa.binary()))
    part = F.pmod(F.xxhash64("v"), F.col("tiles")).cast("int")
    dealt = whole.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "component", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "v", "size", "part", "set"
    )
    tiles = dealt.repartition(parts, "component", "i", "j").sortWithinPartitions("component", "i", "j", "v")
    linked = S.checkpoint(tiles.mapInArrow(_compare_tiles(threshold), "v long, links long, root long"))
    groups = S.connected_components(linked.select(F.col("v").alias("a"), F.col("root").alias("b")))
    counts = linked.groupBy("v").agg(F.sum("links").alias("links"))
    named = classes.select("v", "class_id", "size").join(groups, "v", "left").join(counts, "v", "left")
    named = named.withColumn("component", F.coalesce("component", "v"))
    lowest = named.groupBy("component").agg(F.min(F.struct("class_id", "v")).alias("first"))
    told = named.join(lowest, "component").select(
        "v", "class_id", F.col("first.class_id").alias("component_id"), (F.col("first.v") == F.col("v")).alias("leads"), (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    return signed, told


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row per document with a class, its links and its group.

    Returns doc_id, class_id (the smallest id with the same set of shingles),
    n_links (other rows whose Jaccard similarity of distinct shingles is at
    least the threshold, copies among them), component_id (the smallest id
    reachable by links) and kept (doc_id = component_id). Words are cut at
    ASCII white space and taken unchanged; a text with fewer words than a
    shingle is one shingle. Null and empty texts, and rows without an id, link
    with nothing and are kept, each its own class. Rows that repeat an id count
    as rows; other columns are not read; an empty table gives an empty one. A
    text of any length is taken whole: its sketch is of one size, and its set
    goes to a tile by itself where it fills one.

    What sketches connect beyond a tile of TILE shingles is parted first, by the
    rarest shingles of each set, without losing a link (_sharing_rare). Links
    inside a group of m near copies are m * m / 2 comparisons, spread over tiles
    of at most 2 * TILE shingles (or two longer texts); a set is copied once per
    TILE shingles of its group.
    """
    signed, told = _grouped(docs, doc_id, text, shingle, threshold)
    return signed.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("v")).alias("v")).join(told, "v", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of docs, all columns, of which one of each group of near duplicates stays.

    That is the row of the smallest id in its group (ties, where an id repeats,
    by a hash of the row). Rows are told apart by id and content, so a repeated
    id loses no text of its own: of rows alike in every column one stays, rows
    of one id with texts that are not alike all stay. Rows without an id, and
    null and empty texts, stay.
    """
    signed, told = _grouped(docs, doc_id, text, shingle, threshold)
    linkable = signed.where("v is not null and doc_id is not null").select("v", F.struct("doc_id", "row").alias("r"))
    picked = linkable.groupBy("v").agg(F.min("r").alias("r")).join(told.where("leads"), "v").select("r.doc_id", "r.row", F.lit(True).alias("stays"))
    rows = linkable.groupBy("r.doc_id", "r.row").agg(F.count("*").alias("n")).join(picked, ["doc_id", "row"], "left")
    names = [f"c{i}" for i in range(len(docs.columns))]
    given = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)], F.col(doc_id).cast("long").alias("id"), _row_hash(docs).alias("row"))
    joined = lambda which: which.select(F.col("doc_id").alias("id"), "row")
    out = given.join(joined(rows.where("stays is null")), ["id", "row"], "left_anti")
    again = rows.where("stays and n > 1")
    if again.limit(1).count():
        again = S.checkpoint(joined(again))
        once = given.join(again, ["id", "row"]).dropDuplicates(["id", "row"])
        out = out.join(again, ["id", "row"], "left_anti").unionByName(once)
    return out.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)])
