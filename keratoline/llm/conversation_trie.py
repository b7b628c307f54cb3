"""The prefix trie of conversations, by an external mergesort whose runs carry longest common prefixes."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keratoline.llm import _spark as S

WORD = r"[^\x20\x09-\x0D]+"
MARK, COUNT = 16, 4  # bytes of a turn in a key: of its hash, and of the number of words in its text
TURN = MARK + COUNT
RUN_BYTES = 32 << 20  # of keys that a task sorts at once
RANGE_BYTES = 32 << 20  # of keys, about, that a task merges
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turns_of(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, a turn as hexadecimal digits of its hash and its number of words.

    Ordered by turn, null first; of turns with the same number the one of the
    smaller hash comes first, and rows alike are turns of their own. A
    conversation is one row, 40 digits a turn, so its turns must fit in a task,
    its texts need not. A null role or text is empty. Rows without a conversation are left out. No text leaves
    the task that reads it: what travels is 20 bytes a turn (of SHA-256 half, so
    different turns are told apart). Other columns are not read.
    """
    said, body = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    mark = F.substring(F.sha2(F.concat(F.length(said).cast("string"), F.lit(":"), said, body).cast("binary"), 256), 1, 2 * MARK)
    words = F.lpad(F.hex(F.regexp_count(body, F.lit(WORD)).cast("long")), 2 * COUNT, "0")
    one = rows.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("long").alias("conv_id"), F.struct(F.col(turn).alias("at"), F.lower(F.concat(mark, words)).alias("turn")).alias("one"))
    return one.groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).getField("turn").alias("turns"))


def rebuilt(convs: DataFrame, family: int = 20, most: int = 4) -> DataFrame:
    """(conv_id, turns): each conversation c with its first h turns, h being the checksum of c modulo `most`, taken from conversation c - c % family.

    The head is all that conversation has if it has fewer, and nothing if it is
    not there; c's own turns follow after its first h.
    """
    own = convs.select("conv_id", "turns", (F.col("conv_id") - F.col("conv_id") % family).alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int").alias("h"))
    heads = convs.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    none = F.array().cast("array<string>")
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return own.join(heads, "base", "left").select("conv_id", F.concat(F.slice(F.coalesce("head", none), F.lit(1), F.col("h")), rest).alias("turns"))


def shared(a: bytes, b: bytes, turns: int = 0) -> int:
    """How many turns two keys have in common, of which `turns` are known to be."""
    at, end = turns * TURN, min(len(a), len(b))
    while at < end and a[at : at + TURN] == b[at : at + TURN]:
        at += TURN
    return at // TURN


def _sorted_runs(batches) -> Iterator[pa.RecordBatch]:
    """Sorts by key and conversation, RUN_BYTES at a time; each row tells how many turns it shares with the one before it in its run."""
    base, runs, held, size = TaskContext.get().partitionId() << 32, 0, [], 0

    def run() -> Iterator[pa.RecordBatch]:
        held.sort()
        lcp = [0, *(shared(x[0], y[0]) for x, y in zip(held, held[1:], strict=False))]
        for at in range(0, len(held), 1 << 14):
            part = held[at : at + (1 << 14)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in part], pa.binary()), pa.array([c for _, c in part], pa.int64()), pa.array(np.full(len(part), base + runs)), pa.array(np.arange(at, at + len(part))), pa.array(lcp[at : at + len(part)], pa.int64())],
                names=["key", "conv_id", "run", "i", "lcp"],
            )
        held.clear()

    for batch in batches:
        for key, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held.append((key, conv))
            size += len(key) + 8
            if size > RUN_BYTES:
                yield from run()
                runs, size = runs + 1, 0
    yield from run()


class LoserTree:
    """Merges sorted runs of (key, conv_id, lcp), lcp being the turns shared with the row before in the run.

    Each run's row has a number of turns that it shares with the last row that
    came out. Of two rows the one that shares more is the smaller, and no turn is
    looked at; only where both share as many are turns compared, from there on,
    and the loser keeps what it shares with the winner.
    """

    def __init__(self, runs: list[tuple[list[bytes], list[int], list[int]]]):
        self.runs = runs
        self.at = [0] * len(runs)
        self.lcp = [0 if keys else -1 for keys, _, _ in runs]  # -1: the run is over
        self.compared = 0  # turns that were looked at

    def _wins(self, a: int, b: int) -> bool:
        """Whether run a's row comes before run b's; the loser's lcp is then that with the winner."""
        lcp = self.lcp
        if lcp[a] != lcp[b]:
            return lcp[a] > lcp[b]
        if lcp[a] < 0:
            return True
        (keys_a, convs_a, _), (keys_b, convs_b, _) = self.runs[a], self.runs[b]
        x, y = keys_a[self.at[a]], keys_b[self.at[b]]
        both = shared(x, y, lcp[a])
        self.compared += both - lcp[a] + 1
        left, right = x[both * TURN : (both + 1) * TURN], y[both * TURN : (both + 1) * TURN]
        first = left < right if left != right else convs_a[self.at[a]] < convs_b[self.at[b]]
        lcp[b if first else a] = both
        return first

    def __iter__(self) -> Iterator[tuple[bytes, int, int]]:
        """(key, conv_id, turns shared with the row before) in order."""
        k = len(self.runs)
        if not k:
            return
        losers, winners = [0] * k, [0] * (2 * k)  # node n has children 2n and 2n + 1; run r is leaf k + r
        winners[k:] = range(k)
        for n in range(k - 1, 0, -1):
            a, b = winners[2 * n], winners[2 * n + 1]
            winners[n], losers[n] = (a, b) if self._wins(a, b) else (b, a)
        best = winners[1] if k > 1 else 0
        while self.lcp[best] >= 0:
            keys, convs, lcps = self.runs[best]
            i = self.at[best]
            yield keys[i], convs[i], self.lcp[best]
            self.at[best] = i = i + 1
            self.lcp[best] = lcps[i] if i < len(keys) else -1
            n = (k + best) // 2
            while n:
                if not self._wins(best, losers[n]):
                    best, losers[n] = losers[n], best
                n //= 2


class Node:
    """An open node of the trie: what has been seen below it so far."""

    __slots__ = ("turn", "first", "conv", "n", "kids", "leaves", "saved", "ends", "done")

    def __init__(self, turn: bytes, first: bool):
        self.turn, self.first = turn, first
        self.conv, self.n, self.kids, self.leaves, self.saved = 1 << 63, 0, 0, 0, 0
        self.ends: list = []  # conversations that end here
        self.done: list[int] = []  # rows of its finished children

    def adopt(self, child: Node, own: bool) -> None:
        """A child closes; one that may go on in another range (own: false) is counted when ranges are put together."""
        self.n += child.n
        self.conv = min(self.conv, child.conv)
        if own:
            self.kids += 1
            self.leaves += child.leaves or 1
            self.saved += child.saved + (child.n - 1) * int.from_bytes(child.turn[MARK:])


NODES = "part int, side int, edge boolean, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, turn binary"
_NUMBERS = ("conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens")


class Rows:
    """Finished nodes, by column."""

    def __init__(self, part: int):
        self.part = part
        self.numbers = [array("q") for _ in _NUMBERS]
        self.side, self.parent = array("b"), array("q")  # of the parent: -1 if it is known
        self.ends: list[str] = []
        self.turns: list[bytes | None] = []

    def add(self, node: Node, depth: int, ends: str, turn: bytes | None = None, side: int = -1) -> int:
        for column, x in zip(self.numbers, (node.conv, depth, node.n, node.kids, node.leaves, node.saved), strict=True):
            column.append(x)
        self.side.append(side)
        self.parent.append(0)
        self.ends.append(ends)
        self.turns.append(turn)
        return len(self.ends) - 1

    def name_parent(self, node: Node, side: int) -> None:
        """Tells the node's children whose they are: the conversation, or where side is not -1, what stands in that place at the range's edge."""
        for i in node.done:
            self.side[i], self.parent[i] = side, node.conv

    def batches(self) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(self.ends), 1 << 13):
            cut = slice(at, at + (1 << 13))
            side = np.array(self.side[cut], np.int32)
            numbers = dict(zip(_NUMBERS, (pa.array(np.array(c[cut], np.int64)) for c in self.numbers), strict=True))
            edge = pa.array([t is not None for t in self.turns[cut]], pa.bool_())
            columns = {
                "part": pa.array(np.full(len(side), self.part, np.int32)), "side": pa.array(side), "edge": edge, **numbers,
                "parent_conv_id": pa.array(np.array(self.parent[cut], np.int64), mask=side >= 0), "ends": pa.array(self.ends[cut], pa.string()), "turn": pa.array(self.turns[cut], pa.binary()),
            }
            names = [f.split()[0] for f in NODES.split(", ")]
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)


def _merged(batches) -> Iterator[pa.RecordBatch]:
    """A range's nodes. Those on the way to its first and to its last row may go on in other ranges: they come as edges, side 0 and 1.

    What both ways share is of side 0. Children of an edge name it by side.
    """
    keys: list[bytes] = []
    parts: list[list[np.ndarray]] = [[] for _ in range(4)]
    for batch in batches:
        keys.extend(batch.column(0).to_pylist())
        for held, column in zip(parts, batch.columns[1:], strict=True):
            held.append(column.to_numpy(zero_copy_only=False))
    if not keys:
        return
    conv, run, i, lcp = map(np.concatenate, parts)
    order = np.lexsort((i, run))
    cuts = np.flatnonzero(np.diff(run[order])) + 1
    runs = [([keys[j] for j in own.tolist()], conv[own].tolist(), lcp[own].tolist()) for own in np.split(order, cuts)]
    del keys, parts
    rows = Rows(TaskContext.get().partitionId())
    path = [Node(b"", True)]

    def ids(node: Node) -> str:
        return ",".join(map(str, node.ends))

    def close() -> None:
        node = path.pop()
        path[-1].adopt(node, own=not node.first)
        if node.first:
            rows.add(node, len(path), ids(node), node.turn, 0)
            rows.name_parent(node, 0)
        else:
            node.saved += (node.n - 1) * int.from_bytes(node.turn[MARK:])
            node.leaves = node.leaves or 1
            path[-1].done.append(rows.add(node, len(path), hashlib.sha256(ids(node).encode()).hexdigest() if node.ends else NO_ENDS))
            rows.name_parent(node, -1)

    begun = False
    for key, c, common in LoserTree(runs):
        while len(path) > common + 1:
            close()
        for d in range(len(path) - 1, len(key) // TURN):
            path.append(Node(key[d * TURN : (d + 1) * TURN], not begun))
        begun = True
        top = path[-1]
        top.n += 1
        top.conv = min(top.conv, c)
        top.ends.append(c)
    while path:
        node = path.pop()
        if path:
            path[-1].adopt(node, own=False)
        side = 0 if node.first else 1
        rows.add(node, len(path), ids(node), node.turn, side)
        rows.name_parent(node, side)
    yield from rows.batches()


def _edges_joined(batches) -> Iterator[pa.RecordBatch]:
    """The edges of all ranges, in order, made one trie: its nodes, and for each edge (edge: true) the smallest member of the node that it is part of.

    What is held is the open path and, of an open node, a row for each edge that
    is part of it and each edge child; ids that end in a node are hashed as they come.
    """
    path: list[Node] = []
    rows = Rows(0)

    def close() -> None:
        node = path.pop()
        node.saved += (node.n - 1) * int.from_bytes(node.turn[MARK:]) if path else 0
        node.leaves = node.leaves or 1
        sha, parts = node.ends
        i = rows.add(node, len(path), sha.hexdigest())
        if path:
            up = path[-1]
            up.conv = min(up.conv, node.conv)
            up.kids, up.leaves, up.saved = up.kids + 1, up.leaves + node.leaves, up.saved + node.saved
            up.done.append(i)
        rows.name_parent(node, -1)
        told.extend((part, side, len(path), node.conv) for part, side in parts)

    told: list[tuple[int, int, int, int]] = []
    for batch in batches:
        for r in batch.to_pylist():
            depth = r["depth"]
            if not (depth < len(path) and path[depth].turn == r["turn"]):
                while len(path) > depth:
                    close()
                path.append(Node(r["turn"], False))
                path[-1].ends = [hashlib.sha256(), []]
            node = path[depth]
            node.n += r["n_convs"]
            node.conv = min(node.conv, r["conv_id"])
            node.kids, node.leaves, node.saved = node.kids + r["n_children"], node.leaves + r["n_leaves"], node.saved + r["saved_tokens"]
            if r["ends"]:
                if node.first:  # of this node some have ended before
                    node.ends[0].update(b",")
                node.ends[0].update(r["ends"].encode())
                node.first = True
            node.ends[1].append((r["part"], r["side"]))
    while path:
        close()
    yield from rows.batches()
    schema = [f.split()[0] for f in NODES.split(", ")]
    for at in range(0, len(told), 1 << 13):
        part, side, depth, conv = (np.array(x, np.int64) for x in zip(*told[at : at + (1 << 13)], strict=True))
        null = pa.nulls(len(part), pa.int64())
        columns = {"part": pa.array(part.astype(np.int32)), "side": pa.array(side.astype(np.int32)), "edge": pa.array(np.ones(len(part), bool)), "conv_id": pa.array(conv), "depth": pa.array(depth), "ends": pa.nulls(len(part), pa.string()), "turn": pa.nulls(len(part), pa.binary())}
        yield pa.RecordBatch.from_arrays([columns.get(n, null) for n in schema], names=schema)


def prefix_trie(convs: DataFrame) -> DataFrame:
    """The trie of (conv_id, turns), conv_id given once each, turns as turns_of() writes them.

    A node is a sequence of turns with which a conversation starts, from the
    root of none on. Returns per node: conv_id (its smallest member), depth,
    parent_conv_id (its parent's smallest member; root: null), n_convs
    (members), n_children, n_leaves (childless nodes in its subtree, itself
    included), saved_tokens (summed over its subtree, (n_convs - 1) times the
    words of the node's last turn), ends_sha256 (of the members that end there,
    in order, in decimals with commas between).

    Tasks sort what they read in runs, which keep how many turns each row
    shares with the one before. Runs are dealt by ranges of (turns,
    conversation), so copies of one conversation spread as well, and each range
    is merged by a loser tree; the merged stream opens and closes the nodes of a
    path. A range's edges, two paths, go to one task that puts ranges together;
    with them go the ids of conversations that end there, as one digest runs
    over all of a node's, however many they are: they are streamed, not held.
    An empty table has no root; a conversation without turns ends at the root;
    a null conv_id takes no part.
    """
    keyed = convs.where("conv_id is not null").select(F.coalesce(F.unhex(F.array_join("turns", "")), F.lit(b"")).alias("key"), F.col("conv_id").cast("long").alias("conv_id"))
    runs = S.checkpoint(keyed.mapInArrow(_sorted_runs, "key binary, conv_id long, run long, i long, lcp long"))
    size = runs.agg(F.sum(F.length("key") + 8)).first()[0] or 0
    ranges = max(S.shuffle_partitions(convs.sparkSession), -(-size // RANGE_BYTES))
    nodes = S.checkpoint(runs.repartitionByRange(ranges, "key", "conv_id").mapInArrow(_merged, NODES))
    edges = nodes.where("edge").repartition(1).sortWithinPartitions("part", "side", "depth")
    joined = S.checkpoint(edges.mapInArrow(_edges_joined, NODES))
    place = joined.where("edge").select("part", "side", F.col("depth").alias("above"), F.col("conv_id").alias("named"))
    inner = nodes.where("not edge")
    hung = inner.where("side >= 0").withColumn("above", F.col("depth") - 1).join(place, ["part", "side", "above"])
    parent: Column = F.when(F.col("depth") > 0, F.col("parent_conv_id"))
    shown = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.col("ends").alias("ends_sha256")]
    return (
        inner.where("side < 0").select(*shown)
        .union(hung.withColumn("parent_conv_id", F.col("named")).select(*shown))
        .union(joined.where("not edge").withColumn("parent_conv_id", parent).select(*shown))
    )
