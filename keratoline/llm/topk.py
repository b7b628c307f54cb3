"""Exact top-k search by inner product with a dual-tree over cover trees."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keratoline.llm import _spark as S
from keratoline.llm import _vectors as V

BASE, LEAF = 1.3, 64
LEAST_BLOCK, DATA_BLOCK, QUERY_BLOCK = 256, 8_192, 16_384  # rows of a block, from and to; queries that meet one at a time
TOGETHER = 1 << 20  # components of queries that are sent on in one batch
SAMPLE, MOST_CELLS = 16_384, 4_096  # rows from which the cells' centres are taken, and how many centres there are at most


class Node:
    """All rows lie within radius of the centre."""

    __slots__ = ("centre", "norm", "radius", "rows", "children")

    def __init__(self, points: np.ndarray, centre: np.ndarray, rows: np.ndarray, children: list[Node]):
        self.centre, self.rows, self.children = centre, rows, children
        self.norm = math.sqrt(float(centre @ centre))
        self.radius = math.sqrt(float(((points[rows] - centre) ** 2).sum(1).max()))


def cover_tree(points: np.ndarray) -> list[Node]:
    """The cover tree of a block's rows, as a list of its root.

    A node's children have their centres more than its covering distance apart
    and cover its rows within it; the distance falls by BASE a level. Children
    of few rows are put together into leaves.
    """
    square = (points**2).sum(1)

    def far(c: int, rows: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(square[rows] + square[c] - 2 * (points[rows] @ points[c]), 0))

    def grow(rows: np.ndarray, centre: int, reach: float) -> Node:
        if len(rows) <= LEAF or reach < 1e-9:
            return Node(points, points[centre], rows, [])
        reach /= BASE
        children, few, left, c = [], [], rows, centre
        while len(left):
            near = far(c, left) <= reach
            near |= left == c
            own = left[near]
            if len(own) > LEAF // 4:
                children.append(Node(points, points[c], own, []) if len(own) <= LEAF else grow(own, c, reach))
            else:
                few.append(own)
            left = left[~near]
            c = left[0] if len(left) else c
        if few:
            rest = np.concatenate(few)
            for s in range(0, len(rest), LEAF):
                part = rest[s : s + LEAF]
                children.append(Node(points, points[part].mean(0), part, []))
        return children[0] if len(children) == 1 else Node(points, points[centre], rows, children)

    rows = np.arange(len(points))
    return [grow(rows, 0, float(far(0, rows).max()) * (1 + 1e-9))]


NONE = np.iinfo(np.int64).min  # no score


def products(q: np.ndarray, x: np.ndarray, most: float) -> np.ndarray:
    """Inner products of rows of whole numbers, exact; `most` bounds what the terms of one sum to in size."""
    if most < 2**53:
        return (q @ x.T).astype(np.int64)
    q, x = q.astype(np.int64), x.astype(np.int64)
    if most < 2**63:
        return q @ x.T
    got = q.astype(object) @ x.astype(object).T
    if got.size and max(abs(got.min()), abs(got.max())) >= 2**63 - 1:
        raise OverflowError("a score lies beyond 64 bits; take a smaller scale")
    return got.astype(np.int64)


class Search:
    """The k best rows of a block for each query of a block; ties to the smaller id. Vectors are whole numbers in doubles, scores are 64-bit."""

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, floor: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int):
        self.q, self.q_ids, self.x, self.ids, self.k = queries, query_ids, points, ids, k
        self.floor = floor  # scores below these are of no use
        self.score = np.full((len(queries), k), NONE)
        self.id = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.most = queries.shape[1] * float(np.abs(queries).max(initial=0)) * float(np.abs(points).max(initial=0))
        trees = cover_tree(points) if len(points) else []
        for node in cover_tree(queries) if len(queries) else []:
            self.visit(node, trees)

    def worst(self, rows: np.ndarray) -> int:
        return int(np.maximum(self.score[rows, -1], self.floor[rows]).min())

    def bound(self, q: Node, d: Node) -> float:
        b = float(q.centre @ d.centre) + q.radius * d.norm + d.radius * q.norm + q.radius * d.radius
        return b + 1e-9 * (abs(b) + q.norm * d.norm + 1)

    def visit(self, q: Node, nodes: list[Node]) -> None:
        worst = self.worst(q.rows)
        some = sorted(((self.bound(q, d), i, d) for i, d in enumerate(nodes)), key=lambda x: (-x[0], x[1]))
        some = [(b, d) for b, _, d in some if b >= worst]
        if q.children:
            down = [c for _, d in some for c in (d.children or [d])]
            for child in q.children:
                self.visit(child, down)
            return
        for b, d in some:
            if b < self.worst(q.rows):
                return
            if d.children:
                self.visit(q, d.children)
            else:
                self.compare(q.rows, d.rows)

    def compare(self, rows: np.ndarray, cols: np.ndarray) -> None:
        got = products(self.q[rows], self.x[cols], self.most)
        got[(self.q_ids[rows, None] == self.ids[None, cols]) | (got < self.floor[rows, None])] = NONE
        change = (got >= np.maximum(self.score[rows, -1], NONE + 1)[:, None]).any(1)
        rows, got = rows[change], got[change]
        score = np.concatenate([self.score[rows], got], 1)
        ids = np.concatenate([self.id[rows], np.broadcast_to(self.ids[cols], got.shape)], 1)
        best = np.lexsort((ids, ~score), axis=1)[:, : self.k]
        self.score[rows] = np.take_along_axis(score, best, 1)
        self.id[rows] = np.take_along_axis(ids, best, 1)


def net(points: np.ndarray, most: int) -> np.ndarray:
    """At most `most` rows of points, the top level of a cover tree: each the farthest from those before it, so they are as far apart as they cover."""
    far = np.full(len(points), np.inf)
    chosen = []
    while len(chosen) < most:
        c = int(far.argmax()) if chosen else 0
        if chosen and far[c] <= 0:
            break
        chosen.append(c)
        far = np.minimum(far, ((points - points[c]) ** 2).sum(1))
    return points[chosen]


class Cells:
    """Centres of the cells that rows are dealt to."""

    def __init__(self, centres: np.ndarray):
        self.centres = centres
        self.square = (centres**2).sum(1)

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centre of each row, and how far away it is."""
        cell = np.concatenate([(self.square - 2 * x[s : s + 4096] @ self.centres.T).argmin(1) for s in range(0, len(x), 4096)]) if len(x) else np.empty(0, np.int64)
        return cell, np.sqrt(((x - self.centres[cell]) ** 2).sum(1))

    def bounds(self, q: np.ndarray, radius: np.ndarray, at: np.ndarray | slice = slice(None), around: float = 0.0) -> np.ndarray:
        """For each query and each cell of `at`, what no inner product with a row of the cell exceeds, for any query so far `around` it."""
        inner, norm, far = q @ self.centres[at].T, np.sqrt((q**2).sum(1))[:, None], np.sqrt(self.square[at])
        bound = inner + norm * radius[at] + around * (far + radius[at])
        return bound + 1e-9 * (np.abs(inner) + (norm + around) * (radius[at] + far) + 1)

    def reached(self, queries: np.ndarray, floor: np.ndarray, radius: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(queries, cells, which of these each of those reaches), leaf by leaf of the queries' cover tree.

        A node goes on with the cells that some query of it may reach, by both
        radii and the smallest floor in it; in a leaf each query has its own bound.
        """
        some = [(node, np.flatnonzero(np.isfinite(radius))) for node in (cover_tree(queries) if len(queries) else [])]
        while some:
            node, at = some.pop()
            at = at[self.bounds(node.centre[None], radius, at, node.radius)[0] >= floor[node.rows].min()]
            if node.children:
                some += [(child, at) for child in node.children]
            else:
                yield node.rows, at, self.bounds(queries[node.rows], radius, at) >= floor[node.rows, None]


def packed(x: np.ndarray, kind: str) -> pa.Array:
    """Each row of whole numbers as the bytes of its components."""
    data = np.ascontiguousarray(x.astype(kind))
    at = np.arange(len(x) + 1, dtype=np.int32) * (data.itemsize * x.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(at), pa.py_buffer(data)])


def unpacked(column: pa.ChunkedArray | pa.Array, dims: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dims).astype(np.float64)


ASKED = "b long, ids array<long>, v binary, floor array<long>"  # queries that go to one block, together


def asking(rows: list[tuple], kind: str) -> pa.RecordBatch:
    """Of (block, ids, vectors, floors)."""
    columns = [
        pa.array([b for b, *_ in rows], pa.int64()), pa.array([ids for _, ids, _, _ in rows], pa.list_(pa.int64())),
        pa.array([v.astype(kind).tobytes() for _, _, v, _ in rows], pa.binary()), pa.array([floor for *_, floor in rows], pa.list_(pa.int64())),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["b", "ids", "v", "floor"])


def top_k(vectors: DataFrame, is_query: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = 10, scale: int = 1024) -> DataFrame:
    """Each query's k highest inner products among all rows but its own.

    Components become floor(scale * x) of x as double; scores are exact whole
    numbers. A component of 2**62 or a score beyond 64 bits is an error. Returns query_id, rank
    (from 1), vec_id, score; ties go to the smaller id, and a query has fewer
    rows where there are fewer candidates. Null or empty vectors, vectors with
    null or non-finite components, and null ids take no part; shorter vectors
    count as padded with zeros. A repeated row is a candidate each time; rows
    with the query's own id are its own; an id that asks more than once asks
    with its smallest vector. Other columns are not read; an empty table gives
    an empty one.

    Rows are dealt to cells around the top nodes of a cover tree (of at most
    SAMPLE rows), cells to blocks of at most DATA_BLOCK rows. Each query first
    meets one block of the cell with the highest bound, which gives it a score
    that its k-th best can't fall below. Then queries that lie near each other
    are brought together, as many as an Arrow batch has, and the nodes of their
    cover tree are held against the cells, by the radii of both and the smallest
    of those scores in the node. What a leaf's queries have in common goes to a
    block as one row, the queries whose own bound reaches its cell. In a block,
    trees of its queries and rows are searched together. A row moves once for
    each QUERY_BLOCK queries that need its block, a query once for each block it
    needs, in as few bytes a component as the largest one wants.
    """
    spark = vectors.sparkSession
    given = vectors.where(F.col(vec_id).isNotNull() & V.usable(vector)).select(
        F.col(vec_id).cast("long").alias("id"), F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"),
    )
    rows = S.checkpoint(given)
    largest = F.max(F.array_max(F.transform("v", F.abs)))
    n, dims, most = rows.agg(F.count("*"), F.max(F.size("v")), largest).first()
    dims, most = dims or 1, most or 0
    if most >= 2**62:
        raise OverflowError("a component lies beyond 62 bits; take a smaller scale")
    kind = next(k for k, bits in (("<i2", 15), ("<i4", 31), ("<i8", 63)) if most < 2**bits)
    block = min(DATA_BLOCK, max(LEAST_BLOCK, -(-n // (2 * S.shuffle_partitions(spark)))))
    sample = rows.orderBy(F.xxhash64("id", F.lit(3)), "id", "v").limit(SAMPLE).select("v").toArrow()
    cells = Cells(net(V.block(sample["v"], dims), min(MOST_CELLS, max(1, -(-n // block)))) if n else np.zeros((1, dims)))

    def deal(batches):
        for batch in batches:
            cell, far = cells.place(V.block(batch.column(1), dims))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(far)], names=["id", "v", "asks", "cell", "far"])

    placed = S.checkpoint(rows.mapInArrow(deal, "id long, v array<double>, asks boolean, cell int, far double"))
    known = {r["cell"]: (r["n"], r["far"]) for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}  # at most MOST_CELLS rows
    count = np.array([known.get(c, (0, 0.0))[0] for c in range(len(cells.centres))], np.int64)
    radius = np.array([known.get(c, (0, -math.inf))[1] for c in range(len(count))]) * (1 + 1e-9)  # a cell without rows is out of reach
    blocks = -(-count // block)
    first = np.cumsum(blocks) - blocks  # a cell's blocks are numbered one behind the other

    def block_of(batches):
        for batch in batches:
            cell, turn = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), packed(V.block(batch.column(1), dims), kind), pa.array(first[cell] + turn % blocks[cell])], names=["id", "v", "b"])

    data = placed.select("id", "v", "cell", F.pmod(F.xxhash64("id", "v"), F.lit(1 << 40)).alias("turn")).mapInArrow(block_of, "id long, v binary, b long")
    queries = placed.where("asks").groupBy("id").agg(F.min("v").alias("v"))

    def home(batches):
        """One block of the cell with the highest bound, of those with enough rows; and the cell that a query lies in."""
        usual = np.where(count > 0, radius, 0.0)
        for batch in batches:
            x = V.block(batch.column(1), dims)
            bound = cells.bounds(x, usual)
            bound[:, count <= k] = -np.inf
            cell = pa.array(cells.place(x)[0].astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), packed(x, kind), cell, pa.array(first[bound.argmax(1)])], names=["id", "v", "cell", "b"])

    def at_home(batches):
        for batch in batches:
            ids, x, b = batch.column(0).to_numpy(), unpacked(batch.column(1), dims, kind), batch.column(3).to_numpy()
            order = np.argsort(b, kind="stable")
            yield asking([(b[own[0]], ids[own], x[own], np.full(len(own), NONE)) for own in np.split(order, np.flatnonzero(np.diff(b[order])) + 1) if len(own)], kind)

    def onward(batches):
        """To all blocks of the cells whose bound reaches the floor, but for the one met already."""
        for batch in batches:
            ids, x, seen, floor = batch.column(0).to_numpy(), unpacked(batch.column(1), dims, kind), batch.column(2).to_numpy(), batch.column(3).to_numpy()
            for leaf, at, reach in cells.reached(x, floor, radius):
                out, held = [], 0
                for c, own in zip(at, reach.T, strict=True):
                    for b in range(first[c], first[c] + blocks[c]):
                        some = leaf[own & (seen[leaf] != b)]
                        if len(some):
                            out.append((b, ids[some], x[some], floor[some]))
                            held += len(some)
                        if held * dims >= TOGETHER:
                            yield asking(out, kind)
                            out, held = [], 0
                if out:
                    yield asking(out, kind)

    def search(key: tuple, asked: pa.Table, held: pa.Table) -> pa.Table:
        flat = lambda c: asked[c].combine_chunks().flatten().to_numpy()
        q_ids = flat("ids")
        s = Search(unpacked(asked["v"], dims, kind), q_ids, flat("floor"), unpacked(held["v"], dims, kind), held["id"].to_numpy(), k)
        r, c = np.nonzero(s.score > NONE)
        return pa.table({"query_id": q_ids[r], "vec_id": s.id[r, c], "score": s.score[r, c]})

    def meet(asked: DataFrame) -> DataFrame:
        parts = asked.groupBy("b").agg(F.ceil(F.sum(F.size("ids")) / QUERY_BLOCK).cast("int").alias("parts"))
        asked = asked.join(parts, "b").withColumn("part", F.pmod(F.xxhash64(F.get("ids", F.lit(0))), F.col("parts")).cast("int"))
        held = data.join(parts, "b").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        return S.fresh(asked).groupBy("b", "part").cogroup(S.fresh(held).groupBy("b", "part")).applyInArrow(search, "query_id long, vec_id long, score long")

    started = S.checkpoint(queries.mapInArrow(home, "id long, v binary, cell int, b long"))
    seed = S.checkpoint(meet(started.mapInArrow(at_home, ASKED)))
    floors = seed.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("at_least"))
    bounded = started.join(floors, started.id == floors.query_id, "left").select("id", "v", "b", F.coalesce("at_least", F.lit(int(NONE))).alias("floor"), "cell")
    near = bounded.repartitionByRange("cell", F.xxhash64("id")).sortWithinPartitions("cell").drop("cell")
    found = seed.union(meet(near.mapInArrow(onward, ASKED)))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
