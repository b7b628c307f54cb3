"""Near-duplicate vectors by an inverted multi-index with a multi-sequence traversal."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keratoline.llm import _hashing as H
from keratoline.llm import _spark as S
from keratoline.llm import _vectors as V
from keratoline.llm.ngram_join import _forest

SAMPLE = 8_192  # rows on which the codebooks are fitted and the traversal is calibrated
CELL_ROWS, BLOCK_ROWS = 800, 3_200  # rows of a cell, and of the cells that travel together, aimed at
MOST_WORDS = 2_048  # of a codebook: beyond some 3 billion rows cells grow, and are met in chunks
CHUNK = 4_096
RECALL = 0.999


def codebook(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's centroids from evenly spaced rows of x, in the order of their main axis, so that words near in number are near."""
    words = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = distances(x, words).argmin(1)
        count = np.bincount(near, minlength=k)
        for j in np.flatnonzero(count):
            words[j] = x[near == j].mean(0)
    axis = np.linalg.svd(words - words.mean(0), full_matrices=False)[2][0]
    return words[np.argsort(words @ axis, kind="stable")]


def distances(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] + (words**2).sum(1) - 2 * x @ words.T, 0)


class Index:
    """Two codebooks, one a half; a cell is a pair of their words. visit: cells that each vector looks into at most."""

    def __init__(self, first: np.ndarray, second: np.ndarray, visit: int, far: float):
        self.first, self.second, self.visit, self.far = first, second, visit, far
        self.half, self.k = first.shape[1], len(second)
        # The traversal meets (p, q) after all (p', q') below it, so the first `visit` cells are among these.
        p = np.arange(min(visit, len(first)))
        many = np.minimum(visit // (p + 1), self.k)
        self.p, self.q = np.repeat(p, many), H.counting(many)
        self.wide = max(1, round((BLOCK_ROWS / CELL_ROWS) ** 0.5))

    def block(self, cell: np.ndarray) -> np.ndarray:
        """Cells of neighbouring words make a block."""
        return cell // self.k // self.wide * (-(-self.k // self.wide)) + cell % self.k // self.wide

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return distances(x[:, : self.half], self.first), distances(x[:, self.half :], self.second)

    def _rims(self, d: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Squared distance that a vector has at least from any point of each word's region."""
        near = d.argmin(1)
        gap = np.sqrt(np.maximum(distances(words, words), 1e-30))[near]
        lead = (d - d[np.arange(len(d)), near][:, None]) / (2 * gap)
        lead[np.arange(len(d)), near] = 0
        return np.maximum(lead, 0) ** 2

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(home, visited) of each row: its cell, and the nearest cells in order, its own first.

        Cells that lie wholly beyond the distance of the threshold are left out (-1).
        """
        home, out = np.empty(len(x), np.int64), np.empty((len(x), min(self.visit, len(self.p))), np.int64)
        for s in range(0, len(x), 512):
            d1, d2 = self.halves(x[s : s + 512])
            far = self._rims(d1, self.first), self._rims(d2, self.second)
            o1, o2 = np.argsort(d1, 1, kind="stable"), np.argsort(d2, 1, kind="stable")
            row = np.arange(len(d1))[:, None]
            total = d1[row, o1[:, self.p]] + d2[row, o2[:, self.q]]
            pick = np.argsort(total, 1, kind="stable")[:, : self.visit]
            w1, w2 = o1[row, self.p[pick]], o2[row, self.q[pick]]
            out[s : s + 512] = np.where(far[0][row, w1] + far[1][row, w2] <= self.far, w1 * self.k + w2, -1)
            home[s : s + 512] = o1[:, 0] * self.k + o2[:, 0]
        return home, out

    def rank(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """How many cells the traversal from each row of x meets before its `cell`, counted without visiting them."""
        d1, d2 = self.halves(x)
        row = np.arange(len(x))
        goal = d1[row, cell // self.k] + d2[row, cell % self.k]
        d2 = np.sort(d2, 1)
        return np.array([np.searchsorted(d2[i], goal[i] - d1[i] - 1e-12, "left").sum() for i in row])


def build_index(sample: np.ndarray, n: int, threshold: float) -> Index:
    """Codebooks for n rows, and as many cells to visit as find RECALL of pairs.

    The last third of the sample has no part in the codebooks. The pairs are
    those of its vectors above the threshold, and for each of them one at
    exactly the threshold in a random direction, the hardest case.
    """
    half = sample.shape[1] // 2
    fitted = sample[: len(sample) - len(sample) // 3]
    k = int(min(MOST_WORDS, max(1, len(fitted) // 4), max(2, round((n / CELL_ROWS) ** 0.5))))
    words = codebook(fitted[:, :half], k), codebook(fitted[:, half:], k)
    index = Index(*words, 1, np.inf)
    rng = np.random.default_rng(1)
    some = (sample[len(fitted) :] if len(sample) > 2 else sample)[:1024]
    turn = rng.standard_normal(some.shape)
    turn -= (turn * some).sum(1)[:, None] * some
    turn /= np.maximum(np.linalg.norm(turn, axis=1), 1e-12)[:, None]
    a, b = [some], [threshold * some + np.sqrt(1 - threshold**2) * turn]
    near = some @ sample.T
    i, j = np.nonzero((near >= threshold) & (near < 1 - 1e-12))
    if len(i):
        pick = rng.permutation(len(i))[:512]
        a.append(some[i[pick]])
        b.append(sample[j[pick]])
    a, b = np.concatenate(a), np.concatenate(b)
    rank = np.minimum(index.rank(a, index.cells(b)[0]), index.rank(b, index.cells(a)[0]))
    visit = int(np.quantile(rank, RECALL, method="higher")) + 1
    return Index(*words, min(visit, k * k), 2 - 2 * threshold + 1e-9)


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """Links all pairs found with a cosine (in double precision) at or above the threshold, and none below it.

    Returns vec_id, n_links (other rows linked directly), component_id (the
    smallest id reachable by links, itself included) and kept (vec_id =
    component_id). Null, empty and zero vectors, vectors with null or
    non-finite components, and rows without an id link with nothing. Shorter
    vectors count as padded with zeros. Rows that share an id are one vector
    (not linked to itself), each of which counts for others and has its own
    links. Other columns are not read; an empty table gives an empty one.

    Every row is in the index; rows with the same vector are one entry, so a
    vector that a third of all rows have is compared once. A pair is found when
    either visits the other's cell. A vector travels once for each block of
    cells that it visits; large blocks are met in chunks, by chunks of their
    visitors, so no task holds a whole one. The links in a cell of m like but
    different vectors take m * m / 2 products.
    """
    kind = "<f4" if vectors.schema[vector].dataType == T.ArrayType(T.FloatType(), vectors.schema[vector].dataType.containsNull) else "<f8"
    usable = F.col(vec_id).isNotNull() & V.usable(vector)
    every = S.checkpoint(vectors.select(F.col(vec_id).cast("long").alias("id"), F.when(usable, F.col(vector)).alias("v")))
    valid = F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    good = every.where(valid)
    apart = every.where(~valid).select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    n, dims = good.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return apart
    dims += dims % 2

    def pack(batches):
        for batch in batches:
            x = V.block(batch.column(1), dims).astype(kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "v"])

    def unit(column) -> np.ndarray:
        x = np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dims).astype(np.float64)
        x /= np.abs(x).max(1)[:, None]
        return x / np.sqrt((x**2).sum(1))[:, None]

    packed = S.checkpoint(good.mapInArrow(pack, "id long, v binary").withColumns({"k1": F.xxhash64("v"), "k2": F.xxhash64(F.lit(7), "v")}))
    again = packed.groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1")
    if again.limit(1).count():
        packed = packed.join(again, "id", "left").withColumn("rid", F.when(F.col("rows").isNotNull(), F.col("id"))).drop("rows")
    else:
        packed = packed.withColumn("rid", F.lit(None).cast("long"))
    nodes = packed.groupBy("k1", "k2", "rid").agg(F.min("id").alias("id"), F.count("*").alias("size"), F.any_value("v").alias("v"))
    node = F.xxhash64("k1", "k2", "rid").alias("node")  # tells the vectors of one id apart
    sample = packed.orderBy(F.xxhash64("id", F.lit(5)), "id", "k1").limit(SAMPLE).select("v").toArrow()
    index = build_index(unit(sample["v"]), n, threshold)

    def assign(batches):
        for batch in batches:
            home, seen = index.cells(unit(batch.column(5)))
            visits = []
            for s in seen:
                s = s[s >= 0]
                block = index.block(s)
                order = np.argsort(block, kind="stable")
                s, block = s[order].astype("<i4"), block[order]
                cut = np.flatnonzero(np.diff(block)) + 1
                visits.append([{"block": int(block[a]), "cells": s[a:b].tobytes()} for a, b in zip([0, *cut], [*cut, len(s)], strict=True)])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(home.astype(np.int32)), pa.array(index.block(home)), pa.array([s[s >= 0].astype("<i4").tobytes() for s in seen], pa.binary()), pa.array(visits, pa.list_(pa.struct([("block", pa.int64()), ("cells", pa.binary())])))],
                names=["k1", "k2", "rid", "id", "size", "v", "home", "block", "seen", "visits"],
            )

    placed = S.checkpoint(nodes.mapInArrow(assign, "k1 long, k2 long, rid long, id long, size long, v binary, home int, block long, seen binary, visits array<struct<block: long, cells: binary>>"))
    members = placed.groupBy("block").agg(F.count("*").alias("m"))
    visits = placed.select(node, "id", "size", "v", "home", F.inline("visits"))
    visitors = visits.groupBy("block").agg(F.count("*").alias("m2"))
    sizes = S.checkpoint(members.join(visitors, "block").select("block", F.ceil(F.col("m") / CHUNK).cast("int").alias("n1"), F.ceil(F.col("m2") / CHUNK).cast("int").alias("n2")))
    chunk = lambda n, salt: F.pmod(F.xxhash64("id", "home", F.lit(salt)), F.col(n)).cast("int")
    held = placed.join(sizes, "block").select("block", chunk("n1", 1).alias("a"), F.explode(F.sequence(F.lit(0), F.col("n2") - 1)).alias("b"), node, "id", "size", "v", "home", "seen")
    asking = visits.join(sizes, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("n1") - 1)).alias("a"), chunk("n2", 3).alias("b"), "node", "id", "size", "v", "home", "cells")

    def compare(key: tuple, x: pa.Table, y: pa.Table) -> pa.Table:
        out = {"node": [], "id": [], "links": [], "root": []}
        if len(x) and len(y):
            vx, vy = unit(x["v"]), unit(y["v"])
            ix, iy, hx, hy = (t[c].to_numpy() for t, c in ((x, "id"), (y, "id"), (x, "home"), (y, "home")))
            sx, sy = x["size"].to_numpy(), y["size"].to_numpy()
            asked = [np.frombuffer(c, "<i4") for c in x["cells"].to_pylist()]
            who, cell = np.repeat(np.arange(len(ix)), [len(c) for c in asked]), np.concatenate(asked)
            order = np.argsort(cell, kind="stable")
            who, cell = who[order], cell[order]
            lists = [np.frombuffer(c, "<i4") for c in y["seen"].to_pylist()]
            seen = np.full((len(lists), max(map(len, lists))), -1, np.int32)
            for i, s in enumerate(lists):
                seen[i, : len(s)] = s
            nx, ny = np.zeros(len(ix), np.int64), np.zeros(len(iy), np.int64)
            names, at = np.unique(np.concatenate([ix, iy]), return_inverse=True)
            root = np.arange(len(names))
            for c in np.unique(hy):
                rows, cols = who[np.searchsorted(cell, c, "left") : np.searchsorted(cell, c, "right")], np.flatnonzero(hy == c)
                for s in range(0, len(rows), 256):
                    i, j = np.nonzero(vx[rows[s : s + 256]] @ vy[cols].T >= threshold)
                    i, j = rows[s + i], cols[j]
                    other = ix[i] != iy[j]
                    i, j = i[other], j[other]
                    np.add.at(nx, i, sy[j])
                    for t in range(0, len(i), 1 << 16):
                        ti, tj = i[t : t + (1 << 16)], j[t : t + (1 << 16)]
                        back = (seen[tj] == hx[ti, None]).any(1)  # the member finds the visitor itself
                        np.add.at(ny, tj[~back], sx[ti[~back]])
                    new = root[at[i]] != root[at[len(ix) + j]]
                    if new.any():
                        root = _forest(np.concatenate([root, at[i[new]]]), np.concatenate([np.arange(len(root)), at[len(ix) + j[new]]]), len(names))
            for t, ids, count, places in ((x, ix, nx, at[: len(ix)]), (y, iy, ny, at[len(ix) :])):
                some = np.flatnonzero((count > 0) | (root[places] != places))
                out["node"].append(t["node"].to_numpy()[some])
                out["id"].append(ids[some])
                out["links"].append(count[some])
                out["root"].append(names[root[places[some]]])
        return pa.table({k: np.concatenate(v) if v else np.empty(0, np.int64) for k, v in out.items()})

    asking, held = S.fresh(asking), S.fresh(held)
    linked = S.checkpoint(asking.groupBy("block", "a", "b").cogroup(held.groupBy("block", "a", "b")).applyInArrow(compare, "node long, id long, links long, root long"))
    groups = S.connected_components(linked.select(F.col("id").alias("a"), F.col("root").alias("b")))
    counts = linked.groupBy("node").agg(F.sum("links").alias("links"))
    told = placed.select(node, "k1", "k2", F.col("rid").alias("own"), "id", "size").join(counts, "node", "left").join(groups, F.col("id") == groups.v, "left")
    told = told.select("k1", "k2", "own", "size", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "id").alias("component_id"))
    rows = packed.select("id", "rid", "k1", "k2").join(told, ["k1", "k2"]).where(F.col("rid").eqNullSafe(F.col("own")))
    # Rows of one vector are links of each other, but not where they share their id.
    n_links = F.when(F.col("rid").isNull(), F.col("size") - 1 + F.col("links")).otherwise(F.col("links"))
    return rows.select(F.col("id").alias("vec_id"), n_links.cast("long").alias("n_links"), "component_id", (F.col("id") == F.col("component_id")).alias("kept")).unionByName(apart)
