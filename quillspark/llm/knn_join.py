"""Operator 8: exact top-k search for every vector, as a Voronoi kNN join.

PIVOTS vectors (the square root of their number, at most MAX_PIVOTS), drawn by hash of
the id, divide space in cells. Per cell a summary holds the number of vectors, the
greatest distance to the pivot and the k + 1 smallest ones. Cells are grouped, near ones
together. First each group is searched by itself, which gives every vector a true upper
bound on the distance of its k-th neighbour, and each cell the greatest of them, or what follows
from the summaries, if that is less.
Then a vector is replicated to a group only if for one of its cells neither the distance to its
pivot less the radius, nor the distance to the hyperplane between the two pivots, exceeds
that bound. Groups too large for a task are split in chunks on both sides; chunks are solved
locally, cell by cell, against those vectors that the same bounds leave, by blocked products;
exact distances are computed for all that could be among the k, and partial results merged.

How much is replicated depends on the data: where neighbours are hardly nearer than pivots are
to each other, as among random directions in many dimensions, no bound excludes anything and
every vector goes to every group.

Distances are Euclidean, in double precision, compared after rounding to 6 places; ties
go to the smaller id.

Defined results: rows with a null id, a null vector or one with a null, NaN, infinity or a number
beyond LARGEST in it, or of another dimension than most, are neither queries nor answers; of rows
with one id, the first in the order of their vectors counts; with fewer than k others, all are
returned; a table without usable rows gives none; ids must be integers, else TypeError is raised;
other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ._store import materialise, pick
from ._vec import lean, trim

K = 10
MAX_PIVOTS = 2048
#: Rows of one group, and of one chunk of 64 dimensions (fewer of more).
GROUP_ROWS = 8192
CHUNK_ROWS = 131072
#: Greatest size of a number whose square can be added up.
LARGEST = 1e150
#: Relative error allowed to products of single precision, in squared distances.
_SLACK = 2e-5
#: Distances that differ by less may be rounded to the same.
_ROUNDED = 2e-6


def vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of usable rows, one per id."""
    rows = pick(df, id_col, vec_col).toDF("id", "v")
    if not isinstance(rows.schema["id"].dataType, IntegralType):
        raise TypeError(f"{id_col} must be an integer")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) > LARGEST))
    rows = rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad).withColumn("id", F.col("id").cast("long"))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    rows = rows.filter(F.size("v") == (sizes.d if sizes else 0))
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All Euclidean distances by one product; good to about 1e-7 of the vectors' length."""
    d = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(d, 0))


def cells(v: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest pivot, distance to it)."""
    near, dist = np.zeros(len(v), np.int64), np.zeros(len(v))
    for i in range(0, len(v), 4096):
        d = distances(v[i : i + 4096], pivots)
        near[i : i + 4096] = d.argmin(axis=1)
        dist[i : i + 4096] = d.min(axis=1)
    return near, dist


def bounds(pivots: np.ndarray, count: np.ndarray, radius: np.ndarray, nearest: list[np.ndarray], k: int) -> np.ndarray:
    """For each cell, a distance within which each of its vectors has k others."""
    between = distances(pivots, pivots)
    member = np.concatenate(nearest) if nearest else np.zeros(0)
    of = np.repeat(np.arange(len(nearest)), [len(x) for x in nearest])
    out = np.full(len(pivots), np.inf)
    for i in np.flatnonzero(count):
        upper = radius[i] + between[i, of] + member
        if len(upper) > k:  # one of them may be the vector itself
            out[i] = np.partition(upper, k)[k]
    return out


def grouped(pivots: np.ndarray, count: np.ndarray, limit: int) -> np.ndarray:
    """Group of each cell: cells are halved along their principal axis until a group has at most limit vectors or one cell."""
    out, n, todo = np.zeros(len(pivots), np.int64), 0, [np.arange(len(pivots))]
    while todo:
        part = todo.pop()
        if len(part) == 1 or count[part].sum() <= limit:
            out[part] = n
            n += 1
            continue
        x = pivots[part] - pivots[part].mean(axis=0)
        axis = np.linalg.svd(x, full_matrices=False)[2][0]
        order = part[np.argsort(x @ axis, kind="stable")]
        half = int(np.clip(np.searchsorted(np.cumsum(count[order]), count[order].sum() / 2), 1, len(part) - 1))
        todo += [order[:half], order[half:]]
    return out


def within(v: np.ndarray, own: np.ndarray, pivots: np.ndarray, radius: np.ndarray, bound: np.ndarray, only: np.ndarray) -> np.ndarray:
    """For each vector, of cell own, and each cell of only: may a vector of that cell have it within the cell's bound?"""
    d = distances(v, pivots[only])
    to_own = np.sqrt(((v - pivots[own]) ** 2).sum(axis=1))
    between = distances(pivots, pivots[only])[own]
    scale = 1e-6 * (1 + float(np.abs(v).max(initial=0)) + float(np.abs(pivots).max(initial=0)))
    limit = bound[only] + scale
    ok = d - radius[only] <= limit
    # All of the other cell lies beyond the hyperplane between the pivots.
    plane = np.divide(d * d - (to_own * to_own)[:, None], 2 * between, out=np.zeros_like(d), where=between > scale)
    return ok & ((plane <= limit) | (only == own[:, None]))


def squares(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vectors for products, their squared lengths): in single precision, unless numbers are too large."""
    if np.abs(x).max(initial=0) < 1e15:
        x = x.astype(np.float32)
    return x, (x * x).sum(axis=1)


def kth_within(v: np.ndarray, k: int) -> np.ndarray:
    """For each vector, a bound on the distance of its k-th neighbour among the others, and of what is rounded to the same; infinite if there aren't so many."""
    if len(v) <= k:
        return np.full(len(v), np.inf)
    x, xx = squares(v)
    out = np.empty(len(v))
    slack = 2 * _SLACK * float(xx.max(initial=0))
    for i in range(0, len(v), 512):
        d = xx[i : i + 512, None] + xx[None, :] - 2 * (x[i : i + 512] @ x.T)
        out[i : i + 512] = np.partition(d, k, axis=1)[:, k]  # one of them is the vector itself
    return np.sqrt(np.maximum(out, 0) + slack) + _ROUNDED


def local_topk(r_ids: np.ndarray, r: np.ndarray, reach: np.ndarray, s_ids: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, neighbour id, rounded distance) of the k best of s for each of r, of those within its reach."""
    q, n, d = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    (x, xx), (y, yy) = squares(r), squares(s)
    slack = _SLACK * (float(xx.max(initial=0)) + float(yy.max(initial=0)))
    for i in range(0, len(r), 512):
        part, ids, limit = x[i : i + 512], r_ids[i : i + 512], reach[i : i + 512] ** 2
        rows, cols, dist = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for j in range(0, len(s), 8192):
            near = (xx[i : i + 512] - (limit + slack).astype(xx.dtype))[:, None] + yy[None, j : j + 8192] - 2 * (part @ y[j : j + 8192].T)
            row, col = np.nonzero(near <= slack)
            col += j
            other = ids[row] != s_ids[col]
            row, col = row[other], col[other]
            rows, cols = np.concatenate([rows, row]), np.concatenate([cols, col])
            exact = np.concatenate([np.round(np.sqrt(((r[i + row[m : m + 65536]] - s[col[m : m + 65536]]) ** 2).sum(axis=1)), 6) for m in range(0, len(row), 65536)] or [np.zeros(0)])
            dist = np.concatenate([dist, exact])
            order = np.lexsort((s_ids[cols], dist, rows))
            rows, cols, dist = rows[order], cols[order], dist[order]
            top = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
            rows, cols, dist = rows[top], cols[top], dist[top]
            full = np.flatnonzero(np.arange(len(rows)) - np.searchsorted(rows, rows) == k - 1)  # what is farther than the k best so far is out
            limit[rows[full]] = np.minimum(limit[rows[full]], (dist[full] + _ROUNDED) ** 2)
        q.append(ids[rows])
        n.append(s_ids[cols])
        d.append(dist)
    return np.concatenate(q), np.concatenate(n), np.concatenate(d)


def replicas(df: DataFrame, k: int, id_col: str, vec_col: str, group_rows: int, chunk_rows: int) -> tuple[DataFrame, object]:
    """(rows (g, rc, sc, side, id, v, cell, reach): side 0 are queries, side 1 what is sent to their group; the broadcast plan)."""
    spark = df.sparkSession
    rows = materialise(vectors(df, id_col, vec_col), "vectors")
    n, kind = rows.count(), dict(rows.dtypes)["v"]
    n_pivots = min(MAX_PIVOTS, int(n**0.5) + 1)
    drawn = rows.orderBy(F.xxhash64(F.lit(8), "id"), "id").limit(n_pivots).select("v").collect()
    pivots = np.unique(np.array([r.v for r in drawn], np.float64), axis=0) if drawn else np.zeros((0, 1))
    chunk_rows = max(1, chunk_rows * 64 // max(64, pivots.shape[1]))
    shared = spark.sparkContext.broadcast(pivots)

    def summarise(batches):
        count: dict[int, int] = {}
        near: dict[int, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            cell, dist = cells(matrix(b.column(1)), shared.value)
            for c in np.unique(cell).tolist():
                x = dist[cell == c]
                count[c] = count.get(c, 0) + len(x)
                near[c] = np.sort(np.append(near.get(c, np.zeros(0)), x))[: k + 1]
        if count:
            c = list(count)
            yield pa.record_batch({"cell": pa.array(c, pa.int64()), "n": pa.array([count[x] for x in c], pa.int64()), "near": pa.array([near[x].tolist() for x in c], pa.list_(pa.float64()))})

    parts = rows.mapInArrow(lean(summarise), "cell long, n long, near array<double>")
    parts = parts.groupBy("cell").agg(F.sum("n").alias("n"), F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k + 1).alias("near")).collect()
    count, nearest = np.zeros(len(pivots), np.int64), [np.zeros(0)] * len(pivots)
    for p in parts:
        count[p.cell], nearest[p.cell] = p.n, np.array(p.near)
    group = grouped(pivots, count, group_rows) if len(pivots) else np.zeros(0, np.int64)
    n_groups = int(group.max()) + 1 if len(group) else 0
    queries = np.bincount(group, weights=count, minlength=n_groups) if n_groups else np.zeros(0)
    r_chunks = np.ceil(np.maximum(queries, 1) / group_rows).astype(int)
    first = spark.sparkContext.broadcast((group, r_chunks))

    def assign(batches):
        group, r_chunks = first.value
        for b in batches:
            if b.num_rows:
                cell, dist = cells(matrix(b.column(1)), shared.value)
                g = group[cell]
                yield pa.record_batch({"g": pa.array(g, pa.int32()), "rc": pa.array(np.asarray(b.column(0)) % r_chunks[g], pa.int32()), "id": b.column(0), "v": b.column(1), "cell": pa.array(cell), "dist": pa.array(dist)})

    def reach(table: pa.Table) -> pa.Table:
        found = pa.array(kth_within(matrix(table.column("v")), k))
        return table.select(["g", "rc", "id", "v", "cell", "dist"]).append_column("reach", found)

    schema = f"g int, rc int, id long, v {kind}, cell long, dist double"
    held = rows.mapInArrow(lean(assign), schema).groupBy("g", "rc").applyInArrow(reach, schema + ", reach double")
    held = materialise(held, "reach")
    radius, bound = np.zeros(len(pivots)), np.full(len(pivots), np.inf)
    for p in held.groupBy("cell").agg(F.max("dist").alias("radius"), F.max("reach").alias("reach")).collect():
        radius[p.cell], bound[p.cell] = p.radius, p.reach
    bound = np.minimum(bound, bounds(pivots, count, radius, nearest, k) + _ROUNDED) if len(pivots) else bound
    live = np.flatnonzero(count)
    plan = spark.sparkContext.broadcast((group, r_chunks, radius, bound, live))

    def received(batches):
        group, _, radius, bound, live = plan.value
        total = np.zeros(n_groups, np.int64)
        for b in batches:
            if b.num_rows:
                total += _sent(matrix(b.column(0)), np.asarray(b.column(1)), shared.value, group, radius, bound, live, n_groups).sum(axis=0)
        if total.any():
            yield pa.record_batch({"g": pa.array(np.arange(n_groups), pa.int32()), "n": pa.array(total)})

    got = np.zeros(n_groups, np.int64)
    for p in held.select("v", "cell").mapInArrow(lean(received), "g int, n long").groupBy("g").agg(F.sum("n").alias("n")).collect():
        got[p.g] = p.n
    s_chunks = spark.sparkContext.broadcast(np.ceil(np.maximum(got, 1) / chunk_rows).astype(int))

    def replicate(batches):
        group, r_chunks, radius, bound, live = plan.value
        for b in batches:
            if not b.num_rows:
                continue
            ids, cell = np.asarray(b.column(2)), np.asarray(b.column(4))
            sent = _sent(matrix(b.column(3)), cell, shared.value, group, radius, bound, live, n_groups)
            out = []
            for g in range(n_groups):
                nr, ns = int(r_chunks[g]), int(s_chunks.value[g])
                mine = np.flatnonzero(group[cell] == g)
                out += [(mine, g, ids[mine] % nr, np.full(len(mine), sc), 0) for sc in range(ns)]
                near = np.flatnonzero(sent[:, g])
                out += [(near, g, np.full(len(near), rc), ids[near] // nr % ns, 1) for rc in range(nr)]
            for at, g, rc, sc, side in out:
                if len(at):
                    take = pa.array(at)
                    yield pa.record_batch({"g": pa.array(np.full(len(at), g), pa.int32()), "rc": pa.array(rc, pa.int32()), "sc": pa.array(sc, pa.int32()), "side": pa.array(np.full(len(at), side), pa.int8()), "id": b.column(2).take(take), "v": b.column(3).take(take), "cell": b.column(4).take(take), "reach": b.column(6).take(take)})

    return held.select("g", "rc", "id", "v", "cell", "dist", "reach").mapInArrow(lean(replicate), f"g int, rc int, sc int, side byte, id long, v {kind}, cell long, reach double"), (shared, plan)


def _sent(v, own, pivots, group, radius, bound, live, n_groups: int) -> np.ndarray:
    """Which groups each vector is sent to."""
    out = np.zeros((len(v), n_groups), bool)
    order = live[np.argsort(group[live], kind="stable")]
    heads = np.flatnonzero(np.append(True, group[order][1:] != group[order][:-1]))
    for i in range(0, len(v), 4096):
        out[i : i + 4096, group[order][heads]] = np.logical_or.reduceat(within(v[i : i + 4096], own[i : i + 4096], pivots, radius, bound, order), heads, axis=1)
    return out


def knn_join(df: DataFrame, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", group_rows: int = GROUP_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(id_col, rank, neighbor_id, distance): the k nearest others of every vector, ranks from 1."""
    sent, (shared, plan) = replicas(df, k, id_col, vec_col, group_rows, chunk_rows)

    def solve(table: pa.Table) -> pa.Table:
        _, _, radius, bound, _ = plan.value
        side, ids, cell, reach = (np.asarray(table.column(c).combine_chunks()) for c in ("side", "id", "cell", "reach"))
        v = matrix(table.column("v"))
        r, s = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        r = r[np.argsort(cell[r], kind="stable")]
        for mine in np.split(r, np.flatnonzero(np.diff(cell[r])) + 1) if len(r) and len(s) else []:
            c = cell[mine[0]]
            limit = np.minimum(reach[mine], bound[c])
            most = np.array(bound)
            most[c] = limit.max()
            near = s[within(v[s], cell[s], shared.value, radius, most, np.array([c]))[:, 0]]
            out.append(local_topk(ids[mine], v[mine], limit, ids[near], v[near], k))
        q = [np.concatenate(x) for x in zip(*out)]
        del v, out
        trim()
        return pa.table({"id": pa.array(q[0], pa.int64()), "neighbor_id": pa.array(q[1], pa.int64()), "distance": pa.array(q[2], pa.float64())})

    part = sent.groupBy("g", "rc", "sc").applyInArrow(solve, "id long, neighbor_id long, distance double")
    ranked = part.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("distance", "neighbor_id")))
    return ranked.filter(F.col("rank") <= k).select(F.col("id").alias(id_col), "rank", "neighbor_id", "distance")


ORACLE = f"""
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
d AS (SELECT a.vec_id, b.vec_id AS neighbor_id, round(list_distance(a.v, b.v), 6) AS distance FROM e a JOIN e b ON a.vec_id <> b.vec_id),
r AS (SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbor_id)::INTEGER AS rank, neighbor_id, distance FROM d)
SELECT vec_id, rank, neighbor_id, distance FROM r WHERE rank <= {K}
"""
