"""Approximate nearest neighbours on shifted Hilbert curves.

Vectors are projected on ``dims`` random directions, each squeezed to (0, 1)
by a sigmoid (nothing is cut off), shifted and laid on a grid of 2^16 steps;
the position on the Hilbert curve through that grid orders them, so a cluster
far smaller than a cell of the coarse grid is still ordered by place, on each
curve by other directions.  Each of ``curves`` orderings (own directions and
shift) is cut at splitters into blocks of equal size, a group of Spark rows per
(curve, block).  A query is sent to its block and the blocks within ``share`` of
the curve to either side; there its distances to all members are computed on
the original vectors in double precision, and the best of all curves are merged.
A group holds at most about BLOCK_ROWS members and QUERY_ROWS queries: with
more queries a block is a group several times, each for a share of them.

Vectors with little structure (isotropic noise in 64 dimensions) need a wide
window for a recall of 0.9, so the window is a share of the curve, not a
number of rows: the work is queries x rows x about 2 * share * curves at
every size.

Equal vectors are one class that keeps its k + 1 smallest ids, which is all
that any answer needs; so a vector that a third of all rows repeat is indexed
once.  Splitters come from a sample of at most SAMPLE classes; every class is
indexed.

Defined cases: rows with a NULL id or a NULL, zero or empty vector, or with
NULL or non-finite components take no part, nor do vectors whose length is
not the most frequent one (of two, the longer); a repeated (id, vector) row
counts once, an id with two vectors is two rows and only its own class entry
of that id is left out of its answers; ties go to the smaller id; fewer
candidates than k give fewer rows; empty tables give an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from grainline.llm.hilbert import hilbert_bytes
from grainline.session import materialize

CURVES, DIMS, BITS, SHARE = 16, 16, 16, 0.03
SAMPLE = 50_000
BLOCK_ROWS, QUERY_ROWS = 65_536, 16_384
#: Room for the shift of a curve's grid, as a share of it.
ROOM = 0.125


@dataclass
class Curves:
    centre: np.ndarray
    directions: np.ndarray   # curves x length x dims
    shifts: np.ndarray       # curves x dims
    spread: np.ndarray       # curves x dims
    splitters: list
    reach: int
    parts: int = 1           # groups of a block, each with a share of the queries

    def keys(self, x: np.ndarray, names: list[str], c: int, bits: int = BITS) -> np.ndarray:
        """Sortable bytes: the curve position, then the class name (which
        orders vectors that no grid step tells apart)."""
        y = ((x - self.centre) @ self.directions[c]) / self.spread[c]
        u = 1 / (1 + np.exp(-np.clip(1.7 * y, -30, 30)))
        grid = np.clip((u + ROOM + self.shifts[c]) / (1 + 2 * ROOM) * (1 << bits), 0, (1 << bits) - 1)
        at = hilbert_bytes(grid.astype(np.int64), bits)
        tie = np.frombuffer(bytes.fromhex("".join(names)), np.uint8).reshape(len(names), -1)
        both = np.ascontiguousarray(np.concatenate([at, tie], axis=1))
        return both.view(f"S{both.shape[1]}").ravel()


def _classes_of(k: int):
    def run(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        found: dict[bytes, list[int]] = {}
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            col = batch.column(1)
            x = np.asarray(col.flatten(), np.float64)
            size = np.asarray(col.value_lengths())
            at = np.concatenate([[0], np.cumsum(size)])
            for i, v in enumerate(ids.tolist()):
                key = x[at[i]:at[i + 1]].tobytes()
                have = found.setdefault(key, [])
                if v not in have:
                    have.append(v)
                    if len(have) > 4 * (k + 1):
                        have.sort()
                        del have[k + 1:]
        rows = [(hashlib.md5(b).hexdigest(), b, sorted(v)[:k + 1]) for b, v in found.items()]
        for lo in range(0, len(rows), 5000):
            part = rows[lo:lo + 5000]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.string()), pa.array([r[1] for r in part], pa.binary()),
                                              pa.array([r[2] for r in part], pa.list_(pa.int64()))], ["class", "vec", "ids"])
    return run


def _moments(batches: Iterator) -> Iterator:
    import pyarrow as pa

    n, s, q = 0, 0.0, 0.0
    for batch in batches:
        if batch.num_rows:
            x = np.stack([np.frombuffer(b, np.float64) for b in batch.column(0).to_pylist()])
            n, s, q = n + len(x), s + x.sum(0), q + (x * x).sum(0)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(s))), pa.array(s), pa.array(q), pa.array(np.full(len(s), n))], ["d", "s", "q", "n"])


def fit_curves(classes: DataFrame, n_queries: int = 0, curves: int = CURVES, dims: int = DIMS, share: float = SHARE, seed: int = 17) -> Curves | None:
    m = (classes.select("vec").mapInArrow(_moments, "d long, s double, q double, n long")
         .groupBy("d").agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("n").alias("n")).orderBy("d").toPandas())
    if not len(m):
        return None
    n = int(m["n"].iloc[0])
    centre = (m["s"] / m["n"]).to_numpy()
    var = np.maximum((m["q"] / m["n"]).to_numpy() - centre ** 2, 0)
    rng = np.random.default_rng(seed)
    length = len(centre)
    use = min(dims, length)
    directions = np.stack([np.linalg.qr(rng.normal(size=(length, length)))[0][:, :use] for _ in range(curves)])
    shifts = (2 * rng.random((curves, use)) - 1) * ROOM
    spread = np.sqrt(np.einsum("cij,i->cj", directions ** 2, var)) + 1e-12
    out = Curves(centre, directions, shifts, spread, [], 1)
    blocks = max(1, min(100, n // 64), -(-n // BLOCK_ROWS))
    out.reach = max(1, int(np.ceil(share * blocks)))
    out.parts = -(-n_queries * min(2 * out.reach + 1, blocks) // blocks // QUERY_ROWS) or 1
    sample = classes.select("vec", "class").orderBy("class").limit(SAMPLE).toPandas()
    x = np.stack([np.frombuffer(b, np.float64) for b in sample["vec"]])
    names = sample["class"].tolist()
    for c in range(curves):
        keys = np.sort(out.keys(x, names, c))
        out.splitters.append(keys[(np.arange(1, blocks) * len(keys)) // blocks])
    return out


def _dealt(shared):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        cv = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([np.frombuffer(b, np.float64) for b in batch.column(1).to_pylist()])
            names = batch.column(0).to_pylist()
            asked = np.flatnonzero(batch.column(3).to_numpy(zero_copy_only=False))
            mine = np.array([int(names[i][:8], 16) % cv.parts for i in asked], np.int64)
            rows = np.arange(len(x))
            for c in range(len(cv.splitters)):
                block = np.searchsorted(cv.splitters[c], cv.keys(x, names, c), "right")
                last = len(cv.splitters[c])
                # members go to every part of their block, a query to its own
                take, at = [rows] * cv.parts, [block] * cv.parts
                part, query = [np.full(len(rows), p) for p in range(cv.parts)], [np.zeros(len(rows), bool)] * cv.parts
                for step in range(-cv.reach, cv.reach + 1):
                    to = block[asked] + step
                    ok = (to >= 0) & (to <= last)
                    take.append(asked[ok])
                    at.append(to[ok])
                    part.append(mine[ok])
                    query.append(np.ones(int(ok.sum()), bool))
                part = np.concatenate(part)
                take, at, query = np.concatenate(take), np.concatenate(at), np.concatenate(query)
                for lo in range(0, len(take), 4000):
                    t = pa.array(take[lo:lo + 4000])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(t), c, np.int32)), pa.array(at[lo:lo + 4000].astype(np.int32)), pa.array(part[lo:lo + 4000].astype(np.int32)),
                         pa.array(query[lo:lo + 4000]),
                         batch.column(0).take(t), batch.column(1).take(t), batch.column(2).take(t)],
                        ["curve", "block", "part", "query", "class", "vec", "ids"])
    return run


def _search(k: int):
    def run(pdf):
        import pandas as pd

        q, m = pdf[pdf["query"]], pdf[~pdf["query"]]
        out = {"class": [], "vec_id": [], "score": []}
        if len(q) and len(m):
            x = np.stack([np.frombuffer(b, np.float64) for b in m["vec"]])
            ids = m["ids"].to_list()
            low = np.array([i[0] for i in ids])
            xx = (x * x).sum(1)
            qv = np.stack([np.frombuffer(b, np.float64) for b in q["vec"]])
            step = max(1, 4_000_000 // len(x))
            for lo in range(0, len(q), step):
                part = qv[lo:lo + step]
                d = xx[None] - 2 * part @ x.T
                take = min(len(x), 2 * (k + 1))
                near = np.argpartition(d, take - 1, axis=1)[:, :take] if take < len(x) else np.tile(np.arange(len(x)), (len(part), 1))
                for i in range(len(part)):
                    cand = near[i]
                    worst = d[i][cand].max()
                    cand = np.flatnonzero(d[i] <= worst + 1e-9 * (1 + abs(worst)))  # all that tie with the last
                    exact = np.sqrt(((x[cand] - part[i]) ** 2).sum(1))
                    order = np.lexsort((low[cand], exact))[:k + 1]
                    best = sorted((float(exact[o]), v) for o in order for v in ids[cand[o]])[:k + 1]
                    out["class"] += [q["class"].iloc[lo + i]] * len(best)
                    out["vec_id"] += [int(v) for _, v in best]
                    out["score"] += [s for s, _ in best]
        return pd.DataFrame(out).astype({"class": object, "vec_id": "int64", "score": "float64"})
    return run


def nearest(vectors: DataFrame, queries: str, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", **fit) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for every row
    for which the SQL condition ``queries`` (on ``vec_id``) holds."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec")).filter(
        "vec_id is not null and vec is not null and forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"
        " and exists(vec, x -> x <> 0)")
    sizes = v.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    v = v.filter(F.size("vec") == (sizes["n"] if sizes else 0))
    classes = (v.mapInArrow(_classes_of(k), "class string, vec binary, ids array<long>")
               .groupBy("class").agg(F.first("vec").alias("vec"), F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids")))
    asked = (v.filter(queries).mapInArrow(_named, "query_id long, class string").distinct())
    asked = materialize(asked, "ann-queries")
    classes = materialize(classes.join(asked.select("class").distinct().withColumn("asked", F.lit(True)), "class", "left")
                          .select("class", "vec", "ids", F.coalesce("asked", F.lit(False)).alias("asked")), "ann-classes")
    curves = fit_curves(classes, classes.filter("asked").count(), **fit)
    shared = vectors.sparkSession.sparkContext.broadcast(curves)
    if curves is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = (classes.mapInArrow(_dealt(shared), "curve int, block int, part int, query boolean, class string, vec binary, ids array<long>")
             .groupBy("curve", "block", "part").applyInPandas(_search(k), "class string, vec_id long, score double"))
    best = found.groupBy("class", "vec_id").agg(F.min("score").alias("score"))
    best = best.withColumn("r", F.row_number().over(W.partitionBy("class").orderBy("score", "vec_id"))).filter(F.col("r") <= k + 1)
    rows = asked.join(best.drop("r"), "class").filter("query_id <> vec_id")
    rank = F.row_number().over(W.partitionBy("query_id", "class").orderBy("score", "vec_id"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _named(batches: Iterator) -> Iterator:
    import hashlib

    import pyarrow as pa

    for batch in batches:
        col = batch.column(1)
        x = np.asarray(col.flatten(), np.float64)
        at = np.concatenate([[0], np.cumsum(np.asarray(col.value_lengths()))])
        names = [hashlib.md5(x[at[i]:at[i + 1]].tobytes()).hexdigest() for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string())], ["query_id", "class"])
