"""Exact top-k search by inner product, with pivot-table elimination.

Components become integers floor(1024 * x). Vectors are lifted onto a sphere by one more component, so that a larger
inner product with a query is a smaller distance to it. Each vector's distances to many pivots are computed once and
written beside it: the pivot table. By the triangle inequality, the largest difference between a candidate's and the
query's distances to a pivot bounds their distance from below.

Candidates are dealt into blocks: by nearest pivot, then by shells of distance to it. A block's least and greatest
distances to each pivot bound the scores of all its candidates at once. Each query first searches the block of its best
bound, which gives it a k-th score, and then only those blocks whose bounds can beat that. In a block, a query evaluates
candidates in the order of their own bounds, and stops when the next bound can't beat its k-th score. Scores are exact
integers; bounds in floating point are loosened by more than their error.

Edge cases: vectors that are null, or hold a null or a component that isn't finite, and rows without an id, take no part;
shorter vectors count as filled up with zeros; integers beyond the range of a long are set to its ends, components
before and scores after the products; equal scores go to the smaller id; repeated rows are candidates of their own, and
only the query's own row is left out; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import Scratch, lean

K = 10
STRIDE = 100
SCALE = 1024
PIVOTS = 48
#: Rows of a block of candidates, and of queries that meet it at once. Blocks bound what a task holds; there are at most
#: about MOST_BLOCKS of them, as their bounds are sent to all workers.
CANDIDATES, QUERIES, MOST_BLOCKS = 1 << 13, 1 << 11, 1 << 16
#: Shells around a pivot have so many rows, if a block has more.
SHELL = 1 << 10
#: Candidates that are evaluated between two looks at the bounds.
STEP = 256
#: Rows, chosen by a hash, among which pivots are picked.
PIVOT_SAMPLE = 2048


def integers(df: DataFrame) -> DataFrame:
    """vec_id and the components floor(1024 * x) as one block of bytes, for rows that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out = [], []
            for vec_id, v in zip(b.column("vec_id").to_pylist(), b.column("embedding"), strict=True):
                values = v.values
                if vec_id is None or values is None or values.null_count:
                    continue
                x = pc.cast(values, pa.float64()).to_numpy(zero_copy_only=False)
                if np.isfinite(x).all():
                    ids.append(vec_id)
                    out.append(whole(x).astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["vec_id", "v"])

    return df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(lean(run), "vec_id long, v binary")


def whole(x: np.ndarray) -> np.ndarray:
    """floor(1024 * x) as a long, set to the ends of its range beyond them."""
    with np.errstate(over="ignore"):
        y = np.floor(x * SCALE)
    ends = np.iinfo(np.int64)
    inside = (y >= -(2.0**63)) & (y < 2.0**63)
    return np.where(inside, np.where(inside, y, 0).astype(np.int64), np.where(y > 0, ends.max, ends.min))


def matrix(blobs: list[bytes], dim: int) -> np.ndarray:
    out = np.zeros((len(blobs), dim), dtype=np.int64)
    for i, b in enumerate(blobs):
        x = np.frombuffer(b, dtype="<i8")
        out[i, : len(x)] = x
    return out


class Lift:
    """Vectors on a sphere around the origin, and their distances to pivots on it."""

    def __init__(self, pivots: np.ndarray, most: float) -> None:
        self.most = most  # the largest squared norm of a candidate
        self.pivots = pivots.astype(np.float64)
        self.pivot_rest = np.sqrt(np.maximum(0, most - (self.pivots**2).sum(1)))
        self.pivot_norm = (self.pivots**2).sum(1) + self.pivot_rest**2

    def distances(self, x: np.ndarray, query: bool) -> np.ndarray:
        x = x.astype(np.float64)
        own = (x**2).sum(1)
        rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, self.most - own))
        square = own[:, None] + (rest**2)[:, None] + self.pivot_norm - 2 * (x @ self.pivots.T + rest[:, None] * self.pivot_rest)
        return np.sqrt(np.maximum(0, square))


def farthest_first(x: np.ndarray, n: int) -> np.ndarray:
    """Pivots that lie far from each other."""
    chosen = [0] if len(x) else []
    x64 = x.astype(np.float64)
    gap = np.full(len(x), np.inf)
    while chosen and len(chosen) < min(n, len(x)):
        gap = np.minimum(gap, ((x64 - x64[chosen[-1]]) ** 2).sum(1))
        chosen.append(int(gap.argmax()))
    return x[chosen]


def dots(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products: in double precision where no partial sum can leave its exact integers, in longs where none
    can leave their range, and else in integers of any size, set to the ends of a long's range at last."""
    bound = float(np.abs(x.astype(np.float64)).max(initial=0)) * float(np.abs(q.astype(np.float64)).max(initial=0)) * max(1, len(q))
    if bound < 2**53:
        return (x.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    if bound < 2**62:
        return x @ q
    ends = np.iinfo(np.int64)
    own = [int(a) for a in q]
    return np.array([min(ends.max, max(ends.min, sum(int(a) * b for a, b in zip(row, own, strict=True)))) for row in x], dtype=np.int64)


def bound(low: np.ndarray, norm: float, most: float) -> np.ndarray:
    """The largest inner product that a candidate can have with a query of that squared norm, from which it is that far
    at least; loosened beyond rounding."""
    slack = 1e-6
    best = (norm + most - np.maximum(0, low * (1 - slack) - slack * np.sqrt(norm + most) - slack) ** 2) / 2
    return best + slack * (norm + most) + 1


def search(
    ids: np.ndarray, x: np.ndarray, table: np.ndarray, queries: np.ndarray, q_table: np.ndarray, most: float, k: int, least: np.ndarray | None = None
) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(query's index, rows of its k best, their scores, rows evaluated). x is in floating point where that is exact.
    least is a score for each query below which none is wanted."""
    for i, q in enumerate(queries):
        low = np.abs(table - q_table[i]).max(1) if table.shape[1] else np.zeros(len(x))
        best = bound(low, float((q.astype(np.float64) ** 2).sum()), most)
        order = np.argsort(-best, kind="stable")
        rows, scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        seen = 0
        while seen < len(order):
            if (len(rows) >= k and best[order[seen]] < scores[-1]) or (least is not None and best[order[seen]] < least[i]):
                break
            take = order[seen : seen + STEP]
            seen += len(take)
            rows, scores = np.concatenate([rows, take]), np.concatenate([scores, dots(x[take], q)])
            keep = np.lexsort((ids[rows], -scores))[:k]
            rows, scores = rows[keep], scores[keep]
        yield i, rows, scores, seen


class Blocks:
    """Bounds of the blocks: their numbers, and the least and greatest distances of their candidates to each pivot."""

    def __init__(self, number: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        self.number, self.lo, self.hi = number, lo, hi

    def best(self, q_table: np.ndarray, norm: float, most: float) -> np.ndarray:
        """The largest score that a candidate of each block can have with a query."""
        low = np.maximum(self.lo - q_table, q_table - self.hi).max(1, initial=0)
        return bound(np.maximum(low, 0), norm, most)


_BOTH = "block long, chunk long, qid long, vec_id long, v binary, d binary"


def searched(df: DataFrame, k: int = K, stride: int = STRIDE, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best, and evaluated, the number of candidates whose products
    with the query were computed; queries are the rows whose id is divisible by stride."""
    spark = df.sparkSession
    scratch = Scratch(spark, "topk")
    rows = scratch.save(integers(df), "vectors")

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vs = [np.frombuffer(v, dtype="<i8").astype(np.float64) for v in b.column("v").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([len(v) for v in vs], pa.int64()), pa.array([float((v**2).sum()) for v in vs], pa.float64())], names=["dim", "norm"])

    n, dim, most = rows.mapInArrow(lean(norms), "dim long, norm double").agg(F.count("*"), F.max("dim"), F.max("norm")).head()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long, evaluated long")
    sample = rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(PIVOT_SAMPLE).collect()
    lift = Lift(farthest_first(matrix([r["v"] for r in sample], dim), pivots), most)
    sent = spark.sparkContext.broadcast(lift)

    def tabled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lift = sent.value
        for b in batches:
            d = lift.distances(matrix(b.column("v").to_pylist(), dim), False)
            near = d.argmin(1) if d.shape[1] else np.zeros(len(d), dtype=np.int64)
            own = d[np.arange(len(d)), near] if d.shape[1] else np.zeros(len(d))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x.tobytes() for x in d], pa.binary()), pa.array(near.astype(np.int32)), pa.array(own)], names=["vec_id", "v", "d", "pivot", "far"])

    # the pivot table: every vector with its distances to the pivots, in doubles
    table = scratch.save(rows.mapInArrow(lean(tabled), "vec_id long, v binary, d binary, pivot int, far double"), "table")
    scratch.drop("vectors")
    size = max(CANDIDATES, -(-n // MOST_BLOCKS))
    shell = min(SHELL, size) if n <= SHELL * MOST_BLOCKS else size
    # shells around each pivot, by quantiles of the distance to it; a shell of very many equal distances is cut by a hash
    counts = {r["pivot"]: r["n"] for r in table.groupBy("pivot").agg(F.count("*").alias("n")).collect()}  # one row a pivot
    most_shells = -(-max(counts.values()) // shell)
    edges = {}
    if most_shells > 1:
        shares = F.array(*(F.lit(i / most_shells) for i in range(1, most_shells)))
        for r in table.groupBy("pivot").agg(F.percentile_approx("far", shares, max(10_000, 4 * most_shells)).alias("e")).collect():
            own = -(-counts[r["pivot"]] // shell)
            edges[r["pivot"]] = [r["e"][i * most_shells // own - 1] for i in range(1, own)]
    flat = spark.sparkContext.broadcast({p: np.array(sorted(edges.get(p, []))) for p in counts})

    def shelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = flat.value
        for b in batches:
            pivot, far = b.column("pivot").to_numpy(), b.column("far").to_numpy()
            at = np.zeros(len(pivot), dtype=np.int64)
            for p in np.unique(pivot):
                own = pivot == p
                at[own] = np.searchsorted(known[int(p)], far[own], side="right")
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), b.column("d"), pa.array((pivot.astype(np.int64) << 40) | (at << 20))], names=["vec_id", "v", "d", "block"])

    table = table.mapInArrow(lean(shelled), "vec_id long, v binary, d binary, block long")
    crowded = table.groupBy("block").agg(F.count("*").alias("n")).where(F.col("n") > 2 * size).select(F.col("block").alias("b"), F.ceil(F.col("n") / size).alias("cuts"))
    table = table.join(crowded, F.col("block") == F.col("b"), "left")
    table = table.withColumn("block", F.col("block") + F.coalesce(F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.col("cuts")), F.lit(0)))
    table = scratch.save(table.select("vec_id", "v", "d", "block").repartition("block"), "blocks")
    scratch.drop("table")

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo: dict[int, np.ndarray] = {}
        hi: dict[int, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            d = np.frombuffer(b"".join(b.column("d").to_pylist()), dtype=np.float64).reshape(b.num_rows, -1)
            block = b.column("block").to_numpy()
            for k in np.unique(block).tolist():
                own = d[block == k]
                lo[k] = np.minimum(lo[k], own.min(0)) if k in lo else own.min(0)
                hi[k] = np.maximum(hi[k], own.max(0)) if k in hi else own.max(0)
        yield pa.RecordBatch.from_arrays([pa.array(list(lo), pa.int64()), pa.array([x.tobytes() for x in lo.values()], pa.binary()), pa.array([hi[k].tobytes() for k in lo], pa.binary())], names=["block", "lo", "hi"])

    ranges = table.select("block", "d").mapInArrow(lean(bounds), "block long, lo binary, hi binary").toArrow()  # about MOST_BLOCKS rows a writer at most
    number, at = np.unique(ranges.column("block").to_numpy(), return_inverse=True)
    lo, hi = np.full((len(number), len(lift.pivots)), np.inf), np.full((len(number), len(lift.pivots)), -np.inf)
    for ufunc, to, col in ((np.minimum, lo, "lo"), (np.maximum, hi, "hi")):
        ufunc.at(to, at, np.frombuffer(b"".join(ranges.column(col).to_pylist()), dtype=np.float64).reshape(-1, len(lift.pivots)))
    sent_blocks = spark.sparkContext.broadcast(Blocks(number, lo, hi))

    # queries in chunks of those with the same nearest pivot
    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lift = sent.value
        for b in batches:
            d = lift.distances(matrix(b.column("v").to_pylist(), dim), True)
            near = d.argmin(1) if d.shape[1] else np.zeros(len(d), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x.tobytes() for x in d], pa.binary()), pa.array(near.astype(np.int64))], names=["vec_id", "v", "d", "near"])

    asks = table.where(F.col("vec_id") % stride == 0).select("vec_id", "v").mapInArrow(lean(asked), "vec_id long, v binary, d binary, near long")
    asks = scratch.save(asks, "queries").withColumn("qid", F.monotonically_increasing_id())
    asking = asks.count()
    cuts = -(-asking // (QUERIES * len(lift.pivots)))
    chunk = F.col("near") * (1 << 32) + F.pmod(F.xxhash64("qid"), F.lit(cuts)) if asking > QUERIES else F.lit(0).cast("long")
    asks = asks.withColumn("chunk", chunk).drop("near")
    asks = scratch.save(asks, "chunks")

    def planned(first: bool):  # noqa: ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            blocks, lift = sent_blocks.value, sent.value
            for b in batches:
                if not b.num_rows or not len(blocks.number):
                    continue
                least = None if first else b.column("least").to_numpy(zero_copy_only=False)
                row, to = [], []
                for i, (v, d) in enumerate(zip(b.column("v").to_pylist(), b.column("d").to_pylist(), strict=True)):
                    norm = float((np.frombuffer(v, dtype="<i8").astype(np.float64) ** 2).sum())
                    best = blocks.best(np.frombuffer(d, dtype=np.float64), norm, lift.most)
                    home = int(best.argmax())
                    # a query without k + 1 candidates yet has no least score, and goes everywhere
                    own = np.array([home]) if first else np.flatnonzero((best >= least[i]) | np.isnan(least[i]))
                    own = own if first else own[own != home]
                    row.append(np.full(len(own), i))
                    to.append(blocks.number[own])
                rows = pa.array(np.concatenate(row))
                limit = pa.nulls(len(rows), pa.float64()) if first else b.column("least").take(rows)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(to)), *(b.column(c).take(rows) for c in ("chunk", "qid", "vec_id", "v", "d")), limit], names=["block", "chunk", "qid", "vec_id", "v", "d", "least"])

        return run

    def meet(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        lift = sent.value
        c_ids, x = left.column("vec_id").to_numpy(), matrix(left.column("v").to_pylist(), dim)
        q_ids, q = right.column("vec_id").to_numpy(), matrix(right.column("v").to_pylist(), dim)
        table, q_table = (np.frombuffer(b"".join(t.column("d").to_pylist()), dtype=np.float64).reshape(t.num_rows, -1) for t in (left, right))
        big = float(np.abs(x.astype(np.float64)).max(initial=0)) * float(np.abs(q.astype(np.float64)).max(initial=0)) * max(1, dim)
        x_run = x.astype(np.float64) if big < 2**53 else x
        # as floats, lower by their rounding
        least = np.nan_to_num(right.column("least").to_numpy(zero_copy_only=False).astype(np.float64), nan=-np.inf)
        out: list[list[np.ndarray]] = [[], [], [], [], [], []]
        qid = right.column("qid").to_numpy()
        for i, best, scores, seen in search(c_ids, x_run, table, q, q_table, lift.most, k + 1, least):
            if not len(best):
                continue
            # none below the least score is wanted; one is kept for the count
            keep = max(1, int((scores >= least[i]).sum()))
            best, scores = best[:keep], scores[:keep]
            same = (c_ids[best] == q_ids[i]) & (x[best] == q[i]).all(1)
            count = np.append(seen, np.zeros(len(best) - 1, dtype=np.int64))
            for to, col in zip(out, (np.full(len(best), qid[i]), np.full(len(best), q_ids[i]), c_ids[best], scores, same, count), strict=True):
                to.append(col)
        cols = [np.concatenate(o) if o else np.zeros(0, dtype=np.int64) for o in out]
        return pa.table({
            "qid": pa.array(cols[0], pa.int64()), "query_id": pa.array(cols[1], pa.int64()), "vec_id": pa.array(cols[2], pa.int64()),
            "score": pa.array(cols[3], pa.int64()), "same": pa.array(cols[4].astype(bool)), "evaluated": pa.array(cols[5], pa.int64()),
        })

    def met(asks: DataFrame, first: bool) -> DataFrame:
        """Queries meet the candidates of the blocks that are planned for them: a chunk of queries and a block make a
        task, to which no block goes that no query of the chunk asks for."""
        plan = asks.mapInArrow(lean(planned(first)), _BOTH + ", least double")
        plan = scratch.save(plan, f"plan-{int(first)}")
        places = plan.select(F.col("block").alias("to"), F.col("chunk").alias("of")).distinct()
        cand = table.join(places, F.col("block") == F.col("to")).select(F.col("to").alias("block"), F.col("of").alias("chunk"), "vec_id", "v", "d")
        out = cand.groupBy("block", "chunk").cogroup(plan.groupBy("block", "chunk")).applyInArrow(meet, "qid long, query_id long, vec_id long, score long, same boolean, evaluated long")
        return scratch.save(out, f"met-{int(first)}")

    home = met(asks, True)
    # the last of a query's k + 1 first finds; null where there are fewer. A double below it
    found = home.groupBy("qid").agg(F.when(F.count("*") > k, F.min("score").cast("double") - F.abs(F.min("score").cast("double")) * 1e-12 - 1).alias("least"))
    rest = met(asks.join(found, "qid", "left").select("chunk", "qid", "vec_id", "v", "d", "least"), False)
    top = home.union(rest)
    # each query's best of all blocks, k + 1 of them, without one row that is its own
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id", F.desc("same"))
    own = Window.partitionBy("qid", "same").orderBy(F.desc("score"), "vec_id")
    tried = top.groupBy("qid").agg(F.sum("evaluated").alias("evaluated"))
    top = top.drop("evaluated").withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    top = top.withColumn("s", F.row_number().over(own)).where(~(F.col("same") & (F.col("s") == 1)))
    top = top.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return top.join(tried, "qid").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", "evaluated")


def nearest(df: DataFrame, k: int = K, stride: int = STRIDE, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best."""
    return searched(df, k, stride, pivots).drop("evaluated")
