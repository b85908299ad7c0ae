"""Exact top-k search by distributed histogram selection.

Every pass scores all pairs of a block of queries with a block of candidates by one matrix product.
The first passes only count: each task adds its scores to one histogram per query and sends, of every
histogram, the highest bins down to the one that holds its own k-th score (a lower bin cannot hold the
k-th of all). Their sums tell in which bin the k-th score of all lies; the next pass splits that bin,
until a bin is one score wide. The last pass returns what lies above that score, and of the ties at it
those with the smallest ids.

Queries are handled in chunks of at most ``CHUNK`` (and 32 MB): a chunk and its per-query bounds are all
that is sent to the executors or comes to the driver. The work is queries times candidates, as exact
search by scoring is.

Defined cases: a vector that is null, has a null or non-finite component, or one beyond 2^20 in
magnitude (its score might not fit a long) takes no part, nor does a row without an id; only vectors of
equal length are compared; an empty vector scores 0 with other empty ones; candidates with the query's
own id are left out; a query id that several rows bear is one query with the least of their vectors;
repeated candidate rows are candidates of their own; with fewer than k candidates all are returned;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 16_384
CHUNK_BYTES = 32 << 20
BINS = 1024
SCALE = 64
LARGEST = 2.0**20
#: Scores held at once by a task.
BLOCK_SCORES = 4_000_000


def vectors_of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and whole-number vectors (as float64) of the rows that take part, by vector length."""
    ids, col = batch.column(0), batch.column(1)
    values, off = col.values, np.asarray(col.offsets)
    numbers = values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    length = np.diff(off)
    usable = ~(np.asarray(col.is_null()) | np.asarray(ids.is_null()))
    number_of = ids.cast(pa.int64()).fill_null(0).to_numpy()
    for d in np.unique(length[usable]):
        rows = np.flatnonzero(usable & (length == d))
        x = numbers[off[rows][:, None] + np.arange(d)]
        good = (np.abs(x) <= LARGEST).all(axis=1)
        yield number_of[rows[good]], np.floor(SCALE * x[good])


def _stats(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[int, list[float]] = {}
    for batch in it:
        for ids, x in vectors_of(batch):
            if len(ids):
                s = seen.setdefault(x.shape[1], [0, 0.0])
                s[0] += len(ids)
                s[1] = max(s[1], float((x * x).sum(axis=1).max()))
    yield pa.RecordBatch.from_pydict(
        {"dim": pa.array(seen, pa.int32()), "n": pa.array([s[0] for s in seen.values()], pa.int64()), "norm2": pa.array([s[1] for s in seen.values()], pa.float64())}
    )


def _packed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for ids, x in vectors_of(batch):
            rows = [v.tobytes() for v in x.astype(np.int32)]
            yield pa.RecordBatch.from_pydict(
                {"id": pa.array(ids, pa.int64()), "dim": pa.array([x.shape[1]] * len(ids), pa.int32()), "v": pa.array(rows, pa.binary())}
            )


def _scores(query_ids: np.ndarray, q: np.ndarray, bound: float) -> Callable:
    """Function that yields (candidate ids, score matrix, mask of own ids) for a batch, block by block."""
    kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64
    qt = q.astype(kind)
    width = max(1, BLOCK_SCORES // max(1, len(q)))

    def of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for ids, x in vectors_of(batch):
            if x.shape[1] != q.shape[1]:
                continue
            for i in range(0, len(ids), width):
                own = ids[i : i + width]
                s = (qt @ x[i : i + width].astype(kind).T).astype(np.int64)
                at = np.searchsorted(query_ids, own)
                same = (at < len(query_ids)) & (query_ids[np.minimum(at, len(query_ids) - 1)] == own)
                s[at[same], np.flatnonzero(same)] = np.iinfo(np.int64).min
                yield own, s

    return of


def _count(state) -> Callable:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, q, bound, lo, width, span, need = state.value
        n, scores = len(q), _scores(query_ids, q, bound)
        hist = np.zeros((n, BINS), np.int64)
        row = np.arange(n)[:, None] * BINS
        for batch in it:
            for _, s in scores(batch):
                b = s - lo[:, None]
                inside = (b >= 0) & (b < span[:, None])
                at = (row + b // width[:, None])[inside]
                hist += np.bincount(at, minlength=n * BINS).reshape(n, BINS)
        # Bins from the top, down to the one that reaches what is still wanted.
        above = hist[:, ::-1].cumsum(axis=1)[:, ::-1] - hist
        keep = (hist > 0) & (above < need[:, None])
        r, b = np.nonzero(keep)
        yield pa.RecordBatch.from_pydict({"q": pa.array(r, pa.int32()), "bin": pa.array(b, pa.int32()), "n": pa.array(hist[r, b], pa.int64())})

    return run


def _select(state) -> Callable:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, q, bound, lo, need = state.value
        scores = _scores(query_ids, q, bound)
        least = np.iinfo(np.int64).min
        for batch in it:
            for ids, s in scores(batch):
                r, c = np.nonzero((s > lo[:, None]) & (s > least))
                tie_r, tie_c = np.nonzero((s == lo[:, None]) & (need > 0)[:, None])
                order = np.lexsort((ids[tie_c], tie_r))
                tie_r, tie_c = tie_r[order], tie_c[order]
                place = np.arange(len(tie_r)) - np.searchsorted(tie_r, tie_r)
                few = place < need[tie_r]
                r, c = np.concatenate([r, tie_r[few]]), np.concatenate([c, tie_c[few]])
                yield pa.RecordBatch.from_pydict(
                    {"query_id": pa.array(query_ids[r], pa.int64()), "vec_id": pa.array(ids[c], pa.int64()), "score": pa.array(s[r, c], pa.int64())}
                )

    return run


def _chunk_top(data: DataFrame, chunk: list, dim: int, norm2: float, k: int) -> DataFrame:
    spark = data.sparkSession
    chunk = sorted(chunk, key=lambda x: x["id"])
    query_ids = np.array([x["id"] for x in chunk], np.int64)
    q = np.frombuffer(b"".join(bytes(x["v"]) for x in chunk), np.int32).reshape(len(chunk), dim).astype(np.float64)
    # No score is larger in magnitude than the product of the norms.
    reach = np.ceil(np.sqrt((q * q).sum(axis=1) * norm2)).astype(np.int64) + 1
    lo, span = -reach, 2 * reach + 1
    width = -(-span // BINS)
    need = np.full(len(q), k, np.int64)
    open_ = np.ones(len(q), bool)
    bound = float(reach.max())
    top_first = Window.partitionBy("q").orderBy(F.col("bin").desc())
    while open_.any():
        # A settled query wants nothing, so it sends no bins.
        state = spark.sparkContext.broadcast((query_ids, q, bound, lo, width, span, np.where(open_, need, 0)))
        counts = data.mapInArrow(_count(state), "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        running = counts.withColumn("upto", F.sum("n").over(top_first.rowsBetween(Window.unboundedPreceding, 0)))
        wanted = spark.createDataFrame([(int(i), int(need[i])) for i in np.flatnonzero(open_)], "q int, need long")
        hits = (
            running.join(F.broadcast(wanted), "q")
            .filter((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need")))
            .select("q", "bin", (F.col("need") - F.col("upto") + F.col("n")).alias("left"))
            .collect()
        )
        found = np.zeros(len(q), bool)
        for h in hits:
            i = h["q"]
            lo[i] += h["bin"] * width[i]
            need[i] = h["left"]
            found[i] = True
        # Fewer candidates than k: everything is wanted, and nothing ties.
        few = open_ & ~found
        lo[few], need[few] = -reach[few] - 1, 0
        open_ &= found & (width > 1)
        span, width = np.where(open_, width, 1), np.where(open_, -(-width // BINS), 1)
    state = spark.sparkContext.broadcast((query_ids, q, bound, lo, need))
    rows = data.mapInArrow(_select(state), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(df: DataFrame, vec_id: str, vector: str, is_query: Column, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best inner products of every query."""
    spark = df.sparkSession
    data = df.select(vec_id, vector)
    stats = data.mapInArrow(_stats, "dim int, n long, norm2 double").groupBy("dim").agg(F.sum("n").alias("n"), F.max("norm2").alias("norm2"))
    queries = df.filter(is_query).select(vec_id, vector).mapInArrow(_packed, "id long, dim int, v binary").groupBy("id").agg(F.min(F.struct("dim", "v")).alias("x"))
    queries = queries.select("id", "x.dim", "x.v")
    sizes = {r["dim"]: r["n"] for r in queries.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    parts = []
    for s in sorted(stats.collect(), key=lambda r: r["dim"]):
        dim, n = s["dim"], sizes.get(s["dim"], 0)
        chunks = -(-n // min(CHUNK, max(1, CHUNK_BYTES // max(4, 4 * dim))))
        for c in range(chunks):
            mine = queries.filter((F.col("dim") == dim) & (F.pmod(F.xxhash64("id"), F.lit(chunks)) == c)).collect()
            if mine:
                parts.append(_chunk_top(data, mine, dim, s["norm2"], k))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return reduce(DataFrame.unionByName, parts)
