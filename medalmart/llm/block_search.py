"""Nearest neighbours by a block matrix join: exact, with int8 products to rule pairs out.

Queries and candidates are dealt into blocks; each pair of a query block and a candidate block is
one tile. A tile multiplies int8 codes, a scale for each vector. With x = s c + e (code and error),
the true product lies within |sc| |e'| + |e| |s'c'| + |e| |e'| of the product of the codes, by Cauchy and
Schwarz. A pair is left out only if its upper bound is below the k-th best lower bound of its query;
the rest is computed anew in double precision from the original vectors, and each tile keeps its k
best for each query. The lists of all tiles are merged by heaps, one of k pairs for each query: in
every task before they move, and again where a query's lists meet. So recall is 1.

Each tile holds its two blocks and nothing else. Equal vectors of a candidate block compete once:
only the k + 1 smallest ids of them can be among a query's nearest.

Defined results: vectors that are null, empty, zero, or hold a null or non-finite component take no
part, nor do rows without an id; vectors of another length than the query's are no candidates of
it; rows with the query's id are not its candidates; a vector that is repeated under one id counts
once; several vectors under one query id compete together; ties go to the smaller id; an empty table gives no rows;
columns other than id and vector are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

NEAREST = 20
#: Vectors in a block of queries and of candidates.
QUERIES, CANDIDATES = 4096, 8192
#: Queries of a block that are multiplied at once.
STRIP = 256
#: Pairs that the heaps of a task hold before its lists go on.
HELD = 1 << 18


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    values = column.combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, norms of the coded vectors, norms of the errors (rounded up)."""
    scale = np.abs(x).max(1) / 127.0
    scale = np.maximum(scale, np.finfo(np.float64).tiny)
    code = np.rint(x / scale[:, None])
    coded = code * scale[:, None]
    up = 1.0 + 1e-9
    return code.astype(np.int8), scale, np.linalg.norm(coded, axis=1) * up, np.linalg.norm(x - coded, axis=1) * up


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows; equal rows give equal bits, wherever they stand."""
    return (a * b).sum(axis=1)


def _distinct(ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Candidates in id order, of equal vectors the ``k + 1`` smallest ids, each once."""
    order = np.argsort(ids, kind="stable")
    rows = np.ascontiguousarray(x[order]).view(np.dtype((np.void, x.shape[1] * 8))).reshape(-1)
    _, code = np.unique(rows, return_inverse=True)
    by = np.lexsort((ids[order], code))
    code, own = code[by], ids[order][by]
    again = np.concatenate(([False], (code[1:] == code[:-1]) & (own[1:] == own[:-1])))
    by, code = by[~again], code[~again]
    first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
    nth = np.arange(len(code)) - np.repeat(first, np.diff(np.append(first, len(code))))
    return order[np.sort(by[nth <= k])]


def tile(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best candidates of each query: positions of queries, ids, scores."""
    pick = _distinct(ids, x, k)
    ids, x = ids[pick], x[pick]
    qc, qs, qn, qe = quantised(q)
    xc, xs, xn, xe = quantised(x)
    # int8 products fit float32 exactly up to 2**24 / 127**2 components; longer vectors need doubles.
    kind = np.float32 if x.shape[1] <= 1040 else np.float64
    right = xc.T.astype(kind)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for a in range(0, len(q), STRIP):
        part = slice(a, a + STRIP)
        near = (qc[part].astype(kind) @ right).astype(np.float64) * (qs[part, None] * xs)
        bound = qn[part, None] * xe + qe[part, None] * (xn + xe)
        low = near - bound
        own = query_ids[part, None] == ids
        low[own] = -np.inf
        if len(ids) > k:
            best = np.partition(low, len(ids) - k, axis=1)[:, len(ids) - k]
        else:
            best = np.full(len(low), -np.inf)
        rows, cols = np.nonzero((near + bound >= best[:, None]) & ~own)
        for c in range(0, len(rows), 1 << 16):
            i, j = rows[c : c + (1 << 16)], cols[c : c + (1 << 16)]
            out.append((i + a, ids[j], products(q[i + a], x[j])))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    who, which, score = (np.concatenate(z) for z in zip(*out, strict=True))
    order = np.lexsort((which, -score, who))
    who, which, score = who[order], which[order], score[order]
    first = np.searchsorted(who, who, "left")
    keep = np.arange(len(who)) - first < k
    return who[keep], which[keep], score[keep]


def _tiles(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        if not len(queries) or not len(candidates):
            empty = pa.array([], pa.int64())
            return pa.table({"query_id": empty, "vec_id": empty, "score": pa.array([], pa.float64())})
        query_ids = queries.column("id").to_numpy()
        who, which, score = tile(query_ids, _matrix(queries.column("v")), candidates.column("id").to_numpy(), _matrix(candidates.column("v")), k)
        return pa.table({"query_id": query_ids[who], "vec_id": which, "score": score})

    return run


def _heaps(k: int, ranked: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The ``k`` best pairs of each query, with their ranks if nothing is to come; a heap's root is its worst pair."""

    def told(heaps: dict[int, list[tuple[float, int]]]) -> pa.RecordBatch:
        rows = [(q, n, -v, s) for q, heap in heaps.items() for n, (s, v) in enumerate(sorted(heap, reverse=True), 1)]
        query, rank, which, score = zip(*rows, strict=True) if rows else ((),) * 4
        columns = {"query_id": pa.array(query, pa.int64()), "rank": pa.array(rank, pa.int32()), "vec_id": pa.array(which, pa.int64()), "score": pa.array(score, pa.float64())}
        return pa.RecordBatch.from_pydict({c: columns[c] for c in columns if ranked or c != "rank"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, list[tuple[float, int]]] = {}
        for batch in batches:
            for query, which, score in zip(*(batch.column(c).to_pylist() for c in ("query_id", "vec_id", "score")), strict=True):
                heap, pair = heaps.setdefault(query, []), (score, -which)
                if len(heap) < k:
                    heapq.heappush(heap, pair)
                elif pair > heap[0]:
                    heapq.heapreplace(heap, pair)
            if not ranked and len(heaps) * k > HELD:
                yield told(heaps)
                heaps = {}
        yield told(heaps)

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = NEAREST, key: str = "vec_id", vector: str = "embedding", queries: int = QUERIES, candidates: int = CANDIDATES) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` largest inner products of each query."""
    rows = vectors.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), is_query.alias("asks")).where(usable(F.col("v")))
    if not isinstance(rows.schema["v"].dataType.elementType, T.FloatType | T.DoubleType):
        rows = rows.withColumn("v", F.transform("v", lambda x: x.cast("double")))
    rows = rows.withColumn("dim", F.size("v"))
    counts = rows.agg(F.count("*").alias("all"), F.count_if("asks").alias("asking")).first()
    n_candidate, n_query = counts["all"] // candidates + 1, counts["asking"] // queries + 1
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int")
    asking = rows.where("asks").dropDuplicates(["id", "v"]).select("dim", dealt(n_query).alias("qb"), every(n_candidate).alias("cb"), "id", "v")
    # Rows that repeat a vector under its id would all be dealt to one block; copies go before they move.
    offered = rows.select("dim", "id", "v").distinct().select("dim", every(n_query).alias("qb"), dealt(n_candidate).alias("cb"), "id", "v")
    keys = ["dim", "qb", "cb"]
    found = asking.groupBy(*keys).cogroup(offered.groupBy(*keys)).applyInArrow(_tiles(k), "query_id bigint, vec_id bigint, score double")
    # A task sends on k pairs a query, about; a group of queries streams through its heaps.
    few = found.mapInArrow(_heaps(k, ranked=False), found.schema)
    met = few.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(n_query)))
    return met.applyInArrow(_heaps(k, ranked=True), "query_id bigint, rank int, vec_id bigint, score double")


def op3_block_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, F.coalesce(F.col("vec_id") % 20 == 0, F.lit(False)))
