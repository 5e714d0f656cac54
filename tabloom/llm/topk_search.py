"""Exact top-k by inner product: blocks of dimensions, bounds on what is left, compaction."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tabloom.llm.common import read, stage
from tabloom.llm.vectors import as_kind, exact_kind, finite, scaled, visit

K = 20
SCALE = 64
#: Dimensions added up between two compactions.
DIMS_IN_BLOCK = 16
#: Decimals have so many digits; larger scores count as this.
MOST = 10**38 - 1
#: Below this share of survivors the rest of a block is worked out for the survivors alone.
COMPACT_BELOW = 0.25


def reach(sums: np.ndarray, left: np.ndarray) -> np.ndarray:
    """What ``sums`` can grow to by ``left`` at most, as floats that are not too small."""
    if sums.dtype == np.float64:
        return sums + left * (1 + 1e-9)
    near = sums.astype(np.float64)  # rounded, other than sums below 2^52
    return near + np.abs(near) * 1e-14 + left * (1 + 1e-9)


def search_block(queries: np.ndarray, columns: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of all pairs whose score may reach the query's ``floor``.

    ``columns`` is vertical: a row per dimension. After each block of dimensions a
    pair's score is at most its sum so far plus the product of both remaining
    norms; pairs below the floor go. Sums of integers, so every kept score is exact;
    norms are floats, as squares may not fit where the products do.
    """
    dims = columns.shape[0]
    edges = list(range(0, dims, DIMS_IN_BLOCK)) + [dims]
    left_q = np.sqrt(np.cumsum((queries.astype(np.float64, copy=False) ** 2)[:, ::-1], axis=1)[:, ::-1])
    left_c = np.sqrt(np.cumsum((columns.astype(np.float64, copy=False) ** 2)[::-1], axis=0)[::-1])
    sums = np.zeros((len(queries), columns.shape[1]), dtype=queries.dtype)
    pairs = None
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if pairs is None:
            sums += queries[:, a:b] @ columns[a:b]
            if b == dims:
                break
            bound = reach(sums, left_q[:, b : b + 1] * left_c[b : b + 1])
            alive = bound >= floor[:, None]
            if alive.mean() < COMPACT_BELOW:
                pairs = np.nonzero(alive)
                sums = sums[pairs]
        else:
            q, c = pairs
            sums = sums + np.einsum("ij,ji->i", queries[q, a:b], columns[a:b][:, c])
            if b < dims:
                keep = reach(sums, left_q[q, b] * left_c[b, c]) >= floor[q]
                pairs, sums = (q[keep], c[keep]), sums[keep]
    if pairs is None:
        pairs = np.nonzero(sums.astype(np.float64, copy=False) >= floor[:, None])
        sums = sums[pairs]
    keep = sums.astype(np.float64, copy=False) >= floor[pairs[0]]
    return pairs[0][keep], pairs[1][keep], sums[keep]


def best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k highest scores of each query, ties to the smaller id, in order."""
    if score.dtype == object:
        order = np.array(sorted(range(len(ids)), key=lambda i: (query[i], -score[i], ids[i])), dtype=np.int64)
    else:
        order = np.lexsort((ids, -score, query))
    first = np.concatenate([[True], query[order][1:] != query[order][:-1]])
    begin = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    return order[np.arange(len(order)) - begin < k]


def decimals(score: np.ndarray) -> pa.Array:
    """Scores as decimals of 38 digits; larger ones are cut to that."""
    if score.dtype != object:
        return pa.array(score).cast(pa.decimal128(38, 0))
    return pa.array([Decimal(max(-MOST, min(MOST, int(x)))) for x in score], pa.decimal128(38, 0))


def searched(k: int):
    """The k best rows of a slice for each query of a block: its row, vec_id, and theirs with the score."""

    def search(resident: list, block: tuple) -> Iterator[pa.RecordBatch]:
        (rows, names), asked = block
        floor = np.full(len(rows), -np.inf)
        none = np.zeros(0, dtype=np.int64)
        q, held, score = none, none, none
        for (own, ids), vectors in resident:
            kind = exact_kind(asked, vectors)
            at, c, s = search_block(as_kind(asked, kind), np.ascontiguousarray(as_kind(vectors, kind).T), floor)
            s = s if kind is object else s.astype(np.int64)  # blocks of floats and of larger integers meet here
            other = own[c] != rows[at]
            q, held, score = (np.concatenate(x) for x in ((q, at[other]), (held, ids[c][other]), (score, s[other])))
            top = best(q, held, score, k)
            q, held, score = q[top], held[top], score[top]
            full = np.bincount(q, minlength=len(rows)) >= k
            lowest = np.full(len(rows), np.inf)
            np.minimum.at(lowest, q, score.astype(np.float64))
            floor = np.where(full, lowest, -np.inf)
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows[q]), pa.array(names[q]), pa.array(held), decimals(score)], ["row", "query_id", "vec_id", "score"]
        )

    return search


def top_k(vectors: DataFrame, is_query, k: int = K, slices_: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query.

    ``vectors`` has vec_id and embedding; ``is_query`` is a condition on vec_id.
    Components become floor(64 x), whole numbers of any size. A null vec_id or vector, and null
    or non-finite components, take no part; vectors meet those of their own width. A
    query's candidates are all rows but its own: repeated rows are candidates of each other, and
    each repeated query has its rows. Ties go to the smaller vec_id. Scores are exact; those beyond 64 bits are
    ranked exactly up to 38 digits and told as the largest or smallest long. An empty table gives no rows.

    Rows are dealt to slices once; blocks of queries are sent to every slice (:func:`visit`), where
    blocks of dimensions are added up and a running top k gives the floor for the bounds. Only
    k rows per query and slice are merged.
    """
    rows = vectors.filter(F.col("vec_id").isNotNull() & finite("embedding")).select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"),
        F.coalesce(is_query, F.lit(False)).alias("asks"), scaled("embedding", SCALE).alias("vector"),
    )
    rows = stage(rows)  # so that row numbers stay what they are
    names = ["row", "vec_id"]
    partial = visit(rows, names, rows.filter("asks"), names, searched(k), "row long, query_id long, vec_id long, score decimal(38,0)", slices=slices_)
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    ranked = partial.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    most = F.lit(Decimal(2**63 - 1))
    return ranked.select("query_id", "rank", "vec_id", F.greatest(F.least("score", most), -most).cast("long").alias("score"))


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best partners of every vector whose id is divisible by 20, against all rows."""
    return top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES = {"op9_topk_search": op9_topk_search}
ORACLES = {
    "op9_topk_search": """
WITH v AS (
  SELECT row_number() OVER () AS own, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS vector
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND list_aggregate(list_transform(embedding, lambda x: CASE WHEN x IS NOT NULL AND isfinite(x) THEN 0 ELSE 1 END), 'sum') = 0
), s AS (
  SELECT q.own, q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_aggregate(list_transform(list_zip(q.vector, c.vector), lambda p: p[1] * p[2]), 'sum') AS BIGINT) AS score
  FROM v q JOIN v c ON q.own <> c.own
  WHERE q.vec_id % 20 = 0 AND len(q.vector) = len(c.vector)
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
""",
}
