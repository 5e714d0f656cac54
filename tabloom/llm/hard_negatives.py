"""Hard negatives by a secondary sort: score windows opened by positives, negatives streamed through them.

1. Anchors visit slices of rows; each slice tells an anchor's highest rows of its own label.
   The first of all slices are its positives, and each opens a window of scores.
2. Anchors visit the slices again with their windows; a slice tells the first negatives
   of each window, as later ones of a slice cannot be among the first of all.
3. Positives and negatives become keys (anchor, descending score, id) of bytes that sort as these
   do, and go through ``repartitionAndSortWithinPartitions``. An iterator reads a partition
   once: a positive opens its window, a negative goes to the windows that are open to it. It
   holds a few numbers per open window and no anchor's rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tabloom.llm.common import partitions, read, stage
from tabloom.llm.vectors import as_kind, exact_kind, finite, scaled, visit

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these hundredths of its positive's.
LOW, HIGH = 30, 90
#: Scores are kept as longs; larger ones in size count as this.
LARGEST = (1 << 63) - 1
#: A sort key: anchor's row and id, score from high to low, positives first, id; all as bytes in order.
KEY = ">QQQBQ"
TOP = 1 << 63


def scores(resident: list, block: tuple) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Longs of each block of resident rows and the exact scores of all queries with them, as longs."""
    for longs, vectors in resident:
        kind = exact_kind(block[1], vectors)
        found = as_kind(block[1], kind) @ as_kind(vectors, kind).T
        if kind is object:
            found = np.minimum(np.maximum(found, -LARGEST), LARGEST)
        yield longs, found.astype(np.int64)


def first_of(query: np.ndarray, score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Indices of the ``most`` highest scores of each query, ties to the smaller id."""
    order = np.lexsort((ids, -score, query))
    fresh = np.concatenate([[True], query[order][1:] != query[order][:-1]])
    begin = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
    return order[np.arange(len(order)) - begin < most]


def likely(score: np.ndarray, allowed: np.ndarray, most: int) -> np.ndarray:
    """``allowed`` without scores below the ``most``-th highest allowed one of a row."""
    if score.shape[1] <= most:
        return allowed
    seen = np.where(allowed, score, -LARGEST - 1)
    cut = np.partition(seen, score.shape[1] - most, axis=1)[:, score.shape[1] - most]
    return allowed & (score >= cut[:, None])


def positives_of(most: int):
    def search(resident: list, block: tuple) -> Iterator[pa.RecordBatch]:
        rows, label = block[0][0], block[0][2]
        held = tuple(np.zeros(0, np.int64) for _ in range(3))
        for longs, score in scores(resident, block):
            same = likely(score, (longs[2][None, :] == label[:, None]) & (longs[0][None, :] != rows[:, None]), most)
            q, c = np.nonzero(same)
            held = tuple(np.concatenate(x) for x in zip(held, (q, score[q, c], longs[1][c]), strict=True))
            held = tuple(x[first_of(*held, most)] for x in held) if len(held[0]) else held
        q, score, ids = held
        yield pa.RecordBatch.from_arrays([pa.array(rows[q]), pa.array(score), pa.array(ids)], ["anchor", "score", "id"])

    return search


def negatives_of(windows: int, most: int):
    def search(resident: list, block: tuple) -> Iterator[pa.RecordBatch]:
        rows, named, label, bounds = block[0][0], block[0][1], block[0][2], block[0][3:]
        held = tuple(np.zeros(0, np.int64) for _ in range(3))  # query times windows plus window, score, id
        for longs, score in scores(resident, block):
            other = longs[2][None, :] != label[:, None]
            found = []
            for w in range(windows):
                inside = other & (score >= bounds[2 * w][:, None]) & (score <= bounds[2 * w + 1][:, None])
                q, c = np.nonzero(likely(score, inside, most))
                found.append((q * windows + w, score[q, c], longs[1][c]))
            held = tuple(np.concatenate([h, *(f[k] for f in found)]) for k, h in enumerate(held))
            held = tuple(x[first_of(*held, most)] for x in held) if len(held[0]) else held
        q, score, ids = held[0] // windows, held[1], held[2]
        # a row that several windows found is told as often as one window found it
        order = np.lexsort((held[0], ids, score, q))
        q, score, ids, w = q[order], score[order], ids[order], held[0][order]
        new = np.concatenate([[True], (q[1:] != q[:-1]) | (score[1:] != score[:-1]) | (ids[1:] != ids[:-1])]) if len(q) else np.zeros(0, bool)
        group = np.cumsum(new) - 1
        if len(q):
            runs, times = np.unique(np.stack([group, w]), axis=1, return_counts=True)
            copies = np.zeros(int(group[-1]) + 1, np.int64)
            np.maximum.at(copies, runs[0], times)
            first = np.repeat(np.flatnonzero(new), copies)
            q, score, ids = q[first], score[first], ids[first]
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows[q]), pa.array(named[q]), pa.array(score), pa.array(ids)], ["anchor", "anchor_id", "score", "id"]
        )

    return search


def keys(positive: DataFrame, negative: DataFrame) -> DataFrame:
    """The rows of both as sort keys; each has anchor, anchor_id, score, id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("anchor", "anchor_id", "score", "flag", "id")]
            made = [struct.pack(KEY, a + TOP, n + TOP, TOP - 1 - s, f, i + TOP) for a, n, s, f, i in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["key"])

    both = positive.withColumn("flag", F.lit(0)).unionByName(negative.withColumn("flag", F.lit(1)))
    return both.mapInArrow(run, "key binary")


def mined(keys: Iterator[tuple[bytes, None]], positives: int, negatives: int, low: int, high: int) -> Iterator[tuple]:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score from keys in order."""
    anchor, opened, windows = None, 0, []
    for key, _ in keys:
        row, name, down, flag, code = struct.unpack(KEY, key)
        score, number = TOP - 1 - down, code - TOP
        if row != anchor:
            anchor, opened, windows = row, 0, []
        if flag == 0:
            if opened < positives:
                opened += 1
                if score >= 0:
                    windows.append([score, number, 0])
            continue
        for window in windows:
            if low * window[0] <= 100 * score <= high * window[0] and window[2] < negatives:
                window[2] += 1
                yield name - TOP, window[1], window[2], number, window[0], score


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   low: int = LOW, high: int = HIGH, scale: int = SCALE) -> DataFrame:
    """anchor_id, positive_id long, rank int, negative_id, positive_score, negative_score long.

    ``vectors`` has vec_id, embedding and label; ``is_anchor`` is a condition on vec_id.
    Components become floor(scale x) and scores are exact integer inner products, kept within 63
    bits. An anchor's positives are the first other rows of its label, by falling score, ties by
    smaller vec_id; for each, the first rows of other labels follow whose score lies between
    ``low`` and ``high`` hundredths of the positive's. Rows without vec_id, label or vector, and with null or
    non-finite components, take no part; vectors meet those of their own width. Repeated rows
    are rows of their own: copies of an anchor are each other's positives, and each is an anchor.
    Anchors without positives or negatives have no rows. Further columns are ignored; an
    empty table gives no rows.
    """
    spark = vectors.sparkSession
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite("embedding")
    rows = vectors.filter(fine).select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        scaled("embedding", scale).alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("asks"),
    )
    rows = stage(rows)  # so that row numbers stay what they are
    names = ["row", "vec_id", "label"]
    anchors = rows.filter("asks")
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    told = visit(rows, names, anchors, names, positives_of(positives), "anchor long, score long, id long")
    first = stage(told.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= positives))
    # scores from 0 up have windows; whole numbers from the lower bound rounded up to the higher rounded down
    score = F.col("score").cast("decimal(38,0)")
    bounds = F.when(F.col("score") >= 0, F.struct(
        F.ceil(score * low / 100).cast("long").alias("from"), F.floor(score * high / 100).cast("long").alias("to")
    ))
    windows = first.groupBy("anchor").agg(F.array_compact(F.collect_list(bounds)).alias("windows"))
    # windows that are not there hold nothing
    pair = lambda w: F.try_element_at("windows", F.lit(w + 1))
    edges = [e for w in range(positives) for e in (F.coalesce(pair(w)["from"], F.lit(1)), F.coalesce(pair(w)["to"], F.lit(0)))]
    ends = [f"edge{k}" for k in range(2 * positives)]
    asked = anchors.join(windows, F.col("row") == F.col("anchor")).filter(F.size("windows") > 0)
    asked = asked.select(*names, "vector", *[e.alias(n) for e, n in zip(edges, ends, strict=True)])
    kinds = "anchor long, anchor_id long, score long, id long"
    negative = visit(rows, names, asked, [*names, *ends], negatives_of(positives, negatives), kinds)
    positive = first.join(anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    packed = keys(positive.select("anchor", "anchor_id", "score", "id"), negative)
    count = partitions(spark)
    ordered = packed.rdd.map(lambda r: (bytes(r.key), None)).repartitionAndSortWithinPartitions(count, lambda key: zlib.crc32(key[:8]) % count)
    out = ordered.mapPartitions(lambda keys: mined(keys, positives, negatives, low, high))
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return spark.createDataFrame(out, schema)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives for every embedding whose id is divisible by 100, labels corrupted where divisible by 7."""
    vectors = read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)


QUERIES = {"op12_hard_negatives": op12_hard_negatives}
ORACLES = {
    "op12_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS vector
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND list_aggregate(list_transform(embedding, lambda x: CASE WHEN x IS NOT NULL AND isfinite(x) THEN 0 ELSE 1 END), 'sum') = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same,
         CAST(list_aggregate(list_transform(list_zip(a.vector, c.vector), lambda p: p[1] * p[2]), 'sum') AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id AND len(a.vector) = len(c.vector)
  WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER w <= 10
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)
""",
}
