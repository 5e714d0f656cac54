"""Packing along a Hilbert curve: neighbouring documents share sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabloom.llm.common import bases, binaries, partitions, read, slices, stage, texts_of, tidy
from tabloom.llm.tokens import END_ID, encoder, vocabulary

LENGTH = 4096
#: Coordinates that document vectors are projected to, and bits of each: together below 63.
DIMS, BITS = 4, 12
#: Words that a worker remembers, and bytes of text that it encodes together.
MEMO, SLICE = 800_000, 8_000_000
#: Buckets that token ids are hashed to before the projection.
BUCKETS = 1 << 10

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "hilbert_key long, ids binary"
)


def projection(ids: int, seed: int = 17) -> np.ndarray:
    """Per token id, the coordinates of its signed hash bucket under a random projection."""
    mixed = (np.arange(ids, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    directions = np.random.default_rng(seed).standard_normal((BUCKETS, DIMS))
    sign = np.where(mixed >> np.uint64(63), 1.0, -1.0)
    return (directions[(mixed >> np.uint64(20)) % np.uint64(BUCKETS)] * sign[:, None]).astype(np.float32)


def coordinates(ids: np.ndarray, counts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Mean projected vector of each document as ``DIMS`` integers of ``BITS`` bits."""
    edges = np.concatenate([[0], np.cumsum(counts)])
    sums = np.empty((len(counts), DIMS))
    for k in range(DIMS):
        running = np.concatenate([[0.0], np.cumsum(table[:, k][ids], dtype=np.float64)])
        sums[:, k] = running[edges[1:]] - running[edges[:-1]]
    mean = sums / np.maximum(counts, 1)[:, None]
    return np.floor((np.tanh(2 * mean) + 1) / 2 * ((1 << BITS) - 1)).astype(np.int64)


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place of each point (rows of integers below 2^bits) along the Hilbert curve (Skilling 2004)."""
    x = points.astype(np.int64).copy()
    n = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[:, i] & q) != 0
            swap = np.where(high, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] ^= np.where(high, p, swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(len(x), dtype=np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where(x[:, n - 1] & q, q - 1, 0)
        q >>= 1
    x ^= flip[:, None]
    key = np.zeros(len(x), dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[:, i] >> b) & 1
    return key


def tokens_with_key(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, hilbert_key, doc_tokens, ids of each whole text (null: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, MEMO)
        table = projection(encode.library.get_vocab_size())
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                ids, counts = encode(batch.column("text"), end_id)
                keys = hilbert_key(coordinates(ids, counts, table))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(keys), pa.array(counts), binaries(ids, counts)],
                    ["doc_id", "hilbert_key", "doc_tokens", "ids"],
                )

    rows = texts_of(docs, F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(tidy(run, "tokens"), "doc_id long, hilbert_key long, doc_tokens long, ids binary")


def cut_points(first: int, last: int, total: int, length: int) -> list[int]:
    """Sequence ends inside (first, last): every ``length`` ids; the rest of the last
    sequence is cut into powers of two, which need no padding."""
    full = total // length * length
    cuts = list(range((first // length + 1) * length, min(last, full + 1), length))
    at = full
    while at < total:
        at += 1 << ((total - at).bit_length() - 1)
        cuts.append(at)
    return [c for c in cuts if first < c < last]


def sequence_of(position: int, total: int, length: int) -> tuple[int, int]:
    """The number and first position of the sequence that holds a position."""
    full = total // length
    if position < full * length:
        return position // length, position // length * length
    number, at = full, full * length
    while True:
        size = 1 << ((total - at).bit_length() - 1)
        if position < at + size:
            return number, at
        number, at = number + 1, at + size


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, length: int = LENGTH) -> DataFrame:
    """Pack ``docs`` (doc_id, text) into sequences of ``length`` ids; one row per piece (``PIECES``).

    Documents are put in a row in the order of their Hilbert keys and cut every
    ``length`` ids; what is left at the very end is cut into powers of two, so no
    sequence is padded. Texts are encoded once and written to the shared folder;
    only keys and counts are range-sorted, and each range adds up its own counts.
    Ties of the key go by doc_id, so copies that share a key spread over ranges.
    Null texts have the end id only; rows with equal or null doc_id are all packed;
    an empty table has no pieces; further columns are ignored.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer or vocabulary()
    width = np.dtype(encoder(tokenizer).dtype)
    coded = tokens_with_key(docs, tokenizer, end_id)
    coded = stage(coded.withColumn("row", F.monotonically_increasing_id()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = 0
        for batch in batches:
            ends = held + np.cumsum(batch.column("doc_tokens").to_numpy())
            starts = ends - batch.column("doc_tokens").to_numpy()
            held = int(ends[-1]) if len(ends) else held
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(starts)], ["part", "row", "doc_tokens", "before"])

    keys = coded.select("row", "hilbert_key", "doc_id", "doc_tokens")
    order = ("hilbert_key", "doc_id", "row")
    ranged = keys.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    placed = ranged.select(F.spark_partition_id().alias("part"), "row", "doc_tokens")
    placed = stage(placed.mapInArrow(tidy(places, "tokens"), "part int, row long, doc_tokens long, before long"))
    sums = bases(placed, "part", "doc_tokens")
    # a row per range partition of the shuffle
    starts = placed.join(F.broadcast(sums), "part").select("row", (F.col("base") + F.col("before")).alias("first"), "total")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], [], [], []]
            flat, sizes = [], []
            columns = (batch.column(k).to_pylist() for k in ("doc_id", "hilbert_key", "first", "total"))
            for doc, key, first, total, ids in zip(*columns, batch.column("ids"), strict=True):
                ids = np.frombuffer(ids.as_buffer(), dtype=width)
                edges = [first, *cut_points(first, first + len(ids), total, length), first + len(ids)]
                wide = memoryview(ids.astype("<u4")).cast("B")
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    number, at = sequence_of(a, total, length)
                    crc = zlib.crc32(wide[4 * (a - first) : 4 * (b - first)])
                    for column, value in zip(out, (doc, a - first, b - a, crc, len(ids), number, a - at, key), strict=True):
                        column.append(value)
                flat.append(ids)
                sizes += [b - a for a, b in zip(edges[:-1], edges[1:], strict=True)]
            names = [x.split()[0] for x in PIECES.split(", ")]
            pieces = binaries(np.concatenate(flat) if flat else np.zeros(0, width), np.array(sizes, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out), pieces], names)

    whole = coded.select("row", "doc_id", "hilbert_key", "ids").join(starts, "row")
    return whole.select("doc_id", "hilbert_key", "first", "total", "ids").mapInArrow(tidy(cut, "tokens"), PIECES)


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, ids binary, doc_ids: the pieces of each sequence put together, at most ``length`` ids each."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))
    joined = F.aggregate("parts", F.lit(b""), lambda acc, p: F.concat(acc, p.ids))
    return (
        pieces.groupBy("sequence_id")
        .agg(parts.alias("parts"))
        .select("sequence_id", joined.alias("ids"), F.transform("parts", lambda p: p.doc_id).alias("doc_ids"))
    )


def op3_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 ids."""
    return pack(read(spark, sf_dir, "documents")).drop("ids")


QUERIES = {"op3_hilbert_packing": op3_hilbert_packing}
ORACLES: dict[str, str] = {}
