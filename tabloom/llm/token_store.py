"""Token-ID output: one wavelet matrix per shard of documents, in ascending doc_id order."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabloom.llm.common import bases, binaries, partitions, range_edges, read, shared_folder, slices, texts_of, tidy
from tabloom.llm.tokens import END_ID, encoder, vocabulary
from tabloom.llm.wavelet import WaveletMatrix

#: A shard is closed at the first document end past so many ids.
SHARD_IDS = 1 << 20
#: Range parts per shuffle partition, so that hashed parts fill partitions evenly.
FINER = 4
#: Encoding is nearly all the work here, so workers may remember more words and take larger slices of text.
MEMO, SLICE = 1_000_000, 8_000_000

SHARDS = "part int, shard int, first_in_part long, n_tokens long, n_docs long, content binary"


def encoded(docs: DataFrame, tokenizer: str, end_id: int, edges: list[int]) -> DataFrame:
    """part int, doc_id long, n_tokens long, ids binary: the ids of each whole text, and its range part."""
    cuts = np.array(edges, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, MEMO)
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                ids, counts = encode(batch.column("text"), end_id)
                doc = batch.column("doc_id")
                known = doc.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
                part = np.searchsorted(cuts, known, side="left").astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part), doc, pa.array(counts), binaries(ids, counts)], ["part", "doc_id", "n_tokens", "ids"]
                )

    rows = texts_of(docs, F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(tidy(run, "tokens"), "part int, doc_id long, n_tokens long, ids binary")


def write_shards(
    docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, shard_ids: int = SHARD_IDS
) -> None:
    """Write ``docs`` (doc_id, text) as shards at ``path``.

    A row of the Parquet container holds one self-contained shard file
    (``content``, see ``WaveletMatrix``), its range part and its number there.
    Shards are in ascending doc_id order: by part, then shard. Null texts have the
    end id only; a null doc_id is stored as the smallest long; rows with equal
    doc_id are all kept, ordered by their ids; further columns are ignored. An
    empty table has no shards.
    """
    tokenizer = tokenizer or vocabulary()
    count = partitions(docs.sparkSession)
    width = np.dtype(encoder(tokenizer).dtype)
    edges = range_edges(docs.select("doc_id"), "doc_id", FINER * count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray]] = []
        part, shard, first, size = -1, 0, 0, 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal held, shard, first, size
            if held:
                ids = np.concatenate([x for _, x in held])
                matrix = WaveletMatrix.build(ids, np.array([d for d, _ in held]), np.array([len(x) for _, x in held]))
                row = [part, shard, first, size, len(held), matrix.to_bytes()]
                names = [x.split()[0] for x in SHARDS.split(", ")]
                kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)
                held, shard, first, size = [], shard + 1, first + size, 0

        for batch in batches:
            parts, docs_ = (batch.column(k).fill_null(np.iinfo(np.int64).min if k else 0).to_pylist() for k in (0, 1))
            for p, d, ids in zip(parts, docs_, batch.column(2), strict=True):
                if p != part:
                    yield from close()
                    part, shard, first = p, 0, 0
                held.append((d, np.frombuffer(ids.as_buffer(), dtype=width)))
                size += len(held[-1][1])
                if size >= shard_ids:
                    yield from close()
        yield from close()

    rows = encoded(docs, tokenizer, end_id, edges).select("part", "doc_id", "ids")
    ordered = rows.repartition(count, "part").sortWithinPartitions("part", "doc_id", "ids")
    ordered.mapInArrow(tidy(run, "tokens"), SHARDS).write.option("compression", "none").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """The shards with ``start``: the ids in all shards before."""
    shards = spark.read.schema(SHARDS).parquet(path)
    sums = bases(shards.select("part", "n_tokens"), "part", "n_tokens").withColumnRenamed("part", "of")
    # a row per range part, at most FINER times the shuffle partitions of the writer
    joined = shards.join(F.broadcast(sums), shards.part == sums.of)
    return joined.select(*shards.columns, (F.col("base") + F.col("first_in_part")).alias("start"))


def documents_of(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, decoded from the shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, start in zip(batch.column("content"), batch.column("start").to_pylist(), strict=True):
                matrix = WaveletMatrix.from_bytes(content.as_py())
                ids = matrix.decode().astype("<u4")
                counts = np.diff(matrix.ends, prepend=0)
                starts = matrix.ends - counts
                view = memoryview(ids).cast("B")
                sums = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts.tolist(), matrix.ends.tolist(), strict=True)]
                missing = matrix.doc_ids == np.iinfo(np.int64).min
                yield pa.RecordBatch.from_arrays(
                    [pa.array(matrix.doc_ids, mask=missing), pa.array(start + starts), pa.array(counts), pa.array(sums, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return shards.select("content", "start").mapInArrow(tidy(run, "tokens"), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents as wavelet matrix shards, read the shards back, one row per document."""
    path = shared_folder(spark)
    write_shards(read(spark, sf_dir, "documents"), path)
    return documents_of(read_shards(spark, path))


QUERIES = {"op10_token_store": op10_token_store}
ORACLES: dict[str, str] = {}
