"""Exact dedup against history: a minimal perfect hash over known digests, slots with digest and winner.

A text's digest is the SHA-256 of its UTF-8 bytes without white space. The steps:

1. Historical rows are grouped by digest; each group has a winner.
2. The distinct digests are dealt into shards. A shard is one row: a minimal perfect hash
   of its digests (levels of bits, Limasset et al. 2017) and one slot per digest, which
   holds the whole digest, the winner's place and the group's size.
3. Arriving rows look up their digests. The hash leads any digest to some slot or none; only
   equal bytes in the slot make it a repeat. Repeats update winners and sizes of their slots,
   the others are grouped by digest on their own and become the second generation of shards.
4. All rows read their group's winner from the slots.

A shard with very many rows (copies of one text) is copied, and its rows are split over the copies.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabloom.llm.common import partitions, read, stage

#: Rows that share a shard on average, at most; bits a key of the first level.
SLOTS, GAMMA = 16_384, 2
#: Rows of a shard that one task takes: between these, as the table has it, but at least a millionth
#: of all rows, so that fewer than a million shards are split (their numbers are broadcast).
PIECE_LEAST, PIECE_MOST, SPLIT_SHARDS = 1024, 16_384, 1_000_000

#: A slot: the digest, then the winner (longest, then smallest doc_id, null last, then smallest row), then the group's rows.
SLOT = np.dtype([("digest", "<u8", 4), ("chars", "<i8"), ("unnamed", "?"), ("doc", "<i8"), ("row", "<i8"), ("size", "<i8")])
WINNER = ("chars", "unnamed", "doc", "row")
#: What a row is; the shards of the second generation hold the digests of new rows.
HISTORY, REPEAT, NEW = 1, 2, 3
INDEX = "gen int, shard long, levels string, bits binary, slots binary"

_ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _ODD[1]
    h = (h ^ (h >> np.uint64(27))) * _ODD[2]
    return h ^ (h >> np.uint64(31))


def places(keys: np.ndarray, level: int, width: int) -> np.ndarray:
    """A place below ``width`` of each key (four words) on a level."""
    h = np.full(len(keys), level + 1, np.uint64) * _ODD[0]
    for k in range(keys.shape[1]):
        h = _mix(h ^ keys[:, k]) + _ODD[0]
    return (h % np.uint64(width)).astype(np.int64)


@dataclass
class PerfectHash:
    """Numbers 0 to n - 1 for n distinct keys; any other key gets one of these numbers or -1.

    On each level a key that has its place alone sets a bit; the others go on to the
    next. A key's number is the count of bits before its own.
    """

    widths: list[int]
    words: np.ndarray

    def __post_init__(self) -> None:
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(counts) - counts

    @staticmethod
    def build(keys: np.ndarray) -> PerfectHash:
        widths, parts = [], []
        while len(keys):
            if len(widths) > 200:
                raise ValueError("keys of a perfect hash must be distinct")
            width = 64 * max(1, -(-GAMMA * len(keys) // 64))
            at = places(keys, len(widths), width)
            times = np.bincount(at, minlength=width)
            parts.append(np.packbits(times == 1, bitorder="little"))
            widths.append(width)
            keys = keys[times[at] > 1]
        return PerfectHash(widths, np.concatenate(parts).view("<u8") if parts else np.zeros(0, "<u8"))

    def find(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        left, first = np.arange(len(keys)), 0
        for level, width in enumerate(self.widths):
            if not len(left):
                break
            at = first + places(keys[left], level, width)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[left[hit]] = (self.before[at >> 6] + below)[hit]
            left, first = left[~hit], first + width
        return out


def words_of(digests: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Digests of 32 bytes as four words each."""
    return np.frombuffer(b"".join(digests.to_pylist()), "<u8").reshape(-1, 4)


def digest_rows(docs: DataFrame, historical: Column) -> DataFrame:
    """row, doc, digest, chars, old of each row of ``docs``, written: later steps read these, not the texts."""
    text = F.coalesce("text", F.lit(""))
    plain = text
    for sign in " \t\n\x0b\x0c\r":
        plain = F.replace(plain, F.lit(sign), F.lit(""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc"),
        F.unhex(F.sha2(plain, 256)).alias("digest"), F.length(text).cast("long").alias("chars"),
        F.coalesce(historical, F.lit(False)).alias("old"),
    )
    return stage(rows)


def grouped(rows: DataFrame, *by: str) -> DataFrame:
    """Winner and size of each group, combined before the shuffle."""
    place = F.struct((-F.col("chars")).alias("short"), F.col("doc").isNull().alias("unnamed"), F.coalesce("doc", F.lit(0)).alias("doc"), "row")
    found = rows.groupBy(*by).agg(F.min(place).alias("best"), F.count(F.lit(1)).alias("size"))
    return found.select(*by, (-F.col("best.short")).alias("chars"), "best.unnamed", "best.doc", "best.row", "size")


@dataclass
class Index:
    """Shards of digests: a table of ``INDEX`` that can be written, read again and looked up."""

    frame: DataFrame
    shards: int

    @staticmethod
    def build(groups: DataFrame, shards: int, gen: int = 1) -> Index:
        """``groups`` has each digest once, with the columns of a slot."""

        def one(table: pa.Table) -> pa.Table:
            keys = words_of(table.column("digest"))
            hashed = PerfectHash.build(keys)
            slots = np.zeros(len(keys), SLOT)
            at = hashed.find(keys)
            slots["digest"][at] = keys
            for name in (*WINNER, "size"):
                slots[name][at] = table.column(name).to_numpy()
            columns = [[gen], table.column("shard")[:1].to_pylist(), [json.dumps(hashed.widths)], [hashed.words.tobytes()], [slots.tobytes()]]
            kinds = (pa.int32(), pa.int64(), pa.string(), pa.binary(), pa.binary())
            return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["gen", "shard", "levels", "bits", "slots"])

        placed = groups.withColumn("shard", shard_of(shards))
        return Index(stage(placed.groupBy("shard").applyInArrow(one, INDEX)), shards)

    def updated(self, repeats: DataFrame) -> Index:
        """Winners and sizes with the ``repeats`` (shard, slot and the columns of a group, each slot once) taken in."""

        def one(shard: pa.Table, more: pa.Table) -> pa.Table:
            if not shard.num_rows or not more.num_rows:
                return shard
            slots = np.frombuffer(shard.column("slots")[0].as_py(), SLOT).copy()
            at = more.column("slot").to_numpy()
            old, new = slots[at], {n: more.column(n).to_numpy() for n in (*WINNER, "size")}
            better = np.zeros(len(at), bool)
            same = np.ones(len(at), bool)
            for name, sign in (("chars", -1), ("unnamed", 1), ("doc", 1), ("row", 1)):
                a, b = sign * new[name].astype(np.int64), sign * old[name].astype(np.int64)
                better |= same & (a < b)
                same &= a == b
            for name in WINNER:
                slots[name][at] = np.where(better, new[name], old[name])
            slots["size"][at] = old["size"] + new["size"]
            return shard.set_column(4, "slots", pa.array([slots.tobytes()], pa.binary()))

        both = self.frame.groupBy("shard").cogroup(repeats.groupBy("shard"))
        return Index(stage(both.applyInArrow(one, INDEX)), self.shards)


def shard_of(shards: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(shards))


def look_up(rows: DataFrame, index: DataFrame, shards: int, total: int) -> DataFrame:
    """``rows`` (kind, row, doc, digest, chars) with shard, slot and what the slot holds; all null where no slot has the digest.

    Rows meet the shard of their generation and digest. Where a shard has more rows
    than a piece takes, its rows are dealt over several copies of it.
    """
    spark = rows.sparkSession
    piece = max(PIECE_LEAST, min(PIECE_MOST, total // (2 * partitions(spark))), total // SPLIT_SHARDS)
    rows = rows.withColumn("shard", shard_of(shards)).withColumn("gen", F.when(F.col("kind") == NEW, 2).otherwise(1))
    counts = rows.groupBy(F.col("gen").alias("of_gen"), F.col("shard").alias("of_shard")).agg(F.count(F.lit(1)).alias("held"))
    # fewer than SPLIT_SHARDS rows, as each has a larger part of the total
    full = stage(counts.filter(F.col("held") > piece).select("of_gen", "of_shard", F.ceil(F.col("held") / piece).alias("pieces")))

    def pieces(side: DataFrame) -> DataFrame:
        same = (F.col("gen") == F.col("of_gen")) & (F.col("shard") == F.col("of_shard"))
        return side.join(F.broadcast(full), same, "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))

    left = pieces(rows).select("gen", "shard", F.pmod(F.xxhash64("row"), F.col("pieces")).alias("piece"), "kind", "row", "doc", "digest", "chars")
    right = pieces(index).select("gen", "shard", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), "levels", "bits", "slots")
    kinds = "kind int, shard long, row long, doc long, digest binary, chars long, slot long, keep_id long, keep_row long, size long"
    names = [k.split()[0] for k in kinds.split(", ")]

    def one(asked: pa.Table, shard: pa.Table) -> pa.Table:
        n = asked.num_rows
        slot, found = np.zeros(n, np.int64), np.zeros(n, bool)
        slots = np.zeros(1, SLOT)
        if n and shard.num_rows:
            keys = words_of(asked.column("digest"))
            slots = np.frombuffer(shard.column("slots")[0].as_py(), SLOT)
            hashed = PerfectHash(json.loads(shard.column("levels")[0].as_py()), np.frombuffer(shard.column("bits")[0].as_py(), "<u8"))
            slot = hashed.find(keys)
            found = slot >= 0
            slot = np.maximum(slot, 0)
            found &= (slots["digest"][slot] == keys).all(axis=1)
        held = slots[slot]
        out = [asked.column(c) for c in ("kind", "shard", "row", "doc", "digest", "chars")]
        out += [pa.array(slot, mask=~found), pa.array(held["doc"], mask=~found | held["unnamed"])]
        out += [pa.array(held[c], mask=~found) for c in ("row", "size")]
        return pa.table(out, names)

    met = left.groupBy("gen", "shard", "piece").cogroup(right.groupBy("gen", "shard", "piece"))
    return met.applyInArrow(one, kinds)


def dedup(docs: DataFrame, historical: Column) -> DataFrame:
    """doc_id, keep_id, group_size long, kept boolean, text_sha256, old, repeat boolean of each row of ``docs``.

    ``docs`` has doc_id and text; ``historical`` is a condition on its columns (null: no) that
    tells rows known before (``old``) from those that arrive; ``repeat`` marks arriving rows whose
    digest history holds. Texts are equal if they are without white space (null is empty). Of a
    group, historical or not, the row with the most code points stays, ties by the smaller
    doc_id (null last), then one of the equal rows. Further columns are ignored; an empty
    table gives no rows.
    """
    spark = docs.sparkSession
    rows = digest_rows(docs, historical)
    total = rows.count()
    shards = max(partitions(spark), -(-total // SLOTS))
    known, arriving = rows.filter("old").drop("old"), rows.filter("NOT old").drop("old")
    history = Index.build(grouped(known, "digest"), shards)
    probed = stage(look_up(arriving.withColumn("kind", F.lit(REPEAT)), history.frame, shards, total).select("shard", "slot", "row", "doc", "digest", "chars"))
    repeats, others = probed.filter("slot IS NOT NULL"), probed.filter("slot IS NULL")
    history = history.updated(grouped(repeats, "shard", "slot"))
    fresh = Index.build(grouped(others, "digest"), shards, gen=2)
    own = ["row", "doc", "digest", "chars"]
    every = known.select(F.lit(HISTORY).alias("kind"), *own).unionByName(
        probed.select(F.when(F.col("slot").isNull(), NEW).otherwise(REPEAT).alias("kind"), *own)
    )
    told = look_up(every, history.frame.unionByName(fresh.frame), shards, total)
    return told.select(
        F.col("doc").alias("doc_id"), "keep_id", F.col("size").alias("group_size"),
        (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
        (F.col("kind") == HISTORY).alias("old"), (F.col("kind") == REPEAT).alias("repeat"),
    )


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: three quarters of them (by a hash of doc_id) are history, the others arrive."""
    out = dedup(read(spark, sf_dir, "documents"), F.pmod(F.xxhash64("doc_id"), F.lit(4)) > 0)
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


QUERIES = {"op13_exact_dedup": op13_exact_dedup}
ORACLES = {
    "op13_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), r AS (
  SELECT *, row_number() OVER w AS place, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY length(text) DESC, doc_id NULLS LAST)
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM r
""",
}
