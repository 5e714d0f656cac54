import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.llm import exact_dedup
from tabloom.llm.exact_dedup import PerfectHash, dedup, op13_exact_dedup

BLANKS = dict.fromkeys(map(ord, " \t\n\x0b\x0c\r"))


def brute(rows):
    """doc_id, keep_id, group_size, kept, text_sha256 of (doc_id, text)."""
    groups = {}
    for k, (d, t) in enumerate(rows):
        groups.setdefault((t or "").translate(BLANKS), []).append(k)
    out = []
    for text, members in groups.items():
        best = min(members, key=lambda k: (-len(rows[k][1] or ""), rows[k][0] is None, rows[k][0] or 0, k))
        digest = hashlib.sha256(text.encode()).hexdigest()
        out += [(rows[k][0], rows[best][0], len(members), k == best, digest) for k in members]
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r)[:5] for r in df.collect()), key=str)


def test_query_against_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert result(op13_exact_dedup(spark, sf)) == brute(rows)


@pytest.mark.parametrize("share", [0, 1, 2, 4])
def test_history_never_changes_the_groups(spark, monkeypatch, share):
    """Most rows are copies of one text; shards are small, and full ones are split."""
    monkeypatch.setattr(exact_dedup, "SLOTS", 20)
    monkeypatch.setattr(exact_dedup, "PIECE_LEAST", 16)
    monkeypatch.setattr(exact_dedup, "PIECE_MOST", 16)
    rng = np.random.default_rng(share)
    rows = [(int(k), "hot" + " " * int(rng.integers(0, 4))) for k in rng.permutation(400)]
    rows += [(int(1000 + k), f"text {rng.integers(0, 150)}\t{' ' * int(rng.integers(0, 3))}") for k in range(500)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    found = dedup(frame, F.col("doc_id") % 4 < share)
    assert result(found) == brute(rows)
    known = {(t or "").translate(BLANKS) for d, t in rows if d % 4 < share}
    told = {r.doc_id: (r.old, r.repeat) for r in found.collect()}
    assert told == {d: (d % 4 < share, d % 4 >= share and t.translate(BLANKS) in known) for d, t in rows}


def test_hard_rows(spark, odd_docs, no_docs):
    rows = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    for historical in (F.col("doc_id") < 4, F.lit(None).cast("boolean"), F.lit(True)):
        assert result(dedup(odd_docs, historical)) == brute(rows)
        assert dedup(no_docs, historical).count() == 0
    more = [(None, "a b"), (None, "ab "), (5, "ab"), (5, "ab"), (3, None), (2, " "), (1, ""), (9, "\x85é a0"), (8, "é a0"), (7, "x\x0b\x0cy"), (6, "xy")]
    frame = spark.createDataFrame(more, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("row", "doc", "digest", "shard", "old", "my col", "a.b")})
    assert result(dedup(frame, F.col("doc_id") > 3)) == brute(more)


def test_perfect_hash_numbers_its_keys_and_others_somewhere():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 63, 64, 65, 1000, 20_000):
        keys = rng.integers(0, 2**63, (n, 4)).astype(np.uint64)
        hashed = PerfectHash.build(keys)
        assert sorted(hashed.find(keys).tolist()) == list(range(n))
        strangers = hashed.find(rng.integers(0, 2**63, (500, 4)).astype(np.uint64))
        assert strangers.min() >= -1 and strangers.max(initial=-1) < max(n, 1)
    # keys that share three of four words are still told apart
    near = np.zeros((500, 4), np.uint64)
    near[:, 2] = np.arange(500)
    assert sorted(PerfectHash.build(near).find(near).tolist()) == list(range(500))
    with pytest.raises(ValueError, match="distinct"):
        PerfectHash.build(np.zeros((2, 4), np.uint64))
