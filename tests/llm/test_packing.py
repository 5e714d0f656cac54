import zlib
from collections import defaultdict

import numpy as np
import pytest

from tabloom.llm.packing import cut_points, hilbert_key, op3_hilbert_packing, pack, sequence_of, sequences
from test_token_store import crc, ids_of


def check(pieces, rows, length):
    """Each id in exactly one piece; sequences gapless, at most ``length`` long, only powers of two below that."""
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_seq[p.sequence_id].append(p)
        by_doc[(p.doc_id, p.doc_tokens)].append(p)
    for got in by_seq.values():
        got.sort(key=lambda p: p.offset)
        assert [p.offset for p in got] == np.cumsum([0, *(p.length for p in got[:-1])]).tolist()
        total = sum(p.length for p in got)
        assert total <= length and (total == length or total & (total - 1) == 0)
    want = defaultdict(list)
    for (d, _), ids in zip(rows, ids_of([t for _, t in rows])):
        want[(d, len(ids))].append(ids)
    assert set(want) == set(by_doc)
    for key, copies in want.items():
        assert sum(p.length for p in by_doc[key]) == sum(map(len, copies))
        crcs = {(a, n): {crc(i[a : a + n]) for i in copies} for a, n in {(p.start, p.length) for p in by_doc[key]}}
        assert all(p.ids_crc32 in crcs[(p.start, p.length)] and p.length > 0 for p in by_doc[key])


def test_all_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check(op3_hilbert_packing(spark, sf).collect(), rows, 4096)


def test_hard_rows(spark, odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    pieces = pack(odd_docs, length=100)
    check(pieces.collect(), rows, 100)
    whole = {r.sequence_id: np.frombuffer(bytes(r.ids), "<u2") for r in sequences(pieces).collect()}
    for p in pieces.collect():
        assert zlib.crc32(whole[p.sequence_id][p.offset : p.offset + p.length].astype("<u4").tobytes()) == p.ids_crc32


def test_empty_table(no_docs):
    assert pack(no_docs).count() == 0


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (4, 2)])
def test_the_curve_visits_each_cell_and_steps_to_neighbours(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
    order = np.argsort(keys := hilbert_key(cells, bits))
    assert sorted(keys.tolist()) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[order], axis=0)).sum(axis=1) == 1).all()


def test_the_rest_is_cut_into_powers_of_two():
    assert cut_points(0, 2500, 2500, 4096) == [2048, 2304, 2432, 2496]
    assert cut_points(4000, 8200, 8200, 4096) == [4096, 8192]
    assert [sequence_of(p, 8200, 4096) for p in (0, 4096, 8192, 8199)] == [(0, 0), (1, 4096), (2, 8192), (2, 8192)]


def test_equal_texts_lie_together(spark):
    docs = spark.createDataFrame([(i, f"{'red green blue ' * 30}" if i % 2 else f"{'uno dos tres cuatro ' * 25}") for i in range(40)], "doc_id long, text string")
    out = [r.doc_id % 2 for r in pack(docs, length=10**6).orderBy("sequence_id", "offset").collect()]
    assert sum(a != b for a, b in zip(out, out[1:])) <= 3
