import hashlib
import math

from pyspark.sql import functions as F

from tabloom.llm import common, mixing
from tabloom.llm.mixing import mix


def brute(rows, weights, size=1.0):
    n = {}
    for _, _, s in rows:
        n[s] = n.get(s, 0) + 1
    w = {s: (c**0.5 if weights is None else weights.get(s, 0)) for s, c in n.items()}
    out = []
    for d, t, s in rows:
        rate = w[s] / sum(w.values()) * len(rows) * size / n[s]
        name = "null" if d is None else d
        u = int(hashlib.md5(f"{mixing.SEED}:{name}".encode()).hexdigest()[:13], 16) / 2**52
        k, p = 0, math.exp(-rate)
        c = p
        while c <= u and k < 10_000 and rate:
            k += 1
            p *= rate / k
            c += p
        out += [(str(d), str(t), str(s), i, k) for i in range(1, k + 1)]
    return sorted(out)


ROWS = [(i, f"text {i}", "big" if i % 5 else "small") for i in range(500)] + [(None, None, None), (7, "text 7", "big"), (900, "", "alone"), (901, "w " * 50_000, "alone")]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(1) for c in ("copy", "rate", "n", "steps", "own", "draw")})


def result(out):
    return sorted((str(r.doc_id), str(r.text), str(r.source), r.copy, r.copies) for r in out.select("doc_id", "text", "source", "copy", "copies").collect())


def test_counts_are_inverse_poisson(spark):
    assert result(mix(frame(spark))) == brute(ROWS, None)
    assert result(mix(frame(spark), {"big": 1.0, "small": 3.0}, 2.5)) == brute(ROWS, {"big": 1.0, "small": 3.0}, 2.5)


def test_many_sources_take_the_salted_join(spark, monkeypatch):
    monkeypatch.setattr(common, "SMALL", 1)
    assert result(mix(frame(spark))) == brute(ROWS, None)


def test_large_rates_do_not_underflow(spark):
    rows = [(0, "a", "one")] + [(i, "b", "rest") for i in range(1, 2000)]
    n = mix(frame(spark, rows), {"one": 1.0}).count()
    assert 1800 < n < 2200


def test_order_is_global(spark):
    out = mix(frame(spark)).select("shuffle_key").collect()
    keys = [r.shuffle_key for r in out]
    assert keys == sorted(keys)


def test_sources_get_their_weights(spark):
    rows = [(i, "x", "a" if i < 3000 else "b") for i in range(4000)]
    got = {r.source: r["count"] for r in mix(frame(spark, rows), {"a": 1.0, "b": 1.0}).groupBy("source").count().collect()}
    assert abs(got["a"] - 2000) < 200 and abs(got["b"] - 2000) < 200


def test_empty_table(spark):
    assert mix(frame(spark).limit(0)).count() == 0


def test_documents_without_id_are_drawn_one_by_one(spark):
    rows = [(None, f"text {i}", "hot") for i in range(3000)] + [(i, "x", "rest") for i in range(1000)]
    out = mix(frame(spark, rows), {"hot": 1.0, "rest": 3.0}).filter("source = 'hot'").collect()
    # a rate of a third: the one draw of the word null let all of them go
    assert abs(len(out) - 1000) < 130 and len({r.copies for r in out}) > 1
    assert len({r.shuffle_key for r in out}) == len(out)


def test_weights_of_several_columns(spark):
    """Groups by two columns, one of them with a null and one without weight, at rates that an expression gives."""
    rows = [(i, "x", f"s{i % 3}", None if i % 2 else "en") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, `my lang.a` string")
    weights = F.col("n") * F.when(F.col("source") == "s0", 0.0).when(F.col("`my lang.a`").isNull(), 4.0).otherwise(1.0)
    got = {(r[0], r[1]): r[2] for r in mix(docs, weights, by=("source", "my lang.a")).groupBy("source", "`my lang.a`").count().collect()}
    assert set(got) == {("s1", None), ("s1", "en"), ("s2", None), ("s2", "en")}
    assert all(abs(got[s, None] - 2400) < 250 and abs(got[s, "en"] - 600) < 130 for s in ("s1", "s2"))


def test_a_rate_of_many_thousands_takes_steps_in_proportion(spark):
    rows = [(0, "a", "one")] + [(i, "b", "rest") for i in range(1, 3)]
    assert abs(mix(frame(spark, rows), {"one": 1.0}, size=20_000).count() - 60_000) < 1500
