import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tabloom.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    covered = {i + o for i, w in enumerate(windows) if n[w] > 1 for o in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed), len(lines)


def vectors(counts, lines):
    n, chars, symbols, dup, rep, _ = counts
    return [int(np.floor(v * q.UNIT)) for v in (np.log(1 + chars / n), np.sqrt(symbols / chars), np.sqrt(dup / lines), np.sqrt(rep / n))]


def brute_mcd(x, steps=q.STEPS):
    """Squared distances after concentration steps, in numpy."""
    x = np.array(x, dtype=float)
    floor = np.diag([(f * q.UNIT) ** 2 for f in q.FLOORS.values()])
    mean = np.median(x, axis=0)
    scatter = np.diag((1.4826 * np.median(np.abs(x - mean), axis=0)) ** 2) + floor
    for step in range(steps + 1):
        d2 = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(scatter), x - mean)
        if step == steps:
            return d2
        bins = np.minimum(q.LAST_BIN, np.floor(np.sqrt(d2) * q.BINS_PER_UNIT))
        last = np.sort(bins)[int(np.ceil(q.SHARE * len(x))) - 1]
        near = x[bins <= last]
        mean, scatter = near.mean(axis=0), np.cov(near.T, bias=True) * q.CONSISTENCY + floor


def documents():
    rng = np.random.default_rng(2)
    rows = []
    for i in range(420):
        words = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(rng.integers(50, 90))]
        if i % 12 == 0:
            words = [w + "***" for w in words]
        rows.append((i, " ".join(words) + "\n" + ("same line\n" * (i % 3)), "en" if i % 7 else "fr", f"s{i % 2}"))
    rows += [(1000, None, None, None), (1001, "", "en", "s0"), (1002, "a b c " * 20_000, "en", "s0"), (1003, "x" * 200_000, "en", "s0")]
    rows += [(1004, " ".join(str(i) for i in range(30_000)), None, "s1"), (None, "w " * 60, "de", None), rows[5], (1005, "go go go stop", "en", "s1")]
    return rows


def test_statistics_and_distances(spark):
    rows = documents()
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({c: F.lit(1) for c in ("g", "n", "bin", "size", "words", "lines", "x1")})
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in q.quality_rules(frame).collect())
    assert got == sorted((str(d), *base(t)[0]) for d, t, _, _ in rows)
    groups = {}
    sizes = Counter((lang or "", s or "") for _, t, lang, s in rows if not base(t)[0][5])
    rest = Counter()
    for (lang, _), n in sizes.items():
        rest[lang] += n if n < q.MIN_GROUP else 0
    for d, t, lang, s in rows:
        counts, lines = base(t)
        if not counts[5]:
            lang, s = lang or "", s or ""
            key = (lang, s) if sizes[lang, s] >= q.MIN_GROUP else lang if rest[lang] >= q.MIN_GROUP else ""
            groups.setdefault(key, []).append((str(d), vectors(counts, lines)))
    want = {}
    for members in groups.values():
        for (d, _), d2 in zip(members, brute_mcd([v for _, v in members])):
            want[d] = d2
    out = {str(r.doc_id): r for r in q.quality_rules(frame).collect() if not r.base_failed}
    assert set(out) == set(want) and len(groups) == 3
    assert all(abs(out[d].d2 - want[d]) < 1e-6 * (1 + want[d]) and out[d].kept == (want[d] <= q.CUTOFF) for d in want)
    assert all(out[str(i)].kept == (i % 12 != 0) for i in range(420))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert q.quality_rules(none).count() == 0
    only_failed = spark.createDataFrame([(1, "short", "en", "s")], none.schema)
    assert [(r.base_failed, r.kept) for r in q.quality_rules(only_failed).collect()] == [(True, False)]


def test_no_python_in_the_plan(spark, sf):
    plan = q.op1_mcd_quality(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
