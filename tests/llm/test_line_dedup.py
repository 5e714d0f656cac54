import re

from pyspark.sql import functions as F

from tabloom.llm.line_dedup import remove_boilerplate

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, min_sites, min_words):
    sites, first = {}, {}
    for d, t, s in rows:
        for at, line in enumerate((t or "").split("\n") if t is not None else []):
            if len(WORD.findall(line)) >= min_words:
                sites.setdefault(line, set()).update([s] if s is not None else [])
                place = (d is None, d or 0, at)
                first[line] = min(first.get(line, place), place)
    out = []
    for d, t, _ in rows:
        lines = t.split("\n") if t is not None else []
        keep = [x for at, x in enumerate(lines) if len(sites.get(x, ())) < min_sites or first[x] == (d is None, d or 0, at)]
        out.append((d, None if t is None else "\n".join(keep), len(lines), len(lines) - len(keep)))
    return sorted(out, key=str)


def run(spark, rows, min_sites=3, min_words=2):
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(1) for c in ("parts", "mark", "at", "line", "n_lines", "first")})
    out = remove_boilerplate(frame, min_sites=min_sites, min_words=min_words)
    assert set(out.columns) == set(frame.columns) | {"n_removed"}
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in out.collect()), key=str)


def test_hard_rows(spark):
    rows = [(i, f"own line {i}\nshared by all\nword\nshared by all\n", f"s{i % 4}") for i in range(40)]
    rows += [(100 + i, "on two sites", f"s{i}") for i in range(2)] + [(110 + i, "only null sites", None) for i in range(5)]
    rows += [(200, "", "s0"), (201, None, "s1"), (202, "\n\n", None), (203, "shared by all\n" * 5000, "s2"), (None, "shared by all\nx y", "s3"), rows[3]]
    assert run(spark, rows) == brute(rows, 3, 2)


def test_lines_around_the_threshold_are_counted_exactly(spark):
    rows = [(1000 * n + k, f"line number {n}", f"site {k}") for n in range(30, 70) for k in range(n)]
    assert run(spark, rows, min_sites=50) == brute(rows, 50, 2)


def test_empty_table(spark):
    assert remove_boilerplate(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
