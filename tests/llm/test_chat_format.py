import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from tabloom.llm import chat_format
from tabloom.llm.chat_format import format_chats, op2_chat_format, parse_chats

HARD = [
    (1, 0, "user", "<|end|> <|turn:user|>"), (1, 1, "user", "<\\|next|>"), (1, 2, "assistant", "<\\\\|"), (1, 3, "assistant", None),
    (1, 4, None, "no role"), (1, 5, "a|b%7C%", "|>x"), (1, 6, "end", "ends with <"), (1, 7, "end", "|starts"), (1, 8, "next", "\\"),
    (2, None, "assistant", "é日本<|"), (2, 1, "user", ""), (2, 1, "user", ""), (2, 1, "tool", "tie"), (None, 0, "assistant", "no id"),
    (3, 0, "assistant", "word " * 50_000),
]


def by_conversation(rows):
    found = defaultdict(list)
    for c, n, r, t in rows:
        found[c].append((n is not None, n or 0, r or "", t or ""))
    return {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in found.items()}


def frame(spark, rows):
    out = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return out.withColumns({c: F.lit(1) for c in ("turns", "runs", "pieces", "said", "formatted")})


def test_hard_texts_come_back(spark):
    chats = format_chats(frame(spark, HARD))
    back = {r.conv_id: r for r in parse_chats(chats).collect()}
    want = by_conversation(HARD)
    assert {c: [tuple(t) for t in r.turns] for c, r in back.items()} == want
    assert {c: r.learned for c, r in back.items()} == {c: "".join(t for r, t in x if r == "assistant") for c, x in want.items()}


def test_neighbours_of_a_role_share_a_turn(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")]
    assert format_chats(frame(spark, rows)).first().formatted == "<|turn:user|>a<|next|>b<|end|><|turn:assistant|>c<|end|>"


def test_texts_without_control_strings_stay_as_they_are(spark):
    assert "</s>[INST] a < b | c \\ [/INST]" in format_chats(frame(spark, [(1, 0, "user", "</s>[INST] a < b | c \\ [/INST]")])).first().formatted


def test_empty_table(spark):
    assert parse_chats(format_chats(frame(spark, HARD).limit(0))).count() == 0


def test_query_against_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    want = {}
    for c, turns in by_conversation(rows).items():
        learned = "".join(t for r, t in turns if r == "assistant")
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want[c] = (len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(learned), digest(learned))
    assert {r.conv_id: tuple(r)[1:5] for r in op2_chat_format(spark, sf).collect()} == want


def test_long_conversations_take_time_in_proportion(spark):
    """Turn arrays are cut, not copied turn by turn: 32,000 turns of two roles in few seconds."""
    import time

    turns = spark.range(32_000).selectExpr(
        "CAST(1 AS BIGINT) AS conv_id", "id AS turn", "IF(id % 3 = 0, 'user', 'assistant') AS role", "concat('text ', id, repeat(' <| é', 5)) AS text"
    )
    back = parse_chats(format_chats(turns))
    start = time.time()
    row = back.collect()[0]
    assert time.time() - start < 20
    said = [f"text {i}" + " <| é" * 5 for i in range(32_000)]
    assert [t.text for t in row.turns] == said and row.learned == "".join(t for i, t in enumerate(said) if i % 3)


def test_sums_before(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "ADDED", 4)
    rows = spark.createDataFrame([(list(range(n)),) for n in (0, 1, 3, 4, 5, 8, 30)], "v array<long>")
    for v, got in rows.select("v", chat_format.sums_before(F.col("v"))).collect():
        assert got == [sum(v[:i]) for i in range(len(v))]
