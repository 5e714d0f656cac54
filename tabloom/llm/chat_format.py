r"""Chat formatting in Spark expressions: sorted turns, merged neighbours, a reversible template.

    <|turn:user|>first text<|next|>second text of the same role<|end|><|turn:assistant|>…<|end|>

Control strings open with ``<|``. Inside texts, ``<``, any backslashes and ``|`` get
one backslash more, so no text contains an opening and one backslash less
restores it; other texts stay as they are. In roles ``%`` and ``|`` are written as
``%25`` and ``%7C``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabloom.llm.common import read

OPEN, CLOSE, NEXT, END = "<|turn:", "|>", "<|next|>", "<|end|>"
LEARNED = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("|"), F.lit("%7C"))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("%7C"), F.lit("|")), F.lit("%25"), F.lit("%"))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, not for each element of an array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def merged(turns: Column) -> Column:
    """Neighbours of one role as one struct of the role and its texts.

    Each place where the role changes opens a run, which is cut out of the array whole: the work grows with the turns.
    """

    def runs(t: Column) -> Column:
        opens = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (i == 0) | (F.get(t, i)["role"] != F.get(t, i - 1)["role"]))

        def cut(at: Column, end: Column) -> Column:
            texts = F.transform(F.slice(t, at + 1, end - at), lambda x: x["text"])
            return F.struct(F.get(t, at)["role"].alias("role"), texts.alias("texts"))

        return let(opens, lambda o: F.zip_with(o, F.concat(F.slice(o, F.lit(2), F.size(o)), F.array(F.size(t))), cut))

    return let(turns, runs)


#: Numbers that are added up by one array aggregation, which copies what it has for each.
ADDED = 128


def sums_before(numbers: Column) -> Column:
    """For each number the sum of those before it: within blocks, then over the blocks' totals."""

    def running(values: Column) -> Column:
        return F.aggregate(values, F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    def placed(n: Column) -> Column:
        count = F.ceil(F.size(n) / ADDED).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda b: running(F.slice(n, b * ADDED + 1, ADDED)))

        def joined(blocks: Column) -> Column:
            bases = running(F.transform(blocks, lambda x: F.element_at(x, -1)))
            shifted = F.zip_with(
                blocks, F.slice(bases, F.lit(1), F.size(blocks)), lambda x, base: F.transform(F.slice(x, F.lit(1), F.size(x) - 1), lambda v: v + base)
            )
            return F.flatten(shifted)

        return let(blocks, joined)

    return let(numbers, placed)


def segments(runs: Column, learned: str) -> Column:
    """What the formatted text is put together from: struct of the string and whether it is learned."""

    def piece(text: Column | str, loss: Column | bool) -> Column:
        return F.struct((F.lit(text) if isinstance(text, str) else text).alias("text"), (F.lit(loss) if isinstance(loss, bool) else loss).alias("loss"))

    def of_run(run: Column) -> Column:
        opening = F.concat(F.lit(OPEN), escape_role(run["role"]), F.lit(CLOSE))
        texts = F.transform(
            run["texts"],
            lambda t, i: F.array(piece(F.when(i == 0, opening).otherwise(F.lit(NEXT)), False), piece(escape(t), run["role"] == learned)),
        )
        return F.concat(F.flatten(texts), F.array(piece(END, False)))

    return F.flatten(F.transform(runs, of_run))


def loss_spans(pieces: Column) -> Column:
    """Byte offsets in the UTF-8 text: start from 0, and length, of each learned piece."""

    def spans(p: Column) -> Column:
        lengths = F.transform(p, lambda x: F.octet_length(x["text"]).cast("long"))
        placed = F.zip_with(
            p, sums_before(lengths), lambda x, at: F.struct(at.alias("start"), F.octet_length(x["text"]).cast("long").alias("length"), x["loss"].alias("loss"))
        )
        return F.transform(F.filter(placed, lambda x: x["loss"]), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")))

    return let(pieces, spans)


def format_chats(turns: DataFrame, learned: str = LEARNED) -> DataFrame:
    """conv_id, formatted string, loss_spans of each conversation; ``turns`` has conv_id, turn, role, text.

    Turns are sorted by turn (null first), ties by role, then text; repeated rows
    are kept. Null roles and texts are empty; a null conv_id is a conversation of
    its own; an empty table gives none; further columns are ignored. A
    conversation is one output row, so it is gathered whole, as its text must be.
    """
    clean = turns.select(
        "conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("said")
    )
    sorted_ = clean.groupBy("conv_id").agg(F.array_sort(F.collect_list("said")).alias("turns"))
    pieces = sorted_.select("conv_id", merged(F.col("turns")).alias("runs")).select("conv_id", segments(F.col("runs"), learned).alias("pieces"))
    text = F.array_join(F.transform("pieces", lambda p: p["text"]), "")
    return pieces.select("conv_id", text.alias("formatted"), loss_spans(F.col("pieces")).alias("loss_spans"))


def parse_chats(chats: DataFrame) -> DataFrame:
    """conv_id, turns (array of role and text) and learned (string), read back from formatted chats."""

    def texts(run: Column) -> Column:
        role = unescape_role(F.substr(F.substring_index(run, CLOSE, 1), F.lit(len(OPEN) + 1)))
        body = F.substr(run, F.instr(run, F.lit(CLOSE)) + len(CLOSE))
        return F.transform(F.split(body, NEXT.replace("|", r"\|"), -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    runs = F.split("formatted", END.replace("|", r"\|"), -1)
    # behind the last end there is nothing
    turns = let(runs, lambda r: F.flatten(F.transform(F.slice(r, F.lit(1), F.size(r) - 1), lambda run: texts(run))))

    def parts(raw: Column) -> Column:
        return F.transform("loss_spans", lambda s: unescape(F.substr(raw, (s["start"] + 1).cast("int"), s["length"].cast("int")).cast("string")))

    learned = F.array_join(let(F.col("formatted").cast("binary"), parts), "")
    return chats.select("conv_id", turns.alias("turns"), learned.alias("learned"), "formatted")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format all conversations and one that quotes control strings; digests of what is read back."""
    quoted = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(LEARNED).alias("role"), F.lit(quoted).alias("text"),
    )
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = parse_chats(format_chats(turns))
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


QUERIES = {"op2_chat_format": op2_chat_format}
ORACLES = {
    "op2_chat_format": rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), m AS (
  SELECT *, lag(role) OVER w IS DISTINCT FROM role AS opens, lead(role) OVER w IS DISTINCT FROM role AS closes
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g'))
         + CASE WHEN opens THEN {len(OPEN) + len(CLOSE)} + length(replace(replace(role, '%', '%25'), '|', '%7C')) ELSE {len(NEXT)} END
         + CASE WHEN closes THEN {len(END)} ELSE 0 END) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id
""",
}
