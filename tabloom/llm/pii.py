"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The field labels words that hold a digit or an at sign; all other words can only
be outside, so a text falls apart into short runs of such words, which are decoded
on their own with the outside label around them: the same labels as over the whole
text. It is trained from a small labelled table, most of it generated by rule, and decoded by
Viterbi, all runs of a batch side by side in numpy. It also decides where one value of a run
ends and the next begins, which the patterns cannot tell.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabloom.llm.common import BLANK, read, slices, texts_of, tidy

KINDS = ("email", "ip", "card", "phone")
STATES = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
K = len(STATES)
#: Hashed features; labelled rows that a fit takes at most.
FEATURES, MAX_ROWS = 1 << 13, 5000

MARKED = re.compile("[0-9@]")
BLANKS = re.compile(f"[{BLANK}]")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NOT_DIGIT = re.compile("[^0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the e-mail pattern, found from each at sign, so long words cost no more than their length."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and LOCAL.match(text[start - 1]):
            start -= 1
        found = DOMAIN.match(text, at) if start < at else None
        done = found.end() if found else at + 1
        if found:
            yield start, done
        at = text.find("@", done)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns, by start, then kind as listed."""
    out = []
    if "@" in text:
        out += [("email", a, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def marked_runs(text: str) -> Iterator[list[tuple[int, int]]]:
    """Runs of neighbouring words that hold a digit or an at sign; each place is looked at a bounded number of times."""
    run: list[tuple[int, int]] = []
    done, m = 0, MARKED.search(text)
    while m:
        start = max([done, *(text.rfind(c, done, m.start()) + 1 for c in " \t\n\x0b\x0c\r")])
        gap = BLANKS.search(text, m.end())
        end = gap.start() if gap else len(text)
        if run and text[run[-1][1] : start].strip(" \t\n\x0b\x0c\r"):
            yield run
            run = []
        run.append((start, end))
        done = end
        m = MARKED.search(text, end)
    if run:
        yield run


#: Words longer than this are seen by their first and last characters.
SEEN = 48
SHAPES = str.maketrans({**{chr(c): "d" for c in range(48, 58)}, **{chr(c): "x" for c in range(97, 123)}, **{chr(c): "X" for c in range(65, 91)}})


def shape(word: str) -> str:
    if len(word) > SEEN:
        word = word[: SEEN // 2] + word[-SEEN // 2 :]
    return word.translate(SHAPES)


def sum_check(word: str) -> str:
    """Whether as many digits as a card number has add up like one."""
    if not 14 <= len(word) <= SEEN:
        return "none"
    digits = NOT_DIGIT.sub("", word)
    return str(luhn(digits)) if 14 <= len(digits) <= 19 else "none"


def feature_rows(text: str, run: list[tuple[int, int]]) -> list[list[int]]:
    """Hashed features of each word of a run: shapes, digit counts, and the words next to it."""
    shapes = [shape(text[a:b].strip("!*$%&#,;:?\"'")) for a, b in run]
    ahead = text[max(0, run[0][0] - 24) : run[0][0]].split()[-1:] or ["^"]
    after = text[run[-1][1] : run[-1][1] + 24].split()[:1] or ["$"]
    together = sum_check("".join(text[a:b] for a, b in run)) if run[-1][1] - run[0][0] <= SEEN else "none"
    rows = []
    for k, s in enumerate(shapes):
        alone = sum_check(text[slice(*run[k])])
        before = "=" + shapes[k - 1] if k else "w" + ahead[0].strip(".,:;").lower()
        behind = "=" + shapes[k + 1] if k + 1 < len(shapes) else "w" + after[0].strip(".,:;").lower()
        short = re.sub(r"(.)\1+", r"\1", s)
        names = [
            "bias", f"s:{s}", f"c:{short}", f"d:{min(s.count('d'), 20)}", f"@{s.count('@')}.{min(3, s.count('.'))}-{min(3, s.count('-'))}",
            f"b:{before}", f"a:{behind}", f"bs:{before}|{s}", f"as:{s}|{behind}", f"f:{s[:1]}", f"l:{len(shapes) == 1}{short}", f"x:{'x' in s or 'X' in s}{'d' in s}",
            f"t:{together}", f"o:{alone}", f"to:{together}{alone}",
        ]
        rows.append([zlib.crc32(n.encode()) % FEATURES for n in names])
    return rows


@dataclass
class Field:
    """Weights of features by state, and of transitions; row K of ``moves`` starts a run, column K ends it."""

    weights: np.ndarray
    moves: np.ndarray

    def emissions(self, rows: np.ndarray) -> np.ndarray:
        return self.weights[rows].sum(axis=1)

    def viterbi(self, emissions: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The best states of all words; runs lie one after another and advance together."""
        starts = np.cumsum(lengths) - lengths
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        best = emissions[starts] + self.moves[K, :K]
        back = np.zeros((len(emissions), K), dtype=np.int8)
        last = np.zeros((len(lengths), K))
        for t in range(1, int(lengths.max(initial=0)) + 1):
            live = int(np.searchsorted(-lengths, -t, side="left"))  # runs longer than t come first
            last[live : len(best)] = best[live:]
            if not live:
                break
            paths = best[:live, :, None] + self.moves[None, :K, :K]
            back[starts[:live] + t] = paths.argmax(axis=1)
            best = paths.max(axis=1) + emissions[starts[:live] + t]
        state = (last + self.moves[:K, K]).argmax(axis=1)
        out = np.zeros(len(emissions), dtype=np.int8)
        for t in range(int(lengths.max(initial=0)) - 1, -1, -1):
            live = int(np.searchsorted(-lengths, -t, side="left"))
            at = starts[:live] + t
            out[at] = state[:live]
            state[:live] = back[at, state[:live]]
        return out


def allowed_moves() -> np.ndarray:
    """0 where a transition may be, else -inf: an inner state follows its own kind only."""
    moves = np.zeros((K + 1, K + 1))
    for b, name in enumerate(STATES):
        if name[0] == "I":
            own = {STATES.index("B" + name[1:]), b}
            moves[[a for a in range(K + 1) if a not in own], b] = -np.inf
    return moves


def fit_field(rows: list[np.ndarray], states: list[np.ndarray], penalty: float = 0.02, steps: int = 400) -> Field:
    """Maximise the penalised likelihood of labelled runs: forward-backward for the gradient, Adam for the steps.

    Runs of a length are worked on together. Stops when the gradient is small.
    """
    weights, moves, allowed = np.zeros((FEATURES, K)), np.zeros((K + 1, K + 1)), allowed_moves()
    by_length = {}
    for r, s in zip(rows, states, strict=True):
        by_length.setdefault(len(s), []).append((r, s))
    groups = [(np.stack([r for r, _ in g]), np.stack([s for _, s in g])) for g in by_length.values()]
    # the features of all words in the order in which the loops below meet them
    flat = np.concatenate([features[:, t].ravel() for features, gold in groups for t in range(gold.shape[1])])
    each = groups[0][0].shape[2]
    first = [np.zeros_like(weights), np.zeros_like(moves)]
    second = [np.zeros_like(weights), np.zeros_like(moves)]
    for step in range(1, steps + 1):
        slope_w, slope_m = -penalty * weights, -penalty * moves
        full = moves + allowed
        errors = []
        for features, gold in groups:
            n, length = gold.shape
            scores = weights[features].sum(axis=2)
            ahead, behind = np.zeros((length, n, K)), np.zeros((length, n, K))
            ahead[0] = scores[:, 0] + full[K, :K]
            for t in range(1, length):
                ahead[t] = np.logaddexp.reduce(ahead[t - 1][:, :, None] + full[None, :K, :K], axis=1) + scores[:, t]
            behind[-1] = full[:K, K]
            for t in range(length - 2, -1, -1):
                behind[t] = np.logaddexp.reduce(full[None, :K, :K] + (scores[:, t + 1] + behind[t + 1])[:, None, :], axis=2)
            whole = np.logaddexp.reduce(ahead[-1] + behind[-1], axis=1)
            for t in range(length):
                error = -np.exp(ahead[t] + behind[t] - whole[:, None])
                error[np.arange(n), gold[:, t]] += 1
                errors.append(error)
                if t == 0:
                    slope_m[K, :K] += error.sum(axis=0)
                else:
                    pairs = ahead[t - 1][:, :, None] + full[None, :K, :K] + (scores[:, t] + behind[t])[:, None, :] - whole[:, None, None]
                    slope_m[:K, :K] -= np.exp(pairs).sum(axis=0)
                    np.add.at(slope_m, (gold[:, t - 1], gold[:, t]), 1)
                if t == length - 1:
                    slope_m[:K, K] += error.sum(axis=0)
        error = np.repeat(np.concatenate(errors), each, axis=0)
        for k in range(K):
            slope_w[:, k] += np.bincount(flat, weights=error[:, k], minlength=FEATURES)
        slope_m[~np.isfinite(allowed)] = 0
        slope_m[K, K] = 0
        for k, (value, slope) in enumerate(((weights, slope_w), (moves, slope_m))):
            first[k] = 0.9 * first[k] + 0.1 * slope
            second[k] = 0.99 * second[k] + 0.01 * slope**2
            value += 0.1 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
        if max(np.abs(slope_w).max(), np.abs(slope_m).max()) < 0.02:
            break
    return Field(weights, moves + allowed)


#: Fixed values of the labelled table: texts around a value, values of each kind, and numbers that are not personal.
AROUND = (
    "please call {} tonight", "write to {} about the offer", "contact: {}", "{}", "the office is at {} now", "tel. {}, room",
    "send it to {}.", "it was {} in the report", "sum of {} items", "my number is {}!", "und {} der", "la {} de", "that {}*** this", "reach {}%%% or wait",
)
VALUES = {
    "phone": (
        "+1 (212) 555-0188", "+44 20 7946 0958", "+49-30-901820-11", "(212) 555-0188", "(415) 555-0132", "212-555-0147", "646-555-0199",
        "1-800-555-0101", "+1 (499) 555-6503", "+33 1 99 00 12 34", "(303) 555 0144", "303.555.0177",
    ),
    "email": ("jo.doe@site.org", "a.lee22@mail5.example.com", "info@shop-online.co.uk", "sam_99@mailhost", "k.o@intranet", "x.y07@mail2.example.com"),
    "ip": ("10.0.0.1", "192.168.14.3", "8.8.4.4", "172.16.254.1:8080", "203.0.113.77:443"),
    "card": ("4111 1111 1111 1111", "5500-0000-0000-0004", "4012888888881881", "378282246310005"),
}
PLAIN = (
    "42", "1999", "3.14", "2024-05-17", "12:30", "44657", "0997523947200283", "1,250", "v2.0", "2.0.", "7%", "no 5", "1eb9c654e721b4f812088970e66a6345cee33dd6",
    "100 200 300", "2", "10 000", "3x4", "A4", "ISBN 9783161484100", "@home", "x @ y", "17/05/2024", "1.2", "5 6 7 8 9", "1234 5678 9012 3456", "2.0",
    "555", "1-2", "(3)", "(2019)", "2019-2024", "0x1f", "b2b", "99.5", "+5", "#12", "1st", "80/20", "5-1", "api_3f9c2b71d04e",
)


#: Generated rows of the labelled table, and the letters of their words.
GENERATED, LETTERS = 1200, "abcdefghijklmnopqrstuvwxyz"


def personal_value(kind: str, rng: random.Random) -> str:
    """A random value of a kind in one of its usual forms; ``d`` stands for a digit."""

    def filled(form: str) -> str:
        return re.sub("d", lambda _: str(rng.randrange(10)), form)

    def word(low: int = 2, high: int = 8) -> str:
        return "".join(rng.choice(LETTERS) for _ in range(rng.randint(low, high)))

    if kind == "phone":
        code = str(rng.randint(1, 99))
        return filled(rng.choice((f"+{code} (ddd) ddd-dddd", f"+{code} dd dddd dddd", f"+{code}-dd-dddddd-dd", f"+{code} ddd ddd dddd", "(ddd) ddd-dddd", "ddd-ddd-dddd", "1-800-ddd-dddd")))
    if kind == "email":
        local = word() + rng.choice(("", "." + word(), filled("dd"), "_" + filled("d")))
        return local + "@" + word(3, 9) + rng.choice(("", "", "." + word(2, 3), filled("d.") + word() + ".com", "-" + word() + ".org"))
    if kind == "ip":
        return ".".join(str(rng.randrange(256)) for _ in range(4)) + rng.choice(("", "", f":{rng.randint(80, 9000)}"))
    digits = filled(rng.choice(("4", "5")) + "d" * rng.choice((14, 14, 14, 13)))
    digits += next(n for n in "0123456789" if luhn(digits + n))
    sign = rng.choice(("", " ", "-")) if len(digits) == 16 else ""
    return sign.join(digits[i : i + 4] for i in range(0, len(digits), 4)) if sign else digits


def plain_value(rng: random.Random) -> str:
    """A random number, date, amount, version or key that is not personal."""
    form = rng.choice(("d", "dd", "ddd", "dddd", "ddddd", "dddddddd", "ddddddddd", "d.d", "dd.dd", "d,ddd", "dddd-0d-1d", "1d:dd", "dd%", "d.d.d", "no d", "dd/0d/dddd", "(dddd)", "#dd", "xdd", "hex", "long", "d d d"))
    if form == "hex":
        return "".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(12, 40))) + "7f"
    if form == "long":
        digits = "".join(str(rng.randrange(10)) for _ in range(rng.randint(12, 18))) + "0"
        return digits if not luhn(digits) else digits[:-1] + "1"
    return re.sub("d", lambda _: str(rng.randrange(10)), form)


def generated(count: int, seed: int) -> list[tuple[str, str]]:
    """Texts with one to four values each, words, numbers and punctuation directly before and behind them, and their spans."""
    rng = random.Random(seed)
    rows = []
    for _ in range(count):
        text, spans = "", []
        for _ in range(rng.randint(1, 4)):
            for _ in range(rng.choice((0, 0, 1, 3))):
                text += "".join(rng.choice(LETTERS) for _ in range(rng.randint(1, 9))) + rng.choice((" ", " ", ". ", ", "))
            kind = rng.choice((*KINDS, "", ""))
            value = personal_value(kind, rng) if kind else plain_value(rng)
            if kind:
                spans.append(f"{kind}:{len(text)}:{len(text) + len(value)}")
            text += value + rng.choice((" ", " ", " ", ". ", ", ", "! "))
        for _ in range(rng.choice((0, 2))):
            text += "".join(rng.choice(LETTERS) for _ in range(rng.randint(1, 9))) + " "
        rows.append((text.rstrip(), ",".join(spans)))
    return rows


def labelled_table(spark: SparkSession, seed: int = 1) -> DataFrame:
    """text, spans ("kind:start:end", comma-joined): every fixed value in some of the texts around it, and generated rows."""
    rows = []
    values = [(k, v) for k, vs in VALUES.items() for v in vs] + [("", v) for v in PLAIN]
    for n, (kind, value) in enumerate(values):
        for step in range(4):
            around = AROUND[(n + 4 * step) % len(AROUND)]
            start = around.index("{}")
            rows.append((around.format(value), f"{kind}:{start}:{start + len(value)}" if kind else ""))
    return spark.createDataFrame(rows + generated(GENERATED, seed), "text string, spans string")


def fit(labelled: DataFrame) -> Field:
    """The field of a small labelled table (text, spans); at most ``MAX_ROWS`` rows are taken, in order of their texts."""
    rows, states = [], []
    for r in labelled.orderBy("text", "spans").limit(MAX_ROWS).collect():
        spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in (r.spans or "").split(",") if s)]
        for run in marked_runs(r.text or ""):
            named = []
            for a, b in run:
                hit = next((s for s in spans if s[1] < b and a < s[2]), None)
                named.append(STATES.index(f"{'B' if a <= hit[1] else 'I'}-{hit[0]}") if hit else 0)
            rows.append(np.array(feature_rows(r.text, run)))
            states.append(np.array(named))
    return fit_field(rows, states) if rows else Field(np.zeros((FEATURES, K)), allowed_moves())


def field_spans(field: Field, texts: list[str]) -> list[list[tuple[str, int, int]]]:
    """Spans that the field finds in each text, cut to where letters, digits, + and brackets begin and end."""
    owner, runs, features = [], [], []
    for n, text in enumerate(texts):
        for run in marked_runs(text):
            owner.append(n)
            runs.append(run)
            features += feature_rows(text, run)
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    if not runs:
        return out
    states = field.viterbi(field.emissions(np.array(features)), np.array([len(r) for r in runs]))
    at = 0
    for n, run in zip(owner, runs, strict=True):
        own, at = states[at : at + len(run)], at + len(run)
        for k in np.flatnonzero(own % 2 == 1).tolist():
            end = k + 1
            while end < len(run) and own[end] == own[k] + 1:
                end += 1
            start, stop, text = run[k][0], run[end - 1][1], texts[n]
            while start < stop and not (text[start].isalnum() or text[start] in "+("):
                start += 1
            while start < stop and not (text[stop - 1].isalnum() or text[stop - 1] == ")"):
                stop -= 1
            if start < stop:
                out[n].append((KINDS[(int(own[k]) - 1) // 2], start, stop))
    return out


def added(base: list[tuple[str, int, int]], found: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The found spans that touch no base span."""
    ends, reach = [], 0
    for _, _, b in base:
        reach = max(reach, b)
        ends.append(reach)
    starts = [a for _, a, _ in base]
    return [s for s in found if not (i := bisect_right(starts, s[2] - 1)) or ends[i - 1] <= s[1]]


def find(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256 and spans of each whole text.

    Offsets are code points, ends exclusive; spans of the field are added where no
    base span lies. A null text is empty; each row has its result, repeated or
    without doc_id; further columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def told(spans: list[tuple[str, int, int]]) -> str:
        return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 4_000_000):
                texts = [t if t and MARKED.search(t) else "" for t in batch.column("text").to_pylist()]
                base = [base_spans(t) for t in texts]
                more = [added(b, f) for b, f in zip(base, field_spans(shared.value, texts), strict=True)]
                every = [sorted(b + m, key=lambda s: (s[1], KINDS.index(s[0]), s[2])) for b, m in zip(base, more, strict=True)]
                counts = [pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in KINDS]
                digests = [hashlib.sha256(told(b).encode()).hexdigest() for b in base]
                columns = [batch.column("doc_id"), *counts, pa.array(digests, pa.string()), pa.array(map(told, every), pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    rows = texts_of(docs, F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(tidy(run), f"doc_id long, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string")


def op7_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return find(read(spark, sf_dir, "documents"), fit(labelled_table(spark)))


QUERIES = {"op7_crf_pii": op7_crf_pii}
ORACLES: dict[str, str] = {}
