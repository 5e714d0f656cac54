"""Quality classifier: naive Bayes support vectors on n-gram indicators.

Indicators of byte n-grams and of words said two, three or four times in a row
are scaled by the classes' log-count ratios (Wang and Manning 2012); a linear
hinge-loss model is fitted on them by dual coordinate descent (Hsieh et al. 2008).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tabloom.frame import c
from tabloom.llm.common import read, slices, texts_of, tidy

#: Labelled rows that a fit takes at most, the first by a hash; every fifth of them sets the scale of the score.
SAMPLE = 12_000
TRIPLES = 1 << 17
RUNS = (2, 3, 4)
PAIRS_AT, TRIPLES_AT = 256, 256 + 65536
RUNS_AT = TRIPLES_AT + TRIPLES
FEATURES = RUNS_AT + len(RUNS)
THRESHOLD = 0.3


def feature_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The distinct features of each whole text (null: empty)."""
    texts = texts.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    flat = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]].astype(np.int32)
    offsets = offsets - offsets[0]
    pairs = (flat[:-1] << 8 | flat[1:]) + PAIRS_AT
    triples = (((flat[:-2] << 16 | flat[1:-1] << 8 | flat[2:]).astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(15)).astype(np.int32)
    triples += TRIPLES_AT
    runs = repeated_words(texts.cast(pa.large_string()))
    seen = np.zeros(FEATURES, dtype=np.int32)
    for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        codes = np.concatenate([flat[a:b], pairs[a : max(a, b - 1)], triples[a : max(a, b - 2)], np.array(runs[k], dtype=np.int32)])
        place = np.arange(len(codes), dtype=np.int32)
        seen[codes] = place  # the last place of each code stays
        yield codes[seen[codes] == place]


def repeated_words(texts: pa.Array) -> list[list[int]]:
    """Per text the features of words that stand n times in a row, for each n of ``RUNS``."""
    words = pc.ascii_split_whitespace(texts)
    index = words.flatten().dictionary_encode().indices.to_numpy()
    doc = np.repeat(np.arange(len(texts)), pc.list_value_length(words).to_numpy())
    same = (index[1:] == index[:-1]) & (doc[1:] == doc[:-1])
    out: list[list[int]] = [[] for _ in range(len(texts))]
    run = same
    for k, n in enumerate(RUNS):
        for d in np.unique(doc[: len(run)][run]).tolist():
            out[d].append(RUNS_AT + k)
        run = run[:-1] & same[n - 1 :]
    return out


@dataclass
class Model:
    ratios: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margins(self, sets: Iterator[np.ndarray]) -> np.ndarray:
        value, square = (self.ratios * self.weights), self.ratios**2
        out = [float(value[s].sum() / max(1e-12, np.sqrt(square[s].sum()))) for s in sets]
        return np.array(out, dtype=np.float64) + self.bias

    def scores(self, sets: Iterator[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(sets) + self.shift, -700, 700)))


def log_count_ratios(sets: list[np.ndarray], good: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    counts = np.full((2, FEATURES), smooth)
    for s, y in zip(sets, good, strict=True):
        counts[int(y)][s] += 1
    shares = counts / counts.sum(axis=1, keepdims=True)
    return np.log(shares[1] / shares[0])


def dual_coordinate_descent(
    sets: list[np.ndarray], ratios: np.ndarray, good: np.ndarray, cost: float = 1.0, tolerance: float = 0.01, passes: int = 60
) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss model on unit-length rows of ratios.

    Passes go on until the projected gradients of a pass spread by less than
    ``tolerance``, or a warning tells that ``passes`` did not suffice.
    """
    sign = np.where(good, 1.0, -1.0)
    rows = [ratios[s] / max(1e-12, np.sqrt((ratios[s] ** 2).sum())) for s in sets]
    size = np.array([r @ r + 1.0 for r in rows])
    alpha, weights, bias = np.zeros(len(rows)), np.zeros(FEATURES), 0.0
    rng = np.random.default_rng(0)
    for _ in range(passes):
        high, low = -np.inf, np.inf
        for i in rng.permutation(len(rows)).tolist():
            s, x = sets[i], rows[i]
            gradient = sign[i] * (x @ weights[s] + bias) - 1
            projected = min(gradient, 0.0) if alpha[i] <= 0 else max(gradient, 0.0) if alpha[i] >= cost else gradient
            high, low = max(high, projected), min(low, projected)
            if projected:
                before = alpha[i]
                alpha[i] = min(max(before - gradient / size[i], 0.0), cost)
                step = (alpha[i] - before) * sign[i]
                weights[s] += step * x
                bias += step
        if high - low < tolerance:
            return weights, bias
    import warnings

    warnings.warn(f"dual coordinate descent stopped after {passes} passes", stacklevel=2)
    return weights, bias


def logistic_scale(margins: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through smoothed targets (Platt 1999), by Newton steps."""
    n1, n0 = int(good.sum()), int((~good).sum())
    target = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margins, np.ones(len(margins))], axis=1)
    theta = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -700, 700)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (p - target) + 1e-6 * theta)
        theta -= step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-8:
            break
    return float(theta[0]), float(theta[1])


def fit_rows(sets: list[np.ndarray], good: np.ndarray) -> Model:
    """The model of some rows; with one class only, its smoothed share for every text."""
    aside = np.arange(len(good)) % 5 == 0
    if len(good) < 10 or len(set(good[~aside])) < 2 or len(set(good[aside])) < 2:
        share = (good.sum() + 1) / (len(good) + 2)
        return Model(np.zeros(FEATURES), np.zeros(FEATURES), 0.0, 0.0, float(np.log(share / (1 - share))))
    fitted = [s for s, a in zip(sets, aside, strict=True) if not a]
    ratios = log_count_ratios(fitted, good[~aside])
    weights, bias = dual_coordinate_descent(fitted, ratios, good[~aside])
    model = Model(ratios, weights, bias, 1.0, 0.0)
    margins = model.margins(iter([s for s, a in zip(sets, aside, strict=True) if a]))
    model.slope, model.shift = logistic_scale(margins, good[aside])
    return model


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled rows; ``labels`` has doc_id and label (0 or 1).

    The rows are the first by a hash of doc_id, so any size of table gives a like
    sample. Other labels and nulls are left out; a doc_id with several labels
    counts as 1 if one of them is, and one with several texts gives the smallest.
    The bounded list of labels is broadcast, and only the texts that it names are
    shuffled, one per doc_id. Texts are read and features made in many tasks; one
    task fits on the at most ``sample`` rows of features.
    """
    known = labels.filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy(F.col("doc_id").alias("known_id")).agg(F.max("label").cast("int").alias("label"))
    first = known.orderBy(F.md5(F.concat(F.lit("fit:"), F.col("known_id").cast("string"))), "known_id").limit(sample)
    rows = texts_of(docs, "doc_id", "text").join(F.broadcast(first), F.col("doc_id") == F.col("known_id"))
    # repeats are combined before the shuffle
    rows = rows.groupBy("doc_id").agg(F.first("label").alias("label"), F.min("text").alias("text"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 2_000_000):
                sets = [s.astype("<i4").tobytes() for s in feature_sets(batch.column("text"))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(sets, pa.binary())], ["doc_id", "label", "features"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held).sort_by([("doc_id", "ascending"), ("features", "ascending")])
        good = table["label"].to_numpy() == 1
        # the sets of a bounded sample, in an order that does not follow the ids
        order = np.random.default_rng(1).permutation(len(good))
        found = table["features"].to_pylist()
        model = fit_rows([np.frombuffer(found[i], dtype="<i4") for i in order], good[order])
        row = [model.ratios.astype("<f8").tobytes(), model.weights.astype("<f8").tobytes(), model.bias, model.slope, model.shift]
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["ratios", "weights", "bias", "slope", "shift"])

    made = rows.mapInArrow(tidy(features), "doc_id long, label int, features binary").repartition(1)
    found = made.mapInArrow(tidy(train), "ratios binary, weights binary, bias double, slope double, shift double").collect()
    if not found:
        return fit_rows([], np.zeros(0, dtype=bool))
    r = found[0]
    return Model(np.frombuffer(r.ratios, "<f8"), np.frombuffer(r.weights, "<f8"), r.bias, r.slope, r.shift)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score double and predicted int; null and empty texts get the score of no n-gram.

    Every row is scored from its text alone; rows and other columns stay, columns
    named score or predicted are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [n for n in docs.columns if n not in ("score", "predicted")]
    # other columns travel as one struct, whatever their names
    rows = texts_of(docs, "text", F.struct(*[c(n) for n in names if n != "text"]).alias("own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 4_000_000):
                scores = shared.value.scores(feature_sets(batch.column("text")))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], ["text", "own", "score"])

    scored = rows.mapInArrow(tidy(run), T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())]))
    scored = scored.select(*[F.col("text") if n == "text" else F.col("own")[n].alias(n) for n in names], "score")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Whether crc32(doc_id as text) mod 5 is 0; a null id is the empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % 5 == 0


def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels").filter(~held_out())
    return labels.select("doc_id", F.col("quality").alias("label"))


def op6_nb_svm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document; labels of the held-out fifth are never read for the fit."""
    docs = read(spark, sf_dir, "documents")
    model = fit(docs, training_labels(spark, sf_dir))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


QUERIES = {"op6_nb_svm_quality": op6_nb_svm_quality}
ORACLES: dict[str, str] = {}
