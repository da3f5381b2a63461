"""Severity grades from sparse text features by cumulative-link (ordinal) regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from foldwise.kernels.store import materialize
from foldwise.llm.columns import id_type, pair, quoted

#: A-Z becomes a-z; every other ASCII byte that is no letter becomes a space.
LETTERS = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


#: Lengths in bytes of the word beginnings that are terms besides the words: inflected forms share them.
BEGINNINGS = (4, 5)


def terms_of(text: bytes | None) -> set[bytes]:
    """The distinct words of a text (runs of letters, lower-cased in ASCII) and, marked by ``^``, their beginnings."""
    words = set((text or b"").translate(LETTERS).split())
    terms = set(words)
    for n in BEGINNINGS:
        terms.update([b"^" + w[:n] for w in words if len(w) > n])
    return terms


@dataclass
class OrdinalModel:
    """P(grade > k) = sigmoid(score - thresholds[k]); the score is the sum of the weights of a text's terms."""

    weights: dict[bytes, float]
    thresholds: np.ndarray

    def score(self, text: bytes | None) -> float:
        weights = self.weights
        return sum([weights[t] for t in sorted(weights.keys() & terms_of(text))])

    def rejects(self, scores: np.ndarray, reject_at: float) -> np.ndarray:
        """Whether P(grade > 0) reaches ``reject_at`` by evidence: a text without telling terms is never rejected."""
        return (self.above(scores)[:, 0] >= reject_at) & (scores > 0)

    def above(self, scores: np.ndarray) -> np.ndarray:
        """Rows of P(grade > k) for each threshold k."""
        return _sigmoid(scores[:, None] - self.thresholds[None, :])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def likelihood(scores: np.ndarray, grades: np.ndarray, thresholds: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood of the grades and its gradients by score and by threshold."""
    last = len(thresholds)
    rows = np.arange(len(scores))
    above = np.concatenate([np.ones((len(scores), 1)), _sigmoid(scores[:, None] - thresholds), np.zeros((len(scores), 1))], axis=1)
    mass = np.maximum(above[rows, grades] - above[rows, grades + 1], 1e-12)
    slope = above * (1.0 - above)
    low, high = slope[rows, grades], slope[rows, grades + 1]
    by_threshold = np.bincount(grades, low / mass, last + 1)[1:] - np.bincount(grades, high / mass, last + 1)[:last]
    return -np.log(mass).mean(), -(low - high) / mass / len(scores), by_threshold / len(scores)


def fit(bags: list[list[int]], grades: np.ndarray, n_terms: int, l2: float = 1e-3, steps: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Weights shared by all thresholds, and ordered thresholds, by Adam on the penalised likelihood.

    Thresholds are a first value and positive gaps, so they stay ordered. A grade that never occurs widens no gap.
    """
    last = max(1, int(grades.max(initial=0)))
    rows = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    columns = np.concatenate([np.asarray(b, np.int64) for b in bags] + [np.zeros(0, np.int64)])
    share = np.clip([(grades > k).mean() for k in range(last)], 1e-3, 1 - 1e-3)
    cuts = np.maximum.accumulate(np.log1p(-share) - np.log(share) + 1e-3 * np.arange(last))
    point = np.concatenate([np.zeros(n_terms), cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-3))])
    first, second = np.zeros_like(point), np.zeros_like(point)
    for step in range(1, steps + 1):
        weights, gaps = point[:n_terms], np.exp(point[n_terms + 1 :])
        thresholds = point[n_terms] + np.concatenate([[0.0], np.cumsum(gaps)])
        scores = np.bincount(rows, weights[columns], len(bags))
        _, by_score, by_threshold = likelihood(scores, grades, thresholds)
        tails = np.cumsum(by_threshold[::-1])[::-1]
        gradient = np.concatenate(
            [np.bincount(columns, by_score[rows], n_terms) + l2 * weights, tails[:1], tails[1:] * gaps]
        )
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        rate = 0.1 * min(1.0, 2.0 * (1.0 - step / (steps + 1)))
        point = point - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    gaps = np.exp(point[n_terms + 1 :])
    return point[:n_terms], point[n_terms] + np.concatenate([[0.0], np.cumsum(gaps)])


#: Labelled rows that a model is fitted on at most, chosen by a hash of their id.
SAMPLE_ROWS = 6000


def labelled_sample(
    records: DataFrame, labels: DataFrame, grade: str, id: str = "entry_id", body: str = "body", rows: int = SAMPLE_ROWS
) -> DataFrame:
    """``(entry_id, body, grade)`` of at most ``rows`` labelled ids. Ids without a grade are left out; the chosen ids are
    few enough to broadcast, so the texts are scanned but not shuffled."""
    wanted = labels.select(quoted(id).alias("entry_id"), quoted(grade).cast("int").alias("grade"))
    wanted = wanted.filter(F.col("grade").isNotNull() & F.col("entry_id").isNotNull())
    chosen = wanted.orderBy(F.xxhash64("entry_id"), "entry_id", "grade").limit(rows)
    return pair(records, id, body).join(F.broadcast(chosen), "entry_id")


def telling_terms(bags: DataFrame, least: int, most: int) -> list[bytes]:
    """The ``most`` terms of ``(terms, grade)``, in at least ``least`` records each, whose presence depends most on a grade above 0
    by the chi-square statistic; ties to the earlier term. Counting is a Spark job; only the chosen terms are collected."""
    n, n_bad = bags.agg(F.count(F.lit(1)), F.sum((F.col("grade") > 0).cast("int"))).first()
    mark = (F.col("grade") > 0).cast("double")
    counts = bags.select(F.explode("terms").alias("term"), mark.alias("mark")).groupBy("term")
    counts = counts.agg(F.count(F.lit(1)).cast("double").alias("seen"), F.sum("mark").alias("bad")).filter(F.col("seen") >= least)
    good, n_good = F.col("seen") - F.col("bad"), float(n - n_bad)
    apart = F.col("bad") * (F.lit(n_good) - good) - good * (F.lit(float(n_bad)) - F.col("bad"))
    spread = F.col("seen") * (F.lit(float(n)) - F.col("seen")) * F.lit(n_bad * n_good)
    worth = F.coalesce(F.try_divide(apart * apart, spread), F.lit(0.0))
    return sorted(bytes(r["term"]) for r in counts.orderBy(worth.desc(), "term").limit(most).collect())


def fit_model(
    sample: DataFrame, levels: int = 1, min_records: int = 4, max_terms: int = 300, l2: float = 5e-5, steps: int = 300
) -> OrdinalModel:
    """Fit on a bounded sample ``(entry_id, body, grade)`` with grades 0, 1, 2, ...

    Tasks reduce each text to its distinct terms. At most ``max_terms`` terms that depend most on the mark (a grade above 0),
    each in at least ``min_records`` sampled records, are the features; the driver holds the sample's occurrences of these
    alone. If the labels are a bare 0/1 mark and ``levels`` exceeds 1, a first fit ranks the marked records and their mark is
    spread over ``levels`` grades of equal size, so that the thresholds order them by strength of evidence. An empty sample,
    or one without any grade above 0, gives a model without terms.
    """
    source = sample.select(F.col("body").cast("binary").alias("body"), F.greatest("grade", F.lit(0)).alias("grade"))

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [list(terms_of(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(bags, pa.list_(pa.binary())), batch.column(1)], ["terms", "grade"])

    bags = materialize(source.mapInArrow(terms, "terms array<binary>, grade int"))
    if bags.filter("grade > 0").isEmpty():
        return OrdinalModel({}, np.array([20.0]))
    chosen = telling_terms(bags, min_records, max_terms)
    order = {t: i for i, t in enumerate(chosen)}

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(order[t] for t in bag if t in order) for bag in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), batch.column(1)], ["found", "grade"])

    rows = sorted((r["found"], r["grade"]) for r in bags.mapInArrow(number, "found array<int>, grade int").collect())
    indexed, grades = [f for f, _ in rows], np.array([g for _, g in rows], np.int64)
    weights, thresholds = fit(indexed, grades, len(order), l2, steps)
    if levels > 1 and grades.max() == 1:
        scores = np.array([weights[b].sum() for b in indexed])
        marked = np.flatnonzero(grades)
        ranks = np.argsort(np.argsort(scores[marked], kind="stable"), kind="stable")
        grades[marked] = 1 + ranks * levels // len(marked)
        weights, thresholds = fit(indexed, grades, len(order), l2, steps)
    return OrdinalModel(dict(zip(order, weights.tolist())), thresholds)


def severity(
    records: DataFrame, model: OrdinalModel, id: str = "entry_id", body: str = "body", reject_at: float = 0.5
) -> DataFrame:
    """``(entry_id, score, p_above array, severity, grade, rejected)``, one row per record.

    ``p_above[k]`` is P(grade > k); their sum ``severity`` is the expected grade; ``grade`` is the most probable one and
    ``rejected`` says that P(grade > 0) reaches ``reject_at`` and the score is above 0. The reference's records carry no toxicity marks, so the operator
    is general: any rows with an id and a text. Whole texts are scored; NULL and empty texts have no terms and score 0.
    NULL ids and repeated rows each keep their row. The model's size is bounded by its sample.
    """
    source = pair(records, id, body).withColumn("body", F.col("body").cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.array([model.score(t) for t in batch.column(1).to_pylist()], float)
            above = model.above(scores).reshape(len(scores), -1)
            mass = np.hstack([np.ones((len(scores), 1)), above]) - np.hstack([above, np.zeros((len(scores), 1))])
            arrays = [
                batch.column(0), pa.array(scores), pa.array(list(above), pa.list_(pa.float64())), pa.array(above.sum(axis=1)),
                pa.array(mass.argmax(axis=1), pa.int32()), pa.array(model.rejects(scores, reject_at), pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["entry_id", "score", "p_above", "severity", "grade", "rejected"])

    schema = f"entry_id {id_type(source)}, score double, p_above array<double>, severity double, grade int, rejected boolean"
    return source.mapInArrow(run, schema)


def keep_clean(records: DataFrame, model: OrdinalModel, body: str = "body", reject_at: float = 0.5) -> DataFrame:
    """The rows of ``records``, all columns, without those that ``severity`` rejects; nothing is shuffled."""
    at = records.columns.index(body)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.array([model.score(t) for t in batch.column(at).cast(pa.binary()).to_pylist()], float)
            yield batch.filter(pa.array(~model.rejects(scores, reject_at), pa.bool_()))

    return records.mapInArrow(run, records.schema)
