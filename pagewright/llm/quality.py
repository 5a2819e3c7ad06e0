"""Quality scores by Bradley-Terry pairwise ranking.

A document's strength is w.f, linear in features f of its whole text. A good and a bad labelled document make a
preference pair; the probability that the good one wins is 1 / (1 + exp(-w.(f_good - f_bad))). w minimises the logistic
loss of the feature differences plus a ridge, by Newton steps. A score quantile of the labelled sample is then the
threshold: of all quantile levels, the one that best separates the labels. The strength at the threshold is given the
score `CUT`, so that score >= CUT accepts.

Bounds: at most `per_class` labelled documents of each class, those with the smallest hash of their id, are read to the
driver as short feature rows, and at most `most_pairs` pairs are formed. Scoring covers every document in one pass
without a shuffle.

Defined results: null and empty texts have the features of no words and get a score like others; unlabelled and
null-labelled rows are not learnt from; an id labelled twice counts once, by its larger label; where one class has no
labelled document, every score is CUT; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import boxed, column_of, named, with_columns

CUT = 0.7
PER_CLASS = 3000
MOST_PAIRS = 200_000

FEATURES = (
    "log_words", "upper", "digit", "symbol", "mark", "bar", "repeat", "word_length", "distinct", "symbol_ends",
    "shout_ends", "line_repeat", "letter", "short_words", "top_word", "sentence",
)


def features(text: str | None) -> np.ndarray:
    """The features of one text, in the order of FEATURES; shares lie in 0..1."""
    out = np.zeros(len(FEATURES))
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    words = raw.split()
    n = len(words)
    out[0] = np.log1p(n) / 10
    if not n:
        return out
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(float)
    lower, upper, digit = counts[97:123].sum(), counts[65:91].sum(), counts[48:58].sum()
    beyond = counts[0xC2:0xF5].sum()  # each character beyond ASCII has one lead byte
    inner = max(1.0, lower + upper + digit + beyond)
    marks = counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum()
    plain = counts[[44, 46, 39, 45, 58, 59, 63, 34, 40, 41]].sum()
    out[1] = upper / inner
    out[2] = digit / inner
    out[3] = (marks - plain) / (inner + marks)
    out[4] = plain / (inner + marks)
    out[5] = min(1.0, counts[124] / n)
    known: dict[bytes, int] = {}
    for w in words:
        known[w] = known.get(w, 0) + 1
    out[6] = sum(map(bytes.__eq__, words, words[1:])) / n
    out[7] = min(1.0, (len(raw) - counts[32] - counts[10]) / n / 20)
    out[8] = len(known) / n
    # Word kinds are judged on distinct words and weighed by how often they stand.
    ends = shouts = short = 0
    for w, k in known.items():
        last = w[-1]
        if last in b"#$%&*@^~=+<>_\\/|":
            ends += k
        elif last == 33:
            shouts += k
        if len(w) <= 3:
            short += k
    out[9], out[10] = ends / n, shouts / n
    lines = [x for x in raw.split(b"\n") if x.strip()]
    out[11] = 1 - len(set(lines)) / max(1, len(lines))
    out[12] = (lower + upper + beyond) / max(1, len(raw) - counts[32] - counts[10])
    out[13] = short / n
    out[14] = max(known.values()) / n
    out[15] = min(1.0, (counts[46] + counts[63]) / n)
    return out


@dataclass(frozen=True)
class Ranking:
    """Weights of the standardised features, and the strength and slope that map to the score CUT."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float

    def strength(self, f: np.ndarray) -> np.ndarray:
        return ((f - self.mean) / self.spread) @ self.weights

    def score(self, f: np.ndarray) -> np.ndarray:
        z = self.slope * (self.strength(f) - self.threshold) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(good: np.ndarray, bad: np.ndarray, most_pairs: int = MOST_PAIRS, ridge: float = 1e-2, seed: int = 5) -> Ranking:
    """Bradley-Terry weights from feature rows of preferred and rejected documents."""
    n_features = good.shape[1] if good.ndim == 2 and len(good) else len(FEATURES)
    if not len(good) or not len(bad):
        return Ranking(np.zeros(n_features), np.ones(n_features), np.zeros(n_features), 0.0, 0.0)
    both = np.concatenate([good, bad])
    mean, spread = both.mean(axis=0), both.std(axis=0)
    spread = np.where(spread > 1e-9, spread, 1.0)
    rng = np.random.default_rng(seed)
    n = min(most_pairs, 40 * (len(good) + len(bad)))
    i, j = rng.integers(len(good), size=n), rng.integers(len(bad), size=n)
    diff = (good[i] - bad[j]) / spread
    w = np.zeros(n_features)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(diff @ w, -30, 30)))
        gradient = diff.T @ (p - 1) / n + ridge * w
        hessian = (diff * (p * (1 - p))[:, None]).T @ diff / n + ridge * np.eye(n_features)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    s_good, s_bad = ((good - mean) / spread) @ w, ((bad - mean) / spread) @ w
    # Threshold: the quantile level of the sample's strengths that best separates the labels; midway in a gap.
    strengths = np.sort(np.concatenate([s_good, s_bad]))
    middles = (strengths[:-1] + strengths[1:]) / 2
    right = 1 - np.searchsorted(np.sort(s_good), middles) / len(s_good) + np.searchsorted(np.sort(s_bad), middles) / len(s_bad)
    best = np.nonzero(right >= right.max() - 1e-12)[0]
    widest = best[np.argmax(strengths[best + 1] - strengths[best])]
    threshold = float(middles[widest])
    scale = max(1e-6, min(np.median(s_good) - threshold, threshold - np.median(s_bad)))
    return Ranking(mean, spread, w, threshold, float(3 / scale))


def _rows_of(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        rows = [features(t).tolist() for t in column_of(part, "text")]
        yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("good")), pa.array(rows, pa.list_(pa.float64()))], names=["good", "f"])


def learn(docs: DataFrame, labels: DataFrame, usable: Column | None = None, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Ranking:
    """A ranking learnt from the labelled documents for which usable (over the label table's columns) holds."""
    rows = labels if usable is None else labels.where(usable)
    rows = rows.select(named(id_col).alias("id"), named(label_col).alias("good")).where("id is not null and good in (0, 1)")
    rows = rows.groupBy("id").agg(F.max("good").cast("int").alias("good"))
    picked = [r for g in (0, 1) for r in rows.where(F.col("good") == g).orderBy(F.xxhash64("id"), "id").limit(per_class).collect()]
    if not picked:
        return fit(np.zeros((0, len(FEATURES))), np.zeros((0, len(FEATURES))))
    few = docs.sparkSession.createDataFrame(picked, rows.schema)  # at most 2 * per_class ids
    texts = docs.select(named(id_col).alias("id"), named(text_col).alias("text")).join(F.broadcast(few), "id")
    # One row an id, however often it stands: the sample is bounded by rows.
    texts = texts.groupBy("id", "good").agg(F.min("text").alias("text"))
    got = texts.select("good", "text").mapInArrow(_rows_of, "good int, f array<double>").collect()
    got.sort(key=lambda r: (r.good, r.f))
    return fit(*(np.array([r.f for r in got if r.good == g], float).reshape(-1, len(FEATURES)) for g in (1, 0)))


def _scorer(model: Ranking):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = column_of(part, "text")
            f = np.array([features(t) for t in texts]).reshape(len(texts), len(FEATURES))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(f))], names=["box", "score"])

    return run


def _boxes_scored(boxes: DataFrame, model: Ranking) -> DataFrame:
    return boxes.mapInArrow(_scorer(model), with_columns(boxes, "score double"))


def scored(docs: DataFrame, model: Ranking, keep: list[str], text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The columns in keep of every document, and its score."""
    return _boxes_scored(boxed(docs, keep, text=named(text_col)), model).select("box.*", F.col("score").alias(score_col))


def accepted(docs: DataFrame, model: Ranking, cut: float = CUT, text_col: str = "text") -> DataFrame:
    """The documents with a score of at least cut, with their columns as they were."""
    return _boxes_scored(boxed(docs, text=named(text_col)), model).where(F.col("score") >= cut).select("box.*")
