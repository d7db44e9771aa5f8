"""Cumulative-link (proportional odds) regression on hashed text features.

P(grade > k) = sigmoid(w . x - theta_k): one weight vector for all thresholds, thresholds in ascending order. Features
are hashed into ``2**BITS`` weights, so a model has a fixed size whatever the text. A text's feature vector is a
sum of its tokens' vectors (over all tokens and divided by their number, or over distinct tokens), so a token's
part of w . x can be kept in a table, and whole texts are scored at the cost of a table lookup a token.

Fitting takes a bounded sample: of the labelled documents, the ``sample`` whose ids have the least hashes (all, if fewer);
of rows with equal ids the one with the least text.
Features are made on the executors and the sample's alone come to the driver. Scoring covers all rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.cluster import ship, slices

BITS = 18
MASK = (1 << BITS) - 1
#: Tokens whose sums are kept in a worker.
KEPT = 500_000
AGAIN = "=again"


@dataclass(frozen=True)
class Features:
    """pattern: of tokens; parts: names of a token's features; distinct: sum over distinct tokens, not a mean over all; scale: of the sum."""

    pattern: str
    parts: Callable[[str], list[str]]
    distinct: bool
    lower: bool
    scale: float
    #: Features get a weight if their presence is linked to the grade: sample size x squared correlation (chi-square, one degree) is this at least.
    least_link: float = 20.0
    #: A token that repeats the one before counts as the token AGAIN.
    repeats: bool = False

    def tokens(self, text: str | None) -> list[str]:
        text = text or ""
        found = re.findall(self.pattern, text.lower() if self.lower else text)
        return [AGAIN if a == b else a for a, b in zip(found, [None, *found], strict=False)] if self.repeats else found

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(indices, values), indices ascending."""
        found = self.tokens(text)
        counts = dict.fromkeys(found, 1) if self.distinct else Counter(found)
        total: dict[int, float] = {}
        for token, n in counts.items():
            for part in self.parts(token):
                k = zlib.crc32(part.encode("utf-8", "surrogatepass")) & MASK
                total[k] = total.get(k, 0.0) + n
        keys = np.array(sorted(total), np.int32)
        values = np.array([total[k] for k in keys.tolist()], np.float64)
        return keys, values * (self.scale / (1 if self.distinct else max(1, len(found))))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray
    features: Features
    kept: dict[str, float] = field(default_factory=dict, repr=False)

    def above(self, margin: np.ndarray) -> np.ndarray:
        """[row, k]: P(grade > k)."""
        return _sigmoid(margin[:, None] - self.thresholds[None, :])

    def above_cut(self, text: str | None, cut: int) -> float:
        """P(grade >= cut)."""
        return float(self.above(np.array([self.margin(text)]))[0, cut - 1])

    def token(self, token: str) -> float:
        return float(sum(self.weights[zlib.crc32(p.encode("utf-8", "surrogatepass")) & MASK] for p in self.features.parts(token)))

    def margin(self, text: str | None) -> float:
        f = self.features
        found = f.tokens(text)
        if not found:
            return 0.0
        if len(self.kept) > KEPT:
            self.kept.clear()
        known = self.kept
        sums = list(map(known.get, set(found) if f.distinct else found))
        if None in sums:
            for t in set(found).difference(known):
                known[t] = self.token(t)
            sums = [known[t] for t in (set(found) if f.distinct else found)]
        return float(np.sum(np.sort(np.array(sums)))) * f.scale / (1 if f.distinct else len(found))


def linked(keys: np.ndarray, row: np.ndarray, grades: np.ndarray, n: int, least: float) -> np.ndarray:
    """Which features' presence is linked to the grade strongly enough; those that few rows have never are."""
    centred = grades - grades.mean()
    have = np.bincount(keys, minlength=MASK + 1)
    together = np.bincount(keys, centred[row], minlength=MASK + 1)
    spread = have * (1 - have / n) * (centred**2).sum()
    return np.divide(n * together**2, spread, out=np.zeros(MASK + 1), where=spread > 0) >= least


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, levels: int, features: Features, ridge: float = 1e-3, rounds: int = 200, rate: float = 0.1) -> Model:
    """Full-batch Adam on the ridge-penalised likelihood. Without rows: zero weights, thresholds evenly spread about 0."""
    start = np.linspace(-(levels - 2) / 2, (levels - 2) / 2, levels - 1) if levels > 2 else np.zeros(1)
    if not len(rows):
        return Model(np.zeros(MASK + 1), start, features)
    sizes = np.array([len(k) for k, _ in rows])
    keys = np.concatenate([k for k, _ in rows]).astype(np.int64)
    values = np.concatenate([v for _, v in rows])
    row = np.repeat(np.arange(len(rows)), sizes)
    keep = linked(keys, row, grades, len(rows), features.least_link)[keys]
    keys, values, row = keys[keep], values[keep], row[keep]
    used, keys = np.unique(keys, return_inverse=True)
    n = len(rows)
    share = np.array([(np.count_nonzero(grades > k) + 0.5) / (n + 1) for k in range(levels - 1)])
    theta = -np.log(share / (1 - share))
    gaps = np.log(np.maximum(np.diff(theta), 1e-3))
    p = np.concatenate([np.zeros(len(used)), theta[:1], gaps])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, rounds + 1):
        w, t0, g = p[: len(used)], p[len(used)], p[len(used) + 1 :]
        theta = np.concatenate([[t0], t0 + np.cumsum(np.exp(g))])
        eta = np.bincount(row, values * w[keys], minlength=n)
        f = np.concatenate([np.ones((n, 1)), _sigmoid(eta[:, None] - theta[None, :]), np.zeros((n, 1))], axis=1)
        a, b = f[np.arange(n), grades], f[np.arange(n), grades + 1]
        each = np.maximum(a - b, 1e-12)
        d_eta = (1 - a - b) / n
        d_theta = np.zeros(levels + 1)
        np.add.at(d_theta, grades + 1, b * (1 - b) / each / n)
        np.add.at(d_theta, grades, -a * (1 - a) / each / n)
        d_theta = d_theta[1:levels]
        tail = np.cumsum(d_theta[::-1])[::-1]
        up = np.concatenate([np.bincount(keys, values * d_eta[row], minlength=len(used)) - ridge / n * 10 * w, [tail[0]], tail[1:] * np.exp(g)])
        m = 0.9 * m + 0.1 * up
        v = 0.999 * v + 0.001 * up * up
        p = p + rate * (0.02 ** (step / rounds)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    w, t0, g = p[: len(used)], p[len(used)], p[len(used) + 1 :]
    weights = np.zeros(MASK + 1)
    weights[used] = w
    return Model(weights, np.concatenate([[t0], t0 + np.cumsum(np.exp(g))]), features)


def sampled(labels: DataFrame, grade_col: str, sample: int, id_col: str = "doc_id") -> DataFrame:
    """(_id, _grade): the labelled ids with the least hashes. A repeated id has its largest grade; null ids and grades don't count."""
    one = labels.where(F.col(id_col).isNotNull() & F.col(grade_col).isNotNull()).groupBy(F.col(id_col).cast("bigint").alias("_id")).agg(F.max(F.col(grade_col).cast("int")).alias("_grade"))
    return one.orderBy(F.xxhash64("_id"), "_id").limit(sample)


def train(docs: DataFrame, labels: DataFrame, grade_col: str, features: Features, levels: int | None = None, sample: int = 6000, id_col: str = "doc_id", text_col: str = "text", **how) -> Model:
    """Fits on the texts of at most ``sample`` labelled documents. levels: grades are 0 to levels - 1 (others are moved to the nearer end); None: as the sample has, 2 at least."""
    ship(docs.sparkSession)
    chosen = sampled(labels, grade_col, sample, id_col)
    texts = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_text"))
    met = texts.join(F.broadcast(chosen), "_id")  # at most ``sample`` rows of two integers
    some = met.groupBy("_id", "_grade").agg(F.min("_text").alias("_text"))  # of rows with one id the least text, so that the bound holds for rows

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = [features.vector(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([k.tobytes() for k, _ in made], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in made], pa.binary())], ["_id", "_grade", "_keys", "_values"])

    got = sorted(some.mapInArrow(make, "_id bigint, _grade int, _keys binary, _values binary").toArrow().to_pylist(), key=lambda r: (r["_id"], r["_keys"], r["_values"]))
    grades = np.array([r["_grade"] for r in got], np.int64)
    k = levels or max(2, int(grades.max(initial=0)) + 1)
    return fit([(np.frombuffer(r["_keys"], np.int32), np.frombuffer(r["_values"], "<f4").astype(np.float64)) for r in got], np.clip(grades, 0, k - 1), k, features, **how)


def scores(docs: DataFrame, model: Model, cut: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, expected, tail) of every row: the expected grade, and P(grade >= cut)."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds, model.features))
    made: dict[str, Model] = {}

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "m" not in made:
            weights, thresholds, features = shared.value
            made["m"] = Model(weights.astype(np.float64), thresholds, features)
        own = made["m"]
        for batch in slices(batches):
            above = own.above(np.array([own.margin(t) for t in batch.column(1).to_pylist()]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(above.sum(axis=1)), pa.array(above[:, cut - 1])], ["_id", "expected", "tail"])

    return docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_text")).mapInArrow(score, "_id bigint, expected double, tail double")
