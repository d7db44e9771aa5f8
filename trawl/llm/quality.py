"""Quality grades of documents by ordinal regression, for selection.

Features are shares of a text's tokens: words, runs of signs, shapes (capitals, digits, length), repeats of the token before. ``labels.quality``
has two grades here; any number of ordered grades works. A null text is an empty one, which has no features and gets
the thresholds' own grade. Null ids keep their rows. Without labels all rows get even odds and are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm import ordinal
from trawl.llm.cluster import slices

#: Labelled documents that a model is fitted on at most.
SAMPLE = 6000


def parts(token: str) -> list[str]:
    if token == ordinal.AGAIN:
        return [token]
    if not token[0].isalnum():
        return ["sign:" + token[:4], "sign"]
    shape = "digit" if token[0].isdigit() else "upper" if len(token) > 1 and token.isupper() else "title" if token[0].isupper() else "lower"
    return ["word:" + token.lower(), "shape:" + shape, f"length:{min(len(token), 16)}"]


FEATURES = ordinal.Features(pattern=r"[^\W\d_]+|\d+|(?:[^\w\s]|_)+", parts=parts, distinct=False, lower=False, scale=32.0, repeats=True)


def train(docs: DataFrame, labels: DataFrame, grade_col: str = "quality", sample: int = SAMPLE) -> ordinal.Model:
    return ordinal.train(docs, labels, grade_col, FEATURES, sample=sample)


def grade(docs: DataFrame, model: ordinal.Model, cut: int = 1, least: float = 0.5) -> DataFrame:
    """(doc_id, expected_grade, p_good, keep) of every row; p_good: the probability of grade ``cut`` or better; keep: p_good is ``least`` or more."""
    return ordinal.scores(docs, model, cut).select(F.col("_id").alias("doc_id"), F.col("expected").alias("expected_grade"), F.col("tail").alias("p_good"), (F.col("tail") >= least).alias("keep"))


def select(docs: DataFrame, model: ordinal.Model, cut: int = 1, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text has grade ``cut`` or better with probability ``least`` or more; all columns, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds, model.features))
    at = docs.columns.index(text_col)
    made: dict[str, ordinal.Model] = {}

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "m" not in made:
            made["m"] = ordinal.Model(*shared.value)
        own = made["m"]
        for batch in slices(batches):
            tail = [own.above_cut(t, cut) for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array([p >= least for p in tail], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
