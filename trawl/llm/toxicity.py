"""Severity of toxic language by ordinal regression on the words that a text has.

A text's features are its distinct words and their beginnings (three to six letters), summed without division by length,
so that one insult counts as much in a long text as in a short one. ``labels.toxic`` has two grades here; any number of
ordered grades works. Null texts are empty, null ids keep their rows; without labels all rows get even odds and none is
flagged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm import ordinal

#: Labelled documents that a model is fitted on at most.
SAMPLE = 6000


def parts(token: str) -> list[str]:
    return ["word:" + token, *(f"begin:{token[:k]}" for k in range(3, min(len(token), 7)))]


FEATURES = ordinal.Features(pattern=r"[^\W\d_]+", parts=parts, distinct=True, lower=True, scale=1.0)


def train(docs: DataFrame, labels: DataFrame, grade_col: str = "toxic", sample: int = SAMPLE) -> ordinal.Model:
    return ordinal.train(docs, labels, grade_col, FEATURES, sample=sample, ridge=1e-5, rounds=400, rate=0.3)


def severity(docs: DataFrame, model: ordinal.Model, cut: int = 1, least: float = 0.5) -> DataFrame:
    """(doc_id, expected_severity, p_toxic, toxic) of every row; toxic: severity ``cut`` or more has a probability above ``least``."""
    return ordinal.scores(docs, model, cut).select(F.col("_id").alias("doc_id"), F.col("expected").alias("expected_severity"), F.col("tail").alias("p_toxic"), (F.col("tail") > least).alias("toxic"))
