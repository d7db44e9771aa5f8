"""Mixing sources to target weights, in DataFrame operations only.

Words are counted for each document and source. Each source's target is its weight's share of all words, but no
more than ``most`` times its own words; what that leaves over goes to the other sources by weight until none is above:
target = min(most x size, level x weight), with the level found from running sums over the sources in the
order in which they reach their limit. A source's rate is its target over its size. A document is taken floor(rate)
times, and once more if a number hashed from its id and a seed falls below the fraction.

A null text has no words; a null source is a source of its own, last in order; a source without words has target and
rate 0. Reruns, other partitions and other orders give the same copies; rows with equal ids share their draw.
Running sums over sources run in one task; it gets one row for each source.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawl.llm.cluster import staged

WEIGHTS = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Runs of characters other than space and U+0009 to U+000D: their starts are counted."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("bigint"), F.lit(0).cast("bigint"))


def draw(key: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the key and seed alone: 52 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = 3) -> DataFrame:
    """sizes: (source, size). Returns (source, source_size, target)."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    totals = sizes.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    named = totals.withColumn("w", weight).withColumn("cap", F.col("source_size") * float(most))
    everything = Window.partitionBy()
    by_limit = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_limit.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(onward)
    reached = named.withColumn("level", level).withColumn("under", F.col("level") * F.col("w") <= F.col("cap"))
    final = F.max(F.when(F.col("under"), F.col("level"))).over(everything)  # levels fall from the first source that stays under its limit
    return reached.withColumn("final", final).select("source", "source_size", F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("final") * F.col("w"))).alias("target"))


def document_rates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS, most: int = 3, seed: str = "mix-0-") -> DataFrame:
    """(doc_id, size, source, source_size, target, copies) for every row. Texts are read once and never shuffled."""
    sizes = staged(docs.select(F.col(id_col).alias("doc_id"), word_count(F.col(text_col)).alias("size"), F.col(source_col).alias("source")), "sizes")
    targets = staged(source_targets(sizes, weights, most), "targets").withColumnRenamed("source", "_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    extra = (draw(F.col("doc_id"), seed) < rate - F.floor(rate)).cast("bigint")
    return sizes.join(targets, sizes["source"].eqNullSafe(targets["_source"])).select("doc_id", "size", "source", "source_size", "target", F.least(F.floor(rate) + extra, F.lit(most)).cast("bigint").alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS, most: int = 3, seed: str = "mix-0-") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it (not at all, if 0), all columns as they are.

    Texts aren't shuffled: rows meet their source's target, a table of one row for each source, which Spark
    broadcasts if it is small and joins by sorting if not.
    """
    met, copy = (f"_mix_{n}_{uuid.uuid4().hex}" for n in ("target", "copy"))  # no column of the documents has such a name
    sizes = docs.select(word_count(F.col(text_col)).alias("size"), F.col(source_col).alias("source"))
    targets = staged(source_targets(sizes, weights, most), "targets")
    t = targets.select(F.struct(F.col("source").alias("s"), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("r")).alias(met))
    joined = docs.join(t, docs[source_col].eqNullSafe(t[f"{met}.s"]))
    rate = F.col(f"{met}.r")
    n = F.least(F.floor(rate) + (draw(docs[id_col], seed) < rate - F.floor(rate)).cast("bigint"), F.lit(most)).cast("int")
    return joined.withColumn(copy, F.explode(F.array_repeat(F.lit(1), n))).drop(met, copy)


def taken(docs: DataFrame) -> DataFrame:
    return document_rates(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
