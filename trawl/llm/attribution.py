"""Token counts of sections, from one encoding of each whole document.

A text is encoded once; its tokens' byte spans meet the sections' spans in an interval join: sections of a document lie in
order and don't overlap, so a sorted search finds each token's sections. Counting sections one by one would count
other tokens, since merges reach over borders.

A token that crosses a border goes by ``rule``: "start" to the section of its first byte; "most" to the section with
most of its bytes, the earlier one if even; "split" to each section in proportion to its bytes. Each rule's
counts sum to the document's tokens. Tokens without bytes go by their position.

Sections are lines, each with its line feed. A null or empty text has one section without tokens. Rows with null or equal
ids are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm import bpe
from trawl.llm.cluster import ship, slices

RULES = ("start", "most", "split")


def line_starts(raw: bytes) -> np.ndarray:
    """First byte of each line; a line feed at the very end begins no line."""
    feeds = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
    return np.concatenate([[0], feeds[feeds < len(raw)]]).astype(np.int64)


def attribute(starts: np.ndarray, ends: np.ndarray, sections: np.ndarray, size: int, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of each section, tokens that cross into it from before) for token spans and sections' first bytes."""
    n = len(sections)
    bounds = np.append(sections, size)
    first = np.searchsorted(sections, starts, side="right") - 1
    last = np.maximum(np.searchsorted(sections, ends, side="left") - 1, first)
    cross = np.flatnonzero(last > first)
    counts = np.zeros(n)
    inside = last == first
    counts += np.bincount(first[inside], minlength=n)
    entered = np.zeros(n, np.int64)
    for i in cross.tolist():
        own = np.arange(first[i], last[i] + 1)
        entered[own[1:]] += 1
        share = np.minimum(bounds[own + 1], ends[i]) - np.maximum(bounds[own], starts[i])
        if rule == "start":
            counts[own[0]] += 1
        elif rule == "most":
            counts[own[int(np.argmax(share))]] += 1
        else:
            counts[own] += share / (ends[i] - starts[i])
    return counts, entered


def section_tokens(docs: DataFrame, tokenizer: str, rule: str = "start", id_col: str = "doc_id", text_col: str = "text", added: bool = False) -> DataFrame:
    """(doc_id, section, first_byte, end_byte, n_tokens, n_entered, doc_tokens): a row for each line of each document. No shuffle.

    n_tokens is a double, whole for the rules "start" and "most"; n_entered counts tokens that began in an earlier section.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.load(tokenizer, added)
        for batch in slices(batches, 64):
            texts = batch.column(1).to_pylist()
            columns: list[list[np.ndarray]] = [[] for _ in range(6)]
            sizes = []
            for text, (starts, ends) in zip(texts, encoder.spans(texts), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                sections = line_starts(raw)
                counts, entered = attribute(starts, ends, sections, len(raw), rule)
                n = len(sections)
                sizes.append(n)
                for column, values in zip(columns, (np.arange(n), sections, np.append(sections[1:], len(raw)), counts, entered, np.full(n, len(starts))), strict=True):
                    column.append(values)
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), sizes)))
            whole = [np.concatenate(c) for c in columns]
            types = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(whole, types, strict=True))], ["doc_id", "section", "first_byte", "end_byte", "n_tokens", "n_entered", "doc_tokens"])

    narrow = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return narrow.mapInArrow(count, "doc_id bigint, section bigint, first_byte bigint, end_byte bigint, n_tokens double, n_entered bigint, doc_tokens bigint")
