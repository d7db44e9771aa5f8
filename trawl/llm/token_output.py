"""Token ids of whole documents in a compressed binary table, decodable in parallel.

Documents are dealt by ranges of their id, so shard numbers ascend with ids. A shard is a list of segments of
about a million ids, cut between documents; a segment's row holds its documents' ids and lengths, one
frequency table that all its blocks share, and the blocks: each has a checkpoint (ids before it,
its words' offset, the lanes' states) and a checksum. Rows are written by Spark's committer, so a lost
executor leaves no half file; a task holds one segment, its table and the tokenizer's tables.

Null texts count as empty. Null ids sort first; equal ids keep their rows, ordered by text. Columns other than
the two named are ignored, whatever their names. An empty table gives an empty file set and result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawl.llm import bpe, rans
from trawl.llm.cluster import partitions, ship, slices

SEGMENT = 1 << 20
BLOCKS = pa.list_(pa.struct([("before", pa.int64()), ("n", pa.int32()), ("word_at", pa.int64()), ("n_words", pa.int64()), ("states", pa.binary()), ("crc32", pa.int64())]))
ROW = pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_lens", pa.list_(pa.int64())), ("freq", pa.binary()), ("blocks", BLOCKS), ("words", pa.binary())])
SCHEMA = "shard int, segment int, n_tokens bigint, doc_ids array<bigint>, doc_lens array<bigint>, freq binary, blocks array<struct<before: bigint, n: int, word_at: bigint, n_words: bigint, states: binary, crc32: bigint>>, words binary"


def pack_segment(ids: np.ndarray, size: int) -> tuple[bytes, list[dict], bytes]:
    """(frequency table, blocks, words) of the ids."""
    table = rans.Table.of(ids, size)
    blocks, words, word_at = [], [], 0
    for at in range(0, len(ids), rans.BLOCK):
        part = ids[at : at + rans.BLOCK]
        states, raw, crc = rans.encode(part, table)
        blocks.append({"before": at, "n": len(part), "word_at": word_at, "n_words": len(raw) // 4, "states": states, "crc32": crc})
        words.append(raw)
        word_at += len(raw) // 4
    return table.dump(), blocks, b"".join(words)


def unpack_block(freq: bytes | rans.Table, block: dict, words: bytes) -> np.ndarray:
    """The ids of one block, checked; needs no other block."""
    table = freq if isinstance(freq, rans.Table) else rans.Table.parse(freq)
    raw = words[4 * block["word_at"] : 4 * (block["word_at"] + block["n_words"])]
    ids = rans.decode(block["n"], block["states"], raw, table)
    if rans.checksum(ids) != block["crc32"]:
        raise ValueError("a block of ids doesn't have its checksum")
    return ids


def unpack_segment(row: dict) -> np.ndarray:
    table = rans.Table.parse(row["freq"])
    return np.concatenate([unpack_block(table, b, row["words"]) for b in row["blocks"]] or [np.zeros(0, np.uint32)])


def encode_documents(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, end_id: int, segment: int = SEGMENT, added: bool = False) -> DataFrame:
    """Rows of ``SCHEMA`` for all documents, shards in ascending order of id."""
    ship(docs.sparkSession)
    narrow = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    dealt = narrow.repartitionByRange(partitions(docs.select(text_col)), "_id").sortWithinPartitions("_id", "_text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.load(tokenizer, added)
        end = np.array([end_id], encoder.dtype).tobytes()
        shard, number = TaskContext.get().partitionId(), 0
        doc_ids: list[int | None] = []
        lens: list[int] = []
        held: list[bytes] = []
        total = 0

        def flush() -> pa.RecordBatch:
            freq, blocks, words = pack_segment(np.frombuffer(b"".join(held), encoder.dtype), encoder.size)
            return pa.RecordBatch.from_pylist([{"shard": shard, "segment": number, "n_tokens": total, "doc_ids": doc_ids, "doc_lens": lens, "freq": freq, "blocks": blocks, "words": words}], ROW)

        for batch in slices(batches, 64):
            for doc, packed in zip(batch.column(0).to_pylist(), encoder.packed(batch.column(1).to_pylist()), strict=True):
                n = len(packed) // encoder.dtype.itemsize + 1
                doc_ids.append(doc)
                lens.append(n)
                held += (packed, end)
                total += n
                if total >= segment:
                    yield flush()
                    doc_ids, lens, held, total, number = [], [], [], 0, number + 1
        if doc_ids:
            yield flush()

    return dealt.mapInArrow(encode, SCHEMA)


def write_tokens(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, end_id: int, path: str, segment: int = SEGMENT, added: bool = False) -> None:
    """Writes the table to ``path``; its files hold 32 segments at most, some 40 MB."""
    encode_documents(docs, id_col, text_col, tokenizer, end_id, segment, added).write.option("compression", "none").option("maxRecordsPerFile", 32).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(T._parse_datatype_string(SCHEMA)).parquet(path)


def segment_starts(segments: DataFrame) -> DataFrame:
    """(shard, segment, base): how many ids stand before each segment. Only one row for each shard meets in one task."""
    narrow = segments.select("shard", "segment", "n_tokens")
    within = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = narrow.groupBy("shard").agg(F.sum("n_tokens").alias("shard_tokens")).select("shard", F.coalesce(F.sum("shard_tokens").over(over), F.lit(0)).alias("shard_base"))
    inside = narrow.select("shard", "segment", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)).alias("inside"))
    return inside.join(shards, "shard").select("shard", "segment", (F.col("shard_base") + F.col("inside")).alias("base"))


def document_digests(segments: DataFrame) -> DataFrame:
    """(shard, segment, doc_id, at, n_tokens, ids_crc32) of each document, from the decoded ids; ``at`` counts from the segment's start."""
    ship(segments.sparkSession)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            row = batch.to_pylist()[0]
            ids = unpack_segment(row).astype("<u4")
            ends = np.cumsum(row["doc_lens"])
            starts = ends - row["doc_lens"]
            n = len(ends)
            yield pa.RecordBatch.from_arrays([pa.array([row["shard"]] * n, pa.int32()), pa.array([row["segment"]] * n, pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(starts, pa.int64()), pa.array(row["doc_lens"], pa.int64()), pa.array([rans.checksum(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.int64())], ["shard", "segment", "doc_id", "at", "n_tokens", "ids_crc32"])

    return segments.mapInArrow(digest, "shard int, segment int, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint")


def token_digest(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", added: bool = False) -> DataFrame:
    """Writes the documents' ids to ``path``, reads them back: doc_id, start, n_tokens, ids_crc32."""
    write_tokens(docs, id_col, text_col, tokenizer, end_id, path, added=added)
    segments = read_tokens(docs.sparkSession, path)
    found = document_digests(segments).join(segment_starts(segments), ["shard", "segment"])
    return found.select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
