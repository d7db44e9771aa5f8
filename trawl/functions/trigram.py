"""Trigrams of text: three consecutive characters as a 24-bit code, with byte position and case flags.

An ASCII character counts as its lower-case byte, another one as the low byte of the CRC-32 of its lower-case UTF-8, 0
replaced by 1. Flags: bits 0 to 2 for upper-case characters, bit 7 if any is not ASCII.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.sources.ship import ship

MAX_POSITION = (1 << 24) - 1
POSTINGS = "trigram int, doc_key bigint, occ array<struct<pos: int, flags: int>>"
#: Of a trigram in some documents: df: how many; keys: which, ascending; counts: occurrences in each; occ: positions, each less the one before
#: in its document, with flags in the top byte. The binaries are transposed 32-bit numbers.
BLOCKS = "trigram int, df int, n_occ int, keys array<bigint>, counts binary, occ binary"
#: Trigrams of documents that are sorted together, of a row about at most, and of a batch that goes back to Spark.
BLOCK, ROW, OUT = 1 << 22, 1 << 15, 1 << 19


def char_code(c: str) -> int:
    if c.isascii():
        return ord(c.lower())
    return max(zlib.crc32(c.lower().encode("utf-8", "surrogatepass")) & 0xFF, 1)


_CODES = np.array([char_code(chr(i)) for i in range(128)], np.uint32)
_UPPER = np.array([chr(i).isupper() for i in range(128)])


def occurrences(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, byte positions, flags) of all trigrams in order; those with a zero character are left out."""
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    n = len(chars) - 2
    if n <= 0:
        return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32)
    wide = chars >= 128
    low = np.where(wide, 0, chars)
    code, upper = _CODES[low], _UPPER[low]
    size = np.ones(len(chars), np.int64)
    if wide.any():
        size += wide.astype(np.int64) + (chars >= 0x800) + (chars >= 0x10000)
        for c in np.unique(chars[wide]).tolist():
            at = chars == c
            code[at] = char_code(chr(c))
            upper[at] = chr(c).isupper()
    pos = np.cumsum(size)[:-2] - size[:-2]
    codes = code[:-2] | code[1:-1] << 8 | code[2:] << 16
    flags = upper[:-2] * 1 + upper[1:-1] * 2 + upper[2:] * 4 + (wide[:-2] | wide[1:-1] | wide[2:]) * 0x80
    real = (code[:-2] > 0) & (code[1:-1] > 0) & (code[2:] > 0)
    return codes[real].astype(np.int32), pos[real], flags[real].astype(np.int32)


def code_of(trigram: str) -> int:
    if len(trigram) != 3 or 0 in (codes := [char_code(c) for c in trigram]):
        raise ValueError("not a trigram")
    return codes[0] | codes[1] << 8 | codes[2] << 16


def codes_of(text: str) -> list[int]:
    return occurrences(text)[0].tolist()


def _transposed(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary for each slice of the values: all their low bytes, then all their second bytes and so on, which compresses well."""
    out = np.empty(4 * len(values), np.uint8)
    step = np.repeat(sizes, sizes)
    at = np.arange(len(values)) + 3 * np.repeat(starts, sizes)  # four times the slice's start, and the place in it
    for k in range(4):
        out[at] = (values >> np.uint32(8 * k)).astype(np.uint8)
        at += step
    bounds = np.append(4 * starts, 4 * len(values)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(out)])


def _restored(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _firsts(*columns: np.ndarray) -> np.ndarray:
    """Where any of the columns differs from the row before."""
    change = np.zeros(max(0, len(columns[0]) - 1), bool)
    for c in columns:
        change |= c[1:] != c[:-1]
    return np.concatenate([[0], np.flatnonzero(change) + 1])


def _block(docs: list[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """The postings of some documents, by trigram and key. docs: key, codes, positions with flags in the top byte."""
    docs.sort(key=lambda d: d[0])
    owner = np.repeat(np.arange(len(docs), dtype=np.int32), [len(c) for _, c, _ in docs])
    codes = np.concatenate([c for _, c, _ in docs])
    order = codes.astype(np.int64) << 32 | np.arange(len(codes))
    order.sort()  # by code, then as the documents and their positions are
    codes = (order >> 32).astype(np.int32)
    order &= 0xFFFFFFFF
    owner, occ = owner[order], np.concatenate([o for *_, o in docs])[order]
    del order
    first = _firsts(codes, owner)
    often = np.diff(np.append(first, len(codes)))
    where = occ & np.uint32(MAX_POSITION)
    gaps = np.empty_like(where)
    gaps[1:] = where[1:] - where[:-1]
    gaps[first] = where[first]
    occ = gaps | occ & np.uint32(0xFF000000)
    keys = np.array([k for k, *_ in docs], np.int64)[owner[first]]
    begin = first[np.repeat(g := _firsts(codes[first]), np.diff(np.append(g, len(first))))]  # of each posting's trigram
    rows = _firsts(codes[first], (first - begin) // ROW)
    df, starts = np.diff(np.append(rows, len(first))), first[rows]
    n_occ = np.diff(np.append(starts, len(codes)))
    lists = pa.ListArray.from_arrays(pa.array(np.append(rows, len(first)), pa.int32()), pa.array(keys))
    batch = pa.RecordBatch.from_arrays([pa.array(codes[starts]), pa.array(df, pa.int32()), pa.array(n_occ, pa.int32()), lists, _transposed(often.astype(np.uint32), rows, df), _transposed(occ, starts, n_occ)], ["trigram", "df", "n_occ", "keys", "counts", "occ"])
    cuts = [*np.unique(np.searchsorted(starts, np.arange(0, len(codes), OUT))).tolist(), len(rows)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if a < b:
            yield batch.slice(a, b - a)


def blocks(docs: DataFrame, key_col: str, text_col: str) -> DataFrame:
    """Postings by blocks of documents that lie together: a row for each trigram of a block, or some where they are many, in order of
    trigram and key. Documents stay where they are: nothing is shuffled, and a worker holds one block."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                c, p, f = occurrences(text.as_py())
                if not len(c):
                    continue
                if p[-1] > MAX_POSITION:
                    raise ValueError(f"document {key}: positions beyond {MAX_POSITION} can't be indexed")
                held.append((key, c, p.astype(np.uint32) | f.astype(np.uint32) << np.uint32(24)))
                size += len(c)
                if size >= BLOCK:
                    yield from _block(held)
                    held, size = [], 0
        if held:
            yield from _block(held)

    ship(docs.sparkSession)
    narrow = docs.where(F.col(text_col).isNotNull() & F.col(key_col).isNotNull()).select(F.col(key_col).cast("bigint").alias("doc_key"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(extract, BLOCKS)


def expanded(found: DataFrame) -> DataFrame:
    """One row for each trigram of each document, its occurrences in order, from rows of blocks."""

    def whole(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for code, keys, counts, packed in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3), strict=True):
                often, occ = _restored(counts.as_py()).astype(np.int64), _restored(packed.as_py())
                ends = np.cumsum(often)
                sums = np.cumsum(occ & np.uint32(MAX_POSITION), dtype=np.int64)
                before = np.concatenate([[0], sums[ends[:-1] - 1]])
                pos = pa.array(sums - np.repeat(before, often), pa.int32())
                flags = pa.array(occ >> np.uint32(24), pa.int32())
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.StructArray.from_arrays([pos, flags], ["pos", "flags"]))
                held.append(pa.RecordBatch.from_arrays([pa.array(np.full(len(often), code), pa.int32()), keys.values, lists], ["trigram", "doc_key", "occ"]))
                size += len(occ)
                if size >= OUT:
                    yield from whole(held)
                    held, size = [], 0
        if held:
            yield from whole(held)

    ship(found.sparkSession)
    return found.select("trigram", "keys", "counts", "occ").mapInArrow(expand, POSTINGS)


def ascii_frequencies(found: DataFrame) -> DataFrame:
    """(trigram, df, n_occ) of occurrences in which all characters are ASCII, by their flags, from rows of blocks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            df, n_occ = [], []
            for counts, packed in zip(batch.column(1), batch.column(2), strict=True):
                flags = np.frombuffer(packed.as_py(), np.uint8)[len(packed.as_py()) // 4 * 3 :]
                own = flags < 0x80
                often = _restored(counts.as_py()).astype(np.int64)
                df.append(np.count_nonzero(np.add.reduceat(own, np.cumsum(often) - often, dtype=np.int64)))
                n_occ.append(np.count_nonzero(own))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(df, pa.int64()), pa.array(n_occ, pa.int64())], ["trigram", "df", "n_occ"])

    ship(found.sparkSession)
    each = found.select("trigram", "counts", "occ").mapInArrow(count, "trigram int, df bigint, n_occ bigint").where("n_occ > 0")
    return each.groupBy("trigram").agg(F.sum("df").alias("df"), F.sum("n_occ").alias("n_occ"))


def postings(docs: DataFrame, key_col: str, text_col: str) -> DataFrame:
    """One row for each trigram of each document, its occurrences in order. Documents are whole in their row, so nothing is shuffled."""
    return expanded(blocks(docs, key_col, text_col))


def trigrams(text: Column) -> Column:
    """Lower-cased three-character windows, in order, as an array; a look-ahead at each character, so linear in length."""
    return F.regexp_extract_all(F.lower(text), F.lit("(?s)(?=(...))."), F.lit(1))


_BITS = 21  # of a character


def trigram_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(trigram, df, n_occ) of the lower-cased windows of three characters, over all rows. Rows are counted where they lie; only
    sums over slices of rows, a row for each of their distinct trigrams, are shuffled."""
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                distinct, often = [], []
                for text in batch.column(0).slice(start, 256).to_pylist():
                    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
                    own, n = np.unique(c[:-2] << 2 * _BITS | c[1:-1] << _BITS | c[2:], return_counts=True)
                    distinct.append(own)
                    often.append(n)
                codes, place = np.unique(np.concatenate([*distinct, np.zeros(0, np.int64)]), return_inverse=True)
                if not len(codes):
                    continue
                df = np.bincount(place)
                n_occ = np.bincount(place, np.concatenate(often)).astype(np.int64)
                chars = np.stack([codes >> 2 * _BITS, codes >> _BITS & (1 << _BITS) - 1, codes & (1 << _BITS) - 1], axis=1)
                whole = np.ascontiguousarray(chars.astype("<u4")).tobytes().decode("utf-32-le", "surrogatepass")
                yield pa.RecordBatch.from_arrays([pa.array([whole[k : k + 3] for k in range(0, len(whole), 3)]), pa.array(df), pa.array(n_occ)], ["trigram", "df", "n_occ"])

    lowered = docs.where(F.col(text_col).isNotNull()).select(F.lower(F.col(text_col)).alias("text"))
    each = lowered.mapInArrow(count, "trigram string, df bigint, n_occ bigint")
    return each.groupBy("trigram").agg(F.sum("df").alias("df"), F.sum("n_occ").alias("n_occ"))


def _char_code(c: Column) -> Column:
    return F.when(F.octet_length(c) == 1, F.ascii(F.lower(c))).otherwise(F.greatest(F.crc32(F.encode(F.lower(c), "UTF-8")).bitwiseAND(F.lit(255)), F.lit(1)).cast("int"))


def text_to_trigram(text: Column) -> Column:
    """The code of a text of exactly three characters; an error for others and for zero characters; null for null."""
    parts = [_char_code(F.substring(text, k, 1)) for k in (1, 2, 3)]
    code = parts[0].bitwiseOR(F.shiftleft(parts[1], 8)).bitwiseOR(F.shiftleft(parts[2], 16)).cast("bigint")
    bad = (F.char_length(text) != 3) | F.contains(text, F.lit("\0"))
    return F.when(text.isNull(), F.lit(None).cast("bigint")).when(bad, F.raise_error(F.lit("not a trigram")).cast("bigint")).otherwise(code)


def trigram_to_text(code: Column) -> Column:
    """The three bytes of a code as text; flags in the top byte are ignored, bytes that aren't UTF-8 become U+FFFD, a zero byte is an error."""
    parts = [F.shiftright(code, s).bitwiseAND(F.lit(255)) for s in (0, 8, 16)]
    out_of_range = (code < 0) | (code > 0xFFFFFFFF)
    hexed = F.concat(*[F.lpad(F.hex(p), 2, "0") for p in parts])
    bad = out_of_range | (parts[0] == 0) | (parts[1] == 0) | (parts[2] == 0)
    return F.when(code.isNull(), F.lit(None).cast("string")).when(bad, F.raise_error(F.lit("not a trigram")).cast("string")).otherwise(F.make_valid_utf8(F.unhex(hexed).cast("string")))
