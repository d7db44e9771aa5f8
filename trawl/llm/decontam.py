"""Documents that hold benchmark passages, by the q-gram lemma and banded alignment.

Texts are compared in lower case with each run of white space as one space. A passage of m characters with at most
e edits keeps at least m - q + 1 - q e of its q-grams, on diagonals (document position less passage position) at most e
apart. Rolling hashes of all q-grams of whole documents are looked up among the passages' q-grams; hits are counted in
diagonal bands that overlap by half, so that any e + 1 diagonals lie in one band; bands that reach the bound
are aligned within the band, with free ends in the document. Passages longer than ``window`` are
cut into windows that overlap by half, each of which counts as a passage of its own.

e is ``rate`` of a passage's length, or the most for which the lemma's bound is 1 if that is less. A passage of fewer
than q characters has no q-grams: it must stand as it is, as whole words. Empty passages are in no text; null texts are empty;
passages with equal ids are separate passages, of which a document's best place counts, ties to the first place. Texts may have
any length: they are searched in slices that overlap by more than a window, hits are counted a bounded number at a time.
Extra columns are kept or ignored, whatever their names.

The passages are a side table, taken in blocks of at most ``BLOCK_CHARS`` characters: each block is broadcast and costs
one pass over the documents, so no block outgrows a worker, whatever the benchmark's size. Documents are
never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.cluster import ship, slices

Q, RATE, WINDOW = 10, 0.08, 400
BLOCK_CHARS = 4_000_000
#: Characters of a text in which hits are counted at once, and hits.
SLICE, HITS = 1 << 14, 1 << 20
FILTER_BITS = 24
_BASE = 0x9E3779B97F4A7C15


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def qgram_hashes(chars: np.ndarray, q: int) -> np.ndarray:
    """A polynomial hash of each window of q characters, built from windows of powers of two."""
    n = len(chars) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, width = chars.astype(np.uint64), 1
    out, have = np.zeros(n, np.uint64), 0
    while True:
        if q & width:
            out = out * np.uint64(pow(_BASE, width, 1 << 64)) + power[have : have + n]
            have += width
        if width * 2 > q:
            break
        power = power[:-width] * np.uint64(pow(_BASE, width, 1 << 64)) + power[width:]
        width *= 2
    return (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def budget(m: int, q: int, rate: float) -> int:
    return max(0, min(int(rate * m), (m - q) // q))


@dataclass
class Passages:
    """A block of passages and the index of their q-grams. Equal texts are one passage with the items of all."""

    items: list[int | None]
    texts: list[str]
    q: int
    rate: float

    def __post_init__(self) -> None:
        owners: dict[str, list[int | None]] = {}
        for item, text in zip(self.items, self.texts, strict=True):
            owners.setdefault(text, []).append(item)
        self.short = {tuple(t.split(" ")): own for t, own in owners.items() if 0 < len(t) < self.q}
        self.widths = sorted({len(w) for w in self.short})
        self.texts = [t for t in owners if len(t) >= self.q]
        self.items_of = [owners[t] for t in self.texts]
        self.longest = max(map(len, self.texts), default=0)
        lengths = np.array([len(t) for t in self.texts], np.int64)
        self.edits = np.array([budget(int(m), self.q, self.rate) for m in lengths], np.int64)
        self.least = lengths - self.q + 1 - self.q * self.edits
        self.half = self.edits + 1
        hashes = [qgram_hashes(codes(t), self.q) for t in self.texts]
        grams = np.concatenate([*hashes, np.zeros(0, np.uint64)])
        owner = np.repeat(np.arange(len(self.texts)), [len(h) for h in hashes])
        place = np.concatenate([*[np.arange(len(h)) for h in hashes], np.zeros(0, np.int64)]).astype(np.int64)
        order = np.argsort(grams, kind="stable")
        self.owner, self.place = owner[order], place[order]
        self.grams, self.first, self.count = np.unique(grams[order], return_index=True, return_counts=True)
        self.filter = np.zeros(1 << FILTER_BITS, np.bool_)
        self.filter[(self.grams >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def words(self, text: str) -> dict[tuple[str, ...], tuple[int, int, int]]:
        """Passages too short for q-grams -> their first place."""
        out: dict[tuple[str, ...], tuple[int, int, int]] = {}
        if self.short and text:
            words = text.split(" ")
            starts = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])]).tolist()
            for n in self.widths:
                for k in range(len(words) - n + 1):
                    own = tuple(words[k : k + n])
                    if own in self.short and own not in out:
                        out[own] = (0, starts[k], starts[k + n] - 1)
        return out

    def regions(self, chars: np.ndarray, known: Callable[[int], bool] = lambda p: False) -> Iterator[tuple[int, int]]:
        """(passage, first diagonal of the band) of all bands that reach the lemma's bound. known: whether a passage needn't be counted any more."""
        over = self.longest + 2 * int(self.half.max(initial=1)) + self.q
        step = max(SLICE, over)
        seen: set[tuple[int, int]] = set()
        for begin in range(0, max(1, len(chars) - over), step):
            for found in self._regions(chars[begin : begin + step + over], begin, known):
                if found not in seen:
                    seen.add(found)
                    yield found

    def _regions(self, chars: np.ndarray, begin: int, known: Callable[[int], bool]) -> Iterator[tuple[int, int]]:
        hashes = qgram_hashes(chars, self.q)
        at = np.flatnonzero(self.filter[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        if not len(at) or not len(self.grams):
            return
        found = np.searchsorted(self.grams, hashes[at])
        found[found == len(self.grams)] = 0
        same = self.grams[found] == hashes[at]
        at, found = at[same], found[same]
        if not len(at):
            return
        total = np.cumsum(self.count[found])
        base = begin + len(chars) + 2 * int(self.half.max(initial=1)) + 2 * self.longest  # band numbers lie within it on either side
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(total // HITS)) + 1):
            n = self.count[found[part]]
            take = np.repeat(self.first[found[part]] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
            owner = self.owner[take]
            band = (np.repeat(at[part] + begin, n) - self.place[take]) // self.half[owner]
            key, times = np.unique(owner * (2 * base) + band + base, return_counts=True)
            keys, place = np.unique(np.concatenate([keys, key]), return_inverse=True)
            counts = np.bincount(place, np.concatenate([counts, times])).astype(np.int64)
        both, place = np.unique(np.concatenate([keys, keys - 1]), return_inverse=True)  # a hit counts in the band of its half and in the one that begins before it
        counts = np.bincount(place, np.concatenate([counts, counts])).astype(np.int64)
        owners = both // (2 * base)
        enough = counts >= self.least[np.minimum(owners, len(self.texts) - 1)]
        for o, b in zip(owners[enough].tolist(), (both[enough] % (2 * base) - base).tolist(), strict=True):
            if not known(o):
                yield o, b * int(self.half[o])


def ends(passage: np.ndarray, text: np.ndarray, shift: int, width: int, most: int) -> tuple[int, int]:
    """(fewest edits, end) of the passage in the text, free ends in the text, on the diagonals shift to shift + width - 1.

    Row i holds the cells of text positions i + shift + (0 .. width); cells outside the text are barred. Costs never fall
    along a path, so a row whose cells all exceed ``most`` ends the search.
    """
    far = np.int64(1 << 40)
    lane = np.arange(width + 1)
    m = len(passage)
    padded = np.full(len(text) + 2 * (m + width + 2) + abs(shift), -1, np.int64)
    offset = m + width + 1 + abs(shift)
    padded[offset : offset + len(text)] = text
    row = np.where((lane + shift >= 0) & (lane + shift <= len(text)), 0, far)
    for i in range(1, m + 1):
        pos = lane + i + shift
        before = padded[offset + i + shift - 1 : offset + i + shift + width]
        new = row + (before != passage[i - 1])
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        new[(pos < 0) | (pos > len(text))] = far
        row = np.minimum.accumulate(new - lane) + lane
        row[(pos < 0) | (pos > len(text))] = far
        if i % 16 == 0 and row.min() > most:
            return most + 1, 0
    best = int(np.argmin(row))
    return int(min(row[best], far)), best + m + shift


def matches(text: str, passages: Passages) -> dict[int, tuple[int, int, int]]:
    """passage -> (edits, begin, end) of its best place in the normal text, for those within their budgets; ties to the first."""
    chars = codes(text)
    out: dict[int, tuple[int, int, int]] = {}
    for p, low in passages.regions(chars, lambda p: p in out and out[p][0] == 0):
        wanted, e, half = passages.texts[p], int(passages.edits[p]), int(passages.half[p])
        begin = max(0, low - e)
        found = text.find(wanted, begin, max(0, low) + 2 * half + len(wanted) + e)
        if found >= 0:
            place = (0, found, found + len(wanted))
        else:
            own = codes(wanted)
            left = max(0, low - e)
            cost, end = ends(own, chars[left : low + 2 * half + 2 * e + len(own) + 2], low - e - left, 2 * half + 2 * e, e)
            if cost > e:
                continue
            end += left
            back, length = ends(own[::-1], chars[max(0, end - len(own) - e) : end][::-1], -e, 2 * e + 1, e)
            place = (cost, end - length if back == cost else max(0, end - len(own)), end)
        if p not in out or place < out[p]:
            out[p] = place
    return out


def places(text: str, passages: Passages) -> dict[int | None, tuple[int, int, int]]:
    """item -> its best place in the normal text."""
    best: dict[int | None, tuple[int, int, int]] = {}
    found = [(passages.items_of[p], place) for p, place in matches(text, passages).items()] + [(passages.short[w], place) for w, place in passages.words(text).items()]
    for items, place in found:
        for item in items:
            best[item] = min(best.get(item, place), place)
    return best


def blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", q: int = Q, rate: float = RATE, window: int = WINDOW, chars: int = BLOCK_CHARS) -> Iterator[Passages]:
    """The passages, a bounded block at a time; the driver holds one block."""
    items: list[int | None] = []
    texts: list[str] = []
    size = 0
    for item, raw in benchmark.select(F.col(item_col).cast("bigint"), text_col).toLocalIterator():
        text = normal(raw)
        if not text:
            continue
        cuts = range(0, max(1, len(text) - window // 2), window // 2) if len(text) > window else [0]
        for at in cuts:
            part = text[at : at + window] if len(text) > window else text
            items.append(item)
            texts.append(part)
            size += len(part)
            if size >= chars:
                yield Passages(items, texts, q, rate)
                items, texts, size = [], [], 0
    if items:
        yield Passages(items, texts, q, rate)


def found_passages(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", **how) -> DataFrame:
    """(doc_id, item_id, edits, begin, end): each document and passage within budget, at its best place; places are in the normal text."""
    spark = docs.sparkSession
    ship(spark)
    schema = "doc_id bigint, item_id bigint, edits int, begin bigint, end bigint"
    narrow = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_text"))

    def pass_over(block: Passages) -> DataFrame:
        shared = spark.sparkContext.broadcast(block)  # BLOCK_CHARS at most

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                rows = []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    rows += [(doc, item, *place) for item, place in places(normal(text), shared.value).items()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "item_id", "edits", "begin", "end"])

        return narrow.mapInArrow(find, schema)

    passes = [pass_over(b) for b in blocks(benchmark, item_col, item_text_col, **how)]
    return reduce(DataFrame.union, passes) if passes else spark.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that hold no passage; all columns, no shuffle."""
    spark = docs.sparkSession
    ship(spark)
    at = docs.columns.index(text_col)
    for block in blocks(benchmark, item_col, item_text_col, **how):
        shared = spark.sparkContext.broadcast(block)  # BLOCK_CHARS at most

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                yield batch.filter(pa.array([not places(normal(t), shared.value) for t in batch.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
