"""Unbounded n-gram scores of whole documents from sharded suffix arrays of the training part.

Training documents are those whose CRC-32 of the id's decimal text is not ``fold`` modulo ``folds`` (a null id counts as an
empty text). Texts are A-Z-lower-cased words and one end; null texts are empty. Words are XXH64 hashes from here on. Rows with
equal or null ids are separate rows; columns other than the two named are ignored, whatever their names.

1. Documents are dealt by a hash of their first eight words (64 or 512 where many begin alike), so that a shard holds all
   documents which begin like one of its own, and packed into batches of about two million words. Texts move once.
2. A context is the tokens before a position, nearest first, back to the document's START. Contexts of two tokens, then of three,
   and so on up to ``short``, of all positions are dealt by hash to ranges, once for each batch however frequent they are: sorted arrays of
   contexts cut short. Held-out positions search them for their longest match so far and its count; training
   positions go on only if some held-out position has their context.
3. A held-out position whose context of ``short`` tokens occurs is told the shards that have it. For each of those shards, the runs of
   positions whose contexts it has go there, equal ones once; its suffix array of whole contexts gives each position's longest
   match, of any length, by binary search, and how often it occurs. A match reaches no further back than its run.
4. Answers are merged by position: the longest length over the shards asked, counts summed over those that reach it.
5. A training document's longest context is all that precedes: the shard's array has it as a range, whose size is its
   count. Beginnings too short for the shard to hold all of are counted like words.
6. With length m and count c of the longest context before a word, its continuation count is the count after the word if
   the length there is m + 1, else 0: P = (continuation + mu * base) / (c + mu), mu = 0.05 + 1000 / m**3, which sums to 1
   over the vocabulary and one unknown word. Long contexts are trusted at once, short ones once they are frequent.

Work and shuffled bytes grow with the corpus, not with its square: each round sends a batch's distinct contexts once, and what
copies nothing asks no suffix array. A task holds one shard or one batch. Very long texts are batches of their own. A passage that
many shards hold is asked of all of them, once for each batch.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.llm.cluster import drop, ship, slices, staged
from trawl.llm.suffixes import BASE, END, START, Shard, powers, rolled

BATCH, FOLDS, FOLD = 1 << 21, 7, 2
#: Bytes of text for each shard, and of texts that begin alike before more of their words tell them apart.
SHARD_BYTES, ALIKE_BYTES = 18 << 20, 6 << 20
#: Tokens of stretches that a shard's task holds at once.
ASKED = 1 << 22
#: Pairs of a held-out position and a shard that a batch's task holds at once.
PAIRS = 1 << 22
#: Words by which documents are dealt.
DEPTHS = (8, 64, 512)

_BATCHES = "batch bigint, held boolean, doc_ids array<bigint>, sizes array<int>, depths array<int>, words binary, places binary"
_BATCH_ROW = pa.schema([("batch", pa.int64()), ("held", pa.bool_()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("depths", pa.list_(pa.int32())), ("words", pa.binary()), ("places", pa.binary())])
#: What batches and shards send each other: goal: the shard, or the batch; kind: of message; parts: packed arrays.
_MESSAGES = "goal bigint, source bigint, kind int, a binary, b binary, c binary"
_MESSAGE = pa.schema([("goal", pa.int64()), ("source", pa.int64()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
WORDS, HEADS, TRAIN, HELD, STATE, TOTALS, TIES, STRETCH = range(8)
Message = tuple[int, int, int, bytes | None, bytes | None, bytes | None]


def is_held(doc: int | None, folds: int, fold: int) -> bool:
    return zlib.crc32(b"" if doc is None else str(doc).encode()) % folds == fold


def split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_hashes(words: list[bytes]) -> list[int]:
    """XXH64 of the words; 0 to 2 stand for other things."""
    h = xxhash.xxh64_intdigest
    return [x if (x := h(w)) > 2 else x + 3 for w in words]


# packed arrays

_CODEC = pa.Codec("zstd", 1)


def squeezed(values: np.ndarray) -> bytes:
    """Non-negative integers: bytes of equal weight together, compressed."""
    width = 4 if values.max(initial=0) < 1 << 32 else 8
    raw = np.ascontiguousarray(values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes()
    return len(values).to_bytes(7, "little") + bytes([width]) + _CODEC.compress(raw, asbytes=True)


def unsqueezed(packed: bytes) -> np.ndarray:
    n, width = int.from_bytes(packed[:7], "little"), packed[7]
    raw = _CODEC.decompress(packed[8:], decompressed_size=width * n, asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(f"<u{width}").ravel().astype(np.int64)


def squeezed_keys(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys, as differences."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    raw = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes()
    return len(keys).to_bytes(8, "little") + _CODEC.compress(raw, asbytes=True)


def unsqueezed_keys(packed: bytes) -> np.ndarray:
    n = int.from_bytes(packed[:8], "little")
    raw = _CODEC.decompress(packed[8:], decompressed_size=8 * n, asbytes=True) if n else b""
    steps = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").ravel()
    return np.cumsum(steps, dtype=np.uint64)


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of pairs of 64-bit numbers."""
    x = (a ^ (a >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9) + b
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys ascending, place of each key among them, an index of each distinct key)."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    places = np.empty(len(keys), np.int64)
    places[order] = np.cumsum(new) - 1
    return ordered[new], places, order[new]


def looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The values of wanted keys, 0 for those that aren't there; keys ascending."""
    if not len(keys):
        return np.zeros(len(wanted), values.dtype)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return np.where(keys[at] == wanted, values[at], 0)


# dealing

_SPACE = r"[\x20\x09-\x0D]"


def family(text: Column, words: int) -> Column:
    """A hash of the first words, that documents of the same first words share."""
    first = F.regexp_extract(text, rf"^{_SPACE}*((?:[^\x20\x09-\x0D]+{_SPACE}+){{0,{words - 1}}}[^\x20\x09-\x0D]*)", 1)
    lowered = F.translate(first, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.xxhash64(F.filter(F.split(lowered, rf"{_SPACE}+"), lambda w: w != ""), F.lit(words))


def deal(docs: DataFrame, id_col: str, text_col: str, shard_bytes: int, alike_bytes: int) -> tuple[DataFrame, int]:
    """(_id, _text, _depth), in as many partitions as there are shards, and their number. Documents that share their first _depth words share a partition."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rows.withColumn("_family", family(F.col("_text"), DEPTHS[0])).withColumn("_depth", F.lit(DEPTHS[0]))
    total, alike = 0, alike_bytes
    for k, depth in enumerate(DEPTHS[1:], 1):
        sizes = staged((rows if k == 1 else rows.where(F.col("_depth") == DEPTHS[k - 1])).groupBy("_family").agg(F.sum(F.octet_length("_text") + 16).alias("n")), "ngram-families")
        if k == 1:
            total = int(sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
            alike = max(alike_bytes, total // 1_000_000)
        many = sizes.where(F.col("n") > alike).select(F.col("_family").alias("_alike"))  # fewer than a million rows, whatever the documents
        if not many.head(1):
            break
        again = F.col("_alike").isNotNull()
        met = rows.join(F.broadcast(many), F.col("_family") == F.col("_alike"), "left")
        rows = met.select("_id", "_text", F.when(again, family(F.col("_text"), depth)).otherwise(F.col("_family")).alias("_family"), F.when(again, F.lit(depth)).otherwise(F.col("_depth")).alias("_depth"))
    shards = max(1, -(-total // shard_bytes))
    return rows.repartition(shards, "_family").select("_id", "_text", "_depth"), shards


def packed(dealt: DataFrame, folds: int, fold: int, batch_words: int) -> DataFrame:
    """Rows of ``_BATCHES``, of training or of held-out documents: the distinct words of a batch, frequent ones first, and each word's place among them. A batch's number has its shard's above 32 bits."""

    def row(number: int, held: bool, documents: list[tuple[int | None, int, np.ndarray]], known: dict[bytes, int]) -> pa.RecordBatch:
        ids, depths, codes = zip(*documents, strict=True)
        places = np.concatenate(codes)
        order = np.argsort(-np.bincount(places, minlength=len(known)), kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        words = np.array(word_hashes(list(known)), "<u8")[order]
        return pa.RecordBatch.from_pylist([{"batch": number, "held": held, "doc_ids": ids, "sizes": [len(c) for c in codes], "depths": depths, "words": words.tobytes(), "places": squeezed(rank[places])}], _BATCH_ROW)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        open_: dict[bool, list] = {}
        for batch in slices(batches):
            for doc, text, depth in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                words, held = split(text), is_held(doc, folds, fold)
                own = open_.setdefault(held, [0, [], defaultdict(count().__next__)])
                own[1].append((doc, depth, np.fromiter(map(own[2].__getitem__, words), np.int32, len(words))))
                own[0] += len(words) + 2
                if own[0] >= batch_words:
                    yield row(number, held, *open_.pop(held)[1:])
                    number += 1
        for held, own in open_.items():
            yield row(number, held, *own[1:])
            number += 1

    return dealt.mapInArrow(pack, _BATCHES)


class Batch:
    """A batch's tokens, START and END included, and what is known of its positions: position i stands after token i."""

    def __init__(self, row: pa.RecordBatch):
        get = lambda name: row.column(row.schema.get_field_index(name))[0]
        self.number = get("batch").as_py()
        self.doc_ids, self.held = get("doc_ids"), get("held").as_py()
        self.words = np.frombuffer(get("words").as_buffer(), "<u8")
        self.places = unsqueezed(get("places").as_py())
        self.sizes = get("sizes").values.to_numpy().astype(np.int64) + 2
        self.depths = get("depths").values.to_numpy().astype(np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        n = int(self.ends[-1])
        self.inner = np.ones(n, bool)
        self.inner[self.starts] = self.inner[self.ends - 1] = False
        self.tokens = np.empty(n, np.uint64)
        self.tokens[self.starts], self.tokens[self.ends - 1] = START, END
        self.tokens[self.inner] = self.words[self.places]
        self.room = np.arange(1, n + 1) - np.repeat(self.starts, self.sizes)
        self.hashes = 1, self.tokens
        self.rolled: np.ndarray | None = None

    def contexts(self, length: int) -> np.ndarray:
        """Hashes of the nearest ``length`` tokens; beyond START there is 0. The last ones asked for are kept. Only of use where ``room`` is length - 1 at least."""
        n, hashes = self.hashes if self.hashes[0] <= length else (1, self.tokens)
        while n < length:
            further = np.zeros(len(self.tokens), np.uint64)
            further[n:] = self.tokens[: max(0, len(self.tokens) - n)]
            n += 1
            hashes = mixed(hashes, np.where(self.room >= n, further, np.uint64(0)))
        self.hashes = n, hashes
        return hashes

    def heads(self) -> tuple[np.ndarray, np.ndarray]:
        """(positions, keys) of the training documents' beginnings that count like words."""
        depth = np.repeat(self.depths, self.sizes)
        at = np.flatnonzero((self.room > 1) & (self.room <= depth + 1))
        sums, power, room = self.sums(), powers(int(self.room[at].max(initial=1)), BASE), self.room[at]
        return at, mixed(sums[at + 1] - sums[np.repeat(self.starts, self.sizes)[at]] * power[room], room.astype(np.uint64))

    def sums(self) -> np.ndarray:
        """Rolling hashes, see ``suffixes.rolled``."""
        if self.rolled is None:
            self.rolled = rolled(self.tokens)
        return self.rolled


    def asking(self, length: int, live: np.ndarray) -> Asked:
        """The distinct contexts of that length of live positions."""
        at = np.flatnonzero(live & (self.room >= length))
        return Asked(at, *grouped(self.contexts(length)[at])[:2])


class Asked:
    """Distinct keys of positions, dealt to shards by hash, ascending for each."""

    def __init__(self, at: np.ndarray, keys: np.ndarray, places: np.ndarray):
        self.at, self.keys, self.places = at, keys, places

    def send(self, shards: int) -> Iterator[tuple[int, np.ndarray]]:
        """(shard, which keys) for shards that get any."""
        order, cuts = self.dealt(shards)
        for shard in np.flatnonzero(np.diff(cuts)).tolist():
            yield shard, order[cuts[shard] : cuts[shard + 1]]

    def dealt(self, shards: int) -> tuple[np.ndarray, np.ndarray]:
        goal = (self.keys >> np.uint64(20)) % np.uint64(shards)
        order = np.argsort(goal.astype(np.uint16 if shards <= 1 << 16 else np.uint32), kind="stable")
        return order, np.concatenate([[0], np.cumsum(np.bincount(goal.astype(np.int64), minlength=shards))])

    def told(self, shards: int, answers: dict[int, np.ndarray]) -> np.ndarray:
        """Shards' answers for the keys they were sent, by position of ``at``."""
        out = np.zeros(len(self.keys), np.int64)
        order, cuts = self.dealt(shards)
        for shard, values in answers.items():
            out[order[cuts[shard] : cuts[shard + 1]]] = values
        return out[self.places]


def messages(rows: list[Message]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _MESSAGE, strict=True)], schema=_MESSAGE)


def by_goal(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, list[Message]]]]:
    """(goal, kind -> messages), rows sorted by goal; a goal's messages are bounded by its shard or batch."""
    goal, held = None, defaultdict(list)
    for batch in slices(rows, 64):
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0] != goal:
                if goal is not None:
                    yield goal, held
                goal, held = row[0], defaultdict(list)
            held[row[2]].append(row)
    if goal is not None:
        yield goal, held


def shares(load: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of neighbours with a load, which together have about ``most`` or are one alone."""
    some = np.flatnonzero(load)
    share = (np.cumsum(load[some]) - 1) // most
    for run in np.split(some, np.flatnonzero(np.diff(share)) + 1):
        if len(run):
            yield int(run[0]), int(run[-1]) + 1


# rounds of short contexts

def summed(rows: list[Message]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(keys, totals, totals for each message's keys) of messages with keys and counts."""
    keys = [unsqueezed_keys(r[3]) for r in rows]
    counts = [unsqueezed(r[4]) for r in rows]
    distinct, places, _ = grouped(np.concatenate([*keys, np.zeros(0, np.uint64)]))
    totals = np.bincount(places, np.concatenate([*counts, np.zeros(0, np.int64)]), minlength=len(distinct)).astype(np.int64)
    return distinct, totals, np.split(totals[places], np.cumsum([len(k) for k in keys])[:-1]) if rows else []


def answers_of(shard: int, told: dict[int, list[Message]], last: bool) -> Iterator[Message]:
    """What batches get back: their states; totals of words and beginnings; counts of held-out contexts, in the last round with the
    document shards that have them; in others, which training contexts held-out documents have."""
    for row in told[STATE]:
        yield row[1], shard, STATE, *row[3:]
    for kind in (WORDS, HEADS):
        _, totals, parts = summed(told[kind])
        for row, part in zip(told[kind], parts, strict=True):
            yield row[1], shard, kind, squeezed(part), None, None
        if kind == WORDS and told[kind]:
            yield -1, shard, TOTALS, squeezed(np.array([totals.sum() >> 31, totals.sum() & 0x7FFFFFFF, np.count_nonzero(totals)])), None, None
    train, held = told[TRAIN], told[HELD]
    keys, totals, _ = summed(train)
    asked = [unsqueezed_keys(r[3]) for r in held]
    where, own = _holders(train) if last else (None, None)
    for row, wanted in zip(held, asked, strict=True):
        counts = looked_up(keys, totals, wanted)
        holders = None
        if last:  # how many shards, and which, for each context that occurs
            i = np.searchsorted(where, wanted[counts > 0])
            n = np.searchsorted(where, wanted[counts > 0], "right") - i
            holders = squeezed(np.concatenate([n, own[ranges(i, i + n)]]))
        yield row[1], shard, HELD, squeezed(counts), holders, None
    if not last:
        some = np.unique(np.concatenate([*asked, np.zeros(0, np.uint64)]))
        for row in train:
            yield row[1], shard, TRAIN, squeezed(looked_up(some, np.ones(len(some), np.int64), unsqueezed_keys(row[3]))), None, None


def _holders(train: list[Message]) -> tuple[np.ndarray, np.ndarray]:
    """(keys ascending, document shards that have them), without repeats."""
    keys = np.concatenate([*[unsqueezed_keys(r[3]) for r in train], np.zeros(0, np.uint64)])
    own = np.repeat(np.array([r[1] >> 32 for r in train], np.int64), np.array([int.from_bytes(r[3][:8], "little") for r in train], np.int64))
    order = np.lexsort((own, keys))
    keys, own = keys[order], own[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (own[1:] != own[:-1])
    return keys[new], own[new]


def ranges(first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers from each first to before each end."""
    n = end - first
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


class Known:
    """What rounds have told of a batch's positions. live: that the next round asks about; of held-out positions also the longest match so far and its count."""

    def __init__(self, own: Batch, shards: int, state: list[Message]):
        self.own, self.shards, n = own, shards, len(own.tokens)
        self.live, self.lengths, self.counts = np.ones(n, bool), np.ones(n, np.int64), np.zeros(n, np.int64)
        for m in state:
            self.live = unsqueezed(m[3]) > 0
            if own.held:
                self.lengths, self.counts = unsqueezed(m[4]), unsqueezed(m[5])

    def state(self) -> Message:
        held = self.own.held
        return (self.own.number >> 32) % self.shards, self.own.number, STATE, squeezed(self.live.astype(np.int64)), squeezed(self.lengths) if held else None, squeezed(self.counts) if held else None

    def learn(self, length: int, told: dict[int, list[Message]]) -> Asked:
        """Takes the answers to contexts of that length. Returns what had been asked."""
        asked = self.own.asking(length, self.live)
        counts = asked.told(self.shards, {m[1]: unsqueezed(m[3]) for m in told[HELD if self.own.held else TRAIN]})
        some = asked.at[counts > 0]
        if self.own.held:
            self.lengths[some], self.counts[some] = length, counts[counts > 0]
        self.live = np.zeros(len(self.live), bool)
        self.live[some] = True
        return asked

    def stretches(self, asked: Asked, told: dict[int, list[Message]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(shard, first positions, ends): runs of positions whose contexts, as last asked for, that document shard holds. What all shards hold
        has as many pairs of a position and a shard as there are shards, so they are made for some shards at a time."""
        order, cuts = asked.dealt(self.shards)
        by_place = np.argsort(asked.places, kind="stable")
        begins = np.searchsorted(asked.places[by_place], np.arange(len(asked.keys) + 1))

        def held(m: Message) -> tuple[np.ndarray, np.ndarray]:
            """(keys, shards that hold them)"""
            mine = order[cuts[m[1]] : cuts[m[1] + 1]][unsqueezed(m[3]) > 0]
            flat = unsqueezed(m[4])
            return np.repeat(mine, flat[: len(mine)]), flat[len(mine) :]

        load = np.zeros(0, np.int64)
        for m in told[HELD]:
            key, shard = held(m)
            more = np.bincount(shard, begins[key + 1] - begins[key], minlength=len(load)).astype(np.int64)
            more[: len(load)] += load
            load = more
        for low, high in shares(load, PAIRS):
            pairs = []
            for m in told[HELD]:
                key, shard = held(m)
                if low > 0 or high < len(load):
                    some = (shard >= low) & (shard < high)
                    key, shard = key[some], shard[some]
                first, end = begins[key], begins[key + 1]
                pairs.append(np.repeat(shard << 40, end - first) | asked.at[by_place[ranges(first, end)]])
            both = np.sort(np.concatenate(pairs))
            del pairs
            edge = np.flatnonzero(np.diff(both, prepend=-2) != 1)
            first, last = both[edge], both[np.append(edge[1:], len(both)) - 1]
            whose, place = first >> 40, (1 << 40) - 1
            cut = np.flatnonzero(np.diff(whose)) + 1
            for s, f, e in zip(np.split(whose, cut), np.split(first & place, cut), np.split((last & place) + 1, cut), strict=True):
                yield int(s[0]), f, e


_BOTH = "batch bigint, kind int, held boolean, doc_ids array<bigint>, sizes array<int>, depths array<int>, words binary, places binary, round int, source bigint, sort int, a binary, b binary, c binary"


def with_answers(batches: DataFrame, told: list[DataFrame]) -> DataFrame:
    """Batches, each before the messages of all rounds to it."""
    empty = {n: F.lit(None).cast(t).alias(n) for n, t in (x.split(" ") for x in _BOTH.split(", "))}
    own = batches.select(*[F.lit(0).alias("kind") if n == "kind" else F.col(n) if n in batches.columns else empty[n] for n in empty])
    out = own
    for r, answers in enumerate(told):
        given = {"batch": F.col("goal"), "kind": F.lit(1), "round": F.lit(r), "source": F.col("source"), "sort": F.col("kind"), "a": F.col("a"), "b": F.col("b"), "c": F.col("c")}
        out = out.union(answers.where("goal >= 0").select(*[given[n].alias(n) if n in given else empty[n] for n in empty]))
    return out.repartition("batch").sortWithinPartitions("batch", "kind")


def told_batches(rows: Iterator[pa.RecordBatch], fold: Callable[[Batch, list, Message], None] | None = None) -> Iterator[tuple[Batch, dict[int, dict[int, list[Message]]]]]:
    """(batch, round -> kind -> messages). fold: takes messages of kind STRETCH as they come into what is kept in their list's place."""
    own, told = None, defaultdict(lambda: defaultdict(list))
    for one in slices(rows, 1):
        get = lambda name: one.column(one.schema.get_field_index(name))[0].as_py()  # noqa: B023, E731
        if get("kind") == 0:
            if own is not None:
                yield own, told
                told.clear()
                own = None
            own, told = Batch(one), defaultdict(lambda: defaultdict(list))
        else:
            message = (get("batch"), get("source"), get("sort"), get("a"), get("b"), get("c"))
            kept = told[get("round")][message[2]]
            if fold is not None and message[2] == STRETCH:
                fold(own, kept, message)
            else:
                kept.append(message)
    if own is not None:
        yield own, told


def context_messages(own: Batch, live: np.ndarray, length: int, shards: int) -> Iterator[Message]:
    asked = own.asking(length, live)
    counts = np.bincount(asked.places, minlength=len(asked.keys))
    for shard, which in asked.send(shards):
        yield shard, own.number, HELD if own.held else TRAIN, squeezed_keys(asked.keys[which]), None if own.held else squeezed(counts[which]), None


def count_messages(own: Batch, shards: int) -> Iterator[Message]:
    """Words with their counts, none if the batch is held out, and beginnings of training documents."""
    kinds = [(WORDS, own.words, np.bincount(own.places, minlength=len(own.words)) * (not own.held))]
    if not own.held:
        kinds.append((HEADS, own.heads()[1], None))
    for kind, keys, counts in kinds:
        asked = _asked(keys)
        n = np.bincount(asked.places, counts, minlength=len(asked.keys)).astype(np.int64)
        for shard, which in asked.send(shards):
            yield shard, own.number, kind, squeezed_keys(asked.keys[which]), squeezed(n[which]), None


def _asked(keys: np.ndarray) -> Asked:
    return Asked(np.arange(len(keys)), *grouped(keys)[:2])


def sent_in_parts(rows: Iterator[Message]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += sum(len(x) for x in row[3:] if x)
        if n >= 4 << 20:
            yield messages(held)
            held, n = [], 0
    if held:
        yield messages(held)


def first_round(batches: DataFrame, shards: int) -> DataFrame:
    def ask(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in slices(rows, 1):
            own = Batch(one)
            yield from sent_in_parts(count_messages(own, shards))
            yield from sent_in_parts(context_messages(own, np.ones(len(own.tokens), bool), 2, shards))

    return answered(batches.mapInArrow(ask, _MESSAGES), shards, False)


def answered(asked: DataFrame, shards: int, last: bool) -> DataFrame:
    def answer(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, told in by_goal(rows):
            yield from sent_in_parts(answers_of(shard, told, last))
            told.clear()

    return asked.repartition(shards, "goal").sortWithinPartitions("goal").mapInArrow(answer, _MESSAGES)


def later_round(batches: DataFrame, told: DataFrame, shards: int, length: int, last: bool) -> DataFrame:
    """Contexts of ``length`` tokens; told: the answers of the round before."""

    def ask(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, answers in told_batches(rows):
            known = Known(own, shards, answers[0][STATE])
            known.learn(length - 1, answers[0])
            yield from sent_in_parts(context_messages(own, known.live, length, shards))
            if own.held or not last:
                yield messages([known.state()])

    return answered(with_answers(batches, [told]).mapInArrow(ask, _MESSAGES), shards, last)


# whole contexts

def stretch_message(own: Batch, shard: int, first: np.ndarray, end: np.ndarray, short: int) -> Message:
    """The tokens of the distinct stretches, each from short - 1 tokens before its first position on, and which positions have them: number, sizes, copies, first positions."""
    begin, n = first - short + 1, end - first
    place = grouped(stretch_keys(own.sums(), begin, end))[1]
    by = np.argsort(place, kind="stable")
    copies = np.bincount(place)
    one = by[np.cumsum(copies) - copies]
    tokens = own.tokens[ranges(begin[one], end[one])].tobytes()
    return shard, own.number, STRETCH, len(tokens).to_bytes(8, "little") + _CODEC.compress(tokens, asbytes=True), squeezed(np.concatenate([[len(one)], n[one], copies, first[by]])), None


def stretch_keys(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of stretches of a text, from its rolling hashes."""
    width = end - begin
    return mixed(sums[end] - sums[begin] * powers(int(width.max()), BASE)[width], width.astype(np.uint64))


def searched_parts(text: np.ndarray, begin: np.ndarray, width: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(tokens, place of each in its stretch, from 1) of stretches one after another, about ``most`` tokens at a time."""
    cuts = np.flatnonzero(np.diff(np.cumsum(width) // most)) + 1
    for first, size in zip(np.split(begin, cuts), np.split(width, cuts), strict=True):
        if len(first):
            yield text[ranges(first, first + size)], np.arange(1, int(size.sum()) + 1) - np.repeat(np.cumsum(size) - size, size)


def stretch_tokens(packed_: bytes) -> np.ndarray:
    return np.frombuffer(_CODEC.decompress(packed_[8:], decompressed_size=int.from_bytes(packed_[:8], "little"), asbytes=True), "<u8")


def stretch_parts(packed_: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sizes, copies, first positions) of a message's stretches."""
    flat = unsqueezed(packed_)
    d = int(flat[0])
    return flat[1 : d + 1], flat[d + 1 : 2 * d + 1], flat[2 * d + 1 :]


def suffix_answers(batches: DataFrame, told: DataFrame, shards: int, short: int) -> DataFrame:
    """For each batch: counts of its training documents' whole contexts (TIES), or its state and each asked shard's longest matches of its stretches (STRETCH: stretches, lengths, counts)."""

    def send(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in slices(rows, 1):
            get = lambda name: one.column(one.schema.get_field_index(name))[0].as_py()  # noqa: B023, E731
            yield messages([(get("batch") >> 32, get("batch"), TIES, get("places"), squeezed(np.array(get("sizes"), np.int64)), get("words"))])

    def ask(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, answers in told_batches(rows):
            known = Known(own, shards, answers[0][STATE])
            asked = known.learn(short, answers[0])
            yield messages([known.state()])
            yield from sent_in_parts(stretch_message(own, shard, first, end, short) for shard, first, end in known.stretches(asked, answers[0]))

    def search(built: Shard, rows: list[tuple[int, np.ndarray, bytes]]) -> Iterator[Message]:
        """Answers for the messages' stretches; equal ones, of any batches, are searched for once."""
        sizes = [stretch_parts(p)[0] for _, _, p in rows]
        n = np.concatenate(sizes)
        ends = np.cumsum(n + short - 1)
        text = np.concatenate([t for _, t, _ in rows])
        _, place, some = grouped(stretch_keys(rolled(text), ends - n - short + 1, ends))
        width = n[some] + short - 1
        found = [built.longest(*part) for part in searched_parts(text, ends[some] - width, width)]
        lengths, counts = (np.concatenate([np.zeros(0, np.int64), *[f[k] for f in found]]) for k in range(2))
        begin = np.cumsum(width) - width + short - 1
        at = ranges(begin[place], begin[place] + n)
        cuts = np.cumsum([int(x.sum()) for x in sizes])[:-1]
        for (number, _, parts), a, b in zip(rows, np.split(lengths[at], cuts), np.split(counts[at], cuts), strict=True):
            yield number, 0, STRETCH, parts, squeezed(a), squeezed(b)

    def answer(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, built = None, None
        documents: list[tuple[int, list[np.ndarray]]] = []
        asked: list[tuple[int, np.ndarray, bytes]] = []
        size = 0

        def finish() -> Iterator[pa.RecordBatch]:
            """Searches for what is asked; builds the shard before, once its documents are all there."""
            nonlocal built, size
            if documents:
                built = Shard([d for _, docs in documents for d in docs])
                ties, at = built.whole_counts(), 0
                for number, docs in documents:
                    n = sum(len(d) + 2 for d in docs)
                    yield messages([(number, 0, TIES, squeezed(ties[at : at + n]), None, None)])
                    at += n
                documents.clear()
            if asked:
                yield from sent_in_parts(search(built, asked))
                asked.clear()
                size = 0

        for one in slices(rows, 1):
            goal, number, kind, a, b, c = (x[0].as_py() for x in one.columns)
            if kind == STATE:
                yield messages([(number, 0, STATE, a, b, c)])
                continue
            if goal != shard:
                yield from finish()
                shard, built = goal, None
            if kind == TIES:
                documents.append((number, np.split(np.frombuffer(c, "<u8")[unsqueezed(a)], np.cumsum(unsqueezed(b))[:-1])))
                continue
            asked.append((number, stretch_tokens(a), b))
            size += len(asked[-1][1])
            if size >= ASKED:
                yield from finish()
        yield from finish()

    training = batches.where("not held").mapInArrow(send, _MESSAGES)
    stretches = with_answers(batches.where("held"), [told.join(batches.where("held").select(F.col("batch").alias("goal")), "goal", "left_semi")]).mapInArrow(ask, _MESSAGES)
    dealt = training.union(stretches).repartition(shards, "goal").sortWithinPartitions("goal", "kind")
    return dealt.mapInArrow(answer, _MESSAGES)


def smoothing(length: np.ndarray) -> np.ndarray:
    return 0.05 + 1000.0 / np.maximum(length, 1).astype(np.float64) ** 3


def document_scores(sizes: np.ndarray, base: np.ndarray, lengths: np.ndarray, counts: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """(base score, score) of each document. base: log10 of the base probability of all words and ends in order; lengths, counts: at len + 2 positions of each document; total: training tokens, the count of the empty context."""
    tokens = sizes + 1
    ends = np.cumsum(tokens)
    before = np.arange(int(tokens.sum())) + np.repeat(np.arange(len(sizes)), tokens)  # the position before each token
    m = lengths[before]
    c = np.where(m > 0, counts[before], total)
    goes_on = np.where(lengths[before + 1] == m + 1, counts[before + 1], 0)
    mu = smoothing(m)
    each = np.log10((goes_on + mu * 10.0**base) / (c + mu))
    starts = ends - tokens
    return np.add.reduceat(base, starts), np.add.reduceat(each, starts)


def word_totals(own: Batch, told: dict[int, list[Message]], shards: int, documents: int) -> np.ndarray:
    """The training count of each token; START and END have the number of training documents."""
    each = np.full(len(own.tokens), documents, np.int64)
    each[own.inner] = _asked(own.words).told(shards, {m[1]: unsqueezed(m[3]) for m in told[WORDS]})[own.places]
    return each


def longest(own: Batch, kept: list[np.ndarray], m: Message) -> None:
    """Takes a shard's longest matches of a batch's stretches into the batch's: the longest, and the sum of the counts of those as long, by position."""
    if not kept:
        kept += [np.zeros(len(own.tokens), np.int64), np.zeros(len(own.tokens), np.int64)]
    best, sums = kept
    n, copies, first = stretch_parts(m[3])
    n, begin = np.repeat(n, copies), np.repeat(np.cumsum(n) - n, copies)
    at, answer = ranges(first, first + n), ranges(begin, begin + n)
    found, times = unsqueezed(m[4])[answer], unsqueezed(m[5])[answer]
    sums[at] = np.where(found > best[at], times, np.where(found == best[at], sums[at] + times, sums[at]))
    best[at] = np.maximum(best[at], found)


def held_positions(known: Known, told: dict[int, list], each: np.ndarray, short: int) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, counts) at all positions of a held-out batch; its stretches' answers are folded."""
    lengths, counts = known.lengths, known.counts
    one = lengths == 1
    counts[one] = each[one]
    lengths[one & (each == 0)] = 0
    best, sums = told[STRETCH] or [lengths, counts]
    far = best >= short
    lengths[far], counts[far] = best[far], sums[far]
    return lengths, counts


def training_positions(own: Batch, heads: list[Message], ties: list[Message], each: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, counts) at all positions of a training batch: all that precedes, and how many training documents begin so."""
    counts = np.concatenate([unsqueezed(m[3]) for m in ties])
    at, keys = own.heads()
    counts[at] = _asked(keys).told(shards, {m[1]: unsqueezed(m[3]) for m in heads})
    counts[own.starts] = each[own.starts]
    return own.room, counts


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS, fold: int = FOLD, shard_bytes: int = SHARD_BYTES, batch_words: int = BATCH, alike_bytes: int = ALIKE_BYTES, short: int | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row. short (3 at least): tokens of the longest context that rounds count; None: 6, and one more for each factor of 4 over two hundred million tokens, so that what occurs by chance in many shards is counted in rounds."""
    ship(docs.sparkSession)
    dealt, shards = deal(docs, id_col, text_col, shard_bytes, alike_bytes)
    batches = staged(packed(dealt, folds, fold, batch_words), "ngram-batches", max_records=32)
    told = [staged(first_round(batches, shards), "ngram-round", codec="none")]
    documents = int(batches.where("not held").agg(F.coalesce(F.sum(F.size("sizes")), F.lit(0))).first()[0])
    parts = [unsqueezed(bytes(r["a"])) for r in told[0].where(F.col("kind") == TOTALS).select("a").toLocalIterator()]  # one for each shard
    total = sum(int(p[0]) << 31 | int(p[1]) for p in parts) + documents
    kinds = sum(int(p[2]) for p in parts) + int(documents > 0)
    if short is None:
        short = 6 + max(0, math.ceil(math.log(max(total, 1) / 2e8, 4)))
    for length in range(3, short + 1):
        told.append(staged(later_round(batches, told[-1], shards, length, length == short), "ngram-round", codec="none"))
        if len(told) > 2:
            drop(told.pop(1))
    last = staged(suffix_answers(batches, told[-1], shards, short), "ngram-suffixes", codec="none")
    drop(told[-1])

    def combine(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, answers in told_batches(rows, longest):
            each = word_totals(own, answers[0], shards, documents)
            if own.held:
                lengths, counts = held_positions(Known(own, shards, answers[1][STATE]), answers[1], each, short)
            else:
                lengths, counts = training_positions(own, answers[0][HEADS], answers[1][TIES], each, shards)
            scored = np.ones(len(own.tokens), bool)
            scored[own.starts] = False
            c = each[scored]
            sizes = own.sizes - 2
            low, high = document_scores(sizes, np.log10((c + 1) / (total + kinds + 1)), lengths, counts, total)
            n_known = np.add.reduceat((c > 0).astype(np.int64), np.cumsum(sizes + 1) - sizes - 1)
            yield pa.RecordBatch.from_arrays([own.doc_ids.values, pa.array(np.full(len(sizes), own.held)), pa.array(sizes + 1), pa.array(n_known), pa.array(np.full(len(sizes), total)), pa.array(low), pa.array(high)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    counted = told[0].where(F.col("kind").isin(WORDS, HEADS))
    return with_answers(batches, [counted, last]).mapInArrow(combine, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
