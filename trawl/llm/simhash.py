"""SimHash fingerprints of word shingles, and groups of documents whose fingerprints lie within a radius.

Fingerprints: XXH64 (seed 42) of each shingle of A-Z-lower-cased words, repeats included; a bit is 1 if it is set
in over half the hashes. A text without words has fingerprint zero and is linked like any other; a null text
counts as empty.

Links: the bits are cut into ``radius + spare`` parts. Two fingerprints within the radius agree in ``spare`` parts at least,
so rows dealt by each choice of ``spare`` agreeing parts (42 key bits and more for radius 2 and 4 spare parts) meet every
partner, and no choice of parts is dropped. Only distinct fingerprints are dealt: copies cost nothing here.

Comparison inside the buckets is bit-sliced: bit planes of the sorted rows are stored vertically, 64 rows to a word,
and row i is compared to row i + d for all rows of all buckets at once by shifting planes by d. Carry-save counters of
the differing bits saturate beyond the radius; word blocks in which all lanes exceed it, or have no partner
in the same bucket at that distance, are abandoned. A bucket gives a spanning forest of its
links, at most one row for each member, so groups of any size cost rows in proportion.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.cluster import drop, ship, slices, staged
from trawl.llm.components import components

_ONE = np.uint64(1)
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: str | None, width: int, seed: int) -> list[int]:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    hash64 = xxhash.xxh64_intdigest
    if len(words) < width:
        return [hash64(b" ".join(words), seed)]
    joined = [b" ".join(s) for s in zip(*(words[k:] for k in range(width)), strict=False)]
    return [hash64(s, seed) for s in joined]


def remixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hashes for a text's fingerprint number k: number 0 has them as they are, others an invertible mix of them."""
    if not k:
        return hashes
    x = hashes + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints_of(hashes: np.ndarray, many: int = 1) -> np.ndarray:
    """[k]: unsigned 64-bit fingerprints of one text's shingle hashes; bits are counted in slices, so a long text needs no more memory."""
    out = np.zeros(many, np.uint64)
    for k in range(many if len(hashes) else 0):
        counts = np.zeros(64, np.int64)
        for at in range(0, len(hashes), 1 << 16):
            part = remixed(hashes[at : at + (1 << 16)], k).view(np.uint8).reshape(-1, 8)
            counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0]
    return out


def fingerprints(texts: list[str | None], width: int, seed: int, many: int = 1) -> np.ndarray:
    """[text, k]: unsigned 64-bit fingerprints."""
    out = np.zeros((len(texts), many), np.uint64)
    for i, text in enumerate(texts):
        out[i] = fingerprints_of(np.array(shingle_hashes(text, width, seed), "<u8"), many)
    return out


def fingerprint_documents(docs: DataFrame, id_col: str, text_col: str, width: int = 3, seed: int = 42, many: int = 1) -> DataFrame:
    """(_id, _fps, _node): the fingerprints as signed longs, and a number that texts share if they share all of them: with one fingerprint, that itself."""
    ship(docs.sparkSession)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = fingerprints(batch.column(1).to_pylist(), width, seed, many).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, own.size + 1, many), pa.int32()), pa.array(own.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["_id", "_fps"])

    made = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_text")).mapInArrow(compute, "_id bigint, _fps array<bigint>")
    return made.withColumn("_node", F.col("_fps")[0] if many == 1 else F.xxhash64("_fps"))


def part_masks(radius: int, spare: int = 4) -> list[int]:
    """Masks of the bits on which partners within the radius must agree, one of which holds for each pair."""
    parts = radius + spare
    cuts = [64 * k // parts for k in range(parts + 1)]
    whole = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(whole[k] for k in range(parts) if k not in left) for left in combinations(range(parts), radius)]


def bit_planes(values: np.ndarray) -> np.ndarray:
    """planes[j][w]: bit j of the rows 64 w to 64 w + 63; one word of padding."""
    n_words = -(-len(values) // 64) + 1
    bits = np.zeros((n_words * 64, 64), np.uint8)
    bits[: len(values)] = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(bits.T.reshape(64, n_words, 64), axis=2, bitorder="little").view("<u8").reshape(64, n_words)


def _shifted(plane: np.ndarray, words: np.ndarray, d: int) -> np.ndarray:
    """The plane's bits moved down by d rows, at the given words."""
    q, r = divmod(d, 64)
    last = len(plane) - 1
    low = plane[np.minimum(words + q, last)]
    if not r:
        return low
    return (low >> np.uint64(r)) | (plane[np.minimum(words + q + 1, last)] << np.uint64(64 - r))


def links_in_buckets(buckets: np.ndarray, values: np.ndarray, radius: int, joined: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, i + d) within the radius, d ascending. Rows of a bucket stand together; buckets: a number for each row.

    joined: a number for each row; rows of equal numbers aren't compared. The caller may change it between pairs.
    """
    n = len(values)
    ends = np.append(np.flatnonzero(np.diff(buckets)) + 1, n)
    left = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(n) - 1  # rows of the bucket that follow
    planes = bit_planes(values)
    levels = (radius + 1).bit_length()
    for d in range(1, int(left.max(initial=0)) + 1):
        rows = np.flatnonzero(left >= d)
        if joined is not None:
            rows = rows[joined[rows] != joined[rows + d]]
        words = np.unique(rows >> 6)
        lanes = np.zeros(planes.shape[1], np.uint64)
        np.bitwise_or.at(lanes, rows >> 6, _ONE << (rows & 63).astype(np.uint64))
        over = ~lanes[words]  # lanes without a partner count as beyond the radius
        counter = [np.zeros(len(words), np.uint64) for _ in range(levels)]
        for j in range(64):
            carry = planes[j][words] ^ _shifted(planes[j], words, d)
            for k in range(levels):
                counter[k], carry = counter[k] ^ carry, counter[k] & carry
            over |= carry
            if j % 8 == 7:
                above = np.zeros(len(words), np.uint64)  # the counter, compared to the radius from its highest bit down
                equal = np.full(len(words), _ALL)
                for k in reversed(range(levels)):
                    if radius >> k & 1:
                        equal &= counter[k]
                    else:
                        above |= equal & counter[k]
                        equal &= ~counter[k]
                over |= above
                live = over != _ALL
                if not live.all():
                    words, over, counter = words[live], over[live], [c[live] for c in counter]
                if not len(words):
                    break
        if len(words):
            hits = np.unpackbits((~over).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            word, bit = np.nonzero(hits)
            i = words[word] * 64 + bit
            yield i, i + d


def spanning_links(buckets: np.ndarray, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of links that join what all links join: fewer than there are rows."""
    parent = list(range(len(values)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    a, b = [], []
    for i, j in links_in_buckets(buckets, values, radius):
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            p, q = root(x), root(y)
            if p != q:
                parent[max(p, q)] = min(p, q)
                a.append(x)
                b.append(y)
    return np.array(a, np.int64), np.array(b, np.int64)


def linked_fingerprints(distinct: DataFrame, radius: int, spare: int = 4, rows_at_once: int = 1 << 17) -> DataFrame:
    """distinct: (_node, _fps). Returns links (u, v) of nodes that span the components of all pairs of which some fingerprint, of equal number, lies within the radius."""
    ship(distinct.sparkSession)
    masks = part_masks(radius, spare)
    keys = F.transform(F.array(*[F.lit(m - (1 << 64) if m >> 63 else m) for m in masks]), lambda m, t: F.struct(t.alias("t"), m.alias("m")))
    each = distinct.select("_node", F.posexplode("_fps").alias("k", "fp")).select("_node", "k", "fp", F.explode(keys).alias("x"))
    keyed = each.select((F.col("k") * len(masks) + F.col("x.t")).cast("int").alias("t"), F.col("fp").bitwiseAND(F.col("x.m")).alias("key"), "fp", F.col("_node").alias("node"))
    dealt = keyed.repartition("t", "key").sortWithinPartitions("t", "key", "fp", "node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        n = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, n
            if not held:
                return
            t, key, fp, node = (np.concatenate(x) for x in zip(*held, strict=True))
            change = np.flatnonzero((np.diff(t) != 0) | (np.diff(key) != 0)) + 1
            upto = len(t) if last else int(change[-1]) if len(change) else 0  # the last bucket may go on
            buckets = np.zeros(len(t), np.int64)
            buckets[change] = 1
            held, n = ([(t[upto:], key[upto:], fp[upto:], node[upto:])], len(t) - upto) if upto < len(t) else ([], 0)
            if upto:
                numbers = np.cumsum(buckets)[:upto]
                size = np.bincount(numbers)[numbers]
                many = size > 1
                if many.any():
                    u, v = spanning_links(numbers[many], fp[:upto][many].view(np.uint64), radius)
                    named = node[:upto][many]
                    yield pa.RecordBatch.from_arrays([pa.array(named[u]), pa.array(named[v])], ["u", "v"])

        for batch in batches:
            held.append(tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)))
            n += batch.num_rows
            if n >= max(rows_at_once, 2 * len(held[0][0])):
                yield from flush(False)
        yield from flush(True)

    return dealt.mapInArrow(compare, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, width: int = 3, seed: int = 42, many: int = 1, spare: int = 4) -> DataFrame:
    """Returns (doc_id, fingerprint, component_id) for every row; component_id: the least id reachable over links.

    many: independent fingerprints of each text, any of which links; the first is the one returned. Null ids keep their
    rows; a component of rows with null ids only has a null component_id. Rows with equal ids are separate rows. Extra
    columns are ignored.
    """
    prints = staged(fingerprint_documents(docs, id_col, text_col, width, seed, many), "simhash")
    first = staged(prints.groupBy("_node").agg(F.min("_id").alias("_first"), F.first("_fps").alias("_fps")), "nodes")
    roots = components(linked_fingerprints(first.select("_node", "_fps"), radius, spare))
    rooted = first.join(roots, first["_node"] == roots["node"], "left").select("_node", "_first", F.coalesce("root", "_node").alias("_root"))
    least = rooted.groupBy("_root").agg(F.min("_first").alias("component_id"))
    classes = rooted.join(least, "_root").select("_node", "component_id")
    return prints.join(classes, "_node").select(F.col("_id").alias("doc_id"), F.lower(F.lpad(F.hex(F.col("_fps")[0]), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(text: str | None, width: int, seed: int) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending."""
    return np.unique(np.array(shingle_hashes(text, width, seed), "<u8"))


def set_prints(rows: DataFrame, width: int, seed: int, many: int) -> DataFrame:
    """rows: (_row, _id, _text). Returns (_row, _id, _fps, _node): fingerprints of the set of shingles, and a number that texts with equal sets share."""
    ship(rows.sparkSession)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_set(t, width, seed) for t in batch.column(2).to_pylist()]
            own = np.array([fingerprints_of(s, many) for s in sets], np.uint64).reshape(-1).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, own.size + 1, many), pa.int32()), pa.array(own))
            nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), seed) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists, pa.array(nodes)], ["_row", "_id", "_fps", "_node"])

    return rows.mapInArrow(compute, "_row bigint, _id bigint, _fps array<bigint>, _node bigint")


def near_pairs(nodes: DataFrame, radius: int, spare: int, parts: int, rows_at_once: int = 1 << 17) -> DataFrame:
    """nodes: (_node, _fps). Returns pairs (u, v), u < v, without repeats: of equal fingerprint numbers one agrees in
    ``spare`` of ``parts`` parts and lies within the radius, and together with the next one within twice the radius. Of each
    bucket, pairs that join what all its pairs join."""
    ship(nodes.sparkSession)
    masks = np.array(part_masks(parts - spare, spare), np.uint64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n = batch.num_rows
            fps = batch.column(1).flatten().to_numpy().view(np.uint64).reshape(n, -1)
            many = fps.shape[1]
            keys = (fps[:, :, None] & masks).view(np.int64)
            each = many * len(masks)
            t = np.tile(np.arange(each, dtype=np.int32), n)
            own = np.repeat(fps.view(np.int64).reshape(-1), len(masks))
            following = np.repeat(np.roll(fps, -1, axis=1).view(np.int64).reshape(-1), len(masks))
            node = np.repeat(batch.column(0).to_numpy(), each)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (t, keys.reshape(-1), own, following, node)], ["t", "key", "fp", "more", "node"])

    def pairs_of(buckets: np.ndarray, fp: np.ndarray, more: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        label = np.arange(len(fp))
        for i, j in links_in_buckets(buckets, fp, radius, label):
            close = np.bitwise_count(fp[i] ^ fp[j]).astype(np.int64) + np.bitwise_count(more[i] ^ more[j]) <= 2 * radius
            i, j = i[close], j[close]
            used = []
            for n, (x, y) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
                while label[x] != x:
                    x = label[x]
                while label[y] != y:
                    y = label[y]
                if x != y:
                    label[max(x, y)] = min(x, y)
                    used.append(n)
            while not np.array_equal(up := label[label], label):
                label[:] = up
            if used:
                yield i[used], j[used]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        n = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, n
            if not held:
                return
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            t, key = columns[:2]
            new = (np.diff(t) != 0) | (np.diff(key) != 0)
            change = np.flatnonzero(new) + 1
            upto = len(t) if last else int(change[-1]) if len(change) else 0  # the last bucket may go on
            held, n = ([tuple(c[upto:] for c in columns)], len(t) - upto) if upto < len(t) else ([], 0)
            if not upto:
                return
            numbers = np.concatenate([[0], np.cumsum(new)])[:upto]
            shared = np.bincount(numbers)[numbers] > 1
            if not shared.any():
                return
            fp, more, node = (c[:upto][shared] for c in columns[2:])
            for i, j in pairs_of(numbers[shared], fp.view(np.uint64), more.view(np.uint64)):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j]))], ["u", "v"])

        for batch in batches:
            held.append(tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)))
            n += batch.num_rows
            if n >= max(rows_at_once, 2 * len(held[0][0])):
                yield from flush(False)
        yield from flush(True)

    dealt = nodes.select("_node", "_fps").mapInArrow(deal, "t int, key bigint, fp bigint, more bigint, node bigint")
    met = dealt.repartition("t", "key").sortWithinPartitions("t", "key", "node").mapInArrow(compare, "u bigint, v bigint")
    return met.where("u < v").distinct()


def similar_in_block(sets: list[np.ndarray], left: int, similarity: float) -> list[tuple[int, int]]:
    """Pairs of places of similar sets, of the first ``left`` and the others (of all, if ``left`` is their number), that join what all
    such pairs join. Exact: one set's members are marked, and the marks of all others' members summed."""
    sizes = np.array([len(x) for x in sets], np.int64)
    real = np.flatnonzero(sizes > 0)  # an empty set has nothing in common with another
    if len(real) < 2:
        return []
    members = np.unique(np.concatenate([sets[k] for k in real]), return_inverse=True)[1]
    ends = np.cumsum(sizes[real])
    starts = ends - sizes[real]
    mark = np.zeros(int(members.max()) + 1, np.int32)
    label = np.arange(len(real))
    out = []
    for i in range(len(real)):
        if left < len(sets) and real[i] >= left:
            break
        first = i + 1 if left == len(sets) else int(np.searchsorted(real, left))
        if first >= len(real):
            break
        mark[members[starts[i] : ends[i]]] = 1
        both = np.add.reduceat(mark[members[starts[first] :]], starts[first:] - starts[first])
        mark[members[starts[i] : ends[i]]] = 0
        for j in (first + np.flatnonzero(both >= similarity * (sizes[real[i]] + sizes[real[first:]] - both))).tolist():
            if label[i] != label[j]:
                label[label == label[j]] = label[i]
                out.append((int(real[i]), int(real[j])))
    return out


def similar_links(rows: DataFrame, nodes: DataFrame, radius: int, width: int, seed: int, spare: int, parts: int, similarity: float, block: int = 512) -> DataFrame:
    """Links (u, v) that join the nodes which all similar pairs within components of near pairs join. rows: (_row, _id, _text); nodes: (_node, _fps, _first), a row that has the node's set.

    A component is cut by hash into blocks of about ``block`` nodes, and each two of its blocks, or one and itself, meet in a task
    of their own, where all pairs are compared exactly. Most components are one block: each set moves once.
    """
    pairs = staged(near_pairs(nodes, radius, spare, parts), "pairs")
    near = staged(components(pairs).select(F.col("node").alias("_node"), F.col("root").alias("_near")), "near")
    sizes = near.groupBy("_near").agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks"))
    placed = near.join(sizes, "_near").select("_node", "_near", "_blocks", F.pmod(F.xxhash64("_node"), F.col("_blocks")).cast("int").alias("_block"))
    firsts = nodes.select("_node", "_first").join(placed, "_node")  # grows with the documents: never broadcast, at any size
    texts = rows.join(firsts.hint("merge"), rows["_row"] == firsts["_first"]).select("_node", "_near", "_blocks", "_block", "_text")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = pa.array([shingle_set(t, width, seed).tobytes() for t in batch.column(4).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], sets], ["node", "near", "blocks", "block", "hashes"])

    of = staged(texts.mapInArrow(make, "node bigint, near bigint, blocks int, block int, hashes binary"), "sets", codec="none")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    met = of.select("*", other.alias("other")).select("near", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "hashes")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: tuple[int, int, int] | None = None
        held: list[tuple[int, int, np.ndarray]] = []

        def links() -> Iterator[pa.RecordBatch]:
            left = len(held) if group[1] == group[2] else sum(b == group[1] for b, _, _ in held)
            found = similar_in_block([h for _, _, h in held], left, similarity)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([held[k][1] for k in side], pa.int64()) for side in zip(*found, strict=True)], ["u", "v"])

        for batch in slices(batches):
            for near, low, high, block_, node, hashes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (near, low, high) != group:
                    if held:
                        yield from links()
                    group, held = (near, low, high), []
                held.append((block_, node, np.frombuffer(hashes, "<u8")))
        if held:
            yield from links()

    by = ("near", "low", "high")
    found = staged(met.repartition(*by).sortWithinPartitions(*by, "block", "node").mapInArrow(compare, "u bigint, v bigint"), "links")
    for done in (pairs, near, of):
        drop(done)
    return found


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 16, width: int = 5, seed: int = 42, many: int = 6, spare: int = 2, parts: int = 8, similarity: float = 0.8, block: int = 512) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the row with the least id.

    A link needs an exact Jaccard similarity of the shingle sets (by XXH64 of the shingles). Fingerprints of the sets only find what
    to compare: sets that agree in ``spare`` of ``parts`` parts of one fingerprint and lie within the radius are near, and all pairs
    within a component of near sets are compared. At a similarity of 0.8 a bit differs with probability 0.15, so that
    99.9 % of such pairs meet by the defaults, more of closer ones. Rows are told apart by a number, so rows with equal ids are
    separate. Of rows of a component that share its least id the one with the least text stays. Rows with a null id stay.
    Column names may be any.
    """
    number = f"_row_{uuid.uuid4().hex}"
    numbered = staged(docs.withColumn(number, F.monotonically_increasing_id()), "rows")
    rows = numbered.select(F.col(number).alias("_row"), F.col(f"`{id_col}`").cast("bigint").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    prints = staged(set_prints(rows, width, seed, many), "simhash")
    nodes = staged(prints.groupBy("_node").agg(F.min("_row").alias("_first"), F.first("_fps").alias("_fps")), "nodes")
    links = similar_links(rows, nodes, radius, width, seed, spare, parts, similarity, block)
    roots = components(links)
    of_node = prints.where("_id is not null").groupBy("_node").agg(F.min("_id").alias("_first_id"), F.count("*").alias("_n"))  # a row for each set: copies are counted before they meet
    placed = staged(of_node.join(roots, F.col("_node") == F.col("node"), "left").select("_node", "_first_id", "_n", F.coalesce("root", "_node").alias("_root")), "placed")
    least = placed.groupBy("_root").agg(F.min("_first_id").alias("_least"), F.sum("_n").alias("_rows")).where("_rows > 1")
    classes = placed.join(least, "_root").select("_node", "_root", "_least")
    among = staged(prints.where("_id is not null").join(classes, "_node").select("_row", "_root", (F.col("_id") == F.col("_least")).alias("_is_least")), "shared")
    firsts = staged(among.where("_is_least").groupBy("_root").agg(F.min("_row").alias("_kept"), F.count("*").alias("_n")), "firsts")
    tied = staged(among.where("_is_least").join(firsts.where("_n > 1"), "_root", "left_semi"), "tied")
    kept = firsts.where("_n = 1").select("_kept")
    if tied.head(1):  # else no text is asked for, and none is shuffled
        by_text = tied.join(rows, "_row").groupBy("_root").agg(F.min(F.struct("_text", "_row")).alias("_x")).select(F.col("_x._row").alias("_kept"))
        kept = kept.union(by_text)
    gone = staged(among.join(kept, among["_row"] == kept["_kept"], "left_anti").select(F.col("_row").alias("_gone")), "gone")
    for done in (prints, nodes, links, placed, among, firsts, tied):
        drop(done)
    return numbered.join(gone.hint("merge"), numbered[number] == gone["_gone"], "left_anti").drop(number)  # the rows to remove grow with the documents: never broadcast
