"""Search through a trigram index: candidates from postings, then always the true predicate, on the texts as they were sealed.

The index is used if a match must contain a literal of three characters or more, and the rarest required trigram is in
few enough of enough documents; otherwise the sealed texts are scanned. Both read the same rows, so the choice changes cost, never
results. Few candidates are read by key, from the pages that hold them; of more, a bitmap of their keys' hashes says whose texts the
predicate is applied to where they lie, so that no text is shuffled.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.functions.trigram import char_code, code_of, occurrences
from trawl.operators.predicates import need, predicate
from trawl.plans.pattern import Need
from trawl.sources.index import TextIndex
from trawl.sources.members import near

#: ASCII letters to which some non-ASCII character folds (Kelvin sign, long s, dotted and dotless i).
FOLDED_TO = frozenset("ksi")


@dataclass(frozen=True)
class Gate:
    """When to probe: at most this share of documents for the rarest trigram, and this many documents at least; most: trigrams
    that a probe looks up; fetch: candidates that are read by key, whose keys the driver holds, at most."""

    share: float = 0.05
    docs: int = 10_000
    most: int = 4
    fetch: int = 10_000


ALWAYS = Gate(1.0, 0)
#: Ranges of keys that are pushed to a scan.
_RANGES = 64

Lists = list[set[int]] | None


def literal_codes(literal: str, fold: bool) -> set[int]:
    """Codes that every text containing the literal has; with folding, only of trigrams whose characters fold among themselves."""
    out = set()
    for k in range(len(literal) - 2):
        t = literal[k : k + 3]
        if fold and (not t.isascii() or FOLDED_TO & set(t.lower())) or 0 in map(char_code, t):
            continue
        out.add(code_of(t))
    return out


def all_of(parts: list[Lists]) -> Lists:
    """Of a conjunction: single lists together, and the shortest of the others."""
    known = [p for p in parts if p is not None]
    if not known:
        return None
    joint = set().union(*(p[0] for p in known if len(p) == 1))
    split = [p for p in known if len(p) != 1]
    return [s | joint for s in min(split, key=len)] if split else [joint]


def any_of(parts: list[Lists]) -> Lists:
    return None if None in parts else [s for p in parts for s in p]


def alternatives(tree: Need, fold: bool) -> Lists:
    """Sets of codes, one of which every match has in full; None if there is nothing to look up."""
    if tree is None:
        return None
    if tree[0] == "lit":
        codes = literal_codes(tree[1], fold)
        return [codes] if codes else None
    return (any_of if tree[0] == "or" else all_of)([alternatives(p, fold) for p in tree[1]])


class Condition:
    """A predicate on the text: a pattern, or others joined by ``&``, ``|``, ``~``, as SQL joins them: null texts satisfy none."""

    def __init__(self, kind: str, parts: tuple):
        self.kind, self.parts = kind, parts

    def __and__(self, other: Condition) -> Condition:
        return Condition("and", (self, other))

    def __or__(self, other: Condition) -> Condition:
        return Condition("or", (self, other))

    def __invert__(self) -> Condition:
        return Condition("not", (self,))

    def column(self, text: Column) -> Column:
        if self.kind == "match":
            return predicate(text, *self.parts)
        own = [p.column(text) for p in self.parts]
        return ~own[0] if self.kind == "not" else own[0] & own[1] if self.kind == "and" else own[0] | own[1]

    def lists(self) -> Lists:
        if self.kind == "match":
            return alternatives(*need(*self.parts))
        if self.kind == "not":
            return None
        return (all_of if self.kind == "and" else any_of)([p.lists() for p in self.parts])


def matches(pattern: str, mode: str = "like") -> Condition:
    return Condition("match", (pattern, mode))


def chosen(index: TextIndex, what: Condition, gate: Gate, state: dict) -> tuple[list[list[int]], int] | None:
    """(the codes to probe for each alternative, rarest first; candidates at most), or None: scan."""
    sets = what.lists()
    docs = sum(s["docs"] for s in state["segments"])
    if not sets or docs < gate.docs:
        return None
    df = index.trigram_frequencies(sorted(set().union(*sets)), state)
    ranked = [sorted(s, key=lambda c: (df[c], c))[: gate.most] for s in sets]
    most = sum(df[s[0]] for s in ranked)
    return None if most > gate.share * docs else ([s for s in ranked if df[s[0]] > 0], most)


def candidates(index: TextIndex, codes: list[list[int]], state: dict) -> DataFrame:
    """(doc_key, trigram): the documents that have all codes of one of the lists, without repeats, and one of their codes."""
    wanted = sorted({c for s in codes for c in s})
    if not wanted:
        return index.spark.createDataFrame([], "doc_key bigint, trigram int")
    hits = index.posting_keys(wanted, state).select("doc_key", "trigram")
    if len(wanted) == 1:
        return hits
    have = hits.groupBy("doc_key").agg(F.max("trigram").alias("trigram"), *[F.max(F.col("trigram") == c).alias(f"c{c}") for c in wanted])
    any_list = None
    for s in codes:
        every = None
        for c in s:
            every = F.col(f"c{c}") if every is None else every & F.col(f"c{c}")
        any_list = every if any_list is None else any_list | every
    return have.where(any_list).select("doc_key", "trigram")


def key_ranges(keys: list[int], most: int = _RANGES) -> list[tuple[int, int]]:
    """At most so many ranges that hold all keys, cut at the widest gaps; keys ascending."""
    gaps = sorted(range(1, len(keys)), key=lambda k: keys[k - 1] - keys[k])[: most - 1]
    cuts = [0, *sorted(gaps), len(keys)]
    return [(keys[a], keys[b - 1]) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]


def among(column: Column, keys: list[int]) -> Column:
    """Whether the column is one of the keys, with ranges that a scan prunes by."""
    if not keys:
        return F.lit(False)
    inside = None
    for a, b in key_ranges(keys):
        part = (column >= a) & (column <= b)
        inside = part if inside is None else inside | part
    return inside & column.isin(keys)


def matching(index: TextIndex, what: Condition, gate: Gate = Gate()) -> DataFrame:
    """(doc_key, text) of the sealed, untombstoned rows for which the predicate holds. Looks candidates up at once, if they are few."""
    return _matching(index, what, gate)[0]


def _matching(index: TextIndex, what: Condition, gate: Gate) -> tuple[DataFrame, list[int] | None]:
    state = index.manifest()
    plan = chosen(index, what, gate, state)
    rows, keys = index.rows(state), None
    text = what.column(F.col("text"))
    if plan is None:
        hits = rows.where(text)
    elif plan[1] <= gate.fetch:  # by document frequencies, which bound the candidates
        keys = sorted(r[0] for r in candidates(index, plan[0], state).select("doc_key").toLocalIterator())
        hits = rows.where(among(F.col("doc_key"), keys)).where(text)
    else:
        found = candidates(index, plan[0], state).select("doc_key")
        hits = index.rows(state, lambda t: near(t, "doc_key", found, plan[1], lambda held: F.when(held, text)))  # depends on both sides, so only candidates get there
    return hits.join(index.tombstones(state), "doc_key", "left_anti") if state["tombstones"] else hits, keys


def search(index: TextIndex, what: str | Condition, mode: str = "like", gate: Gate = Gate()) -> DataFrame:
    """Rows of the base table for which the predicate holds and which are sealed and untombstoned: all columns, the text as it was
    sealed. Texts are read from the index, other columns from the base table, as far as they are used. Column names may be any."""
    condition = matches(what, mode) if isinstance(what, str) else what
    hits, keys = _matching(index, condition, gate)
    base = index.docs
    key, text = (f"_{n}_{uuid.uuid4().hex}" for n in ("key", "text"))
    if keys is not None:
        base = base.where(among(F.col(f"`{index.key_col}`"), keys))
    joined = base.join(hits.select(F.col("doc_key").alias(key), F.col("text").alias(text)), F.col(f"`{index.key_col}`") == F.col(key))
    return joined.select(*[F.col(text).alias(c) if c == index.text_col else F.col(f"`{c}`") for c in base.columns])


def phrase_positions(index: TextIndex, literal: str, case_sensitive: bool = True) -> DataFrame:
    """(doc_key, start): byte positions at which the literal's trigrams stand in a row, from the index alone.

    Bit 7 of the flags tells ASCII trigrams from others, so with case they are exact for an ASCII literal in any text. For
    other literals, characters that share a code make it a superset, as for any trigram index.
    """
    codes, offsets, flags = occurrences(literal)
    if not len(codes):
        raise ValueError("a phrase needs three characters at least")
    state = index.manifest()
    by_code: dict[int, list[tuple[int, int]]] = {}
    for c, o, f in zip(codes, offsets, flags, strict=True):
        by_code.setdefault(int(c), []).append((int(o), int(f) & 0x87))
    rare = sorted(by_code, key=lambda c, df=index.trigram_frequencies(sorted(by_code), state): (df[c], c))
    hits = index.postings(state, sorted(by_code))
    lists = hits.groupBy("doc_key").agg(*[F.max(F.when(F.col("trigram") == c, F.col("occ"))).alias(f"c{c}") for c in rare])  # a row's own postings, one for each trigram
    lists = lists.where(" and ".join(f"c{c} is not null" for c in rare))

    def standing(starts: Column, c: int, off: int, want: int) -> Column:
        """The starts at which the trigram stands too."""
        flags = lambda o: (o["flags"].bitwiseAND(F.lit(0x87)) == want) if case_sensitive else F.lit(True)
        return F.filter(starts, lambda s: F.exists(f"c{c}", lambda o: (o["pos"] - off == s) & flags(o)))

    first = rare[0]
    off, want = by_code[first][0]
    begin = F.filter(f"c{first}", lambda o: (o["flags"].bitwiseAND(F.lit(0x87)) == want) if case_sensitive else F.lit(True))
    starts = F.transform(begin, lambda o: o["pos"] - off)
    for c in rare:
        for o, w in by_code[c]:
            if (c, o) != (first, off):
                starts = standing(starts, c, o, w)
    found = lists.select("doc_key", F.explode(starts).alias("start"))
    return found.join(index.tombstones(state), "doc_key", "left_anti") if state["tombstones"] else found
