"""LIKE, ILIKE and regular-expression predicates with the host's semantics, as Spark columns."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from trawl.plans import pattern as P

LIKE, ILIKE, REGEX, IREGEX = "like", "ilike", "regex", "iregex"
MODES = (LIKE, ILIKE, REGEX, IREGEX)


def like(text: Column, pattern: str) -> Column:
    """Literals in order between % are searched for one after another, without going back; other patterns are Spark's LIKE."""
    pieces = P.like_pieces(pattern)
    if pieces is None or len([p for p in pieces if p]) < 2 or not any(pieces[1:-1]):
        return text.like(P.spark_like(pattern))
    first, *middle, last = pieces
    anchored = [text.startswith(first)] if first else []
    anchored += [text.endswith(last)] if last else []
    body = text
    if anchored:
        room = F.char_length(text) - len(first) - len(last)
        anchored.append(room >= sum(map(len, middle)))
        body = F.substring(text, F.lit(len(first) + 1), F.greatest(room, F.lit(0)))
    found = [*anchored, *[text.contains(p) for p in dict.fromkeys(middle)]]
    if len(middle) == 2:
        found += [body.contains(middle[0]), F.position(F.lit(middle[1]), body, F.position(F.lit(middle[0]), body, F.lit(1)) + len(middle[0])) > 0]
    else:
        after = lambda at, p: F.when(at > 0, F.nullif(F.position(p, body, at), F.lit(0)) + F.char_length(p))
        found.append(F.aggregate(F.array(*map(F.lit, middle)), F.lit(1), lambda at, p: F.coalesce(after(at, p), F.lit(0))) > 0)
    return F.when(text.isNotNull(), reduce(and_, found))


def ilike(text: Column, pattern: str) -> Column:
    return text.ilike(P.spark_like(pattern))


def regex(text: Column, pattern: str) -> Column:
    return text.rlike(P.regex(pattern).java)


def iregex(text: Column, pattern: str) -> Column:
    return text.rlike(P.regex(pattern, fold=True).java)


def predicate(text: Column, pattern: str, mode: str) -> Column:
    return {LIKE: like, ILIKE: ilike, REGEX: regex, IREGEX: iregex}[mode](text, pattern)


def need(pattern: str, mode: str) -> tuple[P.Need, bool]:
    """(what a match must contain, whether case is folded)."""
    if mode in (LIKE, ILIKE):
        return P.like_need(pattern), mode == ILIKE
    compiled = P.regex(pattern, fold=mode == IREGEX)
    return compiled.need, compiled.fold
