"""Matching lines with the lines around them, matches marked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.plans.pattern import is_linear


def line_pattern(pattern: str, case_sensitive: bool) -> str:
    """Java's form of a linear-time regular expression: lines end at line feeds only, classes are Unicode's; no look-around, no back-references."""
    if not is_linear(pattern):
        raise ValueError("look-around and back-references aren't supported")
    return ("(?dU)" if case_sensitive else "(?idU)") + f"({pattern})"


def context_rows(text: Column, pattern: str, context_lines: int, case_sensitive: bool, mark: tuple[str, str] = ("<mark>", "</mark>")) -> Column:
    """Array of (match_line_number, context_snippet), one for each matching line, in order.

    A snippet has up to ``context_lines`` lines on either side (a negative number is 0). Only the matching line is
    marked. Empty lines before the first other one are left out of a snippet.
    """
    p = line_pattern(pattern, case_sensitive)
    c = max(int(context_lines), 0)

    def snippet(lines: Column, i: Column) -> Column:
        first = F.greatest(i - c, F.lit(1))
        window = F.slice(lines, first, F.least(i + c, F.size(lines)) - first + 1)
        marked = F.transform(window, lambda line, k: F.when(k + first == i, F.regexp_replace(line, p, mark[0] + "$1" + mark[1])).otherwise(line))
        return F.struct(i.cast("int").alias("match_line_number"), F.regexp_replace(F.array_join(marked, "\n"), r"\A\n+", "").alias("context_snippet"))

    def found(lines: Column) -> Column:
        numbered = F.transform(lines, lambda line, k: F.when(line.rlike(p), k + 1))
        return F.transform(F.filter(numbered, lambda k: k.isNotNull()), lambda k: snippet(lines, k))

    return F.transform(F.array(F.split(text, "\n", -1)), found)[0]  # a lambda's argument is computed once, an expression inside it for each element


def extract_context(df: DataFrame, text_col: str, pattern: str, context_lines: int, case_sensitive: bool, keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns ``keep``, match_line_number, context_snippet. Rows without a match give none; null texts have none."""
    some = df.where(F.col(text_col).isNotNull())
    return some.select(*keep, F.inline(context_rows(F.col(text_col), pattern, context_lines, case_sensitive)))
