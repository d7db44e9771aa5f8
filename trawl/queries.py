"""The registered queries of the search engine and the SQL that gives the same rows. Each runs over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.functions.context import extract_context
from trawl.functions.trigram import ascii_frequencies, code_of, text_to_trigram, trigram_counts, trigram_to_text, trigrams
from trawl.operators.predicates import ilike, iregex, like, regex
from trawl.operators.search import ALWAYS, Gate, matches, phrase_positions, search
from trawl.sources.index import TextIndex
from trawl.sources.workspace import workspace
from trawl.streaming.ingest import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def docs(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# predicates, by scan

_SCANS: dict[str, tuple[Callable, str, str]] = {
    "like_contains": (like, "%tion%", "text LIKE '%tion%'"),
    "like_prefix": (like, "The %", "text LIKE 'The %'"),
    "like_suffix": (like, "%the.", "text LIKE '%the.'"),
    "like_exact": (like, "That it.", "text LIKE 'That it.'"),
    "like_ordered_segments": (like, "%tion%ment%", "text LIKE '%tion%ment%'"),
    "like_overlap_guard": (like, "%ation%tion%", "text LIKE '%ation%tion%'"),
    "like_underscore": (like, "%th_t the%", "text LIKE '%th_t the%'"),
    "like_escape": (like, r"%\%\%\%%", r"text LIKE '%\%\%\%%' ESCAPE '\'"),
    "like_short_anchor": (like, "T%e.", "text LIKE 'T%e.'"),
    "like_short_fallback": (like, "%|%", "text LIKE '%|%'"),
    "ilike_ascii": (ilike, "%OF THE%", "text ILIKE '%OF THE%'"),
    "ilike_non_ascii": (ilike, "%ÉAU%", "text ILIKE '%ÉAU%'"),
    "unicode_like": (like, "%ción%", "text LIKE '%ción%'"),
    "like_anchored_segments": (like, "T%the%tion%.", "text LIKE 'T%the%tion%.'"),
    "like_three_segments": (like, "%the%tion%ment%", "text LIKE '%the%tion%ment%'"),
    "unicode_like_umlaut": (like, "%über%", "text LIKE '%über%'"),
    "regex": (regex, "the [a-z]+tion ", "regexp_matches(text, 'the [a-z]+tion ', 's')"),
    "regex_dot_newline": (regex, "the.*with", "regexp_matches(text, 'the.*with', 's')"),
    "regex_end": (regex, r"the\.$", r"regexp_matches(text, 'the\.$', 's')"),
    "regex_alternation": (regex, "(thanea|inea) the|zu", "regexp_matches(text, '(thanea|inea) the|zu', 's')"),
    "regex_optional_group": (regex, "(foobar)?worthless", "regexp_matches(text, '(foobar)?worthless', 's')"),
    "regex_class": (regex, "[[:digit:]]{3}-[[:digit:]]+", "regexp_matches(text, '[[:digit:]]{3}-[[:digit:]]+', 's')"),
    "regex_word_edge": (regex, r"\mloser\M", r"regexp_matches(text, '\bloser\b', 's')"),
    "regex_unicode_word": (regex, r"\mé\w+\M", r"regexp_matches(text, '(^|[^\pL\pN_])é[\pL\pN_]+([^\pL\pN_]|$)', 's')"),
    "iregex": (iregex, "EAU.*LA", "regexp_matches(text, 'EAU.*LA', 'is')"),
}
for _name, (_op, _pattern, _sql) in _SCANS.items():
    add(_name, lambda s, d, op=_op, p=_pattern: docs(s, d).where(op(F.col("text"), p)).select("doc_id", "source"), f"SELECT doc_id, source FROM documents WHERE {_sql}")

add("not_like", lambda s, d: docs(s, d).where(~like(F.col("text"), "%tion%")).select("doc_id"), "SELECT doc_id FROM documents WHERE text NOT LIKE '%tion%'")
add("not_regex", lambda s, d: docs(s, d).where(~regex(F.col("text"), "t[hi]e")).select("doc_id"), "SELECT doc_id FROM documents WHERE NOT regexp_matches(text, 't[hi]e', 's')")
add("like_conjunction", lambda s, d: docs(s, d).where(like(F.col("text"), "%tion%") & like(F.col("text"), "%eau%")).select("doc_id"), "SELECT doc_id FROM documents WHERE text LIKE '%tion%' AND text LIKE '%eau%'")
add("like_disjunction", lambda s, d: docs(s, d).where(like(F.col("text"), "%idiot%") | like(F.col("text"), "%über%")).select("doc_id"), "SELECT doc_id FROM documents WHERE text LIKE '%idiot%' OR text LIKE '%über%'")
add("like_other_tables", lambda s, d: docs(s, d, "pages").where(ilike(F.col("html"), "%<title>%")).select("page_id").unionByName(docs(s, d, "part").where(like(F.col("p_name"), "%1%")).select(F.col("p_partkey").alias("page_id"))), "SELECT page_id FROM pages WHERE html ILIKE '%<title>%' UNION ALL SELECT p_partkey AS page_id FROM part WHERE p_name LIKE '%1%'")


# indexes of this process, by what they hold

_BUILT: dict[tuple[str, str, str], TextIndex] = {}


def index(spark: SparkSession, sf_dir: str, state: str = "whole") -> TextIndex:
    """whole: all documents in one segment. half: English ones sealed, the others pending. sealed: as half, then sealed. merged: as sealed, into one segment. hidden: whole, with the documents of one source tombstoned."""
    key = (spark.sparkContext.applicationId, sf_dir, state)
    if key not in _BUILT:
        base = docs(spark, sf_dir)
        english = F.coalesce(F.col("lang") == "en", F.lit(False))
        path = workspace(spark, f"index-{state}")
        made = TextIndex.build(base, "doc_id", "text", path, None if state in ("whole", "hidden") else base.where(english))
        if state in ("half", "sealed", "merged"):
            made.append(base.where(~english).select("doc_id"))
        if state in ("sealed", "merged"):
            made.seal()
        if state == "merged":
            made.merge(1)
        if state == "hidden":
            made.tombstone(base.where("source = 'src3'").select("doc_id"))
        _BUILT[key] = made
    return _BUILT[key]


_PROBES = {
    "probe_like": ("%loser%", "like", "text LIKE '%loser%'"),
    "probe_like_segments": ("%thanea%inea the%", "like", "text LIKE '%thanea%inea the%'"),
    "probe_like_no_trigram": ("%|%", "like", "text LIKE '%|%'"),
    "probe_like_missing": ("%qqqzzz%", "like", "text LIKE '%qqqzzz%'"),
    "probe_ilike": ("%PATHETIC%", "ilike", "text ILIKE '%PATHETIC%'"),
    "probe_ilike_folding": ("%STUPID IS%", "ilike", "text ILIKE '%STUPID IS%'"),
    "probe_unicode": ("%über%", "like", "text LIKE '%über%'"),
    "probe_regex": ("disgusting.*idiot", "regex", "regexp_matches(text, 'disgusting.*idiot', 's')"),
    "probe_regex_alternation": ("(scum|clown) (the|of)", "regex", "regexp_matches(text, '(scum|clown) (the|of)', 's')"),
    "probe_regex_optional": ("(foobar)?trash", "regex", "regexp_matches(text, '(foobar)?trash', 's')"),
    "probe_iregex": ("Moron [a-z]+tion", "iregex", "regexp_matches(text, 'Moron [a-z]+tion', 'is')"),
}
for _name, (_pattern, _mode, _sql) in _PROBES.items():
    add(_name, lambda s, d, p=_pattern, m=_mode: search(index(s, d), p, m, ALWAYS).select("doc_id", "source"), f"SELECT doc_id, source FROM documents WHERE {_sql}")

add("probe_conjunction", lambda s, d: search(index(s, d), matches("%loser%") & matches("%THE%", "ilike"), gate=ALWAYS).select("doc_id"), "SELECT doc_id FROM documents WHERE text LIKE '%loser%' AND text ILIKE '%THE%'")
add("probe_disjunction", lambda s, d: search(index(s, d), matches("%loser%") | matches("disgusting.*idiot", "regex") | matches("%über%"), gate=ALWAYS).select("doc_id"), "SELECT doc_id FROM documents WHERE text LIKE '%loser%' OR regexp_matches(text, 'disgusting.*idiot', 's') OR text LIKE '%über%'")
add("probe_exclusion", lambda s, d: search(index(s, d), matches("%tion%") & ~matches("%loser%"), gate=ALWAYS).select("doc_id"), "SELECT doc_id FROM documents WHERE text LIKE '%tion%' AND text NOT LIKE '%loser%'")
add("search_gated", lambda s, d: search(index(s, d), "%worthless%", "like", Gate(0.05, 500)).select("doc_id"), "SELECT doc_id FROM documents WHERE text LIKE '%worthless%'")
add("tombstone_search", lambda s, d: search(index(s, d, "hidden"), "%tion%", "like", ALWAYS).select("doc_id"), "SELECT doc_id FROM documents WHERE text LIKE '%tion%' AND doc_id NOT IN (SELECT doc_id FROM documents WHERE source = 'src3')")
add("tombstone_scan", lambda s, d: search(index(s, d, "hidden"), "%|%", "like").select("doc_id"), "SELECT doc_id FROM documents WHERE text LIKE '%|%' AND source IS DISTINCT FROM 'src3'")
add("tombstone_count", lambda s, d: index(s, d, "hidden").tombstones().agg(F.count("*").alias("n"), F.sum("doc_key").alias("keys")), "SELECT count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS keys FROM documents WHERE source = 'src3'")
add("pending_invisible", lambda s, d: search(index(s, d, "half"), "%tion%", "like", ALWAYS).select("doc_id"), "SELECT doc_id FROM documents WHERE text LIKE '%tion%' AND lang = 'en'")
add("pending_rows", lambda s, d: index(s, d, "half").pending().select("doc_key"), "SELECT doc_id AS doc_key FROM documents WHERE lang IS DISTINCT FROM 'en'")
add("sealed_visible", lambda s, d: search(index(s, d, "sealed"), "%tion%", "like", ALWAYS).select("doc_id"), "SELECT doc_id FROM documents WHERE text LIKE '%tion%'")
add("merge_invariant", lambda s, d: search(index(s, d, "merged"), "%tion%", "like", ALWAYS).select("doc_id"), "SELECT doc_id FROM documents WHERE text LIKE '%tion%'")


def stream_sealed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents arrive as a stream at an empty index and are sealed batch by batch."""
    base = docs(spark, sf_dir)
    at = workspace(spark, "index-stream")
    made = TextIndex.build(base, "doc_id", "text", at, base.limit(0))
    stream = spark.readStream.schema(base.schema).parquet(f"{sf_dir}/documents.parquet*")
    ingest(made, stream, f"{at}-offsets", seal=True).awaitTermination()
    return search(made, "%loser%", "like", ALWAYS).select("doc_id")


add("stream_sealed", stream_sealed, "SELECT doc_id FROM documents WHERE text LIKE '%loser%'")


def growing(spark: SparkSession, sf_dir: str, name: str) -> tuple[str, DataFrame, TextIndex]:
    """A table that begins with the English documents, and its index; (the table's path, the other documents, the index)."""
    base, path = docs(spark, sf_dir), workspace(spark, f"table-{name}")
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    base.where(english).write.parquet(path)
    return path, base.where(~english), TextIndex.build(path, "doc_id", "text", workspace(spark, f"index-{name}"))


def late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys are pending before their rows arrive: a seal finds none and keeps them, the next one finds all."""
    path, others, made = growing(spark, sf_dir, "late")
    made.append(others.select("doc_id"))
    made.seal()
    others.write.mode("append").parquet(path)
    made.seal()
    return search(made, "%tion%", "like", ALWAYS).select("doc_id", "source")


def late_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows arrive after the build in a table that grows, and as a stream that seals each batch."""
    path, others, made = growing(spark, sf_dir, "late-stream")
    others.write.mode("append").parquet(path)
    ingest(made, spark.readStream.schema(others.schema).parquet(path), workspace(spark, "offsets"), seal=True).awaitTermination()
    return search(made, "%tion%", "like", ALWAYS).select("doc_id", "source")


def changed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts change after the build; those of one source are appended and sealed again, the others count as they were sealed."""
    base, at = docs(spark, sf_dir), workspace(spark, "table-changed")
    base.write.parquet(f"{at}/0")
    now = ["0"]
    made = TextIndex.build(lambda: spark.read.parquet(f"{at}/{now[0]}"), "doc_id", "text", f"{at}-index")
    base.withColumn("text", F.concat(F.lit("renewed "), "text")).write.parquet(f"{at}/1")
    now[0] = "1"
    made.append(base.where("source = 'src3'").select("doc_id"))
    made.seal()
    return search(made, "renewed %tion%", "like", ALWAYS).select("doc_id", F.lit("new").alias("state")).union(search(made, "%loser%", "like", ALWAYS).select("doc_id", F.lit("any").alias("state")))


def many_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve batches sealed one by one, which merges them."""
    base = docs(spark, sf_dir)
    part = F.pmod(F.xxhash64("doc_id"), F.lit(12))
    made = TextIndex.build(base, "doc_id", "text", workspace(spark, "index-many"), base.where(part == 0), {"target_segments": 10})
    for k in range(1, 12):
        made.append(base.where(part == k).select("doc_id"))
        made.seal()
    if len(made.manifest()["segments"]) > 10:
        raise RuntimeError("seals didn't merge")
    return search(made, "%tion%", "like", ALWAYS).select("doc_id")


add("late_rows", late_rows, "SELECT doc_id, source FROM documents WHERE text LIKE '%tion%'")
add("late_stream", late_stream, "SELECT doc_id, source FROM documents WHERE text LIKE '%tion%'")
add("changed_text", changed_text, "SELECT doc_id, 'new' AS state FROM documents WHERE source = 'src3' AND text LIKE '%tion%' UNION ALL SELECT doc_id, 'any' FROM documents WHERE text LIKE '%loser%'")
add("many_segments", many_segments, "SELECT doc_id FROM documents WHERE text LIKE '%tion%'")


# trigrams

_WINDOWS = "unnest(list_transform(range(1, length(text) - 1), lambda i: substr(lower(text), CAST(i AS INTEGER), 3)))"


def trigram_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = docs(spark, sf_dir).where("length(text) >= 3").select("doc_id", F.transform(F.array(trigrams(F.col("text"))), lambda w: F.struct(F.size(w).cast("bigint").alias("n_trigrams"), F.size(F.array_distinct(w)).cast("bigint").alias("n_distinct")))[0].alias("n"))
    return windows.select("doc_id", "n.n_trigrams", "n.n_distinct")


add("trigram_extract", trigram_extract, f"SELECT doc_id, count(*) AS n_trigrams, count(DISTINCT trigram) AS n_distinct FROM (SELECT doc_id, {_WINDOWS} AS trigram FROM documents) GROUP BY doc_id")
add("trigram_df", lambda s, d: trigram_counts(docs(s, d), "text"), f"SELECT trigram, count(*) AS df, CAST(sum(tf) AS BIGINT) AS n_occ FROM (SELECT trigram, doc_id, count(*) AS tf FROM (SELECT doc_id, {_WINDOWS} AS trigram FROM documents) GROUP BY ALL) GROUP BY trigram")
add("trigram_topk", lambda s, d: trigram_counts(docs(s, d), "text").select("trigram", "df").orderBy(F.col("df").desc(), "trigram").limit(20), f"SELECT trigram, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, {_WINDOWS} AS trigram FROM documents) GROUP BY trigram ORDER BY df DESC, trigram LIMIT 20")

_ASCII_WORDS = "SELECT DISTINCT w FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM documents) WHERE length(w) = 3"


def words_of_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("w")).where("length(w) = 3").distinct()


add("trigram_code", lambda s, d: words_of_three(s, d).select("w", text_to_trigram(F.col("w")).alias("code")), f"SELECT w, CAST(ascii(lower(w[1])) + 256 * ascii(lower(w[2])) + 65536 * ascii(lower(w[3])) AS BIGINT) AS code FROM ({_ASCII_WORDS})")
add("trigram_to_text", lambda s, d: words_of_three(s, d).select("w", trigram_to_text(text_to_trigram(F.col("w"))).alias("folded")), f"SELECT w, lower(w) AS folded FROM ({_ASCII_WORDS})")


# positions and introspection

_STARTS = "SELECT doc_id AS doc_key, CAST(strlen(substr(text, 1, CAST(i - 1 AS INTEGER))) AS BIGINT) AS start FROM (SELECT doc_id, text, unnest(range(1, length(text) + 1)) AS i FROM documents WHERE text LIKE '%loser%') WHERE substr(text, CAST(i AS INTEGER), 5) = 'loser'"
add("phrase_positions", lambda s, d: phrase_positions(index(s, d), "loser").select("doc_key", F.col("start").cast("bigint").alias("start")), _STARTS)
_NEEDLE = code_of("sta")
_PREVIEW = """SELECT doc_id AS doc_key, CAST(len(p) AS INTEGER) AS positions_count, CAST(p[1] AS INTEGER) AS first_position, CAST(p[-1] AS INTEGER) AS last_position FROM (
SELECT doc_id, list_transform(list_filter(range(1, length(text) - 1), lambda i: substr(lower(text), CAST(i AS INTEGER), 3) = 'sta'), lambda i: strlen(substr(text, 1, CAST(i - 1 AS INTEGER)))) AS p
FROM documents) WHERE len(p) > 0 ORDER BY doc_id LIMIT 50"""
add("postings_preview", lambda s, d: index(s, d).postings_preview(1, _NEEDLE, 50).select("doc_key", "positions_count", "first_position", "last_position"), _PREVIEW)


def first_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = index(spark, sf_dir)
    first = made.postings_preview(1, _NEEDLE, 1).collect()
    return made.posting_positions(1, _NEEDLE, first[0]["doc_key"] if first else -1).select("position", "flags")


add("posting_positions", first_positions, """SELECT CAST(strlen(substr(text, 1, CAST(i - 1 AS INTEGER))) AS BIGINT) AS position,
CAST((CASE WHEN t[1] <> lower(t[1]) THEN 1 ELSE 0 END) + (CASE WHEN t[2] <> lower(t[2]) THEN 2 ELSE 0 END) + (CASE WHEN t[3] <> lower(t[3]) THEN 4 ELSE 0 END) AS INTEGER) AS flags
FROM (SELECT text, i, substr(text, CAST(i AS INTEGER), 3) AS t FROM (SELECT text, unnest(range(1, length(text) - 1)) AS i FROM documents
WHERE doc_id = (SELECT min(doc_id) FROM documents WHERE contains(lower(text), 'sta')))) WHERE lower(t) = 'sta'""")
#: Codes of all characters as the index has them: non-ASCII ones by CRC-32, which DuckDB lacks, so SQL has the ASCII trigrams.
_ENTRIES = """WITH w AS (SELECT doc_id, unnest(list_transform(range(1, length(text) - 1), lambda i: substr(text, CAST(i AS INTEGER), 3))) AS t FROM documents WHERE lang = 'en'),
c AS (SELECT doc_id, ascii(lower(t[1])) + 256 * ascii(lower(t[2])) + 65536 * ascii(lower(t[3])) AS trigram FROM w WHERE strlen(t) = 3)
SELECT CAST(trigram AS INTEGER) AS trigram, count(DISTINCT doc_id) AS df, count(*) AS n_occ FROM c GROUP BY trigram"""


def segment_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All entries of a segment, as they are."""
    return index(spark, sf_dir, "sealed").segment_entries(1)


def ascii_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trigrams of ASCII characters alone, by their flags, with their frequencies, from a segment's postings."""
    return ascii_frequencies(index(spark, sf_dir, "sealed").segment_blocks(1))


add("segment_entries", segment_entries)
add("ascii_entries", ascii_entries, _ENTRIES)
add("segments", lambda s, d: index(s, d, "sealed").segments().select("segment_idx", "docs"), "SELECT 1 AS segment_idx, count(*) FILTER (lang = 'en') AS docs FROM documents UNION ALL SELECT 2, count(*) FILTER (lang IS DISTINCT FROM 'en') FROM documents")
add("segment_files", lambda s, d: index(s, d, "sealed").segment_files(1))


def index_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether files and bytes of all parts sum to what the index says that it takes, the postings' to their segments', and rows to the documents."""
    made = index(spark, sf_dir, "hidden")
    parts, stats = made.overhead(), made.storage_stats()
    sums = parts.agg(F.sum("files").alias("f"), F.sum("bytes").alias("b"), F.max(F.when(F.col("component") == "rows", F.col("rows"))).alias("docs"), F.max(F.when(F.col("component") == "postings", F.col("bytes"))).alias("p"))
    files = made.segment_files(1).agg(F.sum("bytes").alias("one"))
    own = made.segments().agg(F.sum("size").alias("size"))
    return sums.crossJoin(stats.select("files", "bytes")).crossJoin(files).crossJoin(own).select((F.col("f") == F.col("files")).alias("files_add_up"), (F.col("b") == F.col("bytes")).alias("bytes_add_up"), ((F.col("p") == F.col("size")) & (F.col("one") == F.col("size"))).alias("postings_add_up"), "docs")  # single rows


add("index_sizes", index_sizes, "SELECT true AS files_add_up, true AS bytes_add_up, true AS postings_add_up, count(*) AS docs FROM documents")
add("storage_stats", lambda s, d: index(s, d, "half").storage_stats().select("segments", "docs", "pending_rows", "tombstones"), "SELECT 1 AS segments, count(*) FILTER (lang = 'en') AS docs, count(*) FILTER (lang IS DISTINCT FROM 'en') AS pending_rows, CAST(0 AS BIGINT) AS tombstones FROM documents")
add("overhead", lambda s, d: index(s, d, "hidden").overhead())


# lines around matches

_CONTEXT = """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
m AS (SELECT doc_id, lines, unnest(list_filter(range(1, len(lines) + 1), lambda i: regexp_matches(lines[i], {p}, '{o}'))) AS i FROM l)
SELECT doc_id, CAST(i AS INTEGER) AS match_line_number, regexp_replace(array_to_string(list_transform(range(greatest(i - {c}, 1), least(i + {c}, len(lines)) + 1),
lambda k: CASE WHEN k = i THEN regexp_replace(lines[k], '(' || {p} || ')', '<mark>\\1</mark>', '{o}g') ELSE lines[k] END), chr(10)), '^' || chr(10) || '+', '') AS context_snippet FROM m"""


def context(name: str, pattern: str, lines: int, case_sensitive: bool) -> None:
    add(name, lambda s, d: extract_context(docs(s, d), "text", pattern, lines, case_sensitive, ("doc_id",)), _CONTEXT.format(p=quote(pattern), c=max(lines, 0), o="" if case_sensitive else "i"))


context("context_highlight", "loser|idiot", 1, True)
context("context_ci", "THE[a-z]*ING", 2, False)
context("context_negative", "stupid", -5, True)
context("context_no_match", "qqqzzz", 2, True)
context("context_leading_blank", "worthless", 3, True)


# the host's operators over results

add("search_then_groupby", lambda s, d: search(index(s, d), "%pathetic%", "like", ALWAYS).groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars")), "SELECT source, lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents WHERE text LIKE '%pathetic%' GROUP BY source, lang")
add("search_join_labels", lambda s, d: search(index(s, d), "%loser%", "like", ALWAYS).join(docs(s, d, "labels"), "doc_id").groupBy("toxic").agg(F.count("*").alias("n")), "SELECT toxic, count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE text LIKE '%loser%' GROUP BY toxic")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold two literals in order, by a scan that Spark pushes to Parquet."""
    return docs(spark, sf_dir).where(like(F.col("text"), "%tion%ment%")).select("doc_id")
