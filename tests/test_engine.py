import random

import duckdb
import pytest
from pyspark.sql import functions as F

from trawl.functions.context import extract_context
from trawl.functions.trigram import code_of
from trawl.operators.predicates import predicate
from trawl.operators.search import ALWAYS, Gate, key_ranges, matches, phrase_positions, search
from trawl.sources.index import FORMAT, STALE_SECONDS, Conflict, TextIndex, builds
from trawl.sources.workspace import workspace
from trawl.streaming.ingest import ingest

TEXT = "id bigint, text string"


def build(spark, texts, initial=None):
    df = spark.createDataFrame(list(enumerate(texts, 1)), TEXT)
    return TextIndex.build(df, "id", "text", workspace(spark, "t"), initial(df) if initial else None)


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


FIXTURES = [
    ("abcdef", "abc", "like", False), ("xabcdef", "%abc", "like", False), ("abcd", "%abc%bcd%", "like", False), ("abc", "%abc%abc%", "like", False),
    ("a shadow", "a%shadow", "like", True), ("ñbc", "%hbc%", "like", False), ("ab", "ab|foobar", "regex", True), ("xy", "(foobar)?xy", "regex", True),
    ("foobar", "(?:foobar)", "regex", True), ("a\\bcd", r"a\\bcd", "regex", True), ("foo\nbar", "foo.*bar", "regex", True), ("foo\nbar", "foo$", "regex", False),
    ("aKbc", "%KBC%", "ilike", True), ("foobar", r"\mfoo", "regex", True), ("xfoobar", r"\mfoo", "regex", False), ("50% off", r"50\%%", "like", True),
    ("FOO stuff BAR", "foo.*bar", "iregex", True), ("catfish", "(cat|dog)fish", "regex", True), ("abi̇", "%abİ%", "ilike", True), (None, "%a%", "like", False),
    ("é", "é", "regex", False), ("x]y", "[]]y", "regex", True), ("a&&b", "[&]{2}b", "regex", True), ("tab\there", r"\t[[:alpha:]]+", "regex", True),
]


@pytest.mark.parametrize(("text", "pattern", "mode", "expected"), FIXTURES)
def test_predicates(spark, text, pattern, mode, expected):
    df = spark.createDataFrame([(1, text)], TEXT)
    assert (df.where(predicate(F.col("text"), pattern, mode)).count() == 1) is expected


@pytest.fixture(scope="module")
def mixed(spark):
    texts = [t for t, *_ in FIXTURES] + ["olá crêpe 大阪 thimble", "sign 🐢 with plain label", "only latin thimble", "run" * 500 + "runaway", "", "a", "rows_left_margin_shown_cells", "rows before rows_left_x"]
    return build(spark, texts)


@pytest.mark.parametrize("pattern_mode", sorted({(p, m) for _, p, m, _ in FIXTURES} | {("%大阪 %", "like"), ("%crêpe%", "like"), ("%thimble%", "like"), ("%runaway%", "like"), ("%rows_left%", "like"), ("%", "like"), ("THIMBLE|label", "iregex"), ("%zzz%", "like")}))
def test_probe_equals_scan(mixed, pattern_mode):
    pattern, mode = pattern_mode
    want = ids(mixed.docs.where(predicate(F.col("text"), pattern, mode)))
    assert ids(search(mixed, pattern, mode, ALWAYS)) == want
    assert ids(search(mixed, pattern, mode, Gate(0.0, 10**9))) == want


def test_random_patterns_probe_equals_scan(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcKé") for _ in range(rng.randrange(1, 5)))
    index = build(spark, [" ".join(word() for _ in range(rng.randrange(0, 12))) for _ in range(150)])
    for _ in range(12):
        p = rng.choice(["%", ""]) + rng.choice(["%", "_", "% "]).join(word() for _ in range(rng.randrange(1, 3))) + rng.choice(["%", ""])
        mode = rng.choice(["like", "ilike"])
        assert ids(search(index, p, mode, ALWAYS)) == ids(index.docs.where(predicate(F.col("text"), p, mode))), (p, mode)


def test_conjunction_keeps_both(spark):
    index = build(spark, ["abc", "abc xyz"])
    assert ids(search(index, "%abc%", "like", ALWAYS).where(predicate(F.col("text"), "%xyz%", "like"))) == [2]


def test_pending_seal_and_late_rows(spark):
    index = build(spark, [f"first-{i}" for i in range(30)] + [f"after-{i}" for i in range(10)], lambda df: df.limit(0))
    keys = index.docs.select("id")
    index.append(keys.where("id <= 30"))
    assert ids(search(index, "%first-%", "like", ALWAYS)) == []
    cut = index.detach()
    index.append(keys.where("id > 30"))
    assert index.seal(cut) == 30
    assert len(ids(search(index, "first-%", "like", ALWAYS))) == 30 and ids(search(index, "after-%", "like", ALWAYS)) == []
    assert index.seal() == 10 and index.seal() == 0
    assert len(ids(search(index, "after-%", "like", ALWAYS))) == 10
    index.append(keys)
    assert index.seal() == 0
    duplicates = index.postings().groupBy("trigram", "doc_key").count().where("count > 1").count()
    assert duplicates == 0


def test_tombstones(spark):
    index = build(spark, ["hold moo", "drop moo now", "hold moo also"])
    gone = spark.createDataFrame([(2,), (2,), (None,)], "k bigint")
    assert len(ids(search(index, "%moo%", "like", ALWAYS))) == 3
    assert index.tombstone(gone) == 1 and index.tombstone(gone) == 0
    for gate in (ALWAYS, Gate()):
        assert ids(search(index, "%moo%", "like", gate)) == [1, 3]
    assert index.docs.count() == 3
    assert phrase_positions(index, "moo").count() == 2


def test_merges_keep_results_and_drop_the_dead(spark):
    index = build(spark, [f"{'thimble-' if i % 10 == 0 else ''}{i * 7919:032x}" for i in range(120)], lambda df: df.where("id <= 40"))
    for low in (40, 60, 80, 100):
        index.append(index.docs.where(f"id > {low} and id <= {low + 20}").select("id"))
        index.seal(target=3)
    assert len(index.manifest()["segments"]) <= 3
    before = ids(search(index, "%thimble%", "like", ALWAYS))
    assert len(before) == 12
    index.tombstone(spark.createDataFrame([(1,)], "k bigint"))
    assert index.merge(1) == 1
    assert ids(search(index, "%thimble%", "like", ALWAYS)) == before[1:]
    assert index.postings().where("doc_key = 1").count() == 0
    index.vacuum()
    assert ids(search(TextIndex.open(index.docs, "id", "text", index.files.root), "%thimble%", "like", ALWAYS)) == before[1:]


def test_writers_exclude_each_other(spark):
    index = build(spark, ["abc"])
    with index.lock(), pytest.raises(Conflict):
        index.tombstone(spark.createDataFrame([(1,)], "k bigint"))
    assert index.tombstone(spark.createDataFrame([(1,)], "k bigint")) == 1
    with pytest.raises(Conflict):
        TextIndex.build(index.docs, "id", "text", index.files.root)
    with pytest.raises(Conflict):
        index._publish({**index.manifest()})


def test_introspection(spark):
    n = builds()
    index = build(spark, ["abcd", "zzzz", "xxabcABC", None])
    assert builds() == n + 1
    assert [tuple(r)[:3] for r in index.segments().collect()] == [(1, 4, index.dictionary().agg(F.sum("df")).first()[0])]
    entries = {r.trigram: (r.df, r.n_occ) for r in index.segment_entries(1).collect()}
    assert entries[code_of("abc")] == (2, 3) and entries[code_of("zzz")] == (1, 2)
    assert [tuple(r) for r in index.postings_preview(1, code_of("abc"), 5).collect()] == [(1, 1, 0, 0), (3, 2, 2, 5)]
    assert index.postings_preview(1, code_of("abc"), 0).count() == 0 == index.postings_preview(1, code_of("abc"), -3).count()
    assert [tuple(r) for r in index.posting_positions(1, code_of("abc"), 3).collect()] == [(2, 0), (5, 7)]
    assert index.posting_positions(1, code_of("abc"), 2).count() == 0
    for wrong in (0, 2):
        with pytest.raises(IndexError):
            index.segment_entries(wrong)
    stats, overhead = index.storage_stats().first(), index.overhead().collect()
    assert index.overhead().where("component = 'rows' and rows = 4").count() == 1
    assert stats.bytes == sum(r.bytes for r in overhead) and stats.files == sum(r.files for r in overhead) and stats.docs == 4
    assert index.segment_files(1).agg(F.sum("bytes")).first()[0] == index.segments().first()["size"]


def test_like_chains_against_spark(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice("abé") for _ in range(rng.randrange(0, 14))) for _ in range(300)] + [None]
    df = spark.createDataFrame(list(enumerate(texts, 1)), TEXT).cache()
    for _ in range(25):
        p = "%".join("".join(rng.choice("abé") for _ in range(rng.randrange(0, 3))) for _ in range(rng.randrange(2, 6)))
        for negated in (False, True):
            own, plain = predicate(F.col("text"), p, "like"), F.col("text").like(p)
            assert ids(df.where(~own if negated else own)) == ids(df.where(~plain if negated else plain)), p
    df.unpersist()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_few_candidates_are_read_by_key_and_the_predicate_stays_above(spark):
    index = build(spark, ["abcdef", "xyz"])
    assert "In(trigram" in plan_of(search(index, "%abcd%", "like", Gate(1.0, 0, fetch=0)))
    few = plan_of(search(index, "%abcd%", "like", ALWAYS).select("id"))
    assert "EqualTo(doc_key,1)" in few
    many = plan_of(search(index, "%abcd%", "like", Gate(1.0, 0, fetch=0)).select("id"))
    assert "StringContains(text" not in many and "Contains(text" in many.split("FileScan")[0]
    for gate in (ALWAYS, Gate(1.0, 0, fetch=0), Gate()):
        assert ids(search(index, "%abcd%", "like", gate)) == [1]


def test_a_probe_reads_fewer_bytes(spark):
    index = build(spark, [f"{i * 7919:0400x} {'needle' if i % 5000 == 7 else ''}" for i in range(20000)])
    folder = index.files.path("segments", index.manifest()["segments"][0]["id"], "rows")
    keys = ids(search(index, "%needle%", "like", ALWAYS))
    assert len(keys) == 4
    rows = spark.read.parquet(folder)
    from trawl.operators.search import among

    part = rows.where(among(F.col("doc_key"), keys)).select("text")
    part.collect()
    read = part._jdf.queryExecution().executedPlan()
    while not read.children().isEmpty():
        read = read.children().head()
    assert read.metrics().get("numOutputRows").get().value() < 20000 / 4


def test_ranges_of_keys():
    assert key_ranges([1, 2, 3, 50, 51, 900], 3) == [(1, 3), (50, 51), (900, 900)]
    assert key_ranges([5], 64) == [(5, 5)] and key_ranges([1, 9], 1) == [(1, 9)]


def test_conditions(spark):
    index = build(spark, ["abc xyz", "abc", "xyz", None, "ABC", "xyz qrs"])
    asked = {"and": matches("%abc%") & matches("%XYZ%", "ilike"), "or": matches("%abc%") | matches("qrs", "regex"), "not": matches("%xyz%") & ~matches("%abc%"), "deep": (matches("%abc%") | matches("%qrs%")) & ~(matches("%xyz%") & matches("%abc%")), "scan": ~matches("%abc%")}
    want = {"and": [1], "or": [1, 2, 6], "not": [3, 6], "deep": [2, 6], "scan": [3, 5, 6]}
    for name, what in asked.items():
        for gate in (ALWAYS, Gate(1.0, 0, fetch=0), Gate()):
            assert ids(search(index, what, gate=gate)) == want[name], name


def test_rows_that_arrive_after_the_build(spark, tmp_path):
    at = str(tmp_path / "base")
    spark.createDataFrame([(1, "thimble one")], TEXT).write.parquet(at)
    index = TextIndex.build(at, "id", "text", workspace(spark, "t"))
    index.append(spark.createDataFrame([(2,), (3,)], "k bigint"))
    assert index.seal() == 0 and sorted(r[0] for r in index.pending().collect()) == [2, 3]
    spark.createDataFrame([(2, "thimble two")], TEXT).write.mode("append").parquet(at)
    assert index.seal() == 1 and [r[0] for r in index.pending().collect()] == [3]
    for gate in (ALWAYS, Gate()):
        assert ids(search(TextIndex.open(at, "id", "text", index.files.root), "%thimble%", "like", gate)) == [1, 2]
    assert index.seal(keep_missing=False) == 0 and index.pending().count() == 0


def test_changed_texts(spark, tmp_path):
    texts = {1: "old thimble", 2: "old other"}
    index = TextIndex.build(lambda: spark.createDataFrame(list(texts.items()), TEXT), "id", "text", workspace(spark, "t"))
    texts.update({1: "new button", 2: "new thimble"})
    for gate in (ALWAYS, Gate(1.0, 0, fetch=0), Gate()):  # as they were sealed, by probe and by scan
        assert [tuple(r) for r in search(index, "%thimble%", "like", gate).collect()] == [(1, "old thimble")]
    index.append(spark.createDataFrame([(1,), (2,)], "k bigint"))
    assert index.seal() == 2 and index.seal() == 0
    for merged in (False, True):
        if merged:
            assert index.merge(1) == 1 and index.manifest()["replaced"] == []
        for gate in (ALWAYS, Gate(1.0, 0, fetch=0), Gate()):
            assert [tuple(r) for r in search(index, "%thimble%", "like", gate).collect()] == [(2, "new thimble")]
            assert ids(search(index, "old%", "like", gate)) == []
        assert index.postings().groupBy("trigram", "doc_key").count().where("count > 1").count() == 0
        assert index.sealed_keys().count() == 2
    index.append(spark.createDataFrame([(1,), (2,)], "k bigint"))
    assert index.seal() == 0
    texts[1] = None
    index.append(spark.createDataFrame([(1,)], "k bigint"))
    assert index.seal() == 1 and ids(search(index, "%button%", "like", ALWAYS)) == []


def test_locks_wait_and_are_taken_over(spark):
    index = build(spark, ["abc"])
    with index.lock(), pytest.raises(Conflict):
        index.seal(wait=0.5)
    assert index.files.create('{"owner": "dead", "at": 0}', "writer.lock") and STALE_SECONDS > 0
    assert index.seal() == 0 and not index.files.fs.exists(index.files._at("writer.lock"))


def test_vacuum_seals_and_tries(spark):
    index = build(spark, ["abc thimble", "thimble"], lambda df: df.where("id = 1"))
    index.append(index.docs.select("id"))
    with index.lock():
        assert index.vacuum() is False
    assert index.vacuum() is True and ids(search(index, "%thimble%", "like", ALWAYS)) == [1, 2]
    assert index.manifest()["consumed"] == [] and index.files.names("pending") == []


def test_options_and_format(spark):
    df = spark.createDataFrame([(i, f"thimble {i}") for i in range(50)], TEXT)
    index = TextIndex.build(df, "id", "text", workspace(spark, "t"), df.where("id < 10"), {"partitions": 3, "target_segments": 1, "autovacuum_enabled": False})
    assert index.segment_files(1).count() == 3
    index.append(df.select("id"))
    assert index.vacuum() and index.pending().count() == 50
    assert index.seal() == 40 and len(index.manifest()["segments"]) == 1
    for wrong in ({"fillfactor": 70}, {"partitions": 0}, {"partitions": "3"}):
        with pytest.raises(ValueError):
            TextIndex.build(df, "id", "text", workspace(spark, "t"), options=wrong)
    index._publish({**index.manifest(), "version": 99, "format": FORMAT - 1})
    with pytest.raises(ValueError):
        index.manifest()


def test_index_size(spark):
    """The postings of texts like the size bound's take no more than twice the texts' bytes."""
    texts = [__import__("hashlib").md5(str(i).encode()).hexdigest() * 50 for i in range(2048)]
    index = build(spark, texts)
    assert index.segments().first()["size"] <= 2 * sum(map(len, texts))


def test_columns_may_have_any_names(spark):
    df = spark.createDataFrame([(1, "abc thimble", 1, 2, 3, 4)], "id bigint, text string, _key int, doc_key int, _pending_key int, `a.b` int")
    index = TextIndex.build(df, "id", "text", workspace(spark, "t"), df.limit(0))
    index.append(df.select("id"))
    assert index.seal() == 1
    for gate in (ALWAYS, Gate(1.0, 0, fetch=0), Gate()):
        assert [tuple(r) for r in search(index, "%thimble%", "like", gate).collect()] == [(1, "abc thimble", 1, 2, 3, 4)]


def test_phrases(spark):
    index = build(spark, ["thimble Thimble thimble", "no", "thímble thimble"])
    rows = lambda sensitive: sorted(map(tuple, phrase_positions(index, "thimble", sensitive).where("doc_key = 1").collect()))
    assert rows(True) == [(1, 0), (1, 16)] and rows(False) == [(1, 0), (1, 8), (1, 16)]
    with pytest.raises(ValueError):
        phrase_positions(index, "ab")


def test_position_limit(spark):
    with pytest.raises(Exception, match="can't be indexed"):
        build(spark, ["a" * ((1 << 24) + 3)])


def test_empty_and_de_bruijn(spark):
    index = build(spark, [])
    assert ids(search(index, "%abc%", "like", ALWAYS)) == [] and index.segments().count() == 0
    alphabet, n, seq, a = "abcdefghij", 3, [], [0] * 40

    def db(t, p):
        if t > n:
            if n % p == 0:
                seq.extend(a[1 : p + 1])
        else:
            a[t] = a[t - p]
            db(t + 1, p)
            for j in range(a[t - p] + 1, 10):
                a[t] = j
                db(t + 1, t)

    db(1, 1)
    text = "".join(alphabet[i] for i in [*seq, *seq[:2]])
    one = build(spark, [text])
    assert len(text) == 1002 and one.dictionary().where("n_occ = 1").count() == 1000
    assert ids(search(one, f"%{text[900:903]}%", "like", ALWAYS)) == [1]


def test_stream(spark, tmp_path):
    df = spark.createDataFrame([(i, f"thimble {i}") for i in range(20)], TEXT)
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    index = TextIndex.build(df, "id", "text", workspace(spark, "t"), df.limit(0))
    ingest(index, spark.readStream.schema(TEXT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), str(tmp_path / "at"), seal=True).awaitTermination()
    assert len(ids(search(index, "%thimble%", "like", ALWAYS))) == 20


CONTEXT = [
    ("red\nthimble now\nblue\nthimble then\ngrey", "thimble", 1, True, [(2, "red\n<mark>thimble</mark> now\nblue"), (4, "blue\n<mark>thimble</mark> then\ngrey")]),
    ("One\nThimble on top\nEnd", "thimble", 0, False, [(2, "<mark>Thimble</mark> on top")]),
    ("row a\nmatch it\nrow c", "match", -5, True, [(2, "<mark>match</mark> it")]),
    ("alpha\nbeta\ngamma", "thimble", 2, True, []),
    ("\n\nhit", "hit", 2, True, [(3, "<mark>hit</mark>")]),
    ("ab\rcd\nx", "ab.cd", 0, True, [(1, "<mark>ab\rcd</mark>")]),
    ("é É", "é", 0, False, [(1, "<mark>é</mark> <mark>É</mark>")]),
    ("hit\n", "^$", 1, True, [(2, "hit\n<mark></mark>")]),
    ("hit hit\nhit", "hit", 1, True, [(1, "<mark>hit</mark> <mark>hit</mark>\nhit"), (2, "hit hit\n<mark>hit</mark>")]),
    (None, "a", 1, True, []),
]


@pytest.mark.parametrize(("text", "pattern", "lines", "sensitive", "want"), CONTEXT)
def test_context(spark, text, pattern, lines, sensitive, want):
    df = spark.createDataFrame([(1, text)], TEXT)
    assert [tuple(r) for r in extract_context(df, "text", pattern, lines, sensitive).collect()] == want


def test_context_rejects(spark):
    df = spark.createDataFrame([(1, "a")], TEXT)
    assert extract_context(df, "text", r"\(?=x|[(?=]|\\1", 1, True).count() == 0
    for bad in ("(?=a)", r"(a)\1", r"\\(?<!a)"):
        with pytest.raises(ValueError):
            extract_context(df, "text", bad, 1, True)
    with pytest.raises(Exception):  # noqa: B017
        extract_context(df, "text", "(", 1, True).collect()


SF = "/root/testdata/sf0.001"


def test_every_query_agrees_with_its_sql(spark):
    from trawl.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    plain = lambda r: tuple(float(x) if isinstance(x, int) and not isinstance(x, bool) else x for x in r)
    for name, query in QUERIES.items():
        got = query(spark, SF)
        rows = got.collect()
        if name in ORACLE_SQL:
            want = con.execute(ORACLE_SQL[name])
            columns = [c[0] for c in want.description]
            assert sorted(columns) == sorted(got.columns), name
            assert sorted((plain(r) for r in want.fetchall()), key=str) == sorted((plain(r[c] for c in columns) for r in rows), key=str), name


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_phrases_tell_ascii_from_characters_of_the_same_code(spark):
    index = build(spark, ["tñbc", "é thbc"])
    assert sorted(map(tuple, phrase_positions(index, "thbc").collect())) == [(2, 3)]
