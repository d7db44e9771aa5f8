"""The pipeline's stages, run one after the other, against what each must do to its own input."""

import itertools
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from trawl.llm import decontam, queries
from trawl.llm.cluster import new_path

SF = "/root/testdata/sf0.01"  # 87 labels of sf0.001 are too few to learn from


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        path = new_path(spark, "s")
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_all_but_the_last_keep_the_columns(stages):
    for df in stages[:-1]:
        assert df.columns == stages[0].columns


def test_quality_agrees_with_labels(stages, spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = stages[1].select("doc_id")
    bad = labels.where("quality = 0").join(kept, "doc_id", "left_semi").count()
    lost = labels.where("quality = 1").join(kept, "doc_id", "left_anti").count()
    assert bad + lost <= 0.05 * labels.count()


def test_no_copies_are_left(stages):
    texts = [r.text for r in stages[2].collect()]
    assert len(texts) == len(set(texts))
    assert {r.text for r in stages[1].collect()} >= set(texts)


def test_near_copies_against_brute_force(stages):
    """Of all pairs of the stage's input by five-word shingles: what stays is the least id of each group of similarity 0.8, but for one pair in ten at most."""
    rows = [(r.doc_id, {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}) for r in stages[1].collect() for w in [lowered(r.text)]]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [(a, b) for (a, x), (b, y) in itertools.combinations(rows, 2) if 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 5 * len(x & y) >= 4 * len(x | y)]
    for a, b in links:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    want, got = {i for i in parent if root(i) == i}, {r.doc_id for r in stages[2].collect()}
    assert len(links) > 50 and want <= got  # nothing goes without a link
    assert len(got - want) <= 0.1 * len(parent.keys() - want)


def lowered(text):
    return (text or "").encode().lower().split()


def test_mix_takes_what_sql_takes(stages, spark):
    con = duckdb.connect()
    con.register("documents", stages[3].toPandas())
    taken = con.execute(queries.ORACLE_SQL["op8_mixing"]).df()
    want = {int(r.doc_id): int(r.taken // r.size) for r in taken.itertuples() if r.size and r.taken}
    got = Counter(r.doc_id for r in stages[4].collect() if lowered(r.text))
    assert got == want


def test_ids_are_the_librarys(stages):
    tokenizer = Tokenizer.from_file(queries.tokenizer_file())
    want = Counter()
    for r in stages[4].collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]
        want[r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in stages[5].collect()) == want


def test_no_passages_are_left(stages, spark):
    bench = [decontam.normal(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = stages[2].collect(), stages[3].collect()
    assert not any(b in decontam.normal(r.text) for r in after for b in bench)
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert {r.doc_id for r in before if any(b in decontam.normal(r.text) for b in bench)} <= gone


def test_mix_repeats_documents_as_they_are(stages):
    before, after = stages[3].collect(), stages[4].collect()
    assert set(after) <= set(before) and all(after.count(r) <= 3 for r in set(after))


def test_ids_of_all_that_is_left(stages):
    rows = stages[5].orderBy("start").collect()
    assert len(rows) == stages[4].count()
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:], strict=False))


def test_run_returns_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, stages[5].collect()))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_agree_with_sql(spark, name):
    got = queries.QUERIES[name](spark, SF)
    rows = got.collect()
    assert rows and len(got.columns) == len(set(got.columns))
    if name in queries.ORACLE_SQL:
        con = duckdb.connect()
        for t in ("documents", "embeddings", "pages"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        want = con.execute(queries.ORACLE_SQL[name])
        columns = [c[0] for c in want.description]
        assert sorted(columns) == sorted(got.columns)
        key = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
        assert sorted((key(r) for r in want.fetchall()), key=str) == sorted((key(r[c] for c in columns) for r in rows), key=str)


