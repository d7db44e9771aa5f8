"""What building, sealing, merging and searching an index move, and that postings by blocks are those of each document."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from trawl.functions import trigram as T
from trawl.operators.search import Gate, search
from trawl.sources.index import TextIndex
from trawl.sources.members import near
from trawl.sources.workspace import workspace


def shuffled(spark):
    """Bytes that all stages so far have written to shuffles."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    """Texts that a shuffle hardly compresses, of few trigrams; and their bytes."""
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdefghijklmnop") for _ in range(2000)) for _ in range(1200)]
    at = str(tmp_path_factory.mktemp("moved") / "base")
    spark.createDataFrame(list(enumerate(texts)), "id bigint, text string").repartition(4).write.parquet(at)
    return at, sum(map(len, texts))


@pytest.fixture
def joined(spark):
    """No table is small enough to be broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_build_shuffles_texts_once_and_no_postings(spark, base, joined):
    at, size = base
    before = shuffled(spark)
    TextIndex.build(at, "id", "text", workspace(spark, "t"))
    assert shuffled(spark) - before < 2 * size


def test_a_seal_shuffles_its_own_texts(spark, base, joined):
    at, size = base
    docs = spark.read.parquet(at)
    index = TextIndex.build(at, "id", "text", workspace(spark, "t"), docs.where("id % 2 = 0"))
    index.append(docs.where("id % 24 = 1").select("id"))
    before = shuffled(spark)
    assert index.seal() == 50
    assert shuffled(spark) - before < size / 2


def test_a_merge_shuffles_texts_once(spark, base, joined):
    at, size = base
    docs = spark.read.parquet(at)
    index = TextIndex.build(at, "id", "text", workspace(spark, "t"), docs.where("id % 2 = 0"))
    index.append(docs.where("id % 2 = 1").select("id"))
    index.seal()
    before = shuffled(spark)
    assert index.merge(1) == 1
    assert shuffled(spark) - before < 2 * size


def test_a_probe_with_many_candidates_shuffles_no_texts(spark, base, joined):
    at, size = base
    index = TextIndex.build(at, "id", "text", workspace(spark, "t"))
    code = index.dictionary().orderBy(F.desc("df"), "trigram").first()[0]
    pattern = bytes([code & 255, code >> 8 & 255, code >> 16]).decode()
    before = shuffled(spark)
    found = search(index, f"%{pattern}%", "like", Gate(1.0, 0, fetch=0))
    assert found.select("id").count() > 0
    assert shuffled(spark) - before < size / 10


def test_near_keeps_every_key_and_few_others(spark):
    rows = spark.range(-20000, 20000).withColumnRenamed("id", "a.b")
    keys = rows.where("`a.b` % 4 = 0")
    got = {r[0] for r in near(rows, "a.b", keys.select(F.col("`a.b`").alias("k")), 10000).collect()}
    assert got >= set(range(-20000, 20000, 4)) and len(got) < 10000 + 30000 / 8
    assert near(rows, "a.b", keys.limit(0), 0).count() == 0
    few = near(rows, "a.b", keys.select(F.col("`a.b`").alias("k")), 1)  # a wrong count only lets more rows through
    assert few.where("`a.b` % 4 = 0").count() == 10000


def texts_of_all_kinds():
    rng = random.Random(7)
    letters = "abcABCé🦀 \0"
    return {k: "".join(rng.choice(letters) for _ in range(rng.randrange(0, 90))) for k in rng.sample(range(-50, 1000), 80)}


def brute(texts):
    want = defaultdict(list)
    for k, t in texts.items():
        for c, p, f in zip(*(x.tolist() for x in T.occurrences(t)), strict=True):
            want[c, k].append((p, f))
    return want


def test_blocks_hold_what_documents_have(monkeypatch):
    """Also where a trigram's postings take several rows and a block several batches."""
    texts = texts_of_all_kinds()
    held = [(k, c, p.astype(np.uint32) | f.astype(np.uint32) << np.uint32(24)) for k, t in texts.items() for c, p, f in [T.occurrences(t)] if len(c)]
    want = brute(texts)
    for row, out in ((1 << 15, 1 << 19), (5, 40), (1, 1)):
        monkeypatch.setattr(T, "ROW", row)
        monkeypatch.setattr(T, "OUT", out)
        got, order = {}, []
        for batch in T._block(list(held)):
            for r in batch.to_pylist():
                counts, occ = T._restored(r["counts"]).tolist(), T._restored(r["occ"]).tolist()
                assert r["df"] == len(r["keys"]) == len(counts) and r["n_occ"] == len(occ) == sum(counts)
                for k, n in zip(r["keys"], counts, strict=True):
                    own, at = [], 0
                    for o in occ[:n]:
                        at += o & 0xFFFFFF
                        own.append((at, o >> 24))
                    occ = occ[n:]
                    got[r["trigram"], k] = own
                    order.append((r["trigram"], k))
        assert got == want and order == sorted(want)


def test_postings_and_frequencies_from_blocks(spark):
    texts = texts_of_all_kinds()
    blocks = T.blocks(spark.createDataFrame(list(texts.items()), "id bigint, text string").repartition(3), "id", "text").cache()
    want = brute(texts)
    assert {(r.trigram, r.doc_key): [tuple(o) for o in r.occ] for r in T.expanded(blocks).collect()} == want
    plain = defaultdict(lambda: [0, 0])
    for (c, _), occ in want.items():
        if n := sum(f < 0x80 for _, f in occ):
            plain[c][0] += 1
            plain[c][1] += n
    assert {r.trigram: [r.df, r.n_occ] for r in T.ascii_frequencies(blocks).collect()} == dict(plain)
    blocks.unpersist()


def test_a_seal_of_changed_rows_shuffles_their_texts_alone(spark, base, joined):
    at, size = base
    docs = spark.read.parquet(at)
    now = [docs]
    index = TextIndex.build(lambda: now[0], "id", "text", workspace(spark, "t"))
    for k, word in enumerate(("new", "newer"), 1):
        now[0] = docs.withColumn("text", F.concat(F.lit(f"{word} "), "text"))
        index.append(docs.where("id % 24 = 1").select("id"))
        before = shuffled(spark)
        assert index.seal() == 50
        assert shuffled(spark) - before < size / 2 and len(index.manifest()["replaced"]) == k
    assert index.rows().count() == 1200 and index.rows().where("text like 'newer %'").count() == 50 and index.rows().where("text like 'new %'").count() == 0
