import math
import random

import numpy as np
import pytest

from tests.llm.helpers import DOCS, frame, odd_rows
from pyspark.sql import functions as F
from trawl.llm import maxscore, mixing

VECTORS = "vec_id bigint, embedding array<float>, label int, shard int, q_ids string, score bigint"


def brute(rows, is_query, k=5):
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i in sorted({i for i, _ in usable if is_query(i)}):
        q = min(v for _, v in [(0, v) for j, v in usable if j == i])
        scored = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in usable if j != i and len(v) == len(q))[:k]
        out += [(i, n, j, -s) for n, (s, j) in enumerate(scored, 1)]
    return out


def vectors(seed, n, dims=16):
    rng = random.Random(seed)
    f32 = lambda x: float(np.float32(x))
    rows = [(i, [f32(rng.gauss(0, 1)) for _ in range(dims)], 0, 1, "q", 2) for i in range(n)]
    rows += [(n + i, rows[7][1], 0, 1, "q", 2) for i in range(12)]  # ties
    rows += [(None, [1.0] * dims, 0, 1, "q", 2), (5000, None, 0, 1, "q", 2), (5001, [1.0, None] * (dims // 2), 0, 1, "q", 2), (5050, [math.inf] * dims, 0, 1, "q", 2), (5100, [math.nan] * dims, 0, 1, "q", 2), (5150, [], 0, 1, "q", 2), (5151, [], 0, 1, "q", 2), (5200, [1.0, 2.0], 0, 1, "q", 2), (5201, [3.0, -2.0], 0, 1, "q", 2)]
    return [*rows, rows[3]]


def test_terms_are_split_by_their_bounds():
    rng = np.random.default_rng(4)
    candidates = np.floor(rng.normal(0, 50, (600, 24)) * np.where(np.arange(24) < 4, 8, 1))
    ids, query = np.arange(600), np.floor(rng.normal(0, 50, 24))
    visited = []
    got = maxscore.top_k(candidates, ids, query, 3, 5, block=100, visited=visited)
    scores = candidates @ query
    assert got == [(int(scores[i]), int(i)) for i in sorted(set(range(600)) - {3}, key=lambda i: (-scores[i], i))[:5]]
    split, traversed, probed = zip(*visited[1:], strict=True)
    assert visited[0][0] == 24 and all(0 <= s < 24 for s in split) and all(t == s * 100 for s, t in zip(split, traversed, strict=True))
    assert sum(traversed) + sum(probed) < 500 * 24 / 2
    assert maxscore.top_k(candidates, ids, query, 3, 5, floor=got[4][0]) == got
    assert maxscore.essential(np.array([9.0, 3.0, 1.0]), 4.0)[0] == 2 and maxscore.essential(np.array([9.0, 3.0, 1.0]), -np.inf)[0] == 3


def test_mix_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(i, "a b c", f"s{i % 2}", 1, 2, 3) for i in range(20)], "doc_id bigint, text string, source string, _mix_target int, _mix_copy int, r int")
    got = mixing.mix(df)
    assert got.columns == df.columns and {tuple(r)[3:] for r in got.collect()} == {(1, 2, 3)}


@pytest.mark.parametrize(("shard", "block"), [(4096, 256), (40, 3)])
def test_top_k_against_brute_force(spark, shard, block):
    rows = vectors(1, 300)
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    got = sorted(map(tuple, maxscore.search(df, F.col("vec_id") % 50 == 0, shard=shard, block=block).collect()))
    assert got == brute(rows, lambda i: i % 50 == 0)


def test_queries_are_never_broadcast(spark, monkeypatch):
    rows = vectors(2, 300)
    monkeypatch.setattr(maxscore, "GROUP_BYTES", 256)
    found = maxscore.search(spark.createDataFrame(rows, VECTORS).repartition(5), F.col("vec_id") % 50 == 0, shard=20, block=2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Broadcast" not in plan
    assert sorted(map(tuple, found.collect())) == brute(rows, lambda i: i % 50 == 0)


def test_pruning_loses_nothing():
    rng = np.random.default_rng(4)
    for scale in (3, 400, 2**40):
        c = np.floor(rng.normal(0, scale, (3000, 24)))
        q = np.floor(rng.normal(0, scale, 24) * (rng.random(24) < 0.4))
        ids = rng.permutation(3000)
        got = maxscore.top_k(c, ids, q, int(ids[0]), 5, block=256)
        s = [max(-(1 << 63), min((1 << 63) - 1, sum(int(a) * int(b) for a, b in zip(r, q, strict=True)))) for r in c]
        assert got == sorted(((x, int(i)) for x, i in zip(s, ids, strict=True) if i != ids[0]), key=lambda x: (-x[0], x[1]))[:5]


def test_no_vectors(spark):
    assert maxscore.search(spark.createDataFrame([], VECTORS), F.col("vec_id") % 50 == 0).count() == 0


def filled(sizes, weights, most=3):
    """Targets by rounds: shares of what is left by weight, those above their limit held at it."""
    target, open_, left = {}, dict(sizes), sum(sizes.values())
    while open_:
        w = sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] / w > most * sizes[s]}
        if not over:
            target |= {s: left * weights[s] / w for s in open_}
            break
        for s in over:
            target[s] = float(most * sizes[s])
            left -= most * open_.pop(s)
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets_against_rounds(spark, seed):
    rng = random.Random(seed)
    names = [f"s{i:02}" for i in range(12)] + ["É", None]
    rows = [(s, rng.choice([0, 1, 5, 1000, rng.randrange(5000)])) for s in names for _ in range(rng.randrange(1, 4))]
    sizes = {s: sum(n for t, n in rows if t == s) for s in names}
    weights = {s: float((5, 2, 1)[i % 3]) for i, s in enumerate(names)}
    got = {r.source: r for r in mixing.source_targets(spark.createDataFrame(rows, "source string, size bigint")).collect()}
    want = filled(sizes, weights)
    for s in names:
        assert got[s].source_size == sizes[s] and got[s].target == pytest.approx(want[s])
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))


def test_mix_and_digest_agree(spark):
    rows = odd_rows()
    docs = frame(spark, rows)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    digest = mixing.taken(docs).collect()
    assert len(digest) == len(rows)
    size = lambda t: len([w for w in __import__("re").split(r"[\x20\x09-\x0D]+", t or "") if w])
    assert sorted(r["size"] for r in digest) == sorted(size(r[1]) for r in rows)
    assert all(r.taken <= 3 * r["size"] for r in digest)
    assert sum(size(r.text) for r in mixed.collect()) == sum(r.taken for r in digest)
    again = mixing.taken(frame(spark, rows, 7)).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, digest), key=str)


def test_mix_comes_near_targets(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randrange(1, 60), "en", rng.choice(["a", "a", "a", "b", "c", "d"]), 1, 1, 1, "x", 1, 1) for i in range(6000)]
    by_source = {}
    for d, r in zip(sorted(mixing.taken(spark.createDataFrame(rows, DOCS)).collect()), rows, strict=True):
        t = by_source.setdefault(r[3], [0, d.target])
        t[0] += d.taken
    assert all(abs(n - target) < 0.05 * target for n, target in by_source.values())


def test_nothing_to_mix(spark):
    assert mixing.taken(frame(spark, [])).count() == 0 and mixing.mix(frame(spark, [])).count() == 0
    empty = [(i, None, "en", "s", 0, 1, 1, "x", 1, 1) for i in range(3)]
    assert [r.taken for r in mixing.taken(frame(spark, empty)).collect()] == [0, 0, 0]
