import itertools
import random

import numpy as np
import xxhash

from tests.llm.helpers import frame, odd_rows, words
from trawl.llm import simhash
from trawl.llm.components import components


def fingerprint(text, width=3, seed=42):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    shingles = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_fingerprints():
    texts = [r[1] for r in odd_rows()] + ["ÀÉ a b c\x1cd", "X y Z"]
    assert simhash.fingerprints(texts, 3, 42)[:, 0].tolist() == [fingerprint(t) for t in texts]
    assert fingerprint(None) == 0


def test_every_pair_shares_a_key():
    for radius, spare in itertools.product((1, 2, 3), (2, 4)):
        masks = simhash.part_masks(radius, spare)
        for flipped in itertools.combinations(range(0, 64, 5), radius):
            assert any(not any(m >> b & 1 for b in flipped) for m in masks)


def test_bit_sliced_links_are_all_links():
    rng = random.Random(5)
    for _ in range(10):
        values, buckets = [], []
        for b in range(rng.randrange(1, 40)):
            centre = rng.getrandbits(64)
            for _ in range(rng.choice([1, 2, 3, 70, 130]) if b < 3 else rng.randrange(1, 5)):
                values.append(centre ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(0, 5))))
                buckets.append(b)
        v = np.array(values, np.uint64)
        for radius in (0, 1, 2, 3, 5):
            got = {(int(i), int(j)) for a, b in simhash.links_in_buckets(np.array(buckets), v, radius) for i, j in zip(a, b, strict=True)}
            want = {(i, j) for i, j in itertools.combinations(range(len(values)), 2) if buckets[i] == buckets[j] and (values[i] ^ values[j]).bit_count() <= radius}
            assert got == want


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 180)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(90)] + [(5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    want = classes({n for e in edges if e[0] != e[1] for n in e}, edges)
    assert got == want
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def near_rows():
    rows, rng = odd_rows(), random.Random(11)
    base = [words(rng, 300) for _ in range(6)]
    for k in range(60):
        w = rng.choice(base).split(" ")
        for _ in range(rng.randrange(0, 3)):
            w[rng.randrange(len(w))] = "edit"
        rows.append((1000 + k, " ".join(w), "en", "s1", 1, 1, 2, "x", 3, 4))
    return rows


def test_near_duplicates_against_brute_force(spark):
    rows = near_rows()
    got = sorted(map(tuple, simhash.near_duplicates(frame(spark, rows)).select("doc_id", "fingerprint", "component_id").collect()), key=str)
    prints = [fingerprint(r[1]) for r in rows]
    distinct = sorted(set(prints))
    root = classes(distinct, [(a, b) for a, b in itertools.combinations(distinct, 2) if (a ^ b).bit_count() <= 2])
    least = {}
    for r, p in zip(rows, prints, strict=True):
        if r[0] is not None:
            least[root[p]] = min(least.get(root[p], r[0]), r[0])
    assert got == sorted(((r[0], f"{p:016x}", least.get(root[p])) for r, p in zip(rows, prints, strict=True)), key=str)
    assert len(least) < len(rows)


def test_representatives(spark):
    rows = near_rows()
    docs = frame(spark, rows)
    kept = simhash.keep_representatives(docs, radius=2, width=3, many=1, spare=4)
    assert kept.columns == docs.columns
    groups = simhash.near_duplicates(docs)
    want = {r.doc_id for r in groups.collect() if r.doc_id is not None and r.doc_id == r.component_id}
    got = [r.doc_id for r in kept.collect()]
    assert {i for i in got if i is not None} == want and len([i for i in got if i is not None]) == len(want)
    assert got.count(None) == 2
    assert simhash.keep_representatives(frame(spark, [])).count() == 0


def test_many_fingerprints_against_brute_force(spark):
    rows = [(i, *r[1:]) for i, r in enumerate(near_rows())]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(frame(spark, rows), radius=3, width=5, many=3, spare=2).collect()}
    prints = simhash.fingerprints([r[1] for r in rows], 5, 42, 3).tolist()
    links = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if any((a ^ b).bit_count() <= 3 for a, b in zip(prints[i], prints[j], strict=True))]
    assert got == classes(range(len(rows)), links)
    one = simhash.near_duplicates(frame(spark, rows), radius=3, width=5, many=1)
    assert one.select("component_id").distinct().count() >= len(set(got.values()))


def similarity(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} for w in (a.lower().split(), b.lower().split()))
    return len(a & b) / len(a | b)


def edited(rng, text, gaps):
    w = text.split()
    for at in gaps:
        w[at] = "edit" + str(rng.randrange(10**6))
    return " ".join(w)


def test_representatives_are_cut_at_a_similarity(spark):
    rng, rows = random.Random(3), []
    for k in range(40):
        text = " ".join("w" + str(rng.randrange(10**5)) for _ in range(200))
        rows += [(10 * k, text), (10 * k + 1, edited(rng, text, range(9, 40, 10))), (10 * k + 2, edited(rng, text, range(9, 90, 10)))]
    texts = dict(rows)
    assert all(similarity(texts[10 * k], texts[10 * k + 1]) >= 0.8 > 0.65 > similarity(texts[10 * k], texts[10 * k + 2]) > 0.5 for k in range(40))
    links = [(a, b) for a, b in itertools.combinations(texts, 2) if a // 10 == b // 10 and similarity(texts[a], texts[b]) >= 0.8]
    want = {i for i, root in classes(texts, links).items() if i == root}
    got = simhash.keep_representatives(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(r.doc_id for r in got.collect()) == sorted(want)


def test_similar_in_block_against_brute_force():
    rng = np.random.default_rng(8)
    for _ in range(40):
        sets = [np.unique(rng.integers(0, 14, rng.integers(0, 12), np.uint64)) for _ in range(rng.integers(0, 14))]
        for left in {len(sets), len(sets) // 2}:
            alike = lambda a, b: len(a) and len(b) and len(np.intersect1d(a, b)) >= 0.6 * len(np.union1d(a, b))
            pairs = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if (left == len(sets) or i < left <= j) and alike(sets[i], sets[j])]
            got = simhash.similar_in_block(sets, left, 0.6)
            assert set(got) <= set(pairs) and classes(range(len(sets)), got) == classes(range(len(sets)), pairs)


def test_large_components_are_compared_in_blocks(spark):
    rng = random.Random(12)
    text = " ".join("w" + str(rng.randrange(10**5)) for _ in range(150))
    rows = [(i, edited(rng, text, rng.sample(range(150), rng.randrange(0, 6)))) for i in range(90)]
    links = [(a, b) for a, b in itertools.combinations(range(90), 2) if similarity(rows[a][1], rows[b][1]) >= 0.8]
    want = [i for i, root in classes(range(90), links).items() if i == root]
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], "doc_id bigint, text string, _row int, _node int, _gone int, _nth int")
    for block in (512, 10):
        got = simhash.keep_representatives(docs, block=block)
        assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == want


def test_rows_with_equal_ids_are_separate(spark):
    rng = random.Random(4)
    one, *others = (" ".join("w" + str(rng.randrange(10**5)) for _ in range(60)) for _ in range(9))
    rows = [(3, one), (7, one + " end"), *((7, t) for t in others), (7, others[0])]
    got = simhash.keep_representatives(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(map(tuple, got.collect())) == sorted([(3, one), *((7, t) for t in others)])


def test_texts_are_read_for_ties_only_where_there_are_ties(spark, monkeypatch):
    rng = random.Random(8)
    text = [" ".join(rng.choice("abcdefghij") + str(rng.randrange(50)) for _ in range(60)) for _ in range(3)]
    plans = []
    staged = simhash.staged
    monkeypatch.setattr(simhash, "staged", lambda df, name, **how: [plans.append(df._jdf.queryExecution().optimizedPlan().toString()) if name == "gone" else None, staged(df, name, **how)][1])
    for least, read in ((4, False), (3, True)):  # the least id once, and twice, with the texts a and b
        rows = [(3, text[0] + " b"), (least, text[0] + " a"), (5, text[0]), (6, text[1]), (7, text[2])]
        got = simhash.keep_representatives(spark.createDataFrame(rows, "doc_id bigint, text string"))
        assert sorted(map(tuple, got.collect())) == [(3, text[0] + (" a" if read else " b")), (6, text[1]), (7, text[2])]
        assert ("_text" in plans.pop()) == read
