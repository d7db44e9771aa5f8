import math
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.helpers import frame, odd_rows, words
from trawl.llm import ngram
from trawl.llm.suffixes import Shard


def brute_matches(docs, query):
    texts, q = [[1, *d, 2] for d in docs], [1, *query, 2]
    out = []
    for j in range(1, len(q) + 1):
        best = (0, sum(map(len, texts)))
        for m in range(1, j + 1):
            context = q[j - m : j]
            c = sum(t[p - m : p] == context for t in texts for p in range(m, len(t) + 1))
            if not c:
                break
            best = (m, c)
        out.append(best)
    return out


def test_longest_matches_against_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        kinds = rng.choice([3, 8, 50])
        docs = [[rng.randrange(10, 10 + kinds) for _ in range(rng.randrange(0, 30))] for _ in range(rng.randrange(1, 7))]
        docs += [docs[0] + docs[-1]] * rng.randrange(0, 3)
        shard = Shard([np.array(d, np.uint64) for d in docs])
        queries = [[rng.randrange(10, 12 + kinds) for _ in range(rng.randrange(0, 20))], docs[0], docs[0][:5] + docs[-1], []]
        for q, (lengths, counts) in zip(queries, shard.longest_of([np.array(q, np.uint64) for q in queries]), strict=True):
            assert list(zip(lengths.tolist(), counts.tolist(), strict=True)) == brute_matches(docs, q)


def tokens(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        t = t.replace(c, " ")
    return [w for w in t.split(" ") if w]


def brute_scores(rows):
    """By substring search in all training texts, a character for each word."""
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    known = {}
    start, end = "\x01", "\x02"
    coded = lambda t: "".join(known.setdefault(w, chr(0x10000 + len(known))) for w in tokens(t))
    texts = [start + coded(r[1]) + end for r in rows]
    train = [t for r, t in zip(rows, texts, strict=True) if not held(r[0])]
    corpus = "".join(train)
    counts = Counter(corpus)
    counts.pop(start, None)
    n, v = sum(counts.values()), len(counts)

    def times(context):
        at, c = corpus.find(context), 0
        while at >= 0:
            c, at = c + 1, corpus.find(context, at + 1)
        return c

    out, done = [], {}
    for r, q in zip(rows, texts, strict=True):
        if q not in done:
            base = score = 0.0
            m = 0
            for j in range(1, len(q)):
                p = (counts[q[j]] + 1) / (n + v + 1)
                base += math.log10(p)
                m += 1
                while m and q[j - m : j] not in corpus:
                    m -= 1
                c, after = (times(q[j - m : j]), times(q[j - m : j + 1])) if m else (n, counts[q[j]])
                mu = 0.05 + 1000 / max(m, 1) ** 3
                score += math.log10((after + mu * p) / (c + mu))
            done[q] = (len(q) - 1, sum(counts[w] > 0 for w in q[1:]), n, pytest.approx(base, rel=1e-9), pytest.approx(score, rel=1e-9))
        out.append((r[0], held(r[0]), *done[q]))
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0, r[2], r[3]))


def agree(spark, rows, **how):
    got, want = ordered(ngram.scores(frame(spark, rows), **how).collect()), ordered(brute_scores(rows))
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == b, (a, b)


def row(i, text):
    return (i, text, "en", "s", 1, 1, 2, "x", 3, 4)


@pytest.mark.parametrize("how", [{}, {"shard_bytes": 4000, "batch_words": 200, "short": 4}, {"shard_bytes": 4000, "batch_words": 900, "short": 6, "alike_bytes": 600}])
def test_scores_against_brute_force(spark, how):
    """Null, empty, long and repeated texts, null and repeated ids, passages that many documents share, documents that begin alike."""
    rng = random.Random(5)
    rows = odd_rows() + [row(1000 + i, words(rng, 30, 5)) for i in range(20)]
    passage = words(rng, 60)
    rows += [row(1100 + i, f"{words(rng, 9)} {passage} {words(rng, rng.randrange(9))}") for i in range(25)]
    alike = words(rng, 90).split(" ")
    rows += [row(1200 + i, " ".join(alike[: rng.choice([7, 8, 9, 63, 64, 65, 90])] + words(rng, 3).split(" "))) for i in range(40)]
    rows += [row(2000 + i, rng.choice(rows)[1]) for i in range(25)]
    longest = max((r[1] or "" for r in rows), key=len)
    rows += [row(3000 + i, longest[: 900 * i] + " cut " + longest[900 * i :]) for i in range(3)]
    agree(spark, rows, **how)


def test_documents_that_extend_one_another(spark):
    rng = random.Random(6)
    whole = words(rng, 160, 9).split(" ")
    agree(spark, [row(i, " ".join(whole[:i])) for i in range(160)], shard_bytes=20000, batch_words=3000)


def test_frequent_counts_are_packed_whole():
    for values in ([], [0], [1, 2**32 - 1], [5, 2**40, 0]):
        assert ngram.unsqueezed(ngram.squeezed(np.array(values, np.int64))).tolist() == values
    keys = np.sort(np.random.default_rng(1).integers(0, 2**64, 1000, np.uint64))
    assert (ngram.unsqueezed_keys(ngram.squeezed_keys(keys)) == keys).all()


def test_ids_are_odd_or_nobody_trains(spark):
    assert ngram.scores(frame(spark, [])).count() == 0
    got = ngram.scores(frame(spark, odd_rows())).collect()
    assert len(got) == len(odd_rows()) and all(math.isfinite(r.score) and r.score <= 0 for r in got)
    alone = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = ngram.scores(frame(spark, [(alone, "a b c", "en", "s", 1, 1, 2, "x", 3, 4)])).collect()[0]
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (True, 4, 0, 0, 0.0)


def test_probabilities_sum_to_one():
    docs = [[5, 6, 7], [5, 6, 8], [6, 7]]
    counts = Counter([w for d in docs for w in d] + [2] * 3)
    n, v = sum(counts.values()), len(counts)
    grams = Counter(tuple(t[a:b]) for t in ([1, *d, 2] for d in docs) for b in range(len(t) + 1) for a in range(b))
    for context in ((), (1,), (5,), (5, 6), (1, 5, 6), (6, 7)):
        mu = float(ngram.smoothing(np.array([len(context)]))[0])
        c = grams[context] if context else n
        total = sum((grams[(*context, w)] + mu * (counts[w] + 1) / (n + v + 1)) / (c + mu) for w in [*counts, 99])
        assert total == pytest.approx(1.0)


def batch(number, held, docs):
    """A Batch of documents of word numbers."""
    words, places = np.unique(np.concatenate(docs), return_inverse=True)
    row = {"batch": number, "held": held, "doc_ids": list(range(len(docs))), "sizes": [len(d) for d in docs], "depths": [8] * len(docs), "words": (words.astype("<u8") + 10).tobytes(), "places": ngram.squeezed(places)}
    return ngram.Batch(pa.RecordBatch.from_pylist([row], ngram._BATCH_ROW))


def test_memory_does_not_grow_with_the_shards_that_hold_a_text(monkeypatch):
    docs = [np.random.default_rng(d).integers(0, 400, 300) for d in range(10)] * 6
    own, shards, short = batch(3 << 32, True, docs), 200, 4
    asked = own.asking(short, np.ones(len(own.tokens), bool))
    told = defaultdict(list)
    for goal, which in asked.send(shards):
        train = [(goal, (s << 32) + s % 2, ngram.TRAIN, ngram.squeezed_keys(asked.keys[which]), ngram.squeezed(np.ones(len(which), np.int64)), None) for s in range(shards) if s % 3]
        question = (goal, own.number, ngram.HELD, ngram.squeezed_keys(asked.keys[which]), None, None)
        told[ngram.HELD] += ngram.answers_of(goal, defaultdict(list, {ngram.TRAIN: train, ngram.HELD: [question]}), True)
    told[ngram.HELD] = [m for m in told[ngram.HELD] if m[2] == ngram.HELD]
    known = ngram.Known(own, shards, [])
    positions = len(known.learn(short, told).at)
    runs = []
    monkeypatch.setattr(ngram, "PAIRS", 1 << 16, raising=False)
    tracemalloc.start()
    for shard, first, end in known.stretches(asked, told):
        runs.append((shard, first.tolist(), end.tolist()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [r[0] for r in runs] == [s for s in range(shards) if s % 3] and all(r[1:] == runs[0][1:] for r in runs)
    assert sum(e - f for f, e in zip(*runs[0][1:], strict=True)) == positions
    assert peak < 8 * positions * len(runs)  # a number for each pair of a position and a shard


def test_states_are_dealt_to_all_shards():
    own = [batch(p << 32, True, [np.arange(5)]) for p in range(64)]
    assert {ngram.Known(b, 64, []).state()[0] for b in own} == set(range(64))
