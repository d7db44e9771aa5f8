"""A table with nulls, empty, long, tied and repeated rows, and columns whose names operators use inside."""

from __future__ import annotations

import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, shard int, _id bigint, size string, component_id int, row bigint"


def words(rng: random.Random, n: int, size: int = 400) -> str:
    return " ".join(rng.choice(["alpha", "beta", "the", "of", "gamma", "Delta,", "épsilon", "zeta.\nEta"]) + str(rng.randrange(size)) for _ in range(n))


def odd_rows(seed: int = 7) -> list[tuple]:
    rng = random.Random(seed)
    texts = [words(rng, rng.randrange(5, 80)) for _ in range(30)]
    texts += [None, "", "   ", "\n\n", "one", "two words", texts[3], texts[3], texts[4] + " tail", "日本語 テキスト  x", "a" * 5000, words(rng, 9000), "<|endoftext|> \x1c x", "ＡＢＣ abc ABC"]
    rows = [(i, t, "en", rng.choice(["s1", "s2", None, "É"]), len(t or ""), 1, 2, "x", 3, 4) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, "no id", "en", "s1", 5, 1, 2, "x", 3, 4), (None, None, None, None, None, None, None, None, None, None), (900, texts[5], "en", "s9", 1, 1, 2, "x", 3, 4)]
    return rows


def frame(spark, rows, parts: int = 3):
    return spark.createDataFrame(rows, DOCS).repartition(parts)
