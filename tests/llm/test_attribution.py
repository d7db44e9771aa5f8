import numpy as np
import pytest

from tests.llm.helpers import frame, odd_rows
from trawl.llm import attribution
from trawl.llm.queries import tokenizer_file


def brute(text, rule):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file())
    t.encode_special_tokens = True
    letters = t.get_vocab()
    size = {i: len(token) for token, i in letters.items()}
    raw = (text or "").encode()
    lines = [x + b"\n" for x in raw.split(b"\n")]
    lines[-1] = lines[-1][:-1]
    if len(lines) > 1 and not lines[-1]:
        lines.pop()
    owner = [k for k, line in enumerate(lines) for _ in line]
    counts, at = [0.0] * len(lines), 0
    for i in t.encode(text or "", add_special_tokens=False).ids:
        own = owner[at : at + size[i]]
        if rule == "start":
            counts[own[0]] += 1
        elif rule == "most":
            counts[max(sorted(set(own)), key=own.count)] += 1
        else:
            for k in own:
                counts[k] += 1 / len(own)
        at += size[i]
    return counts


@pytest.mark.parametrize("rule", attribution.RULES)
def test_sections_against_brute_force(spark, rule):
    rows = [r for r in odd_rows() if r[0] is not None and len(r[1] or "") < 3000]
    rows = list({r[0]: r for r in rows}.values()) + [(7000 + i, t, "en", "s", 1, 1, 1, "x", 1, 1) for i, t in enumerate(["a\n\n\n\nb\n", "\n\n  \n x", "end\n", "    \n    \n\t\n", "日本\n語", "x\r\n\r\ny"])]
    got = {}
    for r in attribution.section_tokens(frame(spark, rows), tokenizer_file(), rule).orderBy("doc_id", "section").collect():
        got.setdefault(r.doc_id, []).append(r)
    assert set(got) == {r[0] for r in rows}
    for r in rows:
        own = got[r[0]]
        assert np.allclose([x.n_tokens for x in own], brute(r[1], rule)), (r[1], rule)
        assert sum(x.n_tokens for x in own) == pytest.approx(own[0].doc_tokens)
        assert own[0].first_byte == 0 and own[-1].end_byte == len((r[1] or "").encode())


def test_crossing_tokens_are_counted():
    starts, ends = np.array([0, 2, 6]), np.array([2, 6, 7])
    for rule, want in (("start", [2, 0, 1]), ("most", [1, 1, 1]), ("split", [1.25, 0.5, 1.25])):
        counts, entered = attribution.attribute(starts, ends, np.array([0, 3, 5]), 7, rule)
        assert counts.tolist() == want and entered.tolist() == [0, 1, 1], rule


def test_empty_table_and_wrong_rule(spark):
    assert attribution.section_tokens(frame(spark, []), tokenizer_file()).count() == 0
    with pytest.raises(ValueError):
        attribution.section_tokens(frame(spark, []), tokenizer_file(), "none")
