import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trawl.operators.search import alternatives, literal_codes
from trawl.plans import pattern as P


@pytest.mark.parametrize(("pattern", "segments"), [(r"abc%def_g\%h", ["abc", "def", "g%h"]), ("%%a__b%", ["a", "b"]), ("abcd%bcde", ["abcd", "bcde"]), ("", []), ("%", [])])
def test_like_segments(pattern, segments):
    assert P.like_segments(pattern) == segments


@pytest.mark.parametrize(("pattern", "pieces"), [("a%shadow", ["a", "shadow"]), ("%ab%%cd%", ["", "ab", "cd", ""]), (r"a\%b", ["a%b"]), ("a_%b", None), ("", [""]), ("%", ["", ""])])
def test_pieces(pattern, pieces):
    assert P.like_pieces(pattern) == pieces


def test_linear_patterns():
    assert all(map(P.is_linear, [r"\(?=x", "[(?=]", r"\\1", "(?:a)", r"[\1]"]))
    assert not any(map(P.is_linear, ["(?=a)", "(?<!a)", "(?>a)", r"(a)\1", r"\\(?!a)"]))


def test_wildcards_and_escapes():
    assert P.spark_like(r"\a\%b\\") == r"a\%b\\"
    with pytest.raises(P.PatternError):
        P.like_tokens("abc\\")


@pytest.mark.parametrize(
    ("pattern", "need"),
    [
        ("foo.*bar", ("and", (("lit", "foo"), ("lit", "bar")))),
        ("ab?c", ("and", (("lit", "a"), ("lit", "c")))),
        ("[a-z]+_end", ("lit", "_end")),
        ("ab|foobar", ("or", (("lit", "ab"), ("lit", "foobar")))),
        ("(foobar)?xy", ("lit", "xy")),
        ("(abc)*", None),
        ("(?:foobar)", ("lit", "foobar")),
        (r"a\\bcd", ("lit", "a\\bcd")),
        ("(cat|dog)fish", ("and", (("or", (("lit", "cat"), ("lit", "dog"))), ("lit", "fish")))),
        ("(cat|)fish", ("lit", "fish")),
        ("abc+d", ("and", (("lit", "abc"), ("lit", "d")))),
        ("abc{0,2}d", ("and", (("lit", "ab"), ("lit", "d")))),
        (r"\mfoo\M", ("lit", "foo")),
        ("(?=foobar)x", ("lit", "x")),
        ("(?i)abc", ("lit", "abc")),
        ("***=a.b", ("lit", "a.b")),
    ],
)
def test_needs(pattern, need):
    assert P.regex(pattern).need == need


@pytest.mark.parametrize("pattern", ["(", "a)", "[a", "a**", "*a", "{1}", "\\", r"\q", "[[:nope:]]", "a(?i)b", "(?x)a", r"\x", "a++"])
def test_errors(pattern):
    with pytest.raises(P.PatternError):
        P.regex(pattern)


def test_codes_to_look_up():
    assert alternatives(("lit", "ab"), False) is None
    assert alternatives(("or", (("lit", "ab"), ("lit", "foobar"))), False) is None
    assert alternatives(("and", (("lit", "ab"), ("lit", "abcd"))), False) == [literal_codes("abcd", False)]
    split = alternatives(("and", (("or", (("lit", "cat"), ("lit", "dog"))), ("lit", "fish"))), False)
    assert split == [literal_codes(x, False) | literal_codes("fish", False) for x in ("cat", "dog")]
    assert literal_codes("OF THE", True) == literal_codes("of the", True) and not literal_codes("sik", True) and not literal_codes("éau", True)


_ATOMS = st.sampled_from(["a", "b", "cd", ".", "[ab]", "(a|bc)", "(?:ab)", "x", r"\."])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(_ATOMS, st.sampled_from(["", "", "*", "+", "?", "{2}", "{0,1}"])), min_size=1, max_size=5), st.text("abcdx.", max_size=14))
def test_a_match_has_what_is_needed(parts, text):
    """Whatever Python's own engine matches contains the required literals."""
    pattern = "".join(a + q for a, q in parts)
    found = re.search(pattern, text, re.DOTALL)

    def holds(need):
        return need is None or (need[1] in text if need[0] == "lit" else (all if need[0] == "and" else any)(holds(x) for x in need[1]))

    if found:
        assert holds(P.regex(pattern).need)
