import pytest
from pyspark.sql import functions as F

from trawl.functions import trigram as T


def test_windows_and_positions():
    codes, pos, _ = T.occurrences("abcdefgh")
    assert codes.tolist() == [T.code_of(x) for x in ("abc", "bcd", "cde", "def", "efg", "fgh")] and pos.tolist() == list(range(6))
    codes, pos, _ = T.occurrences("aβγδ")
    assert codes.tolist() == [T.code_of("aβγ"), T.code_of("βγδ")] and pos.tolist() == [0, 1]
    assert len(T.occurrences("")[0]) == len(T.occurrences("a")[0]) == 0
    assert T.occurrences("a🦀bcd")[1].tolist() == [0, 1, 5]


@pytest.mark.parametrize(("text", "flags"), [("abc", 0), ("Abc", 1), ("aBc", 2), ("abC", 4), ("ABC", 7)])
def test_flags(text, flags):
    codes, _, found = T.occurrences(text)
    assert codes[0] == 0x636261 and found[0] == flags


def test_vector_with_other_letters():
    codes, _, flags = T.occurrences("aβΒ")
    assert (int(flags[0]) << 24 | int(codes[0])) == 0x849F9F61


def test_zero_characters_make_no_trigram():
    assert T.occurrences("ab\0cde")[0].tolist() == [T.code_of("cde")]
    for bad in ("abcd", "ab", "a\0b"):
        with pytest.raises(ValueError):
            T.code_of(bad)


def test_columns(spark):
    df = spark.createDataFrame([("abc",), ("ABC",), ("aβΒ",), ("🦀ab",), (None,)], "t string")
    got = [tuple(r) for r in df.select(T.text_to_trigram(F.col("t")), T.trigram_to_text(T.text_to_trigram(F.col("t")))).collect()]
    assert got[:2] == [(6513249, "abc")] * 2 and got[2] == (0x9F9F61, "a��") and got[3][0] == T.code_of("🦀ab") and got[4] == (None, None)
    for bad in ("abcd", "", "a\0b"):
        with pytest.raises(Exception, match="not a trigram"):
            spark.createDataFrame([(bad,)], "t string").select(T.text_to_trigram(F.col("t"))).collect()
    for bad in (-1, 1 << 32, 0x616200):
        with pytest.raises(Exception, match="not a trigram"):
            spark.createDataFrame([(bad,)], "c bigint").select(T.trigram_to_text(F.col("c"))).collect()
    assert spark.createDataFrame([(0x87636261,)], "c bigint").select(T.trigram_to_text(F.col("c"))).first()[0] == "abc"


def test_extraction_column(spark):
    texts = ["Abcd", "a\nb\nc", "é🦀b c", "ab", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(T.trigrams(F.col("t"))).collect()]
    assert got == [None if t is None else [t.lower()[i : i + 3] for i in range(len(t) - 2)] for t in texts]


def test_postings(spark):
    df = spark.createDataFrame([(1, "abcabc"), (2, None), (3, "ab"), (None, "abc"), (4, "xABC")], "id bigint, text string")
    got = {(r.trigram, r.doc_key): [tuple(o) for o in r.occ] for r in T.postings(df, "id", "text").collect()}
    assert got[T.code_of("abc"), 1] == [(0, 0), (3, 0)] and got[T.code_of("abc"), 4] == [(1, 7)]
    assert {k for _, k in got} == {1, 4}
