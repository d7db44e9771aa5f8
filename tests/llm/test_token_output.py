import zlib

import numpy as np
import pytest

from tests.llm.helpers import frame, odd_rows
from trawl.llm import bpe, rans, token_output
from trawl.llm.cluster import new_path
from trawl.llm.queries import tokenizer_file


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file())
    t.encode_special_tokens = True
    return t


TRICKY = ["", " ", "  a", "a  ", "a \n b", "a\n  b", "it's 'tis ''s ¼ x²", "\x1c a", "a\x1c b", "日本 語　x", "a\t b", "\n\n a ", "_x__y", "naïve—dash…", "٣٤ ১২", "éa", "🦀 crab", "x y", "don't WON'T", "<|endoftext|>"]


def test_pieces_give_the_library_ids(plain):
    encoder = bpe.PieceEncoder(tokenizer_file())
    texts = TRICKY + [r[1] or "" for r in odd_rows()]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


def test_pieces_survive_an_emptied_table(plain):
    encoder = bpe.PieceEncoder(tokenizer_file(), kept=3)
    for text in [r[1] or "" for r in odd_rows()]:
        assert encoder.encode([text])[0].tolist() == plain.encode(text, add_special_tokens=False).ids


def test_other_kinds_of_tokenizer_are_whole():
    encoder = bpe.PieceEncoder(tokenizer_file("word_bpe_49k.json"))
    assert not encoder.by_piece
    assert encoder.encode(["Hello  there"])[0].tolist() == encoder.tokenizer.encode("Hello  there", add_special_tokens=False).ids
    starts, ends = encoder.spans(["Héllo there"])[0]
    assert ends[-1] == len("Héllo there".encode()) and (starts < ends).all()


@pytest.mark.parametrize("n", [0, 1, 5, 1023, 1024, 1025, 5000])
@pytest.mark.parametrize("kinds", [1, 3, 40000])
def test_blocks_round_trip(n, kinds):
    ids = np.random.default_rng(n + kinds).integers(0, kinds, n).astype("<u2")
    freq, blocks, words = token_output.pack_segment(ids, 50257)
    row = {"freq": freq, "blocks": blocks, "words": words}
    assert np.array_equal(token_output.unpack_segment(row), ids)


def test_blocks_decode_alone_and_damage_shows(monkeypatch):
    monkeypatch.setattr(rans, "BLOCK", 1000)
    monkeypatch.setattr(rans, "LANES", 16)
    ids = np.random.default_rng(1).zipf(1.3, 4321).clip(0, 50000).astype("<u2")
    freq, blocks, words = token_output.pack_segment(ids, 50257)
    assert len(blocks) == 5
    assert np.array_equal(token_output.unpack_block(freq, blocks[3], words), ids[3000:4000])
    with pytest.raises(ValueError):
        token_output.unpack_block(freq, blocks[3] | {"crc32": blocks[3]["crc32"] ^ 1}, words)
    spoiled = bytearray(words)
    spoiled[4 * blocks[2]["word_at"] + 5] ^= 4
    with pytest.raises(ValueError):
        token_output.unpack_block(freq, blocks[2], bytes(spoiled))


def test_frequencies_sum_and_cover():
    counts = np.zeros(300000, np.int64)
    counts[:200000] = 1
    counts[5] = 10**9
    freq = rans.frequencies(counts)
    assert freq.sum() == 1 << rans.BITS and (freq[:200000] > 0).all() and not freq[200000:].any()


def expected(rows, plain):
    at, out = 0, []
    for doc, text in sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = np.array([*plain.encode(text, add_special_tokens=False).ids, 0], "<u4")
        out.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("segment", [1 << 20, 300])
def test_digest_against_brute_force(spark, plain, segment):
    rows, path = odd_rows(), new_path(spark, "t")
    token_output.write_tokens(frame(spark, rows), "doc_id", "text", tokenizer_file(), 0, path, segment)
    segments = token_output.read_tokens(spark, path)
    found = token_output.document_digests(segments).join(token_output.segment_starts(segments), ["shard", "segment"])
    got = found.selectExpr("doc_id", "base + at", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected(rows, plain)


def test_empty_table(spark):
    assert token_output.token_digest(frame(spark, []), new_path(spark, "t"), tokenizer_file()).count() == 0


def test_added_tokens_as_the_library_has_them():
    from tokenizers import Tokenizer

    default = Tokenizer.from_file(tokenizer_file())
    encoder = bpe.PieceEncoder(tokenizer_file(), added=True)
    texts = ["a<|endoftext|>b", "<|endoftext|>", "é <|endoftext|>\n<|endoftext|> x", "no such <|endoftext|", *TRICKY]
    assert encoder.encode(texts[:1])[0].tolist() == [64, 50256, 65]
    for text, ids, (starts, ends) in zip(texts, encoder.encode(texts), encoder.spans(texts), strict=True):
        assert ids.tolist() == default.encode(text, add_special_tokens=False).ids, repr(text)
        assert not text or starts[0] == 0 and ends[-1] == len(text.encode())
