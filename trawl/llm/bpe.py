"""Whole-text encoding with a tokenizer file of the tokenizers library, fast for byte-level BPE.

Byte-level BPE of the GPT kind splits a text into pieces by a fixed pattern and merges bytes inside pieces only.
Most pieces of a corpus repeat: their ids are kept as packed bytes, pieces not met yet go to the library's
BPE model, and a text is joined from packed bytes. Texts with characters whose class could differ
between Unicode versions, and other kinds of tokenizer, go to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from functools import cached_property

import numpy as np

#: Characters of which Python and the tokenizer's pattern agree whether they are letters, digits or white space.
_UNSURE = re.compile(r"[^\t\n\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f\u0370-\u03ff\u0400-\u04ff\u2010-\u2027\u2030-\u205e]")
_RARE = tuple(map(chr, [*range(9), *range(11, 13), *range(14, 32), 127]))
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Pieces kept at most; beyond them the table is emptied, so that memory is bounded.
KEPT = 1_200_000
LOADED: dict[tuple[str, bool], PieceEncoder] = {}


def load(path: str, added: bool = False) -> PieceEncoder:
    """One encoder for each worker process, file and treatment of added tokens."""
    if (path, added) not in LOADED:
        LOADED[path, added] = PieceEncoder(path, added=added)
    return LOADED[path, added]


def _unsure(text: str) -> bool:
    return any(x in text for x in _RARE) if text.isascii() else _UNSURE.search(text) is not None


def _byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class PieceEncoder:
    """``encode(texts)`` gives, for each text, the ids that ``encode(text, add_special_tokens=False)`` gives.

    added: as the library does by default, special tokens that stand in a text get their own ids; else they are plain text
    (``encode_special_tokens``).
    """

    def __init__(self, path: str, kept: int = KEPT, added: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        matched = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items() if added or not t.special}
        self.added_ids = np.array(sorted(matched), np.int64)
        self.added = re.compile("|".join(map(re.escape, matched.values()))) if matched else None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.by_piece = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and spec["model"].get("type") == "BPE" and not spec["model"].get("dropout")
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocab.values()) + 1
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.packed_id = [i.to_bytes(self.dtype.itemsize, "little") for i in range(self.size)]
        self.letters = _byte_letters()
        self.model = self.tokenizer.model
        self.kept = kept
        self.pieces: dict[str, bytes] = {}

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _piece(self, piece: str) -> bytes:
        packed_id = self.packed_id
        mapped = piece.encode().decode("latin-1").translate(self.letters)
        packed = self.pieces[piece] = b"".join([packed_id[t.id] for t in self.model.tokenize(mapped)])
        return packed

    def packed(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian integers of ``self.dtype``."""
        if not self.by_piece:
            return self._plain(texts)
        out: list[bytes | None] = []
        for text in texts:
            if _unsure(text) or self.added and self.added.search(text):
                out.append(None)
                continue
            if len(self.pieces) > self.kept:
                self.pieces.clear()
            known = self.pieces.get
            pieces = _PIECE.findall(text)
            ids = list(map(known, pieces))
            at = -1
            for _ in range(ids.count(None)):
                at = ids.index(None, at + 1)
                ids[at] = known(pieces[at]) or self._piece(pieces[at])
            out.append(b"".join(ids))
        whole = iter(self._plain([t for t, done in zip(texts, out, strict=True) if done is None]))
        return [next(whole) if done is None else done for done in out]

    @cached_property
    def byte_len(self) -> np.ndarray:
        """Bytes of each id of a byte-level vocabulary, where a character stands for a byte."""
        out = np.zeros(self.size, np.int64)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            out[i] = len(token)
        return out

    def _sizes(self, text: str, ids: np.ndarray) -> np.ndarray:
        """Bytes of each token of a text; those of added tokens by what they matched."""
        sizes = self.byte_len[ids]
        at = np.flatnonzero(np.isin(ids, self.added_ids))
        if len(at):
            offsets = self.tokenizer.encode(text, add_special_tokens=False).offsets
            sizes[at] = [len(text[slice(*offsets[k])].encode("utf-8", "surrogatepass")) for k in at.tolist()]
        return sizes

    def spans(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """First byte and end of each token, in bytes of the text; each text is encoded once, whole."""
        if self.by_piece:
            sizes = [self._sizes(text, ids) for text, ids in zip(texts, self.encode(texts), strict=True)]
            return [(ends - size, ends) for size in sizes for ends in [np.cumsum(size)]]
        out = []
        for text, e in zip(texts, self.tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
            at = np.concatenate([[0], np.cumsum([len(c.encode("utf-8", "surrogatepass")) for c in text])]).astype(np.int64)
            pairs = np.array(e.offsets, np.int64).reshape(-1, 2)
            out.append((at[pairs[:, 0]], at[pairs[:, 1]]))
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(b, self.dtype) for b in self.packed(texts)]
