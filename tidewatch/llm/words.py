"""Exact byte-pair ids of whole texts from a public tokenizer file, fast enough for a scan.

A text is cut into the pieces that the file's own pre-tokenizer would make, and
each piece is looked up in a bounded memo. Text outside a small alphabet for
which the cut is proved equal (ASCII and the accented Latin-1 letters, no
special-token markers) goes through the ``tokenizers`` library itself.

A piece that is new is merged by rank. Ranks and merge pairs give the same ids
as long as every vocabulary entry encodes to itself: merges inside a region that
ends up as entry ``t`` cannot depend on anything outside it, so the last pair
merged is the pair from which ``t`` was made.
"""

from __future__ import annotations

import json
import os
import re
from functools import cached_property

import numpy as np

MEMO_WORDS = 250_000  # entries of the memo, about 50 MB; later pieces are not kept

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_OUTSIDE = re.compile(r"[^\t\n\r -~À-ÖØ-öø-ÿ]")
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
_BYTE_PIECES = re.compile(
    rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s0-9{_LETTERS}]+|\s+(?!\S)|\s+"
)
_WORD_PIECES = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{_LETTERS}]+|[0-9]|[^\s0-9{_LETTERS}]+")
_END = "</w>"
_END_MARK = "\x00"  # stands for the end of a word; never part of a text on the fast path


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordIds(dict):
    """``ids(text)``: little-endian unsigned 32-bit ids of a whole text, without special tokens added."""

    def __init__(self, path: str, memo_words: int = MEMO_WORDS) -> None:
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.memo_words = memo_words
        self.word_ends = model.get("end_of_word_suffix") == _END
        self.pieces = _WORD_PIECES if self.word_ends else _BYTE_PIECES
        letters = byte_letters()

        def raw(token: str) -> bytes:
            end = self.word_ends and token.endswith(_END)
            body = token[: -len(_END)] if end else token
            return bytes(letters[c] for c in body) + (_END_MARK.encode() if end else b"")

        vocab = {raw(t): i for t, i in model["vocab"].items()}
        # Ranks: single bytes, then (for files with word ends) a byte with its end mark, then merges in order.
        ranks: dict[bytes, int] = {bytes([b]): b for b in range(256)}
        if self.word_ends:
            for b in range(256):
                ranks[bytes([b]) + _END_MARK.encode()] = 256 + b
        for pair in model["merges"]:
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            ranks.setdefault(raw(left) + raw(right), len(ranks) + 1_000)
        self.id_bytes = {r: np.uint32(vocab[t]).tobytes() for t, r in ranks.items() if t in vocab}
        self.merger = tiktoken.Encoding("pieces", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def library(self):
        """The library's own encoder; a worker that sees no text outside the alphabet never loads it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def __missing__(self, piece: str) -> bytes:
        ranks = self.merger.encode_ordinary(piece + _END_MARK if self.word_ends else piece)
        found = b"".join(map(self.id_bytes.__getitem__, ranks))
        if len(self) < self.memo_words and len(piece) <= 48:
            self[piece] = found
        return found

    def ids(self, text: str) -> bytes:
        if "<|" in text or (_CONTROL if text.isascii() else _OUTSIDE).search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        text = text.lower() if self.word_ends else text
        return b"".join(map(self.__getitem__, self.pieces.findall(text)))


_LOADED: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One copy a Python worker."""
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]
