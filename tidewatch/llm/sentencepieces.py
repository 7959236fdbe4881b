"""Byte-pair SentencePiece ids from a prefix table.

For every prefix of a text the encoding ends in exactly one token. The table of
these last tokens is filled left to right: an Aho-Corasick automaton lists the
vocabulary pieces that end at a position, and the one whose predecessor is the
last token of the remaining prefix *and* stays apart from it when the two are
merged on their own is the token of the prefix. Two tokens that stay apart alone
stay apart in any text, since merges on either side of a boundary that holds
never see past it. The ids are then read backwards through the table, so the work
is linear in the text however long a word is.

A text falls into words in front of which the vocabulary never merges; words are
kept in a bounded memo. Characters outside the vocabulary become byte pieces.

Defined results: null counts as empty and has no ids; an empty text decodes to an
empty text; very long texts are encoded whole; repeated rows and any extra columns make no
difference; an empty table gives no row. A text in which the table leaves a gap is encoded by
the library and marked ``by_library``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import chunks

SPACE = "▁"
MEMO_WORDS = 400_000  # about 100 MB a worker; words beyond are worked out again
MEMO_PAIRS = 300_000
NEVER = float("inf")

OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, by_library boolean"


class PrefixGap(ValueError):
    """The vocabulary leaves a prefix without a last token."""


class PieceTable:
    """Encoder for one byte-pair model file with byte fallback and the identity normaliser."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(lib.get_piece_size())
        special = {i for i in ids if lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i)}
        self.piece = {i: lib.id_to_piece(i) for i in ids if i not in special}
        self.token = {p: i for i, p in self.piece.items()}
        self.rank = {i: -lib.get_score(i) for i in self.piece}
        for i, p in self.piece.items():  # a character is there before any merge
            if len(p) == 1:
                self.rank[i] = -1.0
        self.byte = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if lib.is_unknown(self.byte[0]) or any(lib.is_unused(i) for i in self.piece):
            raise ValueError("the model needs byte fallback and no unused pieces")
        if lib.normalize(f" a  b\t\n{SPACE}ﬁ ") != f"{SPACE}{SPACE}a{SPACE}{SPACE}b\t\n{SPACE}ﬁ{SPACE}":
            raise ValueError("the model needs the identity normaliser with a space put in front")
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.piece.values()):
            raise ValueError("the model has pieces across words")
        self.known = re.compile("[" + "".join(map(re.escape, sorted(p for p in self.token if len(p) == 1))) + "]+")
        self.words = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.automaton = ahocorasick.Automaton()
        for i, p in self.piece.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.apart: dict[tuple[int, int], bool] = {}
        self.built: dict[int, tuple] = {}
        self.whole: dict[int, bool] = {}
        self.memo = _Words(self)

    def merged(self, text: str, keep: int = 1) -> list[int]:
        """Ids of a short text of known characters by plain best-first merging, down to ``keep`` parts."""
        parts: list[str | None] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        end, token, rank = len(parts), self.token, self.rank

        def candidate(a: int) -> tuple | None:
            b = after[a]
            if b >= end:
                return None
            both = parts[a] + parts[b]
            found = token.get(both)
            return None if found is None else (rank[found], a, b, both)

        queue = [c for c in map(candidate, range(end)) if c]
        heapify(queue)
        left = end
        while queue and left > keep:
            _, a, b, both = heappop(queue)
            if parts[a] is None or after[a] != b or parts[b] is None or parts[a] + parts[b] != both:
                continue
            parts[a], parts[b], after[a] = both, None, after[b]
            left -= 1
            if after[b] < end:
                before[after[b]] = a
            for x in (before[a], a):
                if x >= 0 and (c := candidate(x)):
                    heappush(queue, c)
        return [token[p] for p in parts if p is not None]

    def spines(self, token: int) -> tuple:
        """Bottom-up edges of a piece as merging builds it: (text, rank) down its left and its right side."""
        found = self.built.get(token)
        if found is None:
            text = self.piece[token]
            parts = [token] if len(text) == 1 else self.merged(text, keep=2)
            own = (text, self.rank[token])
            if len(text) == 1:
                found = [own], [own]
            elif len(parts) == 2 and max(self.rank[p] for p in parts) < self.rank[token]:
                left, right = (self.spines(p) for p in parts)
                found = (None, None) if left[0] is None or right[0] is None else ([*left[0], own], [*right[1], own])
            else:
                found = None, None  # not made in order of rank, or not at all
            self.built[token] = found
        return found

    def stands(self, token: int) -> bool:
        """Whether a piece on its own becomes one token."""
        if self.spines(token)[0] is not None:
            return True
        if token not in self.whole:
            self.whole[token] = self.merged(self.piece[token]) == [token]
        return self.whole[token]

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether merging ``a`` + ``b`` ends in exactly these two tokens.

        Both sides are built up in order of rank; at each moment the right edge of
        ``a`` and the left edge of ``b`` are known, and the boundary falls if their
        union is a piece whose turn comes before the next merge of either side.
        """
        found = self.apart.get((a, b))
        if found is None:
            x, y = self.spines(a)[1], self.spines(b)[0]
            found = self.stands(a) and self.stands(b)
            if found and (x is None or y is None):  # pieces out of order of rank, such as runs of spaces
                found = self.merged(self.piece[a] + self.piece[b]) == [a, b]
            i = j = 0
            while found and x is not None and y is not None:
                grow_x = x[i + 1][1] if i + 1 < len(x) else NEVER
                grow_y = y[j + 1][1] if j + 1 < len(y) else NEVER
                union = self.token.get(x[i][0] + y[j][0])
                if union is not None and self.rank[union] < grow_x and self.rank[union] <= grow_y:
                    found = False
                elif grow_x == grow_y == NEVER:
                    break
                elif grow_x <= grow_y:
                    i += 1
                else:
                    j += 1
            if len(self.apart) < MEMO_PAIRS:
                self.apart[a, b] = found
        return found

    def prefix_table(self, text: str) -> tuple[list[int], list[int]]:
        """Last token and its length for every prefix of a text of known characters."""
        last, length = [0] * (len(text) + 1), [0] * (len(text) + 1)
        apart = self.apart
        for at, (token, size) in self.automaton.iter(text):
            end = at + 1
            if length[end]:
                continue
            start = end - size
            if start:
                if not length[start]:
                    continue
                fits = apart.get((last[start], token))
                if fits is None:
                    fits = self.stay_apart(last[start], token)
            else:
                fits = self.stands(token)
            if fits:
                last[end], length[end] = token, size
        return last, length

    def _run(self, text: str) -> list[int]:
        last, length = self.prefix_table(text)
        if not length[-1]:
            raise PrefixGap(text)
        ids, end = [], len(text)
        while end:
            ids.append(last[end])
            end -= length[end]
        ids.reverse()
        return ids

    def word(self, word: str) -> tuple[list[int], str]:
        """Ids of a word and their decimal text."""
        ids: list[int] = []
        at = 0
        for run in self.known.finditer(word):
            ids += [self.byte[b] for b in word[at : run.start()].encode()]
            ids += self._run(run.group())
            at = run.end()
        ids += [self.byte[b] for b in word[at:].encode()]
        return ids, ",".join(map(str, ids))

    def encoded(self, text: str) -> tuple[list[int], str]:
        """Ids of a text and their decimal text."""
        if not text:
            return [], ""
        words = text.split(" ")
        if "" in words or SPACE in text:
            words = self.words.findall(SPACE + text.replace(" ", SPACE))
            parts = [self.memo[w[1:]] if w[1:2] != SPACE else self.word(w) for w in words]
        else:
            parts = list(map(self.memo.__getitem__, words))
        return list(chain.from_iterable([p[0] for p in parts])), ",".join([p[1] for p in parts])


    def encoded_always(self, text: str) -> tuple[list[int], str, bool]:
        """As ``encoded``, and whether the library had to encode the text as the table leaves a gap in it."""
        try:
            return *self.encoded(text), False
        except PrefixGap:
            ids = self.library.encode(text)
            return ids, ",".join(map(str, ids)), True


class _Words(dict):
    """Bounded memo of the words after one space."""

    def __init__(self, table: PieceTable) -> None:
        super().__init__()
        self.table = table

    def __missing__(self, word: str) -> tuple[list[int], str]:
        found = self.table.word(SPACE + word)
        if len(self) < MEMO_WORDS and len(word) <= 40:
            self[word] = found
        return found


_LOADED: dict[str, PieceTable] = {}


def piece_table(path: str) -> PieceTable:
    """One copy a Python worker."""
    if path not in _LOADED:
        _LOADED[path] = PieceTable(path)
    return _LOADED[path]


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id`` and ``ids`` (list of int) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_table(path)
        for batch in chunks(batches):
            ids = [table.encoded_always(t or "")[0] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return _input(docs).mapInArrow(run, "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Number and digest of the ids of every text, and the digest of what the model decodes from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_table(path)
        decode = table.library.decode
        for batch in chunks(batches):
            rows: list[tuple[int, str, str, bool]] = []
            for text in batch.column(1).to_pylist():
                ids, digits, gap = table.encoded_always(text or "")
                rows.append((len(ids), _sha(digits), _sha(decode(ids)), gap))
            n, a, b, gaps = zip(*rows)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b), pa.array(gaps)]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "by_library"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return _input(docs).mapInArrow(run, OUT)


def _input(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
