"""Encoders, token files and packing against the tokenizer libraries."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tidewatch.llm import sentencepieces as sp
from tidewatch.llm import stock_packing as pk
from tidewatch.llm import token_store as ts
from tidewatch.llm.queries import tokenizer
from tidewatch.llm.words import byte_letters, word_ids

ODD = [
    None, "", " ", "  ", "\n", "a", "it's I'LL 'tis ''s don't", "İstanbul ǅ", "a\x00b", "<|endoftext|> x <|startoftext|>",
    "   \n\n  x \t", "12345 67", "é́e ê", "x" * 5000, "日本語 テスト 🎉🎉", "foo\x1cbar", "ñ Ñ ÿ Ÿ ß ẞ", "<s> </s> <unk> <0x0A>",
    "▁▁a ▁", "\r\n\t", "\ufeffabc", "aaaaaaabbbbbb" * 50, "ab" * 100 + " " * 50, "a" * 40_000, "the of and " * 3000,
]
SF = "/root/testdata/sf0.001"


def table(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(ODD)] + [(100, ODD[5], "y", 2)] * 2
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, kind int")


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_equal_the_library(spark, name):
    words = word_ids(tokenizer(name))
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for t in [*texts, *[x or "" for x in ODD]]:
        assert np.frombuffer(words.ids(t), "<u4").tolist() == words.library.encode(t, add_special_tokens=False).ids
    letters = byte_letters()
    assert sorted(letters.values()) == list(range(256))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_every_entry_encodes_to_itself(name):
    """What the equality of merging by rank and by pairs rests on."""
    words = word_ids(tokenizer(name))
    for rank, found in words.id_bytes.items():
        piece = words.merger.decode_single_token_bytes(rank)
        assert words.merger._encode_single_piece(piece) == [rank], piece
        assert len(found) == 4


def test_pieces_equal_the_library(spark):
    path = tokenizer("piece_bpe_32k.model")
    library = sp.piece_table(path).library
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for t in [*texts, *[x or "" for x in ODD]]:
        assert sp.piece_table(path).encoded(t)[0] == library.encode(t)
    for r in sp.round_trip(table(spark), path).collect():
        ids = library.encode(ODD[5 if r.doc_id == 100 else r.doc_id] or "")
        want = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), library.decode(ids))]
        assert [r.n_tokens, r.ids_sha256, r.decoded_sha256] == [len(ids), *want]
    assert sp.encode(table(spark).limit(0), path).count() == 0 == sp.round_trip(table(spark).limit(0), path).count()


def test_random_texts_equal_the_library():
    t = sp.piece_table(tokenizer("piece_bpe_32k.model"))
    rng = np.random.default_rng(4)
    parts = ["a", "b", " ", "  ", "   ", "the", "é", "日", "\n", "ing", "th", "▁", ".", "x", "0", "//"]
    for _ in range(4000):
        text = "".join(parts[i] for i in rng.integers(0, len(parts), rng.integers(1, 25)))
        assert t.encoded(text)[0] == t.library.encode(text), repr(text)


def test_pair_test_equals_merging():
    t = sp.piece_table(tokenizer("piece_bpe_32k.model"))
    rng = np.random.default_rng(0)
    ids = list(t.piece)
    for a, b in rng.choice(ids, (3000, 2)).tolist():
        assert t.stay_apart(a, b) == (t.merged(t.piece[a] + t.piece[b]) == [a, b])


@pytest.mark.parametrize("n", [1, 5, 1023, 1024, 1025, 300_000, (1 << 20) + 7])
def test_token_file_round_trip(n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % 49_000).astype(np.uint32)
    file = ts.encode_file(ids, np.array([n]))
    back, lengths = ts.decode_file(file)
    assert (back == ids).all() and lengths.tolist() == [n]
    if n > 100_000:
        broken = bytearray(file)
        broken[len(file) // 2] ^= 1
        with pytest.raises(ts.CorruptFile):
            ts.decode_file(bytes(broken))
    with pytest.raises(ts.CorruptFile):
        ts.decode_file(b"x" + file[1:])


def test_token_store(spark):
    path = tokenizer("word_bpe_49k.json")
    library = word_ids(path).library
    rows = [(i, t) for i, t in enumerate(ODD)]
    docs = table(spark).where("doc_id <> 100")
    got = {r.doc_id: r for r in ts.round_trip(docs, path, shard_ids=500).collect()}
    start = 0
    for i, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert ts.round_trip(table(spark), path).count() == len(ODD) + 2
    assert ts.round_trip(docs.limit(0), path).count() == 0
    nulls = ts.round_trip(spark.createDataFrame([(None, "b"), (None, "a"), (0, "c")], "doc_id long, text string"), path).collect()
    assert sorted((r.start, r.doc_id) for r in nulls) == [(0, None), (2, None), (4, 0)]


def check_packing(rows, texts_by_id, library, capacity):
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
        pieces[r.doc_id].append(r)
    for members in sequences.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    for doc_id, text in texts_by_id.items():
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    return len(sequences)


def test_packing(spark):
    path = tokenizer("byte_bpe_50k.json")
    library = word_ids(path).library
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = pk.pack(docs, path).collect()
    n = check_packing(rows, texts, library, 2048)
    assert sum(r.length for r in rows) / (2048 * n) > 0.97
    odd = table(spark).where("doc_id <> 100")
    check_packing(pk.pack(odd, path, capacity=64, width=4).collect(), dict(enumerate(ODD)), library, 64)
    assert sum(r.doc_id == 100 for r in pk.pack(table(spark), path).collect()) == 2
    assert pk.pack(odd.limit(0), path).count() == 0


def test_plan_meets_demand_with_little_waste():
    rng = np.random.default_rng(1)
    for n in (1, 7, 300, 20_000):
        size, demand = np.unique(rng.integers(1, 257, n), return_counts=True)
        plan = pk.cutting_plan(size, demand, 256)
        assert (sum(p * t for p, t in plan) == demand).all() and all((p * size).sum() <= 256 for p, _ in plan)
        least = -(-int((size * demand).sum()) // 256)
        assert sum(t for _, t in plan) <= 1.05 * least + 2
    value, pattern = pk.best_pattern(np.array([3.0, 5.0, 9.0]), np.array([2, 3, 5]), 11)
    assert value == 19.0 and (pattern * [2, 3, 5]).sum() <= 11  # 5 + 3 + 3


def test_a_text_with_a_gap_in_the_table_goes_through_the_library(monkeypatch):
    pieces = sp.PieceTable(tokenizer("piece_bpe_32k.model"))
    fine = pieces.encoded_always("plain words")
    assert fine[2] is False

    def gap(text):
        raise sp.PrefixGap(text)

    monkeypatch.setattr(pieces, "_run", gap)
    pieces.memo.clear()
    assert pieces.encoded_always("plain words") == (*fine[:2], True)
