"""Token files: static range asymmetric numeral systems over interleaved lanes.

Documents are sorted by id into range partitions; a task tokenises its documents
one after the other and closes a shard file every ``SHARD_IDS`` ids. The blocks of
a shard share one frequency table. A block deals its ids to ``LANES`` coder states
that write into one word stream, so numpy codes a whole row of lanes at a time,
and notes all states every ``CHECK_STEPS`` rows: from these checkpoints the sections of a
block are decoded side by side. Every block carries the CRC-32 of its ids.

File: ``HEADER`` (magic, documents, ids, blocks, table bytes), deflated table (symbol
gaps and frequencies), document lengths, then per block ``BLOCK`` (ids, checkpoints,
words, CRC-32), checkpoint word positions, checkpoint states, words. Little-endian.

Shards are rows of a Parquet table in the cluster's shared folder: written by
Spark's committer, so a lost executor only costs its own tasks.

Defined results: a null text counts as empty; every document ends with ``end_id``; null
document ids sort first; documents with equal ids are ordered by the hash of
their text; very long texts are encoded whole; an empty table writes no shard; other columns are ignored.
The shard is the unit between tasks: one task writes and reads it, its blocks can be decoded apart.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import chunks
from tidewatch.llm.words import word_ids
from tidewatch.session import scratch_path

END_ID = 1
SHARD_IDS = 1 << 22  # 16 MB of ids in memory
BLOCK_IDS = 1 << 20
LANES = 1_024
CHECK_STEPS = 256
SCALE = 20  # frequencies of a table sum to 2^SCALE
LOW = np.uint64(1 << 31)  # states stay in [LOW, LOW * 2^32)
WORD = np.uint64(32)
MAGIC = b"tokn"
HEADER = struct.Struct("<4sIQII")
BLOCK = struct.Struct("<QIQI")
SHARDS = "part int, shard int, start long, n_ids long, doc_ids array<long>, file binary"
DECODED = "part int, doc_id long, local_start long, n_tokens long, ids_crc32 long"


class CorruptFile(ValueError):
    """A file whose structure or checksum is wrong."""


def frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols that occur and their frequencies: at least 1 each, 2^SCALE together."""
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    counts = counts[symbols].astype(object)
    room = (1 << SCALE) - len(symbols)
    if room < 0:
        raise ValueError("more symbols than the table has room for")
    scaled = (1 + counts * room // counts.sum()).astype(np.int64)
    scaled[np.argmax(scaled)] += (1 << SCALE) - scaled.sum()
    return symbols.astype(np.int64), scaled


def encode_block(ids: np.ndarray, freq: np.ndarray, start: np.ndarray) -> bytes:
    """``freq`` and ``start`` by symbol. Ids are coded last to first, so that decoding runs forward."""
    state = np.full(LANES, LOW, np.uint64)
    scale, low_word = np.uint64(SCALE), np.uint64(0xFFFFFFFF)
    full = np.uint64(31 - SCALE + 32)
    out, marks, written = [], [], 0
    for step in range(-(-len(ids) // LANES) - 1, -1, -1):
        row = ids[step * LANES : (step + 1) * LANES]
        f, x = freq[row], state[: len(row)]
        over = x >= f << full
        words = (x[over] & low_word).astype(np.uint32)
        out.append(words)
        written += len(words)
        x = np.where(over, x >> WORD, x)
        share = x // f
        state[: len(row)] = (share << scale) + (x - share * f) + start[row]
        if step % CHECK_STEPS == 0:
            marks.append((written, state.copy()))
    marks.reverse()
    places = np.array([written - w for w, _ in marks], "<u8")
    states = np.concatenate([s for _, s in marks]).astype("<u8") if marks else np.empty(0, "<u8")
    stream = np.concatenate(out[::-1]).astype("<u4") if out else np.empty(0, "<u4")
    head = BLOCK.pack(len(ids), len(marks), len(stream), zlib.crc32(ids.astype("<u4").tobytes()))
    return head + places.tobytes() + states.tobytes() + stream.tobytes()


def decode_block(data: memoryview, at: int, symbol: np.ndarray, freq: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, int]:
    """Ids of the block at ``at`` and the place after it; the three tables are by slot."""
    n, sections, n_words, crc = BLOCK.unpack_from(data, at)
    at += BLOCK.size
    places = np.frombuffer(data, "<u8", sections, at).astype(np.int64)
    at += 8 * sections
    state = np.frombuffer(data, "<u8", sections * LANES, at).reshape(sections, LANES).astype(np.uint64)
    at += 8 * sections * LANES
    stream = np.frombuffer(data, "<u4", n_words, at)
    at += 4 * n_words
    out = np.zeros((sections, CHECK_STEPS, LANES), np.uint32)
    mask, scale = np.uint64((1 << SCALE) - 1), np.uint64(SCALE)
    steps = -(-n // LANES)
    for step in range(min(CHECK_STEPS, steps)):
        rows = sections if (sections - 1) * CHECK_STEPS + step < steps else sections - 1
        x = state[:rows]
        slot = (x & mask).astype(np.int64)
        out[:rows, step] = symbol[slot]
        x = freq[slot] * (x >> scale) + bias[slot]
        need = x < LOW
        if rows == sections and (rows - 1) * CHECK_STEPS + step == steps - 1:
            need[-1, n - (steps - 1) * LANES :] = False  # lanes without an id in the last row
        taken = np.cumsum(need, axis=1)
        where = (taken + places[:rows, None])[need] - 1
        if len(where) and where[-1] >= n_words:
            raise CorruptFile("the words of a block end early")
        x[need] = (x[need] << WORD) | stream[where]
        places[:rows] += taken[:, -1]
        state[:rows] = x
    ids = out.reshape(-1)[:n] if n else np.empty(0, np.uint32)
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise CorruptFile("a block fails its checksum")
    return ids, at


def encode_file(ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """One shard: its table, document lengths and blocks."""
    symbols, scaled = frequencies(ids)
    size = int(symbols[-1]) + 1
    freq, start = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
    freq[symbols], start[symbols] = scaled, np.cumsum(scaled) - scaled
    gaps = np.diff(symbols, prepend=0).astype("<u4")
    table = zlib.compress(struct.pack("<I", len(symbols)) + gaps.tobytes() + scaled.astype("<u4").tobytes())
    blocks = [encode_block(ids[i : i + BLOCK_IDS], freq, start) for i in range(0, len(ids), BLOCK_IDS)]
    head = HEADER.pack(MAGIC, len(lengths), len(ids), len(blocks), len(table))
    return head + table + lengths.astype("<u8").tobytes() + b"".join(blocks)


def decode_file(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a shard and the lengths of its documents."""
    magic, documents, n, n_blocks, table_bytes = HEADER.unpack_from(data, 0)
    if magic != MAGIC:
        raise CorruptFile("not a token file")
    view, at = memoryview(data), HEADER.size
    table = zlib.decompress(view[at : at + table_bytes])
    at += table_bytes
    (used,) = struct.unpack_from("<I", table, 0)
    symbols = np.cumsum(np.frombuffer(table, "<u4", used, 4)).astype(np.uint32)
    scaled = np.frombuffer(table, "<u4", used, 4 + 4 * used).astype(np.int64)
    symbol = np.repeat(symbols, scaled)
    freq = np.repeat(scaled, scaled).astype(np.uint64)
    bias = (np.arange(len(symbol)) - np.repeat(np.cumsum(scaled) - scaled, scaled)).astype(np.uint64)
    lengths = np.frombuffer(view, "<u8", documents, at).astype(np.int64)
    at += 8 * documents
    parts = []
    for _ in range(n_blocks):
        ids, at = decode_block(view, at, symbol, freq, bias)
        parts.append(ids)
    ids = np.concatenate(parts) if parts else np.empty(0, np.uint32)
    if len(ids) != n or lengths.sum() != n:
        raise CorruptFile("lengths do not add up")
    return ids, lengths


def write(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> None:
    """Tokenise the documents in order of id and write their shards to ``path``."""
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
    )
    end = np.uint32(end_id).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer)
        part = TaskContext.get().partitionId()
        shard = start = size = 0
        doc_ids: list[int | None] = []
        pieces: list[bytes] = []

        def close() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(pieces), "<u4")
            file = encode_file(ids, np.array([len(p) // 4 for p in pieces]))
            values = [part], [shard], [start], [len(ids)], [doc_ids], [file]
            kinds = pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()
            names = ["part", "shard", "start", "n_ids", "doc_ids", "file"]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names)

        for batch in chunks(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                doc_ids.append(doc_id)
                pieces.append(words.ids(text) + end)
                size += len(pieces[-1]) // 4
                if size >= shard_ids:
                    yield close()
                    shard, start, size = shard + 1, start + size, 0
                    doc_ids, pieces = [], []
        if pieces:
            yield close()

    ordered.mapInArrow(run, SHARDS).write.mode("overwrite").parquet(path)


def read(files: DataFrame) -> DataFrame:
    """One row per document of the shards: place in its partition, ids and their CRC-32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 1):
            part, first = batch.column(0)[0].as_py(), batch.column(1)[0].as_py()
            ids, lengths = decode_file(batch.column(3)[0].as_py())
            doc_ids = batch.column(2)[0].values
            if len(doc_ids) != len(lengths):
                raise CorruptFile("a shard has other documents than lengths")
            starts = np.cumsum(lengths) - lengths
            data = memoryview(ids.astype("<u4").tobytes())
            crcs = [zlib.crc32(data[4 * s : 4 * (s + n)]) for s, n in zip(starts.tolist(), lengths.tolist())]
            columns = [
                pa.array([part] * len(lengths), pa.int32()), doc_ids, pa.array(starts + first, pa.int64()),
                pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["part", "doc_id", "local_start", "n_tokens", "ids_crc32"])

    return files.select("part", "start", "doc_ids", "file").mapInArrow(run, DECODED)


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Write all documents as token files, read the files back and describe each document from them."""
    spark = docs.sparkSession
    path = scratch_path(spark, "tokens")
    write(docs, tokenizer, path, end_id, shard_ids)
    files = spark.read.parquet(path)
    # One row per written partition: the sum over them is short however long the corpus is.
    bases = (
        files.groupBy("part")
        .agg(F.sum("n_ids").alias("n"))
        .select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    )
    return read(files).join(bases, "part").select(
        "doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32"
    )
