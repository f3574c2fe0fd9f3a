"""Token sequences in training order, in fixed-stride binary shards.

1. Texts become token ids of a public byte-level BPE vocabulary (its file is a parameter), an end mark
   follows each, and each document is cut into sequences of ``length`` tokens. Sequences are numbered
   in input order: the task's number, then the place in it.
2. A keyed Feistel permutation over the next power of four, walked until it falls inside, sends number
   g to slot ``P(g)``: a bijection on 0 .. N-1 that any worker computes without a shuffle or a table.
3. Slots are cut into ranges of ``shard_rows``; each range is one shard. A shard's records have one
   stride, so slot s starts at byte ``(s % shard_rows) * stride`` of shard ``s // shard_rows``: readers go on
   from any slot.

Record: token count (uint32), then ``length`` ids (uint16, little-endian; padded with the end mark).

The tokeniser's pattern never joins across a single space or line feed between other characters, so
texts are cut there and equal pieces are encoded once per task; the ids are those of the whole text.

Defined results: a null or empty text is one sequence with just the end mark; repeated rows are
sequences of their own; a null ``doc_id`` is carried; an empty table gives no rows and no shards. Other
columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import kernel as K
from tidemark.llm import store

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LENGTH, SHARD_ROWS, KEY = 512, 4096, 20240229
WAVES = 4
SHARDS_A_TASK, MAX_TASKS = 4, 20_000  # consecutive shards that a task writes; more of them where tasks would be too many
CACHE, CACHE_IDS = 400_000, 8_000_000  # pieces of text kept per task, and their ids: 26 MB at most, and a batch more
SEQUENCES = "part int, idx long, doc_id long, piece int, n_tokens int, ids binary"
_WHITE = K.SPACE.copy()
_WHITE[0x1C:0x20] = True  # blanks for the pattern, not for words
_UNSAFE = _WHITE.copy()  # white space, or bytes that may begin some
_UNSAFE[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_PLAIN = ~_WHITE & (np.arange(256) < 0x80)


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte offsets where texts can be cut without changing their tokens, and the starts of texts."""
    n = len(data)
    if not n:
        return np.zeros(0, dtype=np.int64)
    safe_next = np.zeros(n, dtype=bool)  # the next byte surely isn't white space
    safe_next[:-1] = ~_UNSAFE[data[1:]]
    after_plain = np.zeros(n, dtype=bool)
    after_plain[1:] = _PLAIN[data[:-1]]
    inner = np.ones(n, dtype=bool)  # neither the first nor the last byte of a text
    some = np.diff(offsets) > 0
    inner[offsets[:-1][some]] = False
    inner[offsets[1:][some] - 1] = False
    cut = (data == 0x20) & safe_next & inner
    feed = (data == 0x0A) & safe_next & after_plain & inner
    cut |= feed
    cut[1:] |= feed[:-1]
    cut[offsets[:-1][some]] = True
    return np.flatnonzero(cut)


@cache
def _encoding(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), max(ranks.values()) + 1


class Encoder:
    """Ids of batches of texts; pieces seen before come from a bounded cache.

    The cache is four arrays: an object for each piece would take some ten times as much in every worker.
    """

    def __init__(self, vocabulary: str = VOCABULARY):
        self.encoding, self.end = _encoding(vocabulary)
        if self.end > 0xFFFF:
            raise ValueError("records hold ids of 16 bits")
        self.lens = np.array([len(self.encoding.decode_single_token_bytes(i)) for i in range(self.end)])
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)  # hashes of the known pieces, ascending
        self.at, self.size = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)  # where their ids lie
        self.ids = np.zeros(0, dtype=np.uint16)

    def _encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the ids of each piece lie, their number, and all ids; pieces that begin with one space are encoded at one go."""
        at, size = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
        is_spaced = np.array([x[:1] == b" " and len(x) > 1 and not _UNSAFE[x[1]] for x in texts], dtype=bool)
        spaced, found, begin = np.flatnonzero(is_spaced), [np.zeros(0, dtype=np.uint16)], 0
        if len(spaced):
            ids = np.array(self.encoding.encode_ordinary(b"".join(texts[i] for i in spaced).decode()), dtype=np.uint16)
            ends = np.searchsorted(np.cumsum(self.lens[ids]), np.cumsum([len(texts[i]) for i in spaced])) + 1
            at[spaced] = np.append(0, ends[:-1])
            size[spaced] = np.diff(ends, prepend=0)
            found.append(ids)
            begin = len(ids)
        for i in np.flatnonzero(~is_spaced):
            ids = np.array(self.encoding.encode_ordinary(texts[i].decode()), dtype=np.uint16)
            at[i], size[i] = begin, len(ids)
            found.append(ids)
            begin += len(ids)
        return at, size, np.concatenate(found)

    def _lookup(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The place in the cache of each piece of ascending hashes; those that aren't there are put in."""
        to = np.searchsorted(self.keys, keys)
        new = np.append(self.keys, np.uint64(0))[to] != keys
        new[to == len(self.keys)] = True
        if len(self.keys) + new.sum() > CACHE:
            self._forget()
            to, new = np.zeros(len(keys), dtype=np.int64), np.ones(len(keys), dtype=bool)
        raw = data.tobytes()
        at, size, ids = self._encode([raw[i:j] for i, j in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
        self.keys, self.at, self.size = (np.insert(a, to[new], b) for a, b in ((self.keys, keys[new]), (self.at, at + len(self.ids)), (self.size, size)))
        self.ids = np.concatenate([self.ids, ids])
        return to + np.cumsum(new) - new

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids with an end mark after each text, and the first of each text and the end."""
        data, offsets = K.buffers(texts)
        starts = piece_starts(data, offsets)
        ends = np.append(starts[1:], len(data))[: len(starts)]
        n = len(offsets) - 1
        if not len(starts):
            return np.full(n, self.end, dtype=np.uint16), np.arange(n + 1)
        uniq, at, inverse = np.unique(K.hash_spans(data, starts, ends), return_index=True, return_inverse=True)
        piece = self._lookup(uniq, data, starts[at], ends[at])[inverse]
        size = self.size[piece]
        where = np.repeat(self.at[piece] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        ids = self.ids[where]
        per_text = K.per_text(size, np.searchsorted(starts, offsets))
        bounds = np.concatenate([[0], np.cumsum(per_text)])
        if len(self.keys) > CACHE or len(self.ids) > CACHE_IDS:
            self._forget()
        return np.insert(ids, bounds[1:], self.end), bounds + np.arange(n + 1)


def _sequences(vocabulary: str, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, idx, encoder = TaskContext.get().partitionId(), 0, None
        for b in K.pieces(batches):
            encoder = encoder or Encoder(vocabulary)
            ids, bounds = encoder.batch(b.column("text"))
            n = np.diff(bounds)
            pieces = -(-n // length)
            owner = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            lo = bounds[owner] + piece * length
            hi = np.minimum(lo + length, bounds[owner + 1])
            # pieces lie one after another in ids
            at = np.append(lo, len(ids)).astype(np.int32) * 2
            raw = pa.BinaryArray.from_buffers(pa.binary(), len(lo), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(ids.astype("<u2").tobytes())])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(lo), part, np.int32)), pa.array(idx + np.arange(len(lo), dtype=np.int64)), b.column("doc_id").take(pa.array(owner)), pa.array(piece.astype(np.int32)), pa.array((hi - lo).astype(np.int32)), raw],
                names=["part", "idx", "doc_id", "piece", "n_tokens", "ids"])
            idx += len(lo)

    return run


def feistel(x: np.ndarray, size: int, key: int, rounds: int = 6) -> np.ndarray:
    """Keyed permutation of 0 .. size-1 (balanced Feistel network with cycle-walking)."""
    half = np.uint64(max(1, (max(size - 1, 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = [np.uint64(K.mix_int(key * 0x9E3779B97F4A7C15 + r + 1)) for r in range(rounds)]

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> half, v & mask
        for k in keys:
            left, right = right, left ^ (K.mix(right ^ k) & mask)
        return (left << half) | right

    out = once(np.asarray(x, dtype=np.uint64))
    while (outside := out >= np.uint64(size)).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


PLACED = ["slot", "shard", "byte_offset", "doc_id", "piece", "n_tokens", "ids"]


def _slotted(docs: DataFrame, vocabulary: str, length: int, shard_rows: int, key: int) -> tuple[DataFrame, int]:
    """``PLACED`` of each sequence, where it was made, and the number of shards."""
    cut = store.table(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_sequences(vocabulary, length), SEQUENCES), "sequences", "zstd")
    parts = sorted((r.part, r.n) for r in cut.groupBy("part").agg(F.count("*").alias("n")).collect())  # a row per task of the pass above
    total = sum(n for _, n in parts)
    first = np.zeros(max((p for p, _ in parts), default=0) + 1, dtype=np.int64)
    for (p, _), at in zip(parts, np.cumsum([0, *(n for _, n in parts)])[:-1], strict=True):
        first[p] = at
    shared = docs.sparkSession.sparkContext.broadcast(first)  # a number per task

    # told to be non-deterministic, which it isn't: else filters on shards copy it, and every task has a second Python worker to find slots again
    @F.pandas_udf("long")
    def slot(part: pd.Series, idx: pd.Series) -> pd.Series:
        return pd.Series(feistel(shared.value[part.to_numpy()] + idx.to_numpy(), total, key))

    out = cut.withColumn("slot", slot.asNondeterministic()("part", "idx")).withColumn("shard", F.expr(f"slot div {shard_rows}"))
    return out.withColumn("byte_offset", F.expr(f"slot % {shard_rows} * {4 + 2 * length}L")).select(*PLACED), -(-total // shard_rows)


def _dealt(slotted: DataFrame, first: int, end: int) -> DataFrame:
    """Shards ``first`` .. ``end - 1``, whole and in order, some consecutive ones in each partition."""
    each = max(-(-(end - first) // MAX_TASKS), SHARDS_A_TASK)
    some = slotted.filter(f"shard >= {first} and shard < {end}")
    return some.repartitionById(max(1, -(-(end - first) // each)), F.expr(f"cast((shard - {first}) div {each} as int)")).sortWithinPartitions("slot")


def materialise(docs: DataFrame, vocabulary: str = VOCABULARY, length: int = LENGTH, shard_rows: int = SHARD_ROWS, key: int = KEY) -> DataFrame:
    """slot, shard, byte_offset, doc_id, piece, n_tokens and ids of each sequence; shards lie whole and sorted in partitions."""
    slotted, shards = _slotted(docs, vocabulary, length, shard_rows, key)
    return _dealt(slotted, 0, shards)


def records(ids: list[bytes], length: int, end: int) -> list[bytes]:
    pad = int(end).to_bytes(2, "little")
    return [(len(x) // 2).to_bytes(4, "little") + x + pad * (length - len(x) // 2) for x in ids]


def digests(placed: DataFrame, vocabulary: str = VOCABULARY, length: int = LENGTH) -> DataFrame:
    """The placed sequences with the CRC-32 of each record instead of its ids."""
    import zlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, end = _encoding(vocabulary)
        for b in batches:
            crc = [zlib.crc32(r) for r in records(b.column("ids").to_pylist(), length, end)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in ("slot", "shard", "byte_offset", "doc_id", "piece", "n_tokens")), pa.array(crc, pa.int64())], names=["slot", "shard", "byte_offset", "doc_id", "piece", "n_tokens", "record_crc32"])

    return placed.mapInArrow(run, "slot long, shard long, byte_offset long, doc_id long, piece int, n_tokens int, record_crc32 long")


def _filesystem(path: str):
    """pyarrow's file system for a URI or a path, and the path in it."""
    from pyarrow import fs

    where = path.replace("s3a://", "s3://", 1)
    if where.startswith("file:"):
        return fs.LocalFileSystem(), "/" + where.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(where)


DIGEST = "slot long, shard long, byte_offset long, doc_id long, piece int, n_tokens int, record_crc32 long"


def shard_files(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, length: int = LENGTH, shard_rows: int = SHARD_ROWS, key: int = KEY) -> DataFrame:
    """Materialise ``docs`` as shard files under ``path`` and read them back: the digest of each record as it lies in its file.

    Token counts and CRC-32 come from the files; a record whose count isn't that of its sequence is an error. Shards are
    written in ``WAVES`` of equal numbers, so that no more than that part of the sequences lies in a shuffle at once.
    """
    slotted, shards = _slotted(docs, vocabulary, length, shard_rows, key)
    out = None
    for w in range(WAVES):
        first, end = shards * w // WAVES, shards * (w + 1) // WAVES
        if first < end or (w == WAVES - 1 and out is None):
            part = store.table(_written(_dealt(slotted, first, end), path, vocabulary, length), "digests")
            out = part if out is None else out.unionByName(part)
    return out


def write_shards(placed: DataFrame, path: str, vocabulary: str = VOCABULARY, length: int = LENGTH) -> DataFrame:
    """Write ``shard-<number>.bin`` files under ``path`` (any URI that pyarrow opens); (shard, records, bytes) of each."""
    out = _written(placed, path, vocabulary, length)
    return out.groupBy("shard").agg(F.count("*").alias("records"), (F.count("*") * (4 + 2 * length)).alias("bytes"))


def _written(placed: DataFrame, path: str, vocabulary: str, length: int) -> DataFrame:
    """Writes each shard under a name of its own, moves it into place and reads it back, so a task that is run again after a lost
    executor replaces it by the same bytes. One shard at a time is in memory."""
    stride, names = 4 + 2 * length, ["slot", "shard", "byte_offset", "doc_id", "piece", "n_tokens", "record_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        import zlib

        where, root = _filesystem(path)
        _, end = _encoding(vocabulary)
        shard, part, out, rows = None, "", None, []

        def close() -> pa.RecordBatch:
            out.close()
            final = f"{root}/shard-{shard:08d}.bin"
            where.move(part, final)
            with where.open_input_file(final) as f:
                got = f.read()
            counts = [int.from_bytes(got[i : i + 4], "little") for i in range(0, len(got), stride)]
            crc = [zlib.crc32(got[i : i + stride]) for i in range(0, len(got), stride)]
            table = pa.Table.from_batches(rows)
            if len(got) != stride * table.num_rows or counts != table.column("n_tokens").to_pylist():
                raise OSError(f"{final} isn't what was written")
            cols = [table.column(k).combine_chunks() for k in names[:-1]]
            return pa.RecordBatch.from_arrays([*cols, pa.array(crc, pa.int64())], names=names)

        for b in batches:
            ids, shards = b.column("ids").to_pylist(), b.column("shard").to_numpy()
            slim = b.select(names[:-1])
            begin = np.flatnonzero(np.concatenate([[True], shards[1:] != shards[:-1]])) if len(shards) else []
            for i, j in zip(begin, [*begin[1:], len(shards)]):
                if shards[i] != shard:
                    if out:
                        yield close()
                    shard, rows = int(shards[i]), []
                    part = f"{root}/.shard-{shard:08d}-{os.urandom(6).hex()}"
                    where.create_dir(root)
                    out = where.open_output_stream(part)
                rows.append(slim.slice(int(i), int(j - i)))
                out.write(b"".join(records(ids[i:j], length, end)))
        if out:
            yield close()

    return placed.mapInArrow(run, DIGEST)


def read_shard(path: str, shard: int, length: int = LENGTH, start: int = 0) -> Iterator[np.ndarray]:
    """Sequences of a shard from record ``start`` on."""
    where, root = _filesystem(path)
    stride = 4 + 2 * length
    with where.open_input_file(f"{root}/shard-{shard:08d}.bin") as f:
        f.seek(start * stride)
        while record := f.read(stride):
            yield np.frombuffer(record, dtype="<u2", offset=4)[: int.from_bytes(record[:4], "little")]
