"""Removal of passages that an earlier document has, by relative Lempel-Ziv parsing.

Every document is parsed against all documents of smaller ``doc_id``, the reference.

1. *Reference blocks.* The least hash of the ``window - gram + 1`` word grams of a window is its
   anchor. Consecutive windows of one anchor form a block, some 20 windows long. Equal windows have
   equal anchors, so a window can occur elsewhere only in a block of the same anchor.
2. *Index.* Blocks are indexed by anchor; anchors that only one document has are dropped. Blocks with
   the same words are one index entry, held by the least (document, place), however many copies there are.
3. *Matches.* A block that an earlier document holds whole is a match. Where blocks of one anchor
   differ - at factor boundaries - their single windows are indexed and looked up. So each window that
   the reference has is in a match, and no other is.
4. *Factors.* Each document is parsed from left to right: a match that begins a factor is extended as long
   as the next ones copy on from the same place of the same reference document; where none does, the
   factor ends, and the match that reaches furthest past it begins the next (:func:`factor`). What no match covers
   are literals. Factors have at least ``window`` words by construction; they are the spans that go.

Exact but for collisions of 64-bit hashes: each window is decided by a lookup of its whole word
sequence (or that of its whole block). What the executors share is two membership filters of a
fixed greatest size, which only spare rows that can't match.

Defined results: a null or empty text has no words and stays empty; fewer than ``window`` words: all
stay; repeated rows: the same ``doc_id`` isn't smaller, so both stay; different texts of one ``doc_id``
are parsed each on its own; a null ``doc_id`` is neither parsed nor part of the reference; an empty table gives
no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import kernel as K
from tidemark.llm import store

WINDOW, GRAM = 50, 8
_BASE = 0xA0761D6478BD642F
_BASE_INV = pow(_BASE, -1, 1 << 64)
PARSED = "doc_id long, tid long, n_words long, kept_sha256 string, anchor array<long>, block array<long>, pos array<int>, size array<int>"
MEMBER = "anchor long, block long, doc_id long, tid long, pos int, size int"


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """Least of each ``size`` consecutive values."""
    if len(x) < size:
        return x[:0]
    have, out = 1, x
    while have * 2 <= size:
        out, have = np.minimum(out[:-have], out[have:]), have * 2
    rest = size - have
    return np.minimum(out[: len(x) - size + 1], out[rest : rest + len(x) - size + 1]) if rest else out


def blocks(w: K.Runs, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Text, first word (in the batch), windows, anchor and hash of each block."""
    ok = K.whole(w.first, window)
    if not ok.any():
        return tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    least = sliding_min(K.windows(w.hashes, gram), window - gram + 1)
    new = ok.copy()
    new[1:] &= ~ok[:-1] | (least[1:] != least[:-1])
    start = np.flatnonzero(new)
    stop = np.append(np.flatnonzero(new | ~ok), len(ok))
    size = stop[np.searchsorted(stop, start, side="right")] - start
    sums = np.zeros(len(w.hashes) + 1, dtype=np.uint64)
    np.cumsum(w.hashes * K.powers(_BASE, len(w.hashes)), out=sums[1:])
    end = start + size + window - 1
    block = K.mix((sums[end] - sums[start]) * K.powers(_BASE_INV, len(w.hashes))[start] + size.astype(np.uint64))
    return np.searchsorted(w.first, start, side="right") - 1, start, size, least[start], block


def owned(anchor_block: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hash of a block and the document that holds it."""
    return K.mix(anchor_block ^ K.mix(doc.astype(np.int64).view(np.uint64)))


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("doc_id").to_numpy(zero_copy_only=False)


def _parse(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.pieces(batches):
            w = K.words(b.column("text"))
            text, start, size, anchor, block = blocks(w, window, gram)
            at = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=b.num_rows))]).astype(np.int32)
            pos = (start - w.first[text]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(x)) for x in (anchor.view(np.int64), block.view(np.int64), pos, size.astype(np.int32))]
            sha = [hashlib.sha256(b" ".join(w.data[s:e].tobytes().split())).hexdigest() for s, e in zip(w.offsets[:-1], w.offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tid"), pa.array(np.diff(w.first)), pa.array(sha), *lists], names=["doc_id", "tid", "n_words", "kept_sha256", "anchor", "block", "pos", "size"])

    return run


def _members(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, tids = _ids(b), b.column("tid").to_numpy()
            counts = np.diff(b.column("anchor").offsets.to_numpy())
            anchor, block, pos, size = (b.column(k).flatten().to_numpy() for k in ("anchor", "block", "pos", "size"))
            hit = shared.value.test(anchor)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor[hit], block[hit], np.repeat(ids, counts)[hit], np.repeat(tids, counts)[hit], pos[hit], size[hit])], names=["anchor", "block", "doc_id", "tid", "pos", "size"])

    return run


def _single_windows(shared, window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.pieces(batches):
            w = K.words(b.column("text"))
            text, start, size, _, block = blocks(w, window, gram)
            ids, tids = _ids(b)[text], b.column("tid").to_numpy()[text]
            hit = shared.value.test(owned(block, ids))
            if not hit.any():
                continue
            size, first = size[hit], np.repeat(start[hit], size[hit])
            at = first + np.arange(len(first)) - np.repeat(np.cumsum(size) - size, size)
            found = K.windows(w.hashes, window)[at]
            text = np.repeat(text[hit], size)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(np.repeat(ids[hit], size)), pa.array(np.repeat(tids[hit], size)), pa.array((at - w.first[text]).astype(np.int32))], names=["w", "doc_id", "tid", "pos"])

    return run


def hits(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(parsed documents, matches): a match (doc_id, tid, pos, n_words, ref_doc_id, ref_pos) is a span that an earlier document has.

    ``tid`` is a hash of the text.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("tid"), "text")
    parsed = store.table(docs.mapInArrow(_parse(window, gram), PARSED), "parsed")
    known = parsed.filter(F.col("doc_id").isNotNull())
    active = store.table(
        known.select("doc_id", F.explode("anchor").alias("anchor")).groupBy("anchor")
        .agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("anchor"), "anchors")
    some = spark.sparkContext.broadcast(store.member_filter(active, "anchor", active.count()))
    members = store.table(
        known.select("doc_id", "tid", "anchor", "block", "pos", "size").mapInArrow(_members(some), MEMBER), "members")
    least = F.min(F.struct("doc_id", "pos"))
    index = store.table(members.groupBy("anchor", "block").agg(least.alias("ref")).select("anchor", "block", F.col("ref.doc_id").alias("lo"), F.col("ref.pos").alias("at")), "index")
    span = ["doc_id", "tid", "pos", "n_words", "ref_doc_id", "ref_pos"]
    held = members.join(index, ["anchor", "block"]).filter("lo < doc_id").withColumn("n_words", F.col("size") + (window - 1))
    held = held.withColumnsRenamed({"lo": "ref_doc_id", "at": "ref_pos"}).select(*span)

    # factor boundaries: anchors with blocks of different words
    edge = store.table(index.groupBy("anchor").agg(F.count("*").alias("n"), F.min("lo").alias("a"), F.max("lo").alias("b")).filter("n > 1 and a < b").select("anchor"), "split")
    edge = store.table(index.join(edge, "anchor", "left_semi").select("block", "lo"), "edges")
    keys = edge.mapInArrow(_owned_keys, "key long")
    few = spark.sparkContext.broadcast(store.member_filter(keys, "key", edge.count()))
    single = store.table(docs.filter(F.col("doc_id").isNotNull()).mapInArrow(_single_windows(few, window, gram), "w long, doc_id long, tid long, pos int"), "windows")
    first = single.groupBy("w").agg(least.alias("ref"), F.max("doc_id").alias("hi")).filter("ref.doc_id < hi")
    first = store.table(first.select("w", F.col("ref.doc_id").alias("ref_doc_id"), F.col("ref.pos").alias("ref_pos")), "least")
    loose = single.join(first, "w").filter("ref_doc_id < doc_id").withColumn("n_words", F.lit(window)).select(*span)
    return parsed, held.unionByName(loose)


def _owned_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(owned(b.column("block").to_numpy().view(np.uint64), b.column("lo").to_numpy()).view(np.int64))], names=["key"])


def factor(pos: np.ndarray, size: np.ndarray, ref: np.ndarray, ref_pos: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Greedy parse of one text from its matches: factors (start, words, ref_doc_id, ref_pos), by start.

    Of matches that begin at a place the longest counts. One that copies on from where the factor is in the
    reference extends it; else it begins a factor of its own if it reaches past the last one's end.
    """
    order = np.lexsort((-(pos + size), pos))
    out: list[list[int]] = []
    for p, e, r, at in zip(*(x[order].tolist() for x in (pos, pos + size, ref, ref_pos)), strict=True):
        if out and p <= out[-1][1] and (r, at - p) == (out[-1][2], out[-1][3] - out[-1][0]):
            out[-1][1] = max(out[-1][1], e)
        elif not out or e > out[-1][1]:
            out.append([p, e, r, at])
    return [(a, b - a, r, at) for a, b, r, at in out]


def _parsed_hits(found: DataFrame) -> DataFrame:
    """(doc_id, tid, hits) of each text that has matches: at most a few a block of the text."""
    return found.groupBy("doc_id", "tid").agg(F.collect_set(F.struct("pos", "n_words", "ref_doc_id", "ref_pos")).alias("hits"))


def _factors_of(got: pa.ListScalar) -> list[tuple[int, int, int, int]]:
    return factor(*(got.values.field(k).to_numpy().astype(np.int64) for k in ("pos", "n_words", "ref_doc_id", "ref_pos")))


def factors(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The parse itself: factors (doc_id, start, n_words, ref_doc_id, ref_pos) of each text against earlier documents."""
    names = ["doc_id", "start", "n_words", "ref_doc_id", "ref_pos"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(d, *x) for d, got in zip(b.column("doc_id").to_pylist(), b.column("hits"), strict=True) for x in _factors_of(got)]
            cols = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], names=names)

    return _parsed_hits(hits(docs, window, gram)[1]).mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = {"n_words": [], "n_removed": [], "kept_sha256": [], "kept_text": []}
        for text, got in zip(b.column("text"), b.column("hits"), strict=True):
            words = (text.as_py() or "").encode().split()
            kept, at = [], 0
            for start, n, _, _ in _factors_of(got):  # literals between factors stay
                kept += words[at:start]
                at = max(at, start + n)
            kept += words[at:]
            joined = b" ".join(kept)
            for k, v in zip(out, (len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode()), strict=True):
                out[k].append(v)
        kinds = {"n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(), "kept_text": pa.string()}
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(v, kinds[k]) for k, v in out.items())], names=["doc_id", *out])


def _filtered(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(shared.value.test(K.mix(_ids(b).astype(np.int64).view(np.uint64)))))

    return run


def _mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(K.mix(_ids(b).astype(np.int64).view(np.uint64)).view(np.int64))], names=["key"])


def with_text(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text) of the documents in ``ids``, and a few more: a filter of fixed size spares the shuffle most others."""
    key = ids.select("doc_id").mapInArrow(_mixed, "key long")
    some = docs.sparkSession.sparkContext.broadcast(store.member_filter(key, "key", ids.count()))
    known = docs.select(F.col("doc_id").cast("long"), "text").filter(F.col("doc_id").isNotNull())
    return known.mapInArrow(_filtered(some), "doc_id long, text string")


def remove(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, texts: bool = False) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by a space).

    The words of the factors go. With ``texts``, also ``kept_text`` for the documents that lost words (else null).
    """
    parsed, found = hits(docs, window, gram)
    spans = store.table(_parsed_hits(found), "spans")
    own = with_text(docs, spans.select("doc_id")).withColumn("tid", F.xxhash64("text"))
    cut = own.join(spans, ["doc_id", "tid"]).mapInArrow(_remove, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    same = parsed.join(spans.select("doc_id", "tid"), ["doc_id", "tid"], "left_anti").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", F.lit(None).cast("string").alias("kept_text"))
    out = same.unionByName(cut)
    return out if texts else out.drop("kept_text")
