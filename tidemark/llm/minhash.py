"""Near-duplicate documents by MinHash.

1. Each text becomes the set of its distinct word shingles; equal sets form a class, named by its
   least ``doc_id``, so copies, however many, go on as one.
2. Each class gets ``bands * rows`` universal-hash minima. Classes that agree on a band share a
   bucket. Bands and rows follow from the threshold (:func:`banding`), so that a pair just at it shares
   none with probability 3e-7 at most: 32 bands of 6 at 85%, 38 of 5 at 80%.
3. In each bucket all classes are paired with the least one only (a star). Signatures are compared
   first (8 bits of each minimum, 6 standard deviations below the threshold), then the full
   shingle sets decide. Linked classes are joined to components.
4. Only buckets that still hold several components can hide further links: there, the full sets are
   compared in blocks of bounded size, inside one task each, by an incidence matrix; each block gives
   at most as many links as it has members (a forest over components), never its pairs.
5. Components come from alternating large-star and small-star steps.

Defined results: a text without words (null, empty, blank) has the empty set, ``n_shingles`` 0 and
stays its own component; fewer words than a shingle: the whole sequence is one shingle; repeated
rows keep one row each, with equal results; a row whose ``doc_id`` is null is linked with nothing,
its component is null and it is kept; an empty table gives no rows. ``doc_id`` names one text. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import graph, store, substring
from tidemark.llm import kernel as K

SHINGLE, PERCENT = 3, 85
MINIMA, MISSED = 192, 3e-7
BLOCK, BLOCK_BYTES = 512, 1 << 20  # classes of a bucket, and bytes of their texts, compared with as many others at once
_rng = np.random.default_rng(20240229)
_A = (_rng.integers(0, 2**32, 1024, dtype=np.uint64).astype(np.uint32)) | np.uint32(1)
_B = _rng.integers(0, 2**32, 1024, dtype=np.uint64).astype(np.uint32)
SIGNED = "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>, sketch binary"


def shingle_sets(w: K.Runs, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle) of each distinct shingle of each text, by text."""
    text, found = [], []
    counts = np.diff(w.first)
    for k in range(1, size + 1):
        ok = K.whole(w.first, k)
        if k < size:  # texts with just k words
            only = np.zeros(len(w.hashes), dtype=bool)
            only[w.first[:-1][counts == k]] = True
            ok = only[: len(ok)]
        if ok.any():
            at = np.flatnonzero(ok)
            found.append(K.windows(w.hashes, k)[at] + np.uint64(k))
            text.append(np.searchsorted(w.first, at, side="right") - 1)
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    text, found = np.concatenate(text), np.concatenate(found)
    _, at = np.unique(K.mix(found ^ K.mix(text.astype(np.uint64))), return_index=True)
    at = at[np.argsort(text[at], kind="stable")]
    return text[at], found[at]


def banding(percent: int) -> tuple[int, int]:
    """Bands and rows: the most rows for which ``MINIMA`` minima miss a pair at ``percent`` with probability ``MISSED`` at most."""
    p = percent / 100
    for rows in range(MINIMA, 0, -1):
        if (1 - p**rows) ** (MINIMA // rows) <= MISSED:
            return MINIMA // rows, rows
    return min(len(_A), ceil(log(MISSED) / log(1 - p))), 1


def _sign(shingle: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.pieces(batches):
            text, found = shingle_sets(K.words(b.column("text"), lower=True), shingle)
            n = np.bincount(text, minlength=b.num_rows)
            some = np.flatnonzero(n)
            first = np.concatenate([[0], np.cumsum(n)])[some]
            keys = [np.zeros(b.num_rows, dtype=np.uint64) for _ in range(2)]
            band = np.zeros((b.num_rows, bands), dtype=np.uint64)
            sketch = np.zeros((b.num_rows, bands * rows), dtype=np.uint8)
            if len(some):
                for key, salt in zip(keys, (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179), strict=True):
                    key[some] = np.add.reduceat(K.mix(found ^ np.uint64(salt)), first)
                x = (found >> np.uint64(32)).astype(np.uint32)
                for i in range(bands):
                    mixed = np.full(len(some), K.mix_int(i + 1), dtype=np.uint64)
                    for j in range(rows):
                        k = i * rows + j
                        least = np.minimum.reduceat(x * _A[k] + _B[k], first)
                        mixed = K.mix(mixed ^ least.astype(np.uint64))
                        sketch[some, k] = (least * np.uint32(0x9E3779B1)) >> np.uint32(24)
                    band[some, i] = mixed
            at = pa.array(np.arange(0, (b.num_rows + 1) * bands, bands, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n), *(pa.array(k.view(np.int64)) for k in keys), pa.ListArray.from_arrays(at, pa.array(band.view(np.int64).ravel())), pa.array([r.tobytes() for r in sketch], pa.binary())],
                names=["doc_id", "n_shingles", "k1", "k2", "bands", "sketch"])

    return run


def least_agreement(percent: int, minima: int, deviations: float = 6.0) -> float:
    """Share of equal sketch bytes that a pair at the threshold falls below with probability 1e-9."""
    p = percent / 100
    p += (1 - p) / 256
    return p - deviations * np.sqrt(p * (1 - p) / minima)


def _agree(percent: int, minima: int):
    cut = least_agreement(percent, minima)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            na, nb = (b.column(k).to_numpy() for k in ("na", "nb"))
            sa, sb = (np.frombuffer(b"".join(b.column(k).to_pylist()), dtype=np.uint8).reshape(-1, minima) for k in ("sa", "sb"))
            ok = (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & ((sa == sb).mean(axis=1) >= cut)
            yield pa.RecordBatch.from_arrays([b.column(k).filter(pa.array(ok)) for k in ("a", "b")], names=["a", "b"])

    return run


def _confirm(shingle: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.pieces(batches, "ta"):
            keys = []
            for k in ("ta", "tb"):
                text, found = shingle_sets(K.words(b.column(k), lower=True), shingle)
                keys.append((text, K.mix(found ^ K.mix(text.astype(np.uint64)))))
            (ta, ka), (tb, kb) = keys
            _, at, _ = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
            both = np.bincount(ta[at], minlength=b.num_rows)
            union = np.bincount(ta, minlength=b.num_rows) + np.bincount(tb, minlength=b.num_rows) - both
            ok = pa.array((100 * both >= percent * union) & (both > 0))
            yield pa.RecordBatch.from_arrays([b.column("a").filter(ok), b.column("b").filter(ok)], names=["u", "v"])

    return run


def _confirmed(docs: DataFrame, pairs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough, as links (u, v)."""
    ids = store.table(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "candidates")
    texts = store.table(substring.with_text(docs, ids).join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"]), "texts")
    left, right = (texts.select(F.col("doc_id").alias(k), F.col("text").alias(f"t{k}")) for k in "ab")
    out = store.table(pairs.join(left, "a").join(right, "b").mapInArrow(_confirm(shingle, percent), "u long, v long"), "links")
    store.drop_table(texts)
    return out


def similar(text: np.ndarray, found: np.ndarray, m: int, percent: int) -> np.ndarray:
    """Which pairs of ``m`` shingle sets are similar enough (m x m), from the sets' incidence matrix."""
    n = np.bincount(text, minlength=m)
    _, column, times = np.unique(found, return_inverse=True, return_counts=True)
    both = np.full((m, m), float((times == m).sum()), dtype=np.float32)
    some = (times > 1) & (times < m)  # shared by all: counted; by none: no matter
    number = np.cumsum(some) - 1
    pick = some[column]
    rows, cols = text[pick], number[column[pick]]
    order = np.argsort(cols, kind="stable")
    rows, cols = rows[order], cols[order]
    for lo in range(0, int(some.sum()), 4096):
        i, j = np.searchsorted(cols, (lo, lo + 4096))
        part = np.zeros((m, min(4096, int(some.sum()) - lo)), dtype=np.float32)
        part[rows[i:j], cols[i:j] - lo] = 1
        both += part @ part.T
    union = n[:, None] + n[None, :] - both
    return (100 * both >= percent * union) & (both > 0)


def _across(shingle: int, percent: int):
    """Links that join components inside a block, or between two blocks, of one bucket: full sets decide, a forest goes out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = [], []
            for lo, hi, got in zip(*(batch.column(k).to_pylist() for k in ("lo", "hi")), batch.column("got"), strict=True):
                x = got.values
                rep, comp, block = (x.field(k).to_numpy() for k in ("rep", "comp", "block"))
                ok = similar(*shingle_sets(K.words(x.field("text"), lower=True), shingle), len(rep), percent)
                ok &= (comp[:, None] != comp[None, :]) & (block == lo)[:, None] & (block == hi)[None, :]
                root = {c: c for c in comp.tolist()}
                for i, j in np.argwhere(ok).tolist():
                    a, b = int(comp[i]), int(comp[j])
                    while root[a] != a:
                        a = root[a]
                    while root[b] != b:
                        b = root[b]
                    if a != b:
                        root[max(a, b)] = min(a, b)
                        u.append(int(rep[i]))
                        v.append(int(rep[j]))
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()) for k in (u, v)], names=["u", "v"])

    return run


def _merged(buckets: DataFrame) -> DataFrame:
    """Buckets (bucket, rep, comp, n) that overlap become one, where that makes fewer comparisons than all of them.

    Any union of buckets holds their pairs, so the labels may be as coarse as one exchange makes them: a
    bucket takes the least label that its members have from any of their buckets.
    """
    # what is joined to the rows of a bucket is a table of one row a bucket, so that a hot bucket can be split
    least = store.table(buckets.groupBy("bucket").agg(F.min("rep").alias("lo")), "least")
    member = buckets.join(least, "bucket").groupBy("rep").agg(F.min("lo").alias("lo"))
    label = store.table(buckets.join(member, "rep").groupBy("bucket").agg(F.min("lo").alias("component"), F.first("n").alias("size")), "labels")
    sizes = buckets.join(label, "bucket").select("component", "rep").distinct().groupBy("component").agg(F.count("*").alias("m"))
    costs = store.table(label.groupBy("component").agg(F.sum(F.col("size") * F.col("size")).alias("apart")).join(sizes, "component"), "costs")
    label = store.table(label.join(costs, "component").select("bucket", "component", "m", (F.col("m") * F.col("m") <= F.col("apart")).alias("one")), "labels")
    known = buckets.join(label, "bucket")
    one = known.filter("one").select(F.lit(1).alias("kind"), F.col("component").alias("bucket"), "rep", "comp", F.col("m").alias("n")).distinct()
    return one.unionByName(known.filter("not one").select(F.lit(0).alias("kind"), "bucket", "rep", "comp", "n"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, bands: int | None = None, rows: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and class_id (least doc_id with the same shingle set) of each row."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    if bands is None or rows is None:
        bands, rows = banding(percent)
    minima = bands * rows
    signed = store.table(docs.mapInArrow(_sign(shingle, bands, rows), SIGNED), "signed")
    classes = store.table(
        signed.filter("n_shingles > 0 and doc_id is not null").groupBy("k1", "k2")
        .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "classes")
    banded = classes.select("rep", F.explode("bands").alias("bucket"))
    shared = store.table(banded.groupBy("bucket").agg(F.min("rep").alias("pivot"), F.count("*").alias("n")).filter("n > 1"), "buckets")
    members = store.table(banded.join(shared, "bucket"), "members")

    sketches = classes.select("rep", "n_shingles", "sketch")
    star = members.filter("rep > pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    for k in "ab":
        star = star.join(sketches.select(F.col("rep").alias(k), F.col("n_shingles").alias(f"n{k}"), F.col("sketch").alias(f"s{k}")), k)
    links = _confirmed(docs, store.table(star.mapInArrow(_agree(percent, minima), "a long, b long"), "pairs"), shingle, percent)
    known = store.table(graph.components(links), "components")

    # buckets whose other members still lie in several components; of buckets with the same members one is enough
    rest = members.filter("n > 2 and rep > pivot").join(known.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "rep", F.coalesce("component", "rep").alias("comp"))
    mixed = rest.groupBy("bucket").agg(
        F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("n"),
        F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("same")).filter("c0 < c1")
    mixed = mixed.groupBy("n", "same").agg(F.min("bucket").alias("bucket")).select("bucket", "n")
    open_ = store.table(rest.join(mixed, "bucket"), "open")
    if open_.limit(1).count():
        open_ = store.table(_merged(open_), "open")
        ids = store.table(open_.select(F.col("rep").alias("doc_id")).distinct(), "candidates")
        texts = store.table(substring.with_text(docs, ids).join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"]).withColumnRenamed("doc_id", "rep"), "texts")
        sized = open_.join(texts.select("rep", F.octet_length("text").alias("bytes")), "rep")
        parts = F.ceil(F.greatest(F.col("n") / BLOCK, F.sum("bytes") / BLOCK_BYTES)).cast("int")
        parts = sized.groupBy("kind", "bucket", "n").agg(parts.alias("parts")).select("kind", "bucket", "parts")
        dealt = open_.join(parts, ["kind", "bucket"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).join(texts, "rep")
        blocks = dealt.groupBy("kind", "bucket", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")).agg(F.collect_list(F.struct("rep", "comp", "block", "text")).alias("got"))  # two blocks at most
        more = store.table(blocks.mapInArrow(_across(shingle, percent), "u long, v long").distinct(), "links")
        store.drop_table(texts)
        if more.limit(1).count():
            known = store.table(graph.components(links.unionByName(more)), "components")

    named = classes.select("k1", "k2", "rep").join(known.withColumnRenamed("node", "rep"), "rep", "left").select("k1", "k2", F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", "k1", "k2").join(named, ["k1", "k2"], "left")
    linked = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    return out.select(
        "doc_id", "n_shingles",
        F.when(linked, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(linked, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
