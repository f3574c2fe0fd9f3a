"""Benchmark passages in training documents, by spaced seeds.

Fixed masks select some of ``SPAN`` consecutive tokens and ignore the others, so a seed survives
substitutions in the ignored places. Shorter items have masks over their whole length (:func:`own_masks`).

1. The seeds of all benchmark items under all masks are a table. A membership filter of a fixed greatest size
   over them goes to the executors, so that of the documents' seeds only those that may occur are shuffled.
2. The seeds of documents are joined to those of items; a hit is a text, an item and a diagonal.
3. Texts that have hits meet the items they hit, and are compared token by token along each diagonal. Of the
   segments in which at least four of five tokens are equal, the one with most equal tokens is an overlap if these
   are ``min_matched``, or 80% of a shorter item.

Tokens: ASCII punctuation is dropped, A-Z lower-cased, split at blanks. An item of fewer than ``LEAST_ITEM`` tokens
can't be told from chance inside a text; it is found where it is the whole text.

Equal texts are one text until the end, and equal items one item, so copies cost one comparison; each document reads
once, whatever the size of the benchmark. Texts and items are known by 64-bit hashes.

Defined results: null or empty texts, items or tables overlap with nothing; a null ``item_id`` or
``doc_id`` is carried as null; repeated rows are reported once each; other columns pass through
``clean`` unread, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import kernel as K
from tidemark.llm import store

MASKS = ("1101001011", "1110010101", "1011100011")
SPAN = len(MASKS[0])
LEAST_ITEM, MIN_MATCHED, MISMATCH = 5, 13, 4
LONGEST_OWN = 14  # tokens of the longest items that have masks over their whole length
CANDIDATES = 2048  # hits of one text compared at once
_WHOLE = np.uint64(0xA24BAED4963EE407)
_PUNCTUATION = np.zeros(256, dtype=bool)
_PUNCTUATION[[i for i in range(0x21, 0x7F) if not chr(i).isalnum()]] = True


def own_masks(n: int) -> list[str]:
    """Masks over all of an item of ``n`` tokens: whatever fifth of them is substituted, one mask ignores it.

    One substitution (5 to 9 tokens): each ignores every third place. Two (10 to 14): each ignores two of four
    residues. Shorter: none is ignored.
    """
    if n < LEAST_ITEM:
        return ["1" * n]
    if n > LONGEST_OWN:
        return []
    step, out = (3, 1) if n < 10 else (4, 2)
    return ["".join("0" if i % step in gone else "1" for i in range(n)) for gone in combinations(range(step), out)]


def tokens(texts: pa.Array) -> K.Runs:
    data, offsets = K.buffers(texts)
    keep = ~_PUNCTUATION[data]
    at = np.concatenate([[0], np.cumsum(keep)])
    return K.runs(data[keep], at[offsets], K.SPACE, lower=True)


def seeds(hashes: np.ndarray, mask: str) -> np.ndarray:
    """Seed of each position under a mask."""
    n = len(hashes) - len(mask) + 1
    out = np.full(max(n, 0), K.mix_int(int(mask, 2) + (len(mask) << 32)), dtype=np.uint64)
    for j, c in enumerate(mask):
        if n > 0 and c == "1":
            out = out * np.uint64(0x9FB21C651E98DF25) + hashes[j : j + n]
    return K.mix(out)


def segment(equal: np.ndarray) -> tuple[int, int]:
    """Begin and end of the segment with most equal tokens among those with at least four of five equal; the shortest of several."""
    sums = np.concatenate([[0], np.cumsum(np.where(equal, 1, -MISMATCH))])
    count = np.concatenate([[0], np.cumsum(equal)])
    # from each begin, the last end whose sum isn't below: it is the last whose later sums reach it
    reach = np.maximum.accumulate(sums[::-1])[::-1]
    end = np.searchsorted(-reach, -sums, side="right") - 1
    matched = count[end] - count
    end = np.maximum(np.searchsorted(count, count[end]), np.arange(len(end)))  # back to the last equal token
    begin = int((matched * len(sums) - (end - np.arange(len(end)))).argmax())
    return begin, int(end[begin])


def item_seeds(w: K.Runs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, seed, place) of all seeds of some items."""
    lens, owner = np.diff(w.first), w.owner()
    found = []
    for mask in MASKS:
        at = np.flatnonzero(K.whole(w.first, SPAN))
        found.append((owner[at], seeds(w.hashes, mask)[at], at - w.first[owner[at]]))
    for n in np.unique(lens[(lens > 0) & (lens <= LONGEST_OWN)]).tolist():
        item = np.flatnonzero(lens == n)
        for mask in own_masks(n):
            s = seeds(w.hashes, mask)[w.first[item]]
            found.append((item, s ^ _WHOLE if n < LEAST_ITEM else s, np.zeros(len(item), dtype=np.int64)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def text_seeds(w: K.Runs, lengths: list[int], member) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, seed, place) of the seeds of some texts that may be seeds of items with such ``lengths``."""
    lens = np.diff(w.first)
    for mask in [*(MASKS if max(lengths, default=0) >= SPAN else ()), *(m for n in lengths for m in own_masks(n))]:
        s = seeds(w.hashes, mask)
        if len(mask) < LEAST_ITEM:
            at = w.first[:-1][lens == len(mask)]
            s = s[at] ^ _WHOLE
            ok = member.test(s)
            at, s = at[ok], s[ok]
        else:
            at = np.flatnonzero(member.test(s))
            at = at[K.whole(w.first, len(mask))[at]] if len(at) else at
            s = s[at]
        text = np.searchsorted(w.first, at, side="right") - 1
        yield text, s, at - w.first[text]


def compare(text: np.ndarray, item: np.ndarray, start: int, min_matched: int) -> tuple[int, int, int, int] | None:
    """(matched, length, start in text, start in item) of the best overlap of an item that would start at ``start`` of a text."""
    least = min(min_matched, -(-4 * len(item) // 5))
    lo, hi = max(0, -start), min(len(item), len(text) - start)
    equal = text[start + lo : start + hi] == item[lo:hi]
    if equal.sum() < least or len(item) < LEAST_ITEM and not len(item) == len(text) == equal.sum():
        return None
    begin, end = segment(equal)
    matched = int(equal[begin:end].sum())
    return (matched, end - begin, start + lo + begin, lo + begin) if matched >= least else None


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in K.pieces(batches):
        w = tokens(b.column("text"))
        raw = [w.hashes[i:j].tobytes() for i, j in zip(w.first[:-1], w.first[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("item"), pa.array(np.diff(w.first)), pa.array(raw, pa.binary())], names=["item", "n", "tokens"])


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in K.pieces(batches):
        item, seed, at = item_seeds(tokens(b.column("text")))
        yield pa.RecordBatch.from_arrays([pa.array(b.column("item").to_numpy()[item]), pa.array(seed.view(np.int64)), pa.array(at)], names=["item", "seed", "at"])


def _text_seeds(shared, lengths: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.pieces(batches):
            tid = b.column("tid").to_numpy()
            for text, seed, at in text_seeds(tokens(b.column("text")), lengths, shared.value):
                yield pa.RecordBatch.from_arrays([pa.array(tid[text]), pa.array(seed.view(np.int64)), pa.array(at)], names=["tid", "seed", "pos"])

    return run


def _verify(min_matched: int):
    names = ["tid", "item", "n_matched", "n_overlap", "n_item", "doc_start", "item_start"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.pieces(batches):
            w, rows = tokens(b.column("text")), []
            for i, (tid, got) in enumerate(zip(b.column("tid").to_pylist(), b.column("got"), strict=True)):
                text, best = w.hashes[w.first[i] : w.first[i + 1]], {}
                x = got.values
                for item, start, raw in zip(x.field("item").to_pylist(), x.field("start").to_pylist(), x.field("tokens"), strict=True):
                    own = np.frombuffer(raw.as_buffer(), dtype=np.uint64)
                    if hit := compare(text, own, start, min_matched):
                        best[item] = max(best.get(item, ()), (hit[0], hit[1], len(own), *hit[2:]))
                rows += [(tid, item, *hit) for item, hit in best.items()]
            cols = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

    return run


def _overlaps(docs: DataFrame, items: DataFrame, min_matched: int) -> DataFrame:
    """Best overlap (tid, item, n_matched, n_overlap, n_item, doc_start, item_start) of each text (tid, text) and item (item, text)."""
    spark = docs.sparkSession
    items = store.table(items.filter(F.length("text") > 0).groupBy("item").agg(F.min("text").alias("text")), "items")
    known = store.table(items.mapInArrow(_items, "item long, n long, tokens binary").filter("n > 0"), "item-tokens")
    seeded = store.table(items.mapInArrow(_item_seeds, "item long, seed long, at long"), "item-seeds")
    lengths = sorted(r.n for r in known.filter(F.col("n") <= LONGEST_OWN).select("n").distinct().collect())  # LONGEST_OWN at most
    lengths += [LONGEST_OWN + 1] if known.filter(F.col("n") > LONGEST_OWN).limit(1).count() else []
    some = spark.sparkContext.broadcast(store.member_filter(seeded, "seed", 4 * seeded.count()))
    found = store.table(docs.mapInArrow(_text_seeds(some, lengths), "tid long, seed long, pos long"), "seeds")
    hits = found.join(seeded, "seed").select("tid", "item", (F.col("pos") - F.col("at")).alias("start")).distinct()
    hits = store.table(hits, "hits")
    # a text that hits very many items is compared in parts
    parts = hits.groupBy("tid").agg(F.ceil(F.count("*") / CANDIDATES).cast("int").alias("parts"))
    hits = hits.join(parts, "tid").withColumn("part", F.pmod(F.xxhash64("item"), F.col("parts"))).join(known, "item")
    hits = hits.groupBy("tid", "part").agg(F.collect_list(F.struct("item", "start", "tokens")).alias("got"))
    texts = store.maybe_in(docs, "tid", parts).join(parts.select("tid"), "tid", "left_semi").groupBy("tid").agg(F.min("text").alias("text"))
    out = store.table(hits.join(texts, "tid").mapInArrow(_verify(min_matched), "tid long, item long, n_matched long, n_overlap long, n_item long, doc_start long, item_start long"), "overlaps")
    for t in (items, seeded, found):
        store.drop_table(t)
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.xxhash64("text").alias("tid"), "text").filter(F.length("text") > 0)


def overlaps(docs: DataFrame, benchmark: DataFrame, min_matched: int = MIN_MATCHED) -> DataFrame:
    """One row per document and benchmark item it overlaps with: the best overlap."""
    items = benchmark.select(F.col("item_id").cast("long"), "text", F.xxhash64("text").alias("item"))
    found = _overlaps(_keyed(docs), items, min_matched)
    own = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("tid"))
    out = own.join(found.join(items.select("item_id", "item"), "item"), "tid")
    return out.select("doc_id", "item_id", "n_matched", "n_overlap", "n_item", "doc_start", "item_start")


def clean(docs: DataFrame, benchmark: DataFrame, min_matched: int = MIN_MATCHED) -> DataFrame:
    """The documents, with all their columns, that overlap with no benchmark item. Only those that may are shuffled."""
    items = benchmark.select("text", F.xxhash64("text").alias("item"))
    found = _overlaps(_keyed(docs), items, min_matched)
    return store.without(docs, F.xxhash64("text"), found.select(F.col("tid").alias("key")))
