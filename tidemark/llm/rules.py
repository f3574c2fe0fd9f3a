"""Quality rules by weak supervision.

Each rule votes good, bad or abstains on a document. Expectation-maximisation over the counts of
vote patterns (a Dawid-Skene model with two classes) estimates how often each rule votes each way
on good and on bad documents, and the posterior probability of good replaces "must pass every rule".

The driver sees one row per distinct vote pattern, 3**len(RULES) at most, for any input.

Defined results: a null or empty text has no words, fails the base rule and isn't kept; repeated
rows are judged alike, each on its own row; an empty table gives no rows. Other columns than
``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import kernel as K
from tidemark.llm import store

GOOD, ABSTAIN, BAD = 2, 1, 0
MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW = 10, 20, 5


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


_SYMBOL, _UPPER, _BANG, _DIGIT = _class(b"#*$%&|<>"), _class(bytes(range(65, 91))), _class(b"!"), _class(b"0123456789")
_LETTER = _class(bytes([*range(65, 91), *range(97, 123), *range(0xC0, 0x100)]))  # lead bytes of other scripts count as letters
_POINT = np.ones(256, dtype=bool)
_POINT[0x80:0xC0] = False  # continuation bytes are no code points of their own


@dataclass
class Features:
    """Counts of each text of a batch."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_lines: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    n_upper: np.ndarray
    n_letters: np.ndarray
    n_bangs: np.ndarray
    n_digits: np.ndarray
    n_short_words: np.ndarray
    n_letterless: np.ndarray


def features(texts: pa.Array) -> Features:
    w = K.words(texts)
    data, offsets, n = w.data, w.offsets, len(w.offsets) - 1
    count = lambda table: K.per_text(table[data], offsets)
    words = np.diff(w.first)

    points = np.concatenate([[0], np.cumsum(_POINT[data], dtype=np.int64)])
    chars = points[w.ends] - points[w.starts]
    letters = np.concatenate([[0], np.cumsum(_LETTER[data], dtype=np.int64)])

    ln = K.lines(data, offsets)
    begun = np.searchsorted(w.starts, ln.starts)
    worded = (begun < len(w.starts)) & (np.append(w.starts, np.iinfo(np.int64).max)[begun] < ln.ends)
    # a line begins at its first byte other than \n; blanks belong to it
    owner, hashes = ln.owner()[worded], ln.hashes[worded]
    _, at = np.unique(K.mix(hashes ^ K.mix(owner.astype(np.uint64))), return_index=True)
    lines = np.bincount(owner, minlength=n)
    dup_lines = lines - np.bincount(owner[at], minlength=n)

    covered = np.zeros(len(w.hashes) + 1, dtype=np.int64)
    if len(w.hashes) >= REPEAT_WINDOW:
        ok = np.flatnonzero(K.whole(w.first, REPEAT_WINDOW))
        five = K.windows(w.hashes, REPEAT_WINDOW)[ok]
        five = K.mix(five ^ K.mix(w.owner()[ok].astype(np.uint64)))
        order = np.argsort(five)
        same = five[order][1:] == five[order][:-1]
        twice = np.zeros(len(five), dtype=bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        hit = ok[twice]
        np.add.at(covered, hit, 1)
        np.add.at(covered, hit + REPEAT_WINDOW, -1)
    repeat = K.per_text(np.cumsum(covered)[:-1] > 0, w.first)
    return Features(
        words, K.per_text(chars, w.first), count(_SYMBOL), lines, dup_lines, repeat,
        count(_UPPER), count(_LETTER), count(_BANG), count(_DIGIT), K.per_text(chars <= 3, w.first),
        K.per_text(letters[w.ends] == letters[w.starts], w.first),
    )


def base_failed(f: Features) -> np.ndarray:
    return (f.n_words < MIN_WORDS) | (100 * f.n_repeat_words > MAX_REPEAT_PERCENT * f.n_words)


def vote(x: np.ndarray, good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    return np.where(bad, BAD, np.where(good, GOOD, ABSTAIN)).astype(np.int64) + 0 * x.astype(np.int64)


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def _between(x: np.ndarray, lo: float, hi: float) -> np.ndarray:
    return (x >= lo) & (x <= hi)


def _rule(share: Callable[[Features], np.ndarray], good: float, bad: float) -> Callable[[Features], np.ndarray]:
    """Good up to ``good``, bad above ``bad``."""

    def judge(f: Features) -> np.ndarray:
        x = share(f)
        return vote(x, x <= good, x > bad)

    return judge


def _length(f: Features) -> np.ndarray:
    return vote(f.n_words, f.n_words >= 40, f.n_words < 5)


def _word_length(f: Features) -> np.ndarray:
    x = _share(f.word_chars, f.n_words)
    return vote(x, _between(x, 3, 9), (x < 2) | (x > 14))


def _short_words(f: Features) -> np.ndarray:
    x = _share(f.n_short_words, f.n_words)
    return vote(x, _between(x, 0.1, 0.6), (x < 0.03) | (x > 0.9))


def _dup_lines(f: Features) -> np.ndarray:
    x = _share(f.n_dup_lines, f.n_lines)
    return vote(x, (f.n_lines >= 3) & (x == 0), x > 0.3)


RULES: dict[str, Callable[[Features], np.ndarray]] = {
    "length": _length,
    "word_length": _word_length,
    "short_words": _short_words,
    "symbols": _rule(lambda f: _share(f.n_symbols, f.n_words), 0.05, 0.3),
    "letterless": _rule(lambda f: _share(f.n_letterless, f.n_words), 0.05, 0.2),
    "dup_lines": _dup_lines,
    "repeats": _rule(lambda f: _share(f.n_repeat_words, f.n_words), 0.02, 0.2),
    "capitals": _rule(lambda f: _share(f.n_upper, f.n_letters), 0.15, 0.4),
    "bangs": _rule(lambda f: _share(f.n_bangs, f.n_words), 0.05, 0.3),
    "digits": _rule(lambda f: _share(f.n_digits, f.word_chars), 0.05, 0.25),
}


def votes(f: Features) -> np.ndarray:
    """One number per text, a base-3 digit per rule."""
    out = np.zeros(len(f.n_words), dtype=np.int64)
    for judge in RULES.values():
        out = out * 3 + judge(f)
    return out


def unpack(pattern: np.ndarray) -> np.ndarray:
    """Votes (pattern x rule)."""
    n = len(RULES)
    return (pattern[:, None] // 3 ** np.arange(n - 1, -1, -1)[None, :]) % 3


@dataclass
class VoteModel:
    """P(good) and, for each rule, P(vote | class); class 1 is good."""

    prior: float
    table: np.ndarray  # class x rule x vote

    def posterior(self, v: np.ndarray) -> np.ndarray:
        log = np.log(self.table)
        rule = np.arange(v.shape[1])
        bad, good = (log[c][rule, v].sum(axis=1) for c in (0, 1))
        return 1 / (1 + np.exp(np.clip(bad + np.log1p(-self.prior) - good - np.log(self.prior), -700, 700)))

    def accuracies(self) -> dict[str, tuple[float, float]]:
        """Of each rule's votes that aren't abstentions: share right on good, on bad documents."""
        t = self.table
        return {k: (t[1, i, GOOD] / (t[1, i, GOOD] + t[1, i, BAD]), t[0, i, BAD] / (t[0, i, GOOD] + t[0, i, BAD])) for i, k in enumerate(RULES)}


#: Pseudo-counts of a rule's votes in each class: before any document is seen, a good one draws good votes. They keep the classes from swapping.
_PRIOR = {1: np.array([0.5, 2.0, 4.0]), 0: np.array([4.0, 2.0, 1.0])}


def fit(v: np.ndarray, counts: np.ndarray, rounds: int = 200, tol: float = 1e-9, bad_share: float = 0.1) -> VoteModel:
    """EM from the start that a document with any bad vote is likelier bad, the more of them the likelier."""
    bad = (v == BAD).sum(axis=1)
    q = np.where(bad == 0, 0.98, np.where(bad == 1, 0.4, 0.05))
    seen = np.stack([v == k for k in range(3)], axis=2).astype(float)  # pattern x rule x vote
    model, last = VoteModel(1 - bad_share, np.full((2, v.shape[1], 3), 1 / 3)), -np.inf
    for _ in range(rounds):
        table = np.empty((2, v.shape[1], 3))
        for c, share in ((1, q), (0, 1 - q)):
            got = np.einsum("p,prv->rv", share * counts, seen) + _PRIOR[c]
            table[c] = got / got.sum(axis=1, keepdims=True)
        total = counts.sum()
        prior = float((q @ counts + 9) / (total + 10))
        model = VoteModel(prior, table)
        q = model.posterior(v)
        moved = float(np.abs(q - last).max()) if np.ndim(last) else np.inf
        last = q.copy()
        if moved < tol:
            break
    return model


#: Most rules find no defect in most bad documents, which the model, taking rules as independent, counts in their favour; so good has to be near certain.
KEEP_FROM = 0.9

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, votes long"


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in K.pieces(batches):
        f = features(b.column("text"))
        cols = [b.column("doc_id").cast(pa.int64()), *(pa.array(x.astype(np.int64)) for x in (f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words)), pa.array(base_failed(f)), pa.array(votes(f))]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "votes"])


def _model(seen: DataFrame) -> tuple[DataFrame, VoteModel]:
    """(votes, p_good) of each vote pattern, and the model fitted to the patterns of all documents."""
    found = seen.groupBy("votes").count().toArrow()  # 3**len(RULES) rows at most
    pattern, counts = (found.column(k).to_numpy().astype(np.int64) for k in ("votes", "count"))
    order = np.argsort(pattern)
    pattern, counts = pattern[order], counts[order]
    model = fit(unpack(pattern), counts.astype(float)) if len(pattern) else VoteModel(0.9, np.full((2, len(RULES), 3), 1 / 3))
    posterior = model.posterior(unpack(pattern)) if len(pattern) else np.zeros(0)
    rows = [(int(p), float(x)) for p, x in zip(pattern, posterior, strict=True)]
    return seen.sparkSession.createDataFrame(rows, "votes long, p_good double"), model


def judge(docs: DataFrame, threshold: float = KEEP_FROM) -> tuple[DataFrame, VoteModel]:
    """Counts, vote pattern, posterior ``p_good`` and ``kept`` of each document, and the fitted model."""
    seen = store.table(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_judge, SCHEMA), "rules")
    lookup, model = _model(seen)
    out = seen.join(F.broadcast(lookup), "votes")
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold)), model


@F.arrow_udf(T.StructType([T.StructField("votes", T.LongType()), T.StructField("failed", T.BooleanType())]))
def _votes(texts: pa.Array) -> pa.Array:
    """Votes and base rule of each text; only texts go to Python, and a row's other columns stay where they are."""
    got = []
    for b in K.pieces([pa.RecordBatch.from_arrays([texts], names=["text"])]):
        f = features(b.column("text"))
        got.append((votes(f), base_failed(f)))
    v, failed = (np.concatenate([x[i] for x in got]) if got else np.zeros(0, dtype=t) for i, t in ((0, np.int64), (1, bool)))
    return pa.StructArray.from_arrays([pa.array(v), pa.array(failed)], names=["votes", "failed"])


def kept(docs: DataFrame, threshold: float = KEEP_FROM) -> DataFrame:
    """The documents, with all their columns, that :func:`judge` keeps. Nothing is shuffled.

    Texts are judged once; rows are written with their votes, and read again when these have fitted the model.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    marked = docs.select(row, _votes("text").alias("_v")).select("_row", "_v.votes", "_v.failed")
    marked = store.table(marked, "votes")
    lookup, _ = _model(marked)
    good = lookup.filter(F.col("p_good") >= threshold).select("votes")
    out = marked.filter("not failed").join(F.broadcast(good), "votes", "left_semi")
    return out.select(*(F.col("_row").getField(c).alias(c) for c in docs.columns))
