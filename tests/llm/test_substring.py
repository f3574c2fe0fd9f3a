import hashlib
import random

from tests.llm import util
from tidemark.llm import substring


def brute(rows, window):
    first = {}
    for i, t in rows:
        if i is not None:
            w = util.words(t)
            for k in range(len(w) - window + 1):
                key = tuple(w[k : k + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = util.words(t)
        gone = set()
        if i is not None:
            for k in range(len(w) - window + 1):
                if first[tuple(w[k : k + window])] < i:
                    gone.update(range(k, k + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows, window, gram):
    got = sorted(map(tuple, substring.remove(util.docs(spark, rows), window, gram).collect()), key=str)
    assert got == brute(rows, window)
    return sum(r[2] for r in got)


def test_passages_edits_and_overlaps(spark):
    rng = random.Random(2)
    passages = [[f"p{k}_{i}" for i in range(rng.randint(8, 60))] for k in range(12)]
    rows = []
    for d in range(150):
        w = []
        for _ in range(rng.randint(0, 6)):
            p = list(rng.choice(passages))
            lo = rng.randrange(len(p))
            p = p[lo : lo + rng.randint(3, 60)]
            if p and rng.random() < 0.3:
                p[rng.randrange(len(p))] = "edit"
            w += p + [f"x{rng.randrange(50)}" for _ in range(rng.randint(0, 12))]
        rows.append((rng.randrange(10**6), " ".join(w)))
    assert check(spark, rows, 10, 4) > 1000


def test_runs_of_one_word_and_small_alphabets(spark):
    rng = random.Random(7)
    rows = [(d, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 120)))) for d in range(60)] + [(100 + d, "a " * (10 * d)) for d in range(8)]
    check(spark, rows, 12, 3)


def test_awkward_rows(spark):
    rows = util.AWKWARD + [(50 + i, "k " * 10 + "passage of many words that two hundred documents share word by word " * 5) for i in range(200)]
    check(spark, rows, 50, 8)
    assert substring.remove(util.docs(spark, [])).count() == 0


def test_factors_cover_what_is_removed(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(1, text), (2, "new words " + text + " end"), (3, text + " " + text)]
    got = {(r.doc_id, r.start, r.n_words, r.ref_doc_id) for r in substring.factors(util.docs(spark, rows)).collect()}
    assert (2, 2, 80, 1) in got and {r[0] for r in got} == {2, 3}
    kept = {r.doc_id: r.kept_text for r in substring.remove(util.docs(spark, rows), texts=True).collect()}
    assert kept[2] == "new words end" and kept[3] == "" and kept[1] is None


def test_two_texts_of_one_id_and_clashing_columns(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(70)) for c in "ab")
    rows = [(1, one), (2, "x " + one), (2, two + " y"), (3, two), (3, two), (None, one)]
    docs = util.docs(spark, rows).selectExpr("*", "1 as tid", "2 as pos", "'z' as anchor", "3 as n_words", "4 as hits")
    got = sorted(map(tuple, substring.remove(docs).collect()), key=str)
    assert got == brute(rows, 50) and sum(r[2] for r in got) == 70 + 2 * 70


def test_factors_copy_from_one_place_of_one_document(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows = [(1, " ".join(words))]
    for d in range(2, 30):
        lo, at = rng.randrange(300), rng.randrange(300)
        rows.append((d, " ".join([*words[lo : lo + rng.randint(5, 100)], f"own{d}", *words[at : at + 90]])))
    texts = {i: t.split() for i, t in rows}
    removed = dict((i, n) for i, _, n, _ in brute(rows, 10))
    covered = {i: set() for i in texts}
    for r in substring.factors(util.docs(spark, rows), 10, 4).collect():
        assert r.n_words >= 10 and r.ref_doc_id < r.doc_id
        assert texts[r.doc_id][r.start : r.start + r.n_words] == texts[r.ref_doc_id][r.ref_pos : r.ref_pos + r.n_words]
        covered[r.doc_id] |= set(range(r.start, r.start + r.n_words))
    assert {i: len(c) for i, c in covered.items()} == removed
