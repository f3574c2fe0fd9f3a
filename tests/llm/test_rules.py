import random
from collections import Counter

import numpy as np

from tests.llm import util
from tidemark.llm import rules


def base(text):
    t = text or ""
    w = util.words(t)
    n_chars = sum(len(x.decode()) for x in w)
    lines = [x for x in t.split("\n") if util.words(x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    wins = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often = Counter(wins)
    cover = {k for i, x in enumerate(wins) if often[x] > 1 for k in range(i, i + 5)}
    failed = len(w) < 10 or 100 * len(cover) > 20 * len(w)
    return (len(w), n_chars, sum(t.count(c) for c in "#*$%&|<>"), dup, len(cover), failed)


def test_counts(spark):
    rng = random.Random(4)
    rows = list(util.AWKWARD)
    for i in range(120):
        words = [rng.choice(["a", "bb", "é!", "x#", "<|>", "%$", "Wörter"]) + str(rng.randrange(9)) for _ in range(rng.randint(0, 60))]
        rows.append((1000 + i, "".join(x + rng.choice([" ", "\n", " \n", "\t", "\n\n"]) for x in words) + rng.choice(["", "\n", "tail line\ntail line\n"])))
    got = rules.judge(util.docs(spark, rows))[0].collect()
    want = sorted(((i, *base(t)) for i, t in rows), key=str)
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted((tuple(r[c] for c in cols) for r in got), key=str) == want
    assert not any(r.kept for r in got if r.base_failed)
    assert rules.judge(util.docs(spark, []))[0].count() == 0


def test_em_finds_the_accuracies_of_planted_rules():
    rng = np.random.default_rng(1)
    n, k = 20_000, len(rules.RULES)
    good = rng.random(n) < 0.85
    right = np.linspace(0.75, 0.95, k)
    votes = np.full((n, k), rules.ABSTAIN)
    cast = rng.random((n, k)) < 0.7
    ok = rng.random((n, k)) < right
    votes[cast] = np.where(ok == good[:, None], rules.GOOD, rules.BAD)[cast]
    model = rules.fit(votes, np.ones(n))
    found = np.array([np.mean(x) for x in model.accuracies().values()])
    assert abs(model.prior - 0.85) < 0.02 and np.abs(found - right).max() < 0.05
    assert ((model.posterior(votes) > 0.5) == good).mean() > 0.97


def test_good_stays_and_bad_goes(spark):
    rng = random.Random(9)
    stock = [f"{a}{b}" for a in ("the", "of", "to", "wander", "river", "mor") for b in ("", "s", "ing", "er", "ful")]
    good = [(i, " ".join(rng.choice(stock) for _ in range(80)) + ".") for i in range(300)]
    bad = [(1000 + i, " ".join(rng.choice(stock).upper() + "!!" for _ in range(80))) for i in range(15)]
    bad += [(2000 + i, " ".join(rng.choice(stock) + "***" for _ in range(80))) for i in range(15)]
    kept = {r.doc_id for r in rules.judge(util.docs(spark, good + bad))[0].filter("kept").collect()}
    assert kept == {i for i, _ in good}
    again = {r.doc_id for r in rules.kept(util.docs(spark, good + bad)).collect()}
    assert again == kept
