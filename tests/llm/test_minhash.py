import random

from tests.llm import util
from tidemark.llm import graph, minhash


def check(spark, rows, size=3, percent=85):
    named = [r for r in rows if r[0] is not None]
    comp, n, links = util.near(named, size, percent)
    got = minhash.near_duplicates(util.docs(spark, rows), size, percent).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (n[r.doc_id], comp[r.doc_id], comp[r.doc_id] == r.doc_id)
    return links


def family(rng, base, copies, edits, start):
    out = []
    for k in range(copies):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append((start + k, " ".join(w)))
    return out


def test_families_around_the_threshold(spark):
    """Many members of a family are similar to some but not to the least; all links must be found."""
    rng = random.Random(5)
    rows = []
    for f in range(6):
        base = [f"w{rng.randrange(500)}" for _ in range(120)]
        rows += family(rng, base, 60, 9, 1000 * (f + 1))
    rng.shuffle(rows)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    assert check(spark, rows) > 500
    check(spark, rows, 5, 80)


def test_chains_link_through_the_middle(spark):
    words = [f"w{i}" for i in range(200)]
    rows = [(k, " ".join(words[: 100 + 4 * k])) for k in range(25)]
    check(spark, rows)


def test_copies_and_awkward_rows(spark):
    rng = random.Random(1)
    base = [f"w{rng.randrange(99)}" for _ in range(60)]
    rows = util.AWKWARD + [(100 + i, " ".join(base)) for i in range(300)]
    check(spark, rows)
    assert minhash.near_duplicates(util.docs(spark, [])).count() == 0


def test_components_of_paths_and_stars(spark):
    rng = random.Random(3)
    ids = list(range(400))
    links = [(i, i + 1) for i in range(150)] + [(200, j) for j in range(201, 300)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    want = util.components(ids, [x for x in links if x[0] != x[1]])
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert all(want[k] == v for k, v in got.items()) and {k for a, b in links if a != b for k in (a, b)} == set(got)
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_bands_follow_from_the_threshold():
    assert minhash.banding(85) == (32, 6)
    for percent in (50, 70, 80, 85, 90, 95):
        bands, rows = minhash.banding(percent)
        assert (1 - (percent / 100) ** rows) ** bands <= 3e-7 and bands * rows <= 192
