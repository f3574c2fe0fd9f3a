"""Brute-force versions and awkward tables."""

from collections import defaultdict

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text, lower=False):
    raw = (text or "").encode()
    return (raw.translate(LOWER) if lower else raw).split()


def shingles(text, size):
    w = words(text, lower=True)
    if len(w) < size:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def components(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near(rows, size, percent):
    """component of each (doc_id, text)."""
    sets = {i: shingles(t, size) for i, t in rows}
    index = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            index[x].add(i)
    links = set()
    for i, s in sets.items():
        for j in {j for x in s for j in index[x] if j > i}:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                links.add((i, j))
    return components(sets, links), {i: len(s) for i, s in sets.items()}, len(links)


def docs(spark, rows):
    """(doc_id, text) or (doc_id, text, source) rows as a documents table."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DOCS)


AWKWARD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "One"), (6, "one two"), (7, "a b   c"), (8, "the same line\nthe same line\nthe same line"),
    (9, "x" * 70_000), (10, "w " * 30_000), (11, "w " * 30_000), (12, "Ünïcödé wörds in ä lîne"), (13, "a b c d e f g h i j"), (13, "a b c d e f g h i j"), (None, "a b c d e f g h i j"), (14, "A B C d e f g h i j"),
]
