import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import kernel as K
from tidemark.llm import store

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\t\x0b é\x1c", max_size=40)), min_size=1, max_size=8)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words_are_those_of_bytes_split(texts):
    w = K.words(pa.array(texts, pa.string()))
    want = [(t or "").encode().split() for t in texts]
    got = [[w.data[s:e].tobytes() for s, e in zip(w.starts[a:b], w.ends[a:b])] for a, b in zip(w.first[:-1], w.first[1:])]
    assert got == want
    flat = [x for t in want for x in t]
    seen = dict(zip(flat, w.hashes.tolist()))
    assert [seen[x] for x in flat] == w.hashes.tolist() and len(set(seen.values())) == len(seen)


def test_hashes_do_not_depend_on_where_a_word_stands():
    big = "x" * (K.LONG_WORD + 5)
    texts = ["filler " * 200_000 + "needle " + big, "needle", big]
    one = K.words(pa.array(texts))
    assert one.hashes[one.first[1] - 2] == one.hashes[one.first[1]]
    assert one.hashes[one.first[1] - 1] == one.hashes[one.first[2]]


def test_windows_equal_by_content():
    w = K.words(pa.array(["a b c d e f g h i j k l", "z a b c d e f g h i j k l"]))
    for size in (2, 5, 10):
        got = K.windows(w.hashes, size)
        ok = K.whole(w.first, size)
        n = 12 - size + 1
        assert (got[:n] == got[13 : 13 + n]).all() and ok[:n].all() and not ok[n:12].any()


def test_filter_never_loses_a_member(spark):
    keys = spark.range(5000).selectExpr("xxhash64(id) as k")
    f = store.member_filter(keys, "k", 5000)
    own = np.array([r.k for r in keys.collect()])
    assert f.test(own).all()
    assert f.test(np.random.default_rng(1).integers(-(2**63), 2**63, 20_000)).mean() < 0.1


def test_pieces_keep_rows():
    batch = pa.RecordBatch.from_pydict({"text": ["x" * 400_000] * 7 + [None]})
    got = list(K.pieces([batch]))
    assert sum(b.num_rows for b in got) == 8 and len(got) > 1
