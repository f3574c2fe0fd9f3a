"""The pipeline on planted rows, and the registered queries on the smallest tables."""

import random
from collections import Counter, defaultdict

import corpus_pipeline
import pytest

import __spark_entry__
from tests.compare import compare, connect
from tests.llm import util
from tidemark.llm import mixing, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = random.Random(11)
    stock = [f"{a}{b}" for a in ("the", "of", "to", "wander", "river", "mor", "len", "stra") for b in ("", "s", "ing", "er", "ful", "ly")]
    say = lambda n: " ".join(rng.choice(stock) for _ in range(n)) + "."
    passage = say(40)
    rows = [(i, say(120), f"s{i % 3}") for i in range(240)]
    copies = [(1000 + i, rows[i][1], "s0") for i in range(20)]
    near = []
    for i in range(20, 40):
        w = rows[i][1].split()
        w[5] = "edited"
        near.append((1000 + i, " ".join(w), "s1"))
    leaks = [(2000 + i, say(50) + " " + passage + " " + say(50), "s2") for i in range(15)]
    bad = [(3000 + i, " ".join(rng.choice(stock).upper() + "!!" for _ in range(60)), "s1") for i in range(12)]
    folder = tmp_path_factory.mktemp("planted")
    util.docs(spark, rows + copies + near + leaks + bad + util.AWKWARD).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_stages_drop_what_was_planted_and_keep_the_rest(spark, planted):
    docs = spark.read.parquet(f"{planted}/documents.parquet")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    by = dict(corpus_pipeline.STAGES)
    assert list(by) == ["quality rules", "near duplicates", "benchmark decontamination", "mixing", "sharding"]
    good = by["quality rules"](spark, docs, planted).cache()
    assert good.columns == docs.columns and not ids(good) & set(range(3000, 3012)) and set(range(240)) <= ids(good)
    single = by["near duplicates"](spark, good, planted).cache()
    named = [(r.doc_id, r.text) for r in good.collect() if r.doc_id is not None]
    comp, _, _ = util.near(named, 5, 80)
    assert ids(single.filter("doc_id is not null")) == {i for i, c in comp.items() if i == c} and single.columns == docs.columns
    clean = by["benchmark decontamination"](spark, single, planted).cache()
    assert ids(single) - ids(clean) == set(range(2000, 2015))
    mixed = by["mixing"](spark, clean, planted).cache()
    assert mixed.columns == docs.columns and ids(mixed) <= ids(clean)
    last = by["sharding"](spark, mixed, planted)
    count = Counter(r.shard for r in last.collect())
    assert sum(count.values()) == mixed.count() and max(count.values()) - min(count.values()) <= 1


def test_mixing_keeps_all_it_is_given(spark, planted):
    docs = spark.read.parquet(f"{planted}/documents.parquet")
    assert dict(corpus_pipeline.STAGES)["mixing"](spark, docs, planted).count() == docs.count()


def test_run_is_the_stages_in_order(spark, planted):
    out = corpus_pipeline.run(spark, planted)
    assert out.count() > 150 and {"doc_id", "shard", "slot"} <= set(out.columns)


def test_shards_hold_the_mix_in_its_order(spark, planted):
    """What the mix decides has to be found in the shards, though its files are read in another order than they were written."""
    docs = spark.read.parquet(f"{planted}/documents.parquet").filter("doc_id is not null")
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, planted).cache()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several files, though they are small
    try:
        mix = {r.doc_id: r for r in mixing.mix(docs).collect()}
        got = [r for r in corpus_pipeline.run(spark, planted).collect() if r.doc_id is not None]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({r.doc_id for r in got}) == len(got) == len(mix) > 200
    shards = defaultdict(list)
    for r in sorted(got, key=lambda r: r.slot):
        shards[r.shard].append(mix[r.doc_id])
    held = defaultdict(list)
    for rows in shards.values():
        assert [r.position for r in rows] == sorted(r.position for r in rows)
        for source in ("s0", "s1", "s2"):
            held[source].append(sum(r.source == source for r in rows))
    # one more where the dealing of a source begins or ends, and one for the row without doc_id
    assert len(shards) == 24 and all(max(n) - min(n) <= 2 for n in held.values())


def test_all_ten_and_the_pipeline_are_registered(spark):
    names = __spark_entry__.queries()
    assert {n for n in names if n.startswith("op")} == set(queries.QUERIES) and len(queries.QUERIES) == 10 and "pipeline" in names


@pytest.mark.parametrize("name", ["op1_url_filters", "op3_conversations", "op4_mixing", "op5_quality_classifier", "op6_token_shards", "op7_quality_rules", "op9_sharding"])
def test_each_row_has_its_result(spark, name):
    out = queries.QUERIES[name](spark, SF)
    table = {"op1": "pages", "op3": "conversations"}.get(name.split("_")[0], "documents")
    rows = spark.read.parquet(f"{SF}/{table}.parquet").count()
    got = out.count()
    assert got >= rows if name.startswith("op6") else got == rows


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_operators_that_sql_can_express(spark, name):
    assert compare(spark, connect(SF), queries.QUERIES[name], queries.ORACLE_SQL[name], SF) is None


def test_columns_of_any_name_come_through_all_stages(spark, planted):
    names = ["slot", "target", "_key", "_row", "key", "tid", "votes", "item", "_bucket", "count", "kept", "rep"]
    docs = spark.read.parquet(f"{planted}/documents.parquet").filter("doc_id is null or doc_id < 60 or doc_id >= 1000")
    docs = docs.selectExpr("*", *(f"concat('{n}', cast(doc_id as string)) as `{n}`" for n in names))
    want, columns = set(docs.collect()), docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, planted).cache()
        assert docs.columns == columns and set(docs.collect()) <= want, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, planted).count() == docs.count() > 40


def test_stages_on_empty_tables_nulls_and_repeats(spark, planted):
    docs = spark.read.parquet(f"{planted}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), planted).count() == 0
    rows = util.docs(spark, [(1, "a b c d e f g"), (1, "a b c d e f g"), (1, "quite another text of seven words"), (None, "a b c d e f g"), (2, None), (2, None), (3, "")])
    by = dict(corpus_pipeline.STAGES)
    key = lambda r: (str(r.doc_id), str(r.text))
    got = sorted(map(key, by["near duplicates"](spark, rows, planted).collect()))
    assert got == [("1", "a b c d e f g"), ("1", "quite another text of seven words"), ("2", "None"), ("3", ""), ("None", "a b c d e f g")]
    for name in ("benchmark decontamination", "mixing"):
        assert sorted(map(key, by[name](spark, rows, planted).collect())) == sorted(map(key, rows.collect()))
    assert by["quality rules"](spark, rows, planted).count() == 0 and by["sharding"](spark, rows, planted).count() == 7
