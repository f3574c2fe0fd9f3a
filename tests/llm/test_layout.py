"""Mixing, sharding, token shards and conversations."""

import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import util
from tidemark.llm import conversations, mixing, sharding, tokens


def test_schedule_deviates_by_less_than_one_turn():
    rng = random.Random(1)
    for n in (1, 2, 5, 17):
        weights = {f"s{i}": rng.randint(1, 40) for i in range(n)}
        period = sum(weights.values())
        order = mixing.schedule(weights)
        assert Counter(order) == Counter(weights)
        seen = Counter()
        for t, k in enumerate(order * 2, 1):
            seen[k] += 1
            assert all(abs(seen[s] - Fraction(w * t, period)) < 1 for s, w in weights.items())


@pytest.mark.parametrize("weights", [{"a": 0.33349, "b": 0.33349, "c": 0.33302}, {"a": Fraction(1, 3), "b": Fraction(1, 3), "c": Fraction(1, 3) - Fraction(5, 10**4), "d": Fraction(5, 10**4)}, {f"s{i}": 1.7**-i for i in range(30)}, {"a": 3}])
def test_given_weights_are_met_to_less_than_a_block_of_two_turns(weights):
    exact = mixing.whole_weights(weights)
    total, slots = sum(exact.values()), 100_000
    assert all(Fraction(exact[a], total) * sum(map(Fraction, weights.values())) == Fraction(weights[a]) for a in weights)
    seen, t = Counter(), 0
    for start, got in mixing.frames(exact, slots, 7001):
        assert start == t and all(seen[k] == had for k, (had, _) in got.items())
        assert all(abs(seen[k] * total - w * t) < total for k, w in exact.items())  # less than one turn at the end of a frame
        for k in mixing.schedule({k: n for k, (_, n) in got.items()}):
            t += 1
            seen[k] += 1
            assert abs(seen[k] * total - exact[k] * t) < 2 * total and (t % 97 or all(abs(seen[s] * total - w * t) < 2 * total for s, w in exact.items()))
    assert t == slots


def test_mix_places_every_row(spark):
    rng = random.Random(2)
    rows = [(i, "t", None if i % 50 == 0 else f"s{min(int(rng.expovariate(0.5)), 5)}") for i in range(3000)] + [(7, "t", "s1")] * 3 + [(None, "t", "s0")]
    docs = util.docs(spark, rows).withColumnRenamed("lang", "slot")
    got = mixing.mix(docs, block=4).toPandas()
    assert len(got) == len(rows) and got.position.is_unique
    target = mixing.tempered(Counter("null" if r[2] is None else "=" + r[2] for r in rows))
    share = got[got.in_mix].source.fillna("null").value_counts(normalize=True)
    for k, w in target.items():
        assert abs(share[k.removeprefix("=")] - w) < 0.01
    assert (got[got.in_mix].groupby("slot").source.nunique(dropna=False) == 1).all()
    out = mixing.mixed(docs.drop("slot"), {"s0": 1, "s1": 1}, block=4)
    assert set(out.columns) == set(docs.columns) - {"slot"} and set(Counter(r.source for r in out.collect())) == {"s0", "s1"}
    assert mixing.mix(util.docs(spark, [])).count() == 0


def test_phases_place_every_turn_once_and_keep_weights():
    rng = random.Random(4)
    for n in (1, 2, 7, 40):
        turns = {f"s{i}": 1 + int(rng.expovariate(0.001)) for i in range(n)} | {"rare": 1}
        weights = {k: rng.random() + 0.01 for k in turns}
        seen, target, begun = {}, {}, []
        for phase, start, of, size, got in mixing.phases(weights, turns, 100):
            target.setdefault(phase, of)
            if len(begun) <= phase:
                begun.append(start)
            left = {k: first for k, (first, _) in got.items()}
            order = mixing.schedule({k: x for k, (_, x) in got.items()})
            assert len(order) == size
            for at, k in enumerate(order):
                if left[k] < turns[k]:
                    assert seen.setdefault(start + at, (k, left[k])) == (k, left[k])
                left[k] += 1
        assert len(seen) == sum(turns.values())
        order = [seen[s] for s in sorted(seen)]
        assert all([b for q, b in order if q == k] == list(range(total)) for k, total in turns.items())
        for phase, (a, b) in enumerate(zip(begun, [*begun[1:], max(seen) + 1])):
            assert sum(target[phase].values()) == 1
            part = Counter(seen[s][0] for s in seen if a <= s < b)
            for k, w in target[phase].items():
                if phase + 1 < len(begun) and k in target[phase + 1]:  # lasts to the phase's end
                    assert abs(part[k] - w * (b - a)) < 2


def test_position_of_each_row_by_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, "t", f"s{min(int(rng.expovariate(0.7)), 3)}") for i in range(700)]
    got = mixing.mix(util.docs(spark, rows), {"s0": 0.3, "s1": Fraction(1, 3), "s2": 0.1}, block=4, frame=64).collect()
    turns = {"=" + k: -(-n // 2) for k, n in Counter(r[2] for r in rows).items() if k != "s3"}
    slot = {}
    for phase, start, of, _, part in mixing.phases({"=s0": 0.3, "=s1": Fraction(1, 3), "=s2": 0.1}, turns, 64):
        at = {k: first for k, (first, _) in part.items()}
        for i, k in enumerate(mixing.schedule({k: n for k, (_, n) in part.items()})):
            slot[k, at[k]] = (start + i, phase, float(of[k]))
            at[k] += 1
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
    for k, some in by.items():
        if k == "s3":
            assert all(r.slot is None and not r.in_mix and r.position is None for r in some)
            continue
        some.sort(key=lambda r: r.position)
        want = [slot["=" + k, i // 2] for i in range(len(some))]
        assert [(r.slot, r.phase, r.target) for r in some] == want and [r.block_no for r in some] == [i // 4 for i in range(len(some))]
        assert [r.position for r in some] == [2 * s + i % 2 for i, (s, _, _) in enumerate(want)]


def test_mixed_returns_columns_of_any_name_unchanged(spark):
    rows = [(i, f"t{i}", f"s{i % 2}") for i in range(200)] + [(None, f"n{i}", None) for i in range(100)] + [(5, "t5", "s1")] * 20
    names = ["slot", "target", "position", "in_mix", "phase", "block_no", "_key", "_row", "_bucket", "_rank", "_turn", "_hash", "a.b"]
    docs = util.docs(spark, rows).selectExpr("*", *(f"concat('{n}', text) as `{n}`" for n in names), "map('k', text) as m")
    out = mixing.mixed(docs, block=4, frame=32)
    assert out.columns == docs.columns and out.schema == docs.schema
    key = lambda r: repr(r)
    assert sorted(out.collect(), key=key) == sorted(docs.collect(), key=key)


def test_a_rare_source_cuts_no_others(spark):
    rows = [(i, "t", f"s{i % 3}") for i in range(3000)] + [(5000, "t", None)]
    docs = util.docs(spark, rows)
    got = mixing.mix(docs, block=4).toPandas()
    assert len(got) == len(rows) and got.position.notna().all() and got.position.is_unique
    assert sorted(r.doc_id for r in mixing.mixed(docs, block=4).collect()) == sorted(r[0] for r in rows)
    rest = got[got.source.notna()].sort_values("position")
    assert all(abs(x - 1 / 3) < 0.03 for x in rest[: len(rest) // 2].source.value_counts(normalize=True))


def check_shards(got, rows, shards):
    count = Counter(r.shard for r in got)
    assert len(got) == len(rows) and max(count.values()) - min(count.values() if len(count) == shards else [0]) <= 1
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    places = defaultdict(set)
    for r in got:
        places[r.group].add(r.shard)
    return {g: s for g, s in places.items() if g is not None and len(s) > 1}


def test_shards_are_even_and_keep_groups(spark):
    rng = random.Random(3)
    rows = [(i, f"text {rng.randrange(250) if i % 3 else i}") for i in range(1200)] + util.AWKWARD
    got = sharding.assign(util.docs(spark, rows)).collect()
    assert not check_shards(got, rows, 24) and {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}


def test_a_group_of_a_third_of_all_rows_takes_as_few_shards_as_hold_it(spark):
    rows = [(i, "same" if i % 3 == 0 else f"t{i % 400}") for i in range(1000)]
    cut = check_shards(sharding.assign(util.docs(spark, rows)).collect(), rows, 24)
    assert [len(s) for s in cut.values()] == [8]  # 334 rows, 42 a shard


@pytest.mark.parametrize("n", [0, 1, 30])
def test_few_rows(spark, n):
    rows = [(i, "x") for i in range(n)]
    got = sharding.assign(util.docs(spark, rows)).collect()
    assert Counter(Counter(r.shard for r in got).values()) == Counter({k: c for k, c in ((n // 24, 24 - n % 24), (n // 24 + 1, n % 24)) if k and c})


def test_permutation():
    for n in (1, 2, 3, 10, 1000, 4097):
        assert sorted(tokens.feistel(np.arange(n), n, 9).tolist()) == list(range(n))
    assert (tokens.feistel(np.arange(1000), 1000, 1) != tokens.feistel(np.arange(1000), 1000, 2)).any()


def test_ids_are_those_of_whole_texts():
    texts = ["", None, "a  b", "\n\nx", " x", "it's  a\n\n test\n", "é x\u3000 y z", "a\nb", "a\n b", "x\x1c y", "x \x1cy", "tab\there \nq", "12 34\n56", "\r\nx", "\u00a0 \u2028x", "x " * 3000, "日本 語", "a \u00a0b"]
    e = tokens.Encoder()
    for _ in range(2):
        ids, at = e.batch(pa.array(texts))
        for i, t in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == [*e.encoding.encode_ordinary(t or ""), e.end], t


def test_shards_round_trip(spark, tmp_path):
    rng = random.Random(6)
    rows = [(100 + i, " ".join(f"word{rng.randrange(300)}" for _ in range(rng.randint(0, 90)))) for i in range(150)] + util.AWKWARD
    placed = tokens.materialise(util.docs(spark, rows), length=32, shard_rows=100).cache()
    got = placed.collect()
    assert sorted(r.slot for r in got) == list(range(len(got)))
    files = tokens.write_shards(placed, f"file://{tmp_path}/out", length=32).collect()
    assert sum(r.records for r in files) == len(got)
    read = [x for s in range(-(-len(got) // 100)) for x in tokens.read_shard(f"file://{tmp_path}/out", s, 32)]
    by_slot = {r.slot: r for r in got}
    assert all((by_slot[s].ids == x.tobytes()) and len(x) == by_slot[s].n_tokens for s, x in enumerate(read))
    assert next(tokens.read_shard(f"file://{tmp_path}/out", 1, 32, 7)).tobytes() == by_slot[107].ids
    e = tokens.Encoder()
    back = defaultdict(list)
    for r in sorted(got, key=lambda r: r.piece):
        if r.doc_id is not None and r.doc_id != 13:
            back[r.doc_id] += np.frombuffer(r.ids, np.uint16).tolist()
    assert all(e.encoding.decode(back[i][:-1]) == (t or "") and back[i][-1] == e.end for i, t in rows if i is not None and i != 13)
    digest = {r.slot: r.record_crc32 for r in tokens.digests(placed, length=32).collect()}
    assert len(digest) == len(got)
    again = tokens.shard_files(util.docs(spark, rows).selectExpr("*", "1 as slot", "2 as shard", "3 as ids", "4 as part"), f"{tmp_path}/again", length=32, shard_rows=100).collect()
    assert {r.slot: r.record_crc32 for r in again} == digest and [r.byte_offset for r in sorted(again, key=lambda r: r.slot)] == [s % 100 * 68 for s in range(len(got))]
    assert tokens.shard_files(util.docs(spark, []), f"file:{tmp_path}/none", length=32).count() == 0
    assert tokens.materialise(util.docs(spark, [])).count() == 0


def test_pieces_kept_by_a_token_worker_are_few_bytes(monkeypatch):
    import tracemalloc

    e, rng = tokens.Encoder(), random.Random(8)
    e.batch(pa.array(["some words to begin with"]))
    tracemalloc.start()
    for _ in range(12):
        e.batch(pa.array([" ".join(f"{rng.getrandbits(40):x}" for _ in range(10_000))]))
    assert tracemalloc.get_traced_memory()[0] < 8e6  # 12e4 pieces of some six ids
    tracemalloc.stop()
    # few, but long
    monkeypatch.setattr(tokens, "CACHE_IDS", 50_000)
    texts = ["-".join(f"{rng.getrandbits(40):x}" for _ in range(2000)) for _ in range(9)]
    for t in [*texts, *texts]:
        ids, _ = e.batch(pa.array([t]))
        assert ids.tolist() == [*e.encoding.encode_ordinary(t), e.end]
        assert len(e.ids) <= 50_000
    monkeypatch.setattr(tokens, "CACHE", 100)
    for t in [" ".join(f"w{rng.randrange(150)}" for _ in range(90)) for _ in range(20)]:
        ids, _ = e.batch(pa.array([t, t[3:]]))
        assert ids.tolist() == [*e.encoding.encode_ordinary(t), e.end, *e.encoding.encode_ordinary(t[3:]), e.end] and len(e.keys) <= 100


def test_slots_of_a_wave_are_found_by_one_python_worker_a_task(spark):
    slotted, shards = tokens._slotted(util.docs(spark, [(i, f"text {i}") for i in range(90)]), tokens.VOCABULARY, 32, 10, 5)
    some = tokens._dealt(slotted, 2, 6)
    assert some._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert sorted(r.slot for r in some.select("slot").collect()) == list(range(20, 60)) and shards == 9


CHAT = [
    (1, 0, "a", "Hello there my friend.\nHow are you today?"), (1, 1, "b", "On Monday, A wrote:\n> How are you today?\nFine thanks a lot."),
    (1, 2, "c", "> > How are you today?\n> Fine thanks a lot.\nGood to hear it."), (1, 3, "a", "> hello THERE my friend\nreply to first"),
    (1, 4, "d", ">> Good to hear it\nthird level"), (1, 5, "e", None), (None, 1, "a", "> x y z"), (1, None, "q", "zz"), (2, 0, "a", "> Fine thanks a lot."), (2, 9, "a", ""), (2, 9, "a", ""),
]


def test_quotes_lead_to_parents(spark):
    got = conversations.in_reply_order(spark.createDataFrame(CHAT, "conv_id long, turn long, role string, text string").selectExpr("*", "3 as root"))
    rows = got.collect()
    assert len(rows) == len(CHAT)
    one = {r.turn: r for r in rows if r.conv_id == 1 and r.turn is not None}
    assert {t: (r.reply_to, r.root, r.depth) for t, r in one.items()} == {0: (None, 0, 0), 1: (0, 0, 1), 2: (1, 0, 2), 3: (0, 0, 1), 4: (2, 0, 3), 5: (None, 5, 0)}
    assert one[1].clean_text == "Fine thanks a lot." and one[2].max_level == 2 and one[5].clean_text == ""
    assert sorted(r.position for r in one.values()) == list(range(6))
    assert all(one[r.reply_to].position < r.position for r in one.values() if r.reply_to is not None)
    assert next(r for r in rows if r.conv_id == 2 and r.turn == 0).reply_to is None
    assert conversations.in_reply_order(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


WRAPPED = [
    (0, "The quick brown fox jumps over the lazy dog and then\nsleeps in the warm sun until the evening comes."), (1, "An unrelated message with many words of its own, said once."),
    (2, "> The quick brown fox jumps\n> over the lazy dog and\n>\n> then sleeps in the warm sun\nI like it."), (3, "ok"), (4, "> ok\nfine"),
    (5, "今日はとても天気がいいですね。\n散歩に行きましょう。"), (6, "> 今日はとても天\n> 気がいいですね。散歩に\n> 行きましょう。\n賛成です"), (7, "好"), (8, "> 好\n!"),
    (9, "> this message was never sent here at all\n> > The quick brown fox\n> > jumps over the lazy dog\nsee above"), (10, "> nobody ever wrote any of these words\nx"),
    (11, "> > An unrelated message\n> > with many words of its own\n> jumps over lazy the fox brown\ny"), (12, "> The quick brown fox jumps over the lazy\n> > An unrelated message with many words of its own, said once.\nz"),
]


def test_passages_link_whatever_their_line_breaks(spark):
    later = [(2, 0, "a", "The quick brown fox jumps over the lazy dog"), (2, 2000, "b", "> The quick brown\n> fox jumps over\n> the lazy dog\nhm")]
    rows = [(1, t, "a", x) for t, x in WRAPPED] + later + [(3, 0, "a", "> The quick brown\n> fox jumps over\n> the lazy dog")]
    got = conversations.in_reply_order(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == len(rows)
    want = {2: 0, 4: 3, 6: 5, 8: 7, 9: 0, 11: 1, 12: 0}
    assert {r.turn: r.reply_to for r in got if r.conv_id == 1} == {t: want.get(t) for t, _ in WRAPPED}
    assert {(r.conv_id, r.turn): r.reply_to for r in got if r.conv_id > 1} == {(2, 0): None, (2, 2000): 0, (3, 0): None}


def test_long_threads_and_hot_lines(spark):
    chain = [(1, t, "u", ("" if not t else f"> line number {t - 1} says\n") + f"line number {t} says\nthe same words everywhere") for t in range(1300)]
    hot = [(2, t, "u", "> the same words everywhere\nthe same words everywhere") for t in range(1300)]
    got = conversations.in_reply_order(spark.createDataFrame(chain + hot, "conv_id long, turn long, role string, text string")).collect()
    for r in got:
        assert r.reply_to == (r.turn - 1 if r.turn else None) and (r.root, r.depth, r.position) == (0, r.turn, r.turn)


def cut_links(rows, got):
    """Pairs of equal texts in different shards, counted one by one."""
    places = defaultdict(list)
    for r in got:
        if r.group is not None:
            places[r.group].append(r.shard)
    return sum(a != b for s in places.values() for i, a in enumerate(s) for b in s[:i])


def test_labels_propagate_until_few_links_are_cut(spark):
    rng = random.Random(8)
    rows = [(i, f"text {rng.randrange(150) if i % 10 else -i}") for i in range(960)]  # nine tenths linked, groups of about six in quotas of 40
    seen = {}
    got = sharding.assign(util.docs(spark, rows), report=lambda k, cut: seen.setdefault(k, cut)).collect()
    check_shards(got, rows, 24)
    cuts = [seen[k] for k in sorted(seen)]
    assert len(cuts) > 3 and all(a >= b for a, b in zip(cuts, cuts[1:])) and cuts[0] > cuts[1] > cuts[2] >= cuts[-1] and cuts[-1] < 0.1 * cuts[0], cuts
    assert cut_links(rows, got) == cuts[-1]
    one = {}
    sharding.assign(util.docs(spark, rows), rounds=1, report=lambda k, cut: one.setdefault(k, cut))
    assert one == {0: cuts[0], 1: cuts[1]}


def test_admitted_moves_keep_quotas():
    rng = random.Random(9)
    assert sharding.admitted({(0, 1): 10, (1, 0): 4}, [0, 0]) == {(0, 1): 4, (1, 0): 4}
    assert sharding.admitted({(0, 1): 5, (1, 2): 5, (2, 0): 5}, [0, 0, 0]) == {(0, 1): 5, (1, 2): 5, (2, 0): 5}
    for _ in range(200):
        n = rng.randint(2, 8)
        room = [rng.choice((0, 0, rng.randint(0, 50))) for _ in range(n)]
        want = {(i, j): rng.randint(1, 60) for i in range(n) for j in range(n) if i != j and rng.random() < 0.5}
        got = sharding.admitted(want, room)
        assert all(0 < x <= want[k] for k, x in got.items())
        for b in range(n):
            assert sum(x for (_, j), x in got.items() if j == b) - sum(x for (i, _), x in got.items() if i == b) <= room[b]


def quoting(rng, conversations=40, turns=14):
    """Messages that quote whole lines of earlier ones, some of them at two levels and with attributions."""
    rows = []
    for c in range(conversations):
        said = []
        for t in range(turns):
            own = [f"line {k} of turn {t} in talk {c} {rng.choice(['today', 'again', 'at last'])}" for k in range(rng.randint(1, 3))] + ["the same words in every message"] * (rng.random() < 0.3)
            quotes = []
            if t and rng.random() < 0.8:
                at = rng.randrange(t)
                quotes = [f"> {x}" for x in rng.sample(said[at], rng.randint(1, len(said[at])))]
                if rng.random() < 0.3:
                    quotes.insert(0, f"> > {rng.choice(said[rng.randrange(t)])}")
                if rng.random() < 0.3:
                    quotes.insert(0, f"On day {at}, someone wrote:")
            rows.append((c, t * 40, "ab"[t % 2], "\n".join(quotes + own)))
            said.append(own)
    return rows + [(0, 999, None, None), (1, 998, "a", ""), (2, 997, "b", "> said by nobody here at all\nhello")]


def test_registered_query_on_planted_quotes_equals_its_sql(spark, tmp_path):
    import duckdb

    from tests.compare import compare
    from tidemark.llm import queries

    rows = [r for r in quoting(random.Random(12)) if r[1] != 997]  # whole lines decide for all that quote
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert compare(spark, con, queries.QUERIES["op3_conversations"], queries.ORACLE_SQL["op3_conversations"], str(tmp_path)) is None
    got = queries.QUERIES["op3_conversations"](spark, str(tmp_path)).collect()
    linked = [r for r in got if r.reply_to is not None]
    assert len(linked) > 350 and max(r.depth for r in got) > 4 and max(r.max_level for r in got) == 2
    # and against plain Python: the latest earlier message that wrote most of the quoted lines of the least level
    wrote = defaultdict(dict)
    for c, t, _, text in rows:
        for line in (text or "").split("\n"):
            if not line.startswith(">") and not line.endswith("wrote:") and line:
                wrote[c].setdefault(line, []).append(t)
    parent = {(r.conv_id, r.turn): r.reply_to for r in got}
    for c, t, _, text in rows:
        asked = [x[2:] for x in (text or "").split("\n") if x.startswith("> ") and not x.startswith("> >")]
        votes = Counter(max((s for s in wrote[c].get(x, []) if s < t), default=None) for x in asked)
        votes.pop(None, None)
        assert parent[c, t] == (max(votes, key=lambda s: (votes[s], s)) if votes else None)


@pytest.mark.parametrize("groups", [0, 60])
def test_shards_follow_the_order_in_which_files_were_written(spark, tmp_path, groups):
    """Three sources in blocks of eight, where 24 shards dealt by row number would get one source each; some texts are linked."""
    rows = [(i, f"group {i % groups}" if groups and i % 10 == 0 else f"text {i} " + "x" * (i // 4), f"s{i // 8 % 3}" if i // 8 % 3 else None) for i in range(2880)]
    df = util.docs(spark, rows).withColumn("_metadata", F.lit("own"))
    df.repartitionByRange(7, "doc_id").sortWithinPartitions("doc_id").write.parquet(f"{tmp_path}/mixed")
    docs = spark.read.parquet(f"{tmp_path}/mixed")
    read = [r.doc_id for r in docs.withColumn("rid", F.monotonically_increasing_id()).orderBy("rid").collect()]
    assert read != sorted(read)  # larger files come first
    for given in (docs, docs.orderBy("doc_id")):
        got = sorted(sharding.assign(given, kind="source").collect(), key=lambda r: r.slot)
        assert not check_shards(got, [r[:2] for r in rows], 24)
        shards = [[r.doc_id for r in got if r.shard == b] for b in range(24)]
        assert all(ids == sorted(ids) for ids in shards)
        alone = lambda i: not groups or i % 10 != 0
        room = [sum(map(alone, ids)) for ids in shards]  # what a shard's links leave
        for upto in (600, 1440, 2880):
            for source in range(3):
                fits = lambda i: i < upto and i // 8 % 3 == source and alone(i)  # noqa: B023, E731
                share = sum(map(fits, range(2880))) / sum(room)
                assert all(abs(sum(map(fits, ids)) - share * r) < 2 for ids, r in zip(shards, room, strict=True)), (upto, source)


@pytest.mark.parametrize("room", [[5000, 0, 7000, 3001], [3] * 24, [4001, 4000, 4000], [0, 0], [7]])
def test_rows_are_dealt_evenly_and_as_many_as_there_is_room(spark, room):
    got = [r.b for r in spark.range(0, sum(room), 1, 1).selectExpr(f"{sharding._dealt(room, 'id')} as b").collect()]
    assert [got.count(b) for b in range(len(room))] == room
    had = [0] * len(room)
    for n, b in enumerate(got, 1):
        had[b] += 1
        assert all(abs(h - n * r / sum(room)) <= 4 for h, r in zip(had, room, strict=True))
