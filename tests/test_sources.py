"""Readers, payload parsers, writers, polite fetching, streaming and the command line."""

import json
import urllib.error
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark import cli
from tidemark.functions import calendar
from tidemark.sources import ingest, payloads, readers, sinks
from tidemark.streaming import ingest as streaming

HEAD = "source,title,link,published_at,published_raw,scraped_at\n"
ROWS = [
    'a,"Infosys gains, ""strong"" quarter",http://x/1,2026-09-28T02:55:19+00:00,"Mon, 28 Sep 2026 08:25:19 +0530",2026-09-28T12:00:00.123456+00:00',
    "a,BSE shares fall,http://x/2,2026-09-28T09:00:00+05:30,raw,2026-09-28T12:00:00+00:00",
    "b,HDFC Bank good profit,http://x/3,2026-09-28T11:00:00+00:00,raw,2026-09-28T12:00:00+00:00",
    "b,nothing here,http://x/4,2026-09-26T11:00:00+00:00,raw,2026-09-28T12:00:00+00:00",
]


@pytest.fixture
def corpus(tmp_path):
    (tmp_path / "h.csv").write_text(HEAD + "\n".join(ROWS) + "\n")
    prices = tmp_path / "prices"
    prices.mkdir()
    days = ["2026-09-25", "2026-09-28", "2026-09-29", "2026-09-30"]
    for k, t in enumerate(("INFY.NS", "BSE.NS", "HDFCBANK.NS", "^NSEI")):
        bars = [{"date": d, "open": 100.0 + k, "close": 100.0 + k + i} for i, d in enumerate(days)]
        (prices / f"{t}.json").write_text(json.dumps({"ticker": t, "bars": bars}, indent=2))
    (tmp_path / "eval.csv").write_text("id,text,expected_label,category,note\n1,good profit,positive,general,\n2,bad loss,negative,general,x\n3,the table,neutral,plain,\n")
    return tmp_path


def test_headlines_keep_order_and_times(spark, corpus):
    got = readers.headlines(spark, f"{corpus}/h.csv").orderBy("seq").collect()
    assert [r.link[-1] for r in got] == list("1234") and got[0].title == 'Infosys gains, "strong" quarter'
    assert got[1].published_at == datetime(2026, 9, 28, 3, 30) and got[0].scraped_at.microsecond == 123456


def test_a_time_without_offset_is_an_error(spark, tmp_path):
    (tmp_path / "h.csv").write_text(HEAD + "a,t,l,2026-09-28T02:55:19,raw,2026-09-28T12:00:00+00:00\n")
    with pytest.raises(Exception, match="without offset"):
        readers.headlines(spark, f"{tmp_path}/h.csv").collect()


def test_bars_round_trip(spark, corpus, tmp_path):
    b = readers.bars(spark, f"{corpus}/prices")
    assert b.count() == 16 and b.filter("ticker = '^NSEI'").count() == 4
    sinks.bars_json(b, f"{tmp_path}/out")
    assert spark.read.schema("ticker string, bars array<struct<date: date, open: double, close: double>>").json(f"{tmp_path}/out").select(F.size("bars").alias("n")).filter("n = 4").count() == 4


def test_headline_csv_is_sorted_by_time(spark, corpus, tmp_path):
    h = readers.headlines(spark, f"{corpus}/h.csv")
    sinks.headlines(h, f"{tmp_path}/out")
    back = readers.headlines(spark, f"{tmp_path}/out").orderBy("seq").collect()
    assert [r.link[-1] for r in back] == list("4123") and {r.title for r in back} == {r.title for r in h.collect()}
    merged = sinks.merge_headlines(h, h.withColumn("title", F.lit("later")), f"{tmp_path}/merged")
    assert merged.count() == 4 and merged.filter("title = 'later'").count() == 0


def test_articles(spark, tmp_path):
    one = {"url": " http://x/1 ", "title": " t ", "seendate": "20260928T025519Z", "domain": "", "language": "English"}
    many = [one, {**one, "language": "Hindi"}, {**one, "title": ""}, {**one, "seendate": "soon"}, {**one, "domain": "d.com", "url": "u"}, {k: v for k, v in one.items() if k != "title"}]
    (tmp_path / "acme_co.json").write_text(json.dumps({"articles": many}))
    (tmp_path / "empty.json").write_text("{}")
    raw = readers.articles(spark, str(tmp_path))
    got = payloads.headlines_of_articles(raw, F.current_timestamp()).collect()
    assert sorted((r.source, r.title, r.link) for r in got) == [("d.com", "t", "u"), ("gdelt", "t", "http://x/1")]
    assert payloads.headlines_of_articles(raw, F.current_timestamp(), None).count() == 3
    assert {r.slug for r in raw.collect()} == {"acme_co", "empty"}


DATES = {
    "Mon, 28 Sep 2026 08:25:19 +0530": "2026-09-28 02:55:19", "28 Sep 2026 08:25 GMT": "2026-09-28 08:25:00", "Mon, 28 Sep 2026 08:25:19 -0000": "2026-09-28 08:25:19",
    "Mon, 8 Sep 2026 08:25:19": "2026-09-08 08:25:19", "soon": None, "": None, None: None,
}


def test_pub_dates(spark):
    df = spark.createDataFrame([(k,) for k in DATES], "raw string")
    got = {r.raw: r.t and str(r.t) for r in df.select("raw", payloads.pub_date(F.col("raw")).alias("t")).collect()}
    assert got == DATES


def test_feed_files(spark, tmp_path):
    item = "<item><title>{}</title><link>{}</link><pubDate>{}</pubDate></item>"
    body = "".join(item.format(*x) for x in (("a &amp; b", "http://x/1", "Mon, 28 Sep 2026 08:25:19 +0530"), ("", "l", "Mon, 28 Sep 2026 08:25:19 GMT"), ("t", "l", "never")))
    (tmp_path / "f.xml").write_text(f"<?xml version='1.0'?><rss><channel>{body}<item><title>only</title></item></channel></rss>")
    got = payloads.headlines_of_items(readers.feed(spark, f"{tmp_path}/f.xml"), F.lit("feed"), F.current_timestamp()).collect()
    assert [(r.title, r.link) for r in got] == [("a & b", "http://x/1")]


def test_chart(spark):
    body = json.dumps({"chart": {"result": [{"timestamp": [1790560800, 1790647200, 1790733600], "indicators": {"quote": [{"open": [1.23456, None, 3.0], "close": [2.0, 5.0, 4.00004]}]}}]}})
    df = spark.createDataFrame([("X", body), ("Y", "{}")], "t string, b string")
    got = payloads.bars_of_chart(df, "b", F.col("t")).orderBy("date").collect()
    assert [(r.ticker, r.open, r.close) for r in got] == [("X", 1.2346, 2.0), ("X", 3.0, 4.0)] and got[0].date.isoformat() == "2026-09-28"


def _error(code):
    def fetch(url, timeout):
        raise urllib.error.HTTPError(url, code, "", None, None)

    return fetch


def _down(url, timeout):
    raise OSError("down")


def test_robots_rules():
    ok = ingest.RobotsCache(lambda u, t: b"User-agent: *\nDisallow: /no\nCrawl-delay: 7\n")
    assert ok.allowed("http://h/yes") and not ok.allowed("http://h/no/x") and ok.crawl_delay("http://h/") == 7.0
    assert not ingest.RobotsCache(_error(403)).allowed("http://h/") and not ingest.RobotsCache(_error(401)).allowed("http://h/")
    assert ingest.RobotsCache(_error(404)).allowed("http://h/") and not ingest.RobotsCache(_down).allowed("http://h/")
    assert ingest.fetch_status("http://h/", ingest.RobotsCache(_down), ingest.RateLimiter()) == (None, "robots_unreachable")
    assert ingest.fetch_status("http://h/", ingest.RobotsCache(_error(403)), ingest.RateLimiter()) == (None, "robots_denied")
    assert ingest.fetch_status("http://h/", ok, ingest.RateLimiter(), fetch=_error(429)) == (None, "fetch_failed")
    assert ingest.fetch_status("http://h/", ok, ingest.RateLimiter(), fetch=lambda u, t: b"x") == (b"x", "ok")


def test_rate_limit():
    now, slept = [0.0], []
    limit = ingest.RateLimiter(3.0, lambda: now[0], slept.append)
    limit.wait("http://a/1")
    limit.wait("http://b/1")
    now[0] = 1.0
    limit.wait("http://a/2", 10.0)
    assert slept == [9.0]


def test_chart_retries():
    calls, slept = [], []

    def fetch(url, timeout):
        calls.append(url)
        if len(calls) < 3:
            raise OSError
        return b'{"chart": {"result": [1]}}'

    assert "chart" in ingest.fetch_chart("http://c", 3, fetch, slept.append) and slept == [2.0, 4.0]
    with pytest.raises(ingest.PriceFetchError):
        ingest.fetch_chart("http://c", 2, _down, slept.append)
    assert "sourcecountry%3AIndia" in ingest.news_query_url("x") and "maxrecords=50" in ingest.news_query_url("x")


def test_stream_adds_each_headline_once(spark, corpus, tmp_path):
    landing, out, state = tmp_path / "landing", f"{tmp_path}/corpus", f"{tmp_path}/state"
    landing.mkdir()
    (landing / "1.csv").write_text(HEAD + "\n".join(ROWS[:2]) + "\n")

    def run():
        streaming.append_new(streaming.headlines(spark, str(landing)), out, state).awaitTermination()

    run()
    (landing / "2.csv").write_text(HEAD + "\n".join(ROWS[1:]) + "\n")
    run()
    run()
    got = spark.read.parquet(out)
    assert sorted(r.link[-1] for r in got.collect()) == list("1234")


def test_stream_dedupe_and_counts(spark, corpus, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    (landing / "1.csv").write_text(HEAD + "\n".join(ROWS + ROWS) + "\n")
    unique = streaming.first_seen(streaming.headlines(spark, str(landing)))
    q = unique.writeStream.format("memory").queryName("unique_rows").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("unique_rows").count() == 4
    q = streaming.timing_counts(streaming.headlines(spark, str(landing))).writeStream.format("memory").queryName("timings").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("timings").agg(F.sum("n")).first()[0] == 8


def test_aligned_file(spark, corpus, tmp_path):
    sinks.aligned(calendar.align(readers.headlines(spark, f"{corpus}/h.csv")), f"{tmp_path}/a")
    assert spark.read.option("header", "true").csv(f"{tmp_path}/a").columns == ["source", "title", "link", "published_at", "local_time", "timing", "session_date"]


def test_commands(spark, corpus, tmp_path, capsys):
    priced = ["--input", f"{corpus}/h.csv", "--prices-dir", f"{corpus}/prices"]
    assert cli.main(["align", "--input", f"{corpus}/h.csv", "--out", f"{tmp_path}/o1"], spark) == 0
    assert cli.main(["score", "--input", f"{corpus}/h.csv", "--out", f"{tmp_path}/o2"], spark) == 0
    assert cli.main(["evaluate", "--eval-set", f"{corpus}/eval.csv", "--out", f"{tmp_path}/o3"], spark) == 0
    assert cli.main(["robustness", *priced, "--n-perm", "5"], spark) == 0
    assert cli.main(["prereg", *priced], spark) == 0
    assert cli.main(["audit", *priced, "--n-perm", "5"], spark) == 0
    assert cli.main(["regress", *priced, "--out", f"{tmp_path}/o4"], spark) == 0
    assert cli.main(["overlay", *priced, "--out-dir", f"{tmp_path}/o5"], spark) == 0
    assert cli.main(["contract", "--input", f"{corpus}/h.csv", "--ticker", "infy.ns", "--out", f"{tmp_path}/o6"], spark) == 0
    assert '"coverage":"partial"' in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["scrape-news", "--input", f"{corpus}/h.csv", "--out", f"{tmp_path}/o7", "--landing", str(tmp_path)], spark)
