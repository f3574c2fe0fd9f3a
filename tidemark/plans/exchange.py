"""Registered queries of sources and sinks: rows go out by a writer into the shared folder and come back by a reader."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scoring, text
from tidemark.operators import bars, corpus, eventstudy, fact, quality, regress
from tidemark.plans.queries import aligned, headlines, price_bars, priced, query, read
from tidemark.sources import payloads, readers, sinks


def folder(spark: SparkSession) -> str:
    """A new folder below the one of ``spark.checkpoint.dir``; of our own only in local mode, where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/tidemark/exchange-{uuid.uuid4().hex}"


def _corpus(spark, d) -> DataFrame:
    """Headlines as a corpus holds them: instants, and times as written."""
    h = headlines(spark, d)
    return h.select("seq", "source", "title", "link", F.col("published_at").cast("timestamp").alias("published_at"), F.date_format("published_at", "yyyy-MM-dd HH:mm").alias("published_raw"), (F.col("published_at") + F.expr("interval 1 hour")).cast("timestamp").alias("scraped_at"))


def _back(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c, t in df.dtypes if t == "timestamp"})


_CORPUS = ("source", "title", "link", "published_at", "published_raw", "scraped_at")


@query
def q_csv_headlines(spark, d):
    path = folder(spark)
    sinks.headlines(_corpus(spark, d), path)
    return _back(readers.headlines(spark, path)).select(*_CORPUS)


@query
def q_csv_merge(spark, d):
    path, c = folder(spark), _corpus(spark, d)
    sinks.merge_headlines(c.filter("seq % 3 = 0"), c.filter("seq % 3 <> 0"), path)
    return _back(readers.headlines(spark, path)).select(*_CORPUS)


@query
def q_parquet_corpus(spark, d):
    path = folder(spark)
    sinks.corpus_parquet(_corpus(spark, d), path)
    return spark.read.parquet(path).groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n"), F.min("title").alias("first_title"))


@query
def q_json_bars(spark, d):
    path = folder(spark)
    sinks.bars_json(price_bars(spark, d).select("ticker", "date", "open", "close"), path)
    return readers.bars(spark, path)


@query
def q_json_bars_of_one(spark, d):
    """The file of one ticker, found by its name in the document."""
    path = folder(spark)
    sinks.bars_json(price_bars(spark, d).select("ticker", "date", "open", "close"), path)
    return readers.bars(spark, path).filter("ticker = 'click'").select("date", "open", "close")


@query
def q_csv_aligned(spark, d):
    path = folder(spark)
    a = aligned(spark, d)
    sinks.aligned(a.withColumn("published_at", F.col("published_at").cast("string")).withColumn("local_time", F.col("local_time").cast("string")), path)
    return spark.read.schema("source string, title string, link string, published_at timestamp_ntz, local_time timestamp_ntz, timing string, session_date date").option("header", "true").csv(path)


@query
def q_csv_fact(spark, d):
    path = folder(spark)
    sinks.fact(priced(spark, d).withColumn("company", F.upper("ticker")), path)
    out = spark.read.schema("title string, company string, ticker string, source string, session_date date, compound double, contemporaneous_return double, lagged_return double, gap_return double").option("header", "true").csv(path)
    return out.select("title", "company", "ticker", "source", "session_date", *(F.round(c, 7).alias(c) for c in ("compound", "contemporaneous_return", "lagged_return", "gap_return")))


@query
def q_csv_regression(spark, d):
    path = folder(spark)
    sinks.regression(regress.predictions(regress.time_split(regress.usable(priced(spark, d)))), path)
    out = spark.read.schema("title string, ticker string, session_date date, compound double, lagged_return double, predicted_return double, split string").option("header", "true").csv(path)
    return out.select("title", "ticker", "session_date", "split", *(F.round(c, 6).alias(c) for c in ("compound", "lagged_return", "predicted_return")))


def _scored_rows(spark, d, names: tuple[str, str, str]) -> DataFrame:
    c = F.round(F.col("compound"), 4)
    h = headlines(spark, d)
    shares = (F.abs(c) * 0.5, 1 - F.abs(c), F.abs(c) * 0.25)
    return h.select("source", "title", "link", F.col("published_at").cast("timestamp").alias("published_at"), *(x.alias(n) for x, n in zip(shares, names, strict=True)), c.alias("compound"), scoring.label(c).alias("label"))


@query
def q_csv_scored(spark, d):
    path = folder(spark)
    sinks.scored(_scored_rows(spark, d, ("neg", "neu", "pos")), path)
    return _back(readers.scored(spark, path))


@query
def q_csv_model_scored(spark, d):
    path = folder(spark)
    sinks.scored(_scored_rows(spark, d, ("positive", "negative", "neutral")), path)
    return _back(readers.scored(spark, path, model=True))


@query
def q_csv_eval_set(spark, d):
    path = folder(spark)
    rows = read(spark, d, "labels").select(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit('text, "'), F.col("doc_id").cast("string"), F.lit('"')).alias("text"), F.when(F.col("quality") == 1, "positive").otherwise("negative").alias("expected_label"), F.concat(F.lit("c"), F.col("toxic").cast("string")).alias("category"), F.lit("a, note").alias("note"))
    sinks.csv(rows, path)
    return readers.evaluation_set(spark, path)


@query
def q_json_contract(spark, d):
    path = folder(spark)
    sinks.contract(corpus.contract(aligned(spark, d), "PURCHASE", score="compound"), path)
    got = spark.read.text(path).select(F.from_json("value", "sentiment struct<score_7d: double, headline_count_7d: int, model: string, coverage: string>").alias("v")).select("v.sentiment.*")
    return got.withColumn("score_7d", F.round("score_7d", 7))


@query
def q_files_articles(spark, d):
    """Landed news responses, one file each, with the slug of the company in the file's name left to the reader."""
    path = folder(spark)
    many = headlines(spark, d).withColumn("one", F.struct(F.concat(F.lit("http://x/"), F.col("seq").cast("string")).alias("url"), F.col("title"), F.date_format("published_at", "yyyyMMdd'T'HHmmss'Z'").alias("seendate"), F.col("source").alias("domain"), F.lit("English").alias("language")))
    body = many.groupBy((F.col("seq") % 7).alias("k")).agg(F.to_json(F.struct(F.collect_list("one").alias("articles"))).alias("value"))  # seven responses
    body.select("value").repartition(7).write.option("maxRecordsPerFile", 1).text(path)
    out = payloads.headlines_of_articles(readers.articles(spark, path), F.lit(None).cast("timestamp"))
    return out.select("source", "title", "link", F.unix_seconds("published_at").alias("published"))


@query
def q_files_feed(spark, d):
    """Landed RSS documents read as files, with their feed's name."""
    path = folder(spark)
    item = F.concat(F.lit("<item><title>"), "title", F.lit("</title><link>http://x/"), F.col("seq").cast("string"), F.lit("</link><pubDate>"), F.date_format("published_at", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT</pubDate></item>"))
    body = headlines(spark, d).groupBy((F.col("seq") % 5).alias("k")).agg(F.concat(F.lit("<rss><channel>"), F.array_join(F.collect_list(item), ""), F.lit("</channel></rss>")).alias("value"))  # five documents
    body.select("value").repartition(5).write.option("maxRecordsPerFile", 1).text(path)
    items = readers.feed(spark, path)
    out = payloads.headlines_of_items(items, F.substring("feed", 1, 4), F.lit(None).cast("timestamp"))
    return out.select("source", "title", "link", F.unix_seconds("published_at").alias("published"))


@query
def q_fact_build(spark, d):
    """The flagship join itself: resolved, aligned, priced and scored, with each row's status."""
    from tidemark.plans.queries import _rules

    h = headlines(spark, d).drop("ticker", "compound").withColumn("published_at", F.to_utc_timestamp(F.col("published_at").cast("timestamp"), "UTC"))
    out = fact.build(h, _rules(spark), price_bars(spark, d), lambda t: F.length(t) / 100.0)
    return out.select("seq", "company", "ticker", "status", "session_date", F.round("compound", 4).alias("compound"), F.round("contemporaneous_return", 7).alias("contemporaneous_return"), F.round("lagged_return", 7).alias("lagged_return"))


@query
def q_registered_run(spark, d):
    """The registered test with its gate, which is met; titles are scored only then."""
    b = price_bars(spark, d)
    rows = eventstudy.with_two_day(priced(spark, d), b, bars.proxy_returns(b))
    gate, stat = quality.registered_test(rows, lambda t: F.length(t) / 100.0, headlines=100, sessions=5, sources=3)
    out = stat.crossJoin(F.broadcast(gate.select("met")))  # one row each
    return out.select("met", "n", *(F.round(c, 7).alias(c) for c in ("r", "ci_low", "ci_high")))


def _predict():
    """Stands for a model: shares from the length of the text."""
    def run(texts: list[str]) -> list[tuple[float, float, float]]:
        out = []
        for t in texts:
            p, n, u = len(t) % 5 + 1.0, len(t) % 3 + 1.0, 2.0
            out.append((p / (p + n + u), n / (p + n + u), u / (p + n + u)))
        return out

    return run


@query
def q_model_score(spark, d):
    """The model scorer's batches, labels and compound, with a stand-in for the model."""
    s = scoring.model_score(_predict)(F.col("title"))
    rows = headlines(spark, d).select("seq", s.alias("s")).select("seq", "s.*")
    return rows.select("seq", *(F.round(c, 7).alias(c) for c in ("pos", "neg", "neu", "compound")), scoring.label_of_shares(F.col("pos"), F.col("neg"), F.col("neu")).alias("label"))


@query
def q_slugs(spark, d):
    return headlines(spark, d).select("seq", text.slug(F.concat(F.lit("Big "), F.initcap("ticker"), F.lit(" Co"))).alias("slug"))


ORACLE: dict[str, str] = {}


def _fill() -> None:
    from tidemark.plans import oracle as O

    corpus_ = "c AS (SELECT seq, source, title, link, published_at, strftime(published_at, '%Y-%m-%d %H:%M') AS published_raw, published_at + INTERVAL 1 HOUR AS scraped_at FROM h)"
    scored = "c AS (SELECT source, title, link, published_at, round(compound, 4) AS compound FROM h), s AS (SELECT *, abs(compound) * 0.5 AS x, 1 - abs(compound) AS y, abs(compound) * 0.25 AS z FROM c)"
    label = O._LABEL
    fields = ", ".join(_CORPUS)
    ORACLE.update({
        "q_csv_headlines": O._with(O._H, corpus_) + f"SELECT {fields} FROM c",
        "q_csv_merge": O._with(O._H, corpus_) + f"SELECT {fields} FROM (SELECT *, row_number() OVER (PARTITION BY source, link ORDER BY CASE WHEN seq % 3 = 0 THEN 0 ELSE 1 END, seq) AS k FROM c) WHERE k = 1",
        "q_parquet_corpus": O._with(O._H) + "SELECT CAST(CAST(published_at AS DATE) AS VARCHAR) AS day, count(*) AS n, min(title) AS first_title FROM h GROUP BY 1",
        "q_json_bars": O._with(O._B) + "SELECT ticker, date, open, close FROM b",
        "q_json_bars_of_one": O._with(O._B) + "SELECT date, open, close FROM b WHERE ticker = 'click'",
        "q_csv_aligned": O._BASE + "SELECT source, title, link, published_at, local_time, timing, session_date FROM a",
        "q_csv_fact": O._FULL + "SELECT title, upper(ticker) AS company, ticker, source, session_date, round(compound, 7) AS compound, round(contemporaneous_return, 7) AS contemporaneous_return, round(lagged_return, 7) AS lagged_return, round(gap_return, 7) AS gap_return FROM f",
        "q_csv_regression": O._with(O._H, O._A, O._B, O._F, O._US, O._fit()) + "SELECT f.title, f.ticker, f.session_date, pd.split, round(pd.compound, 6) AS compound, round(pd.y, 6) AS lagged_return, round(pd.predicted, 6) AS predicted_return FROM pd JOIN f USING (seq)",
        "q_csv_scored": O._with(O._H, scored) + f"SELECT source, title, link, published_at, x AS neg, y AS neu, z AS pos, compound, {label} AS label FROM s",
        "q_csv_model_scored": O._with(O._H, scored) + f"SELECT source, title, link, published_at, x AS positive, y AS negative, z AS neutral, compound, {label} AS label FROM s",
        "q_csv_eval_set": "SELECT CAST(doc_id AS VARCHAR) AS id, 'text, \"' || doc_id || '\"' AS text, CASE WHEN quality = 1 THEN 'positive' ELSE 'negative' END AS expected_label, 'c' || toxic AS category, 'a, note' AS note FROM labels",
        "q_json_contract": O.ORACLE["q_contract"].replace("SELECT 'PURCHASE' AS ticker, ", "SELECT 'lexicon' AS model, "),
        "q_files_articles": O._with(O._H) + "SELECT source, title, 'http://x/' || seq AS link, CAST(epoch(date_trunc('second', published_at)) AS BIGINT) AS published FROM h",
        "q_files_feed": O._with(O._H) + "SELECT 'part' AS source, title, 'http://x/' || seq AS link, CAST(epoch(date_trunc('second', published_at)) AS BIGINT) AS published FROM h",
        "q_fact_build": O._with(O._H, O._RES.replace("SELECT seq, published_at,", "SELECT seq, published_at, title,"), O._align("a", "rs"), O._B, O._K) + """SELECT a.seq, a.company, a.ticker, CASE WHEN status <> 'resolved' THEN status WHEN k.bar_date IS NULL THEN 'price_error' ELSE 'ok' END AS status, coalesce(k.bar_date, a.session_date) AS session_date,
CASE WHEN k.bar_date IS NOT NULL AND status = 'resolved' THEN round(length(a.title) / 100.0, 4) END AS compound, round(bn.ret, 7) AS contemporaneous_return, round(bn.next_ret, 7) AS lagged_return
FROM a LEFT JOIN k ON k.ticker = a.ticker AND k.session_date = a.session_date LEFT JOIN bn ON bn.ticker = a.ticker AND bn.date = k.bar_date""",
        "q_registered_run": O.ORACLE["q_registered_test"].replace("SELECT f.compound,", "SELECT length(f.title) / 100.0 AS compound,").replace("SELECT n, round(r, 7)", "SELECT TRUE AS met, n, round(r, 7)"),
        "q_model_score": O._with(O._H, "p AS (SELECT seq, length(title) % 5 + 1.0 AS p, length(title) % 3 + 1.0 AS n FROM h)", "s AS (SELECT seq, CAST(p AS DOUBLE) / (p + n + 2) AS pos, CAST(n AS DOUBLE) / (p + n + 2) AS neg, 2e0 / (p + n + 2) AS neu FROM p)")
        + "SELECT seq, round(pos, 7) AS pos, round(neg, 7) AS neg, round(neu, 7) AS neu, round(pos - neg, 7) AS compound, CASE WHEN pos >= neg AND pos >= neu THEN 'positive' WHEN neg >= neu THEN 'negative' ELSE 'neutral' END AS label FROM s",
        "q_slugs": O._with(O._H) + "SELECT seq, 'big_' || ticker || '_co' AS slug FROM h",
        "q_lexicon_score": _lexicon_sql(),
    })


def _lexicon_sql() -> str:
    table = lambda t: "MAP {" + ", ".join(f"'{k.replace(chr(39), chr(39) * 2)}': CAST({v} AS DOUBLE)" for k, v in sorted(t.items())) + "}"
    nots = ", ".join("'" + w.replace("'", "''") + "'" for w in scoring.NEGATIONS)
    near = lambda k: f"coalesce(lag(low, {k}) OVER p, '')"
    return rf"""WITH w AS (SELECT conv_id, turn, text, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT conv_id, turn, text, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS ws FROM conversations)),
b AS (SELECT *, regexp_replace(regexp_replace(word, '^[^\p{{L}}\p{{N}}]+', ''), '[^\p{{L}}\p{{N}}]+$', '') AS bare FROM w),
l AS (SELECT *, lower(bare) AS low, len(bare) > 1 AND upper(bare) = bare AND lower(bare) <> bare AS shouted FROM b),
m AS (SELECT *, bool_or(shouted) OVER g AND NOT bool_and(shouted OR len(bare) <= 1) OVER g AS mixed, {near(1)} AS n1, {near(2)} AS n2, {near(3)} AS n3, coalesce(({table(scoring.LEXICON)})[low], 0.0) AS v0 FROM l
  WINDOW g AS (PARTITION BY conv_id, turn), p AS (PARTITION BY conv_id, turn ORDER BY i)),
v AS (SELECT *, v0 + CASE WHEN mixed AND shouted THEN sign(v0) * {scoring.CAPITALS} ELSE 0 END
  + sign(v0) * (coalesce(({table(scoring.BOOSTERS)})[n1], 0.0) + 0.95 * coalesce(({table(scoring.BOOSTERS)})[n2], 0.0) + 0.9 * coalesce(({table(scoring.BOOSTERS)})[n3], 0.0)) AS pushed FROM m),
x AS (SELECT *, CASE WHEN v0 = 0 THEN 0.0 WHEN n1 IN ({nots}) OR n2 IN ({nots}) OR n3 IN ({nots}) THEN pushed * {scoring.NEGATE} ELSE pushed END AS val FROM v),
s AS (SELECT c.conv_id, c.turn, coalesce(sum(val), 0.0) AS t, coalesce(sum(val + 1) FILTER (val > 0), 0.0) AS plus, coalesce(sum(1 - val) FILTER (val < 0), 0.0) AS minus, count(*) FILTER (val = 0) AS plain,
  least(len(coalesce(any_value(c.text), '')) - len(replace(coalesce(any_value(c.text), ''), '!', '')), {scoring.MAX_BANGS}) * {scoring.BANG} AS bangs FROM conversations c LEFT JOIN x USING (conv_id, turn) GROUP BY 1, 2),
z AS (SELECT conv_id, turn, t + sign(t) * bangs AS t, plus + CASE WHEN plus > minus THEN bangs ELSE 0 END AS plus, minus + CASE WHEN minus > plus THEN bangs ELSE 0 END AS minus, plain FROM s)
SELECT conv_id, turn, coalesce(round(minus / nullif(plus + minus + plain, 0), 3), 0.0) AS neg, coalesce(round(plain / nullif(plus + minus + plain, 0), 3), 0.0) AS neu, coalesce(round(plus / nullif(plus + minus + plain, 0), 3), 0.0) AS pos,
greatest(least(round(t / sqrt(t * t + {scoring.NORMALISER}), 4), 1.0), -1.0) AS compound FROM z"""


_fill()
