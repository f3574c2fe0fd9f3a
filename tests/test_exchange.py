"""Exchange files of bounded size, and the order of their rows."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.sources import readers, sinks


def _sizes(path):
    return [sum(1 for _ in f.open()) - 1 for f in sorted(Path(path).glob("part-*"))]


@pytest.fixture
def few(monkeypatch):
    monkeypatch.setattr(sinks, "FILE_ROWS", 10, raising=False)


def _many(spark):
    h = spark.range(0, 95, 1, 4).withColumn("seq", F.col("id"))
    at = F.timestamp_seconds(F.col("id") * 7919 % 90)
    return h.select("seq", F.lit("s").alias("source"), F.concat(F.lit("t "), "id").alias("title"), F.lit("l").alias("link"), at.alias("published_at"), F.lit("raw").alias("published_raw"), at.alias("scraped_at"))


def test_headlines_are_files_of_bounded_size_in_order(spark, few, tmp_path):
    path = f"{tmp_path}/a folder"
    sinks.headlines(_many(spark), path)
    sizes = _sizes(path)
    assert len(sizes) > 9 and max(sizes) <= 10 and sum(sizes) == 95
    back = readers.headlines(spark, path)
    assert back.columns == ["source", "title", "link", "published_at", "published_raw", "scraped_at", "seq"]
    got, want = back.orderBy("seq").collect(), _many(spark).orderBy("published_at", "seq").collect()
    assert [r.title for r in got] == [r.title for r in want] and len({r.seq for r in got}) == 95


def test_rows_of_several_files_are_by_name_and_row(spark, tmp_path):
    for n in (10, 9, 1, 100):  # the largest is read first
        rows = "".join(f'a,"{n} {k}\nmore",l,2026-09-28T09:00:00+05:30,raw,2026-09-28T12:00:00+00:00\n' for k in range(n))
        (tmp_path / f"h{n}.csv").write_text("source,title,link,published_at,published_raw,scraped_at\n" + rows)
    got = [r.title for r in readers.headlines(spark, str(tmp_path)).orderBy("seq").collect()]
    assert got == [f"{n} {k}\nmore" for n in (1, 9, 10, 100) for k in range(n)]


@pytest.mark.parametrize("model", [True, False])
def test_scored_headlines_are_files_of_bounded_size(spark, few, tmp_path, model):
    names = ("positive", "negative", "neutral") if model else ("neg", "neu", "pos")
    rows = _many(spark).select("seq", "source", "title", "link", "published_at", *(F.lit(k / 4).alias(n) for k, n in enumerate(names)), F.lit(0.5).alias("compound"), F.lit("neutral").alias("label"))
    sinks.scored(rows, f"{tmp_path}/s")
    sizes = _sizes(f"{tmp_path}/s")
    assert len(sizes) > 9 and max(sizes) <= 10 and sum(sizes) == 95
    back = readers.scored(spark, f"{tmp_path}/s", model)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.drop("seq").collect()))
