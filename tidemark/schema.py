"""Declared schemas; nothing is inferred."""

HEADLINE_RAW = "source string, title string, link string, published_at string, published_raw string, scraped_at string"
HEADLINE = "source string, title string, link string, published_at timestamp, published_raw string, scraped_at timestamp, seq long"
PRICE_FILE = "ticker string, bars array<struct<date: date, open: double, close: double>>"
BAR = "ticker string, date date, open double, close double"
RULE = "rule_id int, pattern string, company string, ticker string"
EVAL = "id string, text string, expected_label string, category string, note string"
ARTICLES = "articles array<struct<url: string, url_mobile: string, title: string, seendate: string, socialimage: string, domain: string, language: string, sourcecountry: string>>"
CHART = "chart struct<result: array<struct<timestamp: array<long>, indicators: struct<quote: array<struct<open: array<double>, close: array<double>>>>>>>"
LEXICON_SCORED = "source string, title string, link string, published_at timestamp, neg double, neu double, pos double, compound double, label string"
MODEL_SCORED = "source string, title string, link string, published_at timestamp, positive double, negative double, neutral double, compound double, label string"
FACT_COLUMNS = ("title", "company", "ticker", "source", "session_date", "compound", "contemporaneous_return", "lagged_return", "gap_return")
ALIGNED_COLUMNS = ("source", "title", "link", "published_at", "local_time", "timing", "session_date")
