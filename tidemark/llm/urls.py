"""URL filters: host and path rules first, else a logistic regression on hashed character n-grams.

The model is trained on the driver from a small labelled table of URLs (a parameter of
:func:`train`; ``LABELLED`` by default) by Newton-damped full-batch descent on indicators of the 3- to
5-grams of host and path, kept apart by a marker. Its weights have a fixed size, so they may be
broadcast. Hosts and paths are parsed by Spark functions; distinct (host, path) pairs needn't be
gathered, each row is judged where it is.

Defined results: a null URL, or one without ``://``, has an empty host and path; an empty host fits
no rule and is judged by the model like any other text; repeated rows are judged alike; an empty
table gives no rows. Other columns than ``page_id`` and ``url`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import kernel as K

LOG2, ORDERS = 16, (3, 4, 5)

#: (host, path, verdict). A rule fits its host and all subdomains, if the path starts with its own.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

# Names of hosts: kinds of sites that blocklists hold, and everyday words and kinds of sites that they don't.
_BAD_WORDS = (
    "casino", "bigwin-casino", "slots", "jackpot", "poker", "bets", "betting", "bet-now", "lottery", "roulette", "blackjack", "bingo-cash",
    "pills", "viagra", "pharma-deal", "cheap-meds", "adult", "xxx", "porn", "sex-chat", "escort", "nude", "camgirls", "hot-dating",
    "spam", "link-farm", "seo-farm", "ads", "adserver", "track-click", "tracker", "popunder", "clickbait", "banner-ads", "pixel-track",
    "free-money", "cash-now", "quick-loan", "payday", "crypto-win", "free-gift", "prize-claim", "warez", "torrent-free", "keygen", "malware", "crack-download", "phish-login",
)
_GOOD_WORDS = (
    "news", "library", "museum", "university", "school", "science", "journal", "archive", "garden", "kitchen", "weather", "history", "docs", "wiki", "forum", "blog",
    "street", "river", "mountain", "village", "theatre", "orchard", "harbour", "bridge", "castle", "forest", "meadow", "lantern", "airport", "railway", "hospital", "council",
    "python", "developer", "openstreet", "software", "research", "medicine", "physics", "biology", "chemistry", "engineering", "mathematics", "statistics", "economics", "law-review",
    "times", "herald", "gazette", "tribune", "chronicle", "observer", "radio", "cinema", "orchestra", "gallery", "festival", "cycling", "football", "hiking", "cooking", "travel",
    "government", "parliament", "ministry", "police", "energy", "transport", "farmers", "bakery", "bookshop", "furniture", "carpentry", "knitting", "astronomy", "birds", "insurance", "company",
    "world", "people", "house", "summer", "winter", "water", "paper", "letter", "silver", "golden", "green", "north", "south", "island", "valley", "garage",
)
_PATHS = {
    1: ("/", "/win/bonus.html", "/click/88", "/free/download", "/promo", "/go/offer", "/signup/bonus", "/banner/1"),
    0: ("/", "/articles/spring.html", "/about", "/2019/04/report.html", "/docs/index.html", "/wiki/Main_Page", "/search", "/contact"),
}
_ANY_PATHS = ("/en/12", "/fr/7/", "/de/203", "/page/3", "/index.html")  # as good as bad
BAD_SHARE = 0.2  # of URLs, taken for granted: what resembles nothing in the table is let through


def _labelled() -> tuple[tuple[str, int], ...]:
    """A small table of labelled URLs (1: block), written out from short word lists."""
    out = []
    subs, tops = ("", "www.", "m.", "blog.", "en."), ("com", "org", "net", "info")
    for label, names in ((1, _BAD_WORDS), (0, _GOOD_WORDS)):
        paths = (*_PATHS[label], *_ANY_PATHS)
        for i, name in enumerate(names):
            for j in range(6):
                host = f"{subs[(i + j) % 5]}{name}{('', '.example', '-online')[(i + j) % 3]}.{tops[(i + j // 2) % 4]}"
                out.append((f"http{'s' * (j % 2)}://{host}{paths[(5 * i + j) % len(paths)]}", label))
    return tuple(out)


LABELLED = _labelled()


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` up to ``/``, ``?``, ``#``; path then up to ``?`` or ``#``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return _lower(F.regexp_extract(rest, r"\A([^/?#]*)", 1)), F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def by_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as ``host + path`` of the rule, and its verdict; else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def indicators(host: bytes, path: bytes) -> np.ndarray:
    """Indices of the distinct n-grams of a host and a path."""
    out = []
    for mark, part in ((1, host), (2, path)):
        data = np.frombuffer(b"\x02" + part + b"\x03", dtype=np.uint8).astype(np.uint64)
        for n in ORDERS:
            if len(data) >= n:
                x = np.full(len(data) - n + 1, mark + 8 * n, dtype=np.uint64)
                for j in range(n):
                    x = (x << np.uint64(8)) | data[j : j + len(x)]
                out.append(K.mix(x) >> np.uint64(64 - LOG2))
    return np.unique(np.concatenate(out)).astype(np.int64) if out else np.zeros(0, dtype=np.int64)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, host: str, path: str) -> float:
        """Probability of block."""
        x = indicators(host.encode(), path.encode())
        return float(1 / (1 + np.exp(-(self.bias + self.weights[x].sum() / np.sqrt(max(1, len(x)))))))


def split(url: str | None) -> tuple[str, str]:
    """:func:`host_and_path` of one string."""
    _, mark, rest = (url or "").partition("://")
    end = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    host, path = (rest[:end], rest[end:]) if mark else ("", "")
    stop = min((i for i in (path.find(c) for c in "?#") if i >= 0), default=len(path))
    return host.translate(str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})), path[:stop]


def train(labelled=LABELLED, l2: float = 1e-3, rounds: int = 300, rate: float = 8.0, bad_share: float = BAD_SHARE) -> Model:
    """Logistic regression by full-batch descent with momentum; deterministic. Classes are weighed to ``bad_share``."""
    rows = [indicators(*(x.encode() for x in split(u))) for u, _ in labelled]
    y = np.array([v for _, v in labelled], dtype=float)
    flat, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    value = 1 / np.sqrt(np.array([max(1, len(r)) for r in rows]))[owner]
    balance = np.where(y > 0, bad_share / max(1, y.sum()), (1 - bad_share) / max(1, (1 - y).sum()))
    w, bias, dw, db = np.zeros(1 << LOG2), 0.0, np.zeros(1 << LOG2), 0.0
    for _ in range(rounds):
        z = bias + np.bincount(owner, weights=w[flat] * value, minlength=len(rows))
        err = (1 / (1 + np.exp(-z)) - y) * balance
        dw = 0.9 * dw - rate * (np.bincount(flat, weights=err[owner] * value, minlength=1 << LOG2) + l2 / len(rows) * w)
        db = 0.9 * db - 0.2 * float(err.sum())
        w, bias = w + dw, bias + db
    return Model(w, bias)


def judge(pages: DataFrame, model: Model | None = None, rules=RULES, block_from: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's score of each page."""
    model = model or train()
    shared = pages.sparkSession.sparkContext.broadcast(model)  # 2**LOG2 weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple[str, str], float] = {}
        for b in batches:
            out = []
            for key in zip(b.column("host").to_pylist(), b.column("path").to_pylist(), strict=True):
                if key not in kept:
                    if len(kept) >= 50_000:
                        kept.clear()
                    kept[key] = shared.value.score(*key)
                out.append(kept[key])
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in ("page_id", "host", "path", "rule", "ruled")), pa.array(out, pa.float64())], names=["page_id", "host", "path", "rule", "ruled", "score"])

    host, path = host_and_path(F.col("url"))
    parsed = pages.select(F.col("page_id").cast("long"), host.alias("host"), path.alias("path"))
    rule, verdict = by_rule(F.col("host"), F.col("path"), rules)
    scored = parsed.select("*", rule.alias("rule"), verdict.alias("ruled")).mapInArrow(run, "page_id long, host string, path string, rule string, ruled string, score double")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") >= block_from, "block").otherwise("allow")).alias("verdict"), "score")
