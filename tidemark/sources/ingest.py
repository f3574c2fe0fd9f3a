"""Polite fetching for ingestion jobs, outside of any query: robots rules, rate limits, feeds, URLs."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
import urllib.robotparser
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

AGENT, FLOOR, NEWS_FLOOR = "tidemark/0.1", 3.0, 15.0
NEWS_API = "https://api.gdeltproject.org/api/v2/doc/doc"


CHART_API = "https://query1.finance.yahoo.com/v8/finance/chart"


@dataclass(frozen=True)
class Feed:
    """A named feed; what was fetched of it lies in the landing folder under its name."""

    name: str
    url: str

    @classmethod
    def parse(cls, text: str) -> Feed:
        """Of ``name=url``."""
        name, _, url = text.partition("=")
        return cls(name, url)

    def landed(self, folder: str) -> Path:
        return Path(folder) / f"{self.name}.xml"


def article_file(folder: str, company: str) -> Path:
    """Where the news-API response about a company is kept."""
    return Path(folder) / f"{company.lower().replace(' ', '_')}.json"


def chart_url(ticker: str, span: str = "1mo") -> str:
    """Daily bars of a ticker."""
    return f"{CHART_API}/{urllib.parse.quote(ticker)}?interval=1d&range={span}"


class RobotsDenied(RuntimeError):
    """robots.txt forbids the URL, or couldn't be read."""


class PriceFetchError(RuntimeError):
    """No usable price response after all tries."""


def _host(url: str) -> str:
    p = urllib.parse.urlsplit(url)
    return f"{p.scheme}://{p.netloc}"


@dataclass
class RateLimiter:
    """At least ``floor`` seconds, or the host's crawl delay if longer, between requests to one host."""

    floor: float = FLOOR
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    last: dict[str, float] = field(default_factory=dict)

    def wait(self, url: str, crawl_delay: float | None = None) -> None:
        host, gap = _host(url), max(self.floor, crawl_delay or 0.0)
        if host in self.last and (left := self.last[host] + gap - self.clock()) > 0:
            self.sleep(left)
        self.last[host] = self.clock()


def _open(url: str, timeout: float) -> bytes:
    with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": AGENT}), timeout=timeout) as r:
        return r.read()


@dataclass
class RobotsCache:
    """robots.txt of each host: 401 and 403 deny all, other HTTP errors allow all, no answer denies."""

    fetch: Callable[[str, float], bytes] = _open
    known: dict[str, tuple[str, urllib.robotparser.RobotFileParser]] = field(default_factory=dict)

    def _of(self, url: str) -> tuple[str, urllib.robotparser.RobotFileParser]:
        host = _host(url)
        if host not in self.known:
            parser, status = urllib.robotparser.RobotFileParser(), "ok"
            try:
                parser.parse(self.fetch(f"{host}/robots.txt", 10.0).decode("utf-8", "replace").splitlines())
            except urllib.error.HTTPError as e:
                parser.parse([])
                parser.disallow_all, parser.allow_all = e.code in (401, 403), e.code not in (401, 403)
            except OSError:
                parser.parse([])
                parser.disallow_all, status = True, "unreachable"
            self.known[host] = (status, parser)
        return self.known[host]

    def allowed(self, url: str) -> bool:
        return self._of(url)[1].can_fetch(AGENT, url)

    def status(self, url: str) -> str:
        return self._of(url)[0]

    def crawl_delay(self, url: str) -> float | None:
        delay = self._of(url)[1].crawl_delay(AGENT)
        return float(delay) if delay is not None else None


def polite_get(url: str, robots: RobotsCache, limiter: RateLimiter, timeout: float = 10.0, fetch: Callable[[str, float], bytes] = _open) -> bytes:
    if not robots.allowed(url):
        raise RobotsDenied(url)
    limiter.wait(url, robots.crawl_delay(url))
    return fetch(url, timeout)


def fetch_status(url: str, robots: RobotsCache, limiter: RateLimiter, timeout: float = 10.0, fetch: Callable[[str, float], bytes] = _open, tell_limits: bool = False) -> tuple[bytes | None, str]:
    """(payload, status): ok, robots_denied, robots_unreachable, fetch_failed or, if asked for, rate_limited (HTTP 429)."""
    try:
        return polite_get(url, robots, limiter, timeout, fetch), "ok"
    except RobotsDenied:
        return None, "robots_unreachable" if robots.status(url) == "unreachable" else "robots_denied"
    except urllib.error.HTTPError as e:
        return None, "rate_limited" if e.code == 429 and tell_limits else "fetch_failed"
    except OSError:
        return None, "fetch_failed"


def land(payload: bytes, folder: str, name: str) -> Path:
    """Keep a raw payload in the landing folder that batch and streaming readers watch."""
    path = Path(folder) / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(payload)
    return path


def news_query_url(query: str, maxrecords: int = 50, sourcecountry: str = "India", sourcelang: str = "english") -> str:
    terms = " ".join([query, *(f"{k}:{v}" for k, v in (("sourcecountry", sourcecountry), ("sourcelang", sourcelang)) if v)])
    return f"{NEWS_API}?{urllib.parse.urlencode({'query': terms, 'mode': 'artlist', 'format': 'json', 'maxrecords': maxrecords, 'sort': 'datedesc'})}"


def fetch_chart(url: str, retries: int = 3, fetch: Callable[[str, float], bytes] = _open, sleep: Callable[[float], None] = time.sleep) -> str:
    """JSON text of a chart response; waits 2, 4, ... seconds between tries."""
    for k in range(1, retries + 1):
        try:
            raw = fetch(url, 10.0).decode()
            if json.loads(raw).get("chart", {}).get("result"):
                return raw
        except (OSError, ValueError):
            pass
        if k < retries:
            sleep(2.0 * k)
    raise PriceFetchError(url)
