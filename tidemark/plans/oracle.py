"""DuckDB SQL for the registered queries, composed of common table expressions."""

from __future__ import annotations

from tidemark.functions import scoring, stats, text
from tidemark.plans import queries as Q

_Z = stats.Z95

_H = """h AS (SELECT event_id AS seq, event_type AS ticker, 's' || (user_id % 3) AS source, event_type || ' event ' || event_id AS title, 'l' || (event_id % 997) AS link,
  ts AS published_at, (value - 50) / (50 + abs(value - 50)) AS compound FROM events)"""
_LOCAL = "published_at + INTERVAL 330 MINUTE"


def _timing(local: str) -> str:
    return f"CASE WHEN isodow({local}) > 5 THEN 'post_close' WHEN CAST({local} AS TIME) < TIME '09:15:00' THEN 'pre_open' WHEN CAST({local} AS TIME) <= TIME '15:30:00' THEN 'intraday' ELSE 'post_close' END"


def _align(name: str, source: str) -> str:
    return f"""{name}_l AS (SELECT *, {_LOCAL} AS local_time FROM {source}),
{name}_t AS (SELECT *, {_timing('local_time')} AS timing FROM {name}_l),
{name} AS (SELECT *, CAST(CASE WHEN timing = 'pre_open' THEN CAST(local_time AS DATE) ELSE CAST(local_time AS DATE) + CASE isodow(local_time) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END END AS DATE) AS session_date FROM {name}_t)"""


_A = _align("a", "h")
_B = f"""b AS (SELECT event_type AS ticker, CAST(ts AS DATE) AS date, arg_min(value, ts) AS open, arg_max(value, ts) AS close FROM events
  WHERE isodow(ts) <= 5 AND CAST(ts AS DATE) NOT IN ({', '.join(f"DATE '{x}'" for x in Q.HOLIDAYS)}) GROUP BY 1, 2 HAVING arg_min(value, ts) <> 0),
bn AS (SELECT *, row_number() OVER w - 1 AS idx, (close - open) / open AS ret, lag(date) OVER w AS prev_date, lag(close) OVER w AS prev_close, lead(date) OVER w AS next_date,
  lead((close - open) / open) OVER w AS next_ret FROM b WINDOW w AS (PARTITION BY ticker ORDER BY date))"""
_K = """k AS (SELECT k.ticker, k.session_date, min(b.date) AS bar_date FROM (SELECT DISTINCT ticker, session_date FROM a) k LEFT JOIN b ON b.ticker = k.ticker AND b.date >= k.session_date GROUP BY 1, 2)"""
_F = f"""{_K},
f AS (SELECT a.seq, a.ticker, a.source, a.title, a.link, a.compound, a.local_time, k.bar_date AS session_date, k.bar_date > a.session_date AS rolled, bn.ret AS contemporaneous_return, bn.next_ret AS lagged_return,
  CASE WHEN bn.prev_date IS NOT NULL AND a.local_time > bn.prev_date + TIME '15:30:00' AND a.local_time < bn.date + TIME '09:00:00' THEN bn.open / bn.prev_close - 1 END AS gap_return
  FROM a JOIN k ON k.ticker = a.ticker AND k.session_date = a.session_date JOIN bn ON bn.ticker = a.ticker AND bn.date = k.bar_date)"""
_M = """m AS (SELECT date, avg(ret) AS market FROM bn GROUP BY date)"""
_E = """e AS (SELECT seq AS event_id, ticker, session_date AS date, CASE WHEN abs(compound) > 0.3 THEN 'high' ELSE 'low' END AS magnitude FROM f),
days AS (SELECT DISTINCT e.ticker, e.date, bn.idx FROM e JOIN bn ON bn.ticker = e.ticker AND bn.date = e.date)"""
_W = """w AS (SELECT e.event_id, e.magnitude, k.k AS "offset", bn.ret - m.market AS ar FROM e JOIN days d ON d.ticker = e.ticker AND d.date = e.date
  CROSS JOIN (SELECT unnest(range(-5, 2)) AS k) k JOIN bn ON bn.ticker = e.ticker AND bn.idx = d.idx + k.k JOIN m ON m.date = bn.date)"""


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


_BASE, _FULL = _with(_H, _A), _with(_H, _A, _B, _F)


def r9(x: str, name: str, n: int = 9) -> str:
    return f"round({x}, {n}) + 0.0 AS {name}"


def _pearson(x: str, y: str) -> str:
    return f"CASE WHEN count({x}) < 2 THEN NULL WHEN min({x}) = max({x}) OR min({y}) = max({y}) THEN 0.0 ELSE covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) END"


def _ends(r: str = "r", n: str = "n") -> str:
    c = f"greatest(least({r}, 1 - 1e-10), -1 + 1e-10)"
    return ", ".join(f"round(CASE WHEN {n} < 4 THEN {edge} ELSE tanh(atanh({c}) {op} {_Z} / sqrt(greatest({n} - 3, 1))) END, 7) AS {name}" for edge, op, name in (("-1.0", "-", "ci_low"), ("1.0", "+", "ci_high")))


def _ci(value: str) -> str:
    return _FULL + f""", c AS (SELECT CASE WHEN grouping(ticker) = 1 THEN 'all' ELSE ticker END AS ticker, {_pearson('x', 'y')} AS r, count(y) AS n
FROM (SELECT ticker, CASE WHEN {value} IS NOT NULL THEN compound END AS x, {value} AS y FROM f) GROUP BY GROUPING SETS ((ticker), ()))
SELECT ticker, n, round(r, 7) AS r, {_ends()} FROM c"""


def _draw(*parts: str) -> str:
    key = " || ':' || ".join([f"'{Q.SEED}'", *(f"CAST({p} AS VARCHAR)" for p in parts)])
    return f"CAST('0x' || substr(md5({key}), 1, 8) AS BIGINT)"


def _coefficients(n: int) -> str:
    """tr: trials with their four coefficients."""
    return f"tr AS (SELECT trial, " + ", ".join(f"{_draw('trial', chr(39) + c + chr(39))} % 2147483647 AS {c}_" for c in "abcd") + f" FROM (SELECT CAST(unnest(range(1, {n + 1})) AS INTEGER) AS trial))"


_TRIALS = _coefficients(Q.TRIALS)
#: Draw of a trial for a row's hash h.
_POLY = "((((a_ * h + b_) % 2147483647) * h + c_) % 2147483647 * h + d_) % 2147483647"


def _strata(source: str, within: str, key: str = "seq", columns: str = "*") -> str:
    """Rows with grp, h and st, the stratum of about 8192 rows inside the group."""
    return f"(SELECT *, h % greatest(1, CAST(ceil(count(*) OVER (PARTITION BY grp) / 8192.0) AS BIGINT)) AS st FROM (SELECT {columns}, {within} AS grp, {_draw(chr(39) + 'fixed' + chr(39), key)} % 2147483647 AS h FROM {source}))"


def _permuted(source: str, donor: str, within: str = "0", key: str = "seq") -> str:
    """p: rows of ``source`` with ``donor`` of another row, per trial."""
    return f"""fs AS {_strata(source, within, key)},
fx AS (SELECT *, row_number() OVER (PARTITION BY grp, st ORDER BY h, {key}) AS rk FROM fs),
dn AS (SELECT trial, grp, st, {donor} AS donor, row_number() OVER (PARTITION BY trial, grp, st ORDER BY {_POLY}, h, {key}) AS rk FROM fs, tr),
p AS (SELECT dn.trial, fx.* EXCLUDE ({donor}, rk, grp, st, h), dn.donor AS {donor} FROM fx JOIN dn ON dn.grp = fx.grp AND dn.st = fx.st AND dn.rk = fx.rk)"""


_RET = """pr AS (SELECT t.ticker, s.session_date, min(b.date) AS bar_date FROM (SELECT DISTINCT ticker FROM a) t CROSS JOIN (SELECT DISTINCT session_date FROM a) s LEFT JOIN b ON b.ticker = t.ticker AND b.date >= s.session_date GROUP BY 1, 2),
rt AS (SELECT pr.ticker, pr.session_date, bn.ret, bn.next_ret AS lagged FROM pr JOIN bn ON bn.ticker = pr.ticker AND bn.date = pr.bar_date)"""


def _summary(real: str) -> str:
    return f"""SELECT count(n0.r) AS n_trials, (count(*) FILTER (abs(n0.r) >= abs(real)) + 1) / (count(n0.r) + 1) AS p_value, round(real, 7) AS real, round(avg(n0.r), 7) AS null_mean, round(stddev_pop(n0.r), 7) AS null_std
FROM n0 CROSS JOIN ({real}) GROUP BY real"""


_AUDIT = _with(_H, _A, _B, _RET, _TRIALS, "ar AS (SELECT seq, ticker, session_date, compound FROM a)", _permuted("ar", "session_date"),
               f"n0 AS (SELECT trial, {_pearson('compound', 'ret')} AS r, count(ret) AS n FROM p JOIN rt USING (ticker, session_date) GROUP BY trial)")


def _fit(by: str = "") -> str:
    """u (usable rows with split), g (fit), of rows ``us`` (seq, compound, y, by)."""
    part, on = (f"PARTITION BY {by}", f"USING ({by})") if by else ("", "ON TRUE")
    keep, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    return f"""u AS (SELECT *, CASE WHEN row_number() OVER ({part} ORDER BY seq) <= greatest(floor(count(*) OVER ({part or ''}) * 0.7), 2) THEN 'train' ELSE 'test' END AS split FROM us),
g0 AS (SELECT {keep}CASE WHEN min(compound) = max(compound) THEN 0.0 ELSE coalesce(covar_pop(y, compound) / nullif(var_pop(compound), 0), 0.0) END AS slope, avg(y) AS my, avg(compound) AS mx FROM u WHERE split = 'train' {group}),
g AS (SELECT {keep}slope, my, my - slope * mx AS intercept FROM g0),
pd AS (SELECT u.*, g.slope, g.intercept, g.my, g.intercept + g.slope * u.compound AS predicted FROM u JOIN g {on})"""


def _r2(split: str) -> str:
    where = f"FILTER (split = '{split}')"
    return f"CASE WHEN sum((y - my) * (y - my)) {where} = 0 THEN 0.0 ELSE 1 - sum((y - predicted) * (y - predicted)) {where} / sum((y - my) * (y - my)) {where} END"


_US = "us AS (SELECT seq, compound, lagged_return AS y FROM f WHERE lagged_return IS NOT NULL)"
_LEX = "MAP {" + ", ".join(f"'{k.replace(chr(39), chr(39) * 2)}': {v}" for k, v in sorted(Q._LEX.items())) + "}"
_SC = f"""sc AS (SELECT doc_id, lang, round(s / sqrt(s * s + {scoring.NORMALISER}), 6) AS compound FROM (SELECT doc_id, lang, list_sum(list_transform(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z]+'), lambda x: coalesce(({_LEX})[x], 0.0))) AS s FROM documents))"""
_LABEL = "CASE WHEN compound >= 0.05 THEN 'positive' WHEN compound <= -0.05 THEN 'negative' ELSE 'neutral' END"
_J = f"""j0 AS (SELECT sc.*, quality, toxic, compound + 0.3 AS pp, 0.4 - compound AS qq FROM sc JOIN labels USING (doc_id)),
j AS (SELECT doc_id, lang, {_LABEL} AS predicted, CASE WHEN pp >= qq AND pp >= 0.35 THEN 'positive' WHEN qq >= 0.35 THEN 'negative' ELSE 'neutral' END AS second,
  CASE WHEN quality = 1 THEN 'positive' WHEN toxic = 1 THEN 'negative' ELSE 'neutral' END AS expected_label FROM j0)"""
_RULE = "CASE " + " ".join(f"WHEN regexp_matches(title, '{p}') THEN {i}" for i, p, _, _ in Q.RULES) + " ELSE -1 END"


def _of_rule(k: int) -> str:
    return "CASE rule " + " ".join(f"WHEN {r[0]} THEN " + ("NULL" if r[k] is None else f"'{r[k]}'") for r in Q.RULES) + " END"


_RES = f"""rs AS (SELECT seq, published_at, {_of_rule(2)} AS company, {_of_rule(3)} AS ticker, CASE WHEN rule = -1 THEN 'no_match' WHEN {_of_rule(3)} IS NULL THEN 'unresolved' ELSE 'resolved' END AS status FROM (SELECT *, {_RULE} AS rule FROM h))"""
_TI = "ti AS (SELECT seq, ([" + ", ".join(f"'{t}'" for t in Q._TITLES) + f"])[seq % {len(Q._TITLES)} + 1] AS title FROM h)"
_MOVE = f"regexp_matches(title, '(?i){text.MOVE_VERBS}{text.MOVE_PERCENT}')"
_TEMPLATE = "regexp_matches(title, '(?i)Share Price Highlights:.*Stock Price History')"
_SCR = "sp AS (SELECT link, 't' || (seq % 1500) AS title, published_at + to_hours(CAST(seq % 50 - 1 AS INTEGER)) AS scraped_at, CASE WHEN seq % 10 = 0 THEN CAST(date_trunc('hour', published_at) AS TIMESTAMP) ELSE published_at END AS published_at FROM h)"
_ZSUM = "0.8416212335729143 + 1.9599639845400538"

ORACLE: dict[str, str] = {
    "q_align": _BASE + "SELECT seq, ticker, local_time, timing, session_date FROM a",
    "q_timing_counts": _BASE + "SELECT timing, session_date, count(*) AS n FROM a GROUP BY 1, 2",
    "q_leak_violations": _BASE + "SELECT count(*) AS n, count(*) FILTER (NOT (session_date + TIME '09:15:00' > local_time)) AS violations FROM a",
    "q_bars": _with(_B) + "SELECT * FROM b",
    "q_bar_neighbours": _with(_B) + f"SELECT ticker, date, CAST(idx AS INTEGER) AS idx, {r9('ret', 'ret')}, prev_date, prev_close, next_date, {r9('next_ret', 'next_ret')} FROM bn",
    "q_compound_return": _with(_B) + "SELECT ticker, date, round(product(1 + (close - open) / open) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) - 1, 6) AS cumulative FROM b WHERE close < 3 * open",
    "q_compound_return_all": _with(_B) + ", c AS (SELECT ticker, date, product(1 + (close - open) / open) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS cumulative FROM b) SELECT ticker, date, round(ln(CASE WHEN cumulative > -1 THEN 1 + cumulative END), 6) AS log_growth FROM c",
    "q_bar_on": _with(_H, _A, _B) + "SELECT b.* FROM b JOIN (SELECT DISTINCT ticker, session_date FROM a) k ON k.ticker = b.ticker AND k.session_date = b.date",
    "q_asof_session": _with(_H, _A, _B, _K) + "SELECT a.seq, a.ticker, a.session_date, k.bar_date, b.open, b.close FROM a JOIN k USING (ticker, session_date) LEFT JOIN b ON b.ticker = a.ticker AND b.date = k.bar_date",
    "q_asof_strict": _with(_H, _A, _B) + "SELECT a.seq, a.ticker, a.session_date, k.bar_date FROM a JOIN (SELECT k.ticker, k.session_date, min(b.date) AS bar_date FROM (SELECT DISTINCT ticker, session_date FROM a) k LEFT JOIN b ON b.ticker = k.ticker AND b.date > k.session_date GROUP BY 1, 2) k USING (ticker, session_date)",
    "q_fact": _FULL + f"SELECT seq, ticker, session_date, rolled, {', '.join(r9(c, c) for c in ('compound', 'contemporaneous_return', 'lagged_return', 'gap_return'))} FROM f",
    "q_gap": _FULL + "SELECT ticker, count(gap_return) AS n, round(avg(gap_return), 6) AS mean_gap FROM f GROUP BY 1",
    "q_proxy": _with(_B, _M) + f"SELECT date, {r9('market', 'market')} FROM m",
    "q_index": _with(_B) + f"SELECT date, {r9('ret', 'market')} FROM bn WHERE ticker = '{Q.INDEX}'",
    "q_abnormal": _with(_H, _A, _B, _F, _M, _E, _W) + f'SELECT event_id, CAST("offset" AS INTEGER) AS "offset", {r9("ar", "ar")} FROM w',
    "q_car": _with(_H, _A, _B, _F, _M, _E, _W) + ', c AS (SELECT *, sum(ar) OVER (PARTITION BY event_id ORDER BY "offset" ROWS UNBOUNDED PRECEDING) AS car FROM w) SELECT magnitude, CAST("offset" AS INTEGER) AS "offset", round(avg(car), 6) AS mean_car, count(*) AS n FROM c GROUP BY 1, 2',
    "q_ar01": _with(_H, _A, _B, _F, _M, _E) + f""", bm AS (SELECT 'proxy' AS benchmark, date, market FROM m UNION ALL SELECT 'index', date, ret FROM bn WHERE ticker = '{Q.INDEX}'),
x AS (SELECT bm.benchmark, e.event_id, e.magnitude, sum(bn.ret - bm.market) AS ar01, count(*) AS k FROM e JOIN days d ON d.ticker = e.ticker AND d.date = e.date JOIN bn ON bn.ticker = e.ticker AND bn.idx BETWEEN d.idx AND d.idx + 1 JOIN bm ON bm.date = bn.date GROUP BY 1, 2, 3)
SELECT benchmark, magnitude, round(avg(ar01), 6) AS mean_ar01, count(*) AS n FROM x WHERE k = 2 GROUP BY 1, 2""",
    "q_corr_ci": _ci("contemporaneous_return"),
    "q_lagged_corr": _ci("lagged_return"),
    "q_gap_corr": _ci("gap_return"),
    "q_demeaned_corr": _FULL + f", c AS (SELECT compound, contemporaneous_return - avg(contemporaneous_return) OVER (PARTITION BY session_date) AS dm FROM f) SELECT round(coalesce({_pearson('compound', 'dm')}, 0.0), 7) AS r, count(dm) AS n FROM c",
    "q_regress": _with(_H, _A, _B, _F, _US, _fit()) + f"""SELECT count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'test') AS n_test, round(any_value(slope), 6) AS slope, round(any_value(intercept), 6) AS intercept,
round({_r2('train')}, 6) AS train_r2, round({_r2('test')}, 6) AS test_r2, round(avg(abs(y - predicted)) FILTER (split = 'train'), 6) AS train_mae, round(avg(abs(y - predicted)) FILTER (split = 'test'), 6) AS test_mae,
round(avg(abs(y - my)) FILTER (split = 'test'), 6) AS baseline_test_mae FROM pd""",
    "q_predictions": _with(_H, _A, _B, _F, _US, _fit()) + "SELECT seq, split, round(predicted, 6) AS predicted_return FROM pd",
    "q_event_split": _FULL + "SELECT CASE WHEN abs(compound) > 0.3 THEN 'high' ELSE 'low' END AS magnitude, count(*) AS n, round(avg(contemporaneous_return), 7) AS mean_return FROM f GROUP BY 1",
    "q_bootstrap": _FULL + f""", o AS (SELECT CASE WHEN abs(compound) > 0.3 THEN 'high' ELSE 'low' END AS g, seq, contemporaneous_return AS v FROM f WHERE contemporaneous_return IS NOT NULL),
rk AS (SELECT g, v, st, h, row_number() OVER (PARTITION BY g, st ORDER BY h, seq) - 1 AS slot, count(*) OVER (PARTITION BY g, st) AS n FROM {_strata('o', 'g')}),
tr AS (SELECT * FROM ({_coefficients(Q.RESAMPLES)[7:-1]})),
dr AS (SELECT trial, g, st, {_POLY} * n // 2147483647 AS slot FROM rk, tr),
ms AS (SELECT dr.trial, avg(v) FILTER (dr.g = 'high') - avg(v) FILTER (dr.g = 'low') AS d FROM dr JOIN rk ON rk.g = dr.g AND rk.st = dr.st AND rk.slot = dr.slot GROUP BY 1),
en AS (SELECT list_sort(list(d)) AS d FROM ms)
SELECT count(*) FILTER (g = 'high') AS n_a, count(*) FILTER (g = 'low') AS n_b, round(avg(v) FILTER (g = 'high') - avg(v) FILTER (g = 'low'), 6) AS diff,
round(any_value(en.d[{int(0.025 * Q.RESAMPLES) + 1}]), 6) AS ci_low, round(any_value(en.d[{int(0.975 * Q.RESAMPLES)}]), 6) AS ci_high FROM o, en""",
    "q_audit": _AUDIT + _summary(f"SELECT {_pearson('compound', 'ret')} AS real FROM ar JOIN rt USING (ticker, session_date)"),
    "q_audit_null": _AUDIT + "SELECT trial, n, round(r, 7) AS r FROM n0",
    "q_within_session": _with(_H, _A, _B, _F, _TRIALS, "wr AS (SELECT seq, session_date, compound, contemporaneous_return AS ret FROM f)", _permuted("wr", "ret", "session_date"),
                              f"n0 AS (SELECT trial, {_pearson('compound', 'ret')} AS r FROM p GROUP BY trial)") + _summary(f"SELECT {_pearson('compound', 'ret')} AS real FROM wr"),
    "q_leakage": _with(_H, _A, _B, _RET, _coefficients(Q.LEAK_TRIALS), "lr AS (SELECT seq, CASE WHEN ticker <> 'signup' THEN ticker END AS ticker, session_date, compound FROM a)", _permuted("lr", "session_date"),
                       "al AS (SELECT 0 AS trial, seq, ticker, session_date, compound FROM lr UNION ALL SELECT trial, seq, ticker, session_date, compound FROM p)",
                       "se AS (SELECT al.*, rt.ret, rt.lagged FROM al JOIN rt USING (ticker, session_date))",
                       "us AS (SELECT trial, seq, compound, lagged AS y FROM se WHERE lagged IS NOT NULL)", _fit("trial"),
                       f"ft AS (SELECT trial, {_r2('test')} AS test_r2, count(*) FILTER (split = 'train') AS a, count(*) FILTER (split = 'test') AS b FROM pd GROUP BY trial)",
                       f"""c AS (SELECT trial, count(*) AS n_resolved, count(lagged) AS n_lagged, {_pearson('x', 'lagged')} AS lagged_r FROM (SELECT *, CASE WHEN lagged IS NOT NULL THEN compound END AS x FROM se) GROUP BY trial)""")
    + "SELECT c.trial, n_resolved, n_lagged, round(lagged_r, 7) AS lagged_r, round(CASE WHEN a >= 2 AND b >= 1 THEN test_r2 END, 6) AS test_r2 FROM c LEFT JOIN ft USING (trial)",
    "q_power": f"""SELECT 'detectable' AS kind, CAST(n AS DOUBLE) AS x, round(tanh(({_ZSUM}) / sqrt(n - 3)), 6) AS y FROM (SELECT unnest([23, 42, 50, 100, 250, 500, 1000, 2000]) AS n)
UNION ALL SELECT 'needed', CAST(r AS DOUBLE), round(pow(({_ZSUM}) / atanh(r), 2) + 3, 3) FROM (SELECT unnest([0.05, 0.1, 0.15, 0.2, 0.28, 0.3]) AS r)""",
    "q_percentiles": _FULL + """, c AS (SELECT DISTINCT ticker, session_date, contemporaneous_return AS v FROM f), l AS (SELECT ticker, list_sort(list(v)) AS v, count(v) AS n FROM c GROUP BY 1)
SELECT ticker, round(v[CAST(floor(n * (1 - 0.95) / 2) AS BIGINT) + 1], 9) + 0.0 AS low, round(v[least(CAST(floor(n * (1 - (1 - 0.95) / 2)) AS BIGINT), n - 1) + 1], 9) + 0.0 AS high FROM l""",
    "q_resolve": _with(_H, _RES) + "SELECT seq, company, ticker, status FROM rs",
    "q_known": " UNION ALL ".join(f"SELECT '{kind}' AS kind, '{name}' AS name" for kind, k in (("ticker", 3), ("company", 2)) for name in sorted({r[k] for r in Q.RULES if r[3]})),
    "q_outcomes": _with(_H, _RES, _align("a", "rs"), _B, _K) + "SELECT CASE WHEN status <> 'resolved' THEN status WHEN k.bar_date IS NULL THEN 'price_error' ELSE 'ok' END AS status, count(*) AS n FROM a LEFT JOIN k ON k.ticker = a.ticker AND k.session_date = a.session_date GROUP BY 1",
    "q_moves": _with(_H, _TI) + f"SELECT seq, {_MOVE} AS moves FROM ti",
    "q_templates": _with(_H, _TI) + f"SELECT {_TEMPLATE} AS template, count(*) AS n FROM ti GROUP BY 1",
    "q_integrity": _with(_H, _SCR) + """, x AS (SELECT 'published_after_scraped' AS "check", link AS example FROM sp WHERE published_at > scraped_at
UNION ALL SELECT 'link_at_several_times', link FROM sp GROUP BY link HAVING count(DISTINCT published_at) > 1
UNION ALL SELECT 'title_at_several_times', title FROM sp GROUP BY title HAVING count(DISTINCT published_at) > 1 AND count(DISTINCT link) < count(DISTINCT published_at)
UNION ALL SELECT 'batch_stamped', CAST(published_at AS VARCHAR) FROM sp GROUP BY published_at HAVING count(*) >= 5)
SELECT "check", count(*) AS n, min(example) AS first_example FROM x GROUP BY 1""",
    "q_dedupe": _with(_H) + "SELECT source, link, min(seq) AS seq, arg_min(title, seq) AS title FROM h GROUP BY 1, 2",
    "q_merge": _with(_H) + "SELECT source, link, arg_min(seq, o) AS seq, arg_min(title, o) AS title FROM (SELECT *, CASE WHEN seq % 3 = 0 THEN 0 ELSE 10000000000 END + seq AS o FROM h) GROUP BY 1, 2",
    "q_upsert": _with(_B) + """, n AS (SELECT ticker, date, open * 2 AS open, close + 1 AS close FROM b WHERE ticker <> 'click' AND date > DATE '2024-01-12')
SELECT * FROM n UNION ALL SELECT * FROM b WHERE date < DATE '2024-01-22' AND (ticker, date) NOT IN (SELECT (ticker, date) FROM n)""",
    "q_usable": _with(_H, _A, _B, _F, _M, _E, _TI) + f""", x AS (SELECT e.event_id, sum(bn.ret - m.market) AS ar01, count(*) AS k FROM e JOIN days d ON d.ticker = e.ticker AND d.date = e.date JOIN bn ON bn.ticker = e.ticker AND bn.idx BETWEEN d.idx AND d.idx + 1 JOIN m ON m.date = bn.date GROUP BY 1)
SELECT count(*) FILTER (k = 2 AND NOT {_MOVE} AND NOT {_TEMPLATE}) AS n, round(avg(ar01) FILTER (k = 2 AND NOT {_MOVE} AND NOT {_TEMPLATE}), 7) AS mean_ar01, count(*) FILTER ({_TEMPLATE}) AS n_templates
FROM (SELECT seq FROM f) f JOIN ti USING (seq) LEFT JOIN x ON x.event_id = f.seq""",
    "q_gate": _FULL + """, c AS (SELECT count(*) AS h, count(DISTINCT session_date) AS s, count(DISTINCT source) AS o FROM f)
SELECT h >= 5000 AND s >= 30 AND o >= 3 AS met, h AS n_headlines, s AS n_sessions, o AS n_sources,
concat_ws('; ', CASE WHEN h < 5000 THEN h || ' headlines, 5000 needed' END, CASE WHEN s < 30 THEN s || ' sessions, 30 needed' END, CASE WHEN o < 3 THEN o || ' sources, 3 needed' END) AS reasons FROM c""",
    "q_registered_test": _with(_H, _A, _B, _F, _M, _E) + f""", x AS (SELECT e.event_id AS seq, sum(bn.ret - m.market) AS ar01, count(*) AS k FROM e JOIN days d ON d.ticker = e.ticker AND d.date = e.date JOIN bn ON bn.ticker = e.ticker AND bn.idx BETWEEN d.idx AND d.idx + 1 JOIN m ON m.date = bn.date GROUP BY 1),
y AS (SELECT f.compound, ar01 - avg(ar01) OVER (PARTITION BY f.session_date) AS dm FROM f JOIN x USING (seq) WHERE k = 2), c AS (SELECT {_pearson('compound', 'dm')} AS r, count(dm) AS n FROM y)
SELECT n, round(r, 7) AS r, {_ends()} FROM c""",
    "q_contract": _BASE + ", l AS (SELECT max(session_date) AS d FROM a) SELECT 'PURCHASE' AS ticker, round(avg(compound), 7) AS score_7d, CAST(count(*) AS INTEGER) AS headline_count_7d, CASE WHEN count(*) = 0 THEN 'none' WHEN count(*) < 5 THEN 'partial' ELSE 'full' END AS coverage FROM a, l WHERE upper(ticker) = 'PURCHASE' AND session_date BETWEEN d - 6 AND d",
    "q_rolling_contracts": _BASE + ", k AS (SELECT DISTINCT ticker, session_date FROM a) SELECT k.ticker, k.session_date AS as_of, round(avg(a.compound), 7) AS score, count(*) AS n, CASE WHEN count(*) < 5 THEN 'partial' ELSE 'full' END AS coverage FROM k JOIN a ON a.ticker = k.ticker AND a.session_date BETWEEN k.session_date - 6 AND k.session_date GROUP BY 1, 2",
    "q_score": _with(_SC) + f"SELECT doc_id, lang, compound, {_LABEL} AS label FROM sc",
    "q_score_summary": _with(_SC) + f"SELECT {_LABEL} AS label, count(*) AS n, round(avg(compound), 5) AS mean_compound FROM sc GROUP BY 1",
    "q_eval": _with(_SC, _J) + "SELECT CASE WHEN grouping(lang) = 1 THEN 'all' ELSE lang END AS lang, count(*) AS n, count(*) FILTER (predicted = expected_label) AS correct, round(count(*) FILTER (predicted = expected_label) / count(*), 9) AS accuracy FROM j GROUP BY GROUPING SETS ((lang), ())",
    "q_eval_comparison": _with(_SC, _J) + "SELECT CASE WHEN grouping(lang) = 1 THEN 'all' ELSE lang END AS lang, count(*) AS n, count(*) FILTER (predicted = expected_label) AS correct_a, count(*) FILTER (second = expected_label) AS correct_b, round(count(*) FILTER (predicted = expected_label) / count(*), 9) AS accuracy_a, round(count(*) FILTER (second = expected_label) / count(*), 9) AS accuracy_b FROM j GROUP BY GROUPING SETS ((lang), ())",
    "q_agreement": _with(_SC, _J) + "SELECT count(*) AS n, count(*) FILTER (predicted = second) AS agreed, round(count(*) FILTER (predicted = second) / count(*), 9) AS rate FROM j",
    "q_disagreements": _with(_SC, _J) + "SELECT doc_id, predicted, second FROM j WHERE predicted <> second",
    "q_confusion": _with(_SC, _J) + "SELECT predicted AS label_a, second AS label_b, count(*) AS n FROM j GROUP BY 1, 2",
    "q_confusion_grid": _with(_SC, _J) + "SELECT predicted AS label_a, " + ", ".join(f"count(*) FILTER (second = '{x}') AS {x}" for x in ("positive", "neutral", "negative")) + " FROM j GROUP BY 1",
    "q_json_articles": _with(_H) + "SELECT CASE WHEN seq % 5 > 0 THEN source ELSE 'gdelt' END AS source, title, 'http://x/' || seq AS link, CAST(epoch(date_trunc('second', published_at)) AS BIGINT) AS published FROM h WHERE seq % 7 <> 0 AND seq % 11 <> 0 AND seq % 13 <> 0",
    "q_xml_items": _with(_H) + "SELECT title, 'http://x/' || seq AS link, CAST(epoch(date_trunc('second', published_at)) AS BIGINT) - CASE WHEN seq % 2 = 0 THEN 19800 ELSE 0 END AS published FROM h WHERE seq % 7 <> 0",
    "q_chart_bars": _with(_B) + "SELECT ticker, date, round(open / 7, 4) AS open, round(close, 4) AS close FROM b WHERE open > 5",
    "q_orders_weekly_sessions": _with("o AS (SELECT o_orderkey, o_orderdate AS published_at FROM orders)", _align("a", "o")) + "SELECT session_date, count(*) AS n FROM a GROUP BY 1",
}
