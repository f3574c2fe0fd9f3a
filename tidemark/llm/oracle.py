"""DuckDB SQL for the operators of this subpackage whose result SQL can express."""

from __future__ import annotations

_WORDS = r"list_filter(string_split_regex({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWER = "translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(text=_LOWER.format(text="coalesce(text, '')"))} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS k FROM s GROUP BY 1),
c AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY k) AS class_id FROM n),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(c.n, 0) AS n_shingles, m.component_id, coalesce(c.class_id, w.doc_id) AS class_id, w.doc_id = m.component_id AS kept
FROM w LEFT JOIN c USING (doc_id) JOIN m USING (doc_id)"""

OP10 = f"""WITH w AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS ws FROM documents),
v AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)),
f AS (SELECT k, min(doc_id) AS lo FROM v GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, i + j AS place FROM (SELECT doc_id, i, unnest(range(0, 50)) AS j FROM v JOIN f USING (k) WHERE lo < doc_id)),
one AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS place FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS t FROM one ANTI JOIN gone USING (doc_id, place) GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""

_MARKS = r"'^[ \t]*>[> \t]*'"
_NORMAL = r"trim(regexp_replace(" + _LOWER + r", '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
OP3 = rf"""WITH RECURSIVE l AS (SELECT conv_id, turn, role, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS place FROM (SELECT *, string_split(coalesce(text, ''), chr(10)) AS ls FROM conversations)),
q AS (SELECT *, regexp_matches(line, {_MARKS}) AS quoted FROM l),
z AS (SELECT *, NOT quoted AND NOT (regexp_matches(line, '(?i)^[ \t]*on .* wrote:[ \t]*$') AND coalesce(lead(quoted) OVER (PARTITION BY conv_id, turn ORDER BY place), false)) AS written,
  len(regexp_replace(regexp_extract(line, {_MARKS}), '[^>]', '', 'g')) AS level, {_NORMAL.format(text=f"regexp_replace(line, {_MARKS}, '')")} AS said, {_NORMAL.format(text="line")} AS own FROM q),
m AS (SELECT conv_id, turn, any_value(role) AS role, trim(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (written), ''), chr(10) || ' ') AS clean_text,
  CAST(count(*) FILTER (quoted AND len(said) >= 3) AS INTEGER) AS n_quoted_lines, CAST(coalesce(max(level) FILTER (quoted AND len(said) >= 3), 0) AS INTEGER) AS max_level, min(level) FILTER (quoted AND len(said) >= 3) AS least FROM z GROUP BY 1, 2),
asked AS (SELECT z.conv_id, z.turn, z.said, z.place FROM z JOIN m USING (conv_id, turn) WHERE z.quoted AND len(z.said) >= 3 AND z.level = m.least),
src AS (SELECT a.conv_id, a.turn, a.place, max(o.turn) AS source FROM asked a JOIN z o ON o.conv_id = a.conv_id AND o.written AND o.own = a.said AND len(o.own) >= 3 AND o.turn < a.turn GROUP BY 1, 2, 3),
par AS (SELECT conv_id, turn, arg_max(source, n * 1000000000 + source) AS reply_to FROM (SELECT conv_id, turn, source, count(*) AS n FROM src GROUP BY 1, 2, 3) GROUP BY 1, 2),
t AS (SELECT m.conv_id, m.turn, m.turn AS root, 0 AS depth FROM m ANTI JOIN par USING (conv_id, turn) UNION ALL SELECT par.conv_id, par.turn, t.root, t.depth + 1 FROM par JOIN t ON t.conv_id = par.conv_id AND t.turn = par.reply_to)
SELECT m.conv_id, m.turn, m.role, m.clean_text, m.n_quoted_lines, m.max_level, par.reply_to, t.root, t.depth, row_number() OVER (PARTITION BY m.conv_id ORDER BY t.root, m.turn) - 1 AS position
FROM m LEFT JOIN par USING (conv_id, turn) JOIN t USING (conv_id, turn)"""

ORACLE = {"op2_minhash": OP2, "op3_conversations": OP3, "op10_substring_dedup": OP10}
