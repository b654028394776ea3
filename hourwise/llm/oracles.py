"""DuckDB SQL of the queries that SQL can express, each a plain formulation over all pairs or windows."""

from __future__ import annotations

from hourwise.llm.mixing import WEIGHTS
from hourwise.llm.urlfilter import RULES

LOWER = "translate(coalesce({c}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_text = LOWER.format(c="text")
_rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
_weights = ", ".join("(" + ", ".join("NULL" if x is None else repr(x) for x in w) + ")" for w in WEIGHTS)

URLS = f"""
WITH r(rh, rp, v) AS (VALUES {_rules}),
p AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (
  SELECT page_id, {LOWER.format(c="regexp_extract(rest, '^[^/?#]*')")} AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM p)
SELECT page_id, host, path,
  (SELECT arg_max(rh || rp, length(rh || rp) * 1000 + length(rh)) FROM r
    WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS rule,
  coalesce((SELECT arg_max(v, length(rh || rp) * 1000 + length(rh)) FROM r
    WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)), 'allow') AS verdict
FROM u"""

_words = r"regexp_extract_all({t}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
DECONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, {_words.format(t=_text)} AS w FROM documents),
b AS (SELECT item_id, {_words.format(t=_text)} AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, list_slice(w, i, i + least(10, len(w)) - 1) AS s
  FROM b, unnest(range(1, greatest(1, len(w) - 9) + 1)) t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT rn, i, sizes.n AS n, list_slice(w, i, i + sizes.n - 1) AS s
  FROM d, sizes, unnest(range(1, len(w) - sizes.n + 2)) t(i)),
h AS (SELECT rn, i, dw.n AS n, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.s = iw.s),
hit AS (SELECT rn, count(DISTINCT k) AS n_hit FROM h, unnest(range(i, i + n)) t(k) GROUP BY rn),
items AS (SELECT rn, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM h GROUP BY rn)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rn) LEFT JOIN items USING (rn)"""

EMBEDDINGS = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS rn, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
ok AS (SELECT *, sqrt(list_dot_product(e, e)) AS len FROM v
  WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.rn AS a, b.rn AS b FROM ok a JOIN ok b ON a.rn <> b.rn AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.len * b.len) >= 0.9),
reach(a, b) AS (SELECT rn, rn FROM v UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
c AS (SELECT a AS rn, min(vec_id) AS component_id FROM reach JOIN v ON v.rn = reach.b GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = v.rn) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN c USING (rn)"""

NEAR_DUPLICATES = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rn, doc_id, regexp_extract_all({_text}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT rn, list_slice(w, i, i + 4) AS g FROM d, unnest(range(1, greatest(1, len(w) - 4) + 1)) t(i) WHERE len(w) > 0),
n AS (SELECT rn, count(*) AS n FROM s GROUP BY rn),
l AS (
  SELECT a.rn AS a, b.rn AS b FROM s a JOIN s b ON a.g = b.g AND a.rn <> b.rn JOIN n na ON na.rn = a.rn JOIN n nb ON nb.rn = b.rn
  GROUP BY a.rn, b.rn, na.n, nb.n HAVING 100 * count(*) >= 85 * (na.n + nb.n - count(*))),
reach(a, b) AS (SELECT rn, rn FROM d UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
c AS (SELECT a AS rn, min(doc_id) AS component_id FROM reach JOIN d ON d.rn = reach.b GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM d JOIN c USING (rn) LEFT JOIN n USING (rn)"""


def _level(keys: list[str], parent: list[str]) -> str:
    """Water filling of one level: cap{depth} and weights to shares."""
    k, p, n = ", ".join(keys), ", ".join(parent), len(keys)
    by = f"PARTITION BY {p}" if p else ""
    join = f"JOIN f{n - 1} USING ({p})" if p else ", (SELECT least((SELECT floor(sum(n_tokens) * 0.6) FROM leaf), sum(cap)) AS share FROM c1) total"
    src = f"(SELECT {k}, cap, weight, share AS budget FROM c{n} {join})"
    return f"""
r{n} AS (SELECT *, CASE WHEN weight > 0 THEN cap / weight END AS ratio FROM {src}),
q{n} AS (SELECT *,
  coalesce(sum(cap) OVER ({by} ORDER BY ratio NULLS LAST, {keys[-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fullb,
  sum(weight) OVER ({by} ORDER BY ratio NULLS LAST, {keys[-1]} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wl FROM r{n}),
w{n} AS (SELECT *, (budget - fullb) / wl AS lev FROM q{n}),
f{n} AS (SELECT {k}, CASE WHEN ratio <= lev THEN cap ELSE least(cap, weight * (arg_min(lev, ratio) FILTER (WHERE ratio > lev) OVER ({by}))) END AS share FROM w{n})"""


MIXING = rf"""
WITH wt(domain, lang, source, weight) AS (VALUES {_weights}),
d AS (
  SELECT doc_id, CASE WHEN regexp_matches(coalesce(source, '-'), '[0-9][0-9]$') THEN 'web' ELSE 'core' END AS domain,
    coalesce(lang, '-') AS lang, coalesce(source, '-') AS source,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens, md5(coalesce(text, '')) AS tm FROM documents),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS n_tokens FROM d WHERE n_tokens > 0 GROUP BY ALL),
c3 AS (SELECT leaf.domain, leaf.lang, leaf.source, (n_tokens * 4)::DOUBLE AS cap, coalesce(weight, 1)::DOUBLE AS weight
  FROM leaf LEFT JOIN wt ON leaf.domain = wt.domain AND leaf.lang = wt.lang AND leaf.source = wt.source),
c2 AS (SELECT x.domain, x.lang, x.cap, coalesce(weight, 1)::DOUBLE AS weight FROM (SELECT domain, lang, sum(cap) AS cap FROM c3 GROUP BY ALL) x
  LEFT JOIN wt ON x.domain = wt.domain AND x.lang = wt.lang AND wt.source IS NULL),
c1 AS (SELECT x.domain, x.cap, coalesce(weight, 1)::DOUBLE AS weight FROM (SELECT domain, sum(cap) AS cap FROM c2 GROUP BY ALL) x
  LEFT JOIN wt ON x.domain = wt.domain AND wt.lang IS NULL AND wt.source IS NULL),
{_level(["domain"], [])},{_level(["domain", "lang"], ["domain"])},{_level(["domain", "lang", "source"], ["domain", "lang"])},
plan AS (SELECT domain, lang, source, n_tokens AS n, floor(share + 1e-6)::BIGINT AS budget FROM leaf JOIN f3 USING (domain, lang, source)),
x AS (SELECT d.*, budget // n AS whole, budget - (budget // n) * n AS rest FROM d JOIN plan USING (domain, lang, source) WHERE n_tokens > 0),
y AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source
  ORDER BY md5('17:' || whole || ':' || coalesce(doc_id::VARCHAR, '-')), tm ROWS UNBOUNDED PRECEDING) AS run FROM x)
SELECT doc_id, domain, lang, source, n_tokens, e::INTEGER AS epoch FROM x, unnest(range(0, whole)) t(e)
UNION ALL SELECT doc_id, domain, lang, source, n_tokens, whole::INTEGER FROM y WHERE run <= rest"""

LINES = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT doc_id, line, i, coalesce(keeper <> doc_id, false) AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id"""

ORACLES = {
    "op1_url_filters": URLS,
    "op2_decontamination": DECONTAMINATION,
    "op7_embeddings": EMBEDDINGS,
    "op8_mixing": MIXING,
    "op9_minhash": NEAR_DUPLICATES,
    "op13_line_dedup": LINES,
}
