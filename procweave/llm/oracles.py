"""DuckDB SQL with the same rows as the registered queries, where SQL expresses the method."""

from __future__ import annotations

OP4 = """
WITH people AS (
  SELECT DISTINCT conv_id, role AS assistant FROM conversations WHERE role IS NOT NULL AND role <> 'system'),
seen AS (
  SELECT c.conv_id, p.assistant, CAST(c.turn AS BIGINT) AS turn, c.role AS speaker, c.text AS body,
         '<|im_start|>' || CASE WHEN coalesce(c.role, 'unknown') = 'system' THEN 'system'
                                WHEN c.role = p.assistant THEN 'assistant'
                                ELSE 'user name=' || coalesce(c.role, 'unknown') END || chr(10) AS head
  FROM conversations c JOIN people p ON c.conv_id IS NOT DISTINCT FROM p.conv_id),
rendered AS (
  SELECT *, head || coalesce(body, '') || '<|im_end|>' || chr(10) AS segment FROM seen),
placed AS (
  SELECT *, row_number() OVER w - 1 AS seq,
         coalesce(sum(length(segment)) OVER (PARTITION BY conv_id, assistant
           ORDER BY turn NULLS FIRST, speaker NULLS FIRST, body NULLS FIRST
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM rendered WINDOW w AS (PARTITION BY conv_id, assistant ORDER BY turn NULLS FIRST, speaker NULLS FIRST, body NULLS FIRST))
SELECT conv_id, assistant, CAST(seq AS BIGINT) AS seq, turn, speaker, segment, CAST(start AS BIGINT) AS start,
       CAST(start + length(segment) AS BIGINT) AS "end",
       CAST(CASE WHEN speaker = assistant THEN start + length(head) END AS BIGINT) AS mask_start,
       CAST(CASE WHEN speaker = assistant THEN start + length(segment) - 1 END AS BIGINT) AS mask_end
FROM placed
"""

_LEVEL = """
{name} AS (
  SELECT count(*) AS k, sum(ss) AS s, sum(a) AS a, sum(b) AS b FROM (
    SELECT sum(bad * bad / CAST(n AS DOUBLE)) - sum(bad) * sum(bad) / CAST(sum(n) AS DOUBLE) AS ss,
           (sum(bad) / CAST(sum(n) AS DOUBLE)) * (1 - sum(bad) / CAST(sum(n) AS DOUBLE)) * (sum(n) - sum(n * n) / CAST(sum(n) AS DOUBLE)) AS a,
           (sum(bad) / CAST(sum(n) AS DOUBLE)) * (1 - sum(bad) / CAST(sum(n) AS DOUBLE)) * (count(*) - 1) AS b
    FROM {children} WHERE n > 0 GROUP BY {parent}) g),
{name}_k AS (
  SELECT 1 / least(greatest(CASE WHEN s IS NULL OR a - b <= 0 THEN 0.001 ELSE (s - b) / (a - b) END, 0.001), 0.9) - 1 AS k FROM {name})"""

OP7 = r"""
WITH parsed AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
marks AS (
  SELECT p.page_id, max(CASE WHEN l.quality = 0 OR l.toxic = 1 THEN 1 WHEN l.quality IS NOT NULL AND l.toxic IS NOT NULL THEN 0 END) AS bad
  FROM parsed p JOIN labels l ON l.doc_id = TRY_CAST(nullif(regexp_extract(p.path, '/([0-9]{1,18})(?:\.html)?/?$', 1), '') AS BIGINT)
  WHERE p.page_id IS NOT NULL GROUP BY p.page_id HAVING max(CASE WHEN l.quality = 0 OR l.toxic = 1 THEN 1 WHEN l.quality IS NOT NULL AND l.toxic IS NOT NULL THEN 0 END) IS NOT NULL),
counted AS (
  SELECT host, count(m.bad) AS n, coalesce(sum(m.bad), 0) AS bad FROM parsed LEFT JOIN marks m USING (page_id) GROUP BY host),
bare AS (
  SELECT *, string_split(regexp_replace(regexp_replace(host, '^(?s:.*)@', ''), ':[0-9]*$', ''), '.') AS x FROM counted),
hosts AS (
  SELECT host, n, bad,
         CASE WHEN array_to_string(x[-2:], '.') IN ('co.uk', 'org.uk', 'ac.uk', 'com.au', 'co.jp', 'com.br', 'co.in') THEN array_to_string(x[-3:], '.') ELSE array_to_string(x[-2:], '.') END AS domain,
         CASE WHEN array_to_string(x[-2:], '.') IN ('co.uk', 'org.uk', 'ac.uk', 'com.au', 'co.jp', 'com.br', 'co.in') THEN array_to_string(x[-2:], '.') ELSE x[-1] END AS suffix
  FROM bare),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, 1 AS one, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL),
overall AS (SELECT CASE WHEN sum(n) > 0 THEN sum(bad) / CAST(sum(n) AS DOUBLE) ELSE 0.5 END AS p FROM suffixes),""" + ",".join((
    _LEVEL.format(name="host_level", children="hosts", parent="domain"),
    _LEVEL.format(name="domain_level", children="domains", parent="suffix"),
    _LEVEL.format(name="suffix_level", children="suffixes", parent="one"))) + r""",
suffix_post AS (SELECT suffix, (k * p + bad) / (k + n) AS m FROM suffixes, suffix_level_k, overall),
domain_post AS (SELECT domain, suffix, (k * m + bad) / (k + n) AS m FROM domains JOIN suffix_post USING (suffix), domain_level_k),
host_post AS (
  SELECT host, k * m + h.bad AS al, k * (1 - m) + h.n - h.bad AS be FROM hosts h JOIN domain_post USING (domain, suffix), host_level_k),
shape AS (
  SELECT host, al, be, ln(al / be) AS c, sqrt(1 / al + 1 / be) AS sd, asinh(12 + 30 / (least(al, be) * sqrt(1 / al + 1 / be))) AS r
  FROM host_post WHERE al > 0 AND be > 0),
grid AS (
  SELECT *, c + sd * (exp(r * x) - exp(-r * x)) / 2 AS u, (exp(r * x) + exp(-r * x)) / 2 AS jac
  FROM (SELECT *, 2 * i / 256.0::DOUBLE - 1 AS x FROM shape, (SELECT unnest(range(257)) AS i))),
density AS (
  SELECT host, i, c, sd, r, jac * exp(al * (u - c) - (al + be) * (greatest(u, 0) + ln(1 + exp(-abs(u))) - greatest(c, 0) - ln(1 + exp(-abs(c))))) AS w
  FROM grid),
cells AS (
  SELECT *, coalesce((w + lag(w) OVER (PARTITION BY host ORDER BY i)) / 2, 0) AS mass, 0.05::DOUBLE * sum(w) OVER (PARTITION BY host) AS goal
  FROM density),
summed AS (SELECT *, sum(mass) OVER (PARTITION BY host ORDER BY i) AS upto FROM cells),
cut AS (
  SELECT host, any_value(c) AS c, any_value(sd) AS sd, any_value(r) AS r,
         min_by(i - 1 + (goal - (upto - mass)) / mass, i) AS pos
  FROM summed WHERE upto >= goal GROUP BY host),
rated AS (
  SELECT h.host, al / (al + be) AS mean,
         CASE WHEN al <= 0 THEN 0 WHEN be <= 0 THEN 1
              ELSE least(al / (al + be), 1 / (1 + exp(-(c + sd * (exp(r * (2 * pos / 256 - 1)) - exp(-r * (2 * pos / 256 - 1))) / 2)))) END AS low
  FROM host_post h LEFT JOIN cut USING (host)),
ruled AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM parsed)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN low > 0.5 THEN 'block' ELSE 'allow' END AS verdict,
       round(mean, 9) AS bad_rate, round(low, 6) AS bad_rate_lower
FROM ruled JOIN rated USING (host)
"""

OP11 = r"""
WITH terms AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents),
sizes AS (SELECT doc_id, count(*) AS n FROM terms GROUP BY doc_id),
corpus AS (SELECT CAST(count(*) AS BIGINT) AS nd, CAST(sum(n) AS BIGINT) AS l FROM sizes),
wanted AS (
  SELECT item_id, term, count(*) AS c FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark) GROUP BY item_id, term),
counts AS (SELECT doc_id, term, count(*) AS tf FROM terms WHERE term IN (SELECT term FROM wanted) GROUP BY doc_id, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(nd) + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM counts, corpus GROUP BY term),
scores AS (
  SELECT item_id, doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // l)))) AS BIGINT) AS score
  FROM wanted JOIN weights USING (term) JOIN counts USING (term) JOIN sizes USING (doc_id), corpus
  GROUP BY item_id, doc_id),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""

ORACLES: dict[str, str] = {"op4_chat_perspectives": OP4, "op7_url_filter": OP7, "op11_ranked_search": OP11}
