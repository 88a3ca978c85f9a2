"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

from routelab.llm.url_reputation import LOWER, UPPER


def _strength(level: str, parent_rate: str) -> str:
    """SQL for kappa, the prior's weight in labels, of a level: (1 - rho) / rho of the beta-binomial's rho, kept off 0 and 1."""
    spread = f"SUM(n * (1e0 * k / n - {parent_rate}) * (1e0 * k / n - {parent_rate}) / ({parent_rate} * (1 - {parent_rate})))"
    free = "(SUM(n) - 1e0 * SUM(n * n) / SUM(n) - COUNT(*) + 1)"
    rho = f"COALESCE(({spread} - COUNT(*) + 1) / NULLIF({free}, 0), 0e0)"
    return f"SELECT (1 - r) / r AS kappa FROM (SELECT LEAST(GREATEST({rho}, 1e-7), 1 - 1e-7) AS r FROM {level}) x"


HOSTS = f"""
WITH cut AS (SELECT page_id, CASE WHEN INSTR(url, '://') > 0 THEN SUBSTRING(url, INSTR(url, '://') + 3) ELSE '' END AS rest FROM pages),
page AS (SELECT page_id, TRANSLATE(REGEXP_EXTRACT(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                REGEXP_EXTRACT(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
outcome AS (SELECT doc_id AS page_id, MAX(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad
            FROM labels WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY doc_id),
host AS (SELECT host, CAST(COUNT(bad) FILTER (host <> '') AS BIGINT) AS n, CAST(COALESCE(SUM(bad) FILTER (host <> ''), 0) AS BIGINT) AS k,
                array_to_string(string_split(host, '.')[-2:], '.') AS domain, string_split(host, '.')[-1] AS suffix
         FROM page LEFT JOIN outcome ON page.page_id = outcome.page_id GROUP BY host),
domain_ AS (SELECT domain, suffix, CAST(SUM(n) AS BIGINT) AS n, CAST(SUM(k) AS BIGINT) AS k FROM host WHERE n > 0 GROUP BY domain, suffix),
suffix_ AS (SELECT suffix, CAST(SUM(n) AS BIGINT) AS n, CAST(SUM(k) AS BIGINT) AS k FROM domain_ GROUP BY suffix),
base AS (SELECT CASE WHEN COALESCE(SUM(n), 0) = 0 THEN 0e0 ELSE (SUM(k) + 5e-1) / (SUM(n) + 1e0) END AS m FROM suffix_),
suffix_in AS (SELECT suffix, n, k, (SELECT m FROM base) AS up FROM suffix_),
suffix_k AS ({_strength("suffix_in", "up")}),
suffix_m AS (SELECT suffix, (k + (SELECT kappa FROM suffix_k) * up) / (n + (SELECT kappa FROM suffix_k)) AS m FROM suffix_in),
domain_in AS (SELECT domain_.domain, domain_.n, domain_.k, suffix_m.m AS up FROM domain_ JOIN suffix_m ON domain_.suffix = suffix_m.suffix),
domain_k AS ({_strength("domain_in", "up")}),
domain_m AS (SELECT domain, (k + (SELECT kappa FROM domain_k) * up) / (n + (SELECT kappa FROM domain_k)) AS m FROM domain_in),
host_in AS (SELECT host.host, host.n, host.k, COALESCE(domain_m.m, suffix_m.m, (SELECT m FROM base)) AS up
            FROM host LEFT JOIN domain_m ON host.domain = domain_m.domain LEFT JOIN suffix_m ON host.suffix = suffix_m.suffix),
labelled AS (SELECT n, k, up FROM host_in WHERE n > 0),
host_k AS ({_strength("labelled", "up")}),
host_ab AS (SELECT host, k + (SELECT kappa FROM host_k) * up AS a, n - k + (SELECT kappa FROM host_k) * (1 - up) AS b FROM host_in),
judged AS (SELECT host, CASE WHEN a / (a + b) - 0.674e0 * SQRT(a * b / ((a + b) * (a + b) * (a + b + 1))) > (SELECT m FROM base) THEN 'block' ELSE 'allow' END AS verdict FROM host_ab),
ruled AS (SELECT page.*, CASE
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/7%' THEN 'example.com/en/7'
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/de/8%' THEN 'example.net/de/8'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/en/%' THEN 'com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/de/%' THEN 'net/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/es/%' THEN 'org/es/' END AS rule FROM page)
SELECT ruled.page_id, ruled.host, ruled.path, ruled.rule,
       CASE WHEN ruled.rule IN ('example.com/en/7', 'net/de/') THEN 'allow' WHEN ruled.rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block'
            ELSE COALESCE(judged.verdict, 'allow') END AS verdict
FROM ruled LEFT JOIN judged ON ruled.host = judged.host"""


WARC = """
WITH page AS (SELECT page_id, CAST(octet_length(encode(COALESCE(html, ''))) AS BIGINT) AS payload_bytes, sha256(COALESCE(html, '')) AS payload_digest FROM pages),
first AS (SELECT payload_digest, MIN(page_id) AS first FROM page WHERE payload_bytes >= 100 GROUP BY payload_digest HAVING COUNT(*) > 1),
joined AS (SELECT page.*, first.first, first.first IS NOT NULL AND page_id IS DISTINCT FROM first.first AS again FROM page LEFT JOIN first USING (payload_digest))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to
FROM joined"""

JACCARD = f"""
WITH RECURSIVE cut AS (SELECT doc_id, regexp_extract_all(TRANSLATE(COALESCE(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingle AS (SELECT DISTINCT doc_id, UNNEST(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM cut),
size AS (SELECT doc_id, COUNT(*) AS n FROM shingle GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS c FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM met JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
ends AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, ends.b FROM reach JOIN ends ON reach.r = ends.a)
SELECT reach.doc_id, COALESCE(ANY_VALUE(n), 0) AS n_shingles, MIN(r) AS component_id FROM reach LEFT JOIN size ON size.doc_id = reach.doc_id GROUP BY reach.doc_id"""

_TERMS = f"regexp_extract_all(TRANSLATE(COALESCE(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

RANKED = f"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
size AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n FROM doc WHERE len(w) > 0),
total AS (SELECT CAST(COUNT(*) AS BIGINT) AS big_n, CAST(SUM(n) AS BIGINT) AS big_l FROM size),
word AS (SELECT r, UNNEST(w) AS term FROM doc),
held AS (SELECT r, term, CAST(COUNT(*) AS BIGINT) AS tf FROM word GROUP BY r, term),
freq AS (SELECT term, COUNT(*) AS df FROM held GROUP BY term),
weight AS (SELECT term, CAST(floor(1000 * ln((2e0 * (SELECT big_n FROM total) + 2) / (2e0 * df + 1))) AS BIGINT) AS w FROM freq),
asked AS (SELECT item_id, term, CAST(COUNT(*) AS BIGINT) AS times FROM (SELECT item_id, UNNEST({_TERMS}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY item_id, term),
norm AS (SELECT r, doc_id, 75 + ((25 * n * (SELECT big_n FROM total)) // (SELECT big_l FROM total)) AS m FROM size),
score AS (SELECT item_id, norm.r, norm.doc_id, CAST(SUM(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
          FROM asked JOIN weight USING (term) JOIN held USING (term) JOIN norm USING (r) GROUP BY item_id, norm.r, norm.doc_id),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM score WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20"""
