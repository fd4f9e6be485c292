"""DuckDB SQL twins of the registered queries (same names, same output column names).

They are written independently from the DataFrame code, from the rules stated in the
operator docstrings, and run on the same parquet tables.
"""

from __future__ import annotations

from postkit import constants as K
from postkit.plans import catalog as C


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _any_contains(expr: str, needles) -> str:
    return "(" + " OR ".join(f"contains({expr}, {_q(n)})" for n in needles) + ")"


B = """B AS (
  SELECT CAST(c_custkey AS VARCHAR) AS job_id, c_name AS title, c_mktsegment AS company,
    CASE WHEN c_custkey % 2 = 0 THEN 'Remote, EU' ELSE 'Praha' END AS location,
    'https://jobs.example/' || CAST(c_custkey AS VARCHAR) AS url,
    c_mktsegment AS source,
    CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 4 = 1 THEN ''
         WHEN c_custkey % 4 = 2 THEN CAST(c_custkey + 30000 AS VARCHAR) || ' - ' || CAST(c_custkey * 2 + 60000 AS VARCHAR) || ' Kč'
         ELSE '€' || CAST(c_custkey % 80 + 20 AS VARCHAR) || '/hr' END AS salary,
    TIMESTAMP '2024-01-01 00:00:00' + TO_DAYS(CAST(c_custkey % 30 AS INTEGER)) + TO_HOURS(CAST(c_custkey % 24 AS INTEGER)) AS scraped_at,
    CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE CAST(FLOOR(c_acctbal / 100) AS BIGINT) END AS score,
    'Segment ' || c_mktsegment AS match_summary,
    CASE WHEN c_custkey % 3 = 0 THEN '["SQL","Python"]' WHEN c_custkey % 3 = 1 THEN '[]' ELSE 'not json' END AS skills_match,
    '["Spark"]' AS gaps,
    (CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE CAST(FLOOR(c_acctbal / 100) AS BIGINT) END) > 60 AS seniority_match,
    CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_custkey % 2 = 0 END AS remote_match,
    CASE WHEN c_custkey % 50 = 49 THEN 'archived' ELSE CASE c_custkey % 7 WHEN 0 THEN 'new' WHEN 1 THEN 'saved' WHEN 2 THEN 'applied'
         WHEN 3 THEN 'replied' WHEN 4 THEN 'interview' WHEN 5 THEN 'rejected' ELSE 'ignored' END END AS status
  FROM customer)"""

L = """L AS (
  SELECT CAST(user_id AS VARCHAR) AS job_id,
    CASE event_type WHEN 'purchase' THEN 'applied' WHEN 'signup' THEN 'interview' WHEN 'error' THEN 'rejected'
                    WHEN 'view' THEN 'saved' ELSE 'replied' END AS status,
    ts AS updated_at, event_id AS seq
  FROM events)"""

LATEST = """LATEST AS (
  SELECT job_id, status FROM (
    SELECT job_id, status, ROW_NUMBER() OVER (PARTITION BY job_id ORDER BY updated_at DESC, seq DESC) AS rn FROM L)
  WHERE rn = 1)"""

CUR = """CUR AS (
  SELECT b.job_id, b.title, b.company, b.location, b.url, b.source, b.salary, b.score, b.match_summary,
    b.skills_match, b.gaps, b.seniority_match, b.remote_match, COALESCE(o.status, b.status) AS status,
    CAST(b.scraped_at AS DATE) AS date_scraped, b.scraped_at
  FROM B b LEFT JOIN LATEST o ON b.job_id = o.job_id)"""

SAL = r"""S1 AS (
  SELECT *, replace(replace(replace(coalesce(salary, ''), chr(160), ''), chr(8205), ''), ' ', '') AS s FROM CUR),
S2 AS (
  SELECT *, list_filter(regexp_extract_all(s, '[0-9\s]{2,}'), lambda r: trim(r) <> '') AS runs FROM S1),
SAL AS (
  SELECT * EXCLUDE (s, runs),
    CASE WHEN coalesce(salary, '') <> '' AND len(runs) > 0 THEN TRY_CAST(trim(runs[1]) AS BIGINT) END AS salary_min,
    CASE WHEN coalesce(salary, '') <> '' AND len(runs) > 0
         THEN TRY_CAST(trim(CASE WHEN len(runs) > 1 THEN runs[2] ELSE runs[1] END) AS BIGINT) END AS salary_max,
    CASE WHEN coalesce(salary, '') <> '' AND len(runs) > 0
         THEN CASE WHEN contains(s, 'Kč') THEN 'CZK' WHEN contains(s, '€') THEN 'EUR' ELSE 'USD' END END AS salary_currency,
    CASE WHEN coalesce(salary, '') <> '' AND len(runs) > 0
         THEN CASE WHEN contains(lower(s), '/h') THEN 'hour' ELSE 'month' END END AS salary_period
  FROM S2)"""

BOUNDS = """BOUNDS AS (
  SELECT min(salary_min) AS salary_lo, max(salary_max) AS salary_hi FROM SAL WHERE salary_currency = 'CZK')"""

STATUSES_IN = ", ".join(_q(s) for s in K.DEFAULT_STATUS_FILTER)

# the dashboard defaults: score >= 50, default statuses, CZK range = full bounds
SHOWN = f"""SHOWN AS (
  SELECT SAL.* FROM SAL, BOUNDS
  WHERE coalesce(score >= 50, false) AND coalesce(status IN ({STATUSES_IN}), false)
    AND (salary_currency IS DISTINCT FROM 'CZK'
         OR coalesce(salary_min <= coalesce(salary_hi, 4611686018427387904)
                     AND salary_max >= coalesce(salary_lo, -4611686018427387904), false)))"""

DIM = "DIM AS (SELECT * FROM (VALUES " + ", ".join(
    f"({o}, {_q(s)}, {_q(lab)}, {_q(e)})" for o, s, lab, e in K.STATUS_DIM_ROWS
) + ") AS t(ordinal, status, label, emoji))"

D = """D AS (
  SELECT substring(md5(text), 1, 12) AS job_id, doc_id, split_part(text, chr(10), 1) AS title,
    source AS company, lang AS location, text AS description, 'doc://' || CAST(doc_id AS VARCHAR) AS url,
    source, n_chars
  FROM documents)"""

WINNERS = """W AS (SELECT job_id, min(doc_id) AS doc_id FROM D GROUP BY job_id)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


_VIEW = (B, L, LATEST, CUR)
_SALV = _VIEW + (SAL,)

# ---------------------------------------------------------------- link tokens
_TAG = lambda e: _any_contains(e, K.LINK_TAGS)
_SALW = lambda e: _any_contains(e, K.SALARY_KEYWORDS)
_PLACE = lambda e: _any_contains(e, K.PLACE_KEYWORDS)

T_PARTS = """T AS (
  SELECT p_partkey,
    CASE WHEN p_partkey % 13 = 0 THEN [p_name, p_type, p_brand]
    ELSE [CASE WHEN p_partkey % 6 = 0 THEN 'BI' ELSE p_name END,
          CASE WHEN p_partkey % 5 = 0 THEN 'Remote' WHEN p_partkey % 5 = 1 THEN 'Senior ' || p_type ELSE 'HPP' END,
          p_type, p_brand,
          CASE WHEN p_size % 3 = 0 THEN 'Brno' ELSE p_name END,
          CASE WHEN p_size % 4 = 0 THEN 'Navrhni mzdu' ELSE CAST(p_size AS VARCHAR) || '000 Kč' END] END AS parts
  FROM part)"""

LINK_TOKENS = _with(
    T_PARTS,
    f"""T1 AS (SELECT p_partkey, parts,
        coalesce(list_position(list_transform(parts, lambda p: {_TAG('p')}), true), 0) AS idx FROM T)""",
    """T2 AS (SELECT p_partkey, parts,
        CASE WHEN idx = 0 THEN parts ELSE parts[1:idx - 1] END AS head,
        CASE WHEN idx = 0 THEN []::VARCHAR[] ELSE parts[idx:] END AS rest FROM T1)""",
) + f"""SELECT p_partkey,
  CASE WHEN length(trim(array_to_string(head, ' '))) < 3 THEN parts[1] ELSE trim(array_to_string(head, ' ')) END AS title,
  coalesce(list_filter(rest, lambda p: NOT {_TAG('p')} AND NOT {_SALW('p')} AND length(p) > 2)[1], '') AS company,
  coalesce(list_filter(rest, lambda p: {_PLACE('p')})[1], 'Praha') AS location,
  coalesce(list_filter(rest, lambda p: {_SALW('p')})[1], '') AS salary
FROM T2"""

# ---------------------------------------------------------------- responses
R = """R AS (
  SELECT event_id AS response_id,
    CASE event_id % 6
      WHEN 0 THEN '{"score": ' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || ', "match_summary": "ok", "skills_match": ["SQL"], "remote_match": true}'
      WHEN 1 THEN '```json' || chr(10) || '{"score": ' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || ', "gaps": ["Spark"]}' || chr(10) || '```'
      WHEN 2 THEN 'Here: {"score": ' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || ', "seniority_match": "false"} thanks'
      WHEN 3 THEN 'no json here'
      WHEN 4 THEN '{"score": null}'
      ELSE '{}' END AS response
  FROM events)"""

R_PARSED = r"""RS AS (
  SELECT response_id, trim(regexp_replace(response, '```(json)?', '', 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS t FROM R),
RJ AS (
  SELECT response_id,
    CASE WHEN json_valid(t) THEN t
         WHEN json_valid(regexp_extract(t, '(?s)\{.*\}', 0)) THEN regexp_extract(t, '(?s)\{.*\}', 0) END AS j
  FROM RS),
RT AS (
  SELECT response_id, j, json_type(j) AS jt, json_type(j, '$.score') AS st FROM RJ)"""

_BOOL = lambda f: (
    f"CASE WHEN json_type(j, '$.{f}') IS NULL OR json_type(j, '$.{f}') = 'NULL' THEN false "
    f"WHEN json_type(j, '$.{f}') = 'BOOLEAN' THEN CAST(json_extract(j, '$.{f}') AS BOOLEAN) "
    f"WHEN json_type(j, '$.{f}') = 'VARCHAR' THEN json_extract_string(j, '$.{f}') <> '' "
    f"WHEN json_type(j, '$.{f}') IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN CAST(json_extract(j, '$.{f}') AS DOUBLE) <> 0 "
    f"ELSE json_array_length(j, '$.{f}') > 0 END"
)

_OK = ("jt = 'OBJECT' AND (st IS NULL OR st IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'BOOLEAN') "
       "OR (st = 'VARCHAR' AND regexp_matches(json_extract_string(j, '$.score'), '^\\s*[+-]?[0-9]+\\s*$')))")

PARSE_RESPONSES = _with(R, R_PARSED) + f"""SELECT response_id,
  CASE WHEN st IS NULL THEN 0
       WHEN st = 'BOOLEAN' THEN CAST(CAST(json_extract(j, '$.score') AS BOOLEAN) AS BIGINT)
       WHEN st = 'VARCHAR' THEN CAST(trim(json_extract_string(j, '$.score')) AS BIGINT)
       ELSE CAST(trunc(CAST(json_extract(j, '$.score') AS DOUBLE)) AS BIGINT) END AS score,
  CASE WHEN json_type(j, '$.match_summary') IS NULL OR json_type(j, '$.match_summary') = 'NULL' THEN ''
       ELSE json_extract_string(j, '$.match_summary') END AS match_summary,
  coalesce(CAST(json_extract(j, '$.skills_match') AS VARCHAR), '[]') AS skills_match,
  coalesce(CAST(json_extract(j, '$.gaps') AS VARCHAR), '[]') AS gaps,
  {_BOOL('seniority_match')} AS seniority_match,
  {_BOOL('remote_match')} AS remote_match
FROM RT WHERE j IS NOT NULL AND {_OK}"""

QUARANTINE = _with(R, R_PARSED) + f"""SELECT response_id,
  CASE WHEN j IS NULL OR jt <> 'OBJECT' THEN 'no JSON object' ELSE 'score is not an integer' END AS error
FROM RT WHERE NOT (j IS NOT NULL AND coalesce({_OK}, false))"""

# ---------------------------------------------------------------- remotive / muse payloads
_REMOTIVE_TITLE = "CASE event_type " + " ".join(
    f"WHEN {_q(k)} THEN {_q(v)}" for k, v in __import__("postkit.plans.fixtures", fromlist=["x"]).REMOTIVE_TITLES.items()
) + " ELSE 'Analyst' END"

REMOTIVE = f"""WITH E AS (
  SELECT event_id, event_type, user_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, value FROM events),
J AS (
  SELECT event_id, 0 AS pos, 'https://remotive.example/' || CAST(user_id AS VARCHAR) || '/' || k AS url,
    {_REMOTIVE_TITLE} || ' ' || k AS title, 'Co' || CAST(user_id AS VARCHAR) AS company,
    CASE WHEN event_type = 'view' THEN 'Worldwide' ELSE event_type END AS location, 5 AS desc_chars,
    CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS salary FROM E
  UNION ALL
  SELECT event_id, 1, 'https://remotive.example/e/' || CAST(event_id AS VARCHAR), 'Data Engineer', 'Big', 'Worldwide',
    3200, '' FROM E)
SELECT event_id, CAST(pos AS BIGINT) AS pos, substring(md5(url), 1, 12) AS job_id, title, company, location,
  CAST(desc_chars AS BIGINT) AS desc_chars, salary
FROM J WHERE {_any_contains('lower(title)', K.RELEVANT_TITLE_KEYWORDS)}"""

# entities that occur in the pages, '&amp;' last
_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", chr(160)), ("&copy;", chr(169)),
             ("&middot;", chr(183)), ("&amp;", "&")]


def _decoded(x: str) -> str:
    for ent, ch in _ENTITIES:
        x = f"replace({x}, {_q(ent)}, chr({ord(ch)}))"
    return x


MUSE_ROWS = """SELECT conv_id, turn, substring(md5(url), 1, 12) AS job_id, split_part(text, chr(10), 1) AS title, role AS company,
  CASE WHEN turn % 3 = 0 THEN 'Remote' WHEN turn % 3 = 1 THEN role ELSE role || ', Brno' END AS location,
  text || ' café – Plzeň &lt; ' AS description
FROM (SELECT conv_id, turn, role, text,
    CASE WHEN turn % 5 = 4 THEN '' ELSE 'https://muse.example/' || CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR) END AS url
  FROM conversations) WHERE url <> ''"""

MUSE = f"SELECT conv_id, turn, job_id, title, company, location, md5(description) AS desc_md5 FROM ({MUSE_ROWS})"

# ---------------------------------------------------------------- pages
NAV = """WITH N AS (
  SELECT page_id, regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 1) AS hrefs,
    regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 2) AS texts FROM pages),
U AS (
  SELECT page_id, unnest(hrefs) AS href, unnest(texts) AS text, unnest(generate_series(0, len(hrefs) - 1)) AS pos FROM N)
SELECT page_id, CAST(pos AS BIGINT) AS pos, href, {text} AS text FROM U WHERE pos < %d""" % C.NAV_CAP

NAV_CAPPED = NAV.format(text="text")
NAV_PARSED = NAV.format(text=_decoded("text"))
NAV_ALL = NAV_PARSED.partition("WHERE pos <")[0]

_SKILLS = "[" + ", ".join(_q(x) for x in C.PROFILE_SKILLS) + "]"
SCORED_D = _with(D) + f""", T AS (SELECT doc_id, lower(coalesce(substring(description, 1, 3000), '')) AS d FROM D
  WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND coalesce({_any_contains('lower(title)', C.GATE_KEYWORDS)}, false)),
H AS (SELECT doc_id, d, list_filter({_SKILLS}, lambda s: contains(d, s)) AS hits FROM T)
SELECT doc_id, CAST(100 * len(hits) // {len(C.PROFILE_SKILLS)} AS BIGINT) AS score,
  '[' || array_to_string(list_transform(hits, lambda s: '"' || s || '"'), ',') || ']' AS skills_match, '[]' AS gaps,
  false AS seniority_match, contains(d, 'remote') AS remote_match, 'new' AS status, '2024-01-01' AS date_scraped
FROM H"""

def _html_text_sql() -> str:
    x = (r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', '', 'g'), "
         r"'(?is)<style\b.*?</style\s*>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '(?s)<[^>]*>', '', 'g')")
    x = _decoded(x)
    return f"SELECT page_id, CAST(length({x}) AS BIGINT) AS text_chars, md5({x}) AS text_md5 FROM pages"


JOBS_CZ_CARDS = """SELECT p_partkey, 0 AS pos, 'https://jobs.example.cz/' || CAST(p_partkey AS VARCHAR) || '/0' AS url, p_name || ' analyst' AS title,
    p_brand AS company, 'Brno' AS location, CAST(p_size AS VARCHAR) || ' 000 Kč' AS salary FROM part
  UNION ALL
  SELECT p_partkey, 1, 'https://jobs.example.cz/' || CAST(p_partkey AS VARCHAR) || '/1', 'Chef ' || p_name, p_type, 'Praha', '' FROM part
  UNION ALL SELECT p_partkey, 2, NULL, NULL, NULL, NULL, NULL FROM part
  UNION ALL SELECT p_partkey, 3, 'https://jobs.example.cz/' || CAST(p_partkey AS VARCHAR) || '/3', 'Data lead', '', 'Praha', '' FROM part"""
JOBS_CZ_ALL = f"""SELECT p_partkey, CAST(pos AS BIGINT) AS pos, substring(md5(url), 1, 12) AS job_id, title, company, location, salary, url
FROM ({JOBS_CZ_CARDS}) WHERE title IS NOT NULL AND {_any_contains('lower(title)', K.RELEVANT_TITLE_KEYWORDS)}"""
JOBS_CZ_CAPPED = f"""SELECT 'search ' || CAST(p_partkey % 3 AS VARCHAR) AS query, CAST(p_partkey AS BIGINT) AS page_no, CAST(pos AS BIGINT) AS pos,
  substring(md5(url), 1, 12) AS job_id, title, company
FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey % 3 ORDER BY p_partkey, pos) AS n FROM ({JOBS_CZ_CARDS}))
WHERE n <= CASE p_partkey % 3 WHEN 0 THEN 5 WHEN 1 THEN 50 ELSE n END AND title IS NOT NULL AND {_any_contains('lower(title)', K.RELEVANT_TITLE_KEYWORDS)}"""

JOBS_CZ = f"""WITH C AS (
  SELECT p_partkey, 0 AS pos, 'https://jobs.example.cz/' || CAST(p_partkey AS VARCHAR) || '/0' AS url, p_name || ' analyst' AS title,
    p_brand AS company, 'Brno' AS location, CAST(p_size AS VARCHAR) || ' 000 Kč' AS salary FROM part
  UNION ALL
  SELECT p_partkey, 1, 'https://jobs.example.cz/' || CAST(p_partkey AS VARCHAR) || '/1', 'Chef ' || p_name, p_type, 'Praha', '' FROM part)
SELECT p_partkey, CAST(pos AS BIGINT) AS pos, substring(md5(url), 1, 12) AS job_id, title, company, location, salary, url
FROM C WHERE {_any_contains('lower(title)', K.RELEVANT_TITLE_KEYWORDS)}"""

LINKEDIN = f"""WITH C AS (
  SELECT c_custkey, 0 AS pos, 'https://li.example/jobs/view/' || CAST(c_custkey AS VARCHAR) AS url, 'Data Analyst ' || c_name AS title,
    c_mktsegment AS company, 'Brno' AS location FROM customer
  UNION ALL
  SELECT c_custkey, 1, 'https://li.example/jobs/view/' || CAST(c_custkey AS VARCHAR) || '-b', 'BI Developer', '',
    CASE WHEN c_custkey % 2 = 0 THEN 'Worldwide' ELSE 'Prague' END FROM customer)
SELECT c_custkey, CAST(pos AS BIGINT) AS pos, substring(md5(url), 1, 12) AS job_id, title, company, location, url
FROM C WHERE {_any_contains('lower(title)', K.RELEVANT_TITLE_KEYWORDS)}"""

def _jobstack(max_pages: int | None) -> str:
    within = "true" if max_pages is None else f"page_no <= {max_pages}"
    return f"""WITH P AS (
  SELECT conv_id, turn, turn + 1 AS page_no, role, length(text) < 40 AS empty, turn % 4 = 3 AS last FROM conversations),
S AS (SELECT conv_id, min(page_no) FILTER (WHERE empty) AS se, min(page_no) FILTER (WHERE last) AS sl
  FROM P WHERE {within} GROUP BY conv_id),
KP AS (SELECT P.* FROM P JOIN S ON P.conv_id = S.conv_id WHERE {within}
  AND (se IS NULL OR page_no < se) AND (sl IS NULL OR page_no <= sl)),
LK AS (
  SELECT conv_id, page_no, 0 AS pos,
    {_q(K.JOBSTACK_BASE_URL)} || '/it-job/' || CAST(conv_id AS VARCHAR) || '-' || CAST((turn + 1) // 2 AS VARCHAR) AS url,
    CASE WHEN role = 'user' THEN 'Data Analyst' ELSE 'Chef' END AS title, 'Co' || CAST(conv_id AS VARCHAR) AS company,
    'Brno' AS location, CAST(turn AS VARCHAR) || '0 000 Kč' AS salary FROM KP
  UNION ALL
  SELECT conv_id, page_no, 1, {_q(K.JOBSTACK_BASE_URL)} || '/it-job/' || CAST(conv_id AS VARCHAR) || '-x' || CAST(turn AS VARCHAR),
    'Senior BI Developer', 'Acme s.r.o.', 'Remote', '' FROM KP),
F AS (SELECT *, substring(md5(url), 1, 12) AS job_id FROM LK),
W AS (SELECT job_id, min(page_no * 1000 + pos) AS o FROM F GROUP BY job_id)
SELECT CAST(F.conv_id AS VARCHAR) AS category, CAST(F.page_no AS BIGINT) AS page_no, CAST(F.pos AS BIGINT) AS pos,
  F.job_id, F.title, F.company, F.location, F.salary
FROM F JOIN W ON F.job_id = W.job_id AND F.page_no * 1000 + F.pos = W.o
WHERE {_any_contains('lower(F.title)', K.RELEVANT_TITLE_KEYWORDS)}"""


JOBSTACK = _jobstack(K.JOBSTACK_MAX_PAGES)

EXTRACTED = f"""A AS (
  SELECT job_id, title, company, desc_chars, 'remotive' AS source, 0 AS sr, 0 AS qr, event_id AS page_no, pos FROM ({REMOTIVE})
  UNION ALL SELECT job_id, title, company, length(description), 'the_muse', 1, 0, conv_id * 100 + turn, 0 FROM ({MUSE_ROWS})
  UNION ALL SELECT job_id, title, company, 0, 'jobs_cz', 2, CAST(right(query, 1) AS INTEGER), page_no, pos FROM ({JOBS_CZ_CAPPED})
  UNION ALL SELECT substring(md5(replace(url, 'https://li.example/jobs/view/', 'https://remotive.example/e/')), 1, 12), title, company, 0,
    'linkedin', 3, 0, c_custkey, pos FROM ({LINKEDIN})
  UNION ALL SELECT job_id, title, company, 0, 'jobstack', 4, CAST(category AS INTEGER), page_no, pos FROM ({JOBSTACK}) WHERE CAST(category AS INTEGER) % 4 <> 0),
S AS (SELECT DISTINCT substring(md5('https://muse.example/' || CAST(conv_id AS VARCHAR) || '/0'), 1, 12) AS job_id FROM conversations),
N AS (SELECT *, job_id NOT IN (SELECT job_id FROM S) AND row_number() OVER (PARTITION BY job_id ORDER BY sr, qr, page_no, pos, company, desc_chars, title) = 1 AS is_new FROM A)"""

# B twice with different scores (the lower one first), every tenth also without an id
REPEATED = _with(B) + """, R2 AS (SELECT job_id, title, score, scraped_at FROM B UNION ALL SELECT job_id, title, coalesce(score, 0) + 7, scraped_at FROM B),
KEPT AS (SELECT job_id, any_value(title) AS title, CASE WHEN bool_or(score IS NULL) THEN NULL ELSE min(score) END AS score FROM R2 GROUP BY job_id),
LOST AS (SELECT title, score FROM B WHERE CAST(job_id AS BIGINT) % 10 = 0)"""


SQL = {
    "current_postings": _with(*_VIEW) + """SELECT job_id, title, company, location, url, source, salary, score,
  match_summary, skills_match, gaps, seniority_match, remote_match, status, date_scraped
FROM CUR ORDER BY score DESC NULLS LAST, scraped_at DESC, job_id""",

    "session_overrides": _with(*_VIEW) + """, N AS (SELECT CAST(n_nationkey AS VARCHAR) AS job_id, max('saved') AS status
  FROM nation GROUP BY 1)
SELECT c.job_id, COALESCE(n.status, c.status) AS status, c.score FROM CUR c LEFT JOIN N n ON c.job_id = n.job_id""",

    "search_filter": _with(*_VIEW) + f"""SELECT job_id, title, company, location FROM CUR
WHERE coalesce(regexp_matches(lower(title), {_q(C.SEARCH_QUERY)}), false)
   OR coalesce(regexp_matches(lower(company), {_q(C.SEARCH_QUERY)}), false)
   OR coalesce(regexp_matches(lower(location), {_q(C.SEARCH_QUERY)}), false)""",

    "filter_stack": _with(*_SALV, BOUNDS, SHOWN) + """SELECT job_id, score, status, salary_min, salary_max, salary_currency
FROM SHOWN WHERE coalesce(remote_match, false) AND coalesce(salary <> '', false)""",

    "sort_options": _with(*_SALV, BOUNDS, SHOWN) + f"""SELECT sort_by, rank, job_id FROM (
  SELECT 'Score (high→low)' AS sort_by, CAST(ROW_NUMBER() OVER (ORDER BY score DESC NULLS LAST, job_id) AS BIGINT) AS rank, job_id FROM SHOWN
  UNION ALL SELECT 'Score (low→high)', CAST(ROW_NUMBER() OVER (ORDER BY score ASC NULLS LAST, job_id) AS BIGINT), job_id FROM SHOWN
  UNION ALL SELECT 'Date (newest)', CAST(ROW_NUMBER() OVER (ORDER BY date_scraped DESC NULLS LAST, job_id) AS BIGINT), job_id FROM SHOWN
  UNION ALL SELECT 'Company (A→Z)', CAST(ROW_NUMBER() OVER (ORDER BY company ASC NULLS LAST, job_id) AS BIGINT), job_id FROM SHOWN
) WHERE rank <= {C.SORT_TOP}""",

    "salary_parse": _with(B, L, LATEST, "CUR AS (SELECT * FROM B)", SAL)
    + "SELECT job_id, salary, salary_min, salary_max, salary_currency, salary_period FROM SAL",

    "salary_overlap": _with(*_SALV) + f"""SELECT job_id, salary_currency, salary_min, salary_max FROM SAL
WHERE salary_currency IS DISTINCT FROM 'CZK'
   OR coalesce(salary_min <= {C.SALARY_WINDOW[1]} AND salary_max >= {C.SALARY_WINDOW[0]}, false)""",

    "salary_bounds": _with(*_SALV, BOUNDS) + "SELECT salary_lo, salary_hi FROM BOUNDS",

    "summary_metrics": _with(*_SALV, BOUNDS, SHOWN) + """, T AS (SELECT count(*) AS total,
    count(*) FILTER (WHERE status = 'applied') AS applied, count(*) FILTER (WHERE status = 'interview') AS interviews FROM SAL),
S AS (SELECT count(*) AS shown, avg(score) AS avg_score, count(*) FILTER (WHERE coalesce(salary, '') <> '') AS with_salary FROM SHOWN)
SELECT total, shown, CAST(shown * 100.0 / greatest(total, 1) AS DOUBLE) AS pct_shown, round(avg_score, 4) AS avg_score,
  with_salary, applied, interviews,
  CAST(CAST(round_even(CAST(shown * 100.0 / greatest(total, 1) AS DOUBLE), 0) AS BIGINT) AS VARCHAR) || '% of total' AS pct_shown_text,
  coalesce(CAST(CAST(round_even(round(avg_score, 4), 0) AS BIGINT) AS VARCHAR), '—') AS avg_score_text FROM T, S""",

    "count_by_status": _with(*_VIEW, DIM) + """SELECT c.status, concat_ws(' ', d.emoji, coalesce(d.label, upper(substring(c.status, 1, 1)) || lower(substring(c.status, 2)))) AS label,
  c.count FROM (SELECT status, count(*) AS count FROM CUR WHERE status IS NOT NULL GROUP BY status) c
LEFT JOIN DIM d ON c.status = d.status""",

    "count_by_source": _with(*_SALV, BOUNDS, SHOWN)
    + "SELECT source, count(*) AS count FROM SHOWN WHERE source IS NOT NULL GROUP BY source",

    "score_histogram": _with(*_VIEW) + """SELECT CAST(CASE WHEN score = 100 THEN 95 ELSE floor(score / 5) * 5 END AS BIGINT) AS bin_start,
  CAST(CASE WHEN score = 100 THEN 95 ELSE floor(score / 5) * 5 END AS BIGINT) + 5 AS bin_end, count(*) AS count
FROM CUR WHERE score IS NOT NULL GROUP BY 1""",

    "board_topk": _with(*_VIEW, DIM) + f"""SELECT status, rank, job_id, card_score, accent, card_title, card_company FROM (
  SELECT status, CAST(ROW_NUMBER() OVER (PARTITION BY status ORDER BY score DESC NULLS LAST, scraped_at DESC, job_id) AS BIGINT) AS rank,
    job_id, CAST(coalesce(score, 0) AS BIGINT) AS card_score,
    CASE WHEN coalesce(score, 0) >= 75 THEN 'high' WHEN coalesce(score, 0) >= 50 THEN 'medium' ELSE 'low' END AS accent,
    CASE WHEN length(title) > 35 THEN substring(title, 1, 35) || '…' ELSE title END AS card_title,
    CASE WHEN length(company) > 28 THEN substring(company, 1, 28) || '…' ELSE company END AS card_company
  FROM CUR WHERE status IN (SELECT status FROM DIM)) WHERE rank <= {K.BOARD_CARDS_PER_STATUS}""",

    "board_overflow": _with(*_VIEW, DIM) + f"""SELECT CAST(d.ordinal AS BIGINT) AS ordinal, d.status, d.label,
  CAST(coalesce(c.cnt, 0) AS BIGINT) AS count, CAST(greatest(coalesce(c.cnt, 0) - {K.BOARD_CARDS_PER_STATUS}, 0) AS BIGINT) AS overflow
FROM DIM d LEFT JOIN (SELECT status, count(*) AS cnt FROM CUR GROUP BY status) c ON d.status = c.status""",

    "score_bands": _with(*_VIEW) + """SELECT job_id, score,
  CASE WHEN score IS NULL THEN 'medium' WHEN score >= 75 THEN 'high' WHEN score >= 50 THEN 'medium' ELSE 'low' END AS ring,
  CASE WHEN coalesce(score, 0) >= 75 THEN 'high' WHEN coalesce(score, 0) >= 50 THEN 'medium' ELSE 'low' END AS accent,
  CASE WHEN score IS NULL THEN NULL WHEN score >= 85 THEN 'excellent' WHEN score >= 70 THEN 'good'
       WHEN score >= 50 THEN 'partial' WHEN score >= 30 THEN 'weak' ELSE 'poor' END AS rating,
  coalesce(contains(lower(location), 'remote'), false) OR coalesce(source = 'remotive', false) AS remote_rule
FROM CUR""",

    "distinct_sources": "SELECT DISTINCT source FROM documents WHERE source IS NOT NULL ORDER BY source",

    "posting_id": f"""SELECT page_id, substring(md5(url), 1, 12) AS job_id, split_part(url, '?', 1) AS url_clean,
  substring(md5(split_part(url, '?', 1)), 1, 12) AS clean_id,
  CASE WHEN starts_with(regexp_extract(html, '<li><a href="([^"]*)">', 1), 'http') THEN regexp_extract(html, '<li><a href="([^"]*)">', 1)
       ELSE {_q(K.JOBSTACK_BASE_URL)} || regexp_extract(html, '<li><a href="([^"]*)">', 1) END AS first_link,
  CASE WHEN page_id % 3 + 1 = 1 THEN split_part(url, '?', 1)
       ELSE split_part(url, '?', 1) || '?page=' || CAST(page_id % 3 + 1 AS VARCHAR) END AS page_url
FROM pages""",

    "title_gate": _with(D) + f"""SELECT doc_id, title, coalesce({_any_contains('lower(title)', C.GATE_KEYWORDS)}, false) AS relevant,
  coalesce({_any_contains('lower(title)', K.RELEVANT_TITLE_KEYWORDS)}, false) AS relevant_default FROM D""",

    "keyword_table_gate": _with(D) + """, KW AS (SELECT DISTINCT lower(lang) AS k FROM documents WHERE lang IS NOT NULL)
SELECT doc_id, title, coalesce(EXISTS (SELECT 1 FROM KW WHERE contains(lower(D.title), KW.k)), false) AS relevant FROM D""",

    "dedup_first": _with(D, WINNERS) + "SELECT D.job_id, D.doc_id, D.source FROM D JOIN W ON D.job_id = W.job_id AND D.doc_id = W.doc_id",

    "ingest_counters": _with(D, WINNERS) + """SELECT D.source, count(*) AS fetched, count(W.doc_id) AS inserted,
  count(*) - count(W.doc_id) AS skipped
FROM D LEFT JOIN W ON D.job_id = W.job_id AND D.doc_id = W.doc_id GROUP BY D.source""",

    "store_versions": _with(D) + f""", S AS (SELECT job_id, min(doc_id) AS doc_id FROM D WHERE {C.EARLY} GROUP BY job_id),
N AS (SELECT job_id, min(doc_id) AS doc_id FROM D WHERE NOT ({C.EARLY}) GROUP BY job_id),
K AS (SELECT job_id, doc_id FROM S UNION ALL SELECT job_id, doc_id FROM N WHERE job_id NOT IN (SELECT job_id FROM S))
SELECT D.job_id, D.doc_id, D.title, D.source FROM D JOIN K ON D.job_id = K.job_id AND D.doc_id = K.doc_id""",

    "store_last_wins": _with(D) + """, L AS (SELECT job_id, max(doc_id) AS doc_id FROM D GROUP BY job_id)
SELECT D.job_id, D.doc_id, D.title, D.source FROM D JOIN L ON D.job_id = L.job_id AND D.doc_id = L.doc_id""",

    "insert_new": _with(D) + f""", S AS (SELECT job_id, min(doc_id) AS doc_id FROM D WHERE {C.EARLY} GROUP BY job_id),
N AS (SELECT job_id, min(doc_id) AS doc_id FROM D WHERE NOT ({C.EARLY}) GROUP BY job_id)
SELECT job_id, doc_id, false AS is_new FROM S
UNION ALL SELECT job_id, doc_id, true FROM N WHERE job_id NOT IN (SELECT job_id FROM S)""",

    "select_unscored": _with(D) + f"""SELECT doc_id, job_id, title FROM D
WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND coalesce({_any_contains('lower(title)', C.GATE_KEYWORDS)}, false)""",

    "scoring_counters": _with(D) + f""", F AS (SELECT D.*, D.doc_id IN (SELECT doc_id FROM labels) AS done,
  coalesce({_any_contains('lower(title)', C.GATE_KEYWORDS)}, false) AS rel FROM D)
SELECT count(*) FILTER (WHERE done) AS already_scored, count(*) FILTER (WHERE NOT done AND rel) AS to_score,
  count(*) FILTER (WHERE NOT done AND NOT rel) AS irrelevant FROM F""",

    "truncate_text": """SELECT doc_id, md5(substring(text, 1, 3000)) AS desc_md5, CAST(length(substring(text, 1, 3000)) AS BIGINT) AS desc_chars
FROM documents""",

    "build_prompts": _with(D) + f""", P AS (SELECT {_q(K.DEFAULT_PROFILE.strip())} AS profile),
Q AS (SELECT doc_id, 'CANDIDATE PROFILE:' || chr(10) || profile || chr(10) || chr(10) || 'JOB POSTING:' || chr(10)
  || 'Title: ' || coalesce(title, '') || chr(10) || 'Company: ' || coalesce(company, '') || chr(10)
  || 'Location: ' || coalesce(location, '') || chr(10) || 'Salary: not specified' || chr(10)
  || 'Source: ' || coalesce(source, '') || chr(10) || chr(10) || 'Description:' || chr(10)
  || coalesce(substring(description, 1, 3000), '') || chr(10) || chr(10) || 'Score this job for the candidate.' AS prompt FROM D, P)
SELECT doc_id, md5(prompt) AS prompt_md5, CAST(length(prompt) AS BIGINT) AS prompt_chars FROM Q""",

    "lexical_score": f"""WITH S AS (SELECT doc_id,
  {" + ".join(f"CAST(contains(lower(text), {_q(s)}) AS INTEGER)" for s in C.PROFILE_SKILLS)} AS m,
  {" + ".join(f"CAST(contains(lower(text), {_q(v)}) AS INTEGER)" for v in C.VOCABULARY if v not in C.PROFILE_SKILLS)} AS g
  FROM documents)
SELECT doc_id, CAST(CASE WHEN m + g = 0 THEN 0 ELSE floor(100 * m / (m + g)) END AS BIGINT) AS score,
  CAST(m AS BIGINT) AS n_skills, CAST(g AS BIGINT) AS n_gaps FROM S""",

    "parse_responses": PARSE_RESPONSES,
    "quarantine": QUARANTINE,

    "skills_array": _with(B) + """SELECT job_id,
  CAST(CASE WHEN json_valid(skills_match) THEN CASE WHEN json_type(skills_match) = 'ARRAY' THEN json_array_length(skills_match) ELSE 0 END ELSE 0 END AS BIGINT) AS n_skills,
  CASE WHEN json_valid(skills_match) THEN CASE WHEN json_type(skills_match) = 'ARRAY' THEN json_extract_string(skills_match, '$[0]') END END AS first_skill
FROM B""",

    "normalise_rows": _with(B) + """SELECT job_id, coalesce(title, '') AS title, coalesce(company, '') AS company,
  coalesce(location, '') AS location, coalesce(url, '') AS url, coalesce(source, '') AS source,
  coalesce(nullif(salary, ''), '') AS salary, CAST(scraped_at AS VARCHAR) AS scraped_at, score,
  coalesce(status, 'new') AS status, coalesce(skills_match, '[]') AS skills_match, coalesce(gaps, '[]') AS gaps,
  seniority_match, remote_match
FROM B WHERE job_id IS NOT NULL AND job_id <> ''""",

    "load_twice": _with(B) + """SELECT job_id, coalesce(salary, '') AS salary, coalesce(status, 'new') AS status,
  CAST(scraped_at AS DATE) AS scraped_date FROM B""",

    "json_props": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",

    "remotive_extract": REMOTIVE,
    "muse_extract": MUSE,

    "html_heading": "SELECT page_id, regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1) AS heading FROM pages",

    "nav_cards_capped": NAV_CAPPED,
    "nav_cards_parsed": NAV_PARSED,
    "html_text": _html_text_sql(),

    "page_chain_cut": """WITH P AS (SELECT conv_id AS category, turn + 1 AS page_no, length(text) < 40 AS empty FROM conversations),
S AS (SELECT category, min(page_no) FILTER (WHERE empty) AS stop FROM P WHERE page_no <= 5 GROUP BY category)
SELECT P.category, P.page_no FROM P JOIN S ON P.category = S.category
WHERE P.page_no <= 5 AND (S.stop IS NULL OR P.page_no < S.stop)""",

    "link_tokens": LINK_TOKENS,

    "score_postings": SCORED_D,
    "incremental_score": SCORED_D,
    "warehouse_current": _with(*_VIEW) + """SELECT job_id, status, score, coalesce(salary, '') AS salary, date_scraped
FROM CUR""",
    "jobs_cz_cards": JOBS_CZ,
    "linkedin_cards": LINKEDIN,
    "jobstack_links": JOBSTACK,
    "latest_override": _with(L, LATEST) + "SELECT job_id, status FROM LATEST",

    "incremental_dedup": _with(D) + f""", E AS (SELECT job_id, doc_id, source, row_number() OVER (
  PARTITION BY job_id ORDER BY CASE WHEN {C.EARLY} THEN 0 ELSE 1 END, doc_id) AS n FROM D)
SELECT job_id, doc_id, source FROM E WHERE n = 1""",

    "incremental_load": _with(B) + """SELECT job_id, coalesce(salary, '') AS salary, coalesce(status, 'new') AS status,
  CAST(scraped_at AS DATE) AS scraped_date FROM B""",

    "override_stream": _with(L, LATEST) + "SELECT job_id, status FROM LATEST",

    "page_chain_all": """WITH P AS (SELECT conv_id AS category, turn + 1 AS page_no, length(text) < 40 AS empty FROM conversations),
S AS (SELECT category, min(page_no) FILTER (WHERE empty) AS stop FROM P GROUP BY category)
SELECT P.category, P.page_no FROM P JOIN S ON P.category = S.category WHERE S.stop IS NULL OR P.page_no < S.stop""",

    "jobstack_links_all": _jobstack(None),
    "jobs_cz_cards_all": JOBS_CZ_ALL,
    "cards_by_spec_cap": f"SELECT query, page_no, pos, job_id, title FROM ({JOBS_CZ_CAPPED})",
    "nav_cards_all": NAV_ALL,
    "ingest_all": f"WITH {EXTRACTED} SELECT job_id, title, company, source, CAST(desc_chars AS BIGINT) AS desc_chars FROM N WHERE is_new",
    "ingest_all_counters": f"""WITH {EXTRACTED} SELECT source, count(*) AS fetched, count(*) FILTER (WHERE is_new) AS inserted,
  count(*) FILTER (WHERE NOT is_new) AS skipped FROM N GROUP BY source""",

    "load_duplicates": REPEATED + """SELECT 'table' AS part, job_id, title, score FROM KEPT
UNION ALL SELECT 'missing job_id', NULL, title, score FROM LOST UNION ALL SELECT 'missing job_id', NULL, title, score FROM LOST""",
    "load_counters": REPEATED + """, C AS (SELECT (SELECT count(*) FROM KEPT) AS k, (SELECT count(*) FROM R2) AS r, (SELECT count(*) FROM LOST) AS l)
SELECT 1 AS run, k AS inserted, r - k AS skipped, l AS quarantined FROM C UNION ALL SELECT 2, 0, r, l FROM C""",

    "source_filter": _with(*_SALV, BOUNDS) + f"""SELECT job_id, source, score FROM SAL, BOUNDS
WHERE source = 'BUILDING' AND coalesce(status IN ({STATUSES_IN}), false)
  AND (salary_currency IS DISTINCT FROM 'CZK' OR coalesce(salary_min <= salary_hi AND salary_max >= salary_lo, false))""",

    "score_retry_store": SCORED_D,
}
SQL["sort_all"] = SQL["sort_options"].rpartition("WHERE rank <=")[0]
SQL["score_retry"] = f"""WITH T AS (SELECT s.doc_id, {C.EARLY.replace('doc_id', 's.doc_id')} AS early, CAST(substring(d.source, 4) AS INTEGER) % 2 = 0 AS fails
  FROM ({SCORED_D}) s JOIN documents d ON d.doc_id = s.doc_id)
SELECT 1 AS run, count(*) FILTER (WHERE early AND NOT fails) AS scored, count(*) FILTER (WHERE early AND fails) AS failed FROM T
UNION ALL SELECT 2, count(*) FILTER (WHERE NOT early OR fails), 0 FROM T UNION ALL SELECT 3, 0, 0"""

# ---------------------------------------------------------------- ingest with damaged pages
_GATE = lambda c: _any_contains(f"lower({c})", K.RELEVANT_TITLE_KEYWORDS)
_LI_URL = "'https://remotive.example/e/' || CAST(c_custkey AS VARCHAR)"
BROKEN = f"""WITH {REMOTIVE.partition("WITH ")[2].rpartition("SELECT event_id, CAST(pos")[0]},
R AS (
  SELECT 'remotive' AS source, 'data analyst' AS query, event_id AS page_no, pos, title, url, CASE WHEN NOT {_GATE("title")} THEN 'title not relevant' END AS reason
  FROM J WHERE event_id % 10 <> 7
  UNION ALL SELECT 'remotive', 'data analyst', event_id, NULL, '', '', 'broken payload' FROM events WHERE event_id % 10 = 7),
M AS (
  SELECT 'the_muse', 'Data Science', conv_id * 100 + turn, CASE WHEN bad THEN NULL ELSE 0 END, CASE WHEN bad THEN '' ELSE split_part(text, chr(10), 1) END,
    CASE WHEN bad OR turn % 5 = 4 THEN '' ELSE 'https://muse.example/' || CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR) END,
    CASE WHEN bad THEN 'broken payload' WHEN turn % 5 = 4 THEN 'posting without link' END
  FROM (SELECT *, (conv_id * 100 + turn) % 10 = 7 AS bad FROM conversations)),
Z AS (
  SELECT 'jobs_cz', 'search ' || CAST(p_partkey % 3 AS VARCHAR), p_partkey, pos, title, url,
    CASE WHEN title IS NULL THEN 'card without title' WHEN NOT {_GATE("title")} THEN 'title not relevant' END
  FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey % 3 ORDER BY p_partkey, pos) AS n FROM ({JOBS_CZ_CARDS}) WHERE p_partkey % 10 <> 7)
  WHERE n <= CASE p_partkey % 3 WHEN 0 THEN 5 WHEN 1 THEN 50 ELSE n END
  UNION ALL SELECT 'jobs_cz', 'search ' || CAST(p_partkey % 3 AS VARCHAR), p_partkey, NULL, NULL, NULL, 'unreadable page' FROM part WHERE p_partkey % 10 = 7),
I AS (
  SELECT 'linkedin', 'data analyst BI', c_custkey, 0, 'Data Analyst ' || c_name, {_LI_URL}, NULL FROM customer WHERE c_custkey % 10 <> 7
  UNION ALL SELECT 'linkedin', 'data analyst BI', c_custkey, 1, 'BI Developer', {_LI_URL} || '-b', NULL FROM customer WHERE c_custkey % 10 <> 7
  UNION ALL SELECT 'linkedin', 'data analyst BI', c_custkey, 2, 'SQL Admin', NULL, 'card without link' FROM customer WHERE c_custkey % 10 <> 7
  UNION ALL SELECT 'linkedin', 'data analyst BI', c_custkey, NULL, NULL, NULL, 'unreadable page' FROM customer WHERE c_custkey % 10 = 7),
P AS (SELECT conv_id, turn, turn + 1 AS page_no, role, length(text) < 40 AS empty, turn % 4 = 3 AS last, (turn + 1) % 10 = 3 AS bad FROM conversations WHERE conv_id % 4 <> 0),
S AS (SELECT conv_id, min(page_no) FILTER (WHERE empty OR bad) AS se, min(page_no) FILTER (WHERE last AND NOT bad) AS sl FROM P WHERE page_no <= {K.JOBSTACK_MAX_PAGES} GROUP BY conv_id),
KP AS (SELECT P.* FROM P JOIN S USING (conv_id) WHERE page_no <= {K.JOBSTACK_MAX_PAGES} AND (se IS NULL OR page_no < se) AND (sl IS NULL OR page_no <= sl)),
LK AS (
  SELECT conv_id, page_no, 0 AS pos, {_q(K.JOBSTACK_BASE_URL)} || '/it-job/' || CAST(conv_id AS VARCHAR) || '-' || CAST((turn + 1) // 2 AS VARCHAR) AS url,
    CASE WHEN role = 'user' THEN 'Data Analyst' ELSE 'Chef' END AS title FROM KP
  UNION ALL SELECT conv_id, page_no, 1, {_q(K.JOBSTACK_BASE_URL)} || '/it-job/' || CAST(conv_id AS VARCHAR) || '-x' || CAST(turn AS VARCHAR), 'Senior BI Developer' FROM KP),
T AS (
  SELECT 'jobstack', CAST(conv_id AS VARCHAR), page_no, pos, title, url, CASE WHEN NOT {_GATE("title")} THEN 'title not relevant' END
  FROM LK QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_no, pos) = 1
  UNION ALL SELECT 'jobstack', CAST(conv_id AS VARCHAR), page_no, NULL, NULL, NULL, 'unreadable page' FROM P WHERE bad),
A AS (SELECT * FROM R UNION ALL SELECT * FROM M UNION ALL SELECT * FROM Z UNION ALL SELECT * FROM I UNION ALL SELECT * FROM T)
"""
SQL["ingest_quarantine"] = BROKEN + """SELECT source, query, CAST(page_no AS BIGINT) AS page_no, CAST(pos AS BIGINT) AS pos, reason, title, url
FROM A WHERE reason IS NOT NULL"""
SQL["ingest_reasons"] = BROKEN + "SELECT source, reason, count(*) AS n FROM A GROUP BY source, reason"
SQL["page_chain_stops"] = f"""WITH P AS (SELECT conv_id AS category, turn + 1 AS page_no, length(text) < 40 AS empty FROM conversations WHERE turn + 1 <= {K.JOBSTACK_MAX_PAGES}),
R AS (SELECT *, CASE WHEN empty THEN 'no links' WHEN page_no = {K.JOBSTACK_MAX_PAGES} THEN 'page limit' END AS reason FROM P)
SELECT category, coalesce(min(page_no) FILTER (WHERE reason IS NOT NULL), max(page_no)) AS page_no,
  coalesce(arg_min(reason, page_no) FILTER (WHERE reason IS NOT NULL), 'no more pages') AS reason,
  coalesce(arg_min(reason, page_no) FILTER (WHERE reason IS NOT NULL), 'no more pages') <> 'no links' AS inclusive
FROM R GROUP BY category"""
SQL["load_indexed"], SQL["unscored_indexed"] = SQL["load_twice"], SQL["select_unscored"]
SQL["override_compacted"] = SQL["latest_override"]
SQL["stateful_dedup"] = SQL["incremental_dedup"].replace(f"CASE WHEN {C.EARLY} THEN 0 ELSE 1 END", "CASE doc_id % 3 WHEN 1 THEN 0 WHEN 0 THEN 1 ELSE 2 END")

# ---------------------------------------------------------------- stored and incremental forms
SQL["keyword_index_gate"] = _with(D) + """, W AS (SELECT string_split(lower(text), ' ') AS w FROM benchmark),
KW AS (SELECT DISTINCT k FROM (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS k FROM W WHERE len(w) > 1
  UNION ALL SELECT lower(lang) FROM documents) WHERE k <> '')
SELECT doc_id, title, (SELECT count(*) FROM KW WHERE contains(lower(D.title), KW.k)) AS n_keywords FROM D"""
SQL["load_staged"] = SQL["load_duplicates"]                     # two epochs; what the killed run wrote and the replay count for nothing
SQL["load_staged_counters"] = REPEATED + """, C AS (SELECT (SELECT count(*) FROM KEPT) AS k, (SELECT count(*) FROM R2) AS r, (SELECT count(*) FROM LOST) AS l)
SELECT run, CASE WHEN run < 3 THEN k ELSE 0 END AS inserted, CASE WHEN run < 3 THEN r - k ELSE r END AS skipped, l AS quarantined FROM C, range(1, 4) AS t(run)"""
SQL["summary_rollup"], SQL["status_rollup"], SQL["source_rollup"], SQL["histogram_rollup"] = (
    SQL[x] for x in ("summary_metrics", "count_by_status", "count_by_source", "score_histogram"))
SQL["score_answers"] = SQL["score_postings"]
SQL["answer_calls"] = f"""WITH T AS (SELECT s.doc_id, {C.EARLY.replace('doc_id', 's.doc_id')} AS early,
  md5(coalesce(d.source, '') || chr(1) || coalesce(d.lang, '') || chr(1) || split_part(d.text, chr(10), 1) || chr(1) || substring(d.text, 1, 3000)) AS prompt
  FROM ({SCORED_D}) s JOIN documents d ON d.doc_id = s.doc_id)
SELECT 1 AS run, count(*) AS scored, count(DISTINCT prompt) AS called FROM T WHERE early
UNION ALL SELECT 2, count(*), (SELECT count(DISTINCT prompt) FROM T WHERE prompt NOT IN (SELECT prompt FROM T WHERE early)) FROM T"""
SQL["sorted_pages"] = SQL["sort_all"]
SQL["sorted_page"] = f"SELECT * FROM ({SQL['sort_all']}) WHERE rank BETWEEN {(C.SORTED_PAGE[0] - 1) * C.SORTED_PAGE[1] + 1} AND {C.SORTED_PAGE[0] * C.SORTED_PAGE[1]}"
