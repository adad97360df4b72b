"""The registered queries once more, as SQL for another engine."""

from darwise import values as V
from darwise.operators.pricing import permutation
from darwise.plans import queries as Q

_STAND_IN = """
line AS (
  SELECT l_orderkey, first(l_partkey ORDER BY l_linenumber, l_partkey) AS l_partkey, CAST(count(*) AS INTEGER) AS n_lines,
    sum(l_quantity) AS quantity, max(l_shipdate) AS shipped, sum(l_extendedprice) AS gross, sum(l_extendedprice * (1 - l_discount)) AS net
  FROM lineitem GROUP BY 1),
base AS (
  SELECT * FROM orders
  JOIN line ON o_orderkey = l_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN part ON l_partkey = p_partkey
  JOIN nation ON c_nationkey = n_nationkey),
units AS (
  SELECT o_orderkey AS unit_id, n_nationkey AS project_id, n_name || '-' || o_orderkey AS unit_no, p_type AS unit_type,
    n_lines AS bedrooms, CAST(quantity AS INTEGER) AS bathrooms, CAST(p_size AS DOUBLE) AS area_sqm,
    CASE WHEN p_size > 10 THEN n_lines END AS floor, p_brand AS view, n_lines AS parking_spaces,
    o_totalprice AS list_price_sar,
    CASE o_orderstatus WHEN 'F' THEN 'sold' WHEN 'O' THEN 'available' ELSE 'reserved' END AS status
  FROM base),
sales AS (
  SELECT o_orderkey AS sale_id, o_orderkey AS unit_id, n_nationkey AS project_id, CAST(shipped AS DATE) AS sale_date,
    net AS sale_price_sar, 100 * (1 - net / gross) AS discount_pct,
    o_orderpriority AS payment_method, CASE WHEN o_orderpriority <> '5-LOW' THEN c_mktsegment END AS bank_name,
    n_name AS buyer_city
  FROM base WHERE o_orderstatus = 'F'),
projects AS (
  SELECT n_nationkey AS project_id, n_name AS name_en, r_name AS city_en,
    '1995-' || lpad(CAST(n_nationkey % 12 + 1 AS VARCHAR), 2, '0') AS launch_month,
    coalesce(c.n, 0) AS total_units
  FROM nation JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN (SELECT c_nationkey AS k, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey
             WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY 1) c ON c.k = n_nationkey)
"""

_MONTHS_BACK = """
last_day AS (SELECT max(sale_date) AS d FROM sales),
bounds AS (SELECT
  CAST(date_trunc('month', d) - INTERVAL 3 MONTH AS DATE) + CAST(day(d) - 1 AS INTEGER) AS m3,
  CAST(date_trunc('month', d) - INTERVAL 6 MONTH AS DATE) + CAST(day(d) - 1 AS INTEGER) AS m6 FROM last_day),
momentum AS (SELECT
  count(*) FILTER (WHERE sale_date >= m3) AS units_sold,
  round(sum(sale_price_sar) FILTER (WHERE sale_date >= m3)) AS revenue_sar,
  count(*) FILTER (WHERE sale_date < m3 AND sale_date >= m6) AS units_sold_previous
  FROM sales, bounds)
"""

_STATUS = """
status AS (SELECT count(*) AS total, count(*) FILTER (WHERE status = 'available') AS available,
  count(*) FILTER (WHERE status = 'reserved') AS reserved, count(*) FILTER (WHERE status = 'sold') AS sold,
  round(100.0::DOUBLE * count(*) FILTER (WHERE status = 'sold') / nullif(count(*), 0), 1) AS sold_pct FROM units)
"""

_BY_PROJECT = """
by_project AS (SELECT p.name_en AS project, max(p.total_units) AS total_units,
  count(*) FILTER (WHERE u.status = 'sold') AS sold, count(*) FILTER (WHERE u.status = 'available') AS available,
  round(avg(CASE WHEN u.status = 'sold' THEN s.sale_price_sar END)) AS avg_sale_price_sar,
  round(avg(CASE WHEN u.status = 'sold' THEN s.sale_price_sar / nullif(u.area_sqm, 0) END)) AS avg_price_per_sqm
  FROM projects p JOIN units u ON u.project_id = p.project_id LEFT JOIN sales s ON s.unit_id = u.unit_id
  GROUP BY p.name_en)
"""

_BY_TYPE = """
by_type AS (SELECT u.unit_type, count(*) AS units_sold, round(avg(s.sale_price_sar)) AS avg_sale_price_sar
  FROM sales s JOIN units u ON u.unit_id = s.unit_id GROUP BY u.unit_type)
"""

_MONTHLY = """
span AS (SELECT min(date_trunc('month', sale_date)) AS a, max(date_trunc('month', sale_date)) AS b FROM sales),
months AS (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS DATE) AS month FROM span),
monthly AS (SELECT g.project_id, g.month,
    CASE WHEN p.launch_month IS NULL OR g.month >= CAST(p.launch_month || '-01' AS DATE) THEN coalesce(c.n, 0) END AS units
  FROM (SELECT project_id, month FROM (SELECT DISTINCT project_id FROM sales), months) g
  LEFT JOIN projects p ON p.project_id = g.project_id
  LEFT JOIN (SELECT project_id, CAST(date_trunc('month', sale_date) AS DATE) AS month, count(*) AS n FROM sales GROUP BY 1, 2) c
    ON c.project_id = g.project_id AND c.month = g.month)
"""

_A, _B, _P = V.DAMPED_ALPHA, V.DAMPED_BETA, V.DAMPED_PHI
_FORECAST = f"""
series AS (SELECT project_id, month, CAST(units AS DOUBLE) AS y, row_number() OVER w AS t, count(*) OVER (PARTITION BY project_id) AS n
  FROM monthly WHERE units IS NOT NULL WINDOW w AS (PARTITION BY project_id ORDER BY month)),
walk AS (
  SELECT s.project_id, CAST(1 AS BIGINT) AS t, s.y AS level, coalesce(s2.y - s.y, 0.0::DOUBLE) AS trend, CAST(NULL AS DOUBLE) AS ahead
  FROM series s LEFT JOIN series s2 ON s2.project_id = s.project_id AND s2.t = 2 WHERE s.t = 1
  UNION ALL
  SELECT w.project_id, s.t,
    {_A}::DOUBLE * s.y + {1 - _A}::DOUBLE * (w.level + {_P}::DOUBLE * w.trend),
    {_B}::DOUBLE * ({_A}::DOUBLE * s.y + {1 - _A}::DOUBLE * (w.level + {_P}::DOUBLE * w.trend) - w.level) + {1 - _B}::DOUBLE * {_P}::DOUBLE * w.trend,
    greatest(w.level + {_P}::DOUBLE * w.trend, 0.0::DOUBLE)
  FROM walk w JOIN series s ON s.project_id = w.project_id AND s.t = w.t + 1),
errors AS (SELECT s.project_id, s.t, s.n,
    abs(greatest(lag(s.y) OVER w, 0.0::DOUBLE) - s.y) AS e1,
    abs(greatest(avg(s.y) OVER (PARTITION BY s.project_id ORDER BY s.t ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) - s.y) AS e2,
    abs(k.ahead - s.y) AS e3
  FROM series s JOIN walk k ON k.project_id = s.project_id AND k.t = s.t WINDOW w AS (PARTITION BY s.project_id ORDER BY s.t)),
backtest AS (SELECT project_id, avg(e1) AS m1, avg(e2) AS m2, avg(e3) AS m3 FROM errors WHERE n >= 9 AND t > n - 6 GROUP BY 1),
chosen AS (SELECT *, CASE WHEN round(m1, 9) <= round(m2, 9) AND round(m1, 9) <= round(m3, 9) THEN 'naive_last'
    WHEN round(m2, 9) <= round(m3, 9) THEN 'mean_3' ELSE 'damped_trend' END AS method FROM backtest)
"""

_FEATURES = """
features AS (SELECT s.sale_id, CAST(p.project_id AS VARCHAR) AS project_id, p.name_en AS project_name, p.city_en AS city,
    u.unit_type, u.view, s.payment_method, u.bedrooms, u.bathrooms, u.area_sqm, coalesce(u.floor, 0) AS floor, u.parking_spaces,
    CAST(date_trunc('month', s.sale_date) AS DATE) AS month, (year(s.sale_date) - 2024) * 12 + month(s.sale_date) - 1 AS month_index,
    s.sale_price_sar
  FROM sales s JOIN units u ON u.unit_id = s.unit_id JOIN projects p ON p.project_id = s.project_id)
"""

_PRICE_BASELINE = """
cut AS (SELECT CAST(max(month) - INTERVAL 5 MONTH AS DATE) AS c FROM features),
train AS (SELECT f.*, sale_price_sar / nullif(area_sqm, 0) AS ppsqm FROM features f, cut WHERE month < c),
per_group AS (SELECT project_id, unit_type, median(ppsqm) AS m FROM train GROUP BY 1, 2),
overall AS (SELECT median(ppsqm) AS m FROM train),
test AS (SELECT f.project_name, f.sale_price_sar AS y, coalesce(g.m, o.m) * f.area_sqm AS p
  FROM features f JOIN cut ON f.month >= cut.c CROSS JOIN overall o
  LEFT JOIN per_group g ON g.project_id = f.project_id AND g.unit_type = f.unit_type)
"""


def _with(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(p.strip() for p in parts) + "\n"


def _quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


_ARABIC = r"[\x{0621}-\x{064A}\x{066E}-\x{06D3}\x{0671}]"
_STOP = _quoted(V.ARABIC_STOPWORDS + V.ENGLISH_STOPWORDS)
_TOKEN = r"[a-z]+|\p{Nd}+(?:[.,]\p{Nd}+)?"


def _tokens(text: str) -> str:
    """Tokens of a text without Arabic."""
    return f"list_filter(regexp_extract_all(lower({text}), '{_TOKEN}', 0), lambda t: t NOT IN ({_STOP}))"


_STRIP = r"regexp_replace(regexp_replace({}, '^\s+', ''), '\s+$', '')"


def _strip(x: str) -> str:
    return _STRIP.format(x)


_MAX, _OVER = V.CHUNK_MAX_CHARS, V.CHUNK_OVERLAP
_CHUNKS = f"""
whole AS (SELECT doc_id, lang, source, {_strip('text')} AS s FROM documents),
cuts AS (
  SELECT doc_id, s, CAST(0 AS BIGINT) AS a, CAST(CASE WHEN length(s) <= {_MAX} THEN length(s) ELSE 0 END AS BIGINT) AS z, CAST(0 AS BIGINT) AS step
  FROM whole
  UNION ALL
  SELECT doc_id, s, a2, CASE WHEN best <= a2 + {_MAX // 2} THEN stop ELSE best END, step + 1 FROM (
    SELECT *, greatest(
        CASE WHEN instr(reverse(win), chr(10)) > 0 THEN a2 + length(win) - instr(reverse(win), chr(10)) ELSE -1 END,
        CASE WHEN instr(reverse(win), ' .') > 0 THEN a2 + length(win) - instr(reverse(win), ' .') - 1 ELSE -1 END) AS best
    FROM (SELECT *, least(length(s), a2 + {_MAX}) AS stop, substr(s, a2 + 1, least(length(s), a2 + {_MAX}) - a2) AS win
      FROM (SELECT *, CASE WHEN z = 0 THEN 0 ELSE greatest(z - {_OVER}, a + 1) END AS a2 FROM cuts WHERE z < length(s))))),
pieces AS (SELECT doc_id, a, {_strip('substr(s, a + 1, z - a)')} AS piece FROM cuts WHERE z > 0),
chunks AS (
  SELECT CAST(p.doc_id AS VARCHAR) || '#' || (row_number() OVER (PARTITION BY p.doc_id ORDER BY a) - 1) AS chunk_id, p.doc_id,
    CASE WHEN starts_with(piece, CAST(p.doc_id AS VARCHAR)) THEN piece ELSE CAST(p.doc_id AS VARCHAR) || chr(10) || piece END AS text,
    w.lang, w.source, CAST(p.doc_id AS VARCHAR) AS title
  FROM pieces p JOIN whole w ON w.doc_id = p.doc_id WHERE piece <> '')
"""


def _bm25(corpus: str, queries: str) -> str:
    """CTEs up to ``lexical(query_id, chunk_id, score, bm25_rank)`` over ``corpus(chunk_id, text)``."""
    k1, b = V.BM25_K1, V.BM25_B
    return f"""
toks AS (SELECT chunk_id, {_tokens('text')} AS ts FROM {corpus}),
size AS (SELECT count(*) AS n, avg(len(ts)) AS avg_len FROM toks),
post AS (SELECT chunk_id, len, term, count(*) AS tf FROM (SELECT chunk_id, len(ts) AS len, unnest(ts) AS term FROM toks) GROUP BY 1, 2, 3),
freq AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
idf AS (SELECT term, df, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS v FROM freq, size),
mean_idf AS (SELECT avg(v) AS m FROM idf),
qterm AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_tokens('text')}) AS term FROM {queries}) GROUP BY 1, 2),
scored AS (SELECT query_id, chunk_id, round(sum(
    qtf * (CASE WHEN v < 0 THEN {V.BM25_EPSILON}::DOUBLE * m ELSE v END) * tf * {k1 + 1}::DOUBLE
    / (tf + {k1}::DOUBLE * ({1 - b}::DOUBLE + {b}::DOUBLE * len / avg_len))), 9) AS score
  FROM qterm JOIN idf USING (term) JOIN post USING (term), mean_idf, size GROUP BY 1, 2),
lexical AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS bm25_rank
  FROM scored WHERE score > 0) WHERE bm25_rank <= {V.CANDIDATES})
"""


_VECTOR_CORPUS = f"""
corpus AS (SELECT CAST(d.doc_id AS VARCHAR) AS chunk_id, d.doc_id, d.text, d.lang, d.source, CAST(e.embedding AS DOUBLE[]) AS v
  FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id),
asked AS (SELECT b.item_id AS query_id, b.text, c.lang, c.source AS project_id, c.v FROM benchmark b JOIN corpus c ON c.doc_id = b.item_id),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS dense_rank FROM (
  SELECT q.query_id, c.chunk_id, round(list_cosine_similarity(q.v, c.v), 9) AS s FROM asked q, corpus c WHERE q.v IS NOT NULL AND c.v IS NOT NULL)) WHERE dense_rank <= {V.CANDIDATES})
"""

_FUSED = f"""
fused AS (SELECT coalesce(l.query_id, n.query_id) AS query_id, coalesce(l.chunk_id, n.chunk_id) AS chunk_id, bm25_rank, dense_rank,
    coalesce(1.0::DOUBLE / ({V.RRF_K} + bm25_rank), 0) + coalesce(1.0::DOUBLE / ({V.RRF_K} + dense_rank), 0) AS rrf
  FROM lexical l FULL JOIN near n ON n.query_id = l.query_id AND n.chunk_id = l.chunk_id),
boosted AS (SELECT f.*, c.text, c.source, round(rrf * (CASE WHEN c.lang = q.lang THEN {V.LANGUAGE_BOOST}::DOUBLE ELSE 1.0::DOUBLE END)
    * (CASE WHEN c.source = q.project_id OR c.source = '{V.SHARED_PROJECT}' THEN {V.PROJECT_BOOST}::DOUBLE ELSE 1.0::DOUBLE END), 9) AS s9
  FROM fused f JOIN asked q ON q.query_id = f.query_id JOIN corpus c ON c.chunk_id = f.chunk_id),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s9 DESC, chunk_id) AS rank FROM boosted) WHERE rank <= {V.TOP_K})
"""
_HYBRID = _with(_VECTOR_CORPUS, _bm25("corpus", "asked"), _FUSED)


_LO, _HI = V.NGRAM_RANGE


def _ngrams(name: str, source: str, key: str) -> str:
    """CTE ``name(k, bucket, w)``: hashed n-gram vectors of the texts of a table."""
    grams = [f"list_transform(range(1, greatest(length(p) - {n} + 2, 1)), lambda i: substr(p, i, {n}))" for n in range(_LO, _HI + 1)]
    return f"""
{name}_tf AS (SELECT k, CAST('0x' || substr(md5(g), 1, 8) AS BIGINT) % {V.VECTOR_DIM} AS bucket, count(*) AS tf
  FROM (SELECT k, unnest(flatten([{', '.join(grams)}])) AS g FROM (SELECT {key} AS k, ' ' || lower(text) || ' ' AS p FROM {source})) GROUP BY 1, 2),
{name} AS (SELECT k, bucket, CAST(ln(1 + tf) / sqrt(sum(ln(1 + tf) * ln(1 + tf)) OVER (PARTITION BY k)) AS FLOAT) AS w FROM {name}_tf)
"""


def _any(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def _arabic_texts(words) -> str:
    listed = "[" + _quoted(words) + "]"
    return f"""texts AS (SELECT o_orderkey, w[(o_orderkey % {len(words)}) + 1] || '  ' || w[(o_custkey % {len(words)}) + 1] || '  ' || w[((o_orderkey + 3 * o_custkey + 1) % {len(words)}) + 1]
    || CASE WHEN o_orderkey % 3 = 0 THEN ' ' || o_orderpriority ELSE '' END AS text FROM orders, (SELECT {listed} AS w))"""


_MARKS = "".join(chr(c) for lo, hi in V.DIACRITIC_RANGES for c in range(lo, hi + 1))
_FOLD_FROM = V.ARABIC_INDIC_DIGITS + V.EASTERN_ARABIC_INDIC_DIGITS + V.ARABIC_SEPARATORS + V.LETTER_VARIANTS
_FOLD_TO = V.WESTERN_DIGITS * 2 + V.WESTERN_SEPARATORS + V.LETTER_TARGETS


def _folded(text: str) -> str:
    return f"lower(translate({text}, '{_FOLD_FROM}{V.TATWEEL}{_MARKS}', '{_FOLD_TO}'))"


def _without_articles(token: str) -> str:
    """An article goes where two letters or more are left behind it."""
    for article in V.ARABIC_ARTICLES:
        token = f"CASE WHEN starts_with({token}, '{article}') AND length({token}) >= {len(article) + 2} THEN substr({token}, {len(article) + 1}) ELSE {token} END"
    return token


def _project_case(column: str) -> str:
    whens = " ".join(f"WHEN {_any(column, words)} THEN '{p}'" for p, words in V.PROJECT_PATTERNS.items())
    return f"CASE {whens} END"


_CONTRACT = """
cf0 AS (SELECT *, round(o_totalprice) AS total,
    CASE WHEN o_orderpriority = '1-URGENT' THEN 'cash' WHEN o_orderpriority IN ('2-HIGH', '3-MEDIUM') THEN 'bank_financing' ELSE 'installments' END AS method
  FROM base JOIN region ON n_regionkey = r_regionkey),
cf1 AS (SELECT *, CASE WHEN method = 'cash' THEN total ELSE floor(total / 5) END AS down FROM cf0),
cf AS (SELECT o_orderkey AS order_key, substr('ABCD', CAST(o_orderkey % 4 + 1 AS BIGINT), 1) AS template,
    'C-' || lpad(CAST(o_orderkey AS VARCHAR), 7, '0') AS contract_no,
    strftime(o_orderdate, '%Y-%m-%d') AS contract_date, c_name AS buyer_name,
    '1' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS buyer_national_id, '05' || lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS buyer_phone,
    n_name AS project_name, r_name AS city, 'U-' || lpad(CAST(o_orderkey AS VARCHAR), 7, '0') AS unit_no,
    CASE WHEN p_type = 'ECONOMY' THEN 'apartment' WHEN p_type IN ('SMALL', 'MEDIUM') THEN 'townhouse' WHEN p_type = 'LARGE' THEN 'duplex' ELSE 'villa' END AS unit_type,
    CAST(p_size + 40 AS DOUBLE) AS area_sqm, total AS total_price_sar, method AS payment_method, CAST(down AS DOUBLE) AS down_payment_sar,
    CAST(CASE method WHEN 'cash' THEN 0 WHEN 'installments' THEN n_lines + 4 ELSE 1 END AS INTEGER) AS installments_count,
    CAST(CASE method WHEN 'cash' THEN 0.0 WHEN 'installments' THEN floor((total - down) / (n_lines + 4)) ELSE total - down END AS DOUBLE) AS installment_amount_sar,
    CASE WHEN method = 'bank_financing' THEN 'Bank ' || upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) END AS bank_name,
    strftime(shipped, '%Y-%m-%d') AS delivery_date
  FROM cf1)
"""


def _money(x: str) -> str:
    return f"format('{{:,}}', CAST(round({x}) AS BIGINT))"


_EXPECTED = "(down_payment_sar + installments_count * installment_amount_sar)"
_ISSUES = f"""concat_ws('; ',
    CASE WHEN buyer_national_id <> '' AND NOT regexp_full_match(buyer_national_id, '[12]\\d{{9}}') THEN '{V.ISSUE_NATIONAL_ID}' END,
    CASE WHEN buyer_phone <> '' AND NOT regexp_full_match(replace(buyer_phone, ' ', ''), '05\\d{{8}}|\\+9665\\d{{8}}') THEN '{V.ISSUE_PHONE}' END,
    CASE WHEN total_price_sar <= 0 THEN '{V.ISSUE_PRICE}' END,
    CASE WHEN NOT (area_sqm BETWEEN 40 AND 2000) THEN '{V.ISSUE_AREA}' END,
    CASE WHEN payment_method = 'cash' AND abs(down_payment_sar - total_price_sar) > 1 THEN '{V.ISSUE_CASH}' END,
    CASE WHEN payment_method <> 'cash' AND abs({_EXPECTED} - total_price_sar) > greatest(1.0::DOUBLE, 0.001::DOUBLE * total_price_sar)
      THEN 'payments do not sum to price (expected ' || {_money('total_price_sar')} || ', got ' || {_money(_EXPECTED)} || ')' END,
    CASE WHEN payment_method = 'bank_financing' AND coalesce(bank_name, '') = '' THEN '{V.ISSUE_BANK}' END,
    CASE WHEN NOT regexp_full_match(contract_date, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN 'contract_date is not a valid ISO date: ' || contract_date END,
    CASE WHEN NOT regexp_full_match(delivery_date, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN 'delivery_date is not a valid ISO date: ' || delivery_date END,
    CASE WHEN regexp_full_match(contract_date, '\\d{{4}}-\\d{{2}}-\\d{{2}}') AND delivery_date < contract_date THEN '{V.ISSUE_ORDER}' END,
    CASE WHEN coalesce(contract_no, '') = '' OR coalesce(buyer_name, '') = '' OR coalesce(unit_no, '') = '' OR total_price_sar IS NULL
      THEN '{V.ISSUE_MISSING}' || concat_ws(', ',
        CASE WHEN coalesce(contract_no, '') = '' THEN 'contract_no' END, CASE WHEN coalesce(buyer_name, '') = '' THEN 'buyer_name' END,
        CASE WHEN coalesce(unit_no, '') = '' THEN 'unit_no' END, CASE WHEN total_price_sar IS NULL THEN 'total_price_sar' END) END)"""
_FIELD_LIST = ", ".join(V.CONTRACT_FIELDS)

# What the truth with slips changes, field by field: does the field still match?
_OK = {f: "1" for f in V.CONTRACT_FIELDS}
_OK["area_sqm"] = f"CASE WHEN order_key % 3 <= greatest({V.MATCH_TOLERANCE_ABS}, {V.MATCH_TOLERANCE_REL} * (area_sqm + order_key % 3)) THEN 1 ELSE 0 END"
_OK["city"] = "CASE WHEN order_key % 5 <> 0 THEN 1 ELSE 0 END"
_VERDICTS = "verdicts AS (SELECT *, " + ", ".join(f"({e}) AS ok_{f}" for f, e in _OK.items()) + f", {_ISSUES} AS issues FROM cf)"
_HITS = " + ".join(f"ok_{f}" for f in V.CONTRACT_FIELDS)
_N = len(V.CONTRACT_FIELDS)

_GATE_TEXT = """
gate0 AS (SELECT p_partkey, CASE p_partkey %% 8
    WHEN 0 THEN 'select * from units where view = ''' || p_brand || ''';'
    WHEN 1 THEN 'SELECT unit_id FROM units LIMIT ' || (p_size * 3)
    WHEN 2 THEN 'with t as (select * from units limit ' || (p_size * 9) || ') select * from t limit ' || p_size
    WHEN 3 THEN 'select 1; delete from units where area_sqm = ' || p_size
    WHEN 4 THEN '  update units set view = ''' || p_brand || ''''
    WHEN 5 THEN 'select replace(view, ''a'', ''' || p_name || ''') from units'
    WHEN 6 THEN 'drop table part_' || p_size
    ELSE 'select count(*) from units where unit_type = ''' || p_type || ''' -- dropped' END AS t, p_size FROM part),
gate1 AS (SELECT p_partkey, p_size, trim(rtrim(trim(t), ';')) AS s FROM gate0),
gate2 AS (SELECT *, CASE WHEN contains(s, ';') THEN '%(many)s'
    WHEN NOT regexp_matches(s, '^(select|with)\\b', 'i') THEN '%(select)s'
    WHEN regexp_matches(s, '\\b(%(words)s)\\b', 'i') THEN '%(forbidden)s' END AS reason FROM gate1)
""" % {
    "many": V.SQL_TOO_MANY,
    "select": V.SQL_NOT_SELECT,
    "forbidden": V.SQL_FORBIDDEN,
    "words": "|".join(V.FORBIDDEN_SQL_WORDS),
}


def oracle_sql() -> dict[str, str]:
    o: dict[str, str] = {}
    o["kpi_status_totals"] = _with(_STAND_IN, _STATUS) + "SELECT * FROM status"
    o["kpi_revenue"] = _with(_STAND_IN) + (
        "SELECT round(sum(sale_price_sar)) AS revenue_sar_total, round(avg(discount_pct), 2) AS avg_discount_pct, max(sale_date) AS as_of FROM sales"
    )
    o["kpi_recent_momentum"] = _with(_STAND_IN, _MONTHS_BACK) + "SELECT * FROM momentum"
    o["kpi_by_project"] = _with(_STAND_IN, _BY_PROJECT) + "SELECT * FROM by_project"
    o["kpi_inventory_series"] = _with(_STAND_IN, _BY_PROJECT) + "SELECT project, sold, available FROM by_project"
    o["kpi_by_unit_type"] = _with(_STAND_IN, _BY_TYPE) + "SELECT * FROM by_type"
    o["kpi_financing_mix"] = _with(_STAND_IN) + "SELECT payment_method, count(*) AS n_sales FROM sales GROUP BY 1"
    o["kpi_snapshot"] = _with(_STAND_IN, _STATUS, _MONTHS_BACK, _BY_PROJECT, _BY_TYPE) + """
SELECT (SELECT max(sale_date) FROM sales) AS as_of, s.*, (SELECT round(sum(sale_price_sar)) FROM sales) AS revenue_sar_total,
  m.units_sold AS recent_units, m.revenue_sar AS recent_revenue, m.units_sold_previous AS previous_units,
  (SELECT round(avg(discount_pct), 2) FROM sales) AS avg_discount_pct,
  (SELECT string_agg(concat_ws('|', project, total_units, sold, available, CAST(avg_sale_price_sar AS BIGINT), CAST(avg_price_per_sqm AS BIGINT)), ';' ORDER BY sold DESC, project) FROM by_project) AS by_project,
  (SELECT string_agg(concat_ws('|', unit_type, units_sold, CAST(avg_sale_price_sar AS BIGINT)), ';' ORDER BY units_sold DESC, unit_type) FROM by_type) AS by_unit_type,
  (SELECT string_agg(concat_ws('|', payment_method, n), ';' ORDER BY payment_method) FROM (SELECT payment_method, count(*) AS n FROM sales GROUP BY 1)) AS financing_mix
FROM status s, momentum m"""
    o["quarterly_median_ppsqm"] = _with(_STAND_IN) + """
SELECT CAST(date_trunc('quarter', s.sale_date) AS DATE) AS quarter, p.name_en AS project_name,
  round(median(s.sale_price_sar / nullif(u.area_sqm, 0)) + 1e-9::DOUBLE, 6) AS median_ppsqm
FROM sales s JOIN units u ON u.unit_id = s.unit_id JOIN projects p ON p.project_id = s.project_id GROUP BY 1, 2"""
    o["unit_stats"] = _with(_STAND_IN) + """
SELECT project_id, unit_type, count(*) AS n_units, count(*) FILTER (WHERE status = 'available') AS available,
  min(area_sqm) AS min_area, max(area_sqm) AS max_area, min(list_price_sar) AS min_price, max(list_price_sar) AS max_price,
  CAST(grouping(unit_type) AS INTEGER) AS is_project_total
FROM units GROUP BY GROUPING SETS ((project_id, unit_type), (project_id))"""
    o["remaining_units"] = _with(_STAND_IN) + (
        "SELECT project_id, count(*) FILTER (WHERE status = 'available') AS remaining_units FROM units GROUP BY 1"
    )
    o["sales_export"] = _with(_STAND_IN) + """
SELECT s.sale_id, s.sale_date, round(s.sale_price_sar, 4) AS sale_price_sar, round(s.discount_pct, 4) AS discount_pct, s.payment_method, s.bank_name, s.buyer_city,
  u.unit_id, u.unit_no, u.unit_type, u.bedrooms, u.bathrooms, u.area_sqm, u.floor, u.view, u.parking_spaces, u.list_price_sar,
  p.project_id, p.name_en AS project_name, p.city_en AS city
FROM sales s JOIN units u ON u.unit_id = s.unit_id JOIN projects p ON p.project_id = s.project_id"""
    o["monthly_absorption"] = _with(_STAND_IN, _MONTHLY) + "SELECT * FROM monthly"
    o["absorption_backtest"] = _with(_STAND_IN, _MONTHLY, _FORECAST, recursive=True) + (
        "SELECT project_id, round(m1, 6) AS mae_naive_last, round(m2, 6) AS mae_mean_3, round(m3, 6) AS mae_damped_trend, method FROM chosen"
    )
    steps = ", ".join(f"({k}, {sum(_P**i for i in range(1, k + 1))}::DOUBLE)" for k in range(1, 7))
    o["absorption_forecast"] = _with(_STAND_IN, _MONTHLY, _FORECAST, recursive=True) + f"""
, steps(k, reach) AS (VALUES {steps}),
tail AS (SELECT project_id, max(month) AS last_month, last(y ORDER BY t) AS y1, avg(y) AS y3,
    string_agg(CAST(CAST(y AS BIGINT) AS VARCHAR), ',' ORDER BY t) AS last_3_months FROM series WHERE t > n - 3 GROUP BY 1),
state AS (SELECT w.project_id, w.level, w.trend FROM walk w JOIN (SELECT DISTINCT project_id, n FROM series) s ON s.project_id = w.project_id AND s.n = w.t),
stock AS (SELECT project_id, count(*) FILTER (WHERE status = 'available') AS n FROM units GROUP BY 1),
path AS (SELECT c.project_id, c.method, k, t.last_month, t.last_3_months, CASE c.method WHEN 'naive_last' THEN greatest(t.y1, 0.0::DOUBLE)
    WHEN 'mean_3' THEN greatest(t.y3, 0.0::DOUBLE) ELSE greatest(s.level + reach * s.trend, 0.0::DOUBLE) END AS units
  FROM chosen c JOIN tail t USING (project_id) JOIN state s USING (project_id), steps)
SELECT p.project_id, p.method, coalesce(st.n, 0) AS remaining_units,
  round(CASE WHEN avg(units) OVER w > {V.MIN_MONTHLY_SALES} THEN coalesce(st.n, 0) / avg(units) OVER w END, 6) AS months_of_inventory,
  p.last_3_months, CAST(last_month + to_months(CAST(k AS INTEGER)) AS DATE) AS month, round(units, 6) AS units
FROM path p LEFT JOIN stock st USING (project_id) WINDOW w AS (PARTITION BY p.project_id)""".replace("\n, steps", ",\nsteps", 1)
    o["price_features"] = _with(_STAND_IN, _FEATURES) + (
        "SELECT * REPLACE (round(sale_price_sar, 4) AS sale_price_sar) FROM features"
    )
    o["price_baseline_metrics"] = _with(_STAND_IN, _FEATURES, _PRICE_BASELINE) + """
SELECT 'baseline' AS predictor, round(avg(abs(y - p)), 6) AS mae, round(avg(abs(y - p) / greatest(abs(y), 2.220446049250313e-16)), 6) AS mape,
  round(1 - sum((y - p) * (y - p)) / (count(*) * var_pop(y)), 6) AS r2 FROM test"""
    o["price_split"] = _with(_STAND_IN, _FEATURES, _PRICE_BASELINE) + """
SELECT CASE WHEN month < c THEN 'train' ELSE 'test' END AS half, project_name, count(*) AS n, min(month) AS first_month, max(month) AS last_month,
  strftime(max(c), '%Y-%m') AS test_start FROM features, cut GROUP BY 1, 2"""
    learnt = [
        f"code_{c} AS (SELECT CAST({c} AS VARCHAR) AS v, CAST(row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR)) - 1 AS INTEGER) AS code FROM train GROUP BY 1)"
        for c in V.PRICE_CATEGORICAL
    ]
    coded = ", ".join(f"coalesce((SELECT code FROM code_{c} WHERE v = CAST(f.{c} AS VARCHAR)), CAST((SELECT count(*) FROM code_{c}) AS INTEGER)) AS {c}_code" for c in V.PRICE_CATEGORICAL)
    o["price_codes"] = _with(_STAND_IN, _FEATURES, _PRICE_BASELINE, *learnt) + f"SELECT sale_id, {coded} FROM features f"
    a, b = permutation("area_sqm", 0)
    placed = "placed AS (SELECT sale_id, area_sqm, row_number() OVER (ORDER BY md5(CAST(sale_id AS VARCHAR) || ':42'), sale_id) - 1 AS place FROM features)"
    o["price_permutation"] = _with(_STAND_IN, _FEATURES, placed) + f"""
SELECT p.sale_id, p.place, d.sale_id AS donor_id, d.area_sqm AS donor_area
FROM placed p JOIN placed d ON d.place = (p.place * {a} + {b}) % (SELECT count(*) FROM placed)"""
    o["price_defaults"] = _with(_STAND_IN) + f"""
SELECT unit_id, CASE WHEN unit_id % 4 = 0 THEN 'cash' ELSE '{V.DEFAULT_PAYMENT}' END AS payment_method, coalesce(floor, 0) AS floor, 7 AS month_index,
  CASE WHEN unit_id % 5 = 0 THEN 'Somewhere' ELSE '{V.DEFAULT_CITY}' END AS city,
  CASE WHEN unit_id % 3 = 0 AND bathrooms <> 0 THEN bathrooms ELSE greatest(1, bedrooms - 1) END AS bathrooms FROM units"""
    o["price_baseline_by_project"] = _with(_STAND_IN, _FEATURES, _PRICE_BASELINE) + (
        "SELECT project_name, round(avg(abs(y - p) / greatest(abs(y), 2.220446049250313e-16)), 6) AS mape FROM test GROUP BY 1"
    )
    o["tokens"] = f"SELECT doc_id, len(ts) AS n_tokens, array_to_string(ts, ' ') AS tokens FROM (SELECT doc_id, {_tokens('text')} AS ts FROM documents)"
    o["term_stats"] = f"""SELECT term, count(*) AS df, max(tf) AS max_tf, min(len) AS min_len FROM (
  SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(ts) AS len, unnest(ts) AS term FROM (SELECT doc_id, {_tokens('text')} AS ts FROM documents)) GROUP BY 1, 2, 3) GROUP BY 1"""
    ar = f"len(regexp_extract_all(text, '{_ARABIC}'))"
    la = "len(regexp_extract_all(text, '[A-Za-z]'))"
    language = f"CASE WHEN {ar} > 0 AND {ar} >= {la} THEN 'ar' ELSE 'en' END"
    o["language_mix"] = f"""SELECT declared, {language} AS detected, count(*) AS n FROM (
  SELECT text, lang AS declared FROM documents UNION ALL SELECT text, role FROM conversations) GROUP BY 1, 2"""
    o["match_keys"] = r"SELECT conv_id, turn, trim(regexp_replace(lower(text), '[\s\-_/,،:;]+', ' ', 'g')) AS match_key FROM conversations"
    o["western_digits"] = """SELECT o_orderkey, format('{:,.2f}', o_totalprice) AS western, round(o_totalprice, 2) AS price, false AS is_error FROM orders"""
    o["parsed_dates"] = """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS iso,
  o_orderkey % 5 = 4 AS is_error FROM orders"""
    o["sale_periods"] = """SELECT CAST(date_trunc('quarter', l_shipdate) AS DATE) AS quarter, (year(l_shipdate) - 2024) * 12 + month(l_shipdate) - 1 AS month_index,
  count(*) AS n FROM lineitem GROUP BY 1, 2"""
    o["length_guard"] = f"SELECT role, length({_strip('text')}) >= 20 AS accepted, count(*) AS n FROM conversations GROUP BY 1, 2"
    o["chunks"] = _with(_CHUNKS, recursive=True) + "SELECT chunk_id, doc_id, text, lang, source, title FROM chunks"
    o["markdown_chunks"] = """
SELECT '/sheets/c' || c_custkey || '.md#' || n AS chunk_id, 'c' || c_custkey AS doc_id,
  c_name || chr(10) || CASE n WHEN 0 THEN '## Balance' || chr(10) || 'The balance is ' || CAST(CAST(c_acctbal AS DECIMAL(18, 2)) AS VARCHAR) || '.' || chr(10) || '#### Note' || chr(10) || 'not a section'
    ELSE '### Segment: ' || c_mktsegment || chr(10) || chr(10) || '- nation ' || c_nationkey END AS text,
  'P' || c_nationkey AS project_id, 'sheet-' || c_custkey AS source, c_name AS title
FROM customer, (VALUES (0), (1)) v(n)"""
    items = "items AS (SELECT item_id AS query_id, text FROM benchmark)"
    o["bm25_topk"] = _with(_CHUNKS, items, _bm25("chunks", "items"), recursive=True) + (
        "SELECT query_id, chunk_id, round(score, 6) AS score, bm25_rank FROM lexical"
    )
    o["dense_topk"] = f"""
WITH cells AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
means AS (SELECT label AS query_id, list(m ORDER BY i) AS v FROM (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM cells GROUP BY 1, 2) GROUP BY 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS dense_rank FROM (
  SELECT query_id, vec_id, round(list_cosine_similarity(v, CAST(embedding AS DOUBLE[])), 9) AS s FROM means, embeddings))
SELECT query_id, vec_id, round(s, 6) AS score, dense_rank FROM ranked WHERE dense_rank <= {V.CANDIDATES}"""
    o["clustered_topk"] = o["dense_topk"]
    o["hybrid_rrf"] = _HYBRID + "SELECT query_id, chunk_id, round(s9, 6) AS score, bm25_rank, dense_rank, rank FROM hits"
    near = f"""near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS dense_rank FROM (
  SELECT query_id, chunk_id, coalesce(s, 0) AS s FROM (SELECT query_id, chunk_id FROM items, chunks) LEFT JOIN (
    SELECT q.k AS query_id, c.k AS chunk_id, round(sum(CAST(q.w AS DOUBLE) * CAST(c.w AS DOUBLE)), 9) AS s FROM qvec q JOIN cvec c USING (bucket) GROUP BY 1, 2)
  USING (query_id, chunk_id))) WHERE dense_rank <= {V.CANDIDATES})"""
    asked = "asked AS (SELECT query_id, text, CAST(NULL AS VARCHAR) AS lang, CAST(NULL AS VARCHAR) AS project_id FROM items)"
    o["hybrid_ngrams"] = _with(
        _CHUNKS, items, asked, "corpus AS (SELECT * FROM chunks)", _ngrams("qvec", "items", "query_id"), _ngrams("cvec", "chunks", "chunk_id"),
        near, _bm25("chunks", "items"), _FUSED, recursive=True,
    ) + "SELECT query_id, chunk_id, round(s9, 6) AS score, bm25_rank, dense_rank, rank FROM hits"
    o["ngram_vectors"] = _with(_ngrams("vec", "documents", "doc_id")) + """
SELECT k AS doc_id, CAST(count(*) AS INTEGER) AS n_buckets, CAST(sum(bucket) AS BIGINT) AS bucket_sum, round(sum(CAST(w AS DOUBLE) * (bucket % 7)), 4) AS weighed FROM vec GROUP BY 1"""
    o["hybrid_sources"] = _HYBRID + """
SELECT query_id, string_agg(source, ',' ORDER BY r) AS sources FROM (SELECT query_id, source, min(rank) AS r FROM hits GROUP BY 1, 2) GROUP BY 1"""
    o["hybrid_context"] = _HYBRID + """
SELECT query_id, 'DOCUMENT EXCERPTS:' || chr(10) || string_agg('[' || rank || '] source=' || source || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context FROM hits GROUP BY 1"""
    q = "lower(text)"
    inv = _any(q, V.INVENTORY_HINTS_AR + V.INVENTORY_HINTS_EN)
    doc = _any(q, V.DOCUMENT_HINTS_AR + V.DOCUMENT_HINTS_EN)
    o["route_questions"] = f"""
SELECT conv_id, turn, role, lang, route, project_id, route <> 'inventory' AS needs_documents, route <> 'docs' AS needs_inventory FROM (
  SELECT conv_id, turn, role, {language} AS lang, CASE WHEN {inv} AND {doc} THEN 'both' WHEN {inv} THEN 'inventory' ELSE 'docs' END AS route,
    {_project_case(q)} AS project_id FROM conversations)"""
    arabic_token = V.ARABIC_LETTER_CLASS + "+|" + _TOKEN
    o["arabic_tokens"] = _with(_arabic_texts(Q.ARABIC_WORDS)) + f"""
SELECT o_orderkey, len(ts) AS n_tokens, array_to_string(ts, ' ') AS tokens FROM (
  SELECT o_orderkey, list_filter(list_transform(regexp_extract_all({_folded('text')}, '{arabic_token}', 0), lambda t: {_without_articles('t')}), lambda t: t NOT IN ({_STOP})) AS ts FROM texts)"""
    o["arabic_match_keys"] = _with(_arabic_texts(Q.ARABIC_WORDS)) + f"""
SELECT o_orderkey, trim(regexp_replace({_folded('text')}, '[\\s\\-_/,،:;]+', ' ', 'g')) AS match_key FROM texts"""
    o["arabic_routes"] = _with(_arabic_texts(Q.QUESTION_WORDS)) + f"""
SELECT o_orderkey, lang, route, project_id, route <> 'inventory' AS needs_documents, route <> 'docs' AS needs_inventory FROM (
  SELECT o_orderkey, {language} AS lang, CASE WHEN {inv} AND {doc} THEN 'both' WHEN {inv} THEN 'inventory' ELSE 'docs' END AS route,
    {_project_case(q)} AS project_id FROM texts)"""
    o["recent_turns"] = """SELECT conv_id, turn, role, text FROM (SELECT conv_id, turn, role, text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 6"""
    o["sql_gate"] = _with(_GATE_TEXT) + """
SELECT p_partkey, CASE WHEN reason IS NULL THEN 'safe' ELSE 'unsafe' END AS verdict, reason, CASE WHEN reason IS NOT NULL THEN NULL
  WHEN p_partkey % 8 = 1 THEN 'SELECT unit_id FROM units LIMIT ' || least(p_size * 3, 50)
  WHEN p_partkey % 8 = 2 THEN 'with t as (select * from units LIMIT ' || least(p_size * 9, 50) || ') select * from t LIMIT ' || least(p_size, 50)
  ELSE s || ' LIMIT 50' END AS safe_sql FROM gate2"""
    o["contract_roundtrip"] = _with(_STAND_IN, _CONTRACT) + f"""
SELECT contract_no || '.txt' AS source, {_FIELD_LIST}, {_ISSUES} AS issues, {_ISSUES} <> '' AS needs_review FROM cf"""
    unread = "order_key % 4 = 3"
    fields = ", ".join(f"CASE WHEN {unread} THEN NULL ELSE {f} END AS {f}" for f in V.CONTRACT_FIELDS)
    o["reply_records"] = _with(_STAND_IN, _CONTRACT) + f"""
SELECT contract_no || '.txt' AS source, {fields}, CASE WHEN {unread} THEN '{V.ISSUE_FAILED}' ELSE {_ISSUES} END AS issues, {unread} AS is_error FROM cf"""
    per_field = " UNION ALL ".join(f"SELECT '{f}' AS field, sum(ok_{f})::BIGINT AS hits, count(*) AS n FROM verdicts" for f in V.CONTRACT_FIELDS)
    verdicts = _with(_STAND_IN, _CONTRACT, _VERDICTS)
    o["extraction_per_field"] = verdicts + f"SELECT field, hits, n, round(hits / n, 6) AS accuracy FROM ({per_field})"
    o["extraction_by_template"] = verdicts + (
        f"SELECT template, count(*) AS n, round(sum({_HITS}) / (count(*) * {_N}), 6) AS accuracy FROM verdicts GROUP BY 1"
    )
    planted = "delivery_date < contract_date"
    o["extraction_totals"] = verdicts + f"""
SELECT count(*) AS n_contracts, round(sum({_HITS}) / (count(*) * {_N}), 6) AS overall,
  round(count(*) FILTER (WHERE {_HITS} = {_N}) / count(*), 6) AS perfect_contracts, count(*) FILTER (WHERE issues <> '') AS flagged_for_review,
  count(*) FILTER (WHERE {planted}) AS planted_issues_total, count(*) FILTER (WHERE {planted} AND issues <> '') AS planted_issues_caught FROM verdicts"""
    o["extraction_missing"] = verdicts + f"""
SELECT count(*) AS n_contracts, round(count(*) FILTER (WHERE order_key % 3 <> 0 AND {_HITS} = {_N}) / count(*), 6) AS perfect_contracts,
  count(*) FILTER (WHERE order_key % 3 = 0 OR issues <> '') AS flagged_for_review FROM verdicts"""
    o["document_contracts"] = f"""SELECT CAST(doc_id AS VARCHAR) AS source, '{V.ISSUE_MISSING}contract_no, buyer_name, unit_no, total_price_sar' AS issues, true AS needs_review FROM documents"""
    o["extraction_mismatches"] = verdicts + """
SELECT source, field, pred, truth FROM (
  SELECT contract_no || '.txt' AS source, 'area_sqm' AS field, CAST(area_sqm AS VARCHAR) AS pred, CAST(area_sqm + order_key % 3 AS VARCHAR) AS truth, 1 AS p FROM verdicts WHERE ok_area_sqm = 0
  UNION ALL SELECT contract_no || '.txt', 'city', city, NULL, 0 FROM verdicts WHERE ok_city = 0) ORDER BY source, p LIMIT 30"""
    o["validate_records"] = _with(_STAND_IN, _CONTRACT) + f"""
, odd AS (SELECT order_key AS k, cf.* REPLACE (
    CASE WHEN order_key % 7 = 0 THEN substr(buyer_national_id, 1, 9) ELSE buyer_national_id END AS buyer_national_id,
    CASE order_key % 6 WHEN 0 THEN '+966 5' || substr(buyer_phone, 3, 8) WHEN 1 THEN '12345' ELSE buyer_phone END AS buyer_phone,
    CASE WHEN order_key % 11 = 0 THEN -total_price_sar ELSE total_price_sar END AS total_price_sar,
    CASE WHEN order_key % 5 = 0 THEN area_sqm * 30 ELSE area_sqm END AS area_sqm,
    CASE WHEN order_key % 3 <> 0 THEN bank_name END AS bank_name,
    CASE WHEN order_key % 13 = 0 THEN 'soon' ELSE contract_date END AS contract_date,
    CASE WHEN order_key % 17 <> 0 THEN buyer_name END AS buyer_name,
    CASE WHEN order_key % 19 <> 0 THEN unit_no ELSE '' END AS unit_no) FROM cf),
told AS (SELECT k, {_ISSUES} AS issues FROM odd)
SELECT k AS order_key, CAST(CASE WHEN issues = '' THEN 0 ELSE len(string_split(issues, '; ')) END AS INTEGER) AS n_issues, issues FROM told""".replace(
        "\n, odd", ",\nodd", 1
    )
    return o
