"""Shared CTE text for the DuckDB oracle queries (hand-written SQL)."""

DOC_FILES = r"""
doc_files AS (
  SELECT source AS repo,
         lang || '/' || source || '/' || lower(regexp_extract(text, '^\p{L}+')) || '_' || CAST(doc_id AS VARCHAR) AS path,
         text AS content, doc_id
  FROM documents
)"""

# Lines of the document corpus. Documents contain only '\n' breaks, so a split
# on chr(10) minus the empty tail equals str.splitlines().
DOC_LINES = DOC_FILES + r""",
doc_parts AS (
  SELECT repo, path, string_split(content, chr(10)) AS arr FROM doc_files
),
doc_trim AS (
  SELECT repo, path, CASE WHEN arr[-1] = '' THEN arr[1:len(arr) - 1] ELSE arr END AS arr FROM doc_parts
),
doc_lines AS (
  SELECT repo, path, CAST(generate_subscripts(arr, 1) AS INTEGER) AS line_no, unnest(arr) AS line
  FROM doc_trim
)"""

PY_LSTRIP = r"regexp_replace({x}, '^[\t\n\x0B\x0C\r\x1C-\x1F \x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+', '')"


def lstrip(x: str) -> str:
    return PY_LSTRIP.format(x=x)


# Words of each document line, ordered by (line, position).
DOC_WORDS = DOC_LINES + r""",
doc_word_lists AS (
  SELECT repo, path, line_no, regexp_extract_all(line, '[\p{L}\p{N}_]+') AS ws FROM doc_lines
),
doc_words AS (
  SELECT repo, path, line_no AS line,
         [CAST(line_no AS BIGINT), pos] AS seq, name
  FROM (SELECT *, generate_subscripts(ws, 1) AS pos, unnest(ws) AS name FROM doc_word_lists)
)"""

DOC_MODULES = DOC_FILES + r""",
doc_modules AS (
  SELECT f.repo, f.path,
         CAST(len(CASE WHEN string_split(f.content, chr(10))[-1] = ''
                       THEN string_split(f.content, chr(10))[1:len(string_split(f.content, chr(10))) - 1]
                       ELSE string_split(f.content, chr(10)) END) AS INTEGER) AS n_lines,
         CAST(l.quality AS VARCHAR) AS docstring
  FROM doc_files f LEFT JOIN labels l ON f.doc_id = l.doc_id
)"""

ORDER_PATH = "o_orderstatus || '/' || CAST(o_orderkey AS VARCHAR) || '.py'"

ORDER_ITEMS = f"""
order_items AS (
  SELECT o.o_orderpriority AS repo, {ORDER_PATH} AS path,
         'L' || CAST(l.l_linenumber AS VARCHAR) || '_' || CAST(l.l_partkey AS VARCHAR) || '_' || CAST(l.l_suppkey AS VARCHAR) AS name,
         CAST(l.l_linenumber AS INTEGER) AS line,
         CAST(l.l_quantity AS INTEGER) AS complexity,
         l.l_linestatus, l.l_partkey, l.l_suppkey
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
),
order_modules AS (
  SELECT o_orderpriority AS repo, {ORDER_PATH} AS path,
         CAST(floor(o_totalprice / 1000) AS INTEGER) AS n_lines
  FROM orders
)"""

# Path-parts order key: '/' replaced by chr(1).
def pkey(x: str) -> str:
    return f"replace({x}, '/', chr(1))"


SUCCESSION = r"""
sreg AS (
  SELECT DISTINCT 'o' || CAST(l.l_orderkey AS VARCHAR) AS repo, s.s_suppkey, s.s_name, s.s_acctbal,
         ['tests', 'utils', 'models', 'views', 'services', 'lib/__init__', 'core'][s.s_nationkey % 7 + 1] AS folder
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
),
edges AS (
  SELECT DISTINCT 'o' || CAST(l_orderkey AS VARCHAR) AS repo, 's' || CAST(src AS VARCHAR) AS src,
         's' || CAST(dst AS VARCHAR) AS dst
  FROM (SELECT l_orderkey, l_suppkey AS src,
               lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) AS dst
        FROM lineitem) WHERE dst IS NOT NULL
),
snodes AS (
  SELECT repo, 's' || CAST(s_suppkey AS VARCHAR) AS id, folder || '/' || s_name || '.py' AS path
  FROM sreg
)"""

CUSTOMER = r"""
cfiles AS (
  SELECT 'nation' || CAST(c_nationkey AS VARCHAR) AS repo,
         lower(c_mktsegment) || '/' || c_name || '.py' AS path, c_custkey
  FROM customer
),
cov_rows AS (
  SELECT f.repo, f.path AS filename, CAST(e.event_id AS INTEGER) AS line_no,
         CAST(CASE WHEN e.event_type IN ('purchase', 'signup') THEN 1 ELSE 0 END AS BIGINT) AS hits
  FROM events e JOIN cfiles f ON e.user_id = f.c_custkey
),
cblocks AS (
  SELECT f.repo, f.path, 'order_' || CAST(o.o_orderkey AS VARCHAR) AS name,
         CAST(o.o_orderkey AS INTEGER) AS line, CAST(coalesce(li.n_items, 0) AS INTEGER) AS complexity
  FROM orders o
  LEFT JOIN (SELECT l_orderkey, count(*) AS n_items FROM lineitem GROUP BY l_orderkey) li
         ON o.o_orderkey = li.l_orderkey
  JOIN cfiles f ON o.o_custkey = f.c_custkey
)"""
