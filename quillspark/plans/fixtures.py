"""An element relation derived from `documents`, in SQL that Spark and DuckDB both run.

Natural prose hardly ever needs a repair, so each line becomes an element whose
content is one of 24 forms, by arithmetic on its ids: whole lines, or short
texts of which many hold the line's first word.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SPARK_LINES = "SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, line FROM documents LATERAL VIEW posexplode(split(text, '\\n')) t AS line_no, line"
DUCK_LINES = "SELECT doc_id, i - 1 AS line_no, a[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents) q, unnest(range(1, len(a) + 1)) t(i)"

_TEXTS = """
SELECT doc_id, page_no, idx AS elem_idx, 'text' AS type, content, x1, y1,
  CASE WHEN x1 IN (100, 950) THEN x1 + 18 ELSE x1 + least(8 * length(content) + 4, 500) END AS x2, y1 + 14 + g % 4 AS y2, confidence, source_model, g
FROM (SELECT doc_id, CAST(floor(line_no / 25) AS BIGINT) + 1 AS page_no, line_no % 25 AS idx, g,
 CASE WHEN doc_id % 7 = 0 AND (line_no % 25) % 3 = 2 THEN CAST(g % 100 AS STRING) ELSE CASE g % 24
  WHEN 0 THEN concat('Name:      ', w) WHEN 1 THEN concat('Dept ________ ', w, ' _ _ _ _')
  WHEN 2 THEN concat('FAX: ', a, '-555-', b) WHEN 3 THEN concat('Call (', a, ') 555-', b, ' or ', a, '/545-', b)
  WHEN 4 THEN concat('Date ', m, '/', dd, '/1998') WHEN 5 THEN concat('Due ', m, '-', dd, '-98 ', w)
  WHEN 6 THEN concat('<b>', w, '</b>  “quoted” – text…') WHEN 7 THEN concat('Total 14.00 ', w)
  WHEN 8 THEN concat('Factor -', CAST(10 + g % 80 AS STRING), ' applied') WHEN 9 THEN concat('MENT-', CAST(100 + g % 800 AS STRING))
  WHEN 10 THEN 'BRANDS) listed' WHEN 11 THEN concat(w, ' ', w, ' again.')
  WHEN 12 THEN concat('RECEIVED BY: John Smith DATE: ', m) WHEN 13 THEN CAST(g % 100 AS STRING)
  WHEN 14 THEN '///' WHEN 15 THEN 'x' WHEN 16 THEN '1998' WHEN 17 THEN 'Company Inc.'
  WHEN 18 THEN '12345-6789' WHEN 19 THEN 'DEPARTMENT .' ELSE line END END AS content,
 CAST(CASE WHEN doc_id % 7 = 0 AND (line_no % 25) % 3 = 2 THEN 100 WHEN g % 29 = 0 THEN 950 ELSE 40 + ((g * 7) % 5) * 110 END AS DOUBLE) AS x1,
 CAST(30 + (line_no % 25) * 24 + g % 3 AS DOUBLE) AS y1, CAST((g * 37) % 101 AS DOUBLE) / 100 AS confidence,
 CASE WHEN (g + doc_id) % 3 = 0 OR doc_id % 11 = 0 THEN 'trocr' ELSE 'surya' END AS source_model
FROM (SELECT doc_id, line_no, line, doc_id * 31 + line_no * 17 AS g, split_part(concat(line, ' word'), ' ', 1) AS w,
  CAST(200 + (doc_id * 7 + line_no) % 700 AS STRING) AS a, CAST(1000 + (doc_id * 13 + line_no * 3) % 9000 AS STRING) AS b,
  CAST((doc_id + line_no) % 14 AS STRING) AS m, CAST((doc_id * 3 + line_no) % 33 AS STRING) AS dd FROM lines) q1) q2
"""


#: k, type, which documents, box and confidence of the elements besides text.
_KINDS = (
    ("table", "doc_id % 4 = 0", (30, 20, 600, 300), "0.97"),
    ("table", "doc_id % 10 = 0", (900, 900, 990, 990), "0.80"),
    ("layout_region", "doc_id % 6 = 0", (30, 30, 500, 400), "0.90"),
    ("layout_region", "doc_id % 6 = 0", (30.001, 30, 500, 400), "0.90"),
    ("signature", "doc_id % 5 = 0", (30, 180, 400, 300), "NULL"),
    ("logo", "doc_id % 9 = 0", (0, 0, 100, 40), "NULL"),
)


def _case(values: list) -> str:
    return "CASE k " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


_CORNERS = ", ".join(f"CAST({_case([box[i] for _, _, box, _ in _KINDS])} AS DOUBLE) AS {n}" for i, n in enumerate(("x1", "y1", "x2", "y2")))
_MARKS = (
    f"SELECT doc_id, page_no, CAST(100 + k AS BIGINT) AS elem_idx, {_case([repr(t) for t, *_ in _KINDS])} AS type, CAST(NULL AS STRING) AS content, {_CORNERS}, "
    f"CAST({_case([c for *_, c in _KINDS])} AS DOUBLE) AS confidence, CAST(NULL AS STRING) AS source_model, doc_id AS g FROM slots WHERE {_case([w for _, w, _, _ in _KINDS])}"
)
SPARK_SLOTS = "SELECT doc_id, page_no, k FROM pages0 LATERAL VIEW explode(sequence(0, 5)) t AS k"
DUCK_SLOTS = "SELECT doc_id, page_no, k FROM pages0, unnest(range(6)) t(k)"


def ctes(lines: str, slots: str) -> str:
    """The CTEs lines, texts, pages0, slots and elements."""
    return f"lines AS ({lines}), texts AS ({_TEXTS}), pages0 AS (SELECT DISTINCT doc_id, page_no FROM texts), slots AS ({slots}), elements AS (SELECT * FROM texts UNION ALL {_MARKS})"


DUCK = ctes(DUCK_LINES, DUCK_SLOTS)


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    sql = f"WITH documents AS (SELECT * FROM {{docs}}), {ctes(SPARK_LINES, SPARK_SLOTS)} SELECT * FROM elements"
    return spark.sql(sql, docs=docs)


#: A grid of eight rows and four columns for the table at (30, 20, 600, 300), its first row a header.
GRID_ROWS = [(32.0, 24.0 + 35 * i, 598.0, 57.0 + 35 * i) for i in range(8)]
GRID_COLUMNS = [(32.0 + 142 * j, 24.0, 170.0 + 142 * j, 302.0) for j in range(4)]
