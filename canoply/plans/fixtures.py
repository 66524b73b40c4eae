"""Inputs derived from the driver's tables, written once and rendered for both SQL dialects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: A canopy height model from customer: every customer is a cone, a cell takes the highest cone over it.
#: Heights are whole millimetres; $DIV and $SEQ are the dialects' integer division and offsets.
CHM = """
SELECT r0 + dr AS row, c0 + dc AS col,
       CAST(max(h - (4 * h * (dr * dr + dc * dc)) $DIV (5 * rad * rad)) AS BIGINT) AS z
FROM (
  SELECT r0, c0, h, n, 2 + h $DIV 9000 AS rad FROM (
    SELECT (((c_custkey * 2654435761) % 4294967296) $DIV 7) % n AS c0,
           (((c_custkey * 2246822519) % 4294967296) $DIV 11) % n AS r0,
           5000 + CAST(floor((c_acctbal + 1000) * 2) AS BIGINT) AS h, n
    FROM customer CROSS JOIN (SELECT CAST(ceil(sqrt(count(*) * 44.0)) AS BIGINT) AS n FROM customer) g) t) t2
CROSS JOIN (SELECT a.v AS dr, b.v AS dc FROM (SELECT $SEQ AS v) a CROSS JOIN (SELECT $SEQ AS v) b) o
WHERE dr * dr + dc * dc <= rad * rad AND r0 + dr BETWEEN 0 AND n - 1 AND c0 + dc BETWEEN 0 AND n - 1
GROUP BY 1, 2
"""

#: Settings lines from customer: repeated keys, values with further colons, numbers with tails, blanks.
LINES = """
SELECT CAST(floor(c_custkey / 50) AS BIGINT) AS file, c_custkey AS line_no, CASE c_custkey % 8
    WHEN 0 THEN concat('int', c_custkey % 40, ':', c_custkey, 'px')
    WHEN 1 THEN concat('int', c_custkey % 40, ': -', c_custkey)
    WHEN 2 THEN concat('num', c_custkey % 40, ':', CAST(c_custkey AS VARCHAR(20)), '.5e1x')
    WHEN 3 THEN concat('flag', c_custkey % 40, ':', CASE c_custkey % 3 WHEN 0 THEN 'true' WHEN 1 THEN '1' ELSE 'no' END)
    WHEN 4 THEN concat('path', c_custkey % 40, ':/data/', c_name, ':x/', c_mktsegment, '.tif')
    WHEN 5 THEN concat('text', c_custkey % 40, ':')
    WHEN 6 THEN concat('no separator ', c_name)
    ELSE concat('num', c_custkey % 40, ':-', CAST(c_custkey AS VARCHAR(20)), '.25') END AS value
FROM customer
"""

#: Threshold lists in text, of two (tops) or three (crowns) numbers a record; some are not valid.
LISTS = """
SELECT c_custkey AS id,
  concat(c_custkey % 9, ',', 3 + c_custkey % 4, ',', 5 + c_custkey % 20, ',', 5 + 2 * (c_custkey % 3)) AS tops,
  concat(c_custkey % 7, ',0.', c_custkey % 10, ',', 1 + c_custkey % 5, ',', 6 + c_custkey % 9, ',0.5,', c_custkey % 6) AS crowns
FROM customer
"""

#: Progress events; a run is a user.
PROGRESS = """
SELECT user_id AS run, event_id AS seq, CASE WHEN event_id % 4 = 0 THEN -1.0e0 ELSE CAST(event_id % 1001 AS DOUBLE) / 1000 END AS status,
  CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END AS message FROM events
"""

#: Paths, with repeats and all kinds of endings.
FILES = """
SELECT concat('/data/', c_mktsegment, '/f', c_custkey % 200, CASE c_custkey % 6 WHEN 0 THEN '.tif' WHEN 1 THEN '.shp' WHEN 2 THEN '.sqlite' WHEN 3 THEN '.tiff' WHEN 4 THEN '.dat' ELSE '.txt' END) AS path,
  c_custkey AS id FROM customer
"""


def spark_sql(text: str) -> str:
    return text.replace("$DIV", "div").replace("$SEQ", "explode(sequence(-5L, 5L))")


def duck_sql(text: str) -> str:
    return text.replace("$DIV", "//").replace("$SEQ", "unnest(range(-5, 6))::BIGINT")


def rows(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """text over the tables in sf_dir."""
    named = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "events") if t in text}
    for t in named:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(spark_sql(text), **named)


def chm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir, CHM)
