"""Domain inputs derived from the given tables, as SQL that Spark and DuckDB both read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tijolo.sources import landed_files

LISTINGS = """SELECT (((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 1000 + l_suppkey) * 100 + CAST(l_quantity AS BIGINT) AS id,
  CASE l_linenumber % 4 WHEN 0 THEN 'casas' WHEN 1 THEN 'apartamentos' WHEN 2 THEN 'terrenos' ELSE 'imoveis' END AS segment,
  (l_linenumber % 2) * 300000 AS min_price, CAST(l_orderkey % 400 AS INT) + 1 AS page,
  CASE l_partkey % 7 WHEN 0 THEN 'Apartamento ' WHEN 1 THEN 'Casa no ' WHEN 2 THEN 'SOBRADO ' WHEN 3 THEN 'Lote ' WHEN 4 THEN 'Terreno ' ELSE 'Sala ' END || p_name AS address,
  CASE WHEN l_suppkey % 13 = 0 THEN 'Sob consulta' ELSE 'R$ ' || CAST(CAST(floor(l_extendedprice / 1000) AS BIGINT) % 90 AS STRING) || '.' ||
    CASE l_linenumber % 2 WHEN 0 THEN '000 Cond. R$ 500' ELSE '500 IPTU R$ 90' END END AS price_text,
  CASE WHEN l_partkey % 11 = 0 THEN 'N/A' WHEN l_partkey % 11 = 1 THEN '1.200 m²' ELSE CAST(CAST(l_quantity AS BIGINT) AS STRING) || ' m²' END AS area_text,
  CAST(l_linenumber AS STRING) AS rooms_text, CASE WHEN l_suppkey % 5 = 0 THEN 'N/A' ELSE '2-3' END AS baths_text,
  CASE WHEN l_suppkey % 6 = 0 THEN ' ' WHEN l_suppkey % 6 = 1 THEN NULL ELSE '1' END AS parking_text
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey"""

SERIES = """SELECT 'A' AS source, o_orderpriority AS code, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE 'series ' || substr(o_orderpriority, 1, 1) END AS name,
  CAST(o_orderdate AS DATE) AS date, round(o_totalprice) AS value, 'R$' AS unit, 'M' AS frequency, o_orderkey AS seq, CAST(o_orderdate AS DATE) AS seen, o_orderkey % 2 = 0 AS is_batch FROM {orders}"""

PROGRESS = "SELECT DISTINCT c_nationkey AS segment, CAST(c_custkey % 40 AS INT) + 1 AS page FROM {customer}"
GRID = "SELECT n_nationkey AS segment, lower(n_name) AS slug FROM {nation}"
EMPTY = "SELECT s_nationkey AS segment, CAST(s_suppkey % 20 AS INT) + 20 AS page FROM {supplier} WHERE s_suppkey % 10 = 0"
#: Parts as clean listings: some without a kind, some of a kind named like all rows.
PARTS = """SELECT p_partkey, CASE p_partkey % 50 WHEN 0 THEN NULL WHEN 1 THEN 'Todos' ELSE p_type END AS p_type, p_retailprice, p_size FROM {part}"""
#: A catalogue over the series of three sources: active or not, how to resample, and codes to fall back on.
SERIES_OF_SOURCES = """SELECT CASE o_orderkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS source, substr(o_orderpriority, 1, 1) AS code, CAST(o_orderdate AS DATE) AS date,
  round(o_totalprice) AS value, o_orderkey AS seq FROM {orders} WHERE o_orderkey % 3 <> 1 OR substr(o_orderpriority, 1, 1) IN ('1', '2')"""
INGESTED = """SELECT DISTINCT s AS source, substr(o_orderpriority, 1, 1) AS code, 'name ' || substr(o_orderpriority, 1, 1) AS name, 'unit ' || s AS unit,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'mean' WHEN '2' THEN 'sum' ELSE 'last' END AS method, CASE substr(o_orderpriority, 1, 1) WHEN '4' THEN FALSE WHEN '1' THEN NULL ELSE TRUE END AS active,
  CASE substr(o_orderpriority, 1, 1) WHEN '3' THEN 'none' WHEN '5' THEN '1' END AS fallback FROM {orders}, (VALUES ('A'), ('B'), ('C')) v(s)"""
CATALOGUE = "SELECT DISTINCT o_orderpriority AS code, 'unit ' || substr(o_orderpriority, 1, 1) AS catalogue_unit, CASE substr(o_orderpriority, 1, 1) WHEN '4' THEN FALSE WHEN '1' THEN NULL ELSE TRUE END AS active FROM {orders}"
MONEY = """SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN '...' WHEN 1 THEN '-' WHEN 2 THEN '' WHEN 3 THEN 'null' WHEN 4 THEN CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) || ',5'
  WHEN 5 THEN '1.' || lpad(CAST(o_orderkey % 1000 AS STRING), 3, '0') || ',25' WHEN 6 THEN ' +' || CAST(o_orderkey % 100 AS STRING) || ',15%' WHEN 7 THEN '-0.' || CAST(o_orderkey % 90 + 10 AS STRING) ELSE 'x' || CAST(o_orderkey AS STRING) END AS cell FROM {orders}"""
DATES = """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, lpad(CAST(day(o_orderdate) AS STRING), 2, '0') AS dd, lpad(CAST(month(o_orderdate) AS STRING), 2, '0') AS mm, CAST(year(o_orderdate) AS STRING) AS yyyy FROM {orders}"""
MONTHLY_LEFT = "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_orderpriority AS series, round(o_totalprice) AS value FROM {orders}"
_RIGHT = "SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, '{n}' AS series, CAST({c} AS DOUBLE) AS value FROM {{lineitem}}"
MONTHLY_RIGHT = " UNION ALL ".join(_RIGHT.format(n=n, c=c) for n, c in (("quantity", "l_quantity"), ("price", "l_extendedprice"), ("discount", "l_discount"), ("tax", "l_tax"), ("constant", "1")))


def load(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    names = set(re.findall(r"\{(\w+)\}", sql))
    return spark.sql(sql, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})


def duck(sql: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", sql)


#: Orders as elements of landed responses: one response a priority and year, of which some are cut off or hold an error.
LANDED = """SELECT o_orderkey, 't/' || substr(o_orderpriority, 1, 1) || '/p ' || CAST(year(o_orderdate) AS STRING) AS path, CAST(o_orderdate AS DATE) AS d, CAST(year(o_orderdate) AS STRING) AS yyyy,
  lpad(CAST(month(o_orderdate) AS STRING), 2, '0') AS mm, lpad(CAST(day(o_orderdate) AS STRING), 2, '0') AS dd, lower(o_orderpriority) AS label,
  CASE WHEN year(o_orderdate) = 1994 THEN 'not json' WHEN year(o_orderdate) = 1995 AND substr(o_orderpriority, 1, 1) = '4' THEN 'no list' END AS broken,
  CASE WHEN o_orderkey % 13 = 0 THEN 'no object' WHEN o_orderkey % 11 = 0 THEN 'no date' WHEN o_orderkey % 4 = 0 THEN 'no value' END AS reason FROM {orders}"""
#: An element of each source's lists, and what stands around a list.
ELEMENTS = {
    "A": ("""CASE reason WHEN 'no object' THEN '7' ELSE '{"data":"' || CASE WHEN reason = 'no date' THEN '31/13/' ELSE dd || '/' || mm || '/' END || yyyy || '","valor":"' || CASE WHEN reason = 'no value' THEN '...' ELSE CAST(o_orderkey AS STRING) || ',5' END || '"}' END""", "[", "]"),
    "B": ("""CASE reason WHEN 'no object' THEN '"x"' ELSE '{"D1C":"4099","D1N":"Construção ' || label || '","D2C":"' || CASE WHEN reason = 'no date' THEN 'x' ELSE yyyy || mm END || '","D3C":"2001","V":"' || CASE WHEN reason = 'no value' THEN '-' ELSE CAST(o_orderkey AS STRING) END || '"}' END""", "[", "]"),
    "C": ("""CASE reason WHEN 'no object' THEN 'null' ELSE '{"SERCODIGO":"X","VALDATA":"' || CASE WHEN reason = 'no date' THEN '' ELSE yyyy || '-' || mm || '-' || dd || 'T00:00:00-03:00' END || '","VALVALOR":' || CASE WHEN reason = 'no value' THEN 'null' WHEN o_orderkey % 3 = 0 THEN '"' || CAST(o_orderkey AS STRING) || ',5"' ELSE CAST(o_orderkey AS STRING) || '.5' END || '}' END""", '{"value":[', "]}"),
}
#: Series that responses of source B hold: candidates are a response that is cut off, one that holds other names, and one that works.
CATALOGUE_B = """SELECT 'B' AS source, 'S' || CAST(k AS STRING) AS code, 'series ' || CAST(k AS STRING) AS name, 'R$' AS unit, CASE k WHEN 2 THEN FALSE WHEN 3 THEN NULL ELSE TRUE END AS active, CASE k WHEN 1 THEN 'Q' END AS frequency,
  CASE k WHEN 1 THEN 'V' END AS value_key, array(
    named_struct('path', 't/' || CAST(k AS STRING) || '/p 1994', 'keywords', CAST(NULL AS array<string>), 'period_key', CAST(NULL AS string)), named_struct('path', 't/' || CAST(k AS STRING) || '/p 1996', 'keywords', array('construção', 'no such word'), 'period_key', CAST(NULL AS string)),
    named_struct('path', 't/' || CAST(k AS STRING) || '/p 1997', 'keywords', array('CONSTRUÇÃO', '-'), 'period_key', CASE WHEN k = 5 THEN 'D3C' END), named_struct('path', 't/' || CAST(k AS STRING) || '/p 1996', 'keywords', CAST(array() AS array<string>), 'period_key', CAST(NULL AS string))) AS candidates
  FROM (SELECT DISTINCT CAST(substr(o_orderpriority, 1, 1) AS INT) AS k FROM {orders})"""


def landed(spark: SparkSession, sf_dir: str, source: str, root: str) -> None:
    """Write the responses of a source below root, a line an element, so that no response is put together in memory."""
    element, head, tail = ELEMENTS[source]
    rows = load(spark, sf_dir, LANDED).select(F.coalesce("path", F.lit("")).alias("path"), "broken", "o_orderkey", F.expr(element).alias("e")).repartition("path")
    order = Window.partitionBy("path").orderBy("o_orderkey")
    placed = rows.withColumns({"first": F.row_number().over(order) == 1, "last": F.lead("e").over(order).isNull()})
    line = F.concat(F.when(F.col("first"), head).otherwise(","), "e", F.when(F.col("last"), tail).otherwise(""))
    cut = F.when((F.col("broken") == "not json") & F.col("last"), F.left(line, F.length(line) - 2)).otherwise(line)
    body = F.when(F.col("broken") == "no list", '{"error":"none"}').otherwise(cut)
    lines = placed.where(F.col("first") | ~F.col("broken").eqNullSafe("no list"))
    landed_files.land_lines(lines.select("path", body.alias("body")), root)
