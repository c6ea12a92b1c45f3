"""Queries over the domain operators, and the SQL that DuckDB checks them by."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tijolo.functions import text as T
from tijolo.operators import coverage, listings, pages, series, stats
from tijolo.plans import fixtures as X
from tijolo.sources import landed_files, landed_json, scratch, sinks, wide_index

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_L, _S = X.duck(X.LISTINGS), X.duck(X.SERIES)
_KIND = """CASE WHEN lower(address) LIKE '%apartamento%' THEN 'Apartamento'
  WHEN lower(address) LIKE '%casa%' OR lower(address) LIKE '%sobrado%' THEN 'Casa'
  WHEN lower(address) LIKE '%terreno%' OR lower(address) LIKE '%lote%' THEN 'Terreno' ELSE 'Outro' END"""
_NUM = "CASE WHEN trim({0}) <> 'N/A' THEN TRY_CAST(nullif(regexp_extract(replace({0}, '.', ''), '[0-9]+'), '') AS DOUBLE) END"
_PRICE = "TRY_CAST(nullif(regexp_replace(split_part(split_part(price_text, 'Cond', 1), 'IPTU', 1), '[^0-9]', '', 'g'), '') AS DOUBLE)"
_TYPED = f"SELECT id, address, {_PRICE} AS price, {_NUM.format('area_text')} AS area, " + ", ".join(f"CAST({_NUM.format(c + '_text')} AS INT) AS {c}" for c in ("rooms", "baths", "parking")) + f" FROM ({_L})"
_CLEAN = f"""SELECT address, price, area, id, rooms, baths, parking, {_KIND} AS kind, round_even(price / area, 2) AS unit_price FROM (SELECT *, row_number() OVER
  (PARTITION BY address, price, area ORDER BY id) AS rn FROM ({_TYPED}) WHERE price IS NOT NULL AND area > 0) WHERE rn = 1"""
_MISSING = "({0} IS NULL OR trim({0}) = '' OR {0} = 'N/A')"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.load(spark, sf_dir, X.LISTINGS)


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings.clean(raw(spark, sf_dir))


def part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.load(spark, sf_dir, X.PARTS)


# --- listings

query("scan_raw", _L)(raw)
query("clean_price", f"SELECT id, price_text, {_PRICE} AS price FROM ({_L})")(
    lambda s, d: raw(s, d).select("id", "price_text", T.clean_price(F.col("price_text")).alias("price")))
query("extract_number", f"SELECT id, area_text, {_NUM.format('area_text')} AS area, {_NUM.format('baths_text')} AS baths FROM ({_L})")(
    lambda s, d: raw(s, d).select("id", "area_text", T.extract_number(F.col("area_text")).alias("area"), T.extract_number(F.col("baths_text")).alias("baths")))
query("classify_type", f"SELECT id, address, {_KIND} AS kind FROM ({_L})")(
    lambda s, d: raw(s, d).select("id", "address", T.classify_kind(F.col("address")).alias("kind")))
query("clean_listings", _CLEAN)(clean)
query("dedup_first", f"""SELECT address, price, area, id, rooms FROM (SELECT *, row_number() OVER (PARTITION BY address, price, area ORDER BY id) AS rn
  FROM ({_TYPED})) WHERE rn = 1""")(
    lambda s, d: listings.dedup_first(listings.typed(raw(s, d)).select("id", "address", "price", "area", "rooms"), listings.KEY, "id"))
query("clean_audit", f"""SELECT CAST(sum(n) AS BIGINT) AS rows_read, CAST(sum(n - 1) AS BIGINT) AS rows_repeated, count(*) FILTER (NOT ok) AS rows_invalid, count(*) FILTER (ok) AS rows_kept
  FROM (SELECT count(*) AS n, price IS NOT NULL AND coalesce(area > 0, FALSE) AS ok FROM ({_TYPED}) GROUP BY address, price, area)""")(
    lambda s, d: listings.audit(raw(s, d)))

# --- statistics

_PARTS = X.duck(X.PARTS)
_DESC = f"""SELECT {{3}} AS kind, '{{0}}' AS field, '{{1}}' AS unit, count({{2}}) AS n, round_even(avg({{2}}), 2) AS mean,
  round_even(median({{2}}), 2) AS median, round_even(stddev_samp({{2}}), 2) AS stddev FROM ({_PARTS})"""
_DESCRIBED = " UNION ALL ".join(
    _DESC.format(*f, "'Todos'") + " UNION ALL " + _DESC.format(*f, "p_type") + " WHERE p_type <> 'Todos' GROUP BY p_type" for f in (("price", "R$", "p_retailprice"), ("size", "m²", "p_size")))
_TRIM = f"(SELECT * FROM ({_PARTS}) WHERE p_retailprice < (SELECT quantile_cont(p_retailprice, 0.95) FROM part))"


def described(s: SparkSession, d: str) -> DataFrame:
    return stats.describe_by_kind(part(s, d).select("p_type", F.col("p_retailprice").alias("price"), F.col("p_size").cast("double").alias("size")), "p_type", {"price": "R$", "size": "m²"})


def trimmed(s: SparkSession, d: str) -> DataFrame:
    return stats.below_quantile(part(s, d), ["p_retailprice"])


query("describe_by_type", _DESCRIBED)(described)
query("chart_bars", f"""SELECT kind, max(mean) FILTER (field = 'price') AS price, max(mean) FILTER (field = 'size') AS size FROM ({_DESCRIBED})
  GROUP BY kind""")(lambda s, d: stats.bars(described(s, d), ["price", "size"]))
query("chart_share", f"""SELECT p_type AS kind, count(*) AS n, round(CAST(100.0 AS DOUBLE) * count(*) / sum(count(*)) OVER (), 1) AS percent
  FROM ({_PARTS}) WHERE p_type IS NOT NULL GROUP BY p_type""")(lambda s, d: stats.share(part(s, d), "p_type"))
query("quantile_trim", "SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice < (SELECT quantile_cont(p_retailprice, 0.95) FROM part)")(
    lambda s, d: trimmed(s, d).select("p_partkey", "p_retailprice"))
query("quantile_trim2", f"""SELECT p_partkey, p_type, p_retailprice, p_size FROM ({_PARTS}) WHERE p_retailprice < (SELECT quantile_cont(p_retailprice, 0.95)
  FROM part) AND p_size < (SELECT quantile_cont(p_size, 0.95) FROM part)""")(
    lambda s, d: stats.below_quantile(part(s, d).select("p_partkey", "p_type", "p_retailprice", "p_size"), ["p_retailprice", "p_size"]))
_FENCES = f"""WITH t AS {_TRIM}, q AS (SELECT p_type, quantile_cont(p_retailprice, 0.25) AS a, quantile_cont(p_retailprice, 0.5) AS b, quantile_cont(p_retailprice, 0.75) AS c FROM t GROUP BY p_type),
  f AS (SELECT t.*, a, b, c, p_retailprice BETWEEN a - 1.5 * (c - a) AND c + 1.5 * (c - a) AS inside FROM t JOIN q USING (p_type))"""
query("chart_box", f"""{_FENCES} SELECT p_type AS kind, round(a, 6) AS q1, round(b, 6) AS median, round(c, 6) AS q3, min(p_retailprice) FILTER (inside) AS low,
  max(p_retailprice) FILTER (inside) AS high, count(*) FILTER (NOT inside) AS outliers FROM f GROUP BY p_type, a, b, c""")(
    lambda s, d: stats.box(trimmed(s, d), "p_type", "p_retailprice"))
# sizes stand out by their square, prices hardly
query("chart_outliers", f"""WITH t AS (SELECT p_partkey, p_type, CAST(p_size AS DOUBLE) * p_size * p_size AS cube FROM ({_PARTS})), q AS (SELECT p_type, quantile_cont(cube, 0.25) AS a, quantile_cont(cube, 0.75) AS c FROM t GROUP BY p_type)
  SELECT t.* FROM t JOIN q USING (p_type) WHERE cube NOT BETWEEN a - 1.5 * (c - a) AND c + 1.5 * (c - a)""")(
    lambda s, d: stats.outliers(part(s, d).select("p_partkey", "p_type", F.expr("CAST(p_size AS DOUBLE) * p_size * p_size").alias("cube")), "p_type", "cube"))
query("chart_histogram", f"""WITH t AS {_TRIM}, e AS (SELECT min(p_size) AS lo, max(p_size) AS hi FROM t), n AS (SELECT CAST(least(floor((p_size - lo) / (CAST(hi - lo AS DOUBLE) / 30)), 29) AS BIGINT) AS bin, count(*) AS n FROM t, e GROUP BY 1)
  SELECT bin, coalesce(n, 0) AS n FROM (SELECT unnest(range(30)) AS bin) LEFT JOIN n USING (bin)""")(lambda s, d: stats.histogram(trimmed(s, d), "p_size"))

# --- coverage and quality

query("sql_coverage", """SELECT l_orderkey, count(*) AS n, min(l_linenumber) AS first_page, max(l_linenumber) AS last_page, count(DISTINCT l_linenumber) AS pages,
  CASE WHEN min(l_linenumber) = 1 AND max(l_linenumber) = count(DISTINCT l_linenumber) THEN 'contiguous' ELSE 'with gaps' END AS status FROM lineitem GROUP BY l_orderkey""")(
    lambda s, d: coverage.page_coverage(s.read.parquet(f"{d}/lineitem.parquet"), ["l_orderkey"], "l_linenumber"))
query("sql_gap_pages", """SELECT l_orderkey, p AS l_linenumber FROM (SELECT l_orderkey, CAST(unnest(range(1, max(l_linenumber) + 1)) AS INT) AS p FROM lineitem GROUP BY l_orderkey) g
  WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = g.l_orderkey AND l.l_linenumber = g.p)""")(
    lambda s, d: coverage.gap_pages(s.read.parquet(f"{d}/lineitem.parquet"), ["l_orderkey"], "l_linenumber"))
query("sql_page_density", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 ORDER BY n DESC, l_orderkey, l_linenumber LIMIT 30")(
    lambda s, d: s.read.parquet(f"{d}/lineitem.parquet").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "l_orderkey", "l_linenumber").limit(30))
query("sql_count_by_segment", f"SELECT segment, count(*) AS n FROM ({_L}) GROUP BY segment")(
    lambda s, d: raw(s, d).groupBy("segment").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "segment"))
_FIELDS = ["price_text", "area_text", "baths_text", "parking_text"]
query("sql_missing", f"SELECT count(*) AS n, {', '.join(f'count(*) FILTER ({_MISSING.format(c)}) AS {c}_missing' for c in _FIELDS)} FROM ({_L})")(
    lambda s, d: coverage.missing_counts(raw(s, d), _FIELDS))
query("sql_fill_rate", f"""SELECT segment,
  {', '.join(f'round(CAST(100.0 AS DOUBLE) * count(*) FILTER (NOT {_MISSING.format(c)}) / count(*), 2) AS {c}_filled' for c in _FIELDS)}
  FROM ({_L}) GROUP BY segment""")(
    lambda s, d: coverage.fill_rate(raw(s, d), "segment", _FIELDS))
query("sql_dup_estimate", f"""SELECT count(*) AS n, count(DISTINCT address || '|' || price_text || '|' || area_text) AS different,
  count(*) - count(DISTINCT address || '|' || price_text || '|' || area_text) AS repeated FROM ({_L})""")(
    lambda s, d: raw(s, d).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.expr("address || '|' || price_text || '|' || area_text")).alias("different")).withColumn("repeated", F.col("n") - F.col("different")))
# estimates, which SQL does not give: sketches of segments are stored and merged; tests hold them against the exact query
query("sql_dup_sketch")(
    lambda s, d: coverage.merge_sketches(scratch.written(coverage.distinct_sketches(raw(s, d), ["segment"], F.expr("address || '|' || price_text || '|' || area_text")), "sketches")))
query("sql_text_match", "SELECT lang, source, count(*) AS n FROM documents WHERE lower(text) LIKE '%tion%' OR lower(text) LIKE '%keit%' GROUP BY lang, source")(
    lambda s, d: s.read.parquet(f"{d}/documents.parquet").where(F.lower("text").like("%tion%") | F.lower("text").like("%keit%")).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n")))
query("sql_text_sample", "SELECT doc_id, lang, source FROM documents WHERE lower(text) LIKE '%tion%' ORDER BY doc_id LIMIT 50")(
    lambda s, d: s.read.parquet(f"{d}/documents.parquet").where(F.lower("text").like("%tion%")).select("doc_id", "lang", "source").orderBy("doc_id").limit(50))
query("sql_clean_quality", f"""SELECT count(*) AS n, count(*) FILTER (price IS NULL) AS no_price, count(*) FILTER (area IS NULL) AS no_area,
  count(*) FILTER (baths IS NULL) AS no_baths, count(*) FILTER (parking IS NULL) AS no_parking FROM ({_CLEAN})""")(
    lambda s, d: clean(s, d).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"no_{c}") for c in ("price", "area", "baths", "parking")]))
query("sql_price_bands", f"""SELECT count(*) FILTER (unit_price < 500) AS low, count(*) FILTER (unit_price BETWEEN 500 AND 30000) AS middle,
  count(*) FILTER (unit_price > 30000) AS high FROM ({_CLEAN})""")(
    lambda s, d: clean(s, d).agg(F.count_if(F.col("unit_price") < 500).alias("low"), F.count_if(F.col("unit_price").between(500, 30000)).alias("middle"), F.count_if(F.col("unit_price") > 30000).alias("high")))
query("sql_type_distribution", f"SELECT kind, count(*) AS n, round(avg(unit_price), 2) AS mean_unit_price FROM ({_CLEAN}) GROUP BY kind")(
    lambda s, d: clean(s, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("unit_price"), 2).alias("mean_unit_price")))
query("row_counts", f"""SELECT 'raw' AS name, (SELECT count(*) FROM ({_L})) AS n UNION ALL SELECT 'clean', (SELECT count(*) FROM ({_CLEAN}))
  UNION ALL SELECT 'series', (SELECT count(*) FROM orders)""")(
    lambda s, d: raw(s, d).agg(F.lit("raw").alias("name"), F.count(F.lit(1)).alias("n")).unionByName(clean(s, d).agg(F.lit("clean").alias("name"), F.count(F.lit(1)).alias("n"))).unionByName(
        s.read.parquet(f"{d}/orders.parquet").agg(F.lit("series").alias("name"), F.count(F.lit(1)).alias("n"))))
query("crawl_frontier", f"""SELECT g.segment, CAST(p AS INT) AS page, 'https://listings.example/' || slug || '?page=' || p AS url FROM ({X.duck(X.GRID)}) g, range(1, 401) r(p)
  LEFT JOIN (SELECT segment AS es, min(page) AS e FROM ({X.duck(X.EMPTY)}) GROUP BY 1) ON es = g.segment WHERE (e IS NULL OR p < e) AND NOT EXISTS (SELECT 1 FROM ({X.duck(X.PROGRESS)}) q WHERE q.segment = g.segment AND q.page = p)""")(
    lambda s, d: coverage.frontier(X.load(s, d, X.GRID), X.load(s, d, X.PROGRESS), X.load(s, d, X.EMPTY)))
query("insert_if_absent", f"SELECT segment, page FROM ({X.duck(X.PROGRESS)}) UNION SELECT s_nationkey, CAST(s_suppkey % 60 AS INT) + 1 FROM supplier")(
    lambda s, d: series.insert_if_absent(X.load(s, d, X.PROGRESS), X.load(s, d, "SELECT s_nationkey AS segment, CAST(s_suppkey % 60 AS INT) + 1 AS page FROM {supplier}"), ["segment", "page"]))
_CARD = '<li><a href="{}">{}</a>'
query("extract_cards", f"""SELECT page_id, CAST(unnest(range(len(l))) AS INTEGER) AS position, unnest(t) AS price, unnest(l) AS link FROM
  (SELECT page_id, regexp_extract_all(html, '{_CARD.format('([^"]*)', '[^<]*')}', 1) AS l, regexp_extract_all(html, '{_CARD.format('[^"]*', '([^<]*)')}', 1) AS t FROM pages)""")(
    lambda s, d: pages.extract_cards(s.read.parquet(f"{d}/pages.parquet")))

#: Listings as pages of cards with six fields; every fifth card lies inside the one before it, and some are never closed.
_PAGES = f"""SELECT * FROM ({X.LISTINGS}) WHERE segment = 'casas'"""


def _listing_pages(s: SparkSession, d: str) -> DataFrame:
    field = lambda name, c, tag: F.when(F.trim(F.coalesce(c, F.lit(""))) == "", "").otherwise(F.concat(F.lit(f'<{tag} data-field="{name}">'), F.col(c), F.lit(f"</{tag}>")))
    inside, named = F.col("id") % 5 == 0, (("price", "price_text", "p"), ("address", "address", "h2"), ("area", "area_text", "span"), ("rooms", "rooms_text", "b"), ("baths", "baths_text", "i"), ("parking", "parking_text", "em"))
    card = F.concat(F.lit('<div class="a card b"><img src="x"><br>'), *[field(*f) for f in named])
    listed = X.load(s, d, _PAGES).select("page", "id", card.alias("card"), inside.alias("inside"))
    # a card inside the one before it: that one is closed only after it; every seventh is not closed at all
    shut = F.transform(F.array_sort(F.collect_list(F.struct("id", "card", "inside"))), lambda x: F.concat(F.when(x["inside"], "").otherwise("</section><section>"), x["card"], F.when(x["id"] % 7 == 0, "").when(x["inside"], "</div>").otherwise("<!-- open -->")))
    return listed.groupBy(F.col("page").alias("page_id")).agg(F.concat(F.lit("<html><section>"), F.array_join(shut, ""), F.lit("</section>")).alias("html"))


query("extract_listings", "SELECT page AS page_id, " + ", ".join(f"coalesce(nullif(trim({c}), ''), 'N/A') AS {n}" for n, c in (("price", "price_text"), ("address", "address"), ("area", "area_text"), ("rooms", "rooms_text"), ("baths", "baths_text"), ("parking", "parking_text"))) + f" FROM ({X.duck(_PAGES)})")(
    lambda s, d: pages.extract_cards(_listing_pages(s, d), pages.LISTING_CARD, pages.LISTING_FIELDS).drop("position"))

# --- series


def _monthly(method: str):
    return lambda s, d: series.monthly(X.load(s, d, X.SERIES), ["code"], "date", "value", method).select("code", F.col("month").cast("string").alias("month"), F.round("value", 4).alias("value"))


_M = f"SELECT code, CAST(CAST(date_trunc('month', date) AS DATE) AS VARCHAR) AS month, round({{}}, 4) AS value FROM ({_S}) GROUP BY ALL"
query("monthly_last", f"""SELECT code, month, round(value, 4) AS value FROM (SELECT code, CAST(CAST(date_trunc('month', date) AS DATE) AS VARCHAR) AS month,
  value, row_number() OVER (PARTITION BY code, date_trunc('month', date) ORDER BY date DESC, seq DESC) AS rn FROM ({_S}))
  WHERE rn = 1""")(_monthly("last"))
query("monthly_mean", _M.format("avg(value)"))(_monthly("mean"))
query("monthly_sum", _M.format("sum(value)"))(_monthly("sum"))
query("dedup_last", f"SELECT code, CAST(date AS VARCHAR) AS date, arg_max(value, seq) AS value FROM ({_S}) GROUP BY code, date")(
    lambda s, d: series.dedup_last(X.load(s, d, X.SERIES), ["code", "date"], "value", "seq").withColumn("date", F.col("date").cast("string")))
query("latest_by_key", """SELECT o_custkey, CAST(arg_max(CAST(o_orderdate AS DATE), (o_orderdate, o_orderkey)) AS VARCHAR) AS last_date, arg_max(o_orderkey,
  (o_orderdate, o_orderkey)) AS last_key, CAST((SELECT max(CAST(o_orderdate AS DATE)) FROM orders) AS VARCHAR) AS overall_date
  FROM orders GROUP BY o_custkey""")(
    lambda s, d: series.latest(s.read.parquet(f"{d}/orders.parquet").select("o_custkey", F.col("o_orderdate").alias("date"), F.col("o_orderkey").alias("key")), "o_custkey", ["date", "key"]).withColumns({c: F.col(c).cast("date").cast("string") for c in ("last_date", "overall_date")}))
_VALUES = ["name", "value", "unit", "frequency"]


def _upserted(s: SparkSession, d: str) -> DataFrame:
    rows = X.load(s, d, X.SERIES).where("code IS NOT NULL")
    cols = [*series.KEY, *_VALUES, "seen"]
    first = rows.where("NOT is_batch")
    stored = series.upsert(first.select(*cols).limit(0), first.select(*cols, "seq"))
    return series.upsert(stored, rows.where("is_batch").select(*cols[:4], (F.col("value") + 1).alias("value"), *cols[5:7], F.date_add("seen", 1).alias("seen"), "seq"))


_UPSERT = f"""WITH r AS (SELECT source, code, date, name, value, unit, frequency, seq, seen, is_batch FROM ({_S})),
  a AS (SELECT code, date, arg_max(value, seq) AS value, arg_min(seen, seq) AS seen FROM r WHERE NOT is_batch GROUP BY ALL),
  b AS (SELECT code, date, arg_max(value, seq) + 1 AS value, arg_min(seen, seq) + 1 AS seen FROM r WHERE is_batch GROUP BY ALL)
  SELECT 'A' AS source, coalesce(a.code, b.code) AS code, coalesce(a.date, b.date) AS date, coalesce(b.value, a.value) AS value, coalesce(a.seen, b.seen) AS seen FROM a FULL JOIN b ON a.code = b.code AND a.date = b.date"""
query("upsert_series", f"SELECT source, code, CAST(date AS VARCHAR) AS date, value, CAST(CAST(seen AS DATE) AS VARCHAR) AS seen FROM ({_UPSERT})")(
    lambda s, d: _upserted(s, d).select("source", "code", F.col("date").cast("string").alias("date"), "value", F.col("seen").cast("string").alias("seen")))
query("sql_series_coverage", f"""SELECT source, code, coalesce(name, '(no name)') AS label, count(*) AS n, CAST(min(date) AS VARCHAR) AS first,
  CAST(max(date) AS VARCHAR) AS last FROM ({_S}) GROUP BY ALL""")(
    lambda s, d: series.coverage(X.load(s, d, X.SERIES).withColumn("label", F.coalesce("name", F.lit("(no name)"))), ["source", "code", "label"], "date").withColumns({c: F.col(c).cast("string") for c in ("first", "last")}))
query("sql_latest_values", f"SELECT CAST(date AS VARCHAR) AS date, code, seq, value FROM ({_S}) ORDER BY date DESC, code, seq LIMIT 50")(
    lambda s, d: X.load(s, d, X.SERIES).orderBy(F.desc("date"), "code", "seq").limit(50).select(F.col("date").cast("string").alias("date"), "code", "seq", "value"))
query("catalogue_join", f"SELECT code, seq, value, catalogue_unit FROM ({_S}) JOIN ({X.duck(X.CATALOGUE)}) USING (code) WHERE coalesce(active, TRUE)")(
    lambda s, d: series.with_catalogue(X.load(s, d, X.SERIES).select("code", "seq", "value"), X.load(s, d, X.CATALOGUE)))
_INGESTED, _ROWS = X.duck(X.INGESTED), X.duck(X.SERIES_OF_SOURCES)
query("ingest_union", f"""WITH c AS (SELECT * FROM ({_INGESTED}) WHERE coalesce(active, TRUE)), r AS (SELECT * FROM ({_ROWS})),
  u AS (SELECT c.*, CASE WHEN EXISTS (SELECT 1 FROM r WHERE r.source = c.source AND r.code = c.code) THEN c.code ELSE fallback END AS used FROM c),
  m AS (SELECT source, code, CAST(date_trunc('month', date) AS DATE) AS month, avg(value) AS mean, sum(value) AS sum, arg_max(value, (date, seq)) AS last FROM r GROUP BY ALL)
  SELECT u.source, used AS code, name, CAST(month AS VARCHAR) AS month, round(CASE method WHEN 'mean' THEN mean WHEN 'sum' THEN sum ELSE last END, 4) AS value, unit, 'M' AS frequency FROM u JOIN m ON m.source = u.source AND m.code = u.used""")(
    lambda s, d: series.ingest(X.load(s, d, X.SERIES_OF_SOURCES), X.load(s, d, X.INGESTED).withColumn("fallbacks", F.when(F.col("fallback").isNotNull(), F.array("fallback")))).withColumn("value", F.round("value", 4)))
query("fallback_source", f"""SELECT series, rank, code, n FROM (SELECT series, rank, code, n, min(rank) OVER (PARTITION BY series) AS best FROM
  (SELECT s_suppkey AS series, unnest([0, 1, 2]) AS rank, unnest(['x' || s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'none' ELSE CAST(s_suppkey % 5 + 1 AS VARCHAR) END, '2']) AS code FROM supplier) c
  JOIN (SELECT substr(code, 1, 1) AS code, count(*) AS n FROM ({_S}) GROUP BY 1) r USING (code)) WHERE rank = best""")(
    lambda s, d: series.fallback_counts(X.load(s, d, "SELECT s_suppkey AS series, array('x' || s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'none' ELSE CAST(s_suppkey % 5 + 1 AS STRING) END, '2') AS codes FROM {supplier}"),
                                        X.load(s, d, X.SERIES).select(F.substring("code", 1, 1).alias("code"))))


_NAMES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_PIVOT = ", ".join(f"round(avg(value) FILTER (series = '{n}'), 4) AS s{n[0]}" for n in _NAMES)


def _pivoted(s: SparkSession, d: str) -> DataFrame:
    wide = series.pivot_mean(X.load(s, d, X.MONTHLY_LEFT), _NAMES)
    return wide.select("month", *[F.round(F.col(f"`{n}`"), 4).alias(f"s{n[0]}") for n in _NAMES])


query("pivot_mean", f"SELECT CAST(month AS VARCHAR) AS month, {_PIVOT} FROM ({X.duck(X.MONTHLY_LEFT)}) GROUP BY month")(
    lambda s, d: _pivoted(s, d).withColumn("month", F.col("month").cast("string")))
_RIGHT_NAMES = ["quantity", "price", "discount", "tax", "constant"]
_RIGHT_PIVOT = ", ".join(f"round(avg(value) FILTER (series = '{n}'), 4) AS {n}" for n in _RIGHT_NAMES)
query("pivot_found", f"""SELECT CAST(month AS VARCHAR) AS month, round(avg(value) FILTER (series = '1-URGENT'), 4) AS \"1-URGENT\",
  round(avg(value) FILTER (series = '5-LOW'), 4) AS \"5-LOW\" FROM ({X.duck(X.MONTHLY_LEFT)}) GROUP BY month""")(
    lambda s, d: _found(X.load(s, d, X.MONTHLY_LEFT).withColumn("value", F.when(F.col("series").isin("1-URGENT", "5-LOW"), F.col("value")))))


def _found(long: DataFrame) -> DataFrame:
    """All series but two have no value, and are no column."""
    wide = series.pivot_found(long, require_rows=True)
    return wide.select(F.col("month").cast("string").alias("month"), *[F.round(F.col(f"`{c}`"), 4).alias(c) for c in wide.columns[1:]])


query("month_join", f"""SELECT CAST(l.month AS VARCHAR) AS month, l.*EXCLUDE(month), r.*EXCLUDE(month) FROM (SELECT month, {_PIVOT}
  FROM ({X.duck(X.MONTHLY_LEFT)}) GROUP BY month) l JOIN (SELECT month, {_RIGHT_PIVOT} FROM ({X.duck(X.MONTHLY_RIGHT)})
  GROUP BY month) r ON l.month = r.month""")(
    lambda s, d: _pivoted(s, d).join(series.pivot_mean(X.load(s, d, X.MONTHLY_RIGHT), _RIGHT_NAMES).select("month", *[F.round(n, 4).alias(n) for n in _RIGHT_NAMES]), "month").withColumn("month", F.col("month").cast("string")))
query("corr_matrix", f"""WITH l AS ({X.duck(X.MONTHLY_LEFT)}), r AS ({X.duck(X.MONTHLY_RIGHT)}), a AS (SELECT month, series, avg(value) AS v FROM (SELECT * FROM l UNION ALL SELECT * FROM r)
  WHERE month IN (SELECT month FROM l) AND month IN (SELECT month FROM r) GROUP BY ALL)
  SELECT x.series AS series_a, y.series AS series_b, round(covar_pop(x.v, y.v) / nullif(stddev_pop(x.v) * stddev_pop(y.v), 0), 6) AS r FROM a x JOIN a y ON x.month = y.month GROUP BY ALL""")(
    lambda s, d: stats.correlation(X.load(s, d, X.MONTHLY_LEFT), X.load(s, d, X.MONTHLY_RIGHT)))

# --- text and JSON cells

_MONEY, _DATES = X.duck(X.MONEY), X.duck(X.DATES)
_SAFE = "CASE WHEN regexp_full_match({0}, '[+-]?[0-9]*\\.?[0-9]+') THEN TRY_CAST({0} AS DOUBLE) END"
query("parse_number", "SELECT o_orderkey, " + _SAFE.format("t") + f" AS value FROM (SELECT o_orderkey, CASE WHEN trim(cell) IN ('', '...', '-', 'null', 'None') THEN NULL WHEN contains(cell, ',') THEN replace(replace(trim(cell), '.', ''), ',', '.') ELSE trim(cell) END AS t FROM ({_MONEY}))")(
    lambda s, d: X.load(s, d, X.MONEY).select("o_orderkey", T.parse_number(F.col("cell")).alias("value")))
query("ptbr_number", "SELECT o_orderkey, " + _SAFE.format("t") + f" AS value FROM (SELECT o_orderkey, replace(replace(regexp_replace(cell, '[%\\s]', '', 'g'), '.', ''), ',', '.') AS t FROM ({_MONEY}))")(
    lambda s, d: X.load(s, d, X.MONEY).select("o_orderkey", T.ptbr_number(F.col("cell")).alias("value")))
query("parse_dates", f"""SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(d AS VARCHAR) END AS br, CASE WHEN o_orderkey % 7 <> 0
  THEN CAST(d AS VARCHAR) END AS iso FROM ({_DATES})""")(
    lambda s, d: X.load(s, d, X.DATES).select("o_orderkey", T.brazilian_date(F.expr("CASE WHEN o_orderkey % 5 = 0 THEN '31/13/' || yyyy ELSE dd || '/' || mm || '/' || yyyy END")).cast("string").alias("br"),
        T.iso_date(F.expr("CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE yyyy || '-' || mm || '-' || dd || CASE o_orderkey % 3 WHEN 0 THEN 'T00:00:00-03:00' WHEN 1 THEN 'T23:00:00Z' ELSE '' END END")).cast("string").alias("iso")))
_CODE = """CASE o_orderkey % 5 WHEN 0 THEN yyyy || mm || dd WHEN 1 THEN yyyy || '-' || mm WHEN 2
  THEN yyyy || CAST(o_orderkey % 4 + 1 AS STRING) WHEN 3 THEN yyyy ELSE '1' || yyyy || mm END"""
query("period_code", f"""SELECT o_orderkey, code, CASE length(replace(code, '-', '')) WHEN 8 THEN 'D' WHEN 5 THEN 'Q' WHEN 4 THEN 'A' ELSE 'M' END AS frequency, CASE o_orderkey % 5 WHEN 0 THEN yyyy || '-' || mm || '-' || dd WHEN 1 THEN yyyy || '-' || mm || '-01'
  WHEN 2 THEN yyyy || CASE o_orderkey % 4 WHEN 0 THEN '-01-01' WHEN 1 THEN '-04-01' WHEN 2 THEN '-07-01' ELSE '-10-01' END WHEN 3 THEN yyyy || '-01-01' END AS date FROM (SELECT *, {_CODE} AS code FROM ({_DATES}))""")(
    lambda s, d: X.load(s, d, X.DATES).withColumn("code", F.expr(_CODE)).select("o_orderkey", "code", T.period_frequency(F.col("code")).alias("frequency"), T.period_date(F.col("code")).cast("string").alias("date")))
_LABEL = "CASE o_orderkey % 6 WHEN 0 THEN 'jan18' WHEN 1 THEN 'abc-18' ELSE lower({}) || '.-' || substr(yyyy, 3, 2) END"
_MMM = "CASE mm " + " ".join(f"WHEN '{i + 1:02d}' THEN '{m}'" for i, m in enumerate(T.MONTHS)) + " END"
query("ptbr_month", f"SELECT o_orderkey, CASE WHEN o_orderkey % 6 > 1 THEN '20' || substr(yyyy, 3, 2) || '-' || mm || '-01' END AS month FROM ({_DATES})")(
    lambda s, d: X.load(s, d, X.DATES).select("o_orderkey", T.ptbr_month(F.expr(_LABEL.format(_MMM))).cast("string").alias("month")))
# beside the letters of the texts, some with marks of their own and some of other alphabets' accents
_ACCENTS = "replace(text, 'é', 'e' || chr(769)) || 'Ýpsilōn Ğ ř ő Å'"
query("accent_fold", f"SELECT doc_id, md5(lower(strip_accents({_ACCENTS}))) AS folded FROM documents")(
    lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.md5(T.fold_accents(F.concat(F.replace("text", F.lit("é"), F.lit("e\u0301")), F.lit("Ýpsilōn Ğ ř ő Å"))).cast("binary")).alias("folded")))


def _bodies(s: SparkSession, d: str) -> DataFrame:
    rows = s.read.parquet(f"{d}/orders.parquet")
    value = F.when(F.col("o_orderkey") % 4 == 0, "...").otherwise(F.col("o_orderkey").cast("string"))
    return rows.select("o_orderkey", F.concat(
        F.when(F.col("o_orderkey") % 7 == 0, '[1,"x",null,').otherwise("["), F.lit('{"D1C":"NC","D2C":"Mês","V":"Valor"},{"D1C":"4099","D1N":"Construção '), "o_orderpriority", F.lit('","D2C":" '), F.date_format("o_orderdate", "yyyy-MM"),
        F.lit('","D2N":"mês","V":"'), value, F.lit('"}]')).alias("body"))


query("json_source_a", f"SELECT o_orderkey, CAST(d AS VARCHAR) AS date, CAST(o_orderkey AS DOUBLE) + 0.5 AS value FROM ({_DATES}) WHERE o_orderkey % 4 <> 0")(
    lambda s, d: landed_json.source_a(X.load(s, d, X.DATES).select("o_orderkey", F.concat(F.lit('[{"data":"31/13/2024","valor":"1"},{"data":"'), "dd", F.lit("/"), "mm", F.lit("/"), "yyyy", F.lit('","valor":"'), F.when(F.col("o_orderkey") % 4 == 0, "").otherwise(F.concat(F.col("o_orderkey").cast("string"), F.lit(",5"))), F.lit('"}]')).alias("body")), "body").withColumn("date", F.col("date").cast("string")))
query("json_source_b", f"""SELECT o_orderkey, yyyy || '-' || mm AS period, yyyy || '-' || mm || '-01' AS date, 'M' AS frequency,
  CAST(o_orderkey AS DOUBLE) AS value FROM ({_DATES}) WHERE o_orderkey % 4 <> 0""")(
    lambda s, d: landed_json.source_b(_bodies(s, d), "body").withColumn("date", F.col("date").cast("string")))
query("json_source_c", f"""SELECT o_orderkey, 'X' || o_orderkey AS code, CAST(d AS VARCHAR) AS date, CAST(o_orderkey AS DOUBLE) AS value FROM ({_DATES})
  WHERE o_orderkey % 4 <> 0""")(
    lambda s, d: landed_json.source_c(X.load(s, d, X.DATES).select("o_orderkey", F.concat(F.lit('{"value":[{"SERCODIGO":"X'), F.col("o_orderkey").cast("string"), F.lit('","VALDATA":"'), "yyyy", F.lit("-"), "mm", F.lit("-"), "dd", F.lit('T00:00:00-03:00","VALVALOR":'), F.when(F.col("o_orderkey") % 4 == 0, "null").otherwise(F.col("o_orderkey").cast("string")), F.lit("}]}")).alias("body")), "body").withColumn("date", F.col("date").cast("string")))
query("period_key_detect", f"SELECT o_orderkey, yyyy || '-' || mm AS period FROM ({_DATES})")(
    lambda s, d: landed_json.entries(_bodies(s, d), "body").select("o_orderkey", landed_json.period_code(F.col("m")).alias("period")).where(F.col("period").isNotNull()))
query("keyword_filter", "SELECT o_orderkey FROM orders WHERE contains(o_orderpriority, 'HIGH')")(
    lambda s, d: landed_json.entries(_bodies(s, d), "body").where(landed_json.has_keywords(F.col("m"), ["Construção", "high"])).select("o_orderkey"))

# --- landed responses: files on disk, some of them broken

_OUTCOMES = {"A": landed_json.outcomes_a, "B": landed_json.outcomes_b, "C": landed_json.outcomes_c}
_LANDED = X.duck(X.LANDED)
#: What each source gives for an element that is no object or has a bad date, and its dates and values.
_SAID = {
    "A": ("CASE reason WHEN 'no object' THEN 'no date' ELSE reason END", "d", "o_orderkey + 0.5e0"),
    "B": ("CASE reason WHEN 'no date' THEN NULL ELSE reason END", "CASE reason WHEN 'no date' THEN DATE '2001-01-01' ELSE CAST(date_trunc('month', d) AS DATE) END", "CAST(o_orderkey AS DOUBLE)"),
    "C": ("CASE reason WHEN 'no object' THEN 'no date' ELSE reason END", "d", "o_orderkey + 0.5e0"),
}


def _responses(s: SparkSession, d: str, source: str) -> DataFrame:
    root = scratch.path(s, f"landed-{source}")
    X.landed(s, d, source, root)
    return landed_files.read(s, root)


def _landed(s: SparkSession, d: str) -> list[tuple[DataFrame, DataFrame]]:
    out = []
    for source, outcomes in _OUTCOMES.items():
        rows, bad = landed_files.load(_responses(s, d, source), outcomes, ["path"])
        named = [F.lit(source).alias("source"), "path"]
        out.append((rows.select(*named, F.col("date").cast("string").alias("date"), "value"), bad.select(*named, "reason", "n")))
    return out


query("landed_rows", " UNION ALL ".join(
    f"SELECT '{k}' AS source, path, CAST({date} AS VARCHAR) AS date, {value} AS value FROM ({_LANDED}) WHERE broken IS NULL AND ({why}) IS NULL" for k, (why, date, value) in _SAID.items()))(
    lambda s, d: functools.reduce(DataFrame.unionByName, [rows for rows, _ in _landed(s, d)]))
query("landed_rejects", " UNION ALL ".join(
    f"SELECT '{k}' AS source, path, coalesce(broken, why) AS reason, CASE WHEN max(broken) IS NULL THEN count(*) ELSE 1 END AS n FROM (SELECT *, {why} AS why FROM ({_LANDED})) WHERE coalesce(broken, why) IS NOT NULL GROUP BY path, coalesce(broken, why)"
    for k, (why, _, _) in _SAID.items()))(lambda s, d: functools.reduce(DataFrame.unionByName, [bad for _, bad in _landed(s, d)]))
query("landed_series", f"""SELECT 'B' AS source, 'S' || k AS code, 'series ' || k AS name, CASE WHEN k = 5 THEN '2001-01-01' ELSE CAST(CAST(CASE reason WHEN 'no date' THEN DATE '2001-01-01' ELSE date_trunc('month', d) END AS DATE) AS VARCHAR) END AS month,
  CAST(o_orderkey AS DOUBLE) AS value, 'R$' AS unit, CASE WHEN k = 1 THEN 'Q' WHEN k = 5 OR reason = 'no date' THEN 'A' ELSE 'M' END AS frequency, path FROM (SELECT *, CAST(substr(path, 3, 1) AS INT) AS k FROM ({_LANDED}))
  WHERE k <> 2 AND coalesce(reason, '') NOT IN ('no object', 'no value') AND path = 't/' || k || '/p 1997'""")(
    lambda s, d: landed_files.series_by_catalogue(_responses(s, d, "B"), X.load(s, d, X.CATALOGUE_B)))

# --- wide files: the lines are rendered from monthly means, then melted again

_WIDE = "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, " + ", ".join(f"CAST(round(avg(o_totalprice + {i})) AS BIGINT) AS v{i}" for i in range(7)) + " FROM {orders} GROUP BY 1"
_AT = {1: 7, 2: 12, 0: 17, 4: 27, 5: 32, 3: 37, 6: 42}  # measure to column


def wide_lines(s: SparkSession, d: str) -> DataFrame:
    """(file, record, line): four heading records and a record for each month of the orders, in one file a year."""
    names = {2: (2, "Venda"), 22: (2, "Locação"), 42: (2, "Rentabilidade do aluguel (rental yield)"), 7: (3, "Var. mensal (%)"), 12: (3, "Var. em 12 meses (%)"), 17: (3, "Preço médio (R$/m²)"), 27: (3, "Var. mensal (%)"), 32: (3, "Var. em 12 meses (%)"), 37: (3, "Preço médio (R$/m²)"), 1: (4, "Data")}
    head = [",".join(v if r == k else "" for k, v in ((names.get(c, (0, "")))for c in range(56))) for r in (1, 2, 3, 4)]
    months = X.load(s, d, _WIDE).withColumn("file", F.year("month").cast("string"))
    label = F.concat(F.element_at(F.array(*[F.lit(m) for m in T.MONTHS]), F.month("month")), F.lit(".-"), F.substring(F.year("month").cast("string"), 3, 2))
    at = {v: k for k, v in _AT.items()}
    row = [label if c == 1 else F.concat(F.lit('"'), F.col(f"v{at[c]}").cast("string"), F.lit(',5"')) if c in at else F.lit(".") for c in range(56)]
    body = months.select("file", (F.month("month") + 3).alias("record"), F.concat_ws(",", *row).alias("line"))
    tops = months.select("file").distinct().select("file", F.posexplode(F.array(*[F.lit(h) for h in head])).alias("record", "line"))
    return tops.unionByName(body).unionByName(months.select("file").distinct().select("file", F.lit(90).alias("record"), F.lit("Fonte: nota").alias("line")))


query("price_index_load", "SELECT '20' || substr(CAST(month AS VARCHAR), 3) AS date, " + ", ".join(f"v{i} + 0.5e0 AS {n}" for i, (n, _, _) in zip((0, 3, 1, 4, 2, 5, 6), wide_index.RULES)) + f" FROM ({X.duck(_WIDE)})")(
    lambda s, d: wide_index.load(wide_lines(s, d)).withColumn("date", F.col("date").cast("string")))
query("wide_header", """SELECT DISTINCT CAST(year(o_orderdate) AS VARCHAR) AS file, c AS \"column\", o AS output FROM orders, (VALUES (1, 'date'), (7,
  'monthly_sale'), (12, 'yearly_sale'), (17, 'price_m2'), (27, 'monthly_rent'), (32, 'yearly_rent'), (37, 'rent_m2'), (42,
  'rent_yield')) t(c, o)""")(
    lambda s, d: wide_index.columns(wide_index.headings(wide_index.cells(wide_lines(s, d)))))


def _odd_wide_lines(s: SparkSession, d: str) -> DataFrame:
    """Wide files whose headings are those above in every fourth year; others lack the date's or the price's."""
    year, head = F.col("file").cast("int") % 4, F.col("record") < 4
    line = F.when(head & (year == 1), F.replace(F.replace("line", F.lit("Data"), F.lit("Database")), F.lit("Preço médio (R$/m²)"), F.lit("Total")))
    line = line.when(head & (year == 2), F.replace(F.replace("line", F.lit("Data"), F.lit("Dia")), F.lit("Preço médio (R$/m²)"), F.lit("Custo")))
    return wide_lines(s, d).withColumn("line", line.when(head & (year == 3), "").otherwise(F.col("line")))


query("wide_report", """SELECT DISTINCT CAST(y AS VARCHAR) AS file, CASE y % 4 WHEN 1 THEN 'holds the word' WHEN 2 THEN 'second column' ELSE 'none' END AS date_rule,
  CASE y % 4 WHEN 3 THEN 'none' ELSE 'first without total' END AS price_rule FROM (SELECT year(o_orderdate) AS y FROM orders) WHERE y % 4 <> 0""")(
    lambda s, d: wide_index.load_with_report(_odd_wide_lines(s, d))[1])

# --- sinks


@query("sink_append", f"SELECT id, segment, page FROM ({_L}) UNION ALL SELECT id, segment, page FROM ({_L}) WHERE page = 1")
def sink_append(s: SparkSession, d: str) -> DataFrame:
    path, rows = scratch.path(s, "append"), raw(s, d).select("id", "segment", "page")
    sinks.append(rows, path, "segment")
    sinks.append(rows.where("page = 1"), path, "segment")
    return s.read.schema("id bigint, page int, segment string").parquet(path).select("id", "segment", "page")


query("stamped_series", f"""SELECT source, code, CAST(date AS VARCHAR) AS date, value, coalesce(CASE code WHEN '1-URGENT' THEN NULL ELSE 'Q' END, 'M') AS frequency,
  CASE WHEN is_batch THEN '2026-01-02 03:04:05' ELSE CAST(CAST(seen AS DATE) AS VARCHAR) || ' 00:00:00' END AS collected_at FROM ({_S})""")(
    lambda s, d: sinks.stamped(X.load(s, d, X.SERIES).withColumns({"frequency": F.expr("CASE code WHEN '1-URGENT' THEN NULL ELSE 'Q' END"), "collected_at": F.expr("CASE WHEN NOT is_batch THEN seen END")}),
        "series", F.lit("2026-01-02 03:04:05").cast("timestamp")).select("source", "code", F.col("date").cast("string").alias("date"), "value", "frequency", F.date_format("collected_at", "yyyy-MM-dd HH:mm:ss").alias("collected_at")))


@query("sink_csv", f"SELECT p_partkey, p_type, p_retailprice FROM ({_PARTS})")
def sink_csv(s: SparkSession, d: str) -> DataFrame:
    path = scratch.path(s, "csv")
    sinks.write_csv(part(s, d).select("p_partkey", "p_type", "p_retailprice"), path)
    return sinks.read_csv(s, path, "p_partkey bigint, p_type string, p_retailprice double")


@query("schema_contract", f"""SELECT 'listings' AS table_name, (SELECT count(*) FROM ({_L})) AS n, CAST(0 AS BIGINT) AS nulls, (SELECT count(*) - count(DISTINCT id) FROM ({_L})) AS repeats
  UNION ALL SELECT 'series', count(*), CAST(0 AS BIGINT), count(*) - count(DISTINCT (code, date)) FROM ({_S})
  UNION ALL SELECT 'clean_listings', count(*), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM ({_CLEAN})
  UNION ALL SELECT 'progress', count(*), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM ({X.duck(X.PROGRESS)})
  UNION ALL SELECT 'statistics', count(*), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM ({_DESCRIBED})
  UNION ALL SELECT 'price_index', count(*), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM ({X.duck(_WIDE)})""")
def schema_contract(s: SparkSession, d: str) -> DataFrame:
    tables = {"listings": raw(s, d), "series": X.load(s, d, X.SERIES), "clean_listings": clean(s, d), "progress": X.load(s, d, X.PROGRESS), "statistics": described(s, d), "price_index": wide_index.load(wide_lines(s, d))}
    return functools.reduce(DataFrame.unionByName, [sinks.violations(sinks.conform(df, name), name, *sinks.CONTRACTS[name]) for name, df in tables.items()])


# --- tables that are replaced as a whole, read in order


def _stored(s: SparkSession, name: str, df: DataFrame, order: list[str]) -> DataFrame:
    """A table replaced by df, then by nothing, which changes nothing, read in order."""
    path = scratch.path(s, name)
    sinks.replace(sinks.conform(df, name), path)
    sinks.replace(s.createDataFrame([], sinks.SCHEMAS[name]), path)
    return sinks.current(s, path, order)


query("listings_table", _CLEAN)(lambda s, d: _stored(s, "clean_listings", clean(s, d), ["address", "price", "area"]))
query("statistics_table", _DESCRIBED)(lambda s, d: _stored(s, "statistics", described(s, d), ["kind", "field"]))
query("price_index_table", ORACLES["price_index_load"])(
    lambda s, d: _stored(s, "price_index", wide_index.load(wide_lines(s, d)), ["date"]).withColumn("date", F.col("date").cast("string")))
query("series_table", f"""SELECT source, code, CAST(date AS VARCHAR) AS date, value, CAST(CAST(seen AS DATE) AS VARCHAR) AS seen, 'R$' AS unit,
  'M' AS frequency, CASE WHEN code = '5-LOW' THEN NULL ELSE 'series ' || substr(code, 1, 1) END AS name FROM ({_UPSERT})""")(
    lambda s, d: _stored(s, "series", _upserted(s, d), ["date", "source", "code"]).withColumns({c: F.col(c).cast("string") for c in ("date", "seen")}))


_PAGE = ["segment", "page"]


def _recorded(s: SparkSession, d: str) -> str:
    """Pages recorded in three runs: collected ones, empty ones of which some are marked, and the first run again."""
    path = scratch.path(s, "recorded")
    for run, pages_ in (("first", X.PROGRESS), ("second", X.EMPTY), ("first", X.PROGRESS)):
        due = X.load(s, d, pages_)
        rows = due.distinct().withColumn("card", F.explode(F.sequence(F.lit(0), F.col("page") % 3)))
        sinks.record(rows, due, path, _PAGE, run)
    return path


_DUE = f"SELECT DISTINCT segment, page FROM (SELECT * FROM ({X.duck(X.PROGRESS)}) UNION SELECT * FROM ({X.duck(X.EMPTY)}))"
query("record_pages", f"SELECT segment, page, CAST(1 AS BIGINT) AS n FROM ({_DUE})")(
    lambda s, d: sinks.marks(s, _recorded(s, d), sinks.SCHEMAS["progress"]).groupBy(*_PAGE).agg(F.count(F.lit(1)).alias("n")))
query("record_rows", f"SELECT segment, page, CAST(unnest(range(page % 3 + 1)) AS INT) AS card FROM ({_DUE})")(
    lambda s, d: sinks.recorded(s, _recorded(s, d), "segment int, page int, card int"))


@query("merge_series", ORACLES["upsert_series"])
def merge_series(s: SparkSession, d: str) -> DataFrame:
    """The upsert of series, month by month in place: only the months of a batch are written again."""
    path, month = scratch.path(s, "merged"), F.date_format("date", "yyyy-MM")
    rows = X.load(s, d, X.SERIES).where("code IS NOT NULL")
    cols = [*series.KEY, *_VALUES, "seen"]
    shifted = rows.where("is_batch").select(*cols[:4], (F.col("value") + 1).alias("value"), *cols[5:7], F.date_add("seen", 1).alias("seen"), "seq")
    for batch in (rows.where("NOT is_batch").select(*cols, "seq"), shifted):
        sinks.merge(batch, path, sinks.SCHEMAS["series"], month, lambda stored, b: series.upsert(stored.select(*cols), b))
    out = sinks.parts(s, path, sinks.SCHEMAS["series"])
    return out.select("source", "code", F.col("date").cast("string").alias("date"), "value", F.col("seen").cast("string").alias("seen"))


query("clean_audit_on_write", ORACLES["clean_audit"])(lambda s, d: listings.clean_and_count(raw(s, d), scratch.path(s, "clean"))[1])
# listings as a table that needs a price and an area and holds an address once
_CHECKED = f"SELECT *, concat_ws(', ', CASE WHEN price IS NULL THEN 'price' END, CASE WHEN area IS NULL THEN 'area' END) AS why FROM ({_TYPED})"


def _contract(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = listings.typed(raw(s, d)).select("id", "address", "price", "area")
    return sinks.checked(rows, scratch.path(s, "checked"), ["price", "area"], ["address", "price"], "id")


query("contract_rows", f"SELECT arg_min(id, id) AS id, address, price, arg_min(area, id) AS area FROM ({_CHECKED}) WHERE why = '' GROUP BY address, price")(
    lambda s, d: _contract(s, d)[0])
query("contract_quarantine", f"""SELECT reason, count(*) AS keys, CAST(sum(n) AS BIGINT) AS n FROM (SELECT address, price, CASE WHEN why = '' THEN 'repeated' ELSE 'null in ' || why END AS reason, CASE WHEN why = '' THEN count(*) - 1 ELSE count(*) END AS n
  FROM ({_CHECKED}) GROUP BY address, price, why) WHERE n > 0 GROUP BY reason""")(
    lambda s, d: _contract(s, d)[1].groupBy("reason").agg(F.count(F.lit(1)).alias("keys"), F.sum("n").alias("n")))
query("contract_counts", f"""SELECT count(DISTINCT (address, price)) FILTER (why = '') AS n, count(*) FILTER (why <> '') AS nulls, count(*) FILTER (why = '') - count(DISTINCT (address, price)) FILTER (why = '') AS repeats FROM ({_CHECKED})""")(
    lambda s, d: _contract(s, d)[2])
