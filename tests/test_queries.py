"""Every domain query against its SQL in DuckDB, and invariants of the operators."""

import duckdb
import numpy as np
import pytest

from tests.conftest import DATA
from tijolo.operators import listings, series
from tijolo.plans import fixtures as X
from tijolo.plans.queries import ORACLES, QUERIES, raw
from tijolo.sources import sinks, wide_index

TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    df = df.where(df.notna(), None)
    fix = lambda x: round(float(x), 8) if isinstance(x, (float, int, np.number)) and not isinstance(x, bool) else x
    return list(df.columns), sorted((tuple(map(fix, r)) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(con.sql(ORACLES[name]).df())


def test_dedup_keeps_first_and_takes_nulls_as_equal(spark):
    df = spark.createDataFrame([(2, None, "b"), (1, None, "a"), (3, "x", "c")], "id int, k string, v string")
    assert {(r.k, r.v) for r in listings.dedup_first(df, ["k"], "id").collect()} == {(None, "a"), ("x", "c")}


def test_upsert_twice_is_upsert_once(spark):
    cols = [*series.KEY, "name", "value", "unit", "frequency", "seen"]
    rows_ = X.load(spark, DATA, X.SERIES)
    once = series.upsert(rows_.select(*cols).limit(0), rows_.select(*cols, "seq"))
    again = series.upsert(once, rows_.select(*cols, "seq"))
    assert sorted(map(str, once.collect())) == sorted(map(str, again.collect()))


def test_replace_keeps_old_rows_when_new_are_none(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace(spark.range(3), path)
    sinks.replace(spark.range(0).toDF("id"), path)
    assert sinks.current(spark, path).count() == 3
    sinks.replace(spark.range(5), path)
    assert sinks.current(spark, path).count() == 5


def test_no_python_outside_card_extraction(spark):
    plan = listings.clean(raw(spark, DATA))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_cards_survive_broken_html(spark):
    from tijolo.operators.pages import extract_cards

    df = spark.createDataFrame([(1, "<li><a href='/x'>R$\n5</a><li><a>"), (2, None), (3, "<<li"), (4, "<li>no link</li>")], "page_id bigint, html string")
    assert [(r.page_id, r.price, r.link) for r in extract_cards(df).collect()] == [(1, "R$ 5", "/x")]


def test_wide_file_from_disk(spark, tmp_path):
    head = ["," * 2, ",,Venda", ",,Preço médio (R$/m²)", ",Data,Total"]
    (tmp_path / "a.csv").write_text("\n".join([*head, ',jan.-18,"4.586,5"', ",fev.-18,.", ",,", "Fonte: x"]), encoding="utf-8")
    out = wide_index.load(wide_index.read_lines(spark, str(tmp_path / "a.csv")), 3).collect()
    assert [(str(r.date), r.price_m2, r.rent_m2) for r in out] == [("2018-01-01", 4586.5, None)]
