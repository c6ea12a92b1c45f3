"""Domain operators on small made tables: nulls, ties, reserved names, damaged input, empty tables."""

import json
from datetime import date as D

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tijolo.operators import coverage, pages, series, stats
from tijolo.plans import fixtures
from tijolo.plans.queries import QUERIES
from tijolo.sources import landed_files, landed_json, sinks, wide_index



def test_elements_that_are_no_objects_are_left_out(spark):
    body = '[1, {"D1C": "4099", "D2C": "2024-02", "D2N": "Construção", "V": "7,5"}, "x", null, [2], {"D1C": "200001", "V": "-"}]'
    df = spark.createDataFrame([(1, body), (2, None), (3, "[]"), (4, "{")], "id int, body string")
    assert [(r.id, r.period, str(r.date), r.frequency, r.value) for r in landed_json.source_b(df, "body").collect()] == [(1, "2024-02", "2024-02-01", "M", 7.5)]
    found = landed_json.entries(df, "body")
    assert [r.id for r in found.where(landed_json.has_keywords(F.col("m"), ["CONSTRUCÃO"])).collect()] == [1] and found.count() == 2


def test_kinds_that_are_null_or_named_like_all_rows(spark):
    df = spark.createDataFrame([("Casa", 1.0), ("Casa", 3.0), ("Outro", 5.0), (None, 7.0), ("Todos", 9.0), ("Outro", None)], "kind string, v double")
    got = {r.kind: (r.n, r.mean, r.median) for r in stats.describe_by_kind(df, "kind", {"v": "R$"}).collect()}
    assert got == {"Todos": (5, 5.0, 5.0), "Casa": (2, 2.0, 2.0), "Outro": (1, 5.0, 5.0)}
    assert [(r.kind, r.unit, r.n, r.mean, r.median) for r in stats.describe_by_kind(df.limit(0), "kind", {"v": "R$"}).collect()] == [("Todos", "R$", 0, None, None)]
    assert [(r.kind, r.n, r.percent) for r in stats.share(df, "kind").collect()][0] == ("Casa", 2, 40.0)


@pytest.mark.parametrize("how", [{}, {"accuracy": 2}, {"accuracy": 50}, {"limit": 0}, {"accuracy": 50, "limit": 3}, "a sketch that is off"])
def test_quantiles_equal_numpy(spark, monkeypatch, how):
    if isinstance(how, str):
        monkeypatch.setattr(stats.F, "percentile_approx", lambda c, p, a: F.array(*[F.max(F.lit(-7.0)) for _ in p]))
        how = {}
    rng = np.random.default_rng(2)
    values = {"a": rng.exponential(5, 500).round(2), "b": np.array([3.0] * 7), "c": np.array([1.0]), None: rng.normal(0, 1, 30)}
    df = spark.createDataFrame([(k, float(x)) for k, v in values.items() for x in v] + [("d", None)], "k string, v double")
    qs = [0.0, 0.25, 0.5, 0.95, 1.0]
    got = {r.k: [r[f"q{i}"] for i in range(5)] for r in stats.quantiles(df, "v", qs, ["k"], **how).collect()}
    assert set(got) == set(values)
    for k, v in values.items():
        assert np.allclose(got[k], np.quantile(v, qs))
    every = np.concatenate(list(values.values()))
    assert np.allclose(stats.quantiles(df, "v", [0.5], **how).first().q0, np.median(every)) and stats.quantiles(df.limit(0), "v", [0.5]).count() == 0
    assert stats.below_quantile(df, ["v"], 0.9).count() == (every < np.quantile(every, 0.9)).sum()


def test_histogram_has_all_bins(spark):
    df = spark.createDataFrame([(0.0,), (0.0,), (9.9,), (10.0,), (None,)], "v double")
    assert [r.n for r in stats.histogram(df, "v", 10).collect()] == [2, 0, 0, 0, 0, 0, 0, 0, 0, 2]
    assert [r.n for r in stats.histogram(df.where("v = 0"), "v", 3).collect()] == [2, 0, 0] and [r.n for r in stats.histogram(df.limit(0), "v", 2).collect()] == [0, 0]


def test_correlation_reads_each_input_once(spark):
    left = spark.createDataFrame([(m, "x", float(m)) for m in range(5)] + [(m, "x", float(m)) for m in range(5)] + [(1, None, 3.0), (9, "z", 1.0)], "month int, series string, value double")
    right = spark.createDataFrame([(m, "y", -2.0 * m) for m in range(5)] + [(m, "one", 1.0) for m in range(5)] + [(2, "w", None)], "month int, series string, value double")
    got = {(r.series_a, r.series_b): r.r for r in stats.correlation(left, right).collect()}
    names = {a for a, _ in got}
    assert len(got) == len(names) ** 2 and got["x", "y"] == got["y", "x"] == -1.0 and got["x", "x"] == 1.0 and got["one", "x"] is None


def test_catalogue_drives_the_ingest(spark):
    rows = spark.createDataFrame([("A", "1", "2024-01-05", 1.0, 1), ("A", "1", "2024-01-20", 3.0, 2), ("A", "9", "2024-02-01", 5.0, 3), ("B", "1", "2024-01-01", 8.0, 4)], "source string, code string, date string, value double, seq long")
    cat = spark.createDataFrame(
        [("A", "1", "mean", True, None, "n1", "u"), ("A", "2", "last", None, ["7", "9"], "n2", "u"), ("A", "3", "last", True, ["8"], "n3", "u"), ("B", "1", "sum", False, None, "n4", "u")],
        "source string, code string, method string, active boolean, fallbacks array<string>, name string, unit string")
    assert sorted((r.name, r.code, r.month, r.value) for r in series.ingest(rows, cat).collect()) == [("n1", "1", "2024-01-01", 2.0), ("n2", "9", "2024-02-01", 5.0)]
    wanted = spark.createDataFrame([("s", ["0", "9", "1"])], "series string, codes array<string>")
    assert [(r.series, r.rank, r.code, r.value) for r in series.fallback(wanted, rows).collect()] == [("s", 1, "9", 5.0)]


def test_a_job_that_dies_between_the_steps_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(ValueError):
        sinks.current(spark, path)
    sinks.replace(spark.range(3), path)
    spark.range(7).write.parquet(f"{path}/rows/written-but-not-listed")
    assert [r.id for r in sinks.current(spark, path, ["id"]).collect()] == [0, 1, 2]


def files(path):
    return {str(f) for f in path.rglob("*.parquet")}


def test_pages_are_recorded_once(spark, tmp_path):
    path, keys, schema = str(tmp_path / "t"), ["segment", "page"], "segment int, page int, card string"
    rows = spark.createDataFrame([(1, 1, "a"), (1, 1, "b"), (None, 2, "c"), (1, 9, "not due")], schema)
    due = spark.createDataFrame([(1, 1), (1, 1), (None, 2), (1, 3)], "segment int, page int")
    assert sinks.recorded(spark, path, schema).count() == 0 and not (tmp_path / "t").exists()
    sinks.record(rows, due, path, keys, "r1")
    once = files(tmp_path)
    sinks.record(rows, due, path, keys, "r1")  # the run comes again
    assert files(tmp_path) == once
    sinks.record(rows, due.union(spark.createDataFrame([(2, 5)], due.schema)), path, keys, "r2")  # its pages come again, one is new
    assert sorted(r.card for r in sinks.recorded(spark, path, schema).collect()) == ["a", "b", "c"]
    assert sinks.marks(spark, path, "segment int, page int").count() == 4
    # a run that died after its rows were written: they don't count, and it starts over
    spark.createDataFrame([(3, 1, "half")], schema).write.parquet(f"{path}/rows/run=r3")
    assert sinks.recorded(spark, path, schema).count() == 3
    sinks.record(spark.createDataFrame([(3, 1, "whole")], schema), spark.createDataFrame([(3, 1)], due.schema), path, keys, "r3")
    assert sorted(r.card for r in sinks.recorded(spark, path, schema).collect()) == ["a", "b", "c", "whole"]


def test_a_batch_changes_only_the_months_it_touches(spark, tmp_path):
    schema = sinks.SCHEMAS["series"]
    path, month = str(tmp_path / "t"), F.date_format("date", "yyyy-MM")
    row = lambda code, day, value, seen, seq: ("A", code, D.fromisoformat(day), None, value, "u", "M", D.fromisoformat(seen), seq)
    batch = lambda *rows: spark.createDataFrame(rows, f"{schema}, seq bigint")
    cols = [x.rsplit(" ", 1)[0] for x in schema.split(", ")]
    merge = lambda b: sinks.merge(b, path, schema, month, lambda stored, x: series.upsert(stored.select(cols), x))
    merge(batch(row("1", "2024-01-05", 1.0, "2024-02-01", 1), row("1", "2024-02-05", 2.0, "2024-02-01", 2), row("2", "2024-02-05", 3.0, "2024-02-01", 3)))
    before = files(tmp_path / "t" / "rows")
    second = batch(row("1", "2024-02-05", 9.0, "2024-03-01", 1), row("3", "2024-02-06", 4.0, "2024-03-01", 2))
    merge(second)
    state = lambda: sorted((r.code, str(r.date), r.value, str(r.seen)) for r in sinks.parts(spark, path, schema).collect())
    want = [("1", "2024-01-05", 1.0, "2024-02-01"), ("1", "2024-02-05", 9.0, "2024-02-01"), ("2", "2024-02-05", 3.0, "2024-02-01"), ("3", "2024-02-06", 4.0, "2024-03-01")]
    assert state() == want
    now = files(tmp_path / "t" / "rows")
    assert before <= now and all("2024-02" in f for f in now - before)
    merge(second)  # again
    merge(second.limit(0))
    spark.createDataFrame([], schema).write.parquet(f"{path}/rows/died")  # a job that wrote and did not list
    assert state() == want
    # the first content is in use for January still
    assert sinks.vacuum(spark, path, "parts") == 2 and state() == want
    (tmp_path / "t").rename(tmp_path / "moved")
    assert sinks.parts(spark, str(tmp_path / "moved"), schema).count() == 4


def test_reading_creates_nothing_and_old_versions_can_go(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(ValueError):
        sinks.current(spark, path)
    assert not (tmp_path / "t").exists()
    for n in (3, 4, 5):
        sinks.replace(spark.range(n), path)
    assert sinks.vacuum(spark, path) == 2 and sinks.current(spark, path).count() == 5 and sinks.vacuum(spark, path) == 0
    (tmp_path / "t").rename(tmp_path / "moved")
    assert sinks.current(spark, str(tmp_path / "moved")).count() == 5


@pytest.mark.parametrize("order", [["a"], ["a", "b"], ["b", "a"]])
def test_ordered_reads_are_in_order(spark, tmp_path, order):
    rows = [(x % 5, (x * 7) % 11) for x in range(60)] + [(None, 3)]
    sinks.replace(spark.createDataFrame(rows, "a int, b int").repartition(4), str(tmp_path / "t"))
    got = [tuple(r[c] for c in order) for r in sinks.current(spark, str(tmp_path / "t"), order).collect()]
    assert got == sorted(got, key=lambda t: [(x is not None, x) for x in t])


@pytest.mark.parametrize(("name", "key"), [
    ("statistics_table", lambda r: (r["kind"], r["field"])), ("price_index_table", lambda r: r["date"]), ("series_table", lambda r: (r["date"], r["source"], r["code"])),
    ("chart_box", lambda r: (r["median"], r["kind"])), ("chart_share", lambda r: (-r["n"], r["kind"])), ("sql_page_density", lambda r: (-r["n"], r["l_orderkey"], r["l_linenumber"]))])
def test_queries_that_promise_an_order_keep_it(spark, name, key):
    got = QUERIES[name](spark, DATA).collect()
    assert len(got) > 1 and got == sorted(got, key=key)


def test_contract_on_write(spark, tmp_path):
    df = spark.createDataFrame([(3, "k", 1.0), (1, "k", None), (2, "k", 2.0), (4, None, 5.0), (5, "m", 1.0), (6, "m", None), (6, "m", None)], "id int, key string, v double")
    rows, bad, counts = sinks.checked(df, str(tmp_path / "t"), ["key", "v"], ["key"], "id")
    assert sorted((r.id, r.key, r.v) for r in rows.collect()) == [(2, "k", 2.0), (5, "m", 1.0)]
    assert sorted((r.reason, r.key, r.n) for r in bad.collect() if r.key) == [("null in v", "k", 1), ("null in v", "m", 2), ("repeated", "k", 1)]
    assert [(r.reason, r.id, r.n) for r in bad.where("key IS NULL").collect()] == [("null in key", 4, 1)]
    assert tuple(counts.first()) == (2, 4, 1)
    rows, bad, counts = sinks.checked(df.limit(0), str(tmp_path / "none"), ["key", "v"], ["key"], "id")
    assert rows.count() == bad.count() == 0 and tuple(counts.first()) == (0, 0, 0)


def test_one_far_value_moves_no_rows_into_a_task(spark, monkeypatch):
    """200,000 values between 0 and 1 and one of 1e12: at most 400 are put in order around a quantile."""
    seen, written = {}, stats.scratch.written

    def watch(df, name):
        out = written(df, name)
        seen.setdefault(name, []).append(out)
        return out

    monkeypatch.setattr(stats.scratch, "written", watch)
    rng = np.random.default_rng(3)
    values = np.append(rng.random(200_000), 1e12)
    df = spark.range(len(values)).join(spark.createDataFrame(list(enumerate(values.tolist())), "id long, v double"), "id")
    got = stats.quantiles(df, "v", [0.05, 0.5, 0.95]).first()
    assert np.allclose([got.q0, got.q1, got.q2], np.quantile(values, [0.05, 0.5, 0.95]), rtol=1e-12)
    assert max(r["count"] for r in seen["cells"][-1].groupBy("_i").count().collect()) <= 400
    # where a range is too large for a task, its values are sorted over all of them
    got = stats.quantiles(df, "v", [0.5], accuracy=10, limit=1000).first()
    assert abs(got.q0 - np.median(values)) < 1e-12
    sizes = [r["count"] for r in seen["sorted"][-1].groupBy("_part").count().collect()]
    assert sum(sizes) > 50_000 and max(sizes) < 0.5 * sum(sizes)


def test_correlation_of_many_series_in_blocks(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(100, 1, (300, 40)).cumsum(axis=1)
    v[rng.random(v.shape) < 0.1] = np.nan
    v[7] = 3.25
    rows = [(m, f"s{i}", float(v[i, m]), 1 + i % 2) for i in range(300) for m in range(40) if not np.isnan(v[i, m])] + [(m, "s0", float(m), 2) for m in range(40)] + [(99, "late", 1.0, 1)]
    df = spark.createDataFrame(rows, "month int, series string, value double, side int")
    got = {(r.series_a, r.series_b): r.r for r in stats.correlation(df.where("side = 1"), df.where("side = 2"), block=64).collect()}
    names = {a for a, _ in got}
    assert len(got) == len(names) ** 2 and "late" not in names and {"left: s0", "right: s0"} <= names and "s0" not in names and len(names) == 301
    for i, j in [(1, 2), (5, 5), (12, 299), (200, 3)]:
        both = ~np.isnan(v[i]) & ~np.isnan(v[j])
        assert abs(got[f"s{i}", f"s{j}"] - np.corrcoef(v[i][both], v[j][both])[0, 1]) < 2e-6 and got[f"s{i}", f"s{j}"] == got[f"s{j}", f"s{i}"]
    assert got["s7", "s7"] is None and got["s7", "s8"] is None


def test_sketches_are_within_their_error(spark):
    """2.5 %, three standard errors, of the exact number; merging parts gives what the whole gives."""
    df = spark.range(60_000).select((F.col("id") % 3).alias("g"), (F.col("id") % 17_000).cast("string").alias("k"))
    parts = coverage.distinct_sketches(df, ["g"], F.col("k"))
    whole = coverage.merge_sketches(parts).first()
    assert whole.n == 60_000 and abs(whole.different - 17_000) <= 0.025 * 17_000 and whole.repeated == whole.n - whole.different
    assert whole.different == coverage.merge_sketches(coverage.distinct_sketches(df, [], F.col("k"))).first().different
    exact = QUERIES["sql_dup_estimate"](spark, DATA).first()
    near = QUERIES["sql_dup_sketch"](spark, DATA).first()
    assert near.n == exact.n and abs(near.different - exact.different) <= 0.025 * exact.different


def test_cards_in_cards_and_open_ones(spark):
    html = """<div class="x card"><p data-field=price>R$ 1<br>000<div class=card><span data-field=price>2<b> x</b></span><i data-field=address>inner</i></div><em data-field=address>outer</em></div>
      <div class=card><b data-field=area>no price</b></div><div class=other><b data-field=price>no card</b></div><div class="card"><p data-field=price>3<p data-field=address>a &amp; b<img data-field=area><section><div class=card><u data-field=price>4"""
    df = spark.createDataFrame([(1, html), (2, "<div class=card><b data-field=price></b></div>"), (3, None), (4, "<div class=card data-field=price>5")], "page_id bigint, html string")
    got = [(r.page_id, r.position, r.price, r.address, r.area) for r in pages.extract_cards(df, pages.LISTING_CARD, pages.LISTING_FIELDS).collect()]
    assert got == [(1, 0, "R$ 1 000", "outer", "N/A"), (1, 1, "2 x", "inner", "N/A"), (1, 3, "3", "a & b", "N/A"), (1, 4, "4", "N/A", "N/A"), (4, 0, "5", "N/A", "N/A")]


def test_wide_files_with_guessed_columns(spark):
    heads = {
        "good": ["x,Data,Preço médio (R$/m²)"], "holds": ["x,Database,Preço médio (R$/m²)"], "spare": ["x,Data,Total geral,Custo"], "last": [",Data,Total geral"],
        "second": ["Preço médio (R$/m²),Dia,y"], "empty": [",,"],
    }
    lines = [(f, r, h[0] if r == 0 else ",,") for f, h in heads.items() for r in range(4)] + [(f, 4, "1,jan.-18,2") for f in heads]
    df = spark.createDataFrame(lines, "file string, record int, line string")
    rows, guessed = wide_index.load_with_report(df, 4)
    want = {"holds": ("holds the word", "headed"), "spare": ("headed", "first without total"), "last": ("headed", "last"), "second": ("second column", "headed"), "empty": ("none", "none")}
    assert {r.file: (r.date_rule, r.price_rule) for r in guessed.collect()} == want
    assert rows.count() >= 4


def test_landed_responses_that_are_broken(spark, tmp_path):
    a = [(1, "[]"), (2, None), (3, "[{"), (4, "{}"), (5, '[{"data":"01/02/2024","valor":1.5},{"data":"01/02/2024","valor":"1.234,5"},7,null,{"valor":"2"},{"data":"01/02/2024"}]'), (6, "null")]
    out = landed_json.outcomes_a(spark.createDataFrame(a, "id int, body string"), "body")
    assert [(r.id, str(r.date), r.value) for r in landed_json.accepted(out).collect()] == [(5, "2024-02-01", 1.5), (5, "2024-02-01", 1234.5)]
    assert {(r.id, r.reason, r.n) for r in landed_json.rejects(out, ["id"]).collect()} == {(2, "not json", 1), (3, "not json", 1), (4, "no list", 1), (6, "no list", 1), (5, "no date", 3), (5, "no value", 1)}
    c = [(1, '{"value":[{"SERCODIGO":"X","VALDATA":"2024-01-02T00:00:00Z","VALVALOR":"1.234,5"},{"VALDATA":"2024-01-02","VALVALOR":1e3},{"VALDATA":"2024-01-02","VALVALOR":"nan"},3]}'), (2, '{"value":3}'), (3, "[]"), (4, "x")]
    out = landed_json.outcomes_c(spark.createDataFrame(c, "id int, body string"), "body")
    assert [(r.code, r.value) for r in landed_json.accepted(out).collect()] == [("X", 1234.5), (None, 1000.0)]
    assert {(r.id, r.reason, r.n) for r in landed_json.rejects(out, ["id"]).collect()} == {(1, "no value", 1), (1, "no date", 1), (2, "no list", 1), (3, "no list", 1), (4, "not json", 1)}
    b = [(1, '[{"D1C":"4099","V":"1"},{"D2C":"2024","D1C":"2023","V":"2"},5,{"D1C":"2024","V":"-"},{"D1C":"202413","V":"3"}]'), (2, "{}"), (3, "[1"), (4, None), (5, "[]")]
    out = landed_json.outcomes_b(spark.createDataFrame(b, "id int, body string"), "body")
    assert [(r.period, r.value) for r in landed_json.accepted(out).collect()] == [("2024", 2.0)]  # the first key in the text's order, not the alphabet's
    assert {(r.id, r.reason, r.n) for r in landed_json.rejects(out, ["id"]).collect()} == {(1, "no object", 1), (1, "no period", 1), (1, "no value", 1), (1, "no date", 1), (2, "no list", 1), (3, "not json", 1), (4, "not json", 1)}
    landed_files.land(spark.createDataFrame([("t/1 x/2", b[0][1]), ("u", "[")], "path string, body string"), str(tmp_path / "l"))
    rows, bad = landed_files.load(landed_files.read(spark, str(tmp_path / "l")), landed_json.outcomes_b, ["path", "file"])
    assert [(r.path, r.value) for r in rows.collect()] == [("t/1 x/2", 2.0)] and {r.path for r in bad.collect()} == {"t/1 x/2", "u"}


def test_a_response_may_be_larger_than_a_variant(spark):
    filler = F.concat(F.lit('{"x":"'), F.repeat(F.lit("y"), F.lit(15_000_000)), F.lit('"},'))
    sheet = F.concat(F.lit("["), *[filler] * 9, F.lit('{"data":"01/02/2024","valor":"1,5","VALDATA":"2024-02-01","VALVALOR":1.5}]'))
    for outcomes, body in ((landed_json.outcomes_a, sheet), (landed_json.outcomes_c, F.concat(F.lit('{"value":'), sheet, F.lit("}")))):
        got = outcomes(spark.range(1).select(body.alias("body")), "body").select(F.col("date").cast("string"), "value", "reason").collect()
        assert sorted(map(tuple, got), key=str) == [("2024-02-01", 1.5, None)] + 9 * [(None, None, "no date")]


def test_a_landed_response_is_written_an_element_a_line(spark, tmp_path):
    for source in fixtures.ELEMENTS:
        root = tmp_path / source
        fixtures.landed(spark, DATA, source, str(root))
        files = {p.parent.name: p.read_text("utf-8") for p in root.glob("*/*.txt")}
        rows = fixtures.load(spark, DATA, fixtures.LANDED).groupBy("path").agg(F.max("broken").alias("broken"), F.count("*").alias("n")).collect()
        assert len(files) == len(rows) == len(list(root.glob("*/*.txt")))
        for r in rows:
            text = files["path=" + r.path.replace("/", "%2F")]
            assert len(text.splitlines()) == (1 if r.broken == "no list" else r.n)
            if r.broken is None:
                whole = json.loads(text)
                assert len(whole["value"] if source == "C" else whole) == r.n


def test_the_catalogue_says_how_a_response_is_read(spark):
    body = '[{"D1C":"2020","D1N":"Taxa de desocupação","D2C":"202401","V":"1","W":"8"},{"D1C":"x","D1N":"Renda","D2C":"20242","V":"2"}]'
    responses = spark.createDataFrame([("p", body), ("broken", "{")], "path string, body string")
    none = None
    series_ = [
        ("B", "rate", "n", "%", True, none, none, [("gone", none, none), ("broken", none, none), ("p", ["TAXA", "desocupacao"], "D2C")]),
        ("B", "found", "n", "%", none, none, none, [("p", ["taxa"], none)]), ("B", "income", "n", "R$", True, "Q", "V", [("p", ["nothing"], none), ("p", [], "D2C")]),
        ("B", "off", "n", "R$", False, none, none, [("p", [], none)]), ("B", "other value", "n", "R$", True, none, "W", [("p", [], "D2C")]), ("B", "none", "n", "u", True, none, none, [("gone", [], none)])]
    cat = spark.createDataFrame(series_, "source string, code string, name string, unit string, active boolean, frequency string, value_key string, candidates array<struct<path string, keywords array<string>, period_key string>>")
    got = {(r.code, r.month, r.value, r.frequency) for r in landed_files.series_by_catalogue(responses, cat).collect()}
    assert got == {("rate", "2024-01-01", 1.0, "M"), ("found", "2020-01-01", 1.0, "A"), ("income", "2024-01-01", 1.0, "Q"), ("income", "2024-04-01", 2.0, "Q"), ("other value", "2024-01-01", 8.0, "M")}


def test_missing_rows_are_errors_where_they_are_required(spark):
    long = spark.createDataFrame([(1, "a", None), (1, None, 2.0)], "month int, series string, value double")
    assert series.pivot_found(long).columns == ["month"]
    with pytest.raises(ValueError):
        series.pivot_found(long, require_rows=True)
    a, b = spark.createDataFrame([(1, 2)], "month int, x int"), spark.createDataFrame([(2, 2)], "month int, y int")
    assert series.join_months(a, b).count() == 0
    with pytest.raises(ValueError):
        series.join_months(a, b, require_rows=True)


def test_rows_get_defaults_and_the_time_of_writing(spark):
    df = spark.createDataFrame([("Todos", "price", 3)], "kind string, field string, n long").withColumns({"unit": F.lit("R$"), "mean": F.lit(1.0), "median": F.lit(1.0), "stddev": F.lit(None).cast("double")})
    once = sinks.stamped(df, "statistics")
    assert once.columns[-1] == "computed_at" and once.first().computed_at is not None
    again = sinks.stamped(once.withColumn("computed_at", F.lit("2020-01-01").cast("timestamp")), "statistics")
    assert again.first().computed_at.year == 2020 and sinks.stamped(spark.createDataFrame([(1, 2)], "segment int, page int"), "progress").columns == ["segment", "page"]


def test_contracts_name_columns_of_the_schemas():
    for name, (needed, unique) in sinks.CONTRACTS.items():
        columns = [x.rsplit(" ", 1)[0] for x in sinks.SCHEMAS[name].split(", ")]
        assert set(needed) | set(unique) <= set(columns)


def test_cards_are_handed_on_in_frames_of_bounded_size(spark, monkeypatch):
    """A worker holds no more rows than a frame's, however many cards its pages have."""
    df = spark.createDataFrame([(1, "<li><a href='x'>R$ 1</a></li>" * (3 * pages.ROWS + 5)), (2, "<li><a href='y'>R$ 2</a></li>")], "page_id int, html string")
    sizes = []
    monkeypatch.setattr(type(df), "mapInPandas", lambda self, run, schema: sizes.extend(len(x) for x in run([self.toPandas()])))
    pages.extract_cards(df)
    assert max(sizes) == pages.ROWS and sum(sizes) == 3 * pages.ROWS + 6
