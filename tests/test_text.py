import datetime as dt

import pytest
from pyspark.sql import functions as F

from tijolo.functions import text as T

D = dt.date
CASES = [
    (T.classify_kind, [("APARTAMENTO x", "Apartamento"), ("Sobrado", "Casa"), ("Lote 7", "Terreno"), ("Sala", "Outro"), (None, "Outro")]),
    (T.extract_number, [("1.200 m²", 1200.0), ("85,5 m²", 85.0), ("120-150", 120.0), ("N/A", None), (" ", None), (None, None)]),
    (T.clean_price, [("R$ 450.000 Cond. R$ 500", 450000.0), ("R$ 1.200.000 IPTU R$ 90", 1200000.0), ("Sob consulta", None), ("R$ 450.000,00", 45000000.0), (None, None)]),
    (T.parse_number, [("1.234,5", 1234.5), ("0,5", 0.5), ("1.5", 1.5), ("...", None), ("-", None), ("1d", None), ("nan", None), (" 7 ", 7.0), (None, None)]),
    (T.ptbr_number, [("4.586", 4586.0), (" -0,08%", -0.08), ("+0,27%", 0.27), (".", None), ("", None), (None, None)]),
    (T.ptbr_month, [("jan.-18", D(2018, 1, 1)), ("DEZ.-08", D(2008, 12, 1)), ("abc-18", None), ("jan18", None), ("jan.-2018", None), (None, None)]),
    (T.brazilian_date, [("31/12/2024", D(2024, 12, 31)), ("31/13/2024", None), ("30/02/2024", None), ("1/2/2024", D(2024, 2, 1)), ("1/2/24", None), ("", None), (None, None)]),
    (T.iso_date, [("2024-01-02T23:00:00-03:00", D(2024, 1, 2)), ("2024-01-02", D(2024, 1, 2)), ("2024-01-02T00:00:00Z", D(2024, 1, 2)), ("", None)]),
    (T.period_frequency, [("20240102", "D"), ("202401", "M"), ("20241", "Q"), ("2024", "A"), ("1", "M")]),
    (T.period_date, [("20240102", D(2024, 1, 2)), ("202402", D(2024, 2, 1)), ("20243", D(2024, 7, 1)), ("20249", D(2024, 1, 1)), ("2024", D(2024, 1, 1)), ("202413", None), ("1989", None), ("x", None), ("2024-03", D(2024, 3, 1)), (" 2024/1 ", D(2024, 1, 1)), ("", None), (None, None)]),
    (T.fold_accents, [("Construção MÊS", "construcao mes"), ("Ýpsilōn", "ypsilon"), ("e\u0301 n\u0303", "e n"), ("ﬁm ½ m² ㎡ Ⅷ ß", "fim 1⁄2 m2 m2 viii ß"), ("한글 é", "한글 e"), ("", ""), (None, None)]),
]


@pytest.mark.parametrize("f,cases", CASES, ids=[f.__name__ for f, _ in CASES])
def test_expression(spark, f, cases):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    assert [r.v for r in df.select("i", f(F.col("t")).alias("v")).orderBy("i").collect()] == [v for _, v in cases]


def test_every_letter_is_folded_as_its_decomposition(spark):
    """All letters but Hangul syllables, against the decomposition of Python's tables."""
    import sys
    import unicodedata

    letters = [c for c in map(chr, range(0x80, sys.maxunicode + 1)) if unicodedata.category(c)[0] in "LN" and not "\uac00" <= c <= "\ud7a3" and not unicodedata.combining(c)]
    df = spark.createDataFrame([(c,) for c in letters], "t string")
    plain = lambda c: "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
    got = {r.t: r.v for r in df.select("t", T.fold_accents(F.col("t")).alias("v")).collect()}
    wrong = [c for c in letters if got[c] not in (plain(c).lower(), c.lower(), plain(c).casefold())]
    assert wrong == []
    assert df.where("t = 'Ⅷ'").select(T.matches_folded(F.lit("Construção da CASA"), F.lit("construcao")).alias("m")).first().m


def test_dates_of_all_days(spark):
    df = spark.sql("select explode(sequence(date'1990-01-01', date'2035-12-31')) d")
    for form, f in (("yyyyMMdd", T.period_date), ("dd/MM/yyyy", T.brazilian_date), ("yyyy-MM-dd", T.iso_date)):
        assert df.where(~f(F.date_format("d", form)).eqNullSafe(F.col("d"))).count() == 0
