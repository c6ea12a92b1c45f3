"""Headings that the rules meet only by another spelling or by a fallback, one file each."""

import pytest

from tijolo.sources import wide_index

CASES = {
    "date heading holds data": [",,Venda", ",,Preço médio (R$/m²)", ",Mês/Data base,Total"],
    "price without unit": [",,Venda", ",,Preco medio", ",Data,Total"],
    "price with lost letters": [",,Venda", ",,Pre�o m�dio", ",Data,Total"],
    "date is the second column": [",,Venda", ",,Preço médio (R$/m²)", ",Mês,Total"],
    "first without total": [",,Venda", ",,Valor", ",Data,x"],
    "last of totals": [",,Venda", ",,Valor", ",Data,Total"],
}


@pytest.mark.parametrize("name", CASES)
def test_date_and_price_are_found(spark, tmp_path, name):
    (tmp_path / "a.csv").write_text("\n".join([",,", *CASES[name], ',jan.-18,"4.586,5"', "Fonte: x"]), encoding="utf-8")
    out = wide_index.load(wide_index.read_lines(spark, str(tmp_path / "a.csv")), 3).collect()
    assert [(str(r.date), r.price_m2) for r in out] == [("2018-01-01", 4586.5)]


def test_other_spellings_of_measures(spark):
    heading = spark.createDataFrame([("a", 1, "data"), ("a", 2, "var mensal"), ("a", 3, "var em 12 meses"), ("a", 4, "rental yield"), ("a", 5, "preco medio")], "file string, column int, heading string")
    got = {r.column: r.output for r in wide_index.columns(heading).collect()}
    assert got == {1: "date", 2: "monthly_sale", 3: "yearly_sale", 4: "rent_yield", 5: "price_m2"}
