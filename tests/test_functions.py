import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.functions.formula import FormulaError, compile_formula


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_shares_of_tiers_sum_to_one(spark):
    df = spark.createDataFrame([(c, p) for c in (0, 1, 5, 12, 40) for p in (0, 3, 8, 100)], "c int, p int")
    w = S.tier_weights(F.col("c"), F.col("p"))
    for r in df.select((w[0] + w[1] + w[2]).alias("s")).collect():
        assert r.s == pytest.approx(1.0)


def test_clipping_keeps_null(spark):
    assert value(spark, S.winsorise(F.lit(None).cast("double"))) is None
    assert value(spark, S.winsorise(F.lit(9.0))) == 2.5


def test_erf_and_p_values(spark):
    for x in (-2.0, -0.3, 0.0, 0.7, 3.0):
        assert value(spark, S.erf(F.lit(x))) == pytest.approx(math.erf(x), abs=2e-7)
    assert value(spark, S.two_sided_p(F.lit(1.9599639845))) == pytest.approx(0.05, abs=1e-6)


def test_business_days(spark):
    for start, end in (("2024-01-01", "2024-01-31"), ("2024-02-03", "2024-02-04"), ("1969-12-20", "1970-01-09")):
        a, b = dt.date.fromisoformat(start), dt.date.fromisoformat(end)
        want = sum((a + dt.timedelta(k)).weekday() < 5 for k in range(1, (b - a).days + 1))
        assert value(spark, S.business_days(F.lit(start).cast("date"), F.lit(end).cast("date"))) == want


def test_money_rounds_halves_up(spark):
    assert value(spark, S.money(F.lit("2.675").cast("decimal(10,3)"))) == 2.68


def test_excerpts(spark):
    source = F.lit("Some  text\nof a filing")
    assert value(spark, S.verified_excerpt(source, F.lit("text of a"))) == "text of a"
    assert value(spark, S.verified_excerpt(source, F.lit("text of..."))) == "text of"
    assert value(spark, S.verified_excerpt(source, F.lit("another"))) is None
    assert value(spark, S.verified_excerpt(source, F.lit(" "))) is None


def test_quantity_bands(spark):
    for q, want in ((7.3, 7.3), (123.0, 120.0), (1850.0, 1900.0), (99.6, 100.0)):
        assert value(spark, S.quantity_band(F.lit(q))) == pytest.approx(want)


def test_formula_in_decimals(spark):
    x = {"n": F.lit("12345678901234.56").cast("decimal(18,2)")}
    f = compile_formula("max(n * '0.0010', 10) + n * '0.0015' - 1", x, exact=True)
    assert spark.range(1).select(f.cast("string")).first()[0] == "30864197252.086400"


def test_formula(spark):
    f = compile_formula("min(max(n * '0.0010', 10), 100) - -2 / (1 + 1)", {"n": F.lit(50_000.0)})
    assert value(spark, f) == pytest.approx(51.0)


@pytest.mark.parametrize("text", ["n * 0.5", "x + 1", "n ** 2", "import os", "min(n", "n; 1", "", "abs(n)"])
def test_formula_refuses(text):
    with pytest.raises(FormulaError):
        compile_formula(text, {"n": F.lit(1.0)})
