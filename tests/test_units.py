import pytest

from jobweft.operators.units import pay_per_year

UNITS = [("currency", "USD", 1.0), ("currency", "EUR", 1.08), ("currency", "GBP", 1.27), ("currency", "CAD", 0.73), ("currency", "INR", 0.012), ("currency", "CHF", 1.13), ("currency", "JPY", 0.0067),
         ("interval", "yearly", 1.0), ("interval", "monthly", 12.0), ("interval", "hourly", 2080.0), ("interval", "daily", 260.0), ("interval", "weekly", 52.0)]
SCHEMA = "id bigint, salary_min string, salary_max string, salary_currency string, salary_interval string, bound string"

CASES = [
    (("50000", "60,000", "USD", "yearly"), {"min": 50000, "max": 60000}),
    (("€31", "€33,75", None, "hourly"), {"min": 69638, "max": 75816}),
    (("USD 73200-USD 92900 p.a.", None, None, None), {"min": 73200, "max": 92900}),
    (("$70.1k – $76 400/yr", None, None, None), {"min": 70100, "max": 76400}),
    (("$50-70k a year", None, None, None), {"min": 50000, "max": 70000}),
    (("36.9", "40.9", "kUSD", "yearly"), {"min": 36900, "max": 40900}),
    (("2825", "4400", "GBP pence", "hr"), {"min": 74625, "max": 116230}),
    (("29.7 LPA", "39.2 LPA", "₹", None), {"min": 35640, "max": 47040}),
    (("38.800 per annum", "48.5k per annum", "Euro", None), {"min": 41904, "max": 52380}),
    (("10'289'100", "87 000", "JPY", "per annum"), {"min": 68937, "max": 583}),
    (("Fr.45000 – Fr.63,000 per annum", None, "Fr.", None), {"min": 50850, "max": 71190}),
    (("C$24800", None, None, "p.a."), {"min": 18104}),
    (("24 USD/hr", "30", None, None), {"min": 49920, "max": 62400}),
    (("NZ$50000", None, None, "yearly"), {}),
    (("1,2345", None, "USD", "yearly"), {}),
    (("DOE", "n/a", "USD", "yearly"), {}),
    (("0", "-5", "USD", "yearly"), {}),
    (("50000", None, None, "yearly"), {}),
    (("50000", None, "USD", ""), {}),
    ((None, None, None, None), {}),
    (("", "", "", ""), {}),
    (("x" * 100_000 + " 50000", None, "USD", "yearly"), {"min": 50000}),
]


@pytest.fixture(scope="module")
def results(spark):
    units = spark.createDataFrame(UNITS, "unit_type string, unit_code string, factor double")
    df = spark.createDataFrame([(i, *c[0], "clash") for i, c in enumerate(CASES) for _ in range(2)], SCHEMA)
    out = {i: {} for i in range(len(CASES))}
    rows = pay_per_year(df, units).collect()
    for r in rows:
        out[r["id"]][r["bound"]] = r["usd_year"]
    assert len(rows) == sum(len(x) for x in out.values())  # repeated rows give one
    return out


@pytest.mark.parametrize("i", range(len(CASES)))
def test_case(results, i):
    assert results[i] == CASES[i][1], CASES[i][0]


def test_conflicting_statements_are_flagged(spark):
    units = spark.createDataFrame(UNITS, "unit_type string, unit_code string, factor double")
    df = spark.createDataFrame([(1, "EUR 50000", None, "GBP", "yearly", ""), (2, "EUR 50000", "EUR 60000", "GBP", "yearly", ""), (3, "EUR 5000", None, "EUR", "monthly", "")], SCHEMA)
    got = {(r["id"], r["bound"]): (r["usd_year"], r["non_unique"]) for r in pay_per_year(df, units).collect()}
    assert got[1, "min"] == (54000, True) and got[2, "min"] == (54000, False) and got[3, "min"] == (64800, False)


def test_empty(spark):
    units = spark.createDataFrame(UNITS, "unit_type string, unit_code string, factor double")
    assert pay_per_year(spark.createDataFrame([], SCHEMA), units).count() == 0
    assert pay_per_year(spark.createDataFrame([(1, "5", None, "USD", "yearly", "")], SCHEMA), units.limit(0)).count() == 0
    with pytest.raises(ValueError):
        pay_per_year(spark.createDataFrame([], SCHEMA), units, max_units=3)


def test_round_trip_of_generated_statements(spark):
    """Amounts written in many ways come back as the exact product, rounded half up."""
    import random
    from decimal import ROUND_HALF_UP, Decimal

    rng = random.Random(11)
    factors = {c: Decimal(str(f)) for k, c, f in UNITS if k == "currency"}
    periods = {c: Decimal(str(f)) for k, c, f in UNITS if k == "interval"}
    named = {"USD": ["$", "US$", "usd ", "US Dollar "], "EUR": ["€", "EUR ", "Euros "], "GBP": ["£", "gbp ", "Pound Sterling "], "CAD": ["C$", "CA$", "CAD "], "INR": ["₹", "Rs.", "INR "], "CHF": ["Fr.", "chf "], "JPY": ["JP¥", "jpy "]}
    spelled = {"yearly": ["p.a.", " per annum", "/yr", " annually"], "monthly": ["/mo", " per month", " pro Monat"], "hourly": ["/hr", " an hour", " hourly"], "daily": ["/day", " per diem"], "weekly": [" per week", "/wk"]}

    def written(n: Decimal) -> str:
        whole, _, cents = f"{n:f}".partition(".")
        if cents:
            return f"{whole}{rng.choice('.,')}{cents}"
        if n >= 1000 and n % 100 == 0 and rng.random() < 0.3:
            return f"{n / 1000:f}" + rng.choice("kK")
        mark = rng.choice(["", ",", ".", " ", " ", " ", "'", "’"])
        return f"{int(whole):,}".replace(",", mark)

    rows, want = [], {}
    for i in range(400):
        cur, per = rng.choice(list(named)), rng.choice(list(spelled))
        low = Decimal(rng.randint(20, 90_000)) if rng.random() < 0.6 else Decimal(rng.randint(1000, 9900)) / 100
        high = low + rng.randint(0, 50)
        if low != int(low):
            high = low
        in_text_c, in_text_p, as_range = rng.random() < 0.5, rng.random() < 0.5, rng.random() < 0.3
        one = lambda n: (rng.choice(named[cur]) if in_text_c else "") + written(n)  # noqa: E731, B023
        tail = rng.choice(spelled[per]) if in_text_p else ""
        if as_range:
            fields = (one(low) + rng.choice([" - ", "–", " to "]) + one(high) + tail, None)
        else:
            fields = (one(low) + tail, one(high) + tail)
        rows.append((i, *fields, None if in_text_c else cur, None if in_text_p else per, ""))
        for b, n in (("min", low), ("max", high)):
            want[i, b] = int((n * factors[cur] * periods[per]).quantize(Decimal(1), ROUND_HALF_UP))
    units = spark.createDataFrame(UNITS, "unit_type string, unit_code string, factor double")
    got = {(r["id"], r["bound"]): r["usd_year"] for r in pay_per_year(spark.createDataFrame(rows, SCHEMA), units).collect()}
    wrong = {k: (got.get(k), v, rows[k[0]]) for k, v in want.items() if got.get(k) != v}
    assert not wrong, list(wrong.items())[:5]


CONFLICTS = {
    # low an hour, high a year, field a year: the amounts agree only so
    1: (("25 / hour", "60000", "USD", "yearly"), {("min", 52000), ("max", 60000)}, False),
    # two currencies for one amount and nothing to choose by: the one beside it, flagged
    2: (("EUR 50000", None, "GBP", "yearly"), {("min", None)}, True),
    # the field's currency against that of both amounts: two statements outweigh one
    3: (("$50,000", "$60,000", "EUR", "yearly"), {("min", 50000), ("max", 60000)}, False),
    # the other bound names the period that makes the amounts meet
    4: (("4000 monthly", "50000 yearly", "USD", None), {("min", 48000), ("max", 50000)}, False),
    5: (("50000", "60000", "USD", "yearly"), {("min", 50000), ("max", 60000)}, False),
}


def test_contradicting_statements_are_reconciled_by_the_amounts(spark):
    units = spark.createDataFrame([("currency", "USD", 1.0), ("currency", "EUR", 1.1), ("currency", "GBP", 1.3), ("interval", "yearly", 1.0), ("interval", "monthly", 12.0), ("interval", "hourly", 2080.0)], "unit_type string, unit_code string, factor double")
    df = spark.createDataFrame([(k, *v[0]) for k, v in CONFLICTS.items()], "id int, salary_min string, salary_max string, salary_currency string, salary_interval string")
    rows = pay_per_year(df, units).collect()
    for k, (_, want, unsure) in CONFLICTS.items():
        mine = [r for r in rows if r["id"] == k]
        assert {(r["bound"], r["usd_year"]) for r in mine} == {(b, 55000 if v is None else v) for b, v in want}, (k, mine)
        assert {r["non_unique"] for r in mine} == {unsure} and all((r["residual"] > 0) == (k != 5) for r in mine), (k, mine)
