"""Quantities recorded in different units: read every statement of a unit, reconcile them, convert.

A pay bound obeys the identity  usd_year = amount x scale x currency factor x periods a year, and the two
bounds of a row are about the same amount. Currency, period and scale may each be stated several times in
a row: beside the amount, beside the other bound, in the unit fields. Every combination of statements for
both bounds is a candidate; the one with the least sum of log residuals, against all statements and, at
half their weight since the bounds differ anyway, between the two amounts, is taken, and a row where different factors tie is flagged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweft.operators.snapshots import BLANKS, stripped
from jobweft.operators.timestamps import held

# Spellings of currencies, as patterns on lower-case text; the longer spelling first.
CURRENCY_SPELLINGS = {
    "USD": r"us ?\$|us[ -]dollars?|usd",
    "CAD": r"ca\$|c\$|canadian dollars?|cad",
    "AUD": r"au\$|a\$|australian dollars?|aud",
    "JPY": r"jp¥|japanese yen|yen|jpy",
    "INR": r"₹|inr|rs\.?|(?:indian )?rupees?",
    "GBP": r"£|gbp|pounds? sterling|british pounds?|sterling|pence",
    "EUR": r"€|euros?|eur",
    "CHF": r"chf|sfr\.?|fr\.|swiss francs?|franken",
    "SEK": r"sek|swedish kron(?:a|or)",
    "PLN": r"zł|zl|pln|zlotys?|złotych",
}
# Marks of a currency other than those above, which must not be taken for the plain sign.
OTHER_DOLLARS = r"[a-z]{1,3}\$"
# Spellings of pay periods, as patterns on lower-case text.
PERIOD_SPELLINGS = {
    "yearly": r"per[- ]year|per annum|p\. ?a\.?|pa|lpa|years?|yearly|yr|annual(?:ly)?|annum|jahr(?:lich)?|jährlich|pro jahr|par an|al año|anual",
    "monthly": r"months?|monthly|mo|monat(?:lich)?|mensuel|par mois|mensual|al mes|pcm",
    "weekly": r"weeks?|weekly|wk|woche|wöchentlich|semaine|semana|pw",
    "daily": r"days?|daily|diem|tag|täglich|tagessatz|jour|día",
    "hourly": r"hours?|hourly|hr|h|stunde|stündlich|heure|hora",
}
# Scales named in a unit field, as patterns on lower-case text.
SCALE_SPELLINGS = {
    "0.01": r"cents?(?![a-z])|pence(?![a-z])|pennies",
    "1000": r"[kt](?=[a-z]{3}(?![a-z]))|thousands?|\(000s?\)|000s|tsd",
    "100000": r"lakhs?|lacs?(?![a-z])|lpa(?![a-z])",
    "1000000": r"millions?|mio(?![a-z])|mn(?![a-z])",
    "10000000": r"crores?|cr(?![a-z])",
}
# Scales written right behind an amount.
SUFFIX_SCALES = {"k": "1000", "lpa": "100000", "lakh": "100000", "lakhs": "100000", "l": "100000", "crore": "10000000", "cr": "10000000", "m": "1000000", "mio": "1000000"}

AMOUNT = r"(?<!\d)(?<!\d[.,'’])(\d+(?:\.\d+)?)(?![\d.,'’]*\d)(?: ?(k|lpa|lakhs?|l|crore|cr|mio|m)(?![a-z0-9]))?"


def _bounded(pattern: str) -> str:
    """The spelling as a word: letters may not go on around it, digits may (USD50)."""
    return rf"(?<![a-zÀ-ɏ])(?:{pattern})(?![a-zÀ-ɏ])"


def _first(text: Column, spellings: dict[str, str], bounded: bool = True) -> Column:
    """The key whose spelling starts first in the text, null if none does."""
    patterns = {k: _bounded(p) if bounded else rf"(?<![a-z])(?:{p})" for k, p in spellings.items()}
    found = [F.struct(F.nullif(F.regexp_instr(text, F.lit(p)), F.lit(0)).alias("at"), F.lit(k).alias("code")) for k, p in patterns.items()]
    return F.array_min(F.filter(F.array(*found), lambda x: x["at"].isNotNull()))["code"]


def currency_stated(text: Column, codes: list[str]) -> Column:
    """Code of the currency that a text names; a plain dollar sign is USD; 'other' for a currency that has no factor."""
    spellings = {c: CURRENCY_SPELLINGS.get(c, c.lower()) for c in codes}
    text = F.regexp_replace(text, rf"(?<![a-z])[kt](?=(?:{'|'.join(c.lower() for c in codes)})(?![a-z]))", "")
    return F.coalesce(
        _first(text, spellings), F.when(text.rlike(rf"(?<![a-z]){OTHER_DOLLARS}"), "other"), F.when(text.rlike(r"\$|(?<![a-z])dollars?(?![a-z])"), F.lit("USD")),
    )


def normal_numbers(text: Column) -> Column:
    """Thousands marks dropped and the decimal mark a point: exactly three digits follow the former, one or two the latter."""
    grouped = F.regexp_replace(text, r"(?<=\d)[ .,'’](?=\d{3}(?!\d))", "")
    return F.regexp_replace(grouped, r"(?<=\d),(?=\d{1,2}(?!\d))", ".")


def read_amounts(text: Column) -> Column:
    """Array of structs (amount string, suffix) in the order written; a sign before the first makes it no amount."""
    text = F.when(~text.rlike(r"^-\d"), text)
    return F.arrays_zip(F.regexp_extract_all(text, F.lit(AMOUNT), 1).alias("amount"), F.regexp_extract_all(text, F.lit(AMOUNT), 2).alias("suffix"))


def _units_of(curs: str, pers: str) -> Column:
    """Array of the distinct pairs (c, p) of a currency and a period that a bound's statements allow; one of nulls if there are none."""
    pairs = F.flatten(F.transform(F.array_distinct(curs), lambda c: F.transform(F.array_distinct(pers), lambda p: F.struct(c.alias("c"), p.alias("p")))))
    return F.when(F.size(pairs) > 0, pairs).otherwise(F.array(F.struct(F.lit(None).cast("string").alias("c"), F.lit(None).cast("string").alias("p"))))


def _apart(statements: str, chosen: Column, log_factor: Column) -> Column:
    """Sum of the log residuals of the statements against the one chosen."""
    return F.aggregate(statements, F.lit(0.0), lambda acc, s: acc + F.coalesce(F.abs(log_factor[chosen] - log_factor[s]), F.lit(0.0)))


def reconciled(d: DataFrame, logs: dict[str, Column], keep: list[str]) -> DataFrame:
    """The kept columns with _lo and _hi, the units (c, p) chosen for both bounds, residual and non_unique.

    Needs _v_min and _v_max, the log of each amount, and _cs_ and _ps_ of both, their statements, the nearest
    first. ``residual`` is what contradicts among the statements. Of equal sums the combination written first
    counts. Each step is computed once, and only for rows that contradict themselves.
    """
    plain = (F.size(F.array_distinct("_cs_min")) <= 1) & (F.size(F.array_distinct("_ps_min")) <= 1) & (F.size(F.array_distinct("_cs_max")) <= 1) & (F.size(F.array_distinct("_ps_max")) <= 1)
    used = [*keep, "_v_min", "_v_max", *[f"_{k}s_{n}" for k in "cp" for n in ("min", "max")]]
    first = lambda n: F.struct(F.get(f"_cs_{n}", F.lit(0)).alias("c"), F.get(f"_ps_{n}", F.lit(0)).alias("p"))
    d = held(d, *used, F.when(~plain, _units_of("_cs_min", "_ps_min")).alias("_xs"), F.when(~plain, _units_of("_cs_max", "_ps_max")).alias("_ys"))
    d = held(d, *used, F.flatten(F.transform("_xs", lambda x: F.transform("_ys", lambda y: F.struct(x.alias("x"), y.alias("y"))))).alias("_all"))
    factor = lambda u: F.coalesce(logs["currency"][u["c"]] + logs["interval"][u["p"]], F.lit(0.0))
    d = held(d, *used, F.transform("_all", lambda u, i: F.struct(
        (_apart("_cs_min", u["x"]["c"], logs["currency"]) + _apart("_ps_min", u["x"]["p"], logs["interval"]) + _apart("_cs_max", u["y"]["c"], logs["currency"]) + _apart("_ps_max", u["y"]["p"], logs["interval"])).alias("residual"),
        factor(u["x"]).alias("fx"), factor(u["y"]).alias("fy"), i.alias("place"), u["x"].alias("x"), u["y"].alias("y"))).alias("_each"))
    between = lambda u: F.coalesce(F.abs(F.col("_v_min") + u["fx"] - F.col("_v_max") - u["fy"]), F.lit(0.0))
    d = held(d, *used, F.transform("_each", lambda u: F.struct(F.round(u["residual"] + between(u) / 2, 9).alias("total"), u["place"].alias("place"), u.alias("u"))).alias("_scored"))
    d = held(d, *used, "_scored", F.array_min(F.transform("_scored", lambda s: F.struct(s["total"].alias("total"), s["place"].alias("place"), s["u"].alias("u")))).alias("_best"))
    other = lambda s: (F.abs(s["u"]["fx"] - F.col("_best.u.fx")) > 1e-9) | (F.abs(s["u"]["fy"] - F.col("_best.u.fy")) > 1e-9)
    return d.select(
        *keep, F.coalesce("_best.u.x", first("min")).alias("_lo"), F.coalesce("_best.u.y", first("max")).alias("_hi"), F.coalesce(F.round("_best.u.residual", 9), F.lit(0.0)).alias("residual"),
        F.coalesce(F.exists("_scored", lambda s: (s["total"] <= F.col("_best.total")) & other(s)), F.lit(False)).alias("non_unique"))


def pay_per_year(
    df: DataFrame,
    units: DataFrame,
    *,
    key: str = "id",
    low: str = "salary_min",
    high: str = "salary_max",
    currency: str = "salary_currency",
    interval: str = "salary_interval",
    max_units: int = 1000,
) -> DataFrame:
    """Rows (key, bound 'min' or 'max', usd_year, residual, non_unique), distinct.

    ``units`` (unit_type, unit_code, factor) is a small dictionary and is read by the driver; more than
    ``max_units`` rows raise ValueError. A field with two amounts is a range and gives both bounds, but a
    bound's own field goes first. An amount without a scale beside one with a scale in the other bound
    takes whichever of the two scales leaves the smaller log ratio between the bounds. Where the other
    statements contradict one another both bounds are reconciled together as the module describes:
    ``residual`` is the sum of what the statements differ from those taken, ``non_unique`` marks ties between
    different factors, where the statement nearest to the amount was taken. Nothing that no statement says is tried. Null, empty, wordy or non-positive
    amounts and rows without a readable currency or period give nothing, as does a number that no rule
    reads, such as 1,2345. Repeated rows give one. Very long texts are read whole.
    """
    rows = units.select("unit_type", "unit_code", F.col("factor").cast("decimal(20,8)").alias("factor")).limit(max_units + 1).collect()
    if len(rows) > max_units:
        raise ValueError("the unit dictionary is larger than max_units")
    factors = {kind: {r["unit_code"]: r["factor"] for r in rows if r["unit_type"] == kind and r["factor"] and r["factor"] > 0} for kind in ("currency", "interval")}
    if not factors["currency"] or not factors["interval"]:
        return df.sparkSession.createDataFrame([], f"{key} {dict(df.dtypes)[key]}, bound string, usd_year bigint, residual double, non_unique boolean")
    number = {k: F.create_map(*[F.lit(x) for c, v in f.items() for x in (c, v)]) for k, f in factors.items()}
    logs = {k: F.create_map(*[F.lit(x) for c, v in f.items() for x in (c, float(v.ln()))]) for k, f in factors.items()}
    codes, periods = list(factors["currency"]), {c: PERIOD_SPELLINGS.get(c, c.lower()) for c in factors["interval"]}

    text = {n: F.lower(stripped(F.regexp_replace(F.col(c), BLANKS, " "))) for n, c in (("lo", low), ("hi", high), ("cur", currency), ("per", interval))}
    d = df.where(F.col(low).rlike(r"\d") | F.col(high).rlike(r"\d")).select(F.col(key), *[t.alias(f"_{n}") for n, t in text.items()])
    d = d.withColumns({f"_{n}": normal_numbers(F.col(f"_{n}")) for n in ("lo", "hi")})
    d = d.withColumns({f"_a_{n}": read_amounts(F.col(f"_{n}")) for n in ("lo", "hi")} | {
        f"_c_{n}": currency_stated(F.col(f"_{n}"), codes) for n in ("lo", "hi", "cur")} | {
        "_p_lo": _first(F.col("_lo"), periods), "_p_hi": _first(F.col("_hi"), periods),
        "_p_per": _first(F.translate("_per", "-_", "  "), periods), "_s_cur": _first(F.col("_cur"), SCALE_SPELLINGS, bounded=False)})
    at = lambda n, i: F.get(F.col(f"_a_{n}"), F.lit(i))
    d = d.withColumns({
        "_min": F.coalesce(at("lo", 0), F.when(F.size("_a_hi") >= 2, at("hi", 0))),
        "_max": F.coalesce(F.when(F.size("_a_hi") >= 2, at("hi", 1)), at("hi", 0), at("lo", 1)),
    })
    suffix = F.create_map(*[F.lit(x) for k, v in SUFFIX_SCALES.items() for x in (k, v)])
    d = d.withColumns({f"_k_{b}": F.coalesce(suffix[F.col(f"_{b}.suffix")], F.lit("1")).cast("decimal(12,2)") for b in ("min", "max")})
    value = lambda b: F.col(f"_{b}.amount").try_cast("decimal(18,4)")
    log = lambda c: F.ln(F.when(c > 0, c.cast("double")))
    # a scale written once may hold for both amounts: the smaller log ratio between the bounds decides
    apart = F.abs(log(value("min") * F.col("_k_min")) - log(value("max") * F.col("_k_max")))
    shared = F.greatest("_k_min", "_k_max")
    together = F.abs(log(value("min") * shared) - log(value("max") * shared))
    joint = (F.least("_k_min", "_k_max") == 1) & (together < apart)
    field_scale = F.coalesce(F.col("_s_cur"), F.lit("1")).cast("decimal(12,2)")

    def amount(name: str) -> Column:
        scale = F.when(joint, shared).otherwise(F.col(f"_k_{name}"))
        # a scale beside the amount is the same statement as one in the currency field, not a second one
        return (value(name) * F.when(scale == 1, field_scale).otherwise(scale)).cast("decimal(24,4)")

    def stated(kind: str, field: str, own: str, other: str) -> Column:
        """The statements of a unit for one bound, the nearest first; 'other' stands for a currency without a factor."""
        return F.array_compact(F.array(f"_{kind}_{own}", f"_{kind}_{field}", f"_{kind}_{other}"))

    d = held(d, key, *[amount(n).alias(f"_amount_{n}") for n in ("min", "max")], *[
        stated(kind, field, own, other).alias(f"_{kind}s_{name}") for kind, field in (("c", "cur"), ("p", "per")) for name, own, other in (("min", "lo", "hi"), ("max", "hi", "lo"))])
    read = lambda n: (F.col(f"_amount_{n}") > 0) & (F.size(f"_cs_{n}") > 0) & (F.size(f"_ps_{n}") > 0) & (F.get(f"_cs_{n}", F.lit(0)) != "other")
    d = held(d, *[F.col(c) for c in d.columns], *[F.coalesce(read(n), F.lit(False)).alias(f"_read_{n}") for n in ("min", "max")]).where("_read_min OR _read_max")
    none = F.array().cast("array<string>")
    d = held(d, key, "_amount_min", "_amount_max", "_read_min", "_read_max", *[F.when(F.col(f"_read_{n}"), F.ln(F.col(f"_amount_{n}").cast("double"))).alias(f"_v_{n}") for n in ("min", "max")], *[
        F.when(F.col(f"_read_{n}"), F.filter(f"_{k}s_{n}", lambda c: c != "other")).otherwise(none).alias(f"_{k}s_{n}") for k in "cp" for n in ("min", "max")])
    d = reconciled(d, logs, [key, "_amount_min", "_amount_max", "_read_min", "_read_max"])
    bound = lambda n, u: F.struct(F.lit(n).alias("bound"), F.when(F.col(f"_read_{n}"), F.col(f"_amount_{n}")).alias("amount"), F.col(u).alias("unit"))
    d = d.select(key, "residual", "non_unique", F.explode(F.array(bound("min", "_lo"), bound("max", "_hi"))).alias("_b")).where("_b.amount IS NOT NULL")
    exact = F.round(F.col("_b.amount") * number["currency"][F.col("_b.unit.c")].cast("decimal(20,8)") * number["interval"][F.col("_b.unit.p")].cast("decimal(12,4)"), 0)
    return d.select(key, "_b.bound", exact.cast("bigint").alias("usd_year"), "residual", "non_unique").distinct()
