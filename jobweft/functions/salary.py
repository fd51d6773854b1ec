"""Pay stated in running text: six shapes tried in order; the first match of a shape counts if its range is plausible."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Currency of a sign or code.
CURRENCIES = {"$": "USD", "£": "GBP", "€": "EUR", "A$": "AUD", "C$": "CAD"}
CODES = "USD|GBP|EUR|AUD|CAD|CHF|SGD|INR|JPY|CNY|BRL|MXN|ZAR"
KNOWN_CODES = "USD GBP EUR AUD CAD CHF SGD HKD NZD INR JPY CNY KRW BRL MXN ZAR PLN SEK NOK DKK".split()
# Least plausible amount of a period, and the greatest of all.
FLOORS = {"hourly": 5, "weekly": 100, "monthly": 500, "yearly": 10_000}
CEILING = 50_000_000
# Periods named within 60 characters before and 80 behind.
PERIODS = [(r"per\s*hour|hourly|/\s*h(?:ou)?r|an\s*hour", "hourly"), (r"per\s*month|monthly|/\s*month|/\s*mo\b", "monthly"), (r"per\s*week|weekly|/\s*week", "weekly")]

_N, _N2, _S = r"(\d{1,3}(?:,\d{3})*(?:\.\d+)?)", r"(\d{1,3}(?:,\d{3})*(?:\.\d{1,2})?)", r"([$£€]|[AC]\$)"
# The shapes, and which group holds the lower and upper amount, currency, and the thousands marks.
SHAPES = [
    (rf"[Mm]inim(?:um)?\s*[Ss]alary\s*[:=]?\s*{_N}\s*(USD|GBP|EUR|[A-Z]{{3}})?\s*(?:[-–—]|[Mm]axim(?:um)?\s*[Ss]alary\s*[:=]?\s*){_N}\s*(USD|GBP|EUR|[A-Z]{{3}})?", 1, 3, (2, 4), (), "yearly"),
    (rf"{_S}\s*{_N2}\s*([kK])?\s*(?:[-–—]|to)\s*(?:[$£€]|[AC]\$)?\s*{_N2}\s*([kK])?", 2, 4, (1,), (3, 5), None),
    (rf"{_N}\s*([kK])?\s*({CODES})\s*(?:[-–—]|to)\s*{_N}\s*([kK])?\s*(?:{CODES})?", 1, 4, (3,), (2, 5), None),
    (rf"(?i)(?:salary|compensation|pay|base|total\s*comp|starting\s*at|up\s*to|earning)\s*(?:range\s*)?(?:of\s*|is\s*|:\s*|=\s*)?{_S}\s*{_N2}\s*([kK])?", 2, 2, (1,), (3, 3), None),
    (rf"(?i)(?:salary|compensation|pay|base|earn)\s*(?:range\s*)?(?:of\s*|is\s*|:\s*|=\s*)?{_N}\s*([kK])?\s*(USD|GBP|EUR|AUD|CAD|CHF|SGD|INR)", 1, 1, (3,), (2, 2), "yearly"),
    (rf"(?i)(?:pay\s*range|hourly\s*rate|rate)\s*[:=]?\s*([$£€])\s*{_N2}\s*[-–—to]+\s*(?:[$£€])?\s*{_N2}", 2, 3, (1,), (), None),
]


def salary_in_text(text: Column) -> Column:
    """Struct (low, high, currency, interval) or null. Amounts must be grouped by commas, so $120000 is no amount of six digits."""
    tries = []
    codes = F.create_map(*[F.lit(x) for k, v in {**CURRENCIES, **{c: c for c in KNOWN_CODES}}.items() for x in (k, v)])
    for shape, low_at, high_at, currency_at, thousands, interval in SHAPES:
        part = lambda i, s=shape: F.nullif(F.regexp_extract(text, s, i), F.lit(""))
        number = lambda i: F.regexp_replace(part(i), ",", "").try_cast("double")  # noqa: E731, B023
        k_low = F.when(part(thousands[0]).isNotNull(), 1000).otherwise(1) if thousands else F.lit(1)
        k_high = F.when(part(thousands[1]).isNotNull() | part(thousands[0]).isNotNull(), 1000).otherwise(1) if thousands else F.lit(1)
        at = F.regexp_instr(text, F.lit(shape))
        around = F.lower(F.substring(text, F.greatest(at - 60, F.lit(1)), F.length(part(0)) + F.least(at - 1, F.lit(60)) + 80))
        period = F.lit(interval) if interval else F.when(around.rlike(PERIODS[0][0]), "hourly").when(around.rlike(PERIODS[1][0]), "monthly").when(around.rlike(PERIODS[2][0]), "weekly").otherwise("yearly")
        code = codes[F.upper(F.coalesce(*[part(i) for i in currency_at]))]
        # the groups of a shape are taken only where it occurs at all
        tries.append(F.when(text.rlike(shape), F.struct((number(low_at) * k_low).alias("low"), (number(high_at) * k_high).alias("high"), F.coalesce(code, F.lit("USD")).alias("currency"), period.alias("interval"))))
    floors = F.create_map(*[F.lit(x) for k, v in FLOORS.items() for x in (k, v)])
    return F.get(F.filter(F.array(*tries), lambda s: s["low"].isNotNull() & (s["low"] <= s["high"]) & (s["high"] <= CEILING) & (s["low"] >= floors[s["interval"]])), F.lit(0))
