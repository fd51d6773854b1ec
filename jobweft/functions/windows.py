"""Posted windows such as 7d, last_24h or past-week, and dates of feeds."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units of a window in seconds, by their spellings.
UNITS = {"hours": (3600, "h hr hrs hour hours"), "days": (86_400, "d day days"), "weeks": (604_800, "w wk wks week weeks"), "months": (2_592_000, "m mo mon month months")}


@dataclass(frozen=True)
class Window:
    n: int
    unit: str

    @property
    def seconds(self) -> int:
        return self.n * UNITS[self.unit][0]


def parse_window(value: str | None) -> Window | None:
    """A count, one if missing, and a unit, after an optional last or past; null if it is neither."""
    text = re.sub(r"[\s_-]+", " ", re.sub(r"^(?:last|past)[\s_-]+", "", str(value or "").strip().lower())).strip()
    match = re.fullmatch(r"(\d+)?\s*([a-z]+)", text)
    if not match:
        return None
    n = int(match[1]) if match[1] else 1
    unit = next((u for u, (_, names) in UNITS.items() if match[2] in names.split()), None)
    return Window(n, unit) if unit and n > 0 else None


def within(column: Column, value: str | None, as_of: str) -> Column:
    """Rows of the window that ends at as_of; an unreadable window filters nothing."""
    window = parse_window(value)
    return F.lit(True) if window is None else column >= F.expr(f"TIMESTAMP_NTZ '{as_of}' - INTERVAL '{window.n}' {window.unit[:-1]}")


def epoch_or_null(number: Column) -> Column:
    """Epoch seconds below 1e11, else milliseconds, as a timestamp."""
    n = number.try_cast("double")
    return F.when(n < 1e11, F.timestamp_seconds(n)).otherwise(F.timestamp_millis(n.try_cast("long")))
