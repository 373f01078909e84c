"""Short forms of numbers for figures and reports, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dimension_label(d) -> Column:
    """2048 to "2,048 dimensions (2 KB)"."""
    return F.concat(F.format_number(d, 0), F.lit(" dimensions ("), F.floor(d / 1024).cast("string"), F.lit(" KB)"))


def count_label(x) -> Column:
    """A count in thousands, millions or billions."""
    out = None
    for size, suffix in ((1e9, "B"), (1e6, "M"), (1e3, "K")):
        value = F.concat(F.format_number(x / size, 0), F.lit(suffix))
        out = F.when(x >= size, value) if out is None else out.when(x >= size, value)
    return out.otherwise(F.format_number(x, 0))


def percent_label(x) -> Column:
    """A chance in per cent: whole from 10 per cent on, one decimal below."""
    return F.when(x >= 0.1, F.concat(F.format_number(x * 100, 0), F.lit("%"))).otherwise(F.concat(F.format_number(x * 100, 1), F.lit("%")))


def chance_label(x) -> Column:
    """A chance: "0", a power of ten when tiny, else per cent with one decimal."""
    return F.when(x == 0, "0").when(x < 1e-3, F.format_string("%.1e", x)).otherwise(F.concat(F.format_number(x * 100, 1), F.lit("%")))


def json_list(values) -> Column:
    """A list in JSON with a space after each comma."""
    return F.concat(F.lit("["), F.concat_ws(", ", F.transform(values, lambda v: v.cast("string"))), F.lit("]"))
