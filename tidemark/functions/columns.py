"""Column expressions for the scalar operators (P-series).

All helpers return ``Column`` objects built from built-in functions, so
they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "SEASON_MONTHS", "WIND_DIRECTIONS", "season_of_month", "season_of_date",
    "map_values", "yes_no_flag", "round_key", "confidence_band",
    "split_name", "split_dir_name", "split_end_year", "parse_date",
    "anchored_any", "pct",
]

# Southern-hemisphere seasons by calendar month.
SEASON_MONTHS = {
    "Summer": (12, 1, 2),
    "Autumn": (3, 4, 5),
    "Winter": (6, 7, 8),
    "Spring": (9, 10, 11),
}
SEASONS = ["Summer", "Autumn", "Winter", "Spring"]

# The 16 compass directions accepted for wind direction.
WIND_DIRECTIONS = ["N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE",
                   "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW"]


def season_of_month(month: Column) -> Column:
    """Month number -> season name (anything else -> Spring, as the rule's else-branch)."""
    return (F.when(month.isin(*SEASON_MONTHS["Summer"]), "Summer")
            .when(month.isin(*SEASON_MONTHS["Autumn"]), "Autumn")
            .when(month.isin(*SEASON_MONTHS["Winter"]), "Winter")
            .otherwise("Spring"))


def season_of_date(d: Column) -> Column:
    return season_of_month(F.month(d))


def map_values(c: Column, mapping: dict) -> Column:
    """Value map; values outside the mapping become NULL."""
    out = None
    for k, v in mapping.items():
        out = F.when(c == F.lit(k), F.lit(v)) if out is None else out.when(c == F.lit(k), F.lit(v))
    return out


def yes_no_flag(c: Column) -> Column:
    """P7: 'No' -> 0, 'Yes' -> 1, anything else -> NULL."""
    return map_values(c, {"No": 0, "Yes": 1}).cast("int")


def round_key(c: Column) -> Column:
    """Round half-to-even, then cast to int (pandas ``round().astype(int)``)."""
    return F.bround(c, 0).cast("int")


def confidence_band(p: Column) -> Column:
    """Distance of a probability from 0.5 -> High / Medium / Low."""
    d = F.abs(p - F.lit(0.5))
    return F.when(d > 0.3, "High").when(d > 0.15, "Medium").otherwise("Low")


def split_name(start_year: Column, end_year: Column) -> Column:
    """P19: 'YYYY' for a one-year split, else 'YYYY-YYYY'."""
    return F.when(start_year == end_year, end_year.cast("string")).otherwise(
        F.concat(start_year.cast("string"), F.lit("-"), end_year.cast("string")))


def split_dir_name(split_id: Column, start_year: Column, end_year: Column) -> Column:
    """P19: 'split_{id:02d}_{name}'."""
    return F.format_string("split_%02d_%s", split_id, split_name(start_year, end_year))


def split_end_year(dir_name: Column) -> Column:
    """P19 parse: the last year of a split directory name."""
    return F.regexp_extract(dir_name, r"(\d{4})$", 1).cast("int")


def parse_date(c: Column, fmt: str = "yyyy-MM-dd") -> Column:
    """Strict date parse; malformed text -> NULL instead of an error."""
    return F.try_to_timestamp(c, F.lit(fmt)).cast("date")


def anchored_any(c: Column, values) -> Column:
    """Anchored alternation ``^(a|b|...)$`` -- an exact-membership test."""
    return c.isin(*values)


def pct(part: Column, total: Column, digits: int = 4) -> Column:
    """Share rounded for reporting."""
    return F.round(part / total, digits)
