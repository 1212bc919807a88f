"""Labels, number formats and colour scales of the map and the dashboards, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Colours, thresholds and widths.
TRAFFIC_RGB = [(34, 197, 94), (234, 179, 8), (249, 115, 22), (239, 68, 68)]
TRAFFIC_MOST = 10_000
WEIGHT_LEAST, WEIGHT_SPAN = 1.0, 2.5
GAP_RGB, GAP_HOURS = ((99, 102, 241), (239, 68, 68)), 48
DRAUGHT_COLOURS = [(10, "#ef4444"), (7, "#f97316"), (5, "#eab308"), (0, "#22c55e")]
NO_DRAUGHT = "#64748b"
VISIT_COLOURS = [(100, "#3b82f6"), (50, "#60a5fa"), (20, "#93c5fd")]
FEW_VISITS = "#cbd5e1"
TYPE_COLOURS = {"Cargo": "#3b82f6", "Tanker": "#ef4444", "Passenger": "#10b981", "Fishing": "#f59e0b", "HSC": "#8b5cf6", "Sailing": "#ec4899", "Tug": "#14b8a6", "Dredging": "#f97316", "Other": "#64748b"}
OTHER_TYPE = "#94a3b8"


def traffic(trips: Column, most: int = TRAFFIC_MOST) -> Column:
    """Place of a trip count on a log10 scale, from 0 to 1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.log10(F.greatest(trips, F.lit(1)).cast("double")) / F.log10(F.lit(float(max(most, 2))))))


def between(colours, t: Column) -> Column:
    """``rgb(...)`` at ``t`` in 0..1 along equally spaced colours; channels round half up."""
    last = len(colours) - 1
    at = F.least(F.lit(last - 1), F.floor(t * last))
    local = t * last - at
    pick = lambda c, i: F.element_at(F.array(*[F.lit(float(x[c])) for x in colours]), (i + 1).cast("int"))
    channels = [F.floor(pick(c, at) + (pick(c, at + 1) - pick(c, at)) * local + 0.5).cast("string") for c in range(3)]
    return F.concat(F.lit("rgb("), F.concat_ws(",", *channels), F.lit(")"))


def traffic_colour(trips: Column, most: int = TRAFFIC_MOST) -> Column:
    return between(TRAFFIC_RGB, traffic(trips, most))


def traffic_weight(trips: Column, most: int = TRAFFIC_MOST) -> Column:
    return F.lit(WEIGHT_LEAST) + traffic(trips, most) * WEIGHT_SPAN


def gap_colour(hours: Column) -> Column:
    return between(GAP_RGB, F.least(F.lit(1.0), hours / GAP_HOURS))


def stepped(value: Column, steps: list[tuple[float, str]], below: str) -> Column:
    """The colour of the first threshold that a value exceeds."""
    return F.coalesce(*[F.when(value > least, colour) for least, colour in steps], F.lit(below))


def type_colour(ship_type: Column) -> Column:
    return F.coalesce(*[F.when(ship_type == t, c) for t, c in TYPE_COLOURS.items()], F.lit(OTHER_TYPE))


def feature_label(name: Column) -> Column:
    """A feature's name in words: no ``pct_``, no unit, a capital first."""
    words = name
    for part, by in (("^pct_", ""), ("_m$", ""), ("_h$", ""), ("_int$", ""), ("_", " ")):
        words = F.regexp_replace(words, part, by)
    return F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, 1000))


def feature_text(name: Column, value: Column) -> Column:
    """A feature's value with its unit."""
    fixed = lambda n: F.format_string(f"%.{n}f", value)
    return (
        F.when(value.isNull(), "—").when(name.startswith("pct_"), F.concat(fixed(1), F.lit("%"))).when(name.endswith("_m"), F.concat(fixed(1), F.lit(" m")))
        .when(name.endswith("_h"), F.concat(fixed(1), F.lit(" h"))).when(name.endswith("_int"), fixed(0)).when(F.abs(value) >= 100, F.format_number(value, 0)).otherwise(fixed(2))
    )


def compact(n: Column) -> Column:
    """``12.4k`` from ten thousand on, grouped digits below."""
    k = n / 1000
    text = F.when(k >= 100, F.format_string("%.0f", k)).otherwise(F.regexp_replace(F.format_string("%.1f", k), r"\.0$", ""))
    return F.when(n >= 10_000, F.concat(text, F.lit("k"))).otherwise(F.format_number(n, 0))


def region(text: Column) -> Column:
    """What stands before a spaced double dash, single blanks."""
    return F.trim(F.regexp_replace(F.element_at(F.split(F.coalesce(text, F.lit("")), r"\s+--\s+"), 1), r"\s+", " "))


def water(text: Column) -> Column:
    """What stands before a semicolon."""
    return F.trim(F.split_part(F.coalesce(text, F.lit("")), F.lit(";"), F.lit(1)))


def place_label(locode: Column, name: Column) -> Column:
    """The locode, or the name where there is none."""
    code = F.trim(F.coalesce(locode, F.lit("")))
    return F.when(F.lower(code).isin("", "n/a", "nan"), name).otherwise(code)
