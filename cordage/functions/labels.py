"""Display texts: money, distances, ratings, dates and shortened texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import filled, half_up

# Rates from baht, and signs.
CURRENCIES = {
    "THB": (1.0, "฿"),
    "USD": (0.029, "$"),
    "GBP": (0.023, "£"),
    "EUR": (0.027, "€"),
    "SGD": (0.038, "S$"),
    "CNY": (0.21, "¥"),
}
NO_DATE = "September 2026"


def currency(amount: Column, code: Column | str) -> Column:
    """``amount`` in baht as grouped whole units of the currency; an unknown code means baht, null and NaN mean 0."""
    code = F.lit(code) if isinstance(code, str) else code
    rate = F.coalesce(F.create_map(*(F.lit(x) for k, v in CURRENCIES.items() for x in (k, v[0])))[code], F.lit(1.0))
    sign = F.coalesce(F.create_map(*(F.lit(x) for k, v in CURRENCIES.items() for x in (k, v[1])))[code], F.lit("฿"))
    number = F.coalesce(F.nanvl(amount.cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.concat(sign, F.format_number(half_up(number * rate), 0))


def one_decimal(x: Column) -> Column:
    """``x`` (0 to 2048) to one decimal, decided on the exact binary value, ties up; larger values by Spark's own format.

    The value times a power of two is a whole number that a long holds, so no
    second rounding can turn 1.15, which is stored a little lower, into 1.2.
    """

    def rounded(bits: int) -> Column:
        whole = (x * F.lit(float(1 << bits))).cast("bigint").cast("decimal(19,0)")
        half, one = (F.lit(1 << n).cast("decimal(20,0)") for n in (bits, bits + 1))
        return F.call_function("div", whole * F.lit(20).cast("decimal(2,0)") + half, one)

    tenths = F.when(x < 1, rounded(60)).otherwise(rounded(52))
    exact = F.concat(F.floor(tenths / 10).cast("bigint").cast("string"), F.lit("."), (tenths % 10).cast("string"))
    return F.when((x >= 0) & (x < 2048), exact).otherwise(F.format_string("%.1f", x))


def compact_amount(amount: Column) -> Column:
    """``฿1.2M`` from a million on, else ``฿500K``."""
    amount = amount.cast("double")
    return F.when(amount >= 1e6, F.concat(F.lit("฿"), one_decimal(amount / 1e6), F.lit("M"))).otherwise(F.concat(F.lit("฿"), half_up(amount / 1e3).cast("string"), F.lit("K")))


def distance_label(km: Column) -> Column:
    """Metres under one kilometre, else kilometres with one decimal."""
    km = km.cast("double")
    return F.when(km < 1, F.concat(half_up(km * 1000).cast("string"), F.lit(" m"))).otherwise(F.concat(one_decimal(km), F.lit(" km")))


def stars(rating: Column) -> Column:
    """Filled stars of five: the rating rounded half up, from 0 to 5."""
    return F.greatest(F.lit(0), F.least(F.lit(5), half_up(rating.cast("double")))).cast("int")


def updated_label(value: Column, formats: tuple[str, ...] = ("yyyy-MM-dd", "yyyy/MM/dd", "yyyy-MM-dd HH:mm:ss", "MM/dd/yyyy")) -> Column:
    """A date as ``Jan 5, 2026``; other texts trimmed as they are; null and empty give the default."""
    text = F.trim(value)
    dated = F.coalesce(*(F.date_format(F.try_to_timestamp(text, F.lit(f)), "MMM d, yyyy") for f in formats))
    return F.when(filled(value).isNull(), F.lit(NO_DATE)).otherwise(F.coalesce(dated, text))


def shortened(text: Column, limit: int = 220) -> Column:
    """``text`` if shorter than ``limit`` code points, else so many and an ellipsis."""
    return F.when(F.length(text) < limit, text).otherwise(F.concat(F.substring(text, 1, limit), F.lit("…")))


def kilometres(lat: Column, lng: Column, lat0: float | Column, lng0: float | Column, radius: float = 6371.0) -> Column:
    """Great-circle distance from a point that is fixed or of the row."""
    a = F.pow(F.sin(F.radians(lat - lat0) / 2), 2) + F.cos(F.radians(F.lit(lat0))) * F.cos(F.radians(lat)) * F.pow(F.sin(F.radians(lng - lng0) / 2), 2)
    return F.lit(2 * radius) * F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(0.0), 1 - a)))  # at antipodes rounding takes ``a`` past 1


def within(lat: Column, lng: Column, lat0: float, lng0: float, km: float = 10.0) -> Column:
    """Whether a point lies in the circle; a point without a coordinate does not."""
    return F.coalesce(kilometres(lat, lng, lat0, lng0) <= km, F.lit(False))
