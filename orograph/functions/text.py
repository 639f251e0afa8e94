"""Texts of the catalogue: numbers, coordinates and dates the Spanish way, small parsers and guards. Nulls give '' unless said otherwise."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
MONTHS = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")
STATUS_LABELS = {"publicado": "Con modelo 3D", "en proceso": "Modelo en proceso"}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_number(x) -> Column:
    """True for a finite number; null, NaN and infinities are none."""
    x = _c(x).cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def number_or_null(x) -> Column:
    return F.when(is_number(x), _c(x))


def plain_number(x) -> Column:
    """Decimal text without an exponent and without trailing zeros, for |x| below 1e15."""
    d = _c(x).cast("decimal(38,12)").cast("string")
    return F.regexp_replace(F.regexp_replace(d, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def grouped_number(x) -> Column:
    """Points between thousands, a comma before decimals."""
    parts = F.split(plain_number(x), r"\.")
    whole = F.regexp_replace(F.get(parts, F.lit(0)), r"\B(?=(\d{3})+(?!\d))", ".")
    return F.when(F.size(parts) > 1, F.concat(whole, F.lit(","), F.get(parts, F.lit(1)))).otherwise(whole)


def coordinates(lat, lon) -> Column:
    lat, lon = _c(lat), _c(lon)
    side = lambda v, pos, neg: F.when(v >= 0, pos).otherwise(neg)
    text = F.concat(grouped_number(F.abs(lat)), F.lit("° "), side(lat, "N", "S"), F.lit(", "), grouped_number(F.abs(lon)), F.lit("° "), side(lon, "E", "O"))
    return F.when(is_number(lat) & is_number(lon), text).otherwise("")


def status_label(status, default=None) -> Column:
    labels = F.create_map(*(F.lit(v) for kv in STATUS_LABELS.items() for v in kv))
    return F.coalesce(labels[_c(status)], _c(status) if default is None else F.lit(default))


def _month(x) -> Column:
    return F.get(F.array(*map(F.lit, MONTHS)), F.month(x) - 1)


def long_date(text) -> Column:
    """'5 de marzo de 2026' of an ISO date or timestamp."""
    d = F.to_date(_c(text))
    return F.when(d.isNull(), "").otherwise(F.concat(F.dayofmonth(d), F.lit(" de "), _month(d), F.lit(" de "), F.year(d)))


def survey_date(text) -> Column:
    """As ``long_date``; of a year and month without a day, those alone."""
    text = _c(text)
    first = F.to_date(F.concat(text, F.lit("-01")))
    return F.when(text.isNull() | (text == ""), "").when(text.rlike(r"^\d{4}-\d{2}$"), F.concat(_month(first), F.lit(" de "), F.year(first))).otherwise(long_date(F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), text)))


def base_url(configured, forwarded_proto, host) -> Column:
    """The configured base, else the first forwarded protocol (https if none) and the host."""
    proto = F.split(F.coalesce(F.nullif(_c(forwarded_proto), F.lit("")), F.lit("https")), ",")[0]
    return F.coalesce(F.nullif(_c(configured), F.lit("")), F.concat(proto, F.lit("://"), _c(host)))


def quantised(x, step: float = 0.1) -> Column:
    """To the nearest step, halves up, never -0."""
    return F.floor(_c(x) / step + 0.5) * 1.0 / (1.0 / step) + F.lit(0.0)


def with_comma(x) -> Column:
    return F.replace(F.format_string("%.1f", quantised(x)), F.lit("."), F.lit(","))


def clamped(x, low, high, stored=None) -> Column:
    """Into [low, high], which always takes in the stored value."""
    low, high = (F.lit(v) if not isinstance(v, Column) else v for v in (low, high))
    if stored is not None:
        low, high = F.least(low, _c(stored)), F.greatest(high, _c(stored))
    return F.least(F.greatest(_c(x), low), high)


def parsed_decimal(text) -> Column:
    """A finite number from text with a point or a comma; else null."""
    return number_or_null(F.replace(F.trim(_c(text)), F.lit(","), F.lit(".")).try_cast("double"))


def joined_url(base, path) -> Column:
    """'' stays ''; absolute addresses and paths from the root stay; the rest goes below base ('' without one)."""
    base, path = _c(base) if isinstance(base, Column) else F.lit(base), _c(path)
    whole = path.rlike(r"^https?://") | path.startswith("/")
    below = F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), F.regexp_replace(path, r"^\.?/+", ""))
    return F.when(path.isNull() | (path == ""), "").when(whole, path).when(base.isNull() | (base == ""), "").otherwise(below)


def first_text(*columns) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(_c(c), F.lit("")) for c in columns))
