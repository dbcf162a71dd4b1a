"""Masking, casting, ages and shares."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def masked_phone(tel) -> Column:
    """First four characters, then seven asterisks whatever the length."""
    return F.concat(F.substring(tel, 1, 4), F.lit("*******"))


def as_price(text) -> Column:
    """Text to double; NULL (not an error) for text that is no number."""
    return _col(text).try_cast("double")


def age_in_years(birthday, as_of: Column) -> Column:
    """Whole days since ``birthday`` divided by 365, at the moment ``as_of``."""
    born = F.try_to_timestamp(birthday, F.lit("yyyy-M-d"))
    seconds = F.unix_timestamp(as_of) - F.unix_timestamp(born)
    days = F.call_function("div", seconds, F.lit(86400))
    return F.call_function("div", days, F.lit(365)).cast("int")


def age_band(age) -> Column:
    """``under20`` below 20, ``20to30`` up to and including 30, else ``over30``."""
    a = _col(age)
    return F.when(a < 20, "under20").when(a <= 30, "20to30").otherwise("over30")


def percent_tenths(part, whole) -> Column:
    """Percentage with one decimal, ties rounded up; NULL when ``whole`` is 0."""
    return F.floor(F.try_divide(_col(part) * F.lit(1000.0), _col(whole)) + F.lit(0.5)) / F.lit(10.0)


def remaining_percent(*shares) -> Column:
    """100 minus the given shares, to one decimal."""
    rest = F.lit(100.0)
    for s in shares:
        rest = rest - _col(s)
    return F.round(rest, 1)


# Labels shown for the genders.
GENDER_LABELS = {"F": "女", "M": "男"}


def gender_label(gender) -> Column:
    return F.when(_col(gender) == "F", GENDER_LABELS["F"]).otherwise(GENDER_LABELS["M"])
