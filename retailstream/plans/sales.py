"""The sale detail table and the search over it."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_all_words
from ..functions.values import age_band, gender_label, percent_tenths, remaining_percent
from ..operators.joins import detail_part, order_part, with_user
from ..operators.skew import join_unique
from ..schemas import SALE_DETAIL

# Titles and age labels shown with the shares.
AGE_TITLE = "用户年龄占比"
GENDER_TITLE = "用户性别占比"
AGE_LABELS = {"under20": "20岁以下", "20to30": "20岁到30岁", "over30": "30岁以上"}
DEFAULT_DAY = "2019-03-04"


def sale_detail(orders: DataFrame, details: DataFrame, users: DataFrame, as_of: Column) -> DataFrame:
    """One row per order detail whose order is known, with the buyer's data.

    ``orders`` and ``users`` have one row per id. Buyers are looked up per
    order, before each order fans out to its details: fewer rows to move, and
    the result is the same.
    """
    bought = with_user(order_part(orders), users, as_of)
    wide = join_unique(detail_part(details), bought, "order_id", "order_detail_id", "inner")
    return wide.select(*SALE_DETAIL.fieldNames())


def search(sales: DataFrame, day: str = DEFAULT_DAY, keyword: str = "") -> DataFrame:
    """Sales of a day whose product name has every word of ``keyword``; no
    keyword, no restriction."""
    hits = sales.filter(F.col("dt") == day)
    return hits.filter(has_all_words(F.col("sku_name"), keyword)) if keyword.strip() else hits


def total(hits: DataFrame) -> DataFrame:
    return hits.agg(F.count("*").alias("total"))


UNKNOWN = "unknown"


def by_age(hits: DataFrame) -> DataFrame:
    """Hits per age, all of them."""
    return hits.groupBy("user_age").agg(F.count("*").alias("hits"))


def by_gender(hits: DataFrame) -> DataFrame:
    """Hits per gender; buyers without one are ``unknown``, so that all hits are there."""
    return hits.groupBy(F.coalesce("user_gender", F.lit(UNKNOWN)).alias("user_gender")).agg(F.count("*").alias("hits"))


def share_counts(hits: DataFrame) -> DataFrame:
    """All counts behind the shares, in one pass."""
    band = age_band("user_age")
    return hits.agg(
        F.count("*").alias("total"),
        F.count_if(band == "under20").alias("under20"),
        F.count_if(band == "20to30").alias("20to30"),
        F.count_if(F.col("user_gender") == "F").alias("female"),
        F.count_if(F.col("user_gender").isNull()).alias("unknown"),
    )


def _age_options(counts: DataFrame, normalize: bool) -> tuple[DataFrame, list]:
    low, mid, all_ = F.col("under20"), F.col("20to30"), F.col("total")
    high = all_ - low - mid
    if normalize:
        counts = counts.withColumns({"_low": percent_tenths(low, all_), "_mid": percent_tenths(mid, all_)})
        low, mid, high = F.col("_low"), F.col("_mid"), remaining_percent("_low", "_mid")
    names = [F.lit(AGE_LABELS[k]) for k in ("under20", "20to30", "over30")]
    return counts, [(AGE_TITLE, name, value) for name, value in zip(names, (low, mid, high))]


def _gender_options(counts: DataFrame, normalize: bool) -> tuple[DataFrame, list]:
    female, male = F.col("female"), F.col("total") - F.col("female")
    if normalize:
        counts = counts.withColumn("_female", percent_tenths("female", "total"))
        female, male = F.col("_female"), remaining_percent("_female")
    return counts, [
        (GENDER_TITLE, gender_label(F.lit("F")), female),
        (GENDER_TITLE, gender_label(F.lit("M")), male),
    ]


def _rows(counts: DataFrame, options: list) -> DataFrame:
    structs = [
        F.struct(F.lit(title).alias("title"), name.alias("name"), value.cast("double").alias("value"))
        for title, name, value in options
    ]
    return counts.select(F.inline(F.array(*structs)))


def age_share(hits: DataFrame, normalize: bool = True) -> DataFrame:
    """``(title, name, value)``: shares of the age bands in percent, or counts."""
    return _rows(*_age_options(share_counts(hits), normalize))


def gender_share(hits: DataFrame, normalize: bool = True) -> DataFrame:
    """``(title, name, value)``: female share and the rest, as in ``age_share``.

    Buyers without a known gender fall under the rest; ``share_counts`` tells
    how many these are.
    """
    return _rows(*_gender_options(share_counts(hits), normalize))


def _all_options(counts: DataFrame, normalize: bool) -> tuple[DataFrame, list]:
    counts, age = _age_options(counts, normalize)
    counts, gender = _gender_options(counts, normalize)
    return counts, age + gender


def stats(hits: DataFrame, normalize: bool = True) -> DataFrame:
    """Age and gender shares from one pass over the hits."""
    return _rows(*_all_options(share_counts(hits), normalize))


def page(hits: DataFrame, number: int, size: int, key: str = "order_detail_id") -> DataFrame:
    """The ``number``-th page (from 1) in order of ``key``. Cost grows with the
    page number; ``page_after`` does not have that."""
    return hits.orderBy(key).offset((number - 1) * size).limit(size)


def page_after(hits: DataFrame, last: str | None, size: int, key: str = "order_detail_id") -> DataFrame:
    """The page that follows the row with key ``last``."""
    rest = hits if last is None else hits.filter(F.col(key) > last)
    return rest.orderBy(key).limit(size)


def sale_report(sales: DataFrame, day: str = DEFAULT_DAY, number: int = 1, size: int = 10,
                keyword: str = "") -> dict[str, DataFrame]:
    """The whole answer to one search: ``total``, ``stat`` and ``detail`` frames."""
    hits = search(sales, day, keyword)
    counts = share_counts(hits)
    return {
        "total": counts.select("total"), "stat": _rows(*_all_options(counts, True)), "detail": page(hits, number, size),
        "counts": counts,
    }


def report_json(report: dict[str, DataFrame]) -> DataFrame:
    """The answer of ``sale_report`` as one JSON object: ``total``, ``stat``, ``detail``.

    The hits are gone through twice, once for all counts and once for the page.
    """
    counts, options = _all_options(report["counts"], True)
    titles = {}
    for title, name, value in options:
        titles.setdefault(title, []).append(F.struct(name.alias("name"), value.cast("double").alias("value")))
    stat = F.array(*[F.struct(F.array(*own).alias("options"), F.lit(title).alias("title")) for title, own in titles.items()])
    head = counts.select("total", stat.alias("stat"))
    detail = report["detail"].select(F.struct("order_detail_id", F.struct("*").alias("detail")).alias("detail"))
    parts = head.unionByName(detail, allowMissingColumns=True)
    together = parts.agg(
        F.max("total").alias("total"),
        F.max("stat").alias("stat"),
        F.array_sort(F.collect_list("detail"))["detail"].alias("detail"),
    )
    return together.select(F.to_json(F.struct("total", "stat", "detail")).alias("report"))
