"""Date functions on columns. "Today" is always a parameter; dates of text that don't parse are null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names of periods.
MONTHS = ["январь", "февраль", "март", "апрель", "май", "июнь", "июль", "август", "сентябрь", "октябрь", "ноябрь", "декабрь"]


def iso(value: Column) -> Column:
    """The date of a YYYY-MM-DD text, else null."""
    return F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(value, "yyyy-MM-dd"))


def business_days(start: Column, end: Column) -> Column:
    """Mondays to Fridays from start to end; none if a bound is missing or they are reversed."""
    days = F.filter(F.sequence(start, end), lambda d: F.weekday(d) < 5)
    return F.when(start <= end, days).otherwise(F.array().cast("array<date>"))


def n_business_days(start: Column, end: Column) -> Column:
    """Their number, without listing them."""
    span = F.datediff(end, start) + 1
    rest, first = span % 7, F.weekday(start)
    weekend = F.when(rest == 0, 0).otherwise(F.greatest(F.lit(0), F.least(first + rest, F.lit(7)) - F.greatest(first, F.lit(5))))
    # days of the broken week that run over into the next one are Mondays to Fridays, as it has six at most
    return F.when(start <= end, F.floor(span / 7) * 5 + rest - weekend).otherwise(0).cast("int")


def days_to(target: Column, today: Column) -> Column:
    return F.datediff(target, today)


def days_until(target: Column, today: Column) -> Column:
    """Days to the end of the target day: 1 on the day itself, 0 on the day after it."""
    return F.datediff(target, today) + 1


def expiry(unlimited: Column, expires: Column, today: Column, warning_days: int) -> Column:
    return (
        F.when(F.coalesce(unlimited, F.lit(False)), "unlimited")
        .when(expires.isNull(), "missing")
        .when(expires < today, "expired")
        .when(F.datediff(expires, today) < warning_days, "expiring")
        .otherwise("valid")
    )


def internal_deadline(start: Column, deadline: Column, today: Column) -> Column:
    return F.greatest(F.coalesce(start, today), F.date_sub(deadline, 2))


def month_grid(first: Column) -> Column:
    """42 days from the Monday on or before the month's first day."""
    monday = F.date_trunc("week", F.date_trunc("month", first)).cast("date")
    return F.sequence(monday, F.date_add(monday, 41))


def any_date(value: Column) -> Column:
    """ISO text of a date written as YYYY-MM-DD, DD.MM.YYYY or "month year"; else blank."""
    v = F.coalesce(value, F.lit(""))
    day = F.regexp_replace(F.regexp_extract(v, r"\d{2}\.\d{2}\.\d{4}", 0), r"(\d{2})\.(\d{2})\.(\d{4})", "$3-$2-$1")
    name = F.regexp_extract(F.lower(v), f"({'|'.join(MONTHS)})" + r"[\s ]+(\d{4})", 1)
    year = F.regexp_extract(F.lower(v), f"({'|'.join(MONTHS)})" + r"[\s ]+(\d{4})", 2)
    month = F.lpad(F.array_position(F.array(*[F.lit(m) for m in MONTHS]), name).cast("string"), 2, "0")
    return F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}$"), v).when(day != "", day).when(name != "", F.concat_ws("-", year, month, F.lit("01"))).otherwise("")


def certificate_validity(value: Column) -> Column:
    """(unlimited, expires): without end, an ISO or DD.MM.YYYY date, or the end of a year from 2000 on."""
    v = F.coalesce(value, F.lit(""))
    edge, end = "(?<![0-9A-Za-z_])", "(?![0-9A-Za-z_])"
    date = F.regexp_extract(v, edge + r"(20\d{2}-\d{2}-\d{2})" + end, 1)
    dotted = F.regexp_extract(v, edge + r"(\d{2}\.\d{2}\.20\d{2})" + end, 1)
    year = F.regexp_extract(v, edge + r"(20\d{2})" + end, 1)
    found = F.when(date != "", date).when(dotted != "", F.regexp_replace(dotted, r"(\d{2})\.(\d{2})\.(\d{4})", "$3-$2-$1")).when(year != "", F.concat(year, F.lit("-12-31"))).otherwise("")
    unlimited = F.lower(v).contains("бессроч")
    return F.struct(unlimited.alias("unlimited"), F.when(unlimited, "").otherwise(found).alias("expires"))


def documents_valid(documents: Column, today: Column) -> Column:
    """There are documents and all are valid; certificates and permits need a date. documents: array of structs
    with category, unlimited and expires (date)."""

    def valid(d: Column) -> Column:
        dated = F.coalesce(d["expires"] >= today, F.lit(False))
        return F.coalesce(d["unlimited"], F.lit(False)) | F.when(d["category"].isin("certificate", "permit"), dated).otherwise(d["expires"].isNull() | dated)

    return (F.size(documents) > 0) & F.forall(documents, valid)


def period_end(value: Column) -> Column:
    """(end, open): the date of a period's end (of a month, its first), or open for one that lasts ("н.в.")."""
    lasts = F.coalesce(value.rlike(r"(?iu)н\.?\s*в\.?"), F.lit(False))
    return F.struct(F.when(~lasts, F.try_to_date(F.nullif(any_date(value), F.lit("")), "yyyy-MM-dd")).alias("end"), lasts.alias("open"))


def backup_due(last: Column, now: Column, hours: Column) -> Column:
    """Whether `hours` have passed since the last backup; never without a period or a last backup."""
    return F.coalesce((hours > 0) & (F.unix_timestamp(now) - F.unix_timestamp(last) >= hours * 3600), F.lit(False))
