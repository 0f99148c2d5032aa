"""Time column functions. KST is a fixed UTC+9 offset; instants are UTC."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.functions.text import blank_to_null, col, strip

KST_HOURS = 9
Moment = str | datetime | date


def hours(n: int) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(n))


def to_kst(c: Column | str) -> Column:
    return col(c) + hours(KST_HOURS)


def from_kst(c: Column | str) -> Column:
    return col(c) - hours(KST_HOURS)


def kst_date(c: Column | str) -> Column:
    return F.to_date(to_kst(c))


def kst_label(c: Column | str) -> Column:
    return F.concat(F.date_format(to_kst(c), "yyyy-MM-dd HH:mm"), F.lit(" UTC+9"))


def utc_label(c: Column | str) -> Column:
    return F.concat(F.date_format(col(c), "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))


def header_label(c: Column | str) -> Column:
    """Header form of a UTC instant: ``2026. 4. 17. 오후 12:05`` in KST."""
    k = to_kst(c)
    h12 = F.when(F.hour(k) % 12 == 0, 12).otherwise(F.hour(k) % 12)
    return F.concat(
        F.year(k).cast("string"), F.lit(". "), F.month(k).cast("string"), F.lit(". "),
        F.dayofmonth(k).cast("string"), F.lit(". "),
        F.when(F.hour(k) < 12, "오전").otherwise("오후"), F.lit(" "),
        h12.cast("string"), F.lit(":"), F.lpad(F.minute(k).cast("string"), 2, "0"),
    )


def file_label(c: Column | str) -> Column:
    return F.concat(F.date_format(to_kst(c), "yyyy-MM-dd_HH-mm-ss"), F.lit("_KST"))


def moment(value: Moment, like: DataFrame, column: str) -> Column:
    """A literal of the column's own timestamp type, so the comparison reaches the file scan."""
    if not isinstance(value, datetime):
        value = datetime.fromisoformat(str(value).replace("Z", "+00:00"))
    if value.tzinfo is not None:
        value = (value - value.utcoffset()).replace(tzinfo=None)
    kind = like.schema[column].dataType
    name = "timestamp_ntz" if isinstance(kind, T.TimestampNTZType) else "timestamp"
    return F.lit(value.isoformat(sep=" ")).cast(name)


def parse_iso(c: Column | str) -> Column:
    """ISO text to an instant; ``Z`` accepted, naive text is KST, blank text is null."""
    text = blank_to_null(strip(c))
    zoned = text.rlike(r"(?:Z|[+-]\d{2}:?\d{2}(?::?\d{2})?)$") & text.rlike(r"[T ]\d{2}")
    naive = F.when(F.length(text) == 10, F.concat(text, F.lit("T00:00:00"))).when(
        text.rlike(r"[T ]\d{2}:\d{2}$"), F.concat(text, F.lit(":00"))
    ).otherwise(text)
    return F.try_to_timestamp(F.when(zoned, text).otherwise(F.concat(naive, F.lit("+09:00"))))


def parse_feed_iso(c: Column | str, fallback: Column | str) -> Column:
    """ISO feed date, or the fetch time when it does not parse."""
    return F.coalesce(F.try_to_timestamp(col(c)), col(fallback))


def parse_rfc822(c: Column | str, fallback: Column | str) -> Column:
    """``Mon, 06 Apr 2026 00:00:00 -0400``, or the fetch time when it does not parse."""
    text = F.regexp_extract(col(c), r"^[A-Za-z]{3}, (\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2} [+-]\d{4})$", 1)
    parsed = F.try_to_timestamp(blank_to_null(text), F.lit("d MMM yyyy HH:mm:ss Z"))
    return F.coalesce(parsed, col(fallback))


def chat_timestamp(header: Column | str) -> Column:
    """KST wall time of a chat header; 12 오전 is 00h, 12 오후 is 12h, null when impossible."""
    pattern = r"^\[(\d{4})\. (\d{1,2})\. (\d{1,2})\. (오전|오후) (\d{1,2}):(\d{2})\]"
    part = lambda i: F.regexp_extract(col(header), pattern, i).try_cast("int")
    noon = F.regexp_extract(col(header), pattern, 4) == "오후"
    hour = F.pmod(part(5), F.lit(12)) + F.when(noon, 12).otherwise(0)
    hour = F.when(part(5) <= 12, hour)
    text = F.format_string(
        "%04d-%02d-%02d %02d:%02d:00", part(1), part(2), part(3), hour, part(6)
    )
    return F.when(hour.isNotNull(), F.try_to_timestamp(text).cast("timestamp_ntz"))


def chat_utc(ts_kst: Column | str) -> Column:
    return from_kst(ts_kst).cast("timestamp")


def message_id(ts_kst: Column | str, author: Column | str, content: Column | str) -> Column:
    """First 16 hex digits of the SHA-1 of KST time, author and the first 100 characters."""
    stamp = F.date_format(col(ts_kst), "yyyy-MM-dd'T'HH:mm:ss'+09:00'")
    return F.substring(F.sha1(F.concat_ws("|", stamp, col(author), F.substring(col(content), 1, 100))), 1, 16)
