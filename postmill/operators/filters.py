"""Row filters. Time bounds become literals of the column's type and reach the file scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.text import contains_any, strip
from postmill.functions.times import KST_HOURS, Moment, hours, moment


def relevance_filter(df: DataFrame, cols: list[str], keywords: list[str]) -> DataFrame:
    """Rows whose joined text contains any keyword, case-folded."""
    text = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in cols]))
    return df.where(contains_any(text, [k.lower() for k in keywords]))


def lookback(spec: str) -> Column:
    """``7d`` or ``24h`` as an interval."""
    n = int(spec[:-1])
    return F.make_dt_interval(F.lit(n)) if spec[-1] == "d" else hours(n)


def since(df: DataFrame, as_of: Moment, spec: str, ts: str = "timestamp") -> DataFrame:
    return df.where(F.col(ts) > moment(as_of, df, ts) - lookback(spec))


def time_window(df: DataFrame, start_kst: str, end_kst: str, ts: str = "timestamp") -> DataFrame:
    """Closed interval given in KST wall time."""
    if start_kst > end_kst:
        raise ValueError("start must not be after end")
    shift = hours(KST_HOURS)
    return df.where(F.col(ts).between(moment(start_kst, df, ts) - shift, moment(end_kst, df, ts) - shift))


def select_targets(articles: DataFrame, ids: list[str] | None = None, placement: str | None = None) -> DataFrame:
    """Articles named by id or id suffix, or by placement; all of them when neither is given."""
    if ids:
        return articles.where(reduce(lambda a, b: a | b, [F.endswith("id", F.lit(i)) for i in ids]))
    return articles if placement is None else articles.where(F.col("placement") == placement)


def decision_log_retention(log: DataFrame, as_of: Moment, current: DataFrame | None = None, keep_hours: int = 3) -> DataFrame:
    """Entries younger than ``keep_hours``, followed by the current one."""
    kept = log.where(F.col("run_at") > moment(as_of, log, "run_at") - hours(keep_hours))
    return kept if current is None else kept.unionByName(current)


def published(log: DataFrame, platform: str | None = None) -> DataFrame:
    return log if platform is None else log.where(F.col("platform") == platform)


def is_published(articles: DataFrame, log: DataFrame, platform: str) -> DataFrame:
    ids = published(log, platform).select(F.col("article_id").alias("id"))
    return articles.join(ids, "id", "left_semi")


def incremental_cut(
    df: DataFrame, state: DataFrame, as_of: Moment, override: Moment | None = None, key: str = "last_run_at",
    ts: str = "timestamp",
) -> DataFrame:
    """Rows after the high-water mark: the override, else the stored mark, else as_of - 72 h."""
    default = moment(as_of, df, ts) - hours(72)
    if override is not None:
        return df.where(F.col(ts) > moment(override, df, ts))
    kind = df.schema[ts].dataType
    # One value of a keyed table: as a literal it reaches the file scan.
    mark = state.where(F.col("key") == key).agg(F.max(F.col("value").try_cast(kind)).cast("string").alias("mark")).first()["mark"]
    return df.where(F.col(ts) > (default if mark is None else F.lit(mark).cast(kind)))


def advance_mark(state: DataFrame, as_of: Moment, key: str = "last_run_at") -> DataFrame:
    """The stored mark moves to ``as_of`` even when nothing arrived."""
    now = moment(as_of, state, "updated_at")
    text = F.date_format(now, "yyyy-MM-dd HH:mm:ss")
    row = state.sparkSession.range(1).select(F.lit(key).alias("key"), text.alias("value"), now.alias("updated_at"))
    return state.where(F.col("key") != key).unionByName(row)
