"""The reports by name. Each takes a session and a folder of parquet tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagetally.operators import activity, pages
from pagetally.operators.funnel import funnel
from pagetally.operators.last_touch import last_touch
from pagetally.operators.sessions import user_sessions
from pagetally.sources.tables import read_table, stream_events
from pagetally.streaming.jobs import (
    daily_counts,
    deduplicate,
    deduplicate_finished,
    run_complete,
)

Report = Callable[[SparkSession, str], DataFrame]


def _over(table: str, operator: Callable[[DataFrame], DataFrame]) -> Report:
    def report(spark: SparkSession, folder: str) -> DataFrame:
        return operator(read_table(spark, folder, table))

    return report


def signup_funnel(spark: SparkSession, folder: str) -> DataFrame:
    times = funnel(read_table(spark, folder, "events"), ("signup", "view", "purchase"))
    return times.withColumnsRenamed({
        "step_1_ts": "signup_ts", "step_2_ts": "view_ts", "step_3_ts": "purchase_ts",
    })


def stream_daily_counts(spark: SparkSession, folder: str) -> DataFrame:
    return run_complete(daily_counts(stream_events(spark, folder)), "daily-counts")


STREAMS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "daily_counts": daily_counts,
    "deduplicate": deduplicate,
}

REPORTS: dict[str, Report] = {
    "page_audit": _over("pages", pages.page_audit),
    "link_edges": _over("pages", pages.link_edges),
    "duplicate_titles": _over("pages", pages.duplicate_titles),
    "canonical_url_groups": _over("pages", pages.canonical_groups),
    "top_pages_by_links": _over("pages", pages.top_pages),
    "event_report": _over("events", activity.event_report),
    "daily_activity": _over("events", activity.daily_activity),
    "user_sessions": _over("events", user_sessions),
    "signup_funnel": signup_funnel,
    "weekly_retention": _over("events", activity.weekly_retention),
    "last_click_before_purchase": _over("events", last_touch),
    "stream_daily_counts": stream_daily_counts,
    "stream_deduplicated": _over("events", deduplicate_finished),
}
