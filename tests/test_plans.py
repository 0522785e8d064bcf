"""What the plans must keep to at scale."""

import re

import pytest

from pagetally.operators import activity, pages
from pagetally.operators.funnel import funnel
from pagetally.operators.last_touch import last_touch
from pagetally.operators.sessions import user_sessions
from pagetally.sources.tables import read_table
from tests.conftest import TESTDATA

FOLDER = f"{TESTDATA}/sf0.001"


@pytest.fixture
def explain(spark, capsys):
    def run(df):
        df.explain("formatted")
        return capsys.readouterr().out

    return run


@pytest.fixture
def events(spark):
    return read_table(spark, FOLDER, "events")


@pytest.fixture
def page_rows(spark):
    return read_table(spark, FOLDER, "pages")


def read_columns(plan):
    return [set(re.findall(r"(\w+):", s)) for s in re.findall(r"ReadSchema: struct<(.*)>", plan)]


BATCH = {
    "page_audit": (pages.page_audit, "pages", {"page_id", "url", "html"}, 0),
    "link_edges": (pages.link_edges, "pages", {"page_id", "html"}, 0),
    "duplicate_titles": (pages.duplicate_titles, "pages", {"html"}, 1),
    "canonical_groups": (pages.canonical_groups, "pages", {"url"}, 1),
    "top_pages": (pages.top_pages, "pages", {"page_id", "url", "html"}, 1),
    "event_report": (activity.event_report, "events", {"ts", "event_type"}, 2),
    "daily_activity": (activity.daily_activity, "events", {"ts", "user_id", "value"}, 3),
    "weekly_retention": (activity.weekly_retention, "events", {"ts", "user_id"}, 3),
    "user_sessions": (user_sessions, "events", {"ts", "user_id"}, 2),
}


@pytest.mark.parametrize("name", BATCH)
def test_columns_and_shuffles(spark, explain, name):
    operator, table, columns, shuffles = BATCH[name]
    plan = explain(operator(read_table(spark, FOLDER, table)))
    assert read_columns(plan) == [columns]
    tree = plan.split("\n\n")[0]
    assert len(re.findall(r"\bExchange\b", tree)) == shuffles
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert "Python" not in plan and "InPandas" not in plan


def test_top_pages_limits_each_host_before_the_shuffle(explain, page_rows):
    tree = explain(pages.top_pages(page_rows)).split("\n\n")[0]
    assert tree.count("WindowGroupLimit") == 2
    assert tree.rindex("WindowGroupLimit") > tree.index("Exchange")


@pytest.mark.parametrize("aggregate", ["sessions", "retention", "report", "daily"])
def test_events_are_reduced_before_the_first_shuffle(explain, events, aggregate):
    job = {"sessions": user_sessions, "retention": activity.weekly_retention,
           "report": activity.event_report, "daily": activity.daily_activity}[aggregate]
    tree = explain(job(events)).split("\n\n")[0]
    below_last_exchange = tree[tree.rindex("Exchange"):]
    assert "HashAggregate" in below_last_exchange
    assert "Expand" not in below_last_exchange


@pytest.mark.parametrize("job, wanted, shuffles", [
    (funnel, r"In\(event_type, \[purchase,signup,view\]\)", 2),
    (last_touch, r"In\(event_type, \[click,purchase\]\)", 6),
])
def test_funnel_and_last_touch_plans(explain, events, monkeypatch, job, wanted, shuffles):
    plan = explain(job(events))
    assert re.search(rf"PushedFilters: .*{wanted}", plan), plan
    assert "value" not in set().union(*read_columns(plan))
    tree = plan.split("\n\n")[0]
    assert len(re.findall(r"\bExchange\b", tree)) <= shuffles
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_funnel_reads_the_events_once(explain, events):
    assert explain(funnel(events)).split("\n\n")[0].count("Scan parquet") == 1


def test_funnel_and_last_touch_write_nothing(events, monkeypatch):
    monkeypatch.setattr("pyspark.sql.readwriter.DataFrameWriter.parquet", None)
    assert funnel(events).count() > 0 and last_touch(events).count() > 0
