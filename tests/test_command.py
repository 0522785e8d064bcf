"""The command line writes what the report returns."""

import pytest

from pagetally.__main__ import main
from pagetally.plans.reports import REPORTS
from tests.conftest import TESTDATA

TABLES = f"{TESTDATA}/sf0.001"


def test_report(spark, tmp_path):
    out = str(tmp_path / "audit")
    main(["report", "event_report", "--tables", TABLES, "--output", out, "--partition-by", "level"])
    got = spark.read.parquet(out).select("day", "event_type", "n_events")
    want = REPORTS["event_report"](spark, TABLES).select("day", "event_type", "n_events")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        main(["report", "event_report", "--tables", TABLES, "--output", out])


def test_stream_run_twice_adds_nothing(spark, tmp_path):
    out, checkpoint = str(tmp_path / "unique"), str(tmp_path / "checkpoint")
    for _ in range(2):
        main(["stream", "deduplicate", "--tables", TABLES, "--output", out, "--checkpoint", checkpoint])
        assert spark.read.parquet(out).count() == 1000
