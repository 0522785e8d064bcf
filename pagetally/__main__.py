"""Run one report over a folder of tables, from spark-submit or the shell."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pagetally.plans.reports import REPORTS, STREAMS
from pagetally.session import build_session
from pagetally.sources.tables import stream_events, write_table
from pagetally.streaming.jobs import append_available


def main(arguments: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="pagetally", description=__doc__)
    kinds = parser.add_subparsers(dest="kind", required=True)

    report = kinds.add_parser("report", help="compute a report and write it to a new folder")
    report.add_argument("name", choices=sorted(REPORTS))
    report.add_argument("--tables", required=True)
    report.add_argument("--output", required=True)
    report.add_argument("--partition-by", nargs="*", default=[])

    stream = kinds.add_parser("stream", help="append what new event files add, then stop")
    stream.add_argument("name", choices=sorted(STREAMS))
    stream.add_argument("--tables", required=True)
    stream.add_argument("--output", required=True)
    stream.add_argument("--checkpoint", required=True)
    stream.add_argument("--files", help="names of the event files, such as events-*.parquet")
    stream.add_argument("--max-files", type=int)
    stream.add_argument("--max-bytes", help="bytes per batch, such as 10g")
    stream.add_argument("--state-partitions", type=int)

    chosen = parser.parse_args(arguments)
    spark = build_session(f"pagetally {chosen.name}")
    if chosen.kind == "report":
        result = REPORTS[chosen.name](spark, chosen.tables)
        write_table(result, chosen.output, chosen.partition_by)
    else:
        events = stream_events(
            spark, chosen.tables, chosen.files, chosen.max_files, chosen.max_bytes)
        rows = STREAMS[chosen.name](events)
        late = append_available(rows, chosen.output, chosen.checkpoint, chosen.state_partitions)
        print(f"{late} rows came too late and were dropped")


if __name__ == "__main__":
    main()
