"""Command-line jobs: ``python -m fleetlens.plans.jobs ingest|batch ...``"""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from fleetlens import constants as C
from fleetlens.operators.positions import clean_snapshots
from fleetlens.operators.stats import batch_stats
from fleetlens.session import build_session
from fleetlens.sources.snapshots import read_snapshots
from fleetlens.sources.tables import preview
from fleetlens.streaming.ingest import PLANNED_TRIGGERS, IngestConfig, run_ingest, wait_all


def parse(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="fleetlens")
    jobs = parser.add_subparsers(dest="job", required=True)

    ingest = jobs.add_parser("ingest", help="stream landed snapshots into the tables")
    ingest.add_argument("files_dir")
    ingest.add_argument("out_dir")
    ingest.add_argument("checkpoint_dir")
    ingest.add_argument("--layout", choices=("shared", "independent"), help="independent with a database, else shared")
    ingest.add_argument("--trigger", default="1 minute", help='"availableNow", "planned" or an interval')
    ingest.add_argument("--max-files", type=int, default=C.MAX_FILES_PER_TRIGGER)
    ingest.add_argument("--max-bytes", type=int, help="replaces the file limit")
    ingest.add_argument("--rsd", type=float, help="relative error of vehicle counts")
    ingest.add_argument("--tz", help="time zone of day and hour labels")
    ingest.add_argument("--window", default=C.STREAM_WINDOW)
    ingest.add_argument("--delay", default=C.WATERMARK_DELAY, help="how late a ping may be")
    ingest.add_argument("--state-partitions", type=int, help="kept by the checkpoint; required on a cluster")
    ingest.add_argument("--salt-buckets", type=int, help="spread of repeated pings, 1 for none")
    ingest.add_argument("--files-per-batch", type=int, help="files a batch of positions is written to")
    ingest.add_argument("--expected-bytes", type=int, help="size of the largest shuffle, for its partitions")
    ingest.add_argument("--jdbc-url", help="database to write to instead of out_dir")
    ingest.add_argument("--jdbc-properties", help="JSON file of connection properties such as user and password")

    batch = jobs.add_parser("batch", help="statistics of saved snapshots, printed")
    batch.add_argument("files", nargs="+")
    batch.add_argument("--window", default=C.BATCH_WINDOW)
    batch.add_argument("--expected-bytes", type=int, help="size of the largest shuffle, for its partitions")
    return parser.parse_args(argv)


def ingest_config(args: argparse.Namespace) -> IngestConfig:
    """The job's parameters; credentials come from a file, as command lines are visible to others."""
    properties = json.loads(Path(args.jdbc_properties).read_text()) if args.jdbc_properties else {}
    return IngestConfig(
        args.files_dir,
        args.out_dir,
        args.checkpoint_dir,
        layout=args.layout or ("independent" if args.jdbc_url else "shared"),
        window=args.window,
        delay=args.delay,
        trigger=PLANNED_TRIGGERS if args.trigger == "planned" else args.trigger,
        max_files=args.max_files,
        max_bytes=args.max_bytes,
        rsd=args.rsd,
        tz=args.tz,
        state_partitions=args.state_partitions,
        salt_buckets=args.salt_buckets,
        files_per_batch=args.files_per_batch,
        jdbc_url=args.jdbc_url,
        jdbc_properties=properties,
    )


def main(argv: list[str] | None = None) -> None:
    args = parse(argv)
    spark = build_session(f"fleetlens-{args.job}", expected_bytes=getattr(args, "expected_bytes", None))
    if args.job == "batch":
        positions = clean_snapshots(read_snapshots(spark, args.files))
        for stats in batch_stats(positions, args.window):
            preview(stats)
        return
    run_ingest(spark, ingest_config(args))
    wait_all(spark)


if __name__ == "__main__":
    main()
