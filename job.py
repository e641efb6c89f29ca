"""Run the pipeline with spark-submit.

    spark-submit --packages <kafka connector, JDBC drivers> job.py \\
        --servers broker:9092 --topic receipts --checkpoints s3a://lake/checkpoints \\
        --raw-path s3a://lake/raw --clean-jdbc clean.json --errors-jdbc errors.json

Each destination that is named gets its part; clean items and errors share one read of
the topic if both are. A JDBC file holds the writer's options, among them url, dbtable,
driver, user and password. ``--lines`` replays a directory of JSON lines instead of a
topic, ``--sse-lines`` one of captured event-stream lines, ``--publish`` sends the parsed
receipts on to a topic, and ``--once`` stops when the input is used up.
"""

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from receiptlake import streaming as S  # noqa: E402
from receiptlake.sources import (  # noqa: E402
    decode_sse_lines,
    decode_value,
    parse_receipts,
    read_lines,
    read_topic,
)


def arguments(argv=None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    parser.add_argument("--servers")
    parser.add_argument("--topic")
    parser.add_argument("--starting", default="latest", help="offsets to start from")
    parser.add_argument("--min-partitions", type=int)
    parser.add_argument("--max-offsets", type=int, help="bound of a batch")
    parser.add_argument("--lines", help="directory of JSON lines instead of a topic")
    parser.add_argument("--sse-lines", help="directory of captured event-stream lines instead")
    parser.add_argument("--publish", metavar="TOPIC", help="publish parsed receipts to a topic")
    parser.add_argument("--publish-servers", help="brokers of that topic, if not --servers")
    parser.add_argument("--max-files", type=int, help="bound of a batch with --lines")
    parser.add_argument("--checkpoints", required=True)
    parser.add_argument("--raw-path")
    parser.add_argument("--gather", action="store_true", help="few files per month, by a shuffle")
    parser.add_argument("--clean-path")
    parser.add_argument("--clean-jdbc", metavar="FILE")
    parser.add_argument("--errors-path")
    parser.add_argument("--errors-jdbc", metavar="FILE")
    parser.add_argument("--stream-id", help="makes sinks replay-safe; new id, new checkpoints")
    parser.add_argument("--reasons", choices=["reference", "complete"], default="reference")
    parser.add_argument("--on-null", choices=["drop", "error"], default="drop")
    parser.add_argument("--keep-source", action="store_true")
    parser.add_argument("--once", action="store_true")
    args = parser.parse_args(argv)
    if not args.lines and not args.sse_lines and not (args.servers and args.topic):
        parser.error("name a topic (--servers, --topic), --lines or --sse-lines")
    if (args.clean_path or args.errors_path) and not args.stream_id:
        parser.error("--clean-path and --errors-path need --stream-id")
    return args


def source(spark: SparkSession, args: argparse.Namespace, keep_source: bool) -> DataFrame:
    if args.sse_lines:
        return decode_sse_lines(read_lines(spark, args.sse_lines, args.max_files))
    if args.lines:
        records = read_lines(spark, args.lines, args.max_files)
    else:
        records = read_topic(
            spark,
            args.servers,
            args.topic,
            args.starting,
            min_partitions=args.min_partitions,
            max_offsets_per_trigger=args.max_offsets,
        )
    return decode_value(records, keep_source)


def published(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    return parse_receipts(source(spark, args, False))


def sink(path: str | None, jdbc: str | None, stream_id: str | None, write=S.write_parquet):
    if path:
        return S.path_sink(path, stream_id, write)
    if jdbc:
        with open(jdbc, encoding="utf-8") as file:
            return S.jdbc_sink(json.load(file), stream_id)
    return None


def start(spark: SparkSession, args: argparse.Namespace) -> list:
    options = {"trigger": {"availableNow": True} if args.once else None}
    clean = sink(args.clean_path, args.clean_jdbc, args.stream_id, S.write_clean_layout)
    errors = sink(args.errors_path, args.errors_jdbc, args.stream_id)
    routing = {"mode": args.reasons, "on_null": args.on_null, "keep_source": args.keep_source}
    started = []
    if args.raw_path:
        docs = source(spark, args, args.keep_source)
        checkpoint = f"{args.checkpoints}/raw"
        started.append(
            S.run_raw_landing(
                docs, args.raw_path, checkpoint, args.keep_source, gather=args.gather, **options
            )
        )
    if args.publish:
        started.append(
            S.start_topic(
                published(spark, args),
                args.publish_servers or args.servers,
                args.publish,
                f"{args.checkpoints}/publish",
                **options,
            )
        )
    docs = source(spark, args, args.keep_source and bool(errors))
    if clean and errors:
        checkpoint = f"{args.checkpoints}/clean-errors"
        started.append(
            S.run_clean_and_errors(
                docs, clean, errors, checkpoint, carry=(), **routing, **options
            )
        )
    elif clean:
        started.append(
            S.run_clean_items(docs.select("json"), clean, f"{args.checkpoints}/clean", **options)
        )
    elif errors:
        checkpoint = f"{args.checkpoints}/errors"
        started.append(S.run_error_feed(docs, errors, checkpoint, **routing, **options))
    return started


def main() -> None:
    args = arguments()
    spark = SparkSession.builder.appName("receiptlake").getOrCreate()
    queries = start(spark, args)
    if args.once:
        for query in queries:
            query.awaitTermination()
    else:
        S.await_any(spark)


if __name__ == "__main__":
    main()
