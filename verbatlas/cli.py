"""Command line: analyze, search, list, show, rebuild-library, quality."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F

from .functions import text as T
from .operators import quality
from .plans import service
from .plans.analysis import FORMAT, analyze
from .session import cut, local_session
from .sources import files


def positive(text: str) -> int:
    n = int(text)
    if n < 1:
        raise argparse.ArgumentTypeError("must be 1 or more")
    return n


def not_negative(text: str) -> int:
    n = int(text)
    if n < 0:
        raise argparse.ArgumentTypeError("must be 0 or more")
    return n


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="verbatlas", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("analyze", help="analyse <folder>/<video>/*.vtt and write the study files there")
    a.add_argument("folder")
    a.add_argument("--catalog", required=True)
    a.add_argument("--lang", default="es,en")
    a.add_argument("--video", help="only this one")
    s = sub.add_parser("search")
    s.add_argument("query")
    s.add_argument("--video")
    s.add_argument("--limit", type=positive, default=10)
    s.add_argument("--context", type=not_negative, default=0)
    shown = sub.add_parser("show")
    shown.add_argument("id")
    r = sub.add_parser("rebuild-library")
    r.add_argument("folder")
    listed = sub.add_parser("list")
    for x in (s, shown, r, listed):
        x.add_argument("--library", required=True)
    q = sub.add_parser("quality")
    q.add_argument("corpus")
    q.add_argument("--catalog", required=True)
    q.add_argument("--baseline")
    return p


def run(argv: list[str]) -> int:
    args = parser().parse_args(argv)
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    if args.command == "analyze":
        catalog, _ = files.read_catalog(spark, args.catalog)
        print(service.analyze_folder(spark, args.folder, catalog, service.requested_languages(args.lang), video_id=args.video), "files")
    elif args.command == "rebuild-library":
        n, skipped = service.rebuild(spark, args.library, args.folder)
        print(n, "entries", *(f"\nskipped {x}" for x in skipped))
    elif args.command == "search":
        if args.video and files.read_library(spark, args.library).where((F.col("id") == args.video) & F.col("reason").isNull()).isEmpty():
            raise ValueError(f"no such video: {args.video}")
        for r in service.search_library(spark, args.library, args.query, video_id=args.video, limit=args.limit, context=args.context).collect():
            print(f"{r.title} [{r.timestamp}]", *(f"  {x}" for x in r.before), f"> {r.line}", *(f"  {x}" for x in r.after), sep="\n")
    elif args.command in ("list", "show"):
        entries = files.read_library(spark, args.library).where("reason is null")
        if args.command == "show":
            entries = entries.where(F.col("id") == args.id)
            if entries.isEmpty():
                raise ValueError(f"no such video: {args.id}")
        for r in entries.orderBy(F.desc(F.coalesce("updated_at", F.lit("")))).select("id", "title", "channel", T.duration_label(F.col("duration")).alias("duration"), "url", "path", "tools").toLocalIterator():
            print(r.id, r.title, r.channel or "N/D", r.duration, sep=" | ") if args.command == "list" else print(json.dumps(r.asDict(), ensure_ascii=False, indent=2))
    elif args.command == "quality":
        import os

        catalog, _ = files.read_catalog(spark, args.catalog)
        targets = cut(files.read_corpus(spark, args.corpus))
        base = os.path.dirname(os.path.abspath(args.corpus))
        cases = [(r.case_id, "/" + os.path.join(base, r.vtt).lstrip("/")) for r in targets.select("case_id", "vtt").collect()]
        owner = spark.createDataFrame(cases, "video_id string, path string")
        texts = files.text_files(spark, [p for _, p in cases]).withColumn("path", F.regexp_replace("path", "^file:/+", "/"))
        cues = files.parse_vtt(texts).join(owner, "path").select("video_id", "cue_index", "second", "text")
        report = cut(quality.evaluate(analyze(cues, catalog), targets))
        read = lambda path: open(path, "rb").read()  # noqa: E731, SIM115
        head = {"metric_version": quality.METRIC_VERSION, "corpus_schema_version": quality.CORPUS_VERSION, "corpus_digest": quality.digest(read(args.corpus), ((c, read(path)) for c, path in cases)), "analysis_format_version": FORMAT}
        payload = quality.report_payload(report, **head)
        print(json.dumps(payload, ensure_ascii=False, indent=2))
        if args.baseline:
            quality.same_corpus(payload, json.loads(read(args.baseline)))
            worse = quality.regressions(quality.long_metrics(report), files.read_baseline(spark, args.baseline)).collect()
            for r in worse:
                print(f"{r.location}.{r.metric}: actual={r.actual}, baseline={r.baseline}")
            return int(bool(worse))
    return 0


def main() -> None:
    try:
        sys.exit(run(sys.argv[1:]))
    except KeyboardInterrupt:
        sys.exit(130)
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        sys.exit(1)


if __name__ == "__main__":
    main()
