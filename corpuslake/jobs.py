"""Command line of the layers: python -m corpuslake.jobs LAKE COMMAND ... (the paths are the cluster's)."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.lake import Lake
from corpuslake.operators import repair
from corpuslake.session import build_session
from corpuslake.settings import Settings, checked
from corpuslake.sources import fetching


def parser() -> argparse.ArgumentParser:
    """Commands and their options; --doc-ids beats --limit."""
    p = argparse.ArgumentParser(prog="corpuslake.jobs")
    p.add_argument("lake", help="folder of the layers")
    p.add_argument("--master")
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("bronze", help="ingest a source; without --fetch, one that has its content at hand")
    b.add_argument("--source", default="local")
    b.add_argument("--options", type=json.loads, default={}, help='JSON, such as {"folder": "/in"}')
    b.add_argument("--fetch", action="store_true", help="get the candidates' content by HTTP")
    for name, default in zip(("retries", "wait", "delay"), fetching.Policy(), strict=False):
        b.add_argument(f"--{name}", type=type(default), default=default)
    for name in ("silver", "linguistic", "sentiment", "labels"):
        c = sub.add_parser(name)
        c.add_argument("--limit", type=int)
        c.add_argument("--doc-ids", type=int, nargs="*")
    e = sub.add_parser("export")
    e.add_argument("path", help="a .xlsx file, or a folder for CSV")
    r = sub.add_parser("repair-urls")
    r.add_argument("--dry-run", action="store_true")
    m = sub.add_parser("merge-metadata", help="recovered metadata, JSON lines of doc_id and found")
    m.add_argument("path")
    m.add_argument("--speaker", required=True)
    t = sub.add_parser("topics")
    t.add_argument("--clusters", type=int)
    for name in ("statuses", "health", "overview"):
        sub.add_parser(name)
    return p


def _lines(rows: DataFrame) -> int:
    """Prints every row as a line of JSON, one partition at a time; their number."""
    n = 0
    for r in rows.toJSON().toLocalIterator():
        print(r)
        n += 1
    return n


def main(argv: list[str] | None = None) -> object:
    """Runs one command and prints its outcome as JSON lines."""
    a = parser().parse_args(argv)
    spark = build_session("corpuslake-jobs", a.master, **Settings.of().objects())
    lake = Lake(spark, a.lake)
    out: object
    if a.command == "bronze":
        fetch = (lambda rows: fetching.fetched(rows, policy=fetching.Policy(a.retries, a.wait, a.delay))) if a.fetch else None
        out = lake.ingest_bronze(a.source, fetch, **checked(a.source, a.options))
    elif a.command == "silver":
        out = lake.ingest_silver(a.limit, a.doc_ids)
    elif a.command in ("linguistic", "sentiment", "labels"):
        out = {"processed": lake.run_gold(a.command, a.limit, a.doc_ids)}
    elif a.command == "export":
        rows = repair.export_rows(lake.bronze.read(), lake.silver.read())
        n, w = (repair.export_xlsx if a.path.endswith(".xlsx") else repair.export_csv)(rows, a.path)
        out = {"documents": n, "with_transcript": w}
    elif a.command == "repair-urls":
        found = repair.url_repairs(lake.bronze.read())
        out = {"repairs": found.count()}
        if not a.dry_run and out["repairs"]:
            lake.bronze.upsert_columns(found.select("doc_id", F.col("repaired_url").alias("source_url")))  # only the ranges that hold one are written
    elif a.command == "health":
        out = lake.health()
    elif a.command == "merge-metadata":
        found = spark.read.schema("doc_id long, found map<string,string>").json(a.path)
        out = {"merged": lake.merge_metadata(found, a.speaker)}
    elif a.command == "topics":
        out = lake.run_topics(k=a.clusters)
    elif a.command == "statuses":
        out = {"statuses": _lines(lake.statuses())}
    else:
        out = {name: _lines(df) for name, df in lake.overview().items()}
    print(json.dumps(out))
    return out


if __name__ == "__main__":
    main()
