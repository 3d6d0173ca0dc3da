"""Command line over a stored index: ``python -m pharos.cli FOLDER add|delete|clear|search|settings|stats ...``"""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import SparkSession

from pharos.indexing import IndexDocumentsConfig, StoredIndex
from pharos.sources import readers


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pharos", description="A stored index of documents.")
    p.add_argument("folder")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("add", help="index documents of a file or folder")
    a.add_argument("path")
    a.add_argument("--format", choices=("json", "jsonl", "csv", "parquet"), default="jsonl")
    a.add_argument("--update", action="store_true", help="change the given fields of documents that exist")
    a.add_argument("--autogenerate", action="store_true", help="make ids where documents have none")
    a.add_argument("--progress", action="store_true")
    d = sub.add_parser("delete", help="remove documents by id")
    d.add_argument("ids", nargs="+")
    sub.add_parser("clear", help="remove all documents, keep the settings")
    s = sub.add_parser("search")
    s.add_argument("query", nargs="?", default="")
    s.add_argument("--filter")
    s.add_argument("--sort", nargs="*", default=[])
    s.add_argument("--offset", type=int, default=0)
    s.add_argument("--limit", type=int, default=20)
    t = sub.add_parser("settings", help="show the settings, or change those given as NAME=JSON")
    t.add_argument("changes", nargs="*")
    sub.add_parser("stats")
    return p


def run(spark: SparkSession, argv: list[str], out=sys.stdout) -> None:
    o = parser().parse_args(argv)
    ix = StoredIndex(spark, o.folder)
    say = lambda x: print(json.dumps(x, ensure_ascii=False, default=str), file=out)
    if o.command == "add":
        read = {"json": lambda: readers.json_array(spark, o.path), "jsonl": lambda: readers.json_lines(spark, o.path), "csv": lambda: readers.typed_csv(spark, o.path), "parquet": lambda: spark.read.parquet(o.path)}[o.format]
        progress = (lambda step: print(step, file=sys.stderr)) if o.progress else None
        say(ix.add_documents(read(), IndexDocumentsConfig("update" if o.update else "replace", o.autogenerate), progress=progress))
    elif o.command == "delete":
        say({"deleted": ix.delete_documents(o.ids)})
    elif o.command == "clear":
        say({"deleted": ix.clear()})
    elif o.command == "search":
        began = time.time()
        s = ix.search(o.query).sort_criteria(*o.sort).offset(o.offset).limit(o.limit)
        s = s.filter(o.filter) if o.filter else s
        for row in s.documents().toJSON().collect():  # a page
            print(row, file=out)
        print(f"{time.time() - began:.2f} s", file=sys.stderr)
    elif o.command == "settings":
        if o.changes:
            ix.update_settings(**{k: json.loads(v) for k, v in (c.split("=", 1) for c in o.changes)})
        say(json.loads(ix.settings.to_json()))
    else:
        say({"documents": ix.number_of_documents(), "bytes": ix.size(), "fields": ix.fields(), "distribution": {r["field"]: r["n"] for r in ix.field_distribution().collect()}})


if __name__ == "__main__":
    session = SparkSession.builder.appName("pharos").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    run(session, sys.argv[1:])
