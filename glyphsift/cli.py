"""Commands on a store: python -m glyphsift.cli FOLDER COMMAND ..."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from . import service
from .operators import tables
from .store import Store


def main(args: list[str] | None = None, lines=sys.stdin, out=print) -> int:
    p = argparse.ArgumentParser(prog="glyphsift", description=__doc__)
    p.add_argument("folder")
    commands = p.add_subparsers(dest="command", required=True)
    for name, help_ in (("init", "make or empty the store"), ("update", "index the documents"), ("query", "answer requests from standard input"), ("list-all", "list indexed documents"), ("reprocess", "tokenise anew"), ("convert", "rename the old container field")):
        commands.add_parser(name, help=help_)
    for name, what in (("add", "path"), ("del", "path"), ("list", "doi"), ("check-dates", "years")):
        commands.add_parser(name).add_argument(what)
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("glyphsift").getOrCreate()
    store = Store(spark, a.folder)
    show = lambda r: out(f"{r.doi}{f' containerID={r.containerID}' if r.containerID else ''} no_equations={r.no_eqns}")
    if a.command == "query":
        for line in service.answers(lines, store.equations(), store.metadata(), store.postings()):
            out(line)
    elif a.command == "list-all":
        rows, total = tables.list_all(store.metadata())
        for r in rows.toLocalIterator():
            show(r)
        out(f"Total number of equations: {total}")
    elif a.command == "list":
        found = tables.list_one(store.metadata(), a.doi).collect()
        for r in found:
            show(r)
        if not found:
            out("DOI not indexed")
    elif a.command in ("add", "del"):
        errors = store.add(a.path) if a.command == "add" else store.delete(a.path)
        for path, error in errors:
            out(f"{path}: {error}")
        return int(bool(errors))
    elif a.command == "check-dates":
        for doi, status in store.check_years(spark.read.csv(a.years, schema="doi string, year string")):
            out(f"{doi}: {status}")
    else:
        getattr(store, a.command)()
    return 0


if __name__ == "__main__":
    sys.exit(main())
