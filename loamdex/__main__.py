"""python -m loamdex FOLDER COMMAND: config, add, list, delete, update, serve, status, repair."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from loamdex.api import Engine, EngineError
from loamdex.config import Settings, asked
from loamdex.operators.embed import ServiceEmbedder
from loamdex.server import serve
from loamdex.sources.pages import HttpPages


def main(argv: list[str] | None = None, spark: SparkSession | None = None, source=None) -> int:
    p = argparse.ArgumentParser(prog="loamdex", description=__doc__)
    p.add_argument("folder")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("config").add_argument("--ask", action="store_true", help="ask for each setting of the embedding service")
    add = sub.add_parser("add")
    add.add_argument("url")
    add.add_argument("--name")
    add.add_argument("--version", default="latest")
    add.add_argument("--base-url")
    for name in ("list", "serve", "status", "repair"):
        sub.add_parser(name)
    delete = sub.add_parser("delete")
    delete.add_argument("site")
    delete.add_argument("--yes", action="store_true")
    sub.add_parser("update").add_argument("site")
    args = p.parse_args(argv)
    settings = Settings.load(args.folder)
    if args.command == "config":
        if args.ask:
            settings = asked(settings, test=lambda s: ServiceEmbedder(s).validate())
        settings.save()
        print(settings.file.read_text())
        return 0
    engine = Engine(spark or SparkSession.builder.getOrCreate(), settings)
    source = source or HttpPages()
    if args.command == "add":
        site = engine.add_site(args.url, args.name, args.version, args.base_url)
        engine.index_site(site, engine.crawl_site(site, source))
    elif args.command == "update":
        try:
            engine.update_site(args.site, source)
        except EngineError as e:
            print(e, file=sys.stderr)
            return 1
    elif args.command == "delete":
        if not args.yes:
            print("deleting a site needs --yes", file=sys.stderr)
            return 1
        engine.delete_site(args.site)
    elif args.command == "list":
        rows = engine.list_verbose()
        rows.show(max(1, rows.count()), truncate=False)
    elif args.command == "status":
        print(json.dumps(engine.status(), indent=2))
    elif args.command == "repair":
        print(json.dumps(engine.repair(), indent=2))
    else:
        serve(engine)
    return 0


if __name__ == "__main__":
    sys.exit(main())
