"""Command line: add, reindex, search, list, get, events, bench, status, identity, config-show, version."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict
from pathlib import Path

from quarry import __version__
from quarry.api import Engine
from quarry.session import local_session
from quarry.sources.config import ConfigError, load_config
from quarry.sources.corpus import EXTENSIONS
from quarry.streaming.watch import folder_events, register


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quarry", description=__doc__)
    p.add_argument("--config", default="quarry.toml")
    sub = p.add_subparsers(dest="verb", required=True)
    r = sub.add_parser("reindex")
    r.add_argument("--corpus", action="append")
    s = sub.add_parser("search")
    s.add_argument("q")
    s.add_argument("--corpus")
    s.add_argument("--mode", default="keyword")
    s.add_argument("--limit", type=int, default=10)
    s.add_argument("--offset", type=int, default=0)
    ls = sub.add_parser("list")
    ls.add_argument("--corpus")
    ls.add_argument("--limit", type=int, default=50)
    ls.add_argument("--offset", type=int, default=0)
    g = sub.add_parser("get")
    g.add_argument("id")
    g.add_argument("--source", action="store_true")
    a = sub.add_parser("add", help="write a document into a corpus's folder and index it")
    a.add_argument("file")
    a.add_argument("--corpus", required=True)
    a.add_argument("--path", help="path within the corpus; the file's name if not given")
    b = sub.add_parser("bench")
    b.add_argument("queries", help="a file with a query a line")
    b.add_argument("--rounds", type=int, default=5)
    b.add_argument("--mode", default="keyword")
    ev = sub.add_parser("events", help="changes in the folders since the last call, applied to the store")
    ev.add_argument("--state", required=True, help="folder that remembers what was seen")
    for verb in ("identity", "status", "config-show", "version"):
        sub.add_parser(verb)
    return p


def add_document(engine: Engine, file: str, corpus: str, path: str | None) -> None:
    """The folder stays the authority: the document is copied there, and then its path is looked at."""
    root = engine.folders.get(corpus)
    if root is None:
        raise ValueError(f"no corpus {corpus!r}")
    path = path or Path(file).name
    if path.startswith("/") or ".." in path.split("/") or not path.lower().endswith(tuple(f".{e}" for e in EXTENSIONS)):
        raise ValueError("the path lies within the corpus and ends like a document")
    target = Path(root.removeprefix("file://")) / path
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_bytes(Path(file).read_bytes())
    engine.reindex_paths(engine.spark.createDataFrame([(corpus, path)], "corpus string, path string"))


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    if args.verb == "version":
        print(__version__)
        return 0
    try:
        config = load_config(args.config)
        if args.verb == "config-show":
            print(json.dumps(asdict(config), indent=2))
            return 0
        engine = Engine(local_session(), config)
        if args.verb == "reindex":
            print(json.dumps(engine.reindex(args.corpus).stats()))
            return 0
        if args.verb == "add":
            add_document(engine, args.file, args.corpus, args.path)
            print(json.dumps(engine.stats()))
            return 0
        if args.verb == "identity":
            print(json.dumps(engine.identity()))
            return 0
        engine.refresh()
        if args.verb == "events":
            engine.bus.subscribe(lambda e: print(json.dumps(e)))
            register(engine.spark)
            changes = folder_events(engine.spark, engine.folders, f"{args.state}/seen", engine.ignore)
            engine.apply_events(changes, f"{args.state}/checkpoint", debounce=False).trigger(availableNow=True).start().awaitTermination()
            return 0
        if args.verb == "bench":
            asked = [q for q in Path(args.queries).read_text().splitlines() if q.strip() and not q.startswith("#")]
            print(json.dumps(engine.bench(asked, args.rounds, mode=args.mode)))
            return 0
        if args.verb == "status":
            print(json.dumps(engine.stats()))
            return 0
        if args.verb == "search":
            rows = engine.search(args.q, corpus=args.corpus, mode=args.mode, limit=args.limit, offset=args.offset).rows
        elif args.verb == "list":
            rows = engine.artifacts(args.corpus, limit=args.limit, offset=args.offset)[0]
        else:
            rows = engine.get(args.id, args.source)
        for line in rows.toJSON().collect():
            print(line)
        return 0
    except (ConfigError, ValueError, OSError) as e:
        print(f"quarry: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
