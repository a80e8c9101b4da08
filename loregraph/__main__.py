"""Command line over a store: ``python -m loregraph COMMAND ...``."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame

from loregraph import config
from loregraph.plans.reports import shown_page
from loregraph.project import ProjectGraph
from loregraph.session import build_session
from loregraph.sources.store import Store

# Command -> (arguments, options with defaults), in the order of the methods.
COMMANDS: dict[str, tuple[tuple[str, ...], dict[str, object]]] = {
    "status": ((), {}),
    "recent": ((), {"limit": 10}),
    "graph": ((), {"limit": 20}),
    "inspect": (("node_id",), {}),
    "search": (("text",), {"limit": 10, "tier": 0, "source": ""}),
    "similar": (("node_id",), {"threshold": 0.5, "limit": 5}),
    "explain": (("text",), {"budget": 600}),
    "inject": (("text",), {"budget": 600}),
    "decay": ((), {"dry_run": False}),
    "sessions": ((), {"limit": 20}),
    "stats": ((), {}),
    "list": ((), {"sort": "weight", "limit": 20, "offset": 0, "tier": 0, "node_type": "", "source": ""}),
    "count": ((), {}),
    "neighbors": (("node_id",), {}),
    "export": (("path",), {"fmt": "json", "tier": 0}),
    "import": (("path",), {"keep_duplicates": False}),
    "ingest": (("path",), {}),
    "pin": (("node_id",), {}),
    "annotate": (("node_id",), {"rationale": ""}),
    "bump": (("node_id",), {"amount": 1.0}),
    "touch": (("node_id",), {}),
    "prune": (("node_id",), {}),
    "link": (("a", "b"), {}),
    "unlink": (("a", "b"), {}),
    "gc": ((), {}),
    "reset": ((), {}),
    "clean": ((), {"days": 30, "tier": 0}),
}


def parser() -> argparse.ArgumentParser:
    root = argparse.ArgumentParser(prog="loregraph")
    root.add_argument("--project", default=".")
    root.add_argument("--store", default="")
    root.add_argument("--json", action="store_true", help="print rows as JSON lines")
    commands = root.add_subparsers(dest="command", required=True)
    for name, (arguments, options) in COMMANDS.items():
        sub = commands.add_parser(name)
        for a in arguments:
            sub.add_argument(a)
        for key, default in options.items():
            flag = "--" + key.replace("_", "-")
            if isinstance(default, bool):
                sub.add_argument(flag, action="store_true")
            else:
                sub.add_argument(flag, type=type(default), default=default)
    return root


def show(df: DataFrame, as_json: bool) -> None:
    """Print a report; all rows are streamed, none are collected or cut."""
    if as_json:
        for line in df.toJSON().toLocalIterator():
            print(line)
    else:
        print("\t".join(df.columns))
        for row in df.toLocalIterator():
            print("\t".join("" if v is None else str(v) for v in row))


def run(graph: ProjectGraph, args: argparse.Namespace) -> None:
    def put(df: DataFrame) -> None:
        show(df, args.json)

    arguments, options = COMMANDS[args.command]
    given = [getattr(args, a) for a in arguments]
    # 0 and "" stand for "no condition".
    opts = {k: getattr(args, k) for k in options}
    for key in ("tier", "source", "node_type"):
        if key in opts and not opts[key]:
            opts[key] = None
    match args.command:
        case "status":
            for part in graph.status().values():
                put(part)
        case "graph":
            put(graph.overview(**opts))
        case "inspect":
            for part in graph.inspect(*given):
                put(part)
        case "decay":
            put(graph.preview_decay() if opts["dry_run"] else graph.decay())
        case "sessions":
            put(graph.session_list(**opts))
        case "list":
            page, total = graph.list(**opts)
            put(page)
            print(shown_page(opts["offset"], page.count(), total.first().total))
        case "import":
            done, skipped = graph.import_file(*given, skip_duplicates=not opts["keep_duplicates"])
            print(f"imported {done} nodes ({skipped} skipped)")
        case "annotate":
            graph.annotate(*given, opts["rationale"] or None)
        case "touch":
            graph.touch(graph.spark.createDataFrame([tuple(given)], "id string"))
        case name:
            result = getattr(graph, name)(*given, **opts)
            if isinstance(result, DataFrame):
                put(result)
            elif result is not None:
                print(result)


def main(argv: list[str] | None = None) -> None:
    import os

    args = parser().parse_args(argv)
    project = os.path.abspath(args.project)
    spark = build_session("loregraph")
    root = args.store or config.store_path(project)
    store = Store.open(spark, root, create=args.command in ("import", "ingest"), indexed=True)
    if store is None:
        raise SystemExit(f"no store at {root}")
    run(ProjectGraph(store, project, lambda: int(time.time())), args)


if __name__ == "__main__":
    main()
