"""The command line: ``run`` for one chain over one file, and commands to a resident service."""

from __future__ import annotations

import argparse
import json
import sys

from .dsl.ops import HELP
from .dsl.json_parser import SHAPES, parse_json
from .dsl.compiler import compile_operations
from .dsl.parser import parse
from .errors import EngineError, FileProblem

#: Where the service listens unless told otherwise.
SOCKET = "/tmp/tessera.sock"


def _arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera", description="Pipe chains over tables.")
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="a chain over a CSV file")
    run.add_argument("-i", "--input")
    run.add_argument("-o", "--output", help="a file; else standard output")
    run.add_argument("-c", "--chain", help='e.g. "filter(x > 5) | head(3)"')
    run.add_argument("-f", "--file", help="a file with a chain, as JSON if its name ends in .json")
    run.add_argument("--sep", default=",")
    run.add_argument("--no-header", action="store_true")
    run.add_argument("--dry-run", action="store_true", help="parse and check, run nothing")
    run.add_argument("--verbose", action="store_true", help="say what is done, on standard error")
    run.add_argument("-q", "--quiet", action="store_true")
    run.add_argument("--help-ops", action="store_true", help="the operations")
    serve = sub.add_parser("serve", help="a resident service")
    serve.add_argument("--socket", default=SOCKET)
    for name, args in (("load", ("name", "path")), ("pipe", ("source", "target", "chain")), ("save", ("name", "path")), ("list", ()), ("drop", ("name",)), ("show", ("name",)), ("info", ("name",)), ("status", ()), ("shutdown", ())):
        c = sub.add_parser(name, help=f"{name} in the service")
        c.add_argument("--socket", default=SOCKET)
        for a in args:
            c.add_argument(a)
        if name == "show":
            c.add_argument("-n", type=int, default=10)
    return p


def help_operations() -> str:
    return "\n".join(f"{HELP[v]}\n    JSON args: {SHAPES[v]}" for v in HELP)


def _read(path: str) -> str:
    try:
        with open(path, encoding="utf-8") as f:
            return f.read()
    except OSError as e:
        raise FileProblem(str(e)) from e


def _run(a: argparse.Namespace) -> int:
    if a.help_ops:
        print(help_operations())
        return 0
    if (a.chain is None) == (a.file is None):
        print("one of -c and -f is needed", file=sys.stderr)
        return 2
    text = a.chain if a.chain is not None else _read(a.file)
    operations = parse_json(text) if a.file and a.file.endswith(".json") else parse(text)
    say = (lambda x: print(x, file=sys.stderr)) if a.verbose and not a.quiet else (lambda x: None)
    for k, op in enumerate(operations):
        say(f"{k + 1}. {op.verb} {op.args}")
    if a.dry_run:
        if not a.quiet:
            print(f"{len(operations)} operations: " + " | ".join(op.verb for op in operations))
        return 0
    if a.input is None:
        print("-i is needed", file=sys.stderr)
        return 2
    from .session import get_session
    from .sources.csv import read_csv, to_csv

    spark = get_session(**{"spark.ui.showConsoleProgress": "false"})
    frame = read_csv(spark, a.input, a.sep, not a.no_header)
    out = to_csv(compile_operations(frame, operations), a.output, separator=a.sep)
    if out is not None:
        sys.stdout.write(out)
    return 0


def main(argv: list[str] | None = None) -> int:
    """Exit codes: 0 done, 1 internal, 2 usage or protocol, 3 files, 4 parsing, 5 columns and types, 6 unknown frame."""
    a = _arguments().parse_args(argv)
    try:
        if a.command == "run":
            return _run(a)
        if a.command == "serve":
            from .catalog import Catalog
            from .service import Server
            from .session import get_session

            with Server(a.socket, Catalog(get_session(**{"spark.scheduler.mode": "FAIR"}))) as server:
                server.serve_forever()
            return 0
        from .service import request

        given = {k: v for k, v in vars(a).items() if k not in ("command", "socket")}
        if a.command == "pipe" and a.chain.endswith(".json"):
            given["json"] = _read(given.pop("chain"))
        reply = request(a.socket, a.command, **given)
        if reply.get("warning"):
            print(reply["warning"], file=sys.stderr)
        if reply["ok"]:
            print(reply["data"]["csv"] if a.command == "show" else json.dumps(reply["data"], indent=2))
            return 0
        print(f"{reply['error']['code']}: {reply['error']['message']}", file=sys.stderr)
        return reply["error"]["exit"]
    except EngineError as e:
        print(f"{e.code}: {e}", file=sys.stderr)
        return e.exit_code


if __name__ == "__main__":
    sys.exit(main())
