"""Command line: ``python -m lodestone.cli --root DIR --store DIR COMMAND``, or one JSON request a line on standard input."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from lodestone.api import MODES, Workspace, find_root, handle
from lodestone.session import local_session


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lodestone")
    p.add_argument("--root", default=".")
    p.add_argument("--store", required=True)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("index", "status", "remove", "serve"):
        sub.add_parser(name)
    sub.add_parser("doctor").add_argument("--repair", action="store_true")
    s = sub.add_parser("search")
    s.add_argument("query")
    s.add_argument("--mode", choices=MODES, default="hybrid")
    s.add_argument("--include", default="")
    s.add_argument("--exclude", default="")
    s.add_argument("--type", dest="type_filter")
    s.add_argument("--limit", type=int)
    s.add_argument("--context", type=int, default=2)
    s.add_argument("--with-ignored", action="store_true")
    s.add_argument("--files-only", action="store_true")
    a = p.parse_args(argv)
    root, scope = find_root(a.root)
    ignore = Path(root) / ".gitignore"
    w = Workspace(local_session(), root, a.store, ignore.read_text() if ignore.exists() else "")
    if a.command == "serve":
        for line in sys.stdin:
            print(json.dumps(handle(w, json.loads(line))), flush=True)
        return 0
    request = {k: v for k, v in vars(a).items() if k not in ("root", "store", "files_only")}
    if a.command == "search":
        request |= {"file_names": a.files_only, "limit": 50 if a.limit is None and not a.files_only else a.limit}
    if a.command == "search" and scope is not None:
        request |= {"scope": scope, "scope_is_file": (Path(root) / scope).is_file()}
    answer = handle(w, request)
    if a.command == "search" and a.files_only and answer["ok"]:
        answer["result"] = [r["file_path"] for r in answer["result"]]
    print(json.dumps(answer, indent=1))
    return 0 if answer["ok"] else 1


if __name__ == "__main__":
    sys.exit(main())
