"""Command line: administration of a store, and the hook that sends one transcript to be indexed.

    python -m turnstone.cli list | stats | expire --days N | delete --session ID | delete --branch NAME | reset --yes | backfill FOLDER | hook
"""

from __future__ import annotations

import argparse
import json
import os
import subprocess
import sys
import urllib.request

from pyspark.sql import SparkSession

from turnstone import api
from turnstone.session import local_session

#: Seconds the hook waits for the service.
HOOK_SECONDS = 1.0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="turnstone")
    p.add_argument("--store", default=os.environ.get("TURNSTONE_STORE", "turnstone-store"), help="folder of the store")
    p.add_argument("--project", help="project root, * for all")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="sessions with their turns, branches and times")
    sub.add_parser("stats", help="totals")
    expire = sub.add_parser("expire", help="delete old turns")
    expire.add_argument("--days", type=int, required=True)
    delete = sub.add_parser("delete", help="delete a session, or else a branch")
    delete.add_argument("--session")
    delete.add_argument("--branch")
    reset = sub.add_parser("reset", help="drop everything")
    reset.add_argument("--yes", action="store_true", help="do not ask")
    fill = sub.add_parser("backfill", help="index what is new in a folder")
    fill.add_argument("folder")
    hook = sub.add_parser("hook", help="read a hook's JSON from standard input and send it to the service")
    hook.add_argument("--url", default=os.environ.get("TURNSTONE_URL", ""))
    return p


def hook_request(event: dict) -> dict | None:
    """What the hook sends for an event; None if a stop hook is running already or the event names no transcript."""
    if event.get("stop_hook_active") or not event.get("transcript_path") or not event.get("session_id"):
        return None
    cwd = event.get("cwd") or os.getcwd()
    top = subprocess.run(["git", "-C", cwd, "rev-parse", "--show-toplevel"], capture_output=True, text=True, check=False).stdout.strip()
    return {"transcript_path": event["transcript_path"], "session_id": event["session_id"], "cwd": top or cwd}


def _hook(url: str) -> int:
    """Sends and forgets: whatever goes wrong, the caller is not held up."""
    try:
        body = hook_request(json.load(sys.stdin))
        if body and url:
            request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
            urllib.request.urlopen(request, timeout=HOOK_SECONDS).close()  # noqa: S310 - the address is the user's own setting
    except (OSError, ValueError):
        pass
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "hook":
        return _hook(args.url)
    if args.command == "delete" and not (args.session or args.branch):
        print("give --session or --branch", file=sys.stderr)
        return 2
    if args.command == "reset" and not args.yes and input("Delete all turns? [y/N] ").strip().lower() not in ("y", "yes"):
        print("Nothing deleted.")
        return 1
    engine = api.Engine(spark or local_session("turnstone-cli"), args.store)
    project = None if args.project == "*" else args.project
    if args.command == "list":
        print(api.format_sessions(engine.list_sessions(project).collect()))
    elif args.command == "stats":
        print(api.format_stats(engine.get_session_stats(project), args.store))
    elif args.command == "expire":
        print(f"{engine.delete_older_than(args.days, project_root=project)} turns deleted")
    elif args.command == "delete":
        n = engine.delete_by_session(args.session, project) if args.session else engine.delete_by_branch(args.branch, project)
        print(f"{n} turns deleted")
    elif args.command == "backfill":
        print(f"{engine.backfill(args.folder)} turns added")
    else:
        engine.reset()
        print("All turns deleted.")
    return 0


if __name__ == "__main__":
    sys.exit(main())
