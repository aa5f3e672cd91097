"""python -m corvane index|watch|snapshot|evaluate: the operations that a person or a hook starts."""

from __future__ import annotations

import argparse
import json
import os
import sys

from .operators import evaluate
from .operators.store import Store
from .plans.tools import Tools
from .sources import settings, snapshot


def tools_of(config: str, folder: str | None = None) -> Tools:
    from pyspark.sql import SparkSession

    own = settings.settings(config)
    spark = SparkSession.builder.appName("corvane").getOrCreate()
    store = Store(spark, folder or own["storage"]["path"])
    return Tools(spark, own, store, os.path.join(os.path.dirname(os.path.abspath(config)), "logs"), environment_repo=os.environ.get("CORVANE_REPO"))


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="corvane", description=__doc__)
    parser.add_argument("--config", default="config.yaml")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("index", "watch"):
        commands.add_parser(name).add_argument("--repo", help="this one only; all if not given")
    commands.choices["index"].add_argument("--sample", help="only paths that begin with this")
    taken = commands.add_parser("snapshot")
    taken.add_argument("repo")
    taken.add_argument("source")
    taken.add_argument("target")
    taken.add_argument("--max-bytes", type=int)
    taken.add_argument("--follow", action="store_true", help="again whenever the source has changed and is quiet")
    asked = commands.add_parser("evaluate")
    asked.add_argument("questions")
    asked.add_argument("--repo", default="all")
    asked.add_argument("--label", default="run")
    asked.add_argument("--results", default="results")
    own = parser.parse_args(arguments)

    if own.command == "snapshot":
        take = lambda: print(json.dumps(snapshot.take(own.source, own.target, own.max_bytes, own.repo, own.config)), flush=True)
        take()
        if own.follow:
            snapshot.follow(own.source, take)
        return 0
    tools = tools_of(own.config)
    if own.command == "evaluate":
        found = evaluate.run(settings.load(own.questions), lambda query, k: tools.search_code(query, own.repo, k))
        print(*evaluate.write_results(own.results, own.label, found))
        return 0
    names = [own.repo] if own.repo else list(tools.repos)
    if own.repo and own.repo not in tools.repos:
        print(f"{own.repo} is not configured", file=sys.stderr)
        return 1
    if own.command == "index":
        for name in names:
            print(name, json.dumps(tools.index(name, own.sample)), flush=True)
        return 0
    streams = [tools.watch(name, f"{tools.store.folder}/_watch/{name}") for name in names]
    for stream in streams:
        stream.awaitTermination()
    return 0


if __name__ == "__main__":
    sys.exit(main())
