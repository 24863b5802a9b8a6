"""Command line: run, validate, explain, chain, schedule, publish, compare, inspect, capabilities."""

from __future__ import annotations

import argparse
import datetime as dt
import json
import sys

from . import compare, plans, publish
from .plans import chain


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("lakeloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lakeloom", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("run", "validate", "explain"):
        command = commands.add_parser(name)
        command.add_argument("definition")
        if name == "run":
            command.add_argument("--smoke", type=int, help="write so many rows at most")
    commands.add_parser("schedule", help="names that are due").add_argument("jobs", help="JSON or YAML: jobs by name, and state (last times)")
    out = commands.add_parser("publish")
    out.add_argument("root")
    out.add_argument("target")
    out.add_argument("--expected")
    commands.add_parser("chain").add_argument("definitions", help="JSON or YAML of name: definition")
    both = commands.add_parser("compare")
    both.add_argument("left")
    both.add_argument("right")
    inspect = commands.add_parser("inspect")
    inspect.add_argument("path")
    inspect.add_argument("--rows", type=int, default=20)
    commands.add_parser("capabilities")
    asked = parser.parse_args(args)
    if asked.command == "capabilities":
        print(json.dumps(plans.capabilities(), indent=1))
    elif asked.command == "validate":
        problems = plans.validate(plans.load(asked.definition))
        print(json.dumps(problems))
        return int(bool(problems))
    elif asked.command == "run":
        print(json.dumps(plans.run(session(), asked.definition, smoke=asked.smoke)))
    elif asked.command == "schedule":
        document = plans.load(asked.jobs)
        state = {name: dt.datetime.fromisoformat(str(at)) for name, at in document.get("state", {}).items()}
        due = chain.tick(document["jobs"], state, dt.datetime.now())
        print(json.dumps({"due": [[name, at.isoformat()] for name, at in due], "state": {name: at.isoformat() for name, at in state.items()}}))
    elif asked.command == "publish":
        print(json.dumps(publish.publish(session(), asked.root, asked.target, asked.expected)))
    elif asked.command == "explain":
        plans.plan(session(), asked.definition).explain("formatted")
    elif asked.command == "chain":
        result = chain.run(session(), plans.load(asked.definitions))
        print(json.dumps({"status": result.status, "errors": result.errors}))
        return int(any(s in ("failed", "blocked") for s in result.status.values()))
    elif asked.command == "compare":
        spark = session()
        found = compare.compare(spark.read.parquet(asked.left), spark.read.parquet(asked.right))
        print(json.dumps(found, default=str))
        return int(not found["equal"])
    else:
        df = session().read.parquet(asked.path)
        df.printSchema()
        df.limit(asked.rows).show(truncate=60)
    return 0


if __name__ == "__main__":
    sys.exit(main())
