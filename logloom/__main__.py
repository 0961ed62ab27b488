"""python -m logloom: --version, help, generate stubs <schema>, bridge --root R --workspace W --schema S (JSON from
standard input to standard output). Wrong use ends with 2, a failure with 1."""

from __future__ import annotations

import argparse
import sys

from . import errors as E
from .schema import parse_schema, stub

VERSION = "0.1.0"


def main(args: list[str]) -> int:
    if args in (["--version"], ["-V"]):
        print(f"logloom {VERSION}")
        return 0
    if args in ([], ["help"], ["--help"], ["-h"]):
        print(__doc__)
        return 0
    try:
        if args[:2] == ["generate", "stubs"] and len(args) == 3:
            with open(args[2], encoding="utf-8") as f:
                print(stub(parse_schema(f.read())))
            return 0
        if args[0] == "bridge":
            parser = argparse.ArgumentParser("logloom bridge")
            for name in ("root", "workspace", "schema"):
                parser.add_argument(f"--{name}", required=True)
            told = parser.parse_args(args[1:])
            from pyspark.sql import SparkSession

            from .api import Database

            with open(told.schema, encoding="utf-8") as f:
                text = f.read()
            spark = SparkSession.builder.config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
            print(Database.open(spark, told.root, told.workspace, text).execute_json(sys.stdin.read(), require_hash=True))
            return 0
    except (OSError, E.EngineError) as e:
        print(e, file=sys.stderr)
        return 1
    print(__doc__, file=sys.stderr)
    return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
