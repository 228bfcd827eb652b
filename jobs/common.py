"""What the jobs share: the config file, logging and the command line."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession

from wortnetz.session import session


def settings(name: str) -> dict:
    """The config file that lies beside the job."""
    return json.loads(Path(__file__).with_name(f"{name}.json").read_text())


def command_line(run: Callable, name: str, doc: str, paths: dict[str, str]) -> None:
    """Parses ``--config`` and one option per path, then runs the job in a session of its own; options win over the file."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=doc)
    parser.add_argument("--config", help="JSON file of paths and settings; else the one beside the job")
    for path, what in paths.items():
        parser.add_argument(f"--{path}", help=what)
    args = vars(parser.parse_args())
    given = args.pop("config")
    config = (json.loads(Path(given).read_text()) if given else settings(name)) | {k: v for k, v in args.items() if v}
    missing = [p for p in paths if not config.get(p)]
    if missing:
        parser.error("no path for " + ", ".join(missing))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark: SparkSession = session(spark_app_name=name)
    try:
        run(spark, **config)
    finally:
        spark.stop()
