"""The command line that the jobs share: paths, a config file, one session."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession


def settings(job_file: str, given: dict | None = None) -> dict:
    """The job's own config file (same name, ``.json``) with ``given`` over it; unknown names are refused."""
    known = json.loads(Path(job_file).with_suffix(".json").read_text())
    odd = sorted(set(given or {}) - set(known))
    if odd:
        raise ValueError(f"unknown settings: {', '.join(odd)}")
    return known | (given or {})


def main(run: Callable[..., dict], paths: list[str], what: str, args: list[str] | None = None) -> dict:
    """Parse ``--<path>`` for each of ``paths`` and ``--config``, run the job in a session of its own, log and return its report."""
    parser = argparse.ArgumentParser(description=what)
    for p in paths:
        parser.add_argument(f"--{p}", required=True, help="a path that Spark can read and write, local or remote")
    parser.add_argument("--config", help="a JSON file whose values replace the job's own")
    given = parser.parse_args(args)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(levelname)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    over = json.loads(Path(given.config).read_text()) if given.config else None
    spark = SparkSession.builder.appName(what).getOrCreate()
    try:
        return run(spark, *(getattr(given, p) for p in paths), config=over)
    finally:
        spark.stop()
