"""Settings and logs that the jobs share."""

from __future__ import annotations

import argparse
import logging
import os
import tomllib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("genoloom.jobs")


def settings(name: str, path: str | None = None) -> dict:
    """The job's config file, or another in its place; a key that the job's own file lacks is an error."""
    with open(os.path.join(os.path.dirname(os.path.abspath(__file__)), f"{name}.toml"), "rb") as f:
        own = tomllib.load(f)
    if path:
        with open(path, "rb") as f:
            given = tomllib.load(f)
        if unknown := sorted(set(given) - set(own)):
            raise ValueError(f"{path}: unknown settings {', '.join(unknown)}")
        own |= given
    return own


def replace_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Write ``df`` so that of the partitions in ``path`` those that it has are replaced, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def command(name: str, about: str, paths: dict[str, str], run: Callable[..., object]) -> None:
    """The command line: plain paths, and ``--config``. It alone makes a session and stops it."""
    p = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=about)
    for k, text in paths.items():
        p.add_argument(k, help=text)
    p.add_argument("--config", help=f"settings in place of those in jobs/{name}.toml")
    a = p.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        run(spark, *(getattr(a, k) for k in paths), config=settings(name, a.config))
    finally:
        spark.stop()
