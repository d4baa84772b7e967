"""What the jobs share: the command line with its configuration file, and the session that it makes."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession


def configured(defaults: str, given: dict) -> dict:
    """The configuration file beside the jobs, with what is given in place of its values; an unknown name is a ValueError."""
    known = json.loads((Path(__file__).parent / defaults).read_text())
    if extra := set(given) - set(known):
        raise ValueError(f"unknown settings {sorted(extra)}; there are {sorted(known)}")
    return known | given


def _value(text: str):
    """JSON, or else the text as it is."""
    try:
        return json.loads(text)
    except ValueError:
        return text


def main(run: Callable[[SparkSession, dict], dict], defaults: str, about: str) -> None:
    """An option for each setting, such as --source PATH, and --config FILE with several; the session is made and stopped here alone."""
    parser = argparse.ArgumentParser(description=about, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("--config", help=f"JSON file with settings in place of those in jobs/{defaults}")
    for name, value in configured(defaults, {}).items():
        parser.add_argument(f"--{name.replace('_', '-')}", dest=name, metavar="VALUE", help=f"default: {json.dumps(value)}")
    args = vars(parser.parse_args())
    config = args.pop("config")
    given = json.loads(Path(config).read_text()) if config else {}
    given |= {name: _value(value) for name, value in args.items() if value is not None}
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(run.__module__).getOrCreate()
    try:
        print(json.dumps(run(spark, configured(defaults, given))))
    finally:
        spark.stop()
