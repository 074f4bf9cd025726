"""A configuration from JSON, with keys from the environment laid over it."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import SparkSession


def at(config: dict, path: str, default: object = None) -> object:
    """What stands at a dotted path."""
    for name in path.split("."):
        if not isinstance(config, dict) or name not in config:
            return default
        config = config[name]
    return config


def put(config: dict, path: str, value: object) -> dict:
    """config with value at a dotted path; nothing else changes, the given one neither."""
    name, _, rest = path.partition(".")
    inner = config.get(name)
    return {**config, name: put(inner if isinstance(inner, dict) else {}, rest, value) if rest else value}


def overlaid(config: dict, environment: Mapping[str, str], names: dict[str, str], enables: dict[str, list[str]]) -> dict:
    """config with the environment's values that are not empty at the paths that names gives them, and each path of
    enables set to true where all the paths it stands on have a value."""
    for name, path in names.items():
        if environment.get(name):
            config = put(config, path, environment[name])
    for path, needed in enables.items():
        if all(at(config, n) for n in needed):
            config = put(config, path, True)
    return config


def load(spark: SparkSession, path: str, environment: Mapping[str, str] = {}, names: dict[str, str] = {}, enables: dict[str, list[str]] = {}) -> dict:
    """The JSON object at any path that Spark reads, overlaid."""
    return overlaid(json.loads(spark.read.text(path, wholetext=True).first()[0]), environment, names, enables)
