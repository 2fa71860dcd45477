"""The settings of a training set, read from a JSON or YAML file (YAML where its reader is installed)."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from pathlib import PurePosixPath

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    raw_dir: str = "raw"
    processed_dir: str = "processed"
    seed: int = 42
    sizes: dict[str, int] = field(default_factory=dict)
    ratios: dict[str, float] = field(default_factory=dict)
    excluded_ids: tuple[str, ...] = ()

    def raw_file(self, split: str, kind: str) -> str:
        return str(PurePosixPath(self.raw_dir) / split / f"{kind}.json")

    def output_file(self, split: str) -> str:
        return str(PurePosixPath(self.processed_dir) / f"{split}.json")


def parsed(content: str, yaml: bool = False) -> Settings:
    """Unknown keys are refused; ids may be numbers."""
    if yaml:
        try:
            from yaml import safe_load as read
        except ImportError as e:
            raise RuntimeError("YAML settings need a YAML reader; use JSON") from e
    else:
        read = json.loads
    held = read(content) or {}
    unknown = set(held) - {f.name for f in fields(Settings)}
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    if "excluded_ids" in held:
        held["excluded_ids"] = tuple(str(x) for x in held["excluded_ids"] or ())
    return Settings(**held)


def settings(spark: SparkSession, path: str) -> Settings:
    """Read through Spark, so that the file may lie wherever the data do."""
    content = spark.read.text(path, wholetext=True).head()[0]
    return parsed(content, path.endswith((".yaml", ".yml")))
