"""Configuration in layers: defaults, laid over by JSON files, as nested values and as tables that operators take."""

from __future__ import annotations

import json
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def laid_over(default: Any, value: Any) -> Any:
    """``value`` over ``default``: objects key by key at every depth, anything else as a whole; a null leaves the default."""
    if value is None:
        return default
    if isinstance(default, dict) and isinstance(value, dict):
        return {k: laid_over(default.get(k), value.get(k)) for k in [*default, *(k for k in value if k not in default)]}
    return value


def load(spark: SparkSession, folder: str, defaults: dict[str, Any], required: tuple[str, ...] = ()) -> dict[str, Any]:
    """The value of each name of ``defaults``: what ``folder/name.json`` says, laid over its default.

    A file that is absent leaves the default, unless its name is ``required``. A file that is no JSON, or whose top is of another kind than the default, is an error that names it. Files
    are read by Spark, so a folder may be in any store that it reads; they are configuration and come to the driver whole.
    """
    out = {}
    for name, default in defaults.items():
        path = f"{folder.rstrip('/')}/{name}.json"
        try:
            (row,) = spark.read.text(path, wholetext=True).collect() or [(None,)]
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND" or name in required:
                raise
            row = (None,)
        try:
            value = json.loads(row[0]) if row[0] and row[0].strip() else None
        except ValueError as error:
            raise ValueError(f"{path} is not JSON: {error}") from error
        if value is not None and default is not None and isinstance(value, dict) != isinstance(default, dict):
            raise ValueError(f"{path} holds {'an object' if isinstance(value, dict) else 'no object'}, its default does otherwise")
        out[name] = laid_over(default, value)
    return out


def entries(spark: SparkSession, value: dict[str, Any] | list[Any], schema: str, key: str | None = None) -> DataFrame:
    """A list of objects as rows of ``schema``, or an object as one row for each of its names, which ``key`` holds; what an entry lacks is null.

    Entries that are no objects become the only other column.
    """
    columns = [c.split()[0] for c in _columns(schema)]
    rows = list(value) if isinstance(value, list) else [{key: k, **(v if isinstance(v, dict) else {next(c for c in columns if c != key): v})} for k, v in value.items()]
    rows = [r if isinstance(r, dict) else {columns[0]: r} for r in rows]
    return spark.createDataFrame([tuple(r.get(c) for c in columns) for r in rows], schema)


def _columns(schema: str) -> list[str]:
    """Top-level parts of a schema."""
    parts, depth, at = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            parts.append(schema[at:i].strip())
            at = i + 1
    return [*parts, schema[at:].strip()]
