"""Small tables written out in a query, for both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_KINDS = {"int": "INT", "long": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN", "array<string>": "VARCHAR[]"}


def _literal(value, kind: str) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    if value is None:
        text = "NULL"
    elif isinstance(value, list):
        text = "[" + ", ".join(map(quoted, value)) + "]"
    elif isinstance(value, str):
        text = quoted(value)
    else:
        text = str(value).lower()
    return f"CAST({text} AS {_KINDS[kind]})"


class Rows:
    """Rows with a schema: a DataFrame here, a VALUES list there."""

    def __init__(self, schema: str, rows: list[tuple]):
        self.schema, self.rows = schema, rows

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.schema)

    def sql(self) -> str:
        columns = [c.strip().split(" ") for c in self.schema.split(",")]
        rows = ("(" + ", ".join(_literal(v, k) for v, (_, k) in zip(r, columns, strict=True)) + ")" for r in self.rows)
        names = ", ".join(f'"{n}"' for n, _ in columns)
        return f"(SELECT * FROM (VALUES {', '.join(rows)}) v({names}))"
