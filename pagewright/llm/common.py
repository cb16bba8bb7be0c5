"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables that ``spark.checkpoint.dir`` names.

    Where it is unset, a temporary folder is made and set, but only in local mode (tests), where the one process is driver and
    executors: executors of a cluster don't see each other's folders.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = tempfile.mkdtemp(prefix="pagewright-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: its lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pagewright-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(column: pa.Array | pa.ChunkedArray):
    """Each text as UTF-8 bytes, null as empty."""
    binary = column.cast(pa.binary()) if not pa.types.is_binary(column.type) else column
    return (b"" if v is None else v for v in binary.to_pylist())


def crc_fold(doc_id: Column | str) -> Column:
    """crc32 of the id as text, modulo 5; rows with 0 are held out of every training."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 5, F.lit(0))


def whole_runs(batches, key: str):
    """Regroup a stream sorted by ``key`` so that no run of equal keys is cut between two yielded tables."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        start = int(np.searchsorted(keys, keys[-1], side="left"))
        if start:
            held.append(batch.slice(0, start))
            yield pa.Table.from_batches(held)
            held = [batch.slice(start)]
        elif held and held[-1].column(key)[0].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` vertices over the links a-b."""
    root = np.arange(n)
    while a.size:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if np.array_equal(root, before):
            break
    return root
