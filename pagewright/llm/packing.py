"""Packing token sequences shortest-pack-first over the histogram of their lengths."""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewright.llm.common import written

SEQUENCE = 2048
#: Id that ends each document.
END = 1
#: Pieces that share a bucket of ranks, so that a length of many pieces is ranked by many tasks.
BUCKET_ROWS = 50_000

_encoders: dict[str, tuple] = {}


def encoder(json_path: str | None = None, ranks_path: str | None = None):
    """text -> ids of the byte-level BPE of ``json_path``.

    The ids come from the same vocabulary's rank file, read by a faster library; a text that holds the string of the
    special token goes through the vocabulary file itself, which gives that string its own id.
    """
    import base64

    import public_tokenizers
    import tiktoken

    json_path = json_path or public_tokenizers.path("byte_bpe_50k.json")
    ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    if json_path not in _encoders:
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        _encoders[json_path] = (fast, [])
    fast, slow = _encoders[json_path]

    def ids(text: str) -> list[int]:
        if "<|endoftext|>" not in text:
            return fast.encode_ordinary(text)
        if not slow:
            from tokenizers import Tokenizer

            slow.append(Tokenizer.from_file(json_path))
        return slow[0].encode(text, add_special_tokens=False).ids

    return ids


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): each document's ids with the end id, cut every SEQUENCE ids."""

    def run(batches):
        ids_of = encoder(json_path, ranks_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out: list[list] = [[], [], [], [], []]
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = np.array([*ids_of(text or ""), END], dtype="<u4")
                    for s in range(0, len(ids), SEQUENCE):
                        cut = ids[s : s + SEQUENCE]
                        for column, value in zip(out, (doc, s, len(cut), zlib.crc32(cut.tobytes()), len(ids)), strict=True):
                            column.append(value)
                kinds = [batch.schema.field(0).type, *[pa.int64()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=[id_col, "start", "length", "ids_crc32", "doc_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def patterns(histogram: dict[int, int], room: int = SEQUENCE) -> list[tuple[int, int, int, int, int, int]]:
    """Slots (length, first rank, sequences, repeats, first sequence, offset) that hold every piece of the histogram.

    Lengths go longest first, each to the packs with the most room left. Packs with the same filling are one pattern
    with a count; a pattern is split when only some of its packs take a piece. When no pack has room, new packs are
    opened and filled with as many pieces of that length as fit. A length ends within a few steps or uses up a pattern,
    so there are at most a few slots for each of the ``room`` lengths, however many pieces there are.
    """
    heap: list[tuple[int, int, int]] = []  # (-room left, first sequence, sequences)
    slots, opened = [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            if heap and -heap[0][0] >= length:
                space, first, count = heapq.heappop(heap)
                space = -space
            else:
                fit = room // length
                space, first, count = room, opened, max(1, left // fit)
                opened += count
            if left < count:
                heapq.heappush(heap, (-space, first + left, count - left))
                count = left
            repeats = min(space // length, left // count)
            slots.append((length, rank, count, repeats, first, room - space))
            rank += count * repeats
            left -= count * repeats
            if space > repeats * length:
                heapq.heappush(heap, (repeats * length - space, first, count))
    return slots


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """Pieces with sequence_id and offset; each sequence holds at most SEQUENCE ids, without gaps from 0.

    Only the histogram, one count for each of SEQUENCE lengths, reaches the driver. Pieces join the slots of their length
    by rank: a rank is the piece's place among those of its length, counted by buckets of a hash so that no length is
    ranked by one task. Null and empty texts are one piece, the end id. Repeated rows are packed each; rows with a null
    id too. An empty table gives an empty result.
    """
    cut = written(pieces(docs, id_col, text_col, json_path, ranks_path))
    spark = cut.sparkSession
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    buckets = max(1, sum(histogram.values()) // BUCKET_ROWS)
    slots = spark.createDataFrame(patterns(histogram), "length long, from_rank long, sequences long, repeats long, first long, at long")
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64(id_col, "start"), F.lit(buckets)))
    sizes = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    order = W.partitionBy("length", "bucket").orderBy(id_col, "start", "ids_crc32")
    ranked = dealt.withColumn("nth", F.row_number().over(order)).join(sizes, ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("nth") - 1)
    s = slots.withColumnRenamed("length", "l")
    inside = (F.col("length") == F.col("l")) & (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("from_rank") + F.col("sequences") * F.col("repeats"))
    # at most a few slots for each of SEQUENCE lengths: under 1 MB for any input
    placed = ranked.join(F.broadcast(s), inside).withColumn("q", F.col("rank") - F.col("from_rank"))
    return placed.select(
        id_col, "start", "length", "ids_crc32", "doc_tokens",
        (F.col("first") + F.col("q") % F.col("sequences")).alias("sequence_id"),
        (F.col("at") + F.floor(F.col("q") / F.col("sequences")) * F.col("length")).cast("long").alias("offset"),
    )
