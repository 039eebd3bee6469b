"""Harmonic packing of tokenised documents into sequences of a fixed capacity.

Lengths fall into reciprocal-capacity classes: class k holds pieces of which k, and no more, fit in a sequence, so each of its
sequences takes a fixed number of pieces and workers can fill them without knowing of each other. A document is cut into pieces
that fill their class to a small tolerance: full sequences first, then the rest is kept whole where k times its length nearly
fills a sequence, or else is cut at the next class's limit. What is left in a class (under k pieces) is packed together at the end.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from voltspan.llm.common import checkpoint, struct
from voltspan.tables import table

CAPACITY, END_ID, TOLERANCE, BUCKETS = 1024, 0, 0.03, 1024
PIECE = struct(start="long", length="long", ids_crc32="long", doc_tokens="long")
#: Fixed value: the split pattern of the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 for itself, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def encoding(path: str) -> tiktoken.Encoding:
    """The byte-level BPE of a tokenizer file; its merges are in the order of their ids. Special tokens in a text become their ids."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    alphabet = byte_alphabet()
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(alphabet[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in special}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


def cut(total: int, capacity: int = CAPACITY, tolerance: float = TOLERANCE) -> list[int]:
    """Lengths of the pieces of a document of `total` ids, each filling its class to the tolerance."""
    out, rest = [capacity] * (total // capacity), total % capacity
    while rest:
        k = capacity // rest
        own = rest if k * rest >= (1 - tolerance) * capacity else capacity // (k + 1)
        out.append(own)
        rest -= own
    return out


def pieces_of(path: str, end_id: int, capacity: int, tolerance: float):
    """A UDF: the pieces of each text, tokenised whole. A null text counts as empty: just the end id."""

    @arrow_udf(T.ArrayType(PIECE))
    def pieces(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = encoding(path)
        for texts in batches:
            rows, offsets = [], [0]
            for i in range(len(texts)):
                ids = np.array([*bpe.encode(texts[i].as_py() or "", allowed_special="all", disallowed_special=()), end_id], "<u4")
                start = 0
                for length in cut(len(ids), capacity, tolerance):
                    rows.append((start, length, zlib.crc32(ids[start : start + length].tobytes()), len(ids)))
                    start += length
                offsets.append(len(rows))
            columns = [pa.array(np.array(c, np.int64)) for c in zip(*rows, strict=True)] or [pa.array([], pa.int64())] * 4
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, PIECE.names))

    return pieces


def fill_rest(capacity: int, first_id: int):
    """A group function: first fit, longest first, of the few pieces that no class could make a full sequence of."""

    def fill(batch: pa.Table) -> pa.Table:
        length = np.array(batch["length"])
        room, sequence, offset = [], np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for i in sorted(range(len(length)), key=lambda j: (-length[j], batch["class"][j].as_py(), batch["rank"][j].as_py())):
            at = next((k for k, r in enumerate(room) if r >= length[i]), len(room))
            if at == len(room):
                room.append(capacity)
            sequence[i], offset[i] = first_id + at, capacity - room[at]
            room[at] -= int(length[i])
        for name, column in (("sequence_id", sequence), ("offset", offset)):
            batch = batch.set_column(batch.schema.get_field_index(name), name, pa.array(column))
        return batch

    return fill


def pack(docs: DataFrame, key: str, text: str, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per piece: the key, start, length, ids_crc32, doc_tokens, sequence_id and offset.

    Rows that repeat are packed as often as they occur; a null text is the end id alone; an empty table has no pieces. Each piece
    is ranked within its class by a fixed set of hash buckets and their running counts, so no task sees a whole class.
    """
    spark = docs.sparkSession
    made = docs.select(F.col(key).alias("key"), pieces_of(tokenizer, end_id, capacity, tolerance)(text).alias("made")).select("key", F.inline_outer("made"))
    made = made.withColumns({"class": F.floor(F.lit(capacity) / F.col("length")).cast("int"), "bucket": F.pmod(F.xxhash64("key", "start"), F.lit(BUCKETS)).cast("int")})
    made = checkpoint(made)  # tokenised once: the counts below and the ranks read the pieces
    counts = made.groupBy("class", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("class").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("class", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    base, kinds, total = 0, [], {r[0]: r[1] for r in counts.groupBy("class").agg(F.sum("n")).collect()}  # at most `capacity` classes
    for k in sorted(total):
        kinds.append((k, base, total[k] // k))
        base += total[k] // k
    kinds = spark.createDataFrame(kinds, "class int, first_id long, full long")
    rank = F.row_number().over(Window.partitionBy("class", "bucket").orderBy("key", "start")) - 1
    # first has a row for each of the classes and buckets at most; both sides are fixed numbers
    ranked = made.withColumn("rank", rank).join(F.broadcast(first), ["class", "bucket"]).join(F.broadcast(kinds), "class")
    ranked = ranked.withColumn("rank", F.col("first") + F.col("rank")).withColumn("bin", F.floor(F.col("rank") / F.col("class")))
    names = ["key", "start", "length", "ids_crc32", "doc_tokens", "class", "rank", "sequence_id", "offset"]
    ranked = ranked.withColumn("sequence_id", F.when(F.col("bin") < F.col("full"), F.col("first_id") + F.col("bin")))
    earlier = Window.partitionBy("sequence_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    full = ranked.where(F.col("sequence_id").isNotNull()).withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0))).select(names)
    # under k pieces of each class k: a fixed number of rows whatever the input
    rest = ranked.where(F.col("sequence_id").isNull()).withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).select(names)
    rest = rest.withColumn("tail", F.col("class") * 0)
    rest = rest.groupBy("tail").applyInArrow(fill_rest(capacity, base), rest.schema).drop("tail")
    return full.unionByName(rest).withColumnRenamed("key", key).drop("rank")


def default_tokenizer() -> str:
    """The path of the byte-level tokenizer file of the installed vocabulary package."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024."""
    packed = pack(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", default_tokenizer())
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "class")
