"""Token ids in files of directly addressable codes: any token is read by itself, without decoding a block around it.

An id is cut into chunks of bits, lowest first. Level 0 has the first chunk of every id, level j the j-th chunk of those ids that need it.
Each level but the last has a bitmap that says which of its codes go on, and a rank directory: the number of codes that go on before each
512th. So token i's chunk at level 0 is code i, at level 1 code rank(i), and so on; a run of tokens is one run of codes in each level. The
widths of the levels are chosen for each file by dynamic programming over the bits that its ids need.

A file: 4 bytes `VDAC`, then little-endian uint32 levels, uint64 ids, uint64 documents; for each level uint32 width, uint64 codes, and uint64
places of its codes, bitmap and directory; then the places of the documents' starts (uint64, one more than documents), keys (int64) and the
bytes that say whether a key is there. Files are written by tasks under names of their own, in ascending order of keys; the manifest, a
Parquet table that Spark commits, names those that count, so lost or repeated tasks leave only files that nothing reads.
"""

from __future__ import annotations

import struct as binary
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltspan.llm.common import checkpoint_folder, chunks, give_back, unused
from voltspan.llm.common import struct as row_of
from voltspan.llm.segments import ids_by
from voltspan.tables import table

MAGIC, END_ID, BLOCK = b"VDAC", 0, 512
#: Ids in a file, at most those of one more run of texts; ids that a reader takes at once; bytes of text that a partition gets, and that are tokenised at once (or one text).
FILE_IDS, RUN_IDS, PART_BYTES, TEXT_BYTES = 1 << 24, 1 << 20, 256_000_000, 20_000_000
HEAD, LEVEL = binary.Struct("<4sIQQ"), binary.Struct("<IQQQQ")
MANIFEST = row_of(part="int", place="int", file="string", n_ids="long", n_docs="long", widths="string")
_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def level_widths(ids: np.ndarray) -> list[int]:
    """The widths of the levels with the fewest bits in all: codes, bitmap and directory."""
    top = max(1, int(ids.max(initial=0)).bit_length())
    over = [len(ids)] * 2 + [np.count_nonzero(ids >= 1 << (t - 1)) for t in range(2, top + 1)] + [0]  # over[t]: ids of t bits or more
    best, choice = {top: 0.0}, {}
    for t in range(top - 1, -1, -1):
        cost = {u: float(over[t + 1]) * (u - t + (1 + 64 / BLOCK if u < top else 0)) + best[u] for u in range(t + 1, top + 1)}
        choice[t] = min(cost, key=cost.get)
        best[t] = cost[choice[t]]
    out, t = [], 0
    while t < top:
        out.append(choice[t] - t)
        t = choice[t]
    return out


def packed(codes: np.ndarray, width: int) -> bytes:
    """Codes of `width` bits each, lowest bit first, and eight bytes more so that any code can be read as one word."""
    parts = []
    for at in range(0, len(codes), 1 << 20):  # a multiple of eight codes: parts end at whole bytes
        if width < 16:  # eight codes are `width` bytes: two words of four codes each, put together
            some = codes[at : at + (1 << 20)]
            some = np.concatenate((some, np.zeros(-len(some) % 8, some.dtype))).reshape(-1, 2, 4).astype(np.uint64)
            four = (some << (np.arange(4) * width).astype(np.uint64)).sum(axis=2, dtype=np.uint64)
            eight = np.stack((four[:, 0] | four[:, 1] << np.uint64(4 * width), four[:, 1] >> np.uint64(64 - 4 * width)), 1).astype("<u8")
            parts.append(eight.view(np.uint8)[:, :width].tobytes()[: (min(len(codes) - at, 1 << 20) * width + 7) // 8])
            continue
        bits = (codes[at : at + (1 << 20), None] >> np.arange(width, dtype=np.uint32)) & 1
        parts.append(np.packbits(bits.astype(np.uint8), bitorder="little").tobytes())
    return b"".join(parts) + bytes(8)


def unpacked(data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The codes at these places (bits from the start of data)."""
    word, byte = np.zeros(len(at), np.uint64), at >> 3
    for i in range((width + 7 + 7) // 8):
        word |= data[byte + i].astype(np.uint64) << np.uint64(8 * i)
    return ((word >> (at & 7).astype(np.uint64)) & np.uint64((1 << width) - 1)).astype(np.uint32)


def built(ids: np.ndarray, starts: np.ndarray, keys: list[int | None]) -> tuple[bytes, list[int]]:
    """A file of these ids, and the widths of its levels."""
    widths, level, shift = level_widths(ids), ids.astype(np.uint32), 0
    at, heads, body = HEAD.size + LEVEL.size * len(widths) + 24, [], []

    def put(data: bytes) -> int:
        nonlocal at
        body.append(data)
        at += len(data)
        return at - len(data)

    for i, width in enumerate(widths):
        codes = put(packed(level & np.uint32((1 << width) - 1), width))
        rest = level >> np.uint32(width) if width < 32 else np.zeros_like(level)
        bitmap = directory = 0
        if i + 1 < len(widths):
            more = rest > 0
            bitmap = put(np.packbits(more, bitorder="little").tobytes())
            sums = np.concatenate(([0], np.cumsum(more, dtype=np.uint64)))
            directory = put(sums[: len(more) + 1 : BLOCK].astype("<u8").tobytes())
        heads.append(LEVEL.pack(width, len(level), codes, bitmap, directory))
        level, shift = rest[rest > 0], shift + width
    tables = [put(starts.astype("<u8").tobytes()), put(np.array([k or 0 for k in keys], "<i8").tobytes()), put(bytes(k is not None for k in keys))]
    return b"".join([HEAD.pack(MAGIC, len(widths), len(ids), len(keys)), *heads, binary.pack("<3Q", *tables), *body]), widths


class Codes:
    """A file of codes, read in place: `read(place, size)` gives bytes of it."""

    def __init__(self, read: Callable[[int, int], bytes]):
        self.read = read
        magic, n, self.n_ids, self.n_docs = HEAD.unpack(read(0, HEAD.size))
        if magic != MAGIC:
            raise ValueError("not a file of codes")
        heads = read(HEAD.size, LEVEL.size * n + 24)
        self.levels = [LEVEL.unpack_from(heads, LEVEL.size * i) for i in range(n)]
        self.tables = binary.unpack_from("<3Q", heads, LEVEL.size * n)

    def documents(self) -> tuple[np.ndarray, list[int | None]]:
        """Starts of the documents, and the end of the last; their keys."""
        starts = np.frombuffer(self.read(self.tables[0], 8 * (self.n_docs + 1)), "<u8").astype(np.int64)
        keys, there = np.frombuffer(self.read(self.tables[1], 8 * self.n_docs), "<i8"), self.read(self.tables[2], self.n_docs)
        return starts, [int(k) if t else None for k, t in zip(keys, there, strict=True)]

    def rank(self, level: int, i: int) -> int:
        """How many of the first i codes of a level go on: one entry of the directory, and under a block of the bitmap."""
        _, _, _, bitmap, directory = self.levels[level]
        (before,) = binary.unpack("<Q", self.read(directory + 8 * (i // BLOCK), 8))
        rest = i % BLOCK
        if not rest:
            return before
        part = np.frombuffer(self.read(bitmap + i // BLOCK * (BLOCK // 8), (rest + 7) // 8), np.uint8).copy()
        if rest & 7:
            part[-1] &= (1 << (rest & 7)) - 1
        return before + int(_POPCOUNT[part].sum())

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from start to stop."""
        if not 0 <= start <= stop <= self.n_ids:
            raise IndexError(f"{start} to {stop} of {self.n_ids}")
        out, where, shift = np.zeros(stop - start, np.uint32), np.arange(stop - start), 0
        for i, (width, _, codes, bitmap, _) in enumerate(self.levels):
            if start == stop:
                break
            first = start * width // 8
            data = np.frombuffer(self.read(codes + first, stop * width // 8 + 8 - first), np.uint8)
            out[where] |= unpacked(data, np.arange(start, stop) * width - 8 * first, width) << np.uint32(shift)
            if i + 1 < len(self.levels):
                byte = start // 8
                more = np.unpackbits(np.frombuffer(self.read(bitmap + byte, (stop + 7) // 8 - byte), np.uint8), bitorder="little")[start - 8 * byte : stop - 8 * byte].astype(bool)
                start = self.rank(i, start)
                stop, where, shift = start + int(more.sum()), where[more], shift + width
        return out

    def one(self, i: int) -> int:
        """The id at place i: a code, a bit and a rank for each level that it has."""
        return int(self.ids(i, i + 1)[0])


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a uri and the path in it; a bare path is a local one."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def reading(uri: str):
    """A function that reads bytes of a file in place."""
    system, path = opened(uri)
    file = system.open_input_file(path)
    return lambda place, size: file.read_at(size, place)


def write_codes(docs: DataFrame, key: str, text: str, tokenizer: str, path: str, end_id: int = END_ID) -> None:
    """Tokenises whole texts and writes their ids, each document's followed by the end id, under `path` (a uri that all machines share).

    Documents are in ascending order of the key (long; no key comes first), those of one key by a hash of their text, repeated rows as
    often as they occur. A null text is empty: the end id alone. An empty table makes an empty manifest. A very long text is one
    task's row, in a file that may exceed FILE_IDS by it. Other columns are left out.
    """
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_BYTES))
    bare = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    placed = bare.withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})  # a key with many rows is still split by these
    ordered = placed.repartitionByRange(parts, "key", "tie", "row").sortWithinPartitions("key", "tie", "row").select("key", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part, place = ids_by(tokenizer), TaskContext.get().partitionId(), 0
        texts, held, size = [], [], 0

        def tokenised() -> None:
            nonlocal texts, size
            keys, some = (pa.concat_arrays([t[i] for t in texts]) for i in (0, 1))
            ids = tokens.of(some)
            held.append((np.insert(ids.values, np.cumsum(ids.counts), end_id), ids.counts + 1, keys.to_pylist()))
            texts, size = [], 0
            del some, ids
            give_back()

        def flushed() -> pa.RecordBatch:
            nonlocal held, place
            ids, lengths = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            content, widths = built(ids, np.concatenate(([0], np.cumsum(lengths))), [k for h in held for k in h[2]])
            system, folder = opened(path)
            system.create_dir(folder, recursive=True)
            name = f"{part:06d}-{place:06d}-{uuid.uuid4().hex}.codes"
            with system.open_output_stream(f"{folder}/{name}") as out:
                out.write(content)
            row = [[part], [place], [name], [len(ids)], [len(lengths)], [",".join(map(str, widths))]]
            held, place = [], place + 1
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], MANIFEST.names)

        for batch in batches:
            for some in chunks(pc.binary_length(batch["text"]).to_pylist(), TEXT_BYTES):
                mine = batch.slice(some.start, some.stop - some.start)
                texts.append((mine["key"], mine["text"]))
                size += mine["text"].nbytes
                if size >= TEXT_BYTES:
                    tokenised()
                    if sum(len(h[0]) for h in held) >= FILE_IDS:
                        yield flushed()
        if texts:
            tokenised()
        if held:
            yield flushed()

    ordered.mapInArrow(write, MANIFEST).write.parquet(f"{path}/manifest")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The files that count: part, place, file, n_ids, n_docs, widths, and start, the ids of all files before. One row for each
    file of some 16 million ids, whose running sum is one small task."""
    earlier = Window.orderBy("part", "place").rowsBetween(Window.unboundedPreceding, -1)
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest").withColumn("start", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)))


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    """(key, start, ids) of each document: the ids of all documents before it, and its own, as little-endian unsigned 32-bit integers."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, first in zip(batch["file"].to_pylist(), batch["start"].to_pylist(), strict=True):
                codes = Codes(reading(f"{path}/{file}"))
                starts, keys = codes.documents()
                for some in chunks(np.diff(starts).tolist(), RUN_IDS):
                    low, high = int(starts[some.start]), int(starts[some.stop])
                    ids, inner = codes.ids(low, high).astype("<u4").tobytes(), starts[some.start : some.stop + 1] - low
                    each = [ids[4 * a : 4 * b] for a, b in zip(inner[:-1], inner[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(keys[some], pa.int64()), pa.array(starts[some.start : some.stop] + first), pa.array(each, pa.binary())], ["key", "start", "ids"])

    files = manifest(spark, path).select("file", "start")
    return files.repartition(max(1, files.count())).mapInArrow(read, "key long, start long, ids binary")


def tokens_at(places: DataFrame, place: str, path: str) -> DataFrame:
    """Adds `id`, the token at a place counted over all files (null off their ends, or for a null place). Reads only the few bytes of each.

    Places meet the files by a range of the running sum: a sorted list of their starts is broadcast (eight bytes for each 16 million ids).
    """
    spark = places.sparkSession
    rows = manifest(spark, path).select("file", "start", "n_ids").orderBy("start").collect()
    starts, files, end = np.array([r["start"] for r in rows], np.int64), [r["file"] for r in rows], sum(r["n_ids"] for r in rows)
    name = unused(places, "id")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, codes = None, None
        for batch in batches:
            found = []
            for p in batch.column(batch.schema.get_field_index(place)).to_pylist():
                if p is None or not 0 <= p < end:
                    found.append(None)
                    continue
                k = int(np.searchsorted(starts, p, "right")) - 1
                if k != at:
                    at, codes = k, Codes(reading(f"{path}/{files[k]}"))
                found.append(codes.one(p - int(starts[k])))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], [*batch.schema.names, name])

    return places.repartitionByRange(place).sortWithinPartitions(place).mapInArrow(look, T.StructType([*places.schema.fields, T.StructField(name, T.LongType())]))


def op11_addressable_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of all documents, written as directly addressable codes and read back."""
    import public_tokenizers

    path = f"{checkpoint_folder(spark)}/codes-{uuid.uuid4().hex}"
    write_codes(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json"), path)
    back = read_codes(spark, path)
    return back.select(F.col("key").alias("doc_id"), "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
