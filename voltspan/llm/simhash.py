"""Near-duplicates by SimHash and a generalised pigeonhole search.

Fingerprints of texts link if they differ in few bits. The 64 bits are grouped into partitions, correlated bits together, and a
dynamic programme allots each partition a threshold of its own, so that the thresholds sum to distance - partitions + 1: any
two fingerprints within the distance are within the threshold in at least one partition. Its costs are the probes and the
estimated candidates. Fingerprints that share no bucket with another are done. Those in a bucket agree in its bits, so there the
same search goes on over the bits that are left, by a plan of its own, as long as that costs less than to verify. What
still shares a bucket at the end is verified through midpoints: two fingerprints differ in at most 2 bits if and only if some
64-bit value is at most one bit from both. That needs no pair of fingerprints, so a bucket of thousands of near copies costs as
much per row as any other.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from voltspan.llm.common import checkpoint, join_spread, unused
from voltspan.llm.components import components
from voltspan.tables import table

SHINGLE, SEED, BITS, DISTANCE = 3, 42, 64, 2
#: Rows that verifying costs for each fingerprint that shares a bucket: its midpoints, grouped and joined. A probe is a row, and one of the index too.
VERIFY_ROWS = 2 * (BITS + 1)


def fingerprint(text: str | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of a text as a signed 64-bit integer."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # of bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    data = memoryview(b" ".join(words))
    end = np.cumsum([len(w) + 1 for w in words]) - 1
    start = np.concatenate(([0], end[:-1] + 1))
    width = min(width, len(words))
    digest = xxhash.xxh64_intdigest
    count, n = np.zeros(BITS, np.int64), len(words) - width + 1
    for at in range(0, n, 1 << 15):
        pairs = zip(start[at : min(at + (1 << 15), n)].tolist(), end[at + width - 1 : min(at + (1 << 15), n) + width - 1].tolist(), strict=True)
        h = np.array([digest(data[a:b], seed) for a, b in pairs], "<u8")
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > n, bitorder="little").view("<i8")[0])


@arrow_udf(T.LongType())
def simhash(texts: pa.Array) -> pa.Array:
    """The fingerprint of each whole text; that of a text without a word, or of a null, is zero."""
    return pa.array([fingerprint(texts[i].as_py()) for i in range(len(texts))], pa.int64())


@arrow_udf(T.ArrayType(T.DoubleType()))
def _bit_products(prints: pa.Array) -> pa.Array:
    """One long list for a batch, at its first row: sums of products of the bits taken as 0 and 1; empty at the others."""
    bits = np.unpackbits(np.asarray(prints).astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
    return pa.array([(bits.T @ bits).ravel().tolist()] + [[]] * (len(prints) - 1)) if len(prints) else pa.array([], pa.list_(pa.float64()))


def bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints and the share of them in which each two bits are both set, over all rows; 4096 sums reach the driver."""
    sums = prints.select(F.posexplode(_bit_products("fp"))).groupBy("pos").agg(F.sum("col").alias("s")).collect()
    n, both = prints.count(), np.zeros(BITS * BITS)
    for r in sums:
        both[r["pos"]] = r["s"]
    return n, both.reshape(BITS, BITS) / max(n, 1)


@dataclass(frozen=True)
class Plan:
    """Bits of each partition, its threshold (-1: never probed), and the plan for the bits left to those who share its buckets (None: verify)."""

    partitions: tuple[tuple[int, ...], ...]
    thresholds: tuple[int, ...]
    then: tuple[Plan | None, ...] = ()


def group_bits(both: np.ndarray, parts: int, bits: tuple[int, ...] = tuple(range(BITS))) -> tuple[tuple[int, ...], ...]:
    """These bits in partitions of near equal width; a partition takes the free bit that correlates most with its bits."""
    mean = np.diag(both)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-9))
    like = np.abs((both - np.outer(mean, mean)) / np.outer(spread, spread))
    np.fill_diagonal(like, 0)
    free, out = set(bits), []
    for i in range(parts):
        width = len(bits) // parts + (i < len(bits) % parts)
        own = [max(sorted(free), key=lambda b: like[b, sorted(free)].sum())]
        free.remove(own[0])
        while len(own) < width:
            own.append(max(sorted(free), key=lambda b: like[b, own].sum()))
            free.remove(own[-1])
        out.append(tuple(sorted(own)))
    return tuple(out)


def within(both: np.ndarray, bits: tuple[int, ...], limit: int) -> float:
    """The estimated share of pairs that differ in at most `limit` of these bits, each bit on its own."""
    mean = np.diag(both)
    at_most = np.zeros(limit + 1)
    at_most[0] = 1
    for b in bits:
        p = 2 * mean[b] * (1 - mean[b])
        at_most[1:] = at_most[1:] * (1 - p) + at_most[:-1] * p
        at_most[0] *= 1 - p
    return float(at_most.sum())


def cheapest(n: float, both: np.ndarray, bits: tuple[int, ...], distance: int) -> tuple[float, Plan]:
    """The rows made for each of n fingerprints that may differ in these bits, and the plan that makes the fewest.

    A fingerprint has a candidate in a partition with the probability 1 - exp(-candidates), and then costs what is cheaper: its
    midpoints, or a further plan for the bits left, which is thought of where the partition's threshold is 0. Costs of partitions
    add up, so the programme keeps the cheapest choice for each sum of thresholds.
    """
    best = None
    for parts in range(1, min(distance + 1, len(bits)) + 1):
        groups = group_bits(both, parts, bits)
        known: dict[int, tuple[float, tuple[int, ...], tuple[Plan | None, ...]]] = {0: (0.0, (), ())}
        for own in groups:
            probes = [1, 1 + len(own), 1 + len(own) + len(own) * (len(own) - 1) // 2]
            options: list[tuple[int, float, Plan | None]] = [(-1, 0.0, None)]
            for t in range(min(distance, 2) + 1):
                found, rest, then = n * within(both, own, t), float(VERIFY_ROWS), None
                some = -np.expm1(-found)
                if t == 0 and parts > 1 and some * VERIFY_ROWS > 1:
                    further, plan = cheapest(found, both, tuple(b for b in bits if b not in own), distance)
                    if further < rest:
                        rest, then = further, plan
                options.append((t, 1 + probes[t] + some * rest, then))
            step: dict[int, tuple[float, tuple[int, ...], tuple[Plan | None, ...]]] = {}
            for total, (cost, chosen, plans) in known.items():
                for t, rows, then in options:
                    if total + t not in step or cost + rows < step[total + t][0]:
                        step[total + t] = (cost + rows, (*chosen, t), (*plans, then))
            known = step
        cost, chosen, plans = known.get(distance - parts + 1, (np.inf, (), ()))
        if best is None or cost < best[0]:
            best = (cost, Plan(groups, chosen, plans))
    return best


def allot(n: int, both: np.ndarray, distance: int = DISTANCE) -> Plan:
    """The partitions, thresholds and further plans of least cost for n fingerprints."""
    return cheapest(n, both, tuple(range(BITS)), distance)[1]


def _word(bits: tuple[int, ...]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >= 1 << 63 else value


def near(value: Column, bits: tuple[int, ...], limit: int) -> Column:
    """All values that differ from `value` in at most `limit` (0 to 2) of these bits, as an array."""
    flips = [0, *(_word((b,)) for b in bits if limit > 0), *(_word((a, b)) for a in bits for b in bits if limit > 1 and a < b)]
    return F.transform(F.array(*(F.lit(x).cast("long") for x in flips)), lambda x: x.bitwiseXOR(value))


def probe(prints: DataFrame, plan: Plan) -> DataFrame:
    """The fingerprints that share a bucket with another at the end of the plan; no pair is made. prints: distinct fingerprints in column fp.

    A bucket is known by a hash of all its bits; a collision could only add candidates. All plans of a depth are probed together,
    in one pass and one shuffle.
    """
    rows = prints.select("fp", F.lit(0).alias("part"), F.lit(0).cast("long").alias("bucket"))
    level, ends = {0: plan}, []
    while level:
        total, then, asked = rows.count(), [], F.lit(None)
        for node, own in level.items():
            keys = []
            for bits, limit, further in zip(own.partitions, own.thresholds, own.then or (None,) * len(own.partitions), strict=True):
                if limit >= 0:
                    keys.append(_keys(bits, limit, len(then)))
                    then.append(further)
            asked = F.when(F.col("part") == node, F.concat(*keys)).otherwise(asked)
        probes = rows.select("fp", F.explode(asked).alias("key")).select("fp", "key.*")
        buckets = probes.where(~F.col("moved")).groupBy("to").agg(F.count("*").alias("n")).select("to", "n", (F.col("n") > 1).alias("shared"))
        met = join_spread(probes, buckets, "to", total * len(then) // len(level)).where("shared or moved")
        met = checkpoint(met.select("fp", "part", F.col("to").alias("bucket")))
        level = {i: further for i, further in enumerate(then) if further}
        goes_on = F.col("part").isin(list(level))
        ends.append(met.where(~goes_on).select("fp"))
        rows = met.where(goes_on)
    return reduce(DataFrame.union, ends).distinct()


def _keys(bits: tuple[int, ...], limit: int, part: int) -> Column:
    """The buckets that a row probes in a partition, as structs of part, to and moved (not its own one); column bucket: where it comes from."""
    own = F.col("fp").bitwiseAND(F.lit(_word(bits)).cast("long"))
    return F.transform(
        near(own, bits, limit),
        lambda value: F.struct(F.lit(part).alias("part"), F.xxhash64("bucket", F.lit(part), value).alias("to"), (value != own).alias("moved")),
    )


def links(prints: DataFrame) -> DataFrame:
    """(fp, other) so that the fingerprints within distance 2 are connected: each to the smallest that shares a midpoint with it."""
    middle = prints.select("fp", F.explode(near(F.col("fp"), tuple(range(BITS)), 1)).alias("z"))
    shared = middle.groupBy("z").agg(F.min("fp").alias("other"), F.count("*").alias("n")).where("n > 1").drop("n")
    return middle.join(shared, "z").where("fp != other").select("fp", "other").distinct()


def print_links(prints: DataFrame) -> DataFrame:
    """(fp, other) so that the distinct fingerprints in column fp that are within distance 2 are connected, by the plan of least cost for them."""
    n, both = bit_statistics(prints)
    return links(probe(prints.select("fp"), allot(n, both)))


def near_duplicates(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, row, fp, component_id) of each row: row is a hash of key and text, component_id is the smallest key that its fingerprint reaches over links.

    Equal texts share a fingerprint, and only distinct fingerprints are searched. Null, empty and blank texts have fingerprint
    zero and link like others; very long texts are read whole. A repeated row gives a repeated result; a null key is never a
    component's smallest unless all are; an empty table gives no rows; extra columns, of any name, are left alone.
    """
    rows = checkpoint(docs.select(F.col(key).alias("key"), F.xxhash64(key, text).alias("row"), simhash(text).alias("fp")))
    prints = checkpoint(rows.groupBy("fp").agg(F.min("key").alias("least"), F.count("*").alias("n")))
    return named(rows, prints, components(print_links(prints), "fp", "other")).select(F.col("key").alias(key), "row", "fp", "component_id")


def named(rows: DataFrame, prints: DataFrame, roots: DataFrame) -> DataFrame:
    """Adds component_id to rows (with fp): the least key over all of fp's component. prints: each fp, its least key and its number n of rows; roots: (node, root) of linked ones."""
    first = prints.join(roots, prints.fp == roots.node).groupBy("root").agg(F.min("least").alias("first"), F.count("*").alias("n"))
    known = join_spread(roots, first, "root", roots.count()).select(F.col("node").alias("fp"), "first")
    names = checkpoint(prints.join(known.hint("merge"), "fp", "left").select("fp", "n", F.coalesce("first", "least").alias("component_id")))
    return join_spread(rows, names, "fp", names.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])


def first_of_each(docs: DataFrame, found: DataFrame, key: str, text: str) -> DataFrame:
    """The documents whose key is their component's, one row of each component; found: key, row, fp and component_id of each. All columns stay as they are."""
    found = found.where(F.col(key).eqNullSafe(F.col("component_id")))
    row, again = unused(docs, "row"), unused(docs, "again")
    chosen = found.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp"))).agg(F.min("row").alias(row)).select(row)
    kept = docs.withColumn(row, F.xxhash64(key, text)).join(chosen, row, "left_semi")
    whole = F.row_number().over(Window.partitionBy(row, key).orderBy(F.length(text)))  # rows that repeat as a whole
    return kept.withColumn(again, whole).where(F.col(again) == 1).select(*docs.columns)


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, that with its key; all columns stay as they are, whatever their names."""
    return first_of_each(docs, near_duplicates(docs, key, text), key, text)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
