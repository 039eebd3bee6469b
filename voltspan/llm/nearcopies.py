"""Near copies by the exact Jaccard similarity of word shingles.

A SimHash of 64 bits can't serve a similarity of 0.8: such pairs differ in about 10 bits and often in 15, and no pigeonhole over 64
bits is selective at that distance. Candidates come from MinHash bands instead, which two texts share with a probability that depends
on their similarity alone; every candidate is verified on the whole sets of shingles. A text of a bucket is compared with one other of
that bucket, drawn anew for each band, so rows grow in proportion to texts and not with the square of a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from voltspan.llm.common import checkpoint, discard, fresh, give_back, lists, mix, window_hashes, word_hashes, word_spans, written
from voltspan.llm.components import components
from voltspan.llm.simhash import fingerprint, first_of_each, named, print_links

SHINGLE, SIMILARITY = 5, 0.8
#: At similarity 0.8 a pair shares a band with probability 0.8**5, and none of 32 with probability 3e-6.
BANDS, ROWS = 32, 5
#: Hashes of texts in pairs that are broadcast at most: some 10 MB.
FILTER = 1 << 20
#: Values of the min-wise hashes that are computed at once.
STEP = 1 << 14
_RNG = np.random.default_rng(20240602)
_ODD, _ADD = _RNG.integers(1, 2**63, (2, BANDS * ROWS, 1), dtype=np.uint64) | np.uint64(1)


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """The distinct 64-bit hashes of the runs of `width` words (A-Z lower-cased), sorted; a shorter text is one run, one without a word has none."""
    data = np.frombuffer((text or "").encode("utf-8", "replace").lower(), np.uint8)
    words = word_hashes(data, *word_spans(data)) if len(data) else np.zeros(0, np.uint64)
    return np.unique(window_hashes(words, min(width, len(words)))) if len(words) else words


def bands(own: np.ndarray) -> np.ndarray:
    """A 64-bit value of each band: a hash of the least values of the set under the band's min-wise hashes."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(own), STEP):
        h = own[None, at : at + STEP] * _ODD + _ADD
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x7FB5D329728EA185)
        np.minimum(least, h.min(axis=1), out=least)
    z = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        z = mix(z * np.uint64(0x9E3779B97F4A7C15) + row)
    return z.view(np.int64)


def sketch(width: int, simhash: bool = False):
    """A function of a text column: fp, a hash of the set of shingles; the set; its bands (none for an empty set); and, if asked for, the text's SimHash."""
    kind = T.StructType([T.StructField("fp", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType())), T.StructField("bands", T.ArrayType(T.LongType()))])
    if simhash:
        kind = kind.add("simhash", T.LongType())

    def one(texts: pa.Array) -> pa.Array:
        fps, sets, keys, prints = [], [], [], []
        for text in texts:
            own = shingles(text := text.as_py(), width)
            if simhash:
                prints.append(fingerprint(text))
            fps.append(int(window_hashes(own, len(own)).view(np.int64)[0]) if len(own) else 0)
            sets.append(own.view(np.int64))
            keys.append(bands(own) if len(own) else np.zeros(0, np.int64))
        more = [pa.array(prints, pa.int64())] if simhash else []
        return pa.StructArray.from_arrays([pa.array(fps, pa.int64()), lists(sets), lists(keys), *more], [f.name for f in kind])

    @arrow_udf(kind)
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield one(texts)
            give_back()

    return of


def candidates(prints: DataFrame) -> DataFrame:
    """(a, b), a < b: each fp with one other of each of its buckets. prints: distinct fp with its bands.

    The one that a bucket's others are compared with has the least fp XOR band, so it differs from band to band.
    """
    each = prints.select("fp", F.explode("bands").alias("z"))
    least = each.groupBy("z").agg(F.min(F.col("fp").bitwiseXOR(F.col("z"))).alias("least"), F.count("*").alias("n")).where("n > 1")
    pairs = each.join(least, "z").select("fp", F.col("least").bitwiseXOR(F.col("z")).alias("other")).where("fp != other")
    return pairs.select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b")).distinct()


def links(sets: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose sets have the Jaccard similarity or more. sets: fp and shingles."""
    left, right = (sets.select(F.col("fp").alias(k), F.col("shingles").alias(f"s{k}")) for k in "ab")
    both = pairs.join(left, "a").join(right, "b").where(F.least(F.size("sa"), F.size("sb")) >= similarity * F.greatest(F.size("sa"), F.size("sb")))
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(shared >= similarity * (F.size("sa") + F.size("sb") - shared)).select("a", "b")


def sketched(docs: DataFrame, key: str, text: str, width: int, at: str, simhash: bool = False) -> DataFrame:
    """key, row (a hash of key and text) and the sketch of each text, in a table written at a path."""
    return written(docs.select(F.col(key).alias("key"), F.xxhash64(key, text).alias("row"), sketch(width, simhash)(F.col(text)).alias("s")).select("key", "row", "s.*"), at=at)


def set_links(rows: DataFrame, similarity: float) -> DataFrame:
    """(a, b): the fp of candidates whose sets have the similarity. rows: fp, shingles and bands, repeats too."""
    pairs = written(candidates(rows.select("fp", "bands").dropDuplicates(["fp"])), tidy=True)
    ends = pairs.select(F.col("a").alias("fp")).union(pairs.select(F.col("b").alias("fp"))).distinct()
    # most sets are in no pair: they are left out where they are, by FILTER hashes at most, before the others are shuffled
    sieve = F.pmod(F.xxhash64("fp"), F.lit(FILTER)).alias("h")
    near = rows.select("fp", "shingles", sieve).join(F.broadcast(ends.select(sieve).distinct()), "h", "left_semi").drop("h")
    sets = near.join(ends, "fp", "left_semi").dropDuplicates(["fp"])
    return written(links(sets, pairs, similarity), tidy=True)


def near_copies(docs: DataFrame, key: str, text: str, width: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(key, row, fp, component_id) of each row: row is a hash of key and text, component_id the smallest key that its text reaches over links.

    Texts with the same set of shingles share fp, as do null, empty and blank ones. A null key is never a component's smallest unless all are.
    """
    spark = docs.sparkSession
    rows = sketched(docs, key, text, width, at := fresh(spark))
    prints = checkpoint(rows.groupBy("fp").agg(F.min("key").alias("least"), F.count("*").alias("n")))
    roots = components(set_links(rows, similarity), "a", "b")
    found = written(named(rows.select("key", "row", "fp"), prints, roots).select(F.col("key").alias(key), "row", "fp", "component_id"), tidy=True)
    discard(spark, at)  # the sets are larger than the texts
    return found


def copies_by_both(docs: DataFrame, key: str, text: str, width: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(key, row, fp, component_id) of each row, as by near_copies, over the links of near_copies and of simhash.near_duplicates together; fp is the SimHash.

    The nodes are SimHashes, so that one search for components has all links: a set of shingles stands at the least SimHash of its texts, which the
    others of its texts (the same runs of words, but not as often) are linked to.
    """
    spark = docs.sparkSession
    rows = sketched(docs, key, text, width, at := fresh(spark), simhash=True)
    prints = written(rows.groupBy(F.col("simhash").alias("fp")).agg(F.min("key").alias("least"), F.count("*").alias("n")), tidy=True)
    sets = written(rows.groupBy("fp").agg(F.min("simhash").alias("at"), F.max("simhash").alias("last")), tidy=True)
    a, b = (sets.select(F.col("fp").alias(k), F.col("at").alias(f"at_{k}")) for k in "ab")
    alike = set_links(rows, similarity).join(a.hint("merge"), "a").join(b.hint("merge"), "b").select(F.col("at_a").alias("a"), F.col("at_b").alias("b"))
    same = rows.select("fp", "simhash").distinct().join(sets.where("at != last").hint("merge"), "fp").select(F.col("simhash").alias("a"), F.col("at").alias("b"))
    edges = print_links(prints).toDF("a", "b").union(alike).union(same)
    roots = components(written(edges, tidy=True), "a", "b")
    found = written(named(rows.select("key", "row", F.col("simhash").alias("fp")), prints, roots).select(F.col("key").alias(key), "row", "fp", "component_id"), tidy=True)
    discard(spark, at)
    return found


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each component, that with its key; all columns stay as they are, whatever their names."""
    return first_of_each(docs, near_copies(docs, key, text, width, similarity), key, text)


def united(one: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """(key, row, fp, component_id): each row once, by the components of two searches together. one, other: what near_copies or simhash.near_duplicates found for
    the same rows, with whole numbers as keys. A row without a key is where its components' smallest keys are."""
    second = other.select("row", F.col("component_id").alias("_other")).dropDuplicates(["row"])
    both = one.dropDuplicates(["row"]).join(second.hint("merge"), "row")
    both = written(both.select("row", key, "fp", F.coalesce(key, "component_id", "_other").alias("_node"), "component_id", "_other"), tidy=True)
    ends = F.explode(F.array(F.col("component_id"), F.col("_other")))
    edges = both.select(F.col("_node").alias("a"), ends.alias("b")).where("a != b").distinct()
    roots = components(written(edges, tidy=True), "a", "b")
    named_by = both.join(roots.hint("merge"), F.col("_node") == F.col("node"), "left")
    return named_by.select(key, "row", "fp", F.coalesce("root", "_node").alias("component_id"))
