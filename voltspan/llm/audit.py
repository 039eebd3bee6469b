"""How filters interact: each filter's work in every order in which they could be applied.

A direct relational replay. Each document's failures are a bit mask; masks meet all orders of the filters (a broadcast of n! rows, 120 for
five filters), each order's steps are exploded, the step of the first failure says which filter removes the document there, and the
counts are conditional sums that are combined on the map side. A group is a part, an order and a step: 600 for each part, whatever the input.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voltspan.llm.common import HEAVY, written
from voltspan.tables import table

#: The white space that parts words, and its regular expression.
BLANKS, BLANK = " \t\n\x0b\x0c\r", r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    """The maximal runs without white space; none in a blank text."""
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK))


def later_copies(docs: DataFrame, key: str, digest: str) -> DataFrame:
    """Adds `is_copy`: whether a row with a smaller key has the same digest. A row without a key never is one.

    Digests that many rows share meet a broadcast of theirs (under HEAVY rows) in place, so no group of copies lands in one task;
    of the others, only those with copies are joined.
    """
    groups = written(docs.groupBy(digest).agg(F.min(key).alias("_first"), F.count("*").alias("_n")).where("_n > 1"))
    frequent = F.col("_n") > docs.count() / HEAVY
    often, seldom = F.broadcast(groups.where(frequent).drop("_n")), groups.where(~frequent).drop("_n")
    joined = docs.join(often, digest).unionByName(docs.join(often, digest, "left_anti").join(seldom, digest, "left"))
    return joined.withColumn("is_copy", F.coalesce(F.col(key) > F.col("_first"), F.lit(False))).drop("_first")


def replay(flagged: DataFrame, part: str, filters: Mapping[str, str], lost: Mapping[str, str] | None = None) -> DataFrame:
    """What each filter does at each step of each order, by part.

    flagged: a row per document with a boolean column for each filter (true: it fails; null counts as false). filters: name of one
    character to its column. lost: name of a further count to the boolean column of the documents that it counts among those removed.
    Returns a row, zeros included, per part (null: empty string), filter_order and step (from 1, the filter at that place of the order):
    kept after it, removed by it, redundant (fails it, removed earlier), unique_fails (fails it alone), the counts of `lost`, and
    shapley, the filter's removed summed over all orders. Repeated rows count as often as they occur; an empty table has no part.
    """
    names, lost = list(filters), dict(lost or {})
    if any(len(n) != 1 for n in names) or len(set(names)) < len(names) or not 1 <= len(names) <= 6:
        raise ValueError("one to six filters, with names of one character each")
    bit = {n: 1 << i for i, n in enumerate(names)}
    orders = flagged.sparkSession.createDataFrame([("".join(p), [bit[n] for n in p]) for p in permutations(names)], "filter_order string, bits array<int>")
    mask = sum((F.when(F.col(c), bit[n]).otherwise(0) for n, c in filters.items()), F.lit(0))
    masks = flagged.select(F.coalesce(F.col(part), F.lit("")).alias("part"), mask.alias("mask"), *(F.coalesce(F.col(c), F.lit(False)).alias(f"_{n}") for n, c in lost.items()))
    fails = lambda b: F.col("mask").bitwiseAND(b) != 0
    first = F.coalesce(*(F.when(fails(F.col("bits")[i]), i) for i in range(len(names))), F.lit(len(names)))
    # the one join without a key: with a fixed number of orders
    steps = masks.crossJoin(F.broadcast(orders)).withColumn("first", first).select("*", F.posexplode("bits").alias("at", "bit"))
    removed = F.col("first") == F.col("at")
    counts = {
        "kept": F.col("first") > F.col("at"),
        "removed": removed,
        "redundant": fails(F.col("bit")) & (F.col("first") < F.col("at")),
        "unique_fails": F.col("mask") == F.col("bit"),
    } | {n: removed & F.col(f"_{n}") for n in lost}
    found = steps.groupBy("part", "filter_order", (F.col("at") + 1).cast("int").alias("step")).agg(*(F.count_if(c).alias(n) for n, c in counts.items()))
    letter = F.substring(F.col("filter_order"), F.col("step"), F.lit(1))
    return found.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", letter)))


def failures(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(key, part, A to E): which of the five filters each document fails.

    A: under 100 words; B: under 80 % of the words are distinct; C: over 10 % of the code points are A to Z; D: one of `#$%&*|`; E: the same
    text as a row with a smaller key. A null text is empty: it fails A alone, and E as any empty one does. Texts are read once, whole; a
    very long one is one row's array of words. Columns beside these three may have any names, as they are left out first.
    """
    bare = docs.select(F.col(key).alias("key"), F.col(part).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("words", words_of(F.col("text")))
    capitals = F.length("text") - F.length(F.regexp_replace("text", "[A-Z]+", ""))
    judged = bare.select(
        "key", "part", (F.size("words") < 100).alias("A"), (100 * F.size(F.array_distinct("words")) < 80 * F.size("words")).alias("B"), (100 * capitals > 10 * F.length("text")).alias("C"),
        F.col("text").rlike(r"[#$%&*|]").alias("D"), F.unhex(F.sha2("text", 256)).alias("digest"),
    )
    found = later_copies(written(judged), "key", "digest").withColumnRenamed("is_copy", "E")
    return found.select(F.col("key").alias(key), F.col("part").alias(part), *"ABCDE")


def with_labels(flagged: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds `good` and `toxic`: whether any label of the row's key says so; false without one. Repeated labels count once."""
    known = labels.groupBy(key).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    return flagged.join(known, key, "left")


FILTERS: Sequence[str] = "ABCDE"


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over all documents, in all 120 orders, by language."""
    flagged = with_labels(failures(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")), table(spark, sf_dir, "labels"))
    return replay(flagged, "lang", {f: f for f in FILTERS}, {"good_lost": "good", "toxic_lost": "toxic"})


ORACLE_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
known AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
firsts AS (SELECT text, min(doc_id) AS first FROM docs GROUP BY text),
flagged AS (
    SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
        CASE WHEN len(words) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END
        || CASE WHEN 100 * length(regexp_replace(docs.text, '[^A-Z]', '', 'g')) > 10 * length(docs.text) THEN 'C' ELSE '' END
        || CASE WHEN regexp_matches(docs.text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN docs.doc_id > first THEN 'E' ELSE '' END AS fails
    FROM docs JOIN firsts ON docs.text = firsts.text LEFT JOIN known ON docs.doc_id = known.doc_id),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps AS (SELECT filter_order, CAST(s AS INT) AS step, filter_order[s] AS letter, filter_order[1:s - 1] AS before FROM orders, range(1, 6) r(s)),
cells AS (
    SELECT part, filter_order, step, letter, count_if(translate(before || letter, fails, '') = before || letter) AS kept, count_if(contains(fails, letter) AND translate(before, fails, '') = before) AS removed,
        count_if(contains(fails, letter) AND translate(before, fails, '') <> before) AS redundant, count_if(fails = letter) AS unique_fails,
        count_if(good AND contains(fails, letter) AND translate(before, fails, '') = before) AS good_lost, count_if(toxic AND contains(fails, letter) AND translate(before, fails, '') = before) AS toxic_lost
    FROM flagged, steps GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
    CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM cells
"""
