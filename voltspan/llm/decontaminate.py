"""Benchmark decontamination by a positional inverted index of the training tokens. DataFrame functions only.

The index is a written table of postings (term, document, position), made in one pass over the texts. It is sharded by documents: in
each file the postings of a term lie together, so a very frequent term is spread over all files and nothing is shuffled to build it. A
test phrase is looked up by its rarest term; the lists of its other terms are intersected with that, the next rarest first: positions
near the first list's stay, and those at the phrase's own offsets make an exact match, all words within a little more room than the
phrase's length, in any order, a proximity match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voltspan.llm.common import discard, fresh, unused, written
from voltspan.tables import table

#: Words of a phrase, and how many words more a proximity match may spread over.
WIDTH, SLACK = 10, 2
#: Rows up to this number are broadcast to the index (some 50 MB); more are joined by shuffling.
BROADCAST_ROWS = 200_000
#: Documents with candidates are told by a hash of so many values, broadcast whatever their number (some 30 MB at most).
PLACES = 1 << 20
#: Positions in a block: lists are intersected block by block, so that a very long document isn't one group.
BLOCK = 64
#: The characters between words.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str | Column) -> Column:
    """Lower-cased words of ASCII letters and digits and of all other characters; a null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), "")


def lowered(word: Column) -> Column:
    """A word with A-Z lower-cased; those of ASCII letters alone the fast way."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def postings(docs: DataFrame, key: str, text: str, at: str | None = None) -> DataFrame:
    """The index, written: a row (term, key, print, pos) for each word of the documents; in each file rows are in the order of the
    terms' hashes, which sort much faster than strings.

    `print` tells rows of the same key with different texts apart. The empty term marks a document's end: its position is the
    number of words.
    """
    parts = F.split(F.concat(F.coalesce(text, F.lit("")), F.lit(" ")), BETWEEN)  # ends in an empty part, and begins with one where no word does
    own = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("print"), parts.alias("parts"))
    own = own.select("key", "print", F.expr("cast(parts[0] = '' as int)").alias("shift"), F.posexplode("parts").alias("pos", "term")).where("pos > 0 or term != ''")
    own = own.select(lowered(F.col("term")).alias("term"), "key", "print", (F.col("pos") - F.col("shift")).alias("pos"))
    return written(own.withColumn("code", F.xxhash64("term")).sortWithinPartitions("code").drop("code"), at=at)


def phrases(tests: DataFrame, item: str, text: str, width: int = WIDTH) -> DataFrame:
    """(pid, phrase, items), written: each distinct run of `width` words of the tests, or whole test of fewer words, with the ids of
    the items that have it as strings; a null id is an empty string."""
    own = tests.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), words(text).alias("w")).where(F.size("w") > 0)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1))), lambda i: F.slice("w", i, width))
    each = own.select("item", F.explode(runs).alias("phrase")).groupBy("phrase").agg(F.collect_set("item").alias("items"))
    return written(each.select(F.monotonically_increasing_id().alias("pid"), "phrase", "items"))


def sized(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast where the counted rows are within the limit; else the join is left to shuffle, skewed keys split at run time."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def ranked(index: DataFrame, wanted: DataFrame, rows: int) -> DataFrame:
    """(pid, term, offset, times, rank), written: the distinct terms of each phrase, the rarest in the corpus first; offset is the
    first of the term, times how often the phrase has it. Phrases with a term that no document has are left out."""
    terms = wanted.select("pid", F.posexplode("phrase").alias("offset", "term")).groupBy("pid", "term").agg(F.min("offset").alias("offset"), F.count("*").alias("times"))
    own = terms.select("term").distinct()
    counts = index.join(sized(own, rows), "term").groupBy("term").agg(F.count("*").alias("n"))
    each = terms.join(counts, "term", "left")
    phrase = Window.partitionBy("pid")
    each = each.withColumns({"rank": F.row_number().over(phrase.orderBy("n", "offset")), "least": F.min(F.coalesce("n", F.lit(0))).over(phrase)})
    return written(each.where("least > 0").select("pid", "term", "offset", "times", "rank"))


def blocks(pos: Column, reach: int) -> Column:
    """The blocks that hold the positions up to `reach` from pos."""
    return F.array_distinct(F.array(F.floor((pos - reach) / BLOCK), F.floor((pos + reach) / BLOCK)))


def search(index: DataFrame, wanted: DataFrame, slack: int = SLACK) -> DataFrame:
    """(key, print, pid, start, end, exact, items): the places near which documents have all words of a phrase.

    Each has the phrase's words, as often as it has them, within `slack` words more than its length, in any order; exact: from
    start to end they are the phrase. A place is a position of the phrase's rarest word, so one passage may give several.
    """
    rows = wanted.count()
    terms = ranked(index, wanted, rows * WIDTH)
    reach = WIDTH + slack - 1
    listed = index.withColumn("block", F.floor(F.col("pos") / BLOCK))
    first, second = (terms.where(F.col("rank") == k).select("pid", "term", "offset") for k in (1, 2))
    anchors = index.join(sized(first, rows), "term").select("pid", "key", "print", "pos", "offset")
    near = listed.join(sized(second, rows), "term").select(F.col("pid").alias("q"), F.col("key").alias("k"), F.col("print").alias("p"), F.col("block").alias("at"), F.col("pos").alias("other"))
    placed = anchors.join(sized(second.select("pid"), rows), "pid").withColumn("block", F.explode(blocks(F.col("pos"), reach)))
    same = (F.col("pid") == F.col("q")) & F.col("key").eqNullSafe(F.col("k")) & (F.col("print") == F.col("p")) & (F.col("block") == F.col("at"))
    both = placed.join(near, same & (F.abs(F.col("other") - F.col("pos")) <= reach), "left_semi").drop("block").distinct()
    alone = anchors.join(sized(second.select("pid"), rows), "pid", "left_anti").distinct()  # phrases of one word only
    left = written(both.unionByName(alone))
    asked = left.join(sized(terms.select("pid", F.col("term").alias("wanted")), rows * WIDTH), "pid").withColumn("at", F.explode(blocks(F.col("pos"), reach)))
    asked = asked.select("pid", "wanted", "offset", "at", F.col("key").alias("k"), F.col("print").alias("p"), F.col("pos").alias("anchor"))
    place = lambda: F.pmod(F.xxhash64("key", "print"), F.lit(PLACES))
    listed = listed.join(F.broadcast(left.select(place().alias("place")).distinct()), place() == F.col("place"), "left_semi")
    same = F.col("key").eqNullSafe(F.col("k")) & (F.col("print") == F.col("p")) & (F.col("block") == F.col("at")) & (F.col("term") == F.col("wanted"))
    found = listed.join(asked, same & (F.abs(F.col("pos") - F.col("anchor")) <= reach))
    found = found.select("pid", "key", "print", "anchor", "offset", F.struct(F.col("pos").alias("q"), "term").alias("at"))
    lists = found.groupBy("pid", "key", "print", "anchor", "offset").agg(F.collect_set("at").alias("at"))  # 2 * reach + 1 positions at most
    needs = terms.groupBy("pid").agg(F.collect_list(F.struct("term", "times")).alias("needs"))
    known = lists.join(sized(wanted.join(needs, "pid"), rows), "pid")
    size, start, at = F.size("phrase"), F.col("anchor") - F.col("offset"), F.map_from_entries("at")
    here = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.try_element_at(at, start + i))
    room = lambda s, t: F.size(F.filter("at", lambda x: (x["term"] == t) & (x["q"] >= s) & (x["q"] < s + size + slack)))
    close = F.exists(F.sequence(F.col("anchor") - size - slack + 1, F.col("anchor")), lambda s: F.forall("needs", lambda t: room(s, t["term"]) >= t["times"]))
    out = known.select("key", "print", "pid", "items", start.alias("start"), (start + size).alias("end"), (here == F.col("phrase")).alias("exact"), close.alias("close"))
    return out.where("close").drop("close")


def hits(found: DataFrame) -> DataFrame:
    """(key, print, n_hit, items, near_items) of each document with a match: the words inside any exact one, the items of these, and those of all, as sorted strings."""
    span = F.when(F.col("exact"), F.struct("start", "end"))
    some = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    own = found.groupBy("key", "print").agg(F.sort_array(F.collect_set(span)).alias("spans"), some(F.when(F.col("exact"), F.col("items"))).alias("items"), some("items").alias("near_items"))
    step = lambda a, s: F.struct((a["n"] + F.greatest(s["end"] - F.greatest(s["start"], a["last"]), F.lit(0))).alias("n"), F.greatest(a["last"], s["end"]).alias("last"))
    n_hit = F.aggregate("spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("last")), step)["n"]
    return own.select("key", "print", n_hit.cast("long").alias("n_hit"), "items", "near_items")


def contamination(docs: DataFrame, tests: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """key, print, n_words, n_hit, items, near_items and contaminated of each document.

    A null or blank document has no words and isn't contaminated; a very long one is searched whole; a test without words matches
    nothing, one without an id counts under an empty string; repeated rows, of documents or tests, give repeated and the same results;
    a null key is a key like others; without documents or tests nothing matches. Extra columns, of any name, are left alone.
    """
    index = postings(docs, key, text)
    marked = hits(search(index, phrases(tests, item, text))).withColumnsRenamed({"key": "k", "print": "p"})
    every = index.where("term = ''").select("key", "print", F.col("pos").cast("long").alias("n_words"))
    out = every.join(marked, every.key.eqNullSafe(marked.k) & (every.print == marked.p), "left")
    n_hit, none = F.coalesce("n_hit", F.lit(0).cast("long")), F.array().cast("array<string>")
    return out.select(F.col("key").alias(key), "print", "n_words", n_hit.alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("near_items", none).alias("near_items"), (n_hit > 0).alias("contaminated"))


def decontaminated(docs: DataFrame, tests: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """The documents without an exact match of any phrase of the tests; all columns stay as they are, whatever their names."""
    index = postings(docs, key, text, at := fresh(docs.sparkSession))
    k, p = unused(docs, "k"), unused(docs, "p")
    found = search(index, phrases(tests, item, text)).where("exact")
    marked = written(found.select(F.col("key").alias(k), F.col("print").alias(p)).distinct(), tidy=True)
    discard(docs.sparkSession, at)
    return docs.join(marked, F.col(key).eqNullSafe(F.col(k)) & (F.xxhash64(text) == F.col(p)), "left_anti")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item; n_near_items counts the items with a proximity match."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    count = lambda c: F.size(c).cast("long")
    return found.select("doc_id", "n_words", "n_hit", count("items").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", count("near_items").alias("n_near_items"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
q AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: w[i:i + 9])) AS own FROM b WHERE len(w) > 0),
p AS (SELECT item_id, own, array_to_string(own, ' ') AS phrase, len(own) AS n FROM q),
n AS (SELECT DISTINCT n FROM p),
s AS (SELECT r, n, unnest(range(1, len(w) - n + 2)) AS start, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS phrase FROM d, n WHERE len(w) >= n),
m AS (SELECT r, start, n, item_id FROM s JOIN p USING (phrase, n)),
h AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(start, start + n)) AS pos FROM (SELECT DISTINCT r, start, n FROM m)) GROUP BY r),
i AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT r, item_id FROM m) GROUP BY r),
t AS (SELECT r, unnest(w) AS term, unnest(range(1, len(w) + 1)) AS pos FROM d),
c AS (SELECT term, count(*) AS k FROM t GROUP BY term),
a AS (SELECT phrase, n, own, arg_min(term, coalesce(k, 0)) AS term FROM (SELECT DISTINCT phrase, n, own, unnest(own) AS term FROM p) LEFT JOIN c USING (term) GROUP BY ALL),
v AS (SELECT DISTINCT phrase, n, own, r, unnest(range(greatest(pos - n - 1, 1), pos + 1)) AS start FROM a JOIN t USING (term)),
z AS (SELECT DISTINCT phrase, r FROM v JOIN d USING (r) WHERE len(list_filter(list_distinct(own), lambda x: len(list_filter(w[start:start + n + 1], lambda y: y = x)) < len(list_filter(own, lambda y: y = x)))) = 0),
e AS (SELECT r, count(DISTINCT item_id) AS n_near_items FROM z JOIN p USING (phrase) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near_items, 0) AS n_near_items
FROM d LEFT JOIN h USING (r) LEFT JOIN i USING (r) LEFT JOIN e USING (r)
"""
