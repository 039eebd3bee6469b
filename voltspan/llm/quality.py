"""Quality rules: divergence of a document's histograms from language references, beside plain counts. DataFrame functions only.

A document's character-class histogram (letters, vowels, digits, spaces, punctuation and so on) and its histogram of common words
are compared with those of each language by Jensen-Shannon distance (0 to 1). The references are sums over all labelled documents that
pass the base rules. Documents too short for a histogram to mean anything are not judged by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voltspan.llm.common import checkpoint
from voltspan.tables import table

#: Common words of each language that has a reference; another language's list may be added.
COMMON = {
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "auf", "für", "ist", "im", "nicht", "ein", "eine"],
    "en": ["the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "with", "as", "be", "on", "this", "are"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "por", "con", "una", "su", "para"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "sur"],
}
WORDS = sorted({w for own in COMMON.values() for w in own})
#: The characters of each class; what is in none of them counts as `other`.
CLASSES = {
    "consonant": "bcdfghjklmnpqrstvwxyz",
    "vowel": "aeiou",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "accented": "àâäáãåæçèéêëìíîïñòóôöõøùúûüýÿßœÀÂÄÁÃÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÖÕØÙÚÛÜÝŒ",
    "digit": "0123456789",
    "space": " \t\n\x0b\x0c\r",
    "stop": ".,;:!?'\"-()",
    "symbol": "#*$%&|<>",
}
#: Guards: fewer characters or words than these are never judged by a histogram.
MIN_CHARS, MIN_WORDS = 400, 50
#: Greatest Jensen-Shannon distance from the nearest reference that a kept document has.
MAX_CLASS, MAX_WORD = 0.31, 0.30
WINDOW, MIN_DOC_WORDS, REPEAT_SHARE = 8, 20, 30


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def words(text: str | Column) -> Column:
    """Runs of characters that aren't ASCII white space."""
    return F.array_remove(F.split(text, "[ \t\n\x0b\x0c\r]+"), "")


def class_counts(text: Column) -> Column:
    """Characters of each class, and of none. Each class is taken out of what the ones before have left."""
    counts, left = [], text
    for own in CLASSES.values():
        rest = F.translate(left, own, "")
        counts.append(F.length(left) - F.length(rest))
        left = rest
    return F.array(*counts, F.length(left)).cast("array<long>")


def duplicate_lines(lines: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    full = F.filter(lines, lambda x: x.rlike("[^ \t\n\x0b\x0c\r]"))
    return F.when(F.size(F.array_distinct(lines)) == F.size(lines), 0).otherwise(F.size(full) - F.size(F.array_distinct(full))).cast("long")


def features(docs: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """key, lang, BASE, base_failed, classes and commons (histograms as counts) of each whole text, without a shuffle.

    Windows are told apart by 64-bit hashes. Steps are projections of their own so that no array is computed again for each element.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    first = docs.select(
        F.col(key).alias("key"), F.col(lang).alias("lang"), class_counts(body).alias("classes"), F.split(body, "\n").alias("lines"), words(body).alias("words"),
    )
    second = first.select(
        "key", "lang", "classes", duplicate_lines(F.col("lines")).alias("n_dup_lines"), F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
        F.transform(F.filter("words", lambda w: F.lower(w).isin(WORDS)), lambda w: F.lower(w)).alias("hits"),
    )
    kept = ["key", "lang", "classes", "n_dup_lines", "n_words"]
    third = second.select(
        *kept[:-1], F.size("hashes").cast("long").alias("n_words"),
        F.array(*(F.size("hits") - F.size(F.array_remove("hits", w)) for w in WORDS)).cast("array<long>").alias("commons"),
        F.when(F.size("hashes") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("hashes") - WINDOW + 1), lambda i: F.xxhash64(F.slice("hashes", i, WINDOW)))).alias("windows"),
    )
    again = F.size(F.array_distinct("windows")) < F.size("windows")
    fourth = third.select(*kept, "commons", F.when(again, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("ordered"))
    same = lambda s, i: s["h"].eqNullSafe(F.get("ordered", i)["h"])
    fifth = fourth.select(*kept, "commons", F.sort_array(F.transform(F.filter("ordered", lambda s, i: same(s, i - 1) | same(s, i + 1)), lambda s: s["i"])).alias("starts"))
    step = lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last"))
    covered = F.aggregate("starts", F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")), step)["n"]
    out = fifth.select(
        *kept, "commons", (F.aggregate("classes", F.lit(0).cast("long"), lambda a, x: a + x) - F.get("classes", list(CLASSES).index("space"))).alias("word_chars"),
        F.get("classes", list(CLASSES).index("symbol")).alias("n_symbols"), F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_DOC_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_SHARE * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def references(found: DataFrame) -> dict[str, tuple[list[int], list[int]]]:
    """For each language of COMMON with a passing document: its characters by class and its common words, summed over all of them."""
    sums = [F.sum(F.get(c, F.lit(i))).alias(f"{c}{i}") for c, n in (("classes", len(CLASSES) + 1), ("commons", len(WORDS))) for i in range(n)]
    good = found.where(~F.col("base_failed") & F.col("lang").isin(list(COMMON)))
    rows = good.groupBy("lang").agg(F.sum("n_words").alias("n_words"), *sums).collect()  # a row for each language of COMMON at most
    return {
        r["lang"]: ([r[f"classes{i}"] for i in range(len(CLASSES) + 1)], [*(r[f"commons{WORDS.index(w)}"] for w in COMMON[r["lang"]]), r["n_words"] - sum(r[f"commons{WORDS.index(w)}"] for w in COMMON[r["lang"]])])
        for r in rows
    }


def distance(counts: Column, total: Column, reference: list[int]) -> Column:
    """Jensen-Shannon distance, base 2, of a histogram from a reference's."""
    whole = sum(reference)
    share = F.transform(counts, lambda c: c / total)
    part = lambda p, m: F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)
    terms = F.zip_with(share, F.array(*(F.lit(x / whole) for x in reference)), lambda p, q: (part(p, (p + q) / 2) + part(q, (p + q) / 2)) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)))


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """key, n_words and the other counts, base_failed, class_distance and word_distance from the nearest reference, and kept.

    A null text has no words and fails the base rules. A histogram below its guard, and one without any reference (an empty table,
    no labels), isn't judged: its distance is null. Repeated rows give repeated results.
    """
    found = checkpoint(features(docs, key, text, lang))
    known = references(found)
    chars = F.aggregate("classes", F.lit(0).cast("long"), lambda a, x: a + x)
    common = lambda name: [F.get("commons", F.lit(WORDS.index(w))) for w in COMMON[name]]
    histogram = lambda name: F.array(*common(name), F.col("n_words") - sum(common(name), F.lit(0)))
    nearest = lambda each: F.least(*each) if len(each) > 1 else each[0] if each else F.lit(None).cast("double")
    by_class = nearest([distance(F.col("classes"), chars, known[k][0]) for k in sorted(known)])
    by_word = nearest([distance(histogram(k), F.col("n_words"), known[k][1]) for k in sorted(known)])
    out = found.select(
        F.col("key").alias(key), *BASE, "base_failed", F.when(chars >= MIN_CHARS, by_class).alias("class_distance"), F.when(F.col("n_words") >= MIN_WORDS, by_word).alias("word_distance"),
    )
    near = (F.coalesce("class_distance", F.lit(0.0)) <= MAX_CLASS) & (F.coalesce("word_distance", F.lit(0.0)) <= MAX_WORD)
    return out.withColumn("kept", ~F.col("base_failed") & near)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict for every document."""
    return judge(table(spark, sf_dir, "documents")).select("doc_id", *BASE, "base_failed", "kept")


def oracle_sql() -> str:
    """op1_quality in DuckDB's SQL, over the same lists and limits."""
    text = lambda s: "'" + s.replace("'", "''") + "'"
    chars = lambda s: " || ".join(f"chr({ord(c)})" if not c.isprintable() or c == " " else text(c) for c in s)
    left, class_steps = "body", []
    for i, own in enumerate(CLASSES.values()):
        class_steps.append(f"translate({left}, {chars(own)}, '') AS left{i}")
        left = f"left{i}"
    names = ["body", *(f"left{i}" for i in range(len(CLASSES)))]
    counts = [f"length({a}) - length({b})" for a, b in zip(names, names[1:], strict=False)] + [f"length({names[-1]})"]
    langs = sorted(COMMON)
    some = lambda k: " + ".join(f"w[{WORDS.index(w) + 1}]" for w in COMMON[k])
    hist = lambda k: "[" + ", ".join(f"w[{WORDS.index(w) + 1}]" for w in COMMON[k]) + f", n_words - ({some(k)})]"
    part = "CASE WHEN {0} > 0 THEN {0} * log2({0} / (({0} + {1}) / 2)) ELSE 0 END"
    p, q = "(d.l[i] / d.t)", "(r.l[i] / r.t)"
    term = f"({part.format(p, q)} + {part.format(q, p)}) / 2"
    per_lang = lambda table: f"SELECT doc_id, rn, min(sqrt(greatest(0.0, list_sum(list_transform(range(1, len(d.l) + 1), lambda i: {term}))))) AS dist FROM {table} AS d JOIN {table}_ref AS r ON d.k = r.k GROUP BY ALL"
    space, symbol = list(CLASSES).index("space"), list(CLASSES).index("symbol")
    return f"""
WITH src AS (SELECT doc_id, lang, coalesce(text, '') AS body, row_number() OVER () AS rn FROM documents),
cls AS (SELECT *, {', '.join(class_steps)} FROM src),
cut AS (SELECT rn, doc_id, lang, [{', '.join(counts)}] AS c,
  list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0b\\x0c\\r]')) AS lines,
  list_filter(regexp_split_to_array(body, '[ \\t\\n\\x0b\\x0c\\r]+'), lambda x: x <> '') AS words FROM cls),
win AS (SELECT rn, unnest(list_transform(range(1, len(words) - {WINDOW - 2}), lambda i: array_to_string(words[i:i + {WINDOW - 1}], ' '))) AS win, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM cut WHERE len(words) >= {WINDOW}),
rep AS (SELECT rn, i FROM win QUALIFY count(*) OVER (PARTITION BY rn, win) > 1),
cov AS (SELECT rn, sum(least({WINDOW}, i - last)) AS n FROM (SELECT rn, i, lag(i, 1, -{WINDOW}) OVER (PARTITION BY rn ORDER BY i) AS last FROM rep) GROUP BY rn),
feat AS (SELECT rn, doc_id, lang, c, len(words) AS n_words, list_sum(c) - c[{space + 1}] AS word_chars, c[{symbol + 1}] AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, list_transform(words, lambda x: lower(x)) AS low FROM cut LEFT JOIN cov USING (rn)),
base AS (SELECT *, n_words < {MIN_DOC_WORDS} OR 100 * n_repeat_words > {REPEAT_SHARE} * n_words AS base_failed,
  [{', '.join(f"len(list_filter(low, lambda x: x = {text(w)}))" for w in WORDS)}] AS w FROM feat),
word_dist AS ({' UNION ALL '.join(f"SELECT rn, doc_id, lang, base_failed, {text(k)} AS k, {hist(k)} AS l, n_words AS t FROM base WHERE n_words > 0" for k in langs)}),
class_dist AS (SELECT rn, doc_id, lang, base_failed, k, c AS l, list_sum(c) AS t FROM base, (VALUES {', '.join(f"({text(k)})" for k in langs)}) AS v(k) WHERE list_sum(c) > 0),
word_dist_ref AS (SELECT k, list(s ORDER BY i) AS l, sum(s) AS t FROM (SELECT k, i, sum(l[i]) AS s FROM word_dist, range(1, {max(map(len, COMMON.values())) + 2}) AS g(i) WHERE lang = k AND NOT base_failed GROUP BY ALL) GROUP BY k),
class_dist_ref AS (SELECT k, list(s ORDER BY i) AS l, sum(s) AS t FROM (SELECT k, i, sum(l[i]) AS s FROM class_dist, range(1, {len(CLASSES) + 2}) AS g(i) WHERE lang = k AND NOT base_failed GROUP BY ALL) GROUP BY k),
word_near AS ({per_lang('word_dist')}),
class_near AS ({per_lang('class_dist')})
SELECT b.doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND (n_words < {MIN_WORDS} OR coalesce(wn.dist, 0) <= {MAX_WORD}) AND (list_sum(c) < {MIN_CHARS} OR coalesce(cn.dist, 0) <= {MAX_CLASS}) AS kept
FROM base AS b LEFT JOIN word_near AS wn USING (rn) LEFT JOIN class_near AS cn USING (rn)
"""
