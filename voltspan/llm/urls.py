"""URL filters: explicit rules first, else naive Bayes over the words of host and path.

Names in hosts are split into words by a unigram Viterbi search: the counts of words that occur on their own in urls (between
separators) over all pages, and a short lexicon, make the unigrams. Pages that a rule fits are the examples to block or to allow, but
for those of held-out hosts; a multinomial naive Bayes learned from their segmented host and path words judges every other url.
Work is on distinct hosts, names and path signatures, so a host that holds a third of the pages costs as much as another.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from voltspan.llm.common import checkpoint, join_spread
from voltspan.tables import table

#: Longest word that a name is split into, and the count that a word of the lexicon has at least.
LONGEST, LEXICON_COUNT = 20, 1000
#: Of so many hosts with a rule, one isn't learned from, so that the verdicts on unseen hosts can be measured.
HELD_OUT = 5
#: Words that names are often made of. They help to split names; no verdict comes from them.
LEXICON = (
    "about ads adult app art bet bets betting blog book books casino cheap city click clicks data doc docs education farm food forum free gambling garden health help home house info jackpot library life loan "
    "loans local lottery mail malware map media museum music news online open phish photo pills poker porn press promo radio replica school science seo shop site slots spam sport store study tech track "
    "tracker tracking travel viagra video warez weather web wiki win work world xxx".split()
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """Fits its host and all subdomains where the url's path starts with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def host_of(url: str | Column) -> Column:
    """After the first :// up to a slash, question mark or hash, A-Z lower-cased; empty if there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: str | Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(rules: tuple[Rule, ...], host: str = "host", path: str = "path") -> Column:
    """A struct (rule, verdict) of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((F.col(host) == r.host) | F.col(host).endswith("." + r.host)) & F.col(path).startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def names_of(host: str | Column) -> Column:
    """The letter runs of a host without its last label; ASCII letters only, others separate."""
    return F.array_remove(F.split(F.regexp_replace(host, r"(^|\.)[^.]*$", ""), "[^a-z]+"), "")


def path_words(path: str | Column) -> Column:
    """The signature of a path: its words with their repeats, sorted."""
    return F.array_sort(F.array_remove(F.split(F.translate(path, UPPER, LOWER), "[^a-z]+"), ""))


def viterbi(name: str, words: list[tuple[int, str, int]], total: int) -> list[str]:
    """The most probable split of a name. words: (start, word, count) of those in it; a stretch of any other letters is one unknown word."""
    n, known = len(name), {}
    for start, word, count in words:
        known.setdefault(start + len(word), []).append((start, math.log(count / total)))
    best, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
    for end in range(1, n + 1):
        # an unknown word of k letters has probability 10 / (total * 10**k): far below any known one
        options = [(best[s] + math.log(10 / total) - (end - s) * math.log(10), s) for s in range(max(0, end - LONGEST), end)]
        options += [(best[s] + p, s) for s, p in known.get(end, ())]
        best[end], back[end] = max(options, key=lambda o: (o[0], -o[1]))
    out, at = [], n
    while at:
        out.append(name[back[at] : at])
        at = back[at]
    return out[::-1]


@arrow_udf(T.ArrayType(T.StringType()))
def _split(name: pa.Array, words: pa.Array, total: pa.Array) -> pa.Array:
    rows = zip(name.to_pylist(), words.to_pylist(), total.to_pylist(), strict=True)
    return pa.array([viterbi(n, [(w["start"], w["word"], w["n"]) for w in ws or []], max(t or 0, 10)) for n, ws, t in rows], pa.list_(pa.string()))


def unigrams(pairs: DataFrame) -> DataFrame:
    """(word, n): words that stand alone in paths or between hyphens of host labels, over all pages; those of the lexicon have LEXICON_COUNT more."""
    hyphened = F.flatten(F.transform(F.filter(F.split("host", r"\."), lambda x: x.contains("-")), lambda x: F.split(x, "[^a-z]+")))
    seen = pairs.select("n", F.explode(F.concat("signature", hyphened)).alias("word")).where(F.length("word").between(2, LONGEST))
    seeds = pairs.sparkSession.createDataFrame([(w, LEXICON_COUNT) for w in LEXICON], "word string, n long")
    return seen.select("word", "n").union(seeds).groupBy("word").agg(F.sum("n").alias("n"))


def segmented(pairs: DataFrame) -> DataFrame:
    """(host, words): the words of each distinct host."""
    hosts = pairs.select("host").distinct()
    parts = hosts.select("host", F.posexplode(names_of("host")).alias("place", "name"))
    names = parts.select("name").distinct()
    counts = checkpoint(unigrams(pairs))
    total = counts.agg(F.sum("n")).first()[0]
    starts = names.select("name", F.explode(F.sequence(F.lit(0), F.length("name") - 1)).alias("start"))
    inside = starts.select("name", "start", F.explode(F.sequence(F.lit(2), F.least(F.lit(LONGEST), F.length("name") - F.col("start")))).alias("k")).where("start + k <= length(name)")
    inside = inside.select("name", "start", F.expr("substring(name, start + 1, k)").alias("word"))
    found = inside.join(counts, "word").groupBy("name").agg(F.sort_array(F.collect_list(F.struct("start", "word", "n"))).alias("words"))
    split = names.join(found, "name", "left").select("name", _split("name", "words", F.lit(total)).alias("words"))
    own = parts.join(split, "name").groupBy("host").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("place", "words"))), lambda x: x["words"])).alias("words"))
    return hosts.join(own, "host", "left").select("host", F.coalesce("words", F.array().cast("array<string>")).alias("words"))


def held_out(host: str | Column) -> Column:
    """Whether the pages of a host are never learned from: crc32 of the host, modulo HELD_OUT, is 0."""
    return F.crc32(host) % HELD_OUT == 0


def bayes(examples: DataFrame, hosts: DataFrame) -> tuple[DataFrame, float]:
    """(word, weight) and the prior: log-odds of blocking, from examples (host, signature, bad, n: their pages) of all hosts but those held out. Add-one smoothing.

    Without an example of either verdict the weights are those of no evidence, zero.
    """
    labelled = examples.where(~held_out("host")).join(hosts, "host").select("n", "bad", F.concat("words", "signature").alias("words"))
    of = lambda bad: F.coalesce(F.sum(F.when(F.col("bad") == bad, F.col("n"))), F.lit(0))
    n_bad, n_good = labelled.agg(of(True), of(False)).first()
    each = checkpoint(labelled.select("n", "bad", F.explode("words").alias("word")).groupBy("word").agg(of(True).alias("bad"), of(False).alias("good")))
    if not (n_bad and n_good):
        return each.select("word", F.lit(0.0).alias("weight")), math.log((n_bad + 1) / (n_good + 1))
    bad, good, size = each.agg(F.coalesce(F.sum("bad"), F.lit(0)), F.coalesce(F.sum("good"), F.lit(0)), F.count("*")).first()
    weight = F.log((F.col("bad") + 1) / (bad + size + 1)) - F.log((F.col("good") + 1) / (good + size + 1))
    return each.select("word", weight.alias("weight")), math.log((n_bad + 1) / (n_good + 1))


def scored(of: DataFrame, key: str, words: str, weights: DataFrame, name: str) -> DataFrame:
    """(key, name): the sum of the weights of its words."""
    each = of.select(key, F.explode(words).alias("word")).join(weights, "word")
    return each.groupBy(key).agg(F.sum("weight").alias(name))


def judge_urls(pages: DataFrame, key: str = "page_id", url: str = "url", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """key, host, path, rule, verdict, the method's own `score` (above 0: block) and held_out (the host isn't learned from) of each url.

    A null url, or one without ://, has an empty host and path and is judged by the prior. A word that no example has doesn't count.
    Of rules of equal length the later one wins; a score of 0 allows. Repeated rows give repeated results; an empty table gives none;
    very long urls are taken whole; extra columns, of any name, are left alone.
    """
    own = pages.select(F.col(key).alias("key"), host_of(url).alias("host"), path_of(url).alias("path"))
    fit = longest_rule(rules)
    own = own.select("key", "host", "path", path_words("path").alias("signature"), fit["rule"].alias("rule"), fit["verdict"].alias("fixed"))
    pairs = checkpoint(own.groupBy("host", "signature", (F.col("fixed") == "block").alias("bad")).agg(F.count("*").alias("n")))
    hosts = checkpoint(segmented(pairs))
    weights, prior = bayes(pairs.where("bad is not null"), hosts)
    by_host = scored(hosts, "host", "words", weights, "host_score")
    signatures = pairs.select("signature").distinct().withColumn("sig", F.array_join("signature", " "))
    by_path = scored(signatures, "sig", "signature", weights, "path_score")
    # a host has no slash, so that a pair has one name
    total, pair = F.lit(prior) + F.coalesce("host_score", F.lit(0.0)) + F.coalesce("path_score", F.lit(0.0)), F.concat_ws("/", "host", "sig")
    each = pairs.groupBy("host", F.array_join("signature", " ").alias("sig")).agg(F.sum("n").alias("n")).join(by_host, "host", "left").join(by_path, "sig", "left")
    scores = checkpoint(each.select(pair.alias("pair"), total.alias("score"), "n"))
    rows = own.select("key", "host", "path", "rule", "fixed", F.concat_ws("/", "host", F.array_join("signature", " ")).alias("pair"))
    out = join_spread(rows, scores, "pair", scores.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    verdict = F.coalesce("fixed", F.when(F.col("score") > 0, "block").otherwise("allow"))
    return out.select(F.col("key").alias(key), "host", "path", "rule", verdict.alias("verdict"), F.round("score", 3).alias("score"), held_out("host").alias("held_out"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url."""
    return judge_urls(table(spark, sf_dir, "pages"))
