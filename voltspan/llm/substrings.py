"""Substring deduplication: suffix automata of reference passages find repeated runs of words across documents.

A run of `width` words goes from a document if it also starts in a document with a smaller key. Streaming every document past the
automaton of every reference shard would cost the square of the corpus, so shards are passages: each run has an anchor, the smallest
hash of its short word runs, and equal runs have equal anchors. The passages around an anchor that documents share make a shard;
its distinct passages (told apart by SHA-256) are compiled to a suffix automaton whose states know the smallest key that they occur
in, and each passage streams past it. Matching statistics of at least the width give, for each run, the first document that has it.

An anchor with more passages than one automaton takes is split: its passages are cut anew by the two smallest hashes of each run,
then by four, and so on up to all of them. Equal runs still meet, and every shard is an automaton in the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from voltspan.llm.common import HEAVY, chunks, join_apart, join_spread, struct, window_hashes, word_hashes, word_spans, written
from voltspan.tables import table

WIDTH, ANCHOR = 50, 16
#: An anchor with more distinct passages than this isn't handled by one automaton but split.
MOST_PASSAGES = 64
#: Word runs within a run: an anchor of as many hashes is unique to a run.
DEEPEST = WIDTH - ANCHOR + 1
PLACE = struct(anchor="long", lo="int", n="int")
PASSAGE = struct(anchor="long", lo="int", n="int", print="binary", words="string")


def passages(words: np.ndarray, depth: int = 1, width: int = WIDTH, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """anchor, lo, n of the passages of a sequence of word hashes: the runs of `width` words that begin at lo .. lo + n - 1 share their
    anchor, a hash of the `depth` smallest hashes of `anchor` words in each; at the full depth, of all in order, which is the run's own."""
    runs = len(words) - width + 1
    if runs <= 0:
        return (np.zeros(0, np.int64),) * 3
    gram = window_hashes(words, anchor)
    view = np.lib.stride_tricks.sliding_window_view(gram, width - anchor + 1)
    if depth == 1:
        at = np.arange(runs) + np.concatenate([view[i : i + 65536].argmin(axis=1) for i in range(0, runs, 65536)])
        lo = np.flatnonzero(np.diff(at, prepend=-1))
        key = gram[at[lo]]
    else:
        least = lambda part: part if depth == DEEPEST else np.sort(part, axis=1)[:, :depth]
        own = np.concatenate([window_hashes(least(view[i : i + 4096]).ravel(), depth)[::depth] for i in range(0, runs, 4096)])
        new = np.ones(runs, bool)
        new[1:] = own[1:] != own[:-1]
        place = np.arange(runs)
        since = place - np.maximum.accumulate(np.where(new, place, 0))
        lo = np.flatnonzero(since % width == 0)  # periodic texts have many runs of one anchor
        key = own[lo]
    return key.view(np.int64), lo, np.diff(np.append(lo, runs))


@arrow_udf(T.ArrayType(PLACE))
def places(texts: pa.Array) -> pa.Array:
    """The passages of each whole text, by word positions."""
    raw = [(texts[i].as_py() or "").encode("utf-8", "replace") for i in range(len(texts))]
    parts, count = [[], [], []], []
    for part in chunks([len(x) for x in raw]):
        data = np.frombuffer(b"\n".join(raw[part]), np.uint8)
        start, end = word_spans(data)
        hashes = word_hashes(data, start, end)
        bound = np.searchsorted(start, np.cumsum([0, *(len(x) + 1 for x in raw[part])]))
        for a, b in zip(bound[:-1], bound[1:], strict=True):
            own = passages(hashes[a:b])
            count.append(len(own[0]))
            for column, values in zip(parts, own, strict=True):
                column.append(values)
    columns = [pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), k) for c, k in zip(parts, (pa.int64(), pa.int32(), pa.int32()), strict=True)]
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *count]), pa.int32()), pa.StructArray.from_arrays(columns, PLACE.names))


def split_passages(depth: int):
    """A function of a column of passages' words: the passages in each by anchors of `depth` hashes, with their words."""

    @arrow_udf(T.ArrayType(PASSAGE))
    def split(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.to_pylist():
            words, data = text.encode("utf-8", "replace").split(), np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
            found = list(zip(*passages(word_hashes(data, *word_spans(data)), depth), strict=True))
            own = [b" ".join(words[lo : lo + n + WIDTH - 1]) for _, lo, n in found]
            out.append([{"anchor": int(a), "lo": int(lo), "n": int(n), "print": hashlib.sha256(w).digest(), "words": w.decode("utf-8", "replace")} for (a, lo, n), w in zip(found, own, strict=True)])
        return pa.array(out, pa.list_(pa.struct([("anchor", pa.int64()), ("lo", pa.int32()), ("n", pa.int32()), ("print", pa.binary()), ("words", pa.string())])))

    return split


class Automaton:
    """A suffix automaton of several word sequences; first[v] is the smallest key of a sequence that has state v's words."""

    def __init__(self) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [None]

    def _state(self, length: int, link: int, after: dict[str, int], first: int | None) -> int:
        self.next.append(after)
        self.link.append(link)
        self.length.append(length)
        self.first.append(first)
        return len(self.next) - 1

    def _split(self, p: int, word: str, q: int) -> int:
        """State q, or a copy of it with the words of length[p] + 1 only."""
        if self.length[p] + 1 == self.length[q]:
            return q
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]), self.first[q])
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def add(self, words: list[str], key: int) -> None:
        last = 0
        for word in words:
            known = self.next[last].get(word)
            if known is not None:
                last = self._split(last, word, known)
            else:
                new, p = self._state(self.length[last] + 1, 0, {}, None), last
                while p >= 0 and word not in self.next[p]:
                    self.next[p][word] = new
                    p = self.link[p]
                if p >= 0:
                    self.link[new] = self._split(p, word, self.next[p][word])
                last = new
            if self.first[last] is None or key < self.first[last]:
                self.first[last] = key

    def close(self) -> None:
        """Hands the smallest keys on from longer to shorter words."""
        for v in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            up, key = self.link[v], self.first[v]
            if up > 0 and (self.first[up] is None or key < self.first[up]):
                self.first[up] = key

    def stream(self, words: list[str], width: int) -> Iterator[tuple[int, int]]:
        """Matching statistics: (end, smallest key) for each run of `width` words of the stream that the sequences have."""
        v = matched = 0
        for i, word in enumerate(words):
            while v and word not in self.next[v]:
                v = self.link[v]
                matched = self.length[v]
            if word in self.next[v]:
                v, matched = self.next[v][word], matched + 1
            while v and self.length[self.link[v]] >= width:
                v = self.link[v]
                matched = self.length[v]
            if matched >= width:
                yield i + 1, self.first[v]


@arrow_udf(T.ArrayType(T.StructType([T.StructField("print", T.BinaryType()), T.StructField("firsts", T.ArrayType(T.LongType()))])))
def first_keys(groups: pa.Array) -> pa.Array:
    """For each shard (a list of print, key, words): the smallest key of each run of each passage."""
    out = []
    for group in groups.to_pylist():
        own, automaton = [(s["print"], s["key"], s["words"].split(" ")) for s in group], Automaton()
        for _, key, words in own:
            automaton.add(words, key)
        automaton.close()
        out.append([{"print": name, "firsts": [key for _, key in automaton.stream(words, WIDTH)]} for name, _, words in own])
    return pa.array(out, pa.list_(pa.struct([("print", pa.binary()), ("firsts", pa.list_(pa.int64()))])))


@arrow_udf(T.ArrayType(T.BinaryType()))
def prints(texts: pa.Array, wanted: pa.Array) -> pa.Array:
    """SHA-256 of the words of the wanted passages of each text, a space between them."""
    out = []
    for i in range(len(texts)):
        words = (texts[i].as_py() or "").encode("utf-8", "replace").split()
        out.append([hashlib.sha256(b" ".join(words[w["lo"] : w["lo"] + w["n"] + WIDTH - 1])).digest() for w in wanted[i].as_py()])
    return pa.array(out, pa.list_(pa.binary()))


@arrow_udf(T.ArrayType(T.StringType()))
def cut_out(texts: pa.Array, wanted: pa.Array) -> pa.Array:
    """The words of the wanted passages of each text, a space between them."""
    out = []
    for i in range(len(texts)):
        words = (texts[i].as_py() or "").encode("utf-8", "replace").split()
        out.append([b" ".join(words[w["lo"] : w["lo"] + w["n"] + WIDTH - 1]).decode("utf-8", "replace") for w in wanted[i].as_py()])
    return pa.array(out, pa.list_(pa.string()))


@arrow_udf(struct(n_words="long", n_removed="long", kept="string", kept_sha256="string"))
def removed(texts: pa.Array, starts: pa.Array) -> pa.Array:
    """Each text without the words that are inside the runs that begin at `starts`; null for none."""
    rows = []
    for i in range(len(texts)):
        words, at = (texts[i].as_py() or "").encode("utf-8", "replace").split(), starts[i].as_py()
        kept = words
        if at:
            depth = np.zeros(len(words) + 1, np.int64)
            np.add.at(depth, at, 1)
            np.add.at(depth, np.array(at) + WIDTH, -1)
            kept = [words[k] for k in np.flatnonzero(np.cumsum(depth[:-1]) == 0)]
        joined = b" ".join(kept)
        rows.append((len(words), len(words) - len(kept), joined.decode("utf-8", "replace") if at else None, hashlib.sha256(joined).hexdigest()))
    n_words, n_removed, text, digest = zip(*rows, strict=True) if rows else ((),) * 4
    return pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(text, pa.string()), pa.array(digest, pa.string())], ["n_words", "n_removed", "kept", "kept_sha256"])


def shared(found: DataFrame) -> DataFrame:
    """(anchor, n): the anchors that more than one key has, and the rows of each. found: key, anchor."""
    return found.groupBy("anchor").agg(F.min("key").alias("least"), F.max("key").alias("most"), F.count("*").alias("n")).where("least < most").select("anchor", "n")


def by_text(docs: DataFrame, found: DataFrame, taken, name: str) -> DataFrame:
    """Adds to found (key, anchor, lo, n and so on) what `taken` makes of the documents' texts there. The passages of a document are one list, as long as it is."""
    more = [c for c in found.columns if c != "key"]
    wanted = found.groupBy("key").agg(F.collect_list(F.struct(*more)).alias("wanted"))
    cut = docs.join(wanted, "key").select("key", F.arrays_zip("wanted", taken("text", "wanted").alias("taken")).alias("z"))
    return cut.select("key", F.explode("z").alias("z")).select("key", "z.wanted.*", F.col("z.taken").alias(name))


def first_runs(own: DataFrame, depth: int = 1) -> DataFrame:
    """(anchor, print, firsts): for each distinct passage the smallest key of each of its runs. own: anchor, print, key (the smallest that has it), n, words; by anchors of `depth` hashes."""
    count = own.groupBy("anchor").agg(F.count("*").alias("passages"))
    fits = written(own.join(count, "anchor"))
    most = F.lit(depth == DEEPEST) | (F.col("passages") <= MOST_PASSAGES)  # an anchor of one run has a passage for each number of its repeats
    group = fits.where(most).groupBy("anchor").agg(F.collect_list(F.struct("print", "key", "words")).alias("group"))
    few = group.select("anchor", first_keys("group").alias("found")).select("anchor", F.inline("found"))
    large = fits.where(~most)
    if depth == DEEPEST or large.isEmpty():
        return few
    deeper = min(2 * depth, DEEPEST)
    parts = large.select(F.col("anchor").alias("outer"), F.col("print").alias("whole"), "key", split_passages(deeper)("words").alias("part"))
    parts = written(parts.select("outer", "whole", "key", F.inline("part")))
    distinct = parts.groupBy("anchor", "print").agg(F.min("key").alias("key"), F.first("n").alias("n"), F.first("words").alias("words"))
    inner = first_runs(distinct.join(shared(parts), "anchor", "left_semi"), deeper)
    # parts without others of their anchor keep their own key
    known = parts.select("outer", "whole", "key", "anchor", "lo", "n", "print").join(inner, ["anchor", "print"], "left")
    each = known.select("outer", "whole", F.struct("lo", F.coalesce("firsts", F.array_repeat("key", F.col("n"))).alias("firsts")).alias("part"))
    many = each.groupBy("outer", "whole").agg(F.flatten(F.transform(F.sort_array(F.collect_list("part")), lambda x: x["firsts"])).alias("firsts"))
    return few.unionByName(many.select(F.col("outer").alias("anchor"), F.col("whole").alias("print"), "firsts"))


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_removed, kept (the text of the words left; null if none went) and kept_sha256 of each document.

    Keys are unique but for rows that repeat as a whole. A null key is neither smaller nor larger than others: its document stays
    whole, and so do null, empty and short texts; very long ones are read whole. An empty table gives no rows; extra columns, of any
    name, are left alone.
    """
    own = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    found = written(own.where(F.col("key").isNotNull()).select("key", places("text").alias("p")).select("key", F.inline("p")))
    known = written(by_text(own, join_spread(found, shared(found), "anchor", found.count()), prints, "print"))
    distinct = known.groupBy("anchor", "print").agg(F.min(F.struct("key", "lo", "n")).alias("at"), F.count("*").alias("rows")).select("at.*", "anchor", "print", "rows")
    alone = distinct.groupBy("anchor").agg(F.count("*").alias("passages"))
    distinct = written(distinct.join(alone, "anchor"))
    same = distinct.where("passages = 1").select("anchor", "print", F.array_repeat("key", F.col("n")).alias("firsts"))
    cut = by_text(own, distinct.where("passages > 1").drop("passages", "rows"), cut_out, "words").dropDuplicates(["anchor", "print"])
    firsts = written(same.unionByName(first_runs(cut.select("anchor", "print", "key", "n", "words"))).drop("anchor"))  # equal words have equal anchors
    hit = join_apart(known, firsts, "print", distinct.where(F.col("rows") > known.count() / HEAVY))
    starts = F.transform(F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("firsts", i) < F.col("key")), lambda i: F.col("lo") + i)
    spans = hit.select("key", starts.alias("starts")).where(F.size("starts") > 0).groupBy("key").agg(F.flatten(F.collect_set("starts")).alias("starts"))
    return own.join(spans, "key", "left").select(F.col("key").alias(key), removed("text", "starts").alias("r")).select(key, "r.*")


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its runs of 50 words that an earlier document has."""
    return without_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0b\x0c\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT r, doc_id, unnest(range(1, len(w) - 48)) AS start, unnest(list_transform(range(1, len(w) - 48), lambda i: hash(array_to_string(w[i:i + 49], ' ')))) AS run FROM d WHERE len(w) >= 50),
f AS (SELECT run, min(doc_id) AS least FROM s GROUP BY run HAVING min(doc_id) < max(doc_id)),
h AS (SELECT r, list(DISTINCT pos) AS gone FROM (SELECT r, unnest(range(start, start + 50)) AS pos FROM s JOIN f USING (run) WHERE least < doc_id) GROUP BY r),
k AS (SELECT r, string_agg(word, ' ' ORDER BY pos) AS kept FROM (SELECT d.r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d) AS e
  ANTI JOIN (SELECT r, unnest(gone) AS pos FROM h) AS g USING (r, pos) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN h USING (r) LEFT JOIN k USING (r)
"""
