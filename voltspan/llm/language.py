"""Language identification: averaged hashed subword embeddings and a linear softmax, trained by SGD in numpy.

A text is the mean of the embeddings of its hashed subwords (runs of 2 to 4 bytes of a lower-cased word, its ends marked), and a
linear layer with softmax gives the languages. Temperature scaling and a rejection threshold are fitted on a part of the sample.
As the model is linear after the mean, prediction adds up rows of a small table embeddings @ weights for each subword.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from voltspan.llm.common import chunks, struct, unused
from voltspan.tables import table

#: Rows of the training sample at most, and the shape of the model.
SAMPLE_ROWS, BUCKETS, DIM, EPOCHS = 4000, 1 << 16, 16, 6
ORDERS = (2, 3, 4)
#: Share of right predictions of the calibration part that rejection may cost at most.
REJECT_SHARE = 0.002
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
FEATURES = struct(idx="binary", cnt="binary")
PREDICTION = struct(lang_pred="string", score="double", rejected="boolean")

_LETTER_BYTE = np.full(256, 0x20, np.uint8)
_LETTER_BYTE[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_LETTER_BYTE[0x80:] = np.arange(0x80, 256)


def subwords(data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the bucket of the subword at each byte, and whether there is one.

    data: lower-cased UTF-8 bytes with a space before and after each text; all but letters count as spaces.
    """
    wide = _LETTER_BYTE[data].astype(np.uint32)
    letter = wide != 0x20
    for n in ORDERS:
        m = len(wide) - n + 1
        if m <= 0:
            continue
        gram, valid = wide[:m].copy(), letter[1 : m + 1].copy() if n > 2 else letter[:m] | letter[1 : m + 1]
        for k in range(1, n):
            gram |= wide[k : m + k] << np.uint32(8 * k)
        for k in range(2, n - 1):
            valid &= letter[k : m + k]
        bucket = (gram * np.uint32(0x9E3779B1) + np.uint32(0x85EBCA6B * n & 0xFFFFFFFF)) >> np.uint32(16)
        yield bucket.astype(np.int32) & (BUCKETS - 1), valid


def normalised(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The lower-cased bytes of texts, one space around each, and the offset of each."""
    parts = [b" " + t.lower().encode("utf-8", "replace") + b" " for t in texts]
    offsets = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    return np.frombuffer(b"".join(parts), np.uint8), offsets


@arrow_udf(FEATURES)
def features(texts: pa.Array) -> pa.Array:
    """Buckets and counts of the subwords of each text, as bytes of int32 and float32."""
    idx, cnt = [], []
    for text in texts.to_pylist():
        total = np.zeros(BUCKETS, np.int64)
        for bucket, valid in subwords(normalised([text or ""])[0]):
            total += np.bincount(bucket[valid], minlength=BUCKETS)
        found = np.flatnonzero(total)
        idx.append(found.astype(np.int32).tobytes())
        cnt.append(total[found].astype(np.float32).tobytes())
    return pa.StructArray.from_arrays([pa.array(idx, pa.binary()), pa.array(cnt, pa.binary())], ["idx", "cnt"])


@dataclass(frozen=True)
class Model:
    """langs[k] belongs to column k of table, which has a row for each bucket; bias has one value for each language."""

    langs: tuple[str, ...]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def logits(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.langs)))
        count = np.zeros(len(texts))
        sizes = [len(t) for t in texts]
        for part in chunks(sizes, 1_000_000):
            data, offsets = normalised(texts[part])
            for at in range(0, len(data), 1_000_000):  # a very long text goes in pieces that overlap by a subword
                for bucket, valid in subwords(data[at : at + 1_000_000 + max(ORDERS) - 1]):
                    if at + 1_000_000 < len(data):
                        bucket, valid = bucket[:1_000_000], valid[:1_000_000]
                    position = np.flatnonzero(valid)
                    row = np.searchsorted(offsets, position + at, side="right") - 1
                    if not len(row):
                        continue
                    begin = np.flatnonzero(np.diff(row, prepend=-1))
                    which = row[begin] + part.start
                    out[which] += np.add.reduceat(self.table[bucket[position]], begin, axis=0)
                    count[which] += np.diff(np.append(begin, len(row)))
        return out / np.maximum(count, 1)[:, None] + self.bias


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 7) -> Model | None:
    """Fits a model on (language, buckets, counts); a fifth of the rows only calibrates. None without a row."""
    rows = [r for r in rows if len(r[1])]
    langs = tuple(sorted({r[0] for r in rows}))
    if not langs:
        return None
    rng = np.random.default_rng(seed)
    label = np.array([langs.index(r[0]) for r in rows])
    weight = [c / c.sum() for _, _, c in rows]
    order = rng.permutation(len(rows))
    held, fit = (order[: len(order) // 5], order[len(order) // 5 :]) if len(order) >= 50 else (order, order)
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    steps, step = EPOCHS * len(fit), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(fit):
            rate = np.float32(1.0 * (1 - step / steps) + 0.01)
            idx, w = rows[i][1], weight[i]
            mean = w @ emb[idx]
            error = softmax(mean @ out + bias)
            error[label[i]] -= 1
            back = out @ error
            out -= rate * np.outer(mean, error)
            bias -= rate * np.float32(0.1) * error
            emb[idx] -= (rate * np.float32(len(idx) ** 0.5) * w)[:, None] * back[None, :]
            step += 1
    logits = np.array([weight[i] @ (emb[rows[i][1]] @ out) + bias for i in held])
    right = label[held]
    heat = np.geomspace(1, 16, 41)
    loss = [-np.log(softmax(logits / t)[np.arange(len(held)), right] + 1e-9).mean() for t in heat]
    temperature = float(heat[int(np.argmin(loss))])
    p = softmax(logits / temperature)
    sure = p.max(axis=1)[p.argmax(axis=1) == right]
    threshold = min(0.5, float(np.quantile(sure, REJECT_SHARE))) if len(sure) else 0.0
    return Model(langs, (emb @ out).astype(np.float32), bias.astype(np.float64), temperature, threshold)


def sample(df: DataFrame, key: str, text: str, lang: str, rows: int = SAMPLE_ROWS) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """Subword counts of up to `rows` labelled rows, those whose key has the smallest hash. Rows without a label or key are left out.

    The keys are chosen without reading a text; the texts stay on the executors, and a row's counts are bounded by the buckets.
    """
    known = df.where(F.col(lang).isNotNull() & F.col(key).isNotNull())
    keys = known.select(key, F.shiftrightunsigned(F.xxhash64(key), 1).alias("_h"))
    share = min(1.0, 4 * rows / max(1, keys.count()))  # so that few rows of each partition meet in the last sort, however many there are
    chosen = keys.where(F.col("_h") <= min(int(share * 2**63), 2**63 - 1)).distinct().orderBy("_h", key).limit(rows).select(key)
    picked = known.select(key, text, lang).join(F.broadcast(chosen), key, "left_semi").dropDuplicates([key])
    found = picked.select(F.col(lang).alias("lang"), features(text).alias("f")).select("lang", "f.*").toArrow()
    return [(a, np.frombuffer(b, np.int32), np.frombuffer(c, np.float32)) for a, b, c in zip(*(found[x].to_pylist() for x in ("lang", "idx", "cnt")), strict=True)]


def predict(spark: SparkSession, model: Model | None, text: str | Column) -> Column:
    """A struct (lang_pred, score, rejected) for each whole text.

    Null or without a letter: `und`, 0, rejected; so too if nothing could be learned. rejected: the calibrated score is below the threshold.
    """
    shared = spark.sparkContext.broadcast(model)

    @arrow_udf(PREDICTION)
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = shared.value
        for batch in batches:
            n = len(batch)
            lang, score, rejected = np.full(n, UNKNOWN, object), np.zeros(n), np.ones(n, bool)
            for begin in range(0, n, 256):
                texts = batch.slice(begin, 256).to_pylist()
                at = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
                if known is None or not at:
                    continue
                p = softmax(known.logits([texts[i] for i in at]) / known.temperature)
                where = np.array(at) + begin
                lang[where] = np.array(known.langs, object)[p.argmax(axis=1)]
                score[where] = p.max(axis=1)
                rejected[where] = p.max(axis=1) < known.threshold
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], ["lang_pred", "score", "rejected"])

    return judge(text)


def held_out(key: str = "doc_id") -> Column:
    """Whether a row is never learned from: crc32 of the key as text, modulo 5, is 0 (false for a null key, which isn't learned from either)."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def judged(docs: DataFrame, name: str) -> DataFrame:
    """Adds to documents the struct `name` (held_out, lang_pred, score, rejected), by a model learned from those that aren't held out.

    Learned are text and lang of at most SAMPLE_ROWS keys; of rows that share a key with different texts any one may be. An empty
    table, or one without labels, gives `und` for all; null texts and those without a letter do too; very long ones are read whole;
    a tie of two languages goes to the first by name. All other columns stay as they are.
    """
    model = train(sample(docs.where(~held_out()), "doc_id", "text", "lang"))
    p = unused(docs, "p")
    known = docs.withColumn(p, predict(docs.sparkSession, model, "text"))
    return known.withColumn(name, F.struct(held_out().alias("held_out"), f"{p}.*")).drop(p)


def identify(docs: DataFrame) -> DataFrame:
    """Adds held_out, lang_pred, score and rejected to documents; columns of these names that docs has are replaced."""
    return judged(docs.drop("held_out", "lang_pred", "score", "rejected"), p := unused(docs, "judged")).select("*", f"{p}.*").drop(p)


def accepted(docs: DataFrame) -> DataFrame:
    """The documents whose language isn't rejected; all columns stay as they are, whatever their names."""
    p = unused(docs, "judged")
    return judged(docs, p).where(~F.col(p)["rejected"]).select(*docs.columns)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs).select("doc_id", "held_out", "lang_pred", "score", "rejected")
