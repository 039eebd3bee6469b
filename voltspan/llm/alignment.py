"""What the tokens of one tokenizer are in another's: aligned by bytes, segment by segment, each distinct segment once.

Texts are cut before runs of blanks, where neither vocabulary has a token across (`verified` checks the one, `byte_tokenizer` the other).
Documents go into blocks, rows of some megabytes of text that hold their distinct segments once and each document as a list of places in them.
Rows of a segment from all blocks meet in one sorted partition, at most one for each block, so no segment is hot; there it is tokenised and
aligned once, and its alignment goes back to each block that has it. A block then composes its documents' alignments.

Both tokenisations part the same bytes, so the places where either ends cut them into stretches, one for each overlapping pair of
tokens: a link. A stretch that ends both is the end of a group.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltspan.llm.common import written
from voltspan.llm.packing import byte_alphabet
from voltspan.llm.segments import by_row, byte_tokenizer, cut, spans
from voltspan.tables import table

#: Characters of text in a block (a longer text ends one), documents' segments that a block counts at once, segments whose alignments a task sends on together, and segments whose groups are written out at once.
BLOCK_CHARS, AT_ONCE, SENT, SLICE = 9_000_000, 50_000, 100_000, 20_000
A_ENDS, B_ENDS, BOTH = 1, 2, 3
_BLOCK = pa.schema([("block", pa.int64()), ("keys", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("places", pa.binary()), ("segments", pa.list_(pa.string()))])
_DONE = pa.schema(
    [("block", pa.int64()), ("keys", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("valid", pa.list_(pa.bool_()))]
    + [(n, pa.list_(pa.int64())) for n in ("n_a", "n_b", "n_groups", "n_links")]
    + [("digests", pa.list_(pa.string())), ("groups", pa.list_(pa.string())), ("pairs", pa.list_(pa.int64())), ("docs", pa.list_(pa.int32())), ("links", pa.binary()), ("link_counts", pa.binary())]
)
_RESULT = pa.schema([("key", pa.int64())] + [(n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")] + [("groups_sha256", pa.string()), ("groups", pa.string())])


def ddl(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.binary(): "binary", pa.bool_(): "boolean"}
    return ", ".join(f"`{f.name}` " + (f"array<{kinds[f.type.value_type]}>" if pa.types.is_list(f.type) else kinds[f.type]) for f in schema)


class Vocabulary:
    """The byte-level tokenizer A and the piece model B: the bytes of their tokens, and ids of segments."""

    def __init__(self, a_path: str, b_path: str):
        import json

        import sentencepiece

        self.a = byte_tokenizer(a_path, special=False)
        self.b = verified(sentencepiece.SentencePieceProcessor(model_file=b_path))
        with open(a_path, encoding="utf-8") as f:
            words, alphabet = json.load(f)["model"]["vocab"], byte_alphabet()
        self.a_bytes = [b""] * (max(words.values()) + 1)
        for word, i in words.items():
            self.a_bytes[i] = bytes(alphabet[c] for c in word) if all(c in alphabet for c in word) else word.encode()
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(self.b.id_to_piece, range(self.b.vocab_size())))]
        self.a_size, self.b_size = (np.array(list(map(len, v)), np.int64) for v in (self.a_bytes, self.b_bytes))
        self.kind = np.dtype("<u2" if max(len(self.a_bytes), len(self.b_bytes)) <= 1 << 16 else "<u4")

    def alignments(self, segments: list[str]) -> list[bytes]:
        """The alignment of each segment: how many links (uint32), a byte for each that says whose tokens end there, A's ids and B's.
        Nothing if either's bytes differ from the segment's. Segments begin with a blank, which B puts before a text itself."""
        a_ids = [e.ids for e in self.a.encode_batch_fast(segments, add_special_tokens=False)]
        b_ids = self.b.encode([s[1:] for s in segments], num_threads=1)
        out, good = [b""] * len(segments), []
        for i, s in enumerate(segments):
            data = s.encode()
            if b"".join([self.a_bytes[t] for t in a_ids[i]]) == data and b"".join([self.b_bytes[t] for t in b_ids[i]]) == data:
                good.append(i)
        a, b = (np.fromiter((t for i in good for t in ids[i]), np.int64) for ids in (a_ids, b_ids))
        ends_a, ends_b = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        ends = np.zeros(int(ends_a[-1]) + 1 if len(a) else 1, np.uint8)
        ends[ends_a] |= A_ENDS
        ends[ends_b] |= B_ENDS
        at = np.flatnonzero(ends)
        steps, a, b, size = ends[at].tobytes(), a.astype(self.kind).tobytes(), b.astype(self.kind).tobytes(), self.kind.itemsize
        last = np.cumsum([len(segments[i].encode()) for i in good])
        bounds = [0, *np.searchsorted(at, last, "right").tolist()]
        x = y = 0
        for k, i in enumerate(good):
            n, m, p = size * len(a_ids[i]), size * len(b_ids[i]), bounds[k + 1] - bounds[k]
            out[i] = b"".join((p.to_bytes(4, "little"), steps[bounds[k] : bounds[k + 1]], a[x : x + n], b[y : y + m]))
            x, y = x + n, y + m
        return out


def verified(model):
    """The piece model, if no piece goes on into a blank and none is defined by a user: then no merge crosses a cut. Else it raises."""
    for i in range(model.vocab_size()):
        piece = model.id_to_piece(i)
        if "▁" in piece.lstrip("▁"):
            raise ValueError(f"piece {piece!r} has a blank after its first character: segments can't be told apart")
    if model.encode("a  b", out_type=str)[:1] != ["▁a"] or "".join(model.encode(" a  b ", out_type=str)) != "▁▁a▁▁b▁":
        raise ValueError("the model doesn't put one blank before a text, or doesn't keep blanks")
    return model


@lru_cache(maxsize=1)
def vocabulary(a_path: str, b_path: str) -> Vocabulary:
    return Vocabulary(a_path, b_path)


def squeezed(numbers: np.ndarray) -> bytes:
    """Numbers below 2**32, compressed: how many, then all their lowest bytes, the next, and so on."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return len(numbers).to_bytes(8, "little") + pa.Codec("zstd", compression_level=3).compress(planes.tobytes(), asbytes=True)


def restored(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = pa.Codec("zstd").decompress(data[8:], 4 * n, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, n).T).view("<u4").reshape(n).astype(np.int64)


def block_row(number: int, keys: list, texts: list[str | None]) -> pa.RecordBatch:
    """A block: its documents' keys, how many segments each has, all places of segments, and the distinct segments."""
    known: dict[str, int] = {}
    counts, places = [], []
    for t in texts:
        parts = cut(f" {t}") if t else []
        places += [known.setdefault(p, len(known)) for p in parts]
        counts.append(len(parts))
    ordered = sorted(known)  # compresses better
    rank = np.zeros(len(known), np.int64)
    rank[[known[s] for s in ordered]] = np.arange(len(known))
    row = [[number], [keys], [counts], [squeezed(rank[places])], [ordered]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, _BLOCK.types, strict=True)], schema=_BLOCK)


def blocks_of(docs: DataFrame) -> DataFrame:
    """docs: (key, text). Written, as its blocks are named by the tasks that made them."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, keys, texts, size = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for k, t in zip(batch["key"].to_pylist(), batch["text"].to_pylist(), strict=True):
                keys.append(k)
                texts.append(t)
                size += len(t or "")
                if size >= BLOCK_CHARS:
                    yield block_row(number, keys, texts)
                    number, keys, texts, size = number + 1, [], [], 0
        if keys:
            yield block_row(number, keys, texts)

    return written(docs.mapInArrow(collect, ddl(_BLOCK)), codec="zstd")


def packed(block: np.ndarray, at: np.ndarray, found: list[bytes]) -> pa.RecordBatch:
    """A row for each block: the places of its segments, the sizes of their alignments, and these; compressed."""
    order = np.lexsort((at, block))
    names, first = np.unique(block[order], return_index=True)
    rows = []
    for some in np.split(order, first[1:]):
        mine = [found[i] for i in some.tolist()]
        numbers = squeezed(np.array([*at[some], *map(len, mine)]))
        rows.append(len(numbers).to_bytes(4, "little") + numbers + zlib.compress(b"".join(mine), 1))
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(rows, pa.binary())], ["block", "packed"])


def unpacked(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a block's alignments, and where they begin and how long they are, by the places of their segments."""
    at, size, data = [], [], []
    for row in rows:
        end = 4 + int.from_bytes(row[:4], "little")
        numbers = restored(row[4:end])
        at.append(numbers[: len(numbers) // 2])
        size.append(numbers[len(numbers) // 2 :])
        data.append(zlib.decompress(row[end:]))
    at, size = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (at, size))
    first, order = np.cumsum(size) - size, np.argsort(at)
    return np.frombuffer(b"".join(data) + bytes(4), np.uint8), first[order], size[order]


def aligned(blocks: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(block, packed): the alignments of the segments of each block, some at a time. Equal segments stand together and are tokenised once."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, before = vocabulary(a_path, b_path), {}
        block, at, found = [], [], []
        for batch in batches:
            segments = batch["segment"].to_pylist()
            new = [s for s in dict.fromkeys(segments) if s not in before]
            known = before | dict(zip(new, words.alignments(new), strict=True))
            block.append(batch["block"].to_numpy())
            at.append(batch["at"].to_numpy())
            found += [known[s] for s in segments]
            if len(found) >= SENT:
                yield packed(np.concatenate(block), np.concatenate(at), found)
                block, at, found = [], [], []
            before = {segments[-1]: known[segments[-1]]} if segments else before
        if found:
            yield packed(np.concatenate(block), np.concatenate(at), found)

    each = blocks.select("block", F.posexplode("segments").alias("at", "segment"))
    return each.repartition("segment").sortWithinPartitions("segment").mapInArrow(align, "block long, packed binary")


def composed(kind: np.dtype, keep_groups: bool):
    """A function of a block and the alignments of its segments: one row with its documents' alignments and the pairs linked in them."""

    def compose(block: pa.Table, found: pa.Table) -> pa.Table:
        counts = block["counts"].combine_chunks().flatten().to_numpy().astype(np.int64)
        places = restored(block["places"][0].as_py())
        data, first, size = unpacked(found["packed"].to_pylist())
        good, key = size > 0, block["block"].to_pylist()
        n_links = np.where(good, sum(data[first + i].astype(np.int64) << (8 * i) for i in range(4)), 0)
        steps = data[spans(first + 4, n_links)]
        a_end, b_end = (steps & A_ENDS) > 0, (steps & B_ENDS) > 0
        n_a, n_b, n_groups = by_row(a_end, n_links), by_row(b_end, n_links), by_row(steps == BOTH, n_links)
        ids = lambda at, n: data[spans(at, n * kind.itemsize)].view(kind).astype(np.int64)
        a, b = ids(first + 4 + n_links, n_a), ids(first + 4 + n_links + n_a * kind.itemsize, n_b)
        pairs, link = np.unique((a[np.cumsum(a_end) - a_end] << 32) | b[np.cumsum(b_end) - b_end], return_inverse=True)
        link, texts = link.astype(np.int32), group_texts(a, b, steps, n_links)
        del data, first, a, b, steps, a_end, b_end
        valid = (counts > 0) & (by_row(~good[places], counts) == 0)
        totals = [by_row(x[places], counts) * valid for x in (n_a, n_b, n_groups, n_links)]
        ends = np.cumsum(counts)
        groups = (";".join([texts[i] for i in places[e - n : e].tolist()]) if v else "" for e, n, v in zip(ends.tolist(), counts.tolist(), valid.tolist(), strict=True))
        digests, kept = [], []
        for g in groups:
            digests.append(hashlib.sha256(g.encode()).hexdigest() if g else "")
            kept.append(g if keep_groups else None)
        docs, link_first = np.zeros(len(pairs), np.int64), np.cumsum(n_links) - n_links
        for low, high in runs(counts):
            doc = np.repeat(np.arange(low, high), np.where(valid[low:high], counts[low:high], 0))
            place = places[spans((ends - counts)[low:high], np.where(valid[low:high], counts[low:high], 0))]
            doc, place = np.divmod(np.unique(doc * len(size) + place), max(len(size), 1))  # each document's distinct segments
            linked = np.unique(np.repeat(doc, n_links[place]) * len(pairs) + link[spans(link_first[place], n_links[place])])
            docs += np.bincount(linked % max(len(pairs), 1), minlength=len(pairs))
        row = [key, block["keys"].to_pylist(), [counts], [valid], *([t] for t in totals), [digests], [kept], [pairs], [docs.astype(np.int32)], [squeezed(link)], [squeezed(n_links)]]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(row, _DONE.types, strict=True)], schema=_DONE)

    return compose


def runs(counts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Consecutive documents with some AT_ONCE segments together."""
    low = total = 0
    for i, n in enumerate(counts.tolist()):
        if i > low and total + n > AT_ONCE:
            yield low, i
            low, total = i, 0
        total += n
    if low < len(counts):
        yield low, len(counts)


def group_texts(a: np.ndarray, b: np.ndarray, steps: np.ndarray, n_links: np.ndarray) -> list[str]:
    """The groups of each segment: `a1,a2|b1;a3|b2`. Made for some segments at a time, as lists of ids are large."""
    a_ends, b_ends, ends, out, x, y, z = (steps & A_ENDS) > 0, (steps & B_ENDS) > 0, np.cumsum(n_links), [], 0, 0, 0
    for low in range(0, len(n_links), SLICE):
        links = n_links[low : low + SLICE]
        some = slice(z, int(ends[low + len(links) - 1]))
        both, z = steps[some] == BOTH, some.stop
        a_at, b_at = np.cumsum(a_ends[some])[both].tolist(), np.cumsum(b_ends[some])[both].tolist()
        a_text, b_text = (list(map(str, ids[at : at + n[-1]].tolist())) if n else [] for ids, at, n in ((a, x, a_at), (b, y, b_at)))
        groups, i, j = [], 0, 0
        for p, q in zip(a_at, b_at, strict=True):
            groups.append((a_text[i] if p == i + 1 else ",".join(a_text[i:p])) + "|" + (b_text[j] if q == j + 1 else ",".join(b_text[j:q])))
            i, j = p, q
        x, y, at = x + len(a_text), y + len(b_text), 0
        for n in by_row(both, links).tolist():
            out.append(groups[at] if n == 1 else ";".join(groups[at : at + n]))
            at += n
    return out


def summed(done: pa.Table, found: pa.Table) -> pa.Table:
    """The documents of a block, with the counts of their links' pairs."""
    read = lambda c: restored(done[c][0].as_py())
    flat = lambda c: done[c].combine_chunks().flatten()
    counts, places, link, n_links = flat("counts").to_numpy().astype(np.int64), read("places"), read("links"), read("link_counts")
    n, best = np.zeros(int(link.max(initial=-1)) + 1, np.int64), np.zeros(int(link.max(initial=-1)) + 1, np.int64)
    at = found["at"].to_numpy()
    n[at], best[at] = found["n"].to_numpy(), found["best"].to_numpy(zero_copy_only=False)
    valid = flat("valid").to_numpy(zero_copy_only=False)
    total = lambda x: pa.array(by_row(by_row(x[link], n_links)[places], counts) * valid)
    return pa.Table.from_arrays([flat("keys"), *(flat(c) for c in ("n_a", "n_b", "n_groups", "n_links")), total(best), total(n), flat("digests"), flat("groups")], schema=_RESULT)


def align_tokenizers(docs: DataFrame, key: str, text: str, a_path: str, b_path: str, keep_groups: bool = False) -> tuple[DataFrame, DataFrame]:
    """The documents' alignments, and the corpus-wide counts of linked ids.

    The first has a row for each row of docs: the key (long), n_a and n_b tokens, n_groups, n_links (overlapping occurrences of tokens), n_best
    (links whose pair's count is the highest of its A id, ties included), count_sum (of the links' pairs), groups_sha256, and groups, the text
    `a1,a2|b1;a3|b2,b3`, null unless keep_groups. The second: a, b, n, how many documents hold the pair linked; best, whether none of a's has more.
    A text that is null or empty, or that either tokenizer doesn't give back byte for byte, has no tokens: zeros and an empty digest. Repeated rows count
    as often as they occur; a very long text is a block of its own, one row; of other columns none is read. Strings of special tokens are plain text.
    """
    blocks = blocks_of(docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")))
    kind = vocabulary(a_path, b_path).kind
    found = aligned(blocks, a_path, b_path)
    done = written(blocks.drop("segments").groupBy("block").cogroup(found.groupBy("block")).applyInArrow(composed(kind, keep_groups), ddl(_DONE)), tidy=True)
    each = done.select("block", F.posexplode(F.arrays_zip("pairs", "docs")).alias("at", "p")).select("block", "at", F.col("p.pairs").alias("pair"), F.col("p.docs").alias("docs")).where("docs > 0")
    a = F.shiftright("pair", 32)
    counts = written(each.groupBy("pair").agg(F.sum("docs").alias("n")), tidy=True)
    most = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))  # an A id has at most as many pairs as B has ids
    ranked = written(counts.withColumn("a", a).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), tidy=True)
    back = each.join(ranked, "pair").select(F.col("block").alias("of"), "at", "n", "best")  # a pair has one row for each block
    whole = done.drop("pairs", "docs").join(blocks.select("block", "places").hint("merge"), "block")
    result = whole.groupBy("block").cogroup(back.groupBy("of")).applyInArrow(summed, ddl(_RESULT)).withColumnRenamed("key", key)
    return result, ranked.select(a.alias("a"), F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b"), "n", "best")


def op12_align_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level tokens of all documents aligned with those of the piece model."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found, _ = align_tokenizers(docs, "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.drop("groups")
