"""Codes, alignments and segments against plain versions."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import DOCS, ODD, documents
from voltspan.llm import alignment, codes, segments
from voltspan.llm.packing import byte_alphabet

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
AWKWARD = [
    "a  b", " lead", "trail ", "trail  ", " ", "   ", "\n x", "a\n b", "a \n b", "a\u00a0 b", "a\x1c b", "a\u180e b", "\u3000 x", "x\u2003 y", "a\u200b b", "<|endoftext|> y", "see<|endoftext|>", "<s> a </s>",
    "a▁b", "▁", "it's we'll 'd 's", "\t\tif x:\n\t\t    y  = 1\r\n", "é e\u0301 ﬁ ①", "\U0001f600 \U0001f468\u200d\U0001f469", "0 1 23 456  7890", "end\u0085 x", "nul\x00 x", "a" * 3000, "ab " * 700, "%$# !! ..", "\ufeff bom",
]


def random_texts(n, seed=5):
    rng = random.Random(seed)
    alphabet = ["a", "b", "the", " ", " ", "  ", "\n", "\t", "é", "1", ".", "'s", "▁", "\u00a0", "\x1d", "中", "\r\n", "Ġ", "<s>"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(n)]


def plain_tokenizer(special):
    t = tokenizers.Tokenizer.from_file(A)
    t.encode_special_tokens = not special
    return t


def test_segments_give_the_ids_of_whole_texts():
    whole, ids = plain_tokenizer(True), segments.Ids(A)
    for texts in (AWKWARD, random_texts(400)):
        assert all("".join(segments.cut(t)) == t for t in texts)
        found = ids.of(pa.array([*texts, None], pa.string()))
        assert [x.tolist() for x in np.split(found.values, np.cumsum(found.counts)[:-1])] == [*(whole.encode(t, add_special_tokens=False).ids for t in texts), []]


def test_a_tokenizer_with_tokens_across_blanks_is_refused():
    with pytest.raises(ValueError):
        segments.byte_tokenizer(public_tokenizers.path("word_bpe_49k.json"), True)


@pytest.mark.parametrize("ids", [[], [0], [2**32 - 1, 0, 7], list(range(2000)), [0] * 1500 + [2**20], "random"])
def test_every_code_is_addressable(ids):
    rng = np.random.default_rng(1)
    ids = (rng.integers(0, 2**32, 5000) >> rng.integers(0, 32, 5000)).tolist() if ids == "random" else ids
    data, widths = codes.built(np.array(ids, np.uint32), np.array([0, len(ids)]), [None])
    read = codes.Codes(lambda place, size: data[place : place + size])
    assert sum(widths) >= max(ids, default=0).bit_length()
    assert read.ids(0, len(ids)).tolist() == ids
    assert [read.one(i) for i in range(0, len(ids), 7)] == ids[::7]
    assert all(read.ids(a, b).tolist() == ids[a:b] for a, b in [(0, len(ids) // 2), (len(ids) // 3, len(ids) // 2), (len(ids), len(ids))])
    assert read.documents()[1] == [None]
    with pytest.raises(IndexError):
        read.ids(0, len(ids) + 1)


def test_widths_cost_no_more_than_any_two_levels():
    ids = np.concatenate((np.arange(50_000) % 900, np.arange(500) * 90))
    cost = lambda widths: sum(int((ids >= 1 << sum(widths[:i])).sum() if i else len(ids)) * (w + (1 + 64 / codes.BLOCK if i + 1 < len(widths) else 0)) for i, w in enumerate(widths))
    best = codes.level_widths(ids)
    assert all(cost(best) <= cost([w, 16 - w]) for w in range(1, 16)) and cost(best) <= cost([16])


def test_one_token_reads_few_bytes():
    ids = np.arange(100_000, dtype=np.uint32) % 40_000
    data, _ = codes.built(ids, np.array([0, len(ids)]), [1])
    taken = []
    read = codes.Codes(lambda place, size: taken.append(size) or data[place : place + size])
    taken.clear()
    assert read.one(77_777) == 77_777 % 40_000
    assert sum(taken) < 64 * 4 * len(read.levels)


def op11_plain(rows):
    whole, start, out = plain_tokenizer(True), 0, []
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_op11_gives_what_it_wrote(spark, write):
    from voltspan.llm.codes import op11_addressable_codes

    rows = ODD + [(100 + i, t, "en", "a", len(t)) for i, t in enumerate(AWKWARD + random_texts(60))]
    got = op11_addressable_codes(spark, write("documents", rows, ids="x", key=1, row=0, tie=0)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(op11_plain([(r[0], r[1]) for r in rows]), key=repr)
    assert op11_addressable_codes(spark, write("documents", [], folder="none")).count() == 0


def test_many_files_repeated_keys_and_random_access(spark, tmp_path, monkeypatch):
    texts = [f"word{i} and {'more ' * (i % 50)}" for i in range(300)]
    docs = spark.createDataFrame([(i // 3 if i < 150 else 7, t) for i, t in enumerate(texts)], "k long, t string")
    monkeypatch.setattr(codes, "FILE_IDS", 500)
    monkeypatch.setattr(codes, "TEXT_BYTES", 1000)
    codes.write_codes(docs, "k", "t", A, path := f"file://{tmp_path}/codes")
    files = codes.manifest(spark, path).collect()
    assert len(files) > 10 and all(f["n_ids"] for f in files)
    back = codes.read_codes(spark, path).orderBy("start").collect()
    whole = plain_tokenizer(True)
    assert [r["key"] for r in back] == sorted(r["key"] for r in back) and len(back) == 300
    assert Counter((r["key"], bytes(r["ids"])) for r in back) == Counter((r["k"], np.array([*whole.encode(r["t"], add_special_tokens=False).ids, 0], "<u4").tobytes()) for r in docs.collect())
    every = [int(x) for r in back for x in np.frombuffer(r["ids"], "<u4")]
    places = spark.createDataFrame([(p, "x") for p in [None, -1, 0, 1, 499, 500, len(every) - 1, len(every), *range(0, len(every), 37)]], "p long, id string")
    looked = codes.tokens_at(places, "p", path)
    assert looked.columns == ["p", "id", "_id"]
    assert all(r["_id"] == (every[r["p"]] if r["p"] is not None and 0 <= r["p"] < len(every) else None) for r in looked.collect())


def test_files_of_lost_tasks_are_not_read(spark, tmp_path):
    codes.write_codes(spark.createDataFrame([(1, "one two")], "k long, t string"), "k", "t", A, path := f"file://{tmp_path}/codes")
    (tmp_path / "codes" / "000000-000000-dead.codes").write_bytes(b"half a file")
    assert [r["key"] for r in codes.read_codes(spark, path).collect()] == [1]


def op12_plain(rows):
    import sentencepiece

    a, b, alphabet = plain_tokenizer(False), sentencepiece.SentencePieceProcessor(model_file=B), byte_alphabet()
    words = {i: w for w, i in a.get_vocab().items()}
    a_bytes = lambda i: bytes(alphabet[c] for c in words[i])
    b_bytes = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    done, count = [], Counter()
    for key, text in rows:
        ia, ib = (a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        if not text or not b"".join(map(a_bytes, ia)) == b"".join(map(b_bytes, ib)) == f" {text}".encode():
            done.append((key, None))
            continue
        ends = lambda ids, f: np.cumsum([len(f(i)) for i in ids]).tolist()
        ea, eb = ends(ia, a_bytes), ends(ib, b_bytes)
        links = [(ia[i], ib[j]) for i in range(len(ia)) for j in range(len(ib)) if max(ea[i - 1] if i else 0, eb[j - 1] if j else 0) < min(ea[i], eb[j])]
        shared = sorted(set(ea) & set(eb))
        group = lambda ids, e, low, high: ",".join(str(i) for i, x in zip(ids, e, strict=True) if low < x <= high)
        groups = [group(ia, ea, low, high) + "|" + group(ib, eb, low, high) for low, high in zip([0, *shared], shared, strict=False)]
        count.update(set(links))
        done.append((key, (len(ia), len(ib), len(groups), links, ";".join(groups))))
    best = {}
    for (x, _), n in count.items():
        best[x] = max(n, best.get(x, 0))
    return [(k, 0, 0, 0, 0, 0, 0, "") if v is None else (k, *v[:3], len(v[3]), sum(count[p] == best[p[0]] for p in v[3]), sum(count[p] for p in v[3]), hashlib.sha256(v[4].encode()).hexdigest()) for k, v in done], count, best


@pytest.mark.parametrize("block", [16_000_000, 300])
def test_op12_aligns_as_pairs_of_ranges_do(spark, write, monkeypatch, block):
    from voltspan.llm.alignment import op12_align_tokenizers

    monkeypatch.setattr(alignment, "BLOCK_CHARS", block)
    monkeypatch.setattr(alignment, "AT_ONCE", block // 100)
    rows = [r if r[1] is None or len(r[1]) < 400 else (*r[:1], r[1][:400], *r[2:]) for r in ODD] + [(100 + i, t[:400], "en", "a", len(t)) for i, t in enumerate(AWKWARD + random_texts(150))]
    got = op12_align_tokenizers(spark, write("documents", rows, block=1, at="x", Segment=2)).collect()
    want, _, _ = op12_plain([(r[0], r[1]) for r in rows])
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_pairs_and_groups_come_out(spark):
    rows = [(1, "one two"), (2, "one two three"), (3, "two"), (3, "two"), (4, None)]
    docs, pairs = alignment.align_tokenizers(spark.createDataFrame(rows, "k long, t string"), "k", "t", A, B, keep_groups=True)
    _, count, best = op12_plain(rows)
    assert {(r["a"], r["b"]): (r["n"], r["best"]) for r in pairs.collect()} == {p: (n, n == best[p[0]]) for p, n in count.items()}
    got = docs.collect()
    assert len(got) == 5 and all(hashlib.sha256(r["groups"].encode()).hexdigest() == r["groups_sha256"] for r in got if r["n_a"])


def test_op12_takes_a_very_long_text_and_no_rows(spark, write):
    from voltspan.llm.alignment import op12_align_tokenizers

    long = " ".join(f"w{i % 5000}" for i in range(200_000)) + "x" * 100_000
    got = op12_align_tokenizers(spark, write("documents", documents([long, "w1 w2"]))).orderBy("doc_id").collect()
    assert got[0]["n_a"] == len(plain_tokenizer(False).encode(f" {long}").ids) and got[0]["n_groups"] > 200_000 and got[1]["n_links"] > 0
    assert op12_align_tokenizers(spark, write("documents", [], folder="none")).count() == 0


def test_a_model_with_inner_blanks_is_refused():
    class Fake:
        vocab_size = lambda self: 1
        id_to_piece = lambda self, i: "a▁b"

    with pytest.raises(ValueError):
        alignment.verified(Fake())


def test_words_are_remembered_from_run_to_run(monkeypatch):
    """Words of an earlier run were tokenised again; whatever is remembered, ids are those of whole texts."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    runs = [[f"so {' '.join(f'word{a}{b}' for a in 'abcdef' for b in 'uvwxyz')}, and été{i}! x", None, "", f"only here{i} abcdefg" * 3] for i in range(3)]
    for limit in (1 << 20, 600, 0):
        monkeypatch.setattr(segments, "REMEMBERED", limit)
        tokens, asked = segments.Ids(path), []
        monkeypatch.setattr(tokens, "lined", lambda words, f=tokens.lined, asked=asked: (asked.append(set(words)), f(words))[1])
        for texts in [*runs, runs[0]]:
            found = tokens.of(pa.array(texts, pa.string()))
            want = [tokens.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
            assert [x.tolist() for x in np.split(found.values, np.cumsum(found.counts)[:-1])] == want
            assert tokens.words.nbytes + tokens.known.values.nbytes + tokens.known.counts.nbytes <= limit + 100
        assert (limit < 1 << 20) or not any(a & b for i, a in enumerate(asked) for b in asked[:i])


def test_packed_codes_are_bits_lowest_first():
    rng = np.random.default_rng(5)
    for width in range(1, 33):
        for n in (0, 1, 7, 8, 9, 1000):
            own = rng.integers(0, 1 << width, n, dtype=np.uint64).astype(np.uint32)
            bits = np.packbits(((own[:, None].astype(np.uint64) >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8), bitorder="little")
            assert codes.packed(own, width) == bits.tobytes() + bytes(8)
