import zlib
from collections import defaultdict

import numpy as np
from conftest import LONG, ODD, documents
from tokenizers import Tokenizer

from voltspan.llm import packing as P


def check(rows, pieces):
    bpe = Tokenizer.from_file(P.default_tokenizer())
    texts = {k: bpe.encode(t or "", add_special_tokens=False).ids + [0] for k, t, *_ in rows}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for k, own in by_doc.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(texts[k])
            assert r.ids_crc32 == zlib.crc32(np.array(texts[k][at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(texts[k])
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    return sum(r.length for r in pieces) / (1024 * len(by_sequence))


def test_every_id_once(spark, write):
    texts = ["word " * n + "é<|endoftext|> x" for n in range(0, 900, 7)] + [LONG]
    rows = documents(texts) + [(k if k is None else k + 1000, *r) for k, *r in ODD]
    filled = check(rows, P.op8_packing(spark, write("documents", rows)).collect())
    assert filled > 0.95


def test_repeated_rows_and_empty_table(spark, write):
    got = P.op8_packing(spark, write("documents", [ODD[3]] * 5)).collect()
    assert len(got) == 5 and len({(r.sequence_id, r.offset) for r in got}) == 5
    assert P.op8_packing(spark, write("documents", [], folder="none")).count() == 0


def test_cuts_fill_their_class():
    for n in range(1, 5000):
        own = P.cut(n)
        assert sum(own) == n
        assert all((1024 // k) * k >= 0.97 * 1024 for k in own)


def test_same_ids_as_the_library():
    bpe, mine = Tokenizer.from_file(P.default_tokenizer()), P.encoding(P.default_tokenizer())
    for text in [LONG, "a  b\n\n c\t\td   ", "It's we'll 1234 +-*/ ñandú 漢字 \U0001f600 z", "x<|endoftext|>y", "\x00\x7f́e"]:
        assert mine.encode(text, allowed_special="all", disallowed_special=()) == bpe.encode(text, add_special_tokens=False).ids
