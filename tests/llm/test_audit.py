"""The filter audit against a plain replay."""

import re
from collections import Counter
from itertools import permutations

import pyarrow as pa
import pytest

from tests.llm.conftest import LONG, ODD
from voltspan.llm import audit

LABELS = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())])
MORE = [(20 + i, t, lang, "a", None) for i, (t, lang) in enumerate([
    ("A B C " * 60, "en"), ("word " * 120, "en"), ("SHOUT " * 10, "de"), ("SHOUT " * 10, "de"), ("pay $ 5", ""), (" ".join(f"w{i}" for i in range(99)), None), (" ".join(f"w{i}" for i in range(100)), None),
    (" ".join(f"w{i % 80}" for i in range(100)), "en"), (" ".join(f"w{i % 79}" for i in range(100)), "en"), ("AAAAAAAAAA" + "b" * 90, "en"), ("AAAAAAAAAAA" + "b" * 89, "en"), (LONG, "fr"), ("x\x0by\x0cz\u00a0w", "fr"), (None, "fr"), ("", None),
])]


def plain(rows, labels):
    flagged = []
    for key, text, lang, *_ in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {f for f, c in zip("ABCDE", (
            len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)),
            key is not None and any(k is not None and k < key and (o or "") == t for k, o, *_ in rows),
        ), strict=True) if c}
        mine = [r for r in labels if key is not None and r[0] == key]
        flagged.append((lang or "", fails, any(r[1] == 1 for r in mine), any(r[2] == 1 for r in mine)))
    out = {}
    for part in {f[0] for f in flagged}:
        shapley = Counter()
        own = [f for f in flagged if f[0] == part]
        for order in permutations("ABCDE"):
            for step, letter in enumerate(order, 1):
                before = set(order[: step - 1])
                removed = [f for f in own if letter in f[1] and not f[1] & before]
                shapley[letter] += len(removed)
                out[part, "".join(order), step] = [
                    sum(not f[1] & (before | {letter}) for f in own), len(removed), sum(letter in f[1] and bool(f[1] & before) for f in own), sum(f[1] == {letter} for f in own), sum(f[2] for f in removed), sum(f[3] for f in removed),
                ]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


@pytest.mark.parametrize("heavy", [1000, 2])
def test_the_replay_counts_as_a_plain_one(spark, write, monkeypatch, heavy):
    monkeypatch.setattr(audit, "HEAVY", heavy)  # at 2, copies of half the rows are joined apart
    labels = [(20, 1, 0), (21, 0, 1), (22, 1, 1), (22, 1, 1), (23, None, None), (24, 1, None), (None, 1, 1), (5, 0, 1), (5, 1, 0), (6, 1, 0), (31, 1, 1)]
    rows = ODD + MORE + [(60 + i, "same", "en", "a", 4) for i in range(40)]
    write("documents", rows, part=1, A="x", key="y", digest=0)
    got = audit.op13_filter_audit(spark, write("labels", labels, LABELS, lang="zz")).collect()
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in names) for r in got} == plain(rows, labels)


def test_no_documents_no_parts(spark, write):
    write("documents", [])
    assert audit.op13_filter_audit(spark, write("labels", [], LABELS)).count() == 0


def test_other_filters(spark):
    flagged = spark.createDataFrame([("p", True, None, True), ("p", False, True, False), (None, None, None, None)], "part string, short boolean, loud boolean, dear boolean")
    got = {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["dear"], r["shapley"]) for r in audit.replay(flagged, "part", {"s": "short", "l": "loud"}, {"dear": "dear"}).collect()}
    assert got[("p", "sl", 1)] == (1, 1, 1, 2) and got[("p", "sl", 2)] == (0, 1, 0, 2) and got[("", "ls", 2)] == (1, 0, 0, 0) and len(got) == 8
    with pytest.raises(ValueError):
        audit.replay(flagged, "part", {"ab": "short"})
