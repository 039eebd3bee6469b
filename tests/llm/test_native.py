"""op1, op2 and op7 against plain Python."""

import hashlib
import random
import re

import pyarrow as pa
import pytest
from conftest import LONG, ODD, documents

from voltspan.llm import chat, decontaminate, quality

ITEMS = pa.schema([("item_id", pa.int64()), ("text", pa.string())])
TURNS = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def base(text):
    own = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    windows = [tuple(own[i : i + 8]) for i in range(len(own) - 7)]
    at = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    failed = len(own) < 20 or 100 * len(at) > 30 * len(own)
    return len(own), sum(map(len, own)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(at), failed


def test_base_counts(spark, write):
    texts = ["a b c d e f g h i\n" * 3, "x y " * 30, "one\none\n\n \n\none", "the of and to " * 4 + " ".join(f"w{i}" for i in range(50)), "# * $ | < é漢\U0001f600"]
    rows = [r for r in documents(texts) + [(k if k is None else k + 100, *r) for k, *r in ODD] if r[1] != LONG]
    got = quality.op1_quality(spark, write("documents", rows, extra=1)).collect()
    assert sorted((r[0] is None, r[0], *r[1:7]) for r in got) == sorted((r[0] is None, r[0], *base(r[1])) for r in rows)
    assert all(not r.kept or not r.base_failed for r in got)


def test_divergence_keeps_prose_and_drops_junk(spark, write):
    prose = ["The house of the man is in the town and it was built for a family that " + " ".join(f"{a}{b}" for a in ("plan", "stone", "water") for b in ("ed", "ing", "er", "s", "y", "ly", "able", "ness", "ful", "ment", "less", "ish", "al", "ic", "ous")) + f" {i}" for i in range(20)]
    junk = [" ".join(f"W{i}### x{i}$$$ {i}|" for i in range(80))]
    got = {r.doc_id: r.kept for r in quality.op1_quality(spark, write("documents", documents(prose + junk))).collect()}
    assert all(got[i] for i in range(20)) and not got[20]


def test_no_references(spark, write):
    assert quality.op1_quality(spark, write("documents", [])).count() == 0
    rows = [(i, " ".join(f"word{k}" for k in range(60)), None, None, None) for i in range(2)]
    assert all(r.kept for r in quality.op1_quality(spark, write("documents", rows, folder="none")).collect())


SAID = "</s>[INST] ok [/INST]"


def test_chat_round_trip(spark, write):
    hard = [SAID, "", None, "<\\s><s></s>[\\\\INST][INST]", "<<SYS>> x <</SYS>>", "<|role|>a<|text|>b<|end|>", " [/INST", "<", "a\\", "\n", "[[INST] <<s>", "</s", "漢\U0001f600"]
    rows = [(1, i, ("user", "assistant", "system", "tool", None, "<|text|>")[i % 6], t) for i, t in enumerate(hard * 3)] + [(2, 0, "assistant", "only")] * 2
    got = {r.conv_id: r for r in chat.op2_chat_format(spark, write("conversations", rows, TURNS, extra="x")).collect()}
    for key, own in {1: rows[: len(hard) * 3], 2: rows[-2:], -1: [(-1, 0, "user", SAID), (-1, 1, "assistant", SAID)]}.items():
        turns = [(r or "", t or "") for _, _, r, t in own]
        loss = "".join(t for r, t in turns if r == "assistant")
        r = got[key]
        assert r.n_turns == len(turns) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert set(got) == {1, 2, -1}


@pytest.mark.parametrize(
    ("record", "turns"),
    [
        ('{"prompt": "p", "response": "r"}', [("user", "p"), ("assistant", "r")]),
        ('{"instruction": "i", "input": "x", "output": "o"}', [("system", "i"), ("user", "x"), ("assistant", "o")]),
        ('{"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}', [("user", "a"), ("assistant", "b")]),
        ('{"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}', [("user", "a"), ("assistant", "b")]),
        ('{"id": 1, "prompt": "p", "response": "r", "meta": {"prompt": "x"}}', [("user", "p"), ("assistant", "r")]),
        ('{"prompt": "p", "response": "r", "system": "s", "input": 3}', [("system", "s"), ("user", "p"), ("assistant", "r")]),
        ('{"messages": [{"role": "user", "content": "a", "name": "n"}], "prompt": null}', [("user", "a")]),
        ('{"messages": []}', []),
        ('{"messages": "text"}', None),
        ('["prompt", "response"]', None),
        ('{"unknown": 1}', None),
        ("no json", None),
        (None, None),
    ],
)
def test_json_layouts(spark, record, turns):
    got = chat.json_turns(spark.createDataFrame([(1, record)], "id long, record string"), "id", "record").first()
    assert (got.turns if got.turns is None else [(t.role, t.text) for t in got.turns]) == turns


def test_table_layouts(spark):
    messages = spark.createDataFrame([(1, [("human", "a"), ("gpt", None)])], "id long, conversations array<struct<from:string,value:string>>")
    assert [(t.role, t.text) for t in chat.canonical_turns(messages, "id").first().turns] == [("user", "a"), ("assistant", "")]
    pairs = spark.createDataFrame([(1, "q", "a", 5)], "id long, question string, answer string, score int")
    assert [(t.role, t.text) for t in chat.canonical_turns(pairs, "id").first().turns] == [("user", "q"), ("assistant", "a")]
    with pytest.raises(ValueError):
        chat.canonical_turns(spark.range(1), "x")


@pytest.mark.parametrize("extra", ["system", "input", "output", "answer", "prompt", "Messages"])
def test_layouts_with_fields_of_others(spark, write, extra):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", LONG * 20)]
    got = {r.conv_id: r for r in chat.op2_chat_format(spark, write("conversations", rows, TURNS, **{extra: "x"})).collect()}
    assert (got[1].n_turns, got[1].loss_chars) == (2, len(LONG) * 20)


def low(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute_hits(docs, items):
    out = []
    for key, text, *_ in docs:
        own, at, found, close = low(text), set(), set(), set()
        for item, phrase in items:
            w, item = low(phrase), "" if item is None else str(item)
            for p in [w[i : i + 10] for i in range(max(len(w) - 9, 1))] if w else []:
                for s in range(len(own) - len(p) + 1):
                    if own[s : s + len(p)] == p:
                        at |= set(range(s, s + len(p)))
                        found.add(item)
                if set(p) <= set(own) and any(all(own[s : s + len(p) + 2].count(x) >= p.count(x) for x in p) for s in range(max(len(own) - len(p) - 1, 1))):
                    close.add(item)
        out.append((key, len(own), len(at), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(at), len(close)))
    return sorted(out, key=str)


A = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"


@pytest.mark.parametrize("rows", [decontaminate.BROADCAST_ROWS, 0])
def test_contamination_like_brute_force(spark, write, monkeypatch, rows):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", rows)  # 0: every join shuffles
    items = [(1, A), (2, "short Phrase"), (3, None), (4, ""), (10, A.upper() + " xi"), (5, "the the the the the the the the the the the the"), (None, "no id here"), (None, "nor here"), (1, A), (6, "beta beta gamma")]
    texts = [
        f"x {A}, y", "some short phrase here. Short-phrase!", "the " * 30, "beta gamma delta epsilon zeta eta theta iota kappa lambda", "beta gamma delta epsilon zeta eta theta iota kappa", f"{A} {A}", "no id here nor here",
        "phrase which is short", "phrase it short", "beta gamma x beta", "beta gamma x y beta", "gamma beta", "x " * 63 + A, "the " * 9 + "a the b the c the",
        "kappa beta gamma x delta epsilon eta zeta y theta iota lambda",
    ]
    docs = documents(texts) + [(k if k is None else k + 100, *r) for k, *r in ODD] + [(3, texts[3], None, None, 1), (3, "another text short phrase", None, None, 1)]
    sf = write("documents", docs, term="x", k=1, P=2, print="y")
    write("benchmark", items, ITEMS, n_chars=1, phrase="z", pid=1)
    got = sorted((tuple(r) for r in decontaminate.op7_decontaminate(spark, sf).collect()), key=str)
    assert got == brute_hits(docs, items)
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    kept = decontaminate.decontaminated(frame, spark.read.parquet(f"{sf}/benchmark.parquet"))
    assert kept.count() == sum(not r[5] for r in got) and kept.columns == frame.columns


def test_contamination_across_blocks_of_a_long_text(spark, write):
    rng = random.Random(7)
    own = [rng.choice("abcdefgh") for _ in range(4000)]
    items = [(i, " ".join(own[at : at + 14])) for i, at in enumerate(range(50, 3900, 37))] + [(900 + i, " ".join(rng.sample(own[at : at + 10], 10))) for i, at in enumerate(range(55, 3900, 101))]
    docs = [(1, " ".join(own), None, None, 1), (2, " ".join(reversed(own)), None, None, 1)]
    sf = write("documents", docs)
    write("benchmark", items, ITEMS)
    got = sorted((tuple(r) for r in decontaminate.op7_decontaminate(spark, sf).collect()), key=str)
    assert got == brute_hits(docs, items)


def test_contamination_of_empty_tables(spark, write):
    sf = write("documents", documents(["a b c"]))
    write("benchmark", [], ITEMS)
    assert [r.contaminated for r in decontaminate.op7_decontaminate(spark, sf).collect()] == [False]
    sf = write("documents", [], folder="none")
    write("benchmark", [(1, "a")], ITEMS, folder="none")
    assert decontaminate.op7_decontaminate(spark, sf).count() == 0
