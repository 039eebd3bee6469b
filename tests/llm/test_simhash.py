import random

import numpy as np
import xxhash
from conftest import ODD, documents

from voltspan.llm import nearcopies
from voltspan.llm import simhash as S


def brute_print(text):
    words = [w for w in (text or "").translate({c: c + 32 for c in range(65, 91)}).replace("\n", " ").replace("\t", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    prints = {}
    for key, text, *_ in rows:
        prints.setdefault(brute_print(text), []).append(key)
    left, found = set(prints), {}
    while left:
        todo, own = [left.pop()], []
        while todo:
            own.append(x := todo.pop())
            close = {y for y in left if (x ^ y).bit_count() <= 2}
            left -= close
            todo += close
        keys = [k for x in own for k in prints[x] if k is not None]
        for x in own:
            found |= {(k, x): min(keys, default=None) for k in prints[x]}
    return sorted(((k, f"{x:016x}", c) for (k, x), c in found.items()), key=str)


def near_copies(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts = [None, "", "two words"]
    for _ in range(40):
        base = [word() for _ in range(rng.randint(40, 160))]
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    return texts


def test_matches_brute_force(spark, write):
    rows = documents(near_copies()) + [(k if k is None else k + 1000, *r) for k, *r in ODD]
    got = sorted(((r[0], r[1], r[2]) for r in S.op10_simhash(spark, write("documents", rows)).collect()), key=str)
    assert got == brute(rows)
    assert len({r[2] for r in got}) < len({r[1] for r in got})  # something linked beyond equal prints


def test_empty_table(spark, write):
    assert S.op10_simhash(spark, write("documents", [])).count() == 0


def test_every_plan_finds_every_pair(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(-(2**63), 2**63, 60)
    close = [int(x) ^ (1 << int(a)) ^ (1 << int(b)) for x in base[:30] for a, b in [rng.integers(0, 63, 2)]]
    prints = spark.createDataFrame([(int(x),) for x in {*map(int, base), *close}], "fp long")
    for parts, thresholds in ((1, (2,)), (2, (1, 0)), (2, (2, -1)), (3, (0, 0, 0)), (3, (1, 0, -1))):
        width = 64 // parts
        groups = tuple(tuple(range(i * width, 64 if i == parts - 1 else (i + 1) * width)) for i in range(parts))
        kept = {r[0] for r in S.probe(prints, S.Plan(groups, thresholds)).collect()}
        assert {*close} <= kept


def test_nested_plan_finds_every_pair_and_little_else(spark):
    both = np.full((64, 64), 0.25)
    np.fill_diagonal(both, 0.5)
    plan = S.allot(10**11, both)
    assert all(deeper for further in plan.then for deeper in further.then)  # three levels
    rng = np.random.default_rng(6)
    base = [int(x) for x in rng.integers(-(2**63), 2**63, 300)]
    close = [x ^ (1 << int(a)) ^ (1 << int(b)) for x in base[:60] for a, b in [rng.integers(0, 63, 2)]]
    alike = [x ^ (2**12 - 1) for x in base[100:200]]  # the same but for 12 neighbouring bits
    prints = spark.createDataFrame([(x,) for x in {*base, *close, *alike}], "fp long")
    kept = {r[0] for r in S.probe(prints, plan).collect()}
    assert {z for pair in zip(base[:60], close, strict=True) if pair[0] != pair[1] for z in pair} <= kept
    assert len(kept) < len({*base[:60], *close}) + 2 * len(alike)


def test_thresholds_sum_as_the_pigeonhole_needs():
    both = np.full((64, 64), 0.25)
    np.fill_diagonal(both, 0.5)
    small, large = S.allot(10**5, both), S.allot(10**10, both)
    for plan in (small, large):
        assert sum(plan.thresholds) == 2 - len(plan.partitions) + 1
        assert sorted(b for p in plan.partitions for b in p) == list(range(64))
    assert len(large.partitions) <= len(small.partitions)


def test_deduplicated_keeps_clashing_columns(spark):
    rows = [(1, "a b c", 5, 6, 7), (2, "a b c", 5, 6, 7), (3, "x y z", 5, 6, 7), (3, "x y z", 5, 6, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int, _Row int, again int")
    for kept in (S.deduplicated(docs), nearcopies.deduplicated(docs)):
        assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == [rows[0], rows[2]]
