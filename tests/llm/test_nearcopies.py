"""Near copies by shingles against all pairs in plain Python."""

import random

from conftest import ODD, documents

from voltspan.llm import nearcopies as N


def sets_of(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def pairs_of(rows, similarity=0.8):
    sets = [(k, sets_of(t)) for k, t, *_ in rows]
    return {(i, j) for i, (_, a) in enumerate(sets) for j, (_, b) in enumerate(sets[:i]) if len(a & b) >= similarity * len(a | b)}


def edited(seed=7):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts = []
    for _ in range(60):
        base = [word() for _ in range(rng.randint(4, 160))]
        for _ in range(rng.randint(1, 5)):
            copy = list(base)
            for _ in range(rng.randint(0, 1 + len(copy) // 60)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    return texts


def test_like_all_pairs(spark, write):
    rows = [*documents(edited()), *((k if k is None else k + 1000, *r) for k, *r in ODD)]
    got = N.near_copies(spark.read.parquet(f"{write('documents', rows)}/documents.parquet"), "doc_id", "text").collect()
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in pairs_of(rows):
        parent[top(i)] = top(j)
    groups = {}
    for i, (k, *_) in enumerate(rows):
        groups.setdefault(top(i), []).append(k)
    want = sorted(((k, min((x for x in g if x is not None), default=None)) for g in groups.values() for k in g), key=str)
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == want


def test_stage_drops_copies_with_a_few_changed_words(spark):
    import corpus_pipeline as P

    rng = random.Random(11)
    texts = []
    for _ in range(30):
        base = [f"w{rng.randrange(5000)}" for _ in range(120)]
        copy = list(base)
        copy[20] = copy[70] = "changed"  # 10 of 116 shingles: similarity 106 / 126
        texts += [" ".join(base), " ".join(copy)]
    docs = spark.createDataFrame(documents(texts), "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in P.near_dedup(spark, docs, "").collect()) == list(range(0, 60, 2))


def test_width_and_similarity_are_parameters(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "a b c d e f g h i k")], "doc_id long, text string")
    assert [N.deduplicated(docs, width=w, similarity=s).count() for w, s in ((5, 0.8), (1, 0.8), (5, 0.7))] == [2, 1, 1]


def test_stage_links_by_simhash_too(spark):
    """Two texts within 2 bits whose shingles have little in common, and a third that is a near copy of one of them: the stage only had the shingles' links."""
    import corpus_pipeline as P
    from voltspan.llm.simhash import fingerprint

    # one long run of a word decides the bits; what is around it differs
    a, b = " ".join(["same"] * 400 + [f"x{i}" for i in range(8)]), " ".join(["same"] * 400 + [f"y{i}" for i in range(8)])
    assert bin((fingerprint(a) ^ fingerprint(b)) & (2**64 - 1)).count("1") <= 2 and len(sets_of(a) & sets_of(b)) < 0.8 * len(sets_of(a) | sets_of(b))
    rows = documents([f"{' '.join(f'alone{i}w{j}' for j in range(30))}" for i in range(20)] + [a, b])
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in P.near_dedup(spark, docs, "").collect()) == list(range(21))
    assert N.deduplicated(docs).count() == 22


def test_components_of_two_searches_together(spark):
    schema = "doc_id long, row long, fp long, component_id long"
    one = spark.createDataFrame([(1, 11, 0, 1), (2, 12, 0, 1), (3, 13, 0, 3), (4, 14, 0, 4), (None, 15, 5, 4), (None, 16, 6, None), (9, 17, 7, 9)], schema)
    other = spark.createDataFrame([(1, 11, 0, 1), (2, 12, 0, 2), (3, 13, 0, 2), (4, 14, 0, 4), (None, 15, 0, 3), (None, 16, 0, None), (9, 17, 0, 9)], schema)
    got = {r.row: (r.doc_id, r.component_id) for r in N.united(one, other, "doc_id").collect()}
    assert got == {11: (1, 1), 12: (2, 1), 13: (3, 1), 14: (4, 1), 15: (None, 1), 16: (None, None), 17: (9, 9)}


def test_both_searches_in_one_as_two_united(spark, write):
    """Links of SimHash and of shingles in one search for components, with no more jobs than twice those of one (before, a search for each and a third for both)."""
    from voltspan.llm.simhash import near_duplicates

    same = ["a b c d e f g a b c d e f g", "a b c d e f g a b c d e f g a b c d e f g"]  # equal sets of five-word shingles
    rows = [*documents([*edited(), *same, *["same " * n + " ".join(f"{x}{i}" for i in range(8)) for n, x in ((400, "x"), (400, "y"), (390, "y"))]]), *((k if k is None else k + 1000, *r) for k, *r in ODD)]
    docs, context = spark.read.parquet(f"{write('documents', rows)}/documents.parquet"), spark.sparkContext
    jobs = {}

    def found(name, search):
        context.setJobGroup(name, name)
        out = search().dropDuplicates(["row"]).collect()
        jobs[name] = len(context.statusTracker().getJobIdsForGroup(name))
        context.setLocalProperty("spark.jobGroup.id", None)
        return {r.row: (r.doc_id, r.component_id) for r in out}

    got = found("one", lambda: N.copies_by_both(docs, "doc_id", "text"))
    assert got == found("two", lambda: N.united(near_duplicates(docs, "doc_id", "text"), N.near_copies(docs, "doc_id", "text"), "doc_id"))
    assert len({c for _, c in got.values()}) < len({c for _, c in found("sets", lambda: N.near_copies(docs, "doc_id", "text")).values()})
    assert jobs["one"] < 0.67 * jobs["two"], jobs
