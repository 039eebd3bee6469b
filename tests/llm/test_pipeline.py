"""The corpus pipeline, stage by stage, against what each stage should keep; and the guard that lets it be left out."""

import os
import random
import shutil
import subprocess
import sys

import pyarrow as pa
from conftest import ODD
from test_packing import check
from test_tasks import SECRET
from test_simhash import brute

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
EN = "the of and to in is that it for was with as be on this are house water stone light river metal".split()
FR = "de la le et les des en un du une que est pour qui dans sur maison pierre chaud fleuve lampe".split()


def corpus():
    rng = random.Random(9)
    text = lambda own, n: " ".join(rng.choice(own) + rng.choice(["", "", "s", "ly"]) for _ in range(n))
    rows = [(i, text((EN, FR)[i % 2], 60), ("en", "fr")[i % 2], "a", None) for i in range(120)]
    passage = text(EN, 30)
    rows += [(200, rows[4][1], "en", "a", 1), (201, rows[4][1] + " ", "en", "b", 1), (202, f"{text(EN, 40)} {passage} {text(EN, 20)}", "en", "a", 1), (203, f"{text(EN, 50)} {SECRET} {text(EN, 10)}", "en", "a", 7)]
    return rows + [(k if k is None else k + 500, *r) for k, *r in ODD], passage


def test_stages(spark, write):
    import corpus_pipeline as P

    rows, passage = corpus()
    sf = write("documents", rows)
    write("benchmark", [(1, passage), (2, None)], pa.schema([("item_id", pa.int64()), ("text", pa.string())]))
    assert [n for n, _ in P.STAGES] == ["language", "near_dedup", "decontaminate", "secrets", "packing"]
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in P.STAGES:
        before = [tuple(r) for r in docs.collect()]
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), stage(spark, docs, sf).schema)
        seen[name] = (before, docs.collect())
    before, after = seen["language"]
    kept = {tuple(r) for r in after}
    assert kept <= set(before) and not any(r[1] is None or not any(c.isalpha() for c in r[1]) for r in kept)
    assert {r for r in before if r[0] is not None and r[0] < 300} <= kept  # clean documents stay
    before, after = seen["near_dedup"]
    groups = {k: c for k, _, c in brute(before)}
    assert sorted(r.doc_id for r in after if r.doc_id is not None) == sorted({c for c in groups.values() if c is not None})
    before, after = seen["decontaminate"]
    assert {r[0] for r in before} - {r.doc_id for r in after} == {202}
    before, after = seen["secrets"]
    texts = {r.doc_id: r.text for r in after}
    assert SECRET not in texts[203] and all(texts[r[0]] == r[1] for r in before if r[0] != 203)
    before, after = seen["packing"]
    check(before, after)


def test_run(spark, write):
    import corpus_pipeline as P

    sf = write("documents", corpus()[0])
    write("benchmark", [], pa.schema([("item_id", pa.int64()), ("text", pa.string())]))
    assert P.run(spark, sf).count() > 100
    sf = write("documents", [], folder="none")
    write("benchmark", [], pa.schema([("item_id", pa.int64()), ("text", pa.string())]), folder="none")
    assert P.run(spark, sf).count() == 0


def test_the_rest_imports_without_the_operators(tmp_path):
    shutil.copytree(REPO, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') for n in e.queries()))"], cwd=tmp_path / "r", capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path / "r")})
    assert said.stdout.split()[1:] == ["False"], said.stderr
