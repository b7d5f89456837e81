"""The pipeline against its stages done plainly in Python."""

import re

import numpy as np

import corpus_pipeline
from logsieve.llm import minhash, mixing, quality
from logsieve.llm.common import LOWER, materialize

TABLES = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    columns = docs.columns
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(materialize(stage(spark, steps[-1], TABLES), "test-stage"))
    assert all(s.columns == columns for s in steps[1:-1])
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "MinHash near-dedup", "benchmark decontamination", "mixing sources to target weights", "token-ID / binary output",
    ]
    rows = [{r.doc_id: r for r in s.collect()} for s in steps[:-1]]

    labels = spark.read.parquet(f"{TABLES}/labels.parquet")
    scores = {r.doc_id: r.score for r in quality.report(docs, labels).collect()}
    assert set(rows[1]) == {i for i in rows[0] if scores[i] >= 0.3}

    sets = {}
    for i, r in rows[1].items():
        w = r.text.encode().translate(LOWER).split()
        k = min(5, len(w))
        sets[i] = frozenset(tuple(w[a : a + k]) for a in range(len(w) - k + 1)) if k else frozenset()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    assert set(rows[2]) == {i for i in sets if root(i) == i}

    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows = set()
    for r in spark.read.parquet(f"{TABLES}/benchmark.parquet").collect():
        w = pattern.findall(r.text.lower())
        k = min(13, len(w))
        windows |= {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if k else set()
    clean = set()
    for i, r in rows[2].items():
        w = pattern.findall(r.text.lower())
        hit = np.zeros(len(w), dtype=bool)
        for k in {len(x) for x in windows}:
            for a in range(len(w) - k + 1):
                if tuple(w[a : a + k]) in windows:
                    hit[a : a + k] = True
        if not (hit.any() and 20 * hit.sum() >= len(w)):
            clean.add(i)
    assert set(rows[3]) == clean

    copies = {r.doc_id: r.copies for r in mixing.assign(steps[3]).collect()}
    counted = {r.doc_id: r["count"] for r in steps[4].groupBy("doc_id").count().collect()}
    assert counted == {i: n for i, n in copies.items() if n}

    slots = sorted(r.slot for r in steps[5].collect())
    assert slots == list(range(len(slots)))


def test_run(spark):
    found = corpus_pipeline.run(spark, TABLES).collect()
    assert sorted(r.slot for r in found) == list(range(len(found)))
    assert corpus_pipeline.ORACLE_SQL is None


def test_keep_first_takes_null_and_repeated_ids(spark):
    """Of each component one row stays, by what its rows hold and not by id alone."""
    words = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcdef"]
    near = words[0].replace("a59", "other")
    rows = [
        (5, near, 1), (3, words[0], 2), (None, near + " more", 3), (None, words[1], 4), (None, words[2], 5), (None, words[2], 6),
        (7, words[3], 7), (7, words[4], 8), (7, words[4].upper(), 9), (None, words[5], 10), (9, words[5], 11),
        (None, "", 12), (None, None, 13), (7, " \t\x0b\x0c\r\n", 14), (7, "", 15), (3, "a b", 16),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, at int")
    found = minhash.keep_first(docs)
    assert found.columns == docs.columns
    at = sorted(r["at"] for r in found.collect())
    assert at in [sorted([2, 4, c, 7, d, 11, 12, 13, 14, 15, 16]) for c in (5, 6) for d in (8, 9)]
