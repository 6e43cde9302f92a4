"""How far the search of similar documents shortens its prefixes."""

import inspect
import random

import numpy as np
from helpers import documents, sentence
from test_jaccard import brute, family

from tideglass.llm import jaccard

GIVEN = {k: p.default for k, p in inspect.signature(jaccard.join).parameters.items() if p.default is not p.empty}


def shortest():
    """The longest prefix that meets a lone pair at the threshold as often as asked."""
    return next(d for d in range(GIVEN["longest"], 0, -1) if jaccard.met(GIVEN["threshold"], d, GIVEN["trees"]) >= GIVEN["target"])


def test_given_parameters_shorten_until_a_lone_pair_is_met(spark):
    rng = random.Random(6)
    docs = documents(spark, list(enumerate(family(rng, 12) + [sentence(rng, 60) for _ in range(10)])))
    found = jaccard.search(docs)
    assert found.depth == shortest() < GIVEN["longest"] and found.recall >= GIVEN["target"]
    assert len(found.recalls) == GIVEN["longest"] - found.depth + 1 and all(r < GIVEN["target"] for r in found.recalls[:-1])
    assert jaccard.search(docs, threshold=0.99).depth == GIVEN["longest"]


def test_audit_counts_pairs_in_different_families(spark):
    base = np.arange(224, dtype="<u2")
    rows = []
    for i in range(10):
        sig = base.copy()
        sig[: 10 * (i % 4)] += 7
        rows.append((i, sig.tobytes()))
    rows.append((99, (base + 1000).tobytes()))
    classes = spark.createDataFrame(rows, "cid long, sig binary")

    def audited(roots):
        return jaccard.audit(classes, spark.createDataFrame(roots, "node long, root long"), 0.8, 50)

    whole = audited([(i, 0) for i in range(10)])
    like = sum(((np.frombuffer(a, "<u2") == np.frombuffer(b, "<u2")).mean() >= 0.8) for i, a in rows for j, b in rows if i != j)
    assert whole == (like, like)
    pairs, hit = audited([(i, 0) for i in range(5)] + [(i, 5) for i in range(5, 10)])
    assert pairs == like and 0 < hit < like
    assert audited([])[1] == 0


def test_an_audit_that_fails_shortens_further(spark, monkeypatch):
    told = iter([(10, 9), (10, 10)])
    monkeypatch.setattr(jaccard, "audit", lambda *_: next(told))
    rows = list(enumerate(family(random.Random(7), 15)))
    found = jaccard.search(documents(spark, rows))
    assert found.depth == shortest() - 1 and found.recalls[-2] == 0.9 and found.recall >= GIVEN["target"]


def test_few_trees_are_shortened_by_the_data(spark):
    rows = list(enumerate(family(random.Random(8), 30)))
    found = jaccard.search(documents(spark, rows), trees=6, target=0.999)
    assert found.depth < 5 and found.recall >= 0.999
    got = jaccard.join(documents(spark, rows), trees=6, target=0.999)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)
