"""Lattice likelihood, quality and toxicity."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from helpers import awkward, documents, sentence
from pyspark.sql import functions as F

from tideglass.llm import lattice, quality, toxicity

VOCAB = public_tokenizers.path("piece_bpe_32k.model")


def by_recursion(word, logs, spell, memo=None):
    """Sum over all segmentations, by plain recursion in probabilities."""
    if not word:
        return 1.0
    total = spell(word[0]) * by_recursion(word[1:], logs, spell)
    for n in range(1, len(word) + 1):
        if word[:n] in logs:
            total += math.exp(logs[word[:n]]) * by_recursion(word[n:], logs, spell)
    return total


def test_forward_recursion_sums_all_segmentations():
    pieces, byte_ids, prior = lattice.vocabulary(VOCAB)
    logp = np.log(np.where(prior > 0, prior, 1))
    lat = lattice.Lattice(pieces, byte_ids, logp)
    words = ["a", "the", "thand", "ther", "étre", "日本", "q" * 9]
    got, counts = lat.run(words, np.ones(len(words)))
    logs = {p: logp[i] for i, p in enumerate(pieces) if p}

    def spell(c):
        return math.exp(sum(logp[byte_ids[b]] for b in c.encode()))

    for w, g in zip(words, got, strict=True):
        assert g == pytest.approx(math.log(by_recursion(lattice.MARK + w, logs, spell)), rel=1e-9)
    # each character is covered once: expected characters of pieces and of spelled bytes add up to the words' length
    chars = sum(counts[i] * len(p) for i, p in enumerate(pieces) if p)
    spelled = sum(counts[byte_ids[b]] / (1 if b < 0x80 else 3) for b in range(256) if b < 0x80 or b >= 0xE0 or b >= 0x80)
    assert chars <= sum(len(w) + 1 for w in words) + 1e-6 and spelled >= 0


def test_scores_match_brute_force(spark):
    rows = [r for r in awkward(random.Random(1)) if r[0] != 12] + [(i, sentence(random.Random(i), 30)) for i in range(20, 60)]
    got = lattice.score(documents(spark, rows), VOCAB, head=20).collect()
    assert len(got) == len(rows)

    def parts(t):
        return (t or "").encode().lower().split()

    def learn(i):
        return zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2

    train = Counter(w for i, t in rows if learn(i) for w in [*parts(t), None])
    total, distinct = sum(train.values()), len(train)
    expected = []
    for i, t in rows:
        tokens = [*parts(t), None]
        expected.append((i, not learn(i), len(tokens), sum(train[w] > 0 for w in tokens), total, round(sum(math.log10((train[w] + 1) / (total + distinct + 1)) for w in tokens), 6)))
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=repr) == sorted(expected, key=repr)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    empty = {r.score for r in got if r.n_tokens == 1}
    assert len(empty) == 1
    again = {(r.doc_id, round(r.score, 6)) for r in lattice.score(documents(spark, rows), VOCAB, head=10_000).collect()}
    assert again == {(r.doc_id, round(r.score, 6)) for r in got}


def test_word_probabilities_do_not_exceed_one():
    pieces, byte_ids, prior = lattice.vocabulary(VOCAB)
    lat = lattice.Lattice(pieces, byte_ids, np.log(np.where(prior > 0, prior, 1)))
    assert np.logaddexp.reduce(lat.run([chr(97 + i) + chr(97 + j) for i in range(26) for j in range(26)])[0]) < 0


def test_lattice_without_training_rows(spark):
    assert lattice.score(documents(spark, []), VOCAB).count() == 0
    alone = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][0]
    [r] = lattice.score(documents(spark, [(alone, "the word")]), VOCAB).collect()
    assert (r.held_out, r.n_known, r.train_tokens) == (True, 0, 0) and r.score < 0


def labelled(spark, n=400):
    rng = random.Random(7)
    rows, marks = [], []
    for i in range(n):
        bad, toxic = i % 4 == 0, i % 5 == 0
        text = " ".join(w + "***" for w in sentence(rng, 30).split()) if bad else sentence(rng, 30)
        rows.append((i, text + (" you worthless moron" if toxic else "")))
        marks.append((i, int(not bad), int(toxic)))
    labels = spark.createDataFrame([*marks, (3, None, 1), (None, 1, 0), (10_000, 1, 1)], "doc_id long, quality int, toxic int")
    return rows + awkward(rng), labels


def test_quality_is_learnt_and_held_out(spark):
    rows, labels = labelled(spark)
    got = quality.classify(documents(spark, rows), labels).collect()
    assert len(got) == len(rows)
    fold = [r for r in got if r.held_out and r.doc_id is not None and 15 < r.doc_id < 400]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in fold)
    assert np.mean([r.predicted == int(r.doc_id % 4 != 0) for r in fold]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert len({r.score for r in got if r.doc_id in (6, 7)}) >= 1


def test_quality_ignores_labels_of_the_held_out_fold(spark):
    rows, labels = labelled(spark)
    fold = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0
    turned = labels.withColumn("quality", F.when(fold, 1 - F.col("quality")).otherwise(F.col("quality")))
    docs = documents(spark, rows)
    assert sorted(map(str, quality.classify(docs, labels).collect())) == sorted(map(str, quality.classify(docs, turned).collect()))


def test_models_without_labels(spark):
    docs = documents(spark, [(1, "a"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.classify(docs, none).collect()} == {0.5}
    assert {r.p_toxic for r in toxicity.detect(docs, none.withColumn("low_quality", F.lit(1))).collect()} == {0.5}
    assert quality.classify(documents(spark, []), none).count() == 0


def test_toxicity_chain(spark):
    rows, labels = labelled(spark)
    marks = labels.withColumn("low_quality", 1 - F.col("quality"))
    got = toxicity.detect(documents(spark, rows), marks, sample=250).collect()
    seen = [r for r in got if r.doc_id is not None and 16 <= r.doc_id < 400]
    assert np.mean([r.is_toxic == int(r.doc_id % 5 == 0) for r in seen]) > 0.97
    chain = toxicity.train(documents(spark, rows), marks, ["low_quality", "toxic"])
    assert [len(m.extra) for m in chain.models] == [0, 1]
