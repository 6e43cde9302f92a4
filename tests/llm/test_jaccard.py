import random
import re
from collections import defaultdict

import numpy as np
from helpers import awkward, documents, sentence

from tideglass.llm import jaccard
from tideglass.llm.groups import connected_components


def brute(rows, n=5, threshold=0.8):
    def grams(t):
        w = re.findall(r"(?:[0-9a-z]|[^\x00-\x7f])+", (t or "").lower())
        return {tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, 1 if w else 0))}

    sets = [grams(t) for _, t in rows]
    links = defaultdict(set)
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9:
                links[i].add(j)
                links[j].add(i)
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], min(ids) if ids else None, len(links[i])))
    return sorted(out, key=repr)


def family(rng, size):
    """Texts that differ from their neighbours by a word or two, so similarities lie around the threshold."""
    base, out = sentence(rng, 80).split(), []
    for _ in range(size):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = sentence(rng, 1)
        out.append(" ".join(w))
    return out


def test_awkward_rows_match_brute_force(spark):
    rows = awkward(random.Random(4))
    got = jaccard.join(documents(spark, rows))
    assert got.columns == ["doc_id", "class_id", "n_links"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_families_in_small_blocks_match_brute_force(spark):
    rng = random.Random(9)
    texts = family(rng, 60) + family(rng, 25) + [sentence(rng, 60) for _ in range(40)]
    rows = list(enumerate(texts + texts[:7]))
    got = jaccard.join(documents(spark, rows), block=16, text_block=8)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_prefixes_are_shortened_until_the_target(spark):
    rng = random.Random(5)
    rows = list(enumerate(family(rng, 30)))
    few = jaccard.join(documents(spark, rows), trees=4, longest=7, target=0.999, threshold=0.7)
    assert sorted(map(tuple, few.collect()), key=repr) == brute(rows, threshold=0.7)
    assert jaccard.met(0.8, 7, 32) > 0.999 and jaccard.met(0.8, 1, 4) > 0.998


def test_one_row_of_each_component_stays(spark):
    rows = awkward(random.Random(4))
    kept = jaccard.deduplicate(documents(spark, rows))
    assert kept.columns == documents(spark, rows).columns
    ids = [r.doc_id for r in kept.collect()]
    assert set(ids) >= {1, 5, 6, 7, 8, 9, 11, 12, 14} and not {2, 3, 4, 10} & set(ids) and len(ids) == 14


def test_empty_table(spark):
    assert jaccard.join(documents(spark, [])).count() == 0
    assert jaccard.deduplicate(documents(spark, [(1, None)])).count() == 1


def test_minima_estimate_similarity():
    flat = np.random.default_rng(1).integers(0, 2**63, 9000, dtype=np.uint64)
    both = np.concatenate((flat[:8000], flat[1000:9000]))
    low = jaccard.minima(both, np.array([0, 8000, 16000]), 512)
    assert abs((low[0] == low[1]).mean() - 7 / 9) < 0.08


def test_components_of_many_shapes(spark):
    rng = random.Random(3)
    path = [(i, i + 1) for i in range(200)]
    zipper = [(1000 + i, 1002 + i) for i in range(100)] + [(1100, 1101)]
    hub = [(5000, i) for i in range(4000, 4300)]
    loose = [(9000 + rng.randrange(80), 9000 + rng.randrange(80)) for _ in range(50)]
    edges = path + zipper + hub + loose + loose[:9] + [(7, 7), (12345, 12345), (None, 3), (3, None)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {n: n for e in edges if None not in e and e[0] != e[1] for n in e}
    while True:
        was = dict(root)
        for a, b in edges:
            if a in root and b in root:
                root[a] = root[b] = min(root[a], root[b])
        if root == was:
            break
    assert got == root
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
