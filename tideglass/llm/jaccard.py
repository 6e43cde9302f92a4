"""N-gram Jaccard join by a MinHash LSH forest, with exact verification.

Words are those of ``words``; a text's set is its word 5-grams (a shorter text has one, of all its
words). The forest has ``trees`` sorted prefix tries; a trie holds each set's minima under
``longest`` hash functions in order, a node of it is the run of paths that share a prefix, and sets in one node
are neighbours. The join starts with prefixes of all ``longest`` functions and shortens them one function at a time until the
recall reaches ``target``, by three measures: a link of similarity s is met with probability 1 - (1 - s^depth)^trees, so
each verified link stands for 1 / that many, and the links found over those they stand for must reach it; so must that
probability for a lone pair at the threshold, whatever other links there are; and so must an audit: the sketches of
``audited`` classes, half of them with neighbours, are compared with those of all classes, and of the pairs that
reach the threshold those count as met whose classes are in one family.

Steps: (1) minima per text, texts with equal words collapse to one class; (2) classes in one node
are compared by the low 16 bits of all their minima, in blocks of bounded size, and joined into families
wherever these may allow the threshold; at a shorter prefix only classes under different children of the node
are, since the others have met; (3) within families all pairs of classes are verified by
exact Jaccard similarity of their 64-bit n-gram fingerprints, again in blocks; at a shorter prefix only
families that have grown are. Only spanning edges and per-class counts leave a task, never lists of pairs. A
family of n classes costs n x ceil(n / ``text_block``) rows with their texts.

Defined cases: a text without words (null, empty, punctuation) has no n-grams, is similar to nothing and
stands alone with 0 links; repeated rows are copies and link to each other; a class is named by its
smallest non-null id; an empty table gives an empty result; other columns of the input, whatever their names,
are ignored by ``join`` and kept by ``deduplicate``; of rows equal in id and text it keeps any one.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import materialise
from .columns import fresh
from .groups import block_pairs, connected_components, local_roots, star_edges, whole_groups
from .words import WordStream, chunks, encode, grams, slices

TREES, LONGEST = 32, 7
#: Standard errors below the threshold at which two sketches still count as similar.
MARGIN = 5.5
THRESHOLD, TARGET = 0.8, 0.9999
#: Rows of a block where sketches (small) and where texts are compared.
BLOCK, TEXT_BLOCK = 4096, 128
#: Classes whose sketches are compared with all others after each prefix.
AUDITED = 128


def minima(flat: np.ndarray, offsets: np.ndarray, count: int, seed: int = 11) -> np.ndarray:
    """(texts, count) uint32: the least of each text's n-grams under each hash function."""
    rng = np.random.default_rng(seed)
    mul = rng.integers(0, 2**32, count, dtype=np.uint32) | np.uint32(1)
    add = rng.integers(0, 2**32, count, dtype=np.uint32)
    small = (flat >> np.uint64(32)).astype(np.uint32)
    out = np.full((len(offsets) - 1, count), np.uint32(0xFFFFFFFF))
    has = np.flatnonzero(np.diff(offsets))
    first = offsets[has]
    for at in range(0, len(small), 4096):
        part = small[at : at + 4096]
        lo, hi = np.searchsorted(first, at, "right") - 1, np.searchsorted(first, at + len(part), "left")
        inside = np.maximum(first[lo:hi] - at, 0)
        values = part[None, :] * mul[:, None]
        values += add[:, None]
        values ^= values >> np.uint32(15)
        least = np.minimum.reduceat(values, inside, axis=1).T
        out[has[lo:hi]] = np.minimum(out[has[lo:hi]], least)
    return out


def _signed(batches: Iterator[pa.RecordBatch], n: int, count: int) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        texts = b.column("text").to_pylist()
        h1, h2, size, sig = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), [b""] * len(texts)
        for at, held in chunks(texts):
            s = WordStream([encode(t) for t in held])
            flat, offsets = grams(s.hashes, s.offsets, n)
            low = minima(flat, offsets, count)
            lens = np.diff(s.offsets)
            weight = np.arange(len(s.hashes), dtype=np.uint64) - np.repeat(s.offsets[:-1], lens).astype(np.uint64)
            for out, salt in ((h1, 0x9E3779B97F4A7C15), (h2, 0xC2B2AE3D27D4EB4F)):
                place = weight * np.uint64(salt) + np.uint64(salt)
                total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((s.hashes ^ place) * (place | np.uint64(1)), dtype=np.uint64)))
                out[at : at + len(held)] = (total[s.offsets[1:]] - total[s.offsets[:-1]] + lens.astype(np.uint64)).view(np.int64)
            size[at : at + len(held)] = np.diff(offsets)
            for i in range(len(held)):
                sig[at + i] = low[i].astype("<u2").tobytes()
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "r1", "r2")), pa.array(h1), pa.array(h2), pa.array(size), pa.array(sig, pa.binary())], ["doc_id", "r1", "r2", "h1", "h2", "n_grams", "sig"])


def _with_row_keys(docs: DataFrame) -> DataFrame:
    """A 128-bit key of (id, text): equal rows share it."""
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("r1"), F.xxhash64("text", F.lit(7), "doc_id").alias("r2"))


def _family_edges(batches: Iterator[pa.RecordBatch], cut: float) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) that span what the sketches join inside each node and pair of blocks; rows come by path, so a
    node's children are runs, and two rows under one child have met before."""
    for table, starts in whole_groups(batches, ("label", "_bi", "_bj")):
        group = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        cid = table.column("cid").to_numpy()
        own = table.column("_own").to_numpy()
        cross = (table.column("_bi").to_numpy() != table.column("_bj").to_numpy())
        child = table.column("child").to_numpy()
        sketch = np.frombuffer(b"".join(table.column("sig").to_pylist()), "<u2").reshape(len(cid), -1)
        left, right = [], []
        i = np.arange(len(cid))
        for d in range(1, int(np.diff(starts).max())):
            i = i[: np.searchsorted(i, len(cid) - d)]
            i = i[group[i] == group[i + d]]
            pair = i[(~cross[i] | (own[i] != own[i + d])) & (child[i] != child[i + d])]
            for at in range(0, len(pair), 1 << 15):
                p = pair[at : at + (1 << 15)]
                hit = p[(sketch[p] == sketch[p + d]).mean(1) >= cut]
                left.append(hit)
                right.append(hit + d)
        a, b = np.concatenate([np.zeros(0, np.int64), *left]), np.concatenate([np.zeros(0, np.int64), *right])
        a, b = star_edges(cid, local_roots(len(cid), a, b))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def similarities(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(shared n-grams of each pair of texts, distinct n-grams of each text)."""
    s = WordStream([encode(t) for t in texts])
    flat, offsets = grams(s.hashes, s.offsets, n)
    doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
    order = np.lexsort((doc, flat))
    flat, doc = flat[order], doc[order]
    keep = np.ones(len(flat), bool)
    keep[1:] = (flat[1:] != flat[:-1]) | (doc[1:] != doc[:-1])
    flat, doc = flat[keep], doc[keep]
    sizes = np.bincount(doc, minlength=len(texts))
    number = np.cumsum(np.concatenate(([0], flat[1:] != flat[:-1]))) if len(flat) else np.zeros(0, np.int64)
    held = np.bincount(number) if len(number) else np.zeros(0, np.int64)
    common = np.flatnonzero(held >= 2)
    column = np.full(len(held), -1)
    column[common] = np.arange(len(common))
    at = column[number] if len(number) else number
    doc, at = doc[at >= 0], at[at >= 0]
    shared = np.zeros((len(texts), len(texts)), np.float32)
    for lo in range(0, len(common), 8192):
        part = (at >= lo) & (at < lo + 8192)
        x = np.zeros((len(texts), min(8192, len(common) - lo)), np.float32)
        x[doc[part], at[part] - lo] = 1
        shared += x @ x.T
    return shared, sizes


def met(similarity: np.ndarray | float, depth: int, trees: int) -> np.ndarray | float:
    """The probability that a pair shares a prefix of ``depth`` in at least one of ``trees`` tries."""
    return 1 - (1 - np.asarray(similarity, float) ** depth) ** trees


def audit(classes: DataFrame, family: DataFrame, threshold: float, size: int) -> tuple[int, int]:
    """(pairs of a sampled and any other class whose sketches reach the threshold, those of them in one family). ``classes``: cid, sig;
    ``family``: node, root. The sample has at most ``size`` classes, those of least hash, half of them with neighbours if there are."""
    held = classes.select("cid", "sig").join(family.select(F.col("node").alias("cid"), "root"), "cid", "left")
    order = (F.xxhash64("cid"), F.col("cid"))
    near = held.filter("root IS NOT NULL").orderBy(*order).limit(size // 2)
    sample = near.unionByName(held.filter("root IS NULL").orderBy(*order).limit(size - size // 2)).collect()
    if not sample:
        return 0, 0
    chosen = [(r["cid"], -1 if r["root"] is None else r["root"], np.frombuffer(r["sig"], "<u2")) for r in sample]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = met_ = 0
        for b in slices(batches):
            sketch = np.frombuffer(b"".join(b.column("sig").to_pylist()), "<u2").reshape(b.num_rows, -1)
            cid, root = b.column("cid").to_numpy(), b.column("root").fill_null(-2).to_numpy()
            for own, family_, sig in chosen:
                like = ((sketch == sig).mean(1) >= threshold) & (cid != own)
                pairs += int(like.sum())
                met_ += int((like & (root == family_)).sum())
        yield pa.RecordBatch.from_arrays([pa.array([pairs]), pa.array([met_])], ["pairs", "met"])

    sums = held.mapInArrow(compare, "pairs long, met long").agg(F.sum("pairs"), F.sum("met")).first()
    return sums[0] or 0, sums[1] or 0


def _verified(batches: Iterator[pa.RecordBatch], n: int, threshold: float, depths: int, trees: int) -> Iterator[pa.RecordBatch]:
    """Per class and pair of blocks: the copies it links to, a spanning edge, the links found, and how many they stand
    for at each prefix length from 1 to ``depths``."""
    lengths = np.arange(1, depths + 1)
    for table, starts in whole_groups(batches, ("family", "_bi", "_bj"), rows=256):
        cid, copies, own = (table.column(c).to_numpy() for c in ("cid", "copies", "_own"))
        bi, bj = table.column("_bi").to_numpy(), table.column("_bj").to_numpy()
        root, links = cid.copy(), np.zeros(len(cid), np.int64)
        found, stands = np.zeros(len(cid)), np.zeros((len(cid), depths))
        for lo, hi in zip(starts[:-1], starts[1:], strict=True):
            if hi - lo < 2:
                continue
            shared, sizes = similarities(table.column("text").slice(lo, hi - lo).to_pylist(), n)
            union = sizes[:, None] + sizes[None, :] - shared
            linked = shared >= threshold * union - 1e-9
            np.fill_diagonal(linked, False)
            if bi[lo] != bj[lo]:
                linked &= own[lo:hi, None] != own[None, lo:hi]
            links[lo:hi] = linked @ copies[lo:hi]
            a, b = np.nonzero(np.triu(linked))
            local = local_roots(hi - lo, a, b)
            least = cid[lo:hi].copy()
            np.minimum.at(least, local, cid[lo:hi])
            root[lo:hi] = least[local]
            np.add.at(found[lo:hi], a, 1)
            likeness, number = np.unique(shared[a, b] / union[a, b], return_inverse=True)
            np.add.at(stands[lo:hi], a, (1 / met(likeness[:, None], lengths, trees))[number])
        yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in (cid, root, links, found)), pa.array(list(stands), pa.list_(pa.float64()))], ["a", "b", "links", "found", "stands"])


@dataclass(frozen=True)
class Found:
    """rows: per row of the input doc_id, r1, r2, n_grams and, if it has n-grams, _root (its component), _class and _n;
    depth: the shortest prefix searched; recall: the least of the three measures there; recalls: it at each prefix from the longest on."""

    rows: DataFrame
    depth: int
    recall: float
    recalls: tuple[float, ...]


def search(docs: DataFrame, *, n: int = 5, threshold: float = THRESHOLD, target: float = TARGET, trees: int = TREES, longest: int = LONGEST, block: int = BLOCK, text_block: int = TEXT_BLOCK, audited: int = AUDITED) -> Found:
    """The classes of ``docs``, and the recall that was reached; a warning tells if even prefixes of one function
    leave it below ``target`` (more ``trees`` then help)."""
    count = trees * longest
    signed = materialise(_with_row_keys(docs).mapInArrow(lambda it: _signed(it, n, count), "doc_id long, r1 long, r2 long, h1 long, h2 long, n_grams long, sig binary"), "signed")
    classes = signed.filter("n_grams > 0").groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least_id"), F.min(F.struct("r1", "r2")).alias("_row"), F.first("sig").alias("sig"))
    classes = materialise(classes.select("h1", "h2", "copies", "least_id", "_row.r1", "_row.r2", "sig", F.monotonically_increasing_id().alias("cid")), "classes")
    cut = threshold - MARGIN * (threshold * (1 - threshold) / count) ** 0.5
    depth = longest
    family = known = verified = None
    recalls: list[float] = []

    def node(t: Column, length: int) -> Column:
        return F.xxhash64(t, F.substring(F.col("sig"), t * (2 * longest) + 1, F.lit(2 * length)))

    while True:
        nodes = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(node(t, depth).alias("label"), (F.col("cid") if depth == longest else node(t, depth + 1)).alias("child")))
        paths = classes.select("cid", F.explode(nodes).alias("_p")).select("cid", "_p.*")
        shared = paths.groupBy("label").agg(F.count(F.lit(1)).alias("_size"), F.min("child").alias("_a"), F.max("child").alias("_b")).filter("_a <> _b").drop("_a", "_b")
        meet = block_pairs(paths.join(shared, "label").join(classes.select("cid", "sig"), "cid"), F.col("_size"), F.xxhash64("cid"), block)
        meet = meet.select("label", "_bi", "_bj", "child", "_own", "cid", "sig").repartition("label", "_bi", "_bj").sortWithinPartitions("label", "_bi", "_bj", "child")
        edges = meet.mapInArrow(lambda it: _family_edges(it, cut), "a long, b long")
        family = connected_components(edges if family is None else edges.unionByName(family.select(F.col("node").alias("a"), F.col("root").alias("b"))))
        sizes = materialise(family.groupBy("root").agg(F.count(F.lit(1)).alias("_size")), "family-sizes")
        grown = sizes if known is None else sizes.join(known, ["root", "_size"], "left_anti")  # families only merge, and a root is the least member
        members = family.join(grown, "root").join(classes.select("cid", "copies", "r1", "r2"), family["node"] == F.col("cid")).select(F.col("root").alias("family"), "_size", "cid", "copies", "r1", "r2")
        texts = _with_row_keys(docs).drop("doc_id").join(members, ["r1", "r2"]).dropDuplicates(["cid"])
        pairs = block_pairs(texts.select("family", "_size", "cid", "copies", "text"), F.col("_size"), F.xxhash64("cid"), text_block)
        pairs = pairs.repartition("family", "_bi", "_bj").sortWithinPartitions("family", "_bi", "_bj")
        new = pairs.mapInArrow(lambda it: _verified(it, n, threshold, longest, trees), "a long, b long, links long, found double, stands array<double>")
        if verified is not None:
            new = new.unionByName(verified.join(family.join(grown, "root").select(F.col("node").alias("a")), "a", "left_anti"))
        verified, known = materialise(new, "links"), sizes
        sums = verified.agg(F.sum("found").alias("found"), F.sum(F.col("stands")[depth - 1]).alias("stands")).first()
        recall = min(sums["found"] / sums["stands"] if sums["found"] else 1.0, float(met(threshold, depth, trees)))
        if recall >= target:  # the audit costs most, so it comes last
            pairs, hit = audit(classes, family, threshold, audited)
            recall = min(recall, hit / pairs if pairs else 1.0)
        recalls.append(recall)
        if recall >= target or depth == 1:
            break
        depth -= 1
    if recall < target:
        warnings.warn(f"estimated recall {recall:.5f} is below {target} at prefixes of one function; more trees are needed", stacklevel=2)
    links = verified.groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("_links"))
    roots = connected_components(verified.select("a", "b"))
    named = roots.join(classes.select(F.col("cid").alias("node"), "least_id"), "node").groupBy("root").agg(F.min("least_id").alias("class_id"))
    of = roots.join(named, "root").select(F.col("node").alias("cid"), "root", "class_id")
    told = classes.select("h1", "h2", "cid", "copies", "least_id").join(of, "cid", "left").join(links, "cid", "left")
    told = told.select("h1", "h2", F.coalesce("root", "cid").alias("_root"), F.coalesce("class_id", "least_id").alias("_class"), (F.coalesce("_links", F.lit(0)) + F.col("copies") - 1).alias("_n"))
    return Found(signed.drop("sig").join(told, ["h1", "h2"], "left"), depth, recall, tuple(recalls))


def join(docs: DataFrame, *, n: int = 5, threshold: float = THRESHOLD, target: float = TARGET, trees: int = TREES, longest: int = LONGEST, block: int = BLOCK, text_block: int = TEXT_BLOCK) -> DataFrame:
    """doc_id, class_id, n_links: one row per row of ``docs``. n_links counts the other rows of
    similarity ``threshold`` or more; class_id is the smallest id that links lead to."""
    rows, worded = search(docs, n=n, threshold=threshold, target=target, trees=trees, longest=longest, block=block, text_block=text_block).rows, F.col("n_grams") > 0
    return rows.select("doc_id", F.when(worded, F.col("_class")).otherwise(F.col("doc_id")).alias("class_id"), F.when(worded, F.col("_n")).otherwise(F.lit(0)).cast("long").alias("n_links"))


def deduplicate(docs: DataFrame, *, n: int = 5, threshold: float = THRESHOLD, target: float = TARGET, trees: int = TREES, longest: int = LONGEST, block: int = BLOCK, text_block: int = TEXT_BLOCK) -> DataFrame:
    """The row of smallest id of each component, all columns kept, and all rows without words; rows equal
    in id and text count as one."""
    rows = search(docs, n=n, threshold=threshold, target=target, trees=trees, longest=longest, block=block, text_block=text_block).rows
    r1, r2 = fresh(docs, "_r1", "_r2")
    best = rows.filter("n_grams > 0").groupBy("_root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "r1", "r2")).alias("_best")).select("_best.r1", "_best.r2")
    kept = materialise(best.unionByName(rows.filter("n_grams = 0").select("r1", "r2").distinct()).select(F.col("r1").alias(r1), F.col("r2").alias(r2)), "kept")
    keyed = docs.withColumns({r1: F.xxhash64("doc_id", "text"), r2: F.xxhash64("text", F.lit(7), "doc_id")})
    return keyed.join(kept, [r1, r2], "left_semi").dropDuplicates([r1, r2]).drop(r1, r2)
