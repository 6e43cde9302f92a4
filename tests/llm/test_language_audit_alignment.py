"""Language identification, the filter audit and tokenizer alignment against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
from helpers import awkward, documents
from pyspark.sql import functions as F

from tideglass.llm import alignment, filter_audit, language
from tideglass.llm.queries import QUERIES

A_FILE, B_FILE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LANGUAGES = {"xx": ["alpha", "beta", "gamma", "delta"], "yy": ["uno", "dos", "tres", "cuatro"], "zz": ["один", "два", "три"]}


def told(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, lang_pred string, n long, part string, A string, same string")


def in_languages(spark, seed=1, n=200):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choices(LANGUAGES[k], k=rng.randint(3, 30))), k, 0.5, "q", 1, "p", "a", "s") for i in range(n) for k in [rng.choice("xyz") * 2]]
    return told(spark, rows), rows


def plain_scores(texts, languages, wanted):
    """Multinomial naive Bayes over the same n-grams as strings' hashes, by loops."""

    def slots(text):
        code = "".join(c if c.isalpha() else " " for c in text.lower())
        norm = " " + "".join(w + " " for w in code.split())
        out = Counter()
        for at in range(len(norm)):
            h = 0
            for n in range(1, min(language.LONGEST, len(norm) - at) + 1):
                h = (h + ord(norm[at + n - 1]) + n) * 0x9E3779B97F4A7C15 % 2**64
                x = h
                x ^= x >> 30
                x = x * 0xBF58476D1CE4E5B9 % 2**64
                x ^= x >> 27
                x = x * 0x94D049BB133111EB % 2**64
                x ^= x >> 31
                out[x >> (64 - language.BITS)] += 1
        return out

    names, counts, rows = sorted(set(languages)), defaultdict(Counter), Counter(languages)
    for t, k in zip(texts, languages, strict=True):
        counts[k] += slots(t)
    total = {k: sum(counts[k].values()) + language.SMOOTHING * 2**language.BITS for k in names}
    out = []
    for t in wanted:
        logs = [math.log(rows[k] / len(languages)) + sum(n * math.log((counts[k][s] + language.SMOOTHING) / total[k]) for s, n in slots(t).items()) for k in names]
        best = max(range(len(names)), key=lambda i: (logs[i], -i))
        out.append((names[best], 1 / sum(math.exp(x - logs[best]) for x in logs)))
    return out


def test_language_scores_equal_a_plain_version(spark):
    docs, rows = in_languages(spark)
    model = language.train(docs)
    odd = ["alpha uno", "два", "Beta, beta; TRES 12", "q", "alphauno один"]
    best, p = model.predict([*odd, None, "", "12 !"])
    want = plain_scores([r[1] for r in rows], [r[2] for r in rows], odd)
    assert [model.languages[i] for i in best[:5]] == [k for k, _ in want]
    np.testing.assert_allclose(p[:5], [s for _, s in want], rtol=1e-4)
    assert best[5:].tolist() == [-1, -1, -1] and p[5:].tolist() == [0, 0, 0]


def test_blocks_of_a_long_text_add_up(monkeypatch):
    text = "Ein längerer Text, der über mehrere Blöcke geht. " * 40
    whole = language.slot_counts([text, "kurz", None, text])
    monkeypatch.setattr(language, "_BLOCK", 101)
    cut = language.slot_counts([text, "kurz", None, text])

    def sums(got):
        out = Counter()
        for t, s, n in zip(*(x.tolist() for x in got[:3]), strict=True):
            out[t, s] += n
        return out

    assert sums(whole) == sums(cut) and whole[3].tolist() == cut[3].tolist() == [True, True, False, True]


def test_identify_defined_cases(spark):
    docs, rows = in_languages(spark, seed=3)
    more = told(spark, [(900, None, "xx", 0.0, "", 0, "", "", ""), (901, " 12 !", "yy", 0.0, "", 0, "", "", ""), (902, "alpha beta gamma", None, 0.0, "", 0, "", "", ""), (None, "uno dos tres", "yy", 0.0, "", 0, "", "", ""), (902, "alpha beta gamma", None, 0.0, "", 0, "", "", ""), (903, "alpha beta " * 200_000, None, 0.0, "", 0, "", "", "")])
    got = language.identify(docs.unionByName(more)).select("doc_id", "held_out", "lang_pred", "score").collect()
    assert len(got) == len(rows) + 6
    of = {r["doc_id"]: r for r in got}
    assert of[900]["lang_pred"] == of[901]["lang_pred"] == "und" and of[900]["score"] == of[901]["score"] == 0
    assert of[902]["lang_pred"] == of[903]["lang_pred"] == "xx" and of[None]["lang_pred"] == "yy"
    assert all(of[r[0]]["lang_pred"] == r[2] for r in rows) and all(0 <= r["score"] <= 1 for r in got)
    nothing = language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).select("lang_pred", "score").distinct().collect()
    assert [tuple(r) for r in nothing] == [("und", 0.0)]
    assert language.identify(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="lang_pred"):
        language.score(docs, language.train(docs))


def test_held_out_labels_and_languages_are_not_learned(spark):
    docs, _ = in_languages(spark, seed=5)
    aside = F.col("doc_id") % 2 == 0
    changed = docs.withColumn("lang", F.when(aside, F.lit("never")).otherwise(F.col("lang")))
    a, b = (language.identify(d, held_out=aside).drop("text").orderBy("doc_id").collect() for d in (docs, changed))
    assert a == b


def test_held_out_accuracy_of_documents(spark, sf):
    got = QUERIES["op11_hashed_naive_bayes"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out")
    right, n = got.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count(F.lit(1))).first()
    assert n > 20 and right / n > 0.97


def plain_audit(rows, labels):
    """Every order over every document, by loops."""
    texts = [(i, t or "", k or "") for i, t, k in rows]
    least = {}
    for i, t, _ in texts:
        if i is not None:
            least[t] = min(i, least.get(t, i))
    fails, out = [], []
    for i, t, part in texts:
        words = [w for w in re.split("[\x20\x09-\x0d]+", t) if w]
        f = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > least[t]}
        own = [x for x in labels if x[0] == i and i is not None]
        fails.append((part, f, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    shapley = Counter()
    for part in {f[0] for f in fails}:
        left = [f for f in fails if f[0] == part]
        for order in map("".join, permutations("ABCDE")):
            alive = list(range(len(left)))
            for step, c in enumerate(order, 1):
                gone = [d for d in alive if left[d][1][c]]
                alive = [d for d in alive if not left[d][1][c]]
                redundant = sum(f[1][c] for f in left) - len(gone)
                unique = sum(f[1][c] and sum(f[1].values()) == 1 for f in left)
                shapley[part, c] += len(gone)
                out.append([part, order, step, len(alive), len(gone), redundant, unique, sum(left[d][2] for d in gone), sum(left[d][3] for d in gone)])
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def test_filter_audit_equals_loops(spark):
    rng = random.Random(9)
    base = [" ".join(rng.choice(["a", "b", "Cc", "DD", "#", "e&", "ñ"]) + str(rng.randrange(300)) for _ in range(rng.choice([3, 99, 100, 101, 200]))) for _ in range(25)]
    rows = [(i if i % 11 else None, rng.choice([*base, None, "", " \t\x0b", "A" * 11 + "\u2028" * 99, "A" * 10 + "b" * 90]), rng.choice(["en", "de", None, ""])) for i in range(160)]
    rows += [(5, rows[5][1], "en"), (5, rows[5][1], "de"), (6, rows[7][1], "en")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 160, 2)] + [(4, 1, 1), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "doc_id long, text string, lang string, n long, part string, same string")
    marks = spark.createDataFrame([(*x, "p") for x in labels], "doc_id long, quality int, toxic int, part string")
    got = filter_audit.audit(docs, marks).drop("filter")
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == plain_audit(rows, labels)
    assert filter_audit.audit(docs.limit(0), marks).count() == 0
    assert filter_audit.audit(docs, marks.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


def test_survivors_of_all_parts_are_the_sums(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    left = filter_audit.survivors(filter_audit.profiles(docs, labels)).toPandas()
    assert len(left) == 32 * (docs.select("lang").distinct().count() + 1)
    whole = left[left["part"].isna()].set_index("subset")[["n", "good", "toxic"]]
    assert whole.equals(left[left["part"].notna()].groupby("subset")[["n", "good", "toxic"]].sum().loc[whole.index])


def plain_alignments(texts):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a_of, b_of = Tokenizer.from_file(A_FILE), SentencePieceProcessor(model_file=B_FILE)
    a_of.encode_special_tokens = True
    letters, entries = alignment.byte_alphabet(), {i: e for e, i in a_of.get_vocab().items()}
    each, held = [], defaultdict(set)
    for number, text in enumerate(texts):
        want = b" " + (text or "").encode()
        a = a_of.encode(" " + (text or ""), add_special_tokens=False).ids
        b = b_of.encode(text or "")
        bytes_a = [bytes(letters[c] for c in entries[i]) for i in a]
        bytes_b = [bytes([int(b_of.id_to_piece(i)[3:5], 16)]) if b_of.is_byte(i) else b_of.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            each.append(([], [], [], []))
            continue
        owner_a = [i for i, x in enumerate(bytes_a) for _ in x]
        owner_b = [i for i, x in enumerate(bytes_b) for _ in x]
        links = sorted(set(zip(owner_a, owner_b, strict=True)))
        cut = [at for at in range(1, len(want) + 1) if at == len(want) or owner_a[at] != owner_a[at - 1] and owner_b[at] != owner_b[at - 1]]
        groups, before = [], 0
        for at in cut:
            groups.append(",".join(str(a[i]) for i in sorted(set(owner_a[before:at]))) + "|" + ",".join(str(b[i]) for i in sorted(set(owner_b[before:at]))))
            before = at
        each.append((a, b, groups, [(a[i], b[j]) for i, j in links]))
        for p in each[-1][3]:
            held[p].add(number)
    most = Counter()
    for (x, _), docs in held.items():
        most[x] = max(most[x], len(docs))
    return [
        (len(a), len(b), len(groups), len(links), sum(len(held[p]) == most[p[0]] for p in links), sum(len(held[p]) for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else "")
        for a, b, groups, links in each
    ]


def odd_texts():
    rng = random.Random(4)
    letters = [*"abcXYZ09.,;'\"|<>_-\t\n\r  ", " ", "\n ", "  ", "▁", "<0x41>", "<s>", "<|endoftext|>", "é", "e\u0301", "İ", "ß", "日本", "\u00a0", "\u2003", "\u3000", "\u180e", "\x1c", "\x85", "\u200b", "\ufeff", "\U0001f600", "don't", "I'LL", "the", " the", "\x00", "\x7f", "\ufb01", "½"]
    fuzz = ["".join(rng.choices(letters, k=rng.randint(1, 40))) for _ in range(700)]
    return [None, "", " ", "\n", "  a", "a ", "a  b", "a\n b", "a \n b", "x" * 3000, "▁", "a ▁ b", "one two", "one two", "<|endoftext|> <s> <0x41>", "�", *fuzz]


def test_alignment_equals_a_walk_over_bytes(spark):
    texts = odd_texts()
    docs = spark.createDataFrame([(i, t, "g", 1, "p") for i, t in enumerate(texts)], "doc_id long, text string, groups string, row int, pairs string").repartition(3)
    for hot in (alignment.HOT, 40):
        aligned = alignment.alignments(docs, A_FILE, B_FILE).withColumn("digest", F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)))
        got = alignment.with_counts(aligned, hot=hot).orderBy("doc_id").select("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "digest").collect()
        assert list(map(tuple, got)) == plain_alignments(texts)


def test_parts_put_together_equal_whole_texts(monkeypatch):
    texts = [t for t in odd_texts() if t]
    parted, whole = alignment.Aligner(A_FILE, B_FILE), alignment.Aligner(A_FILE, B_FILE)
    whole._parted = False
    monkeypatch.setattr(alignment, "_KEPT_CHARS", 300)  # parts are forgotten again and again
    for at in range(0, len(texts), 50):
        for x, y in zip(parted.documents(texts[at : at + 50]), whole.documents(texts[at : at + 50]), strict=True):
            assert x == y if isinstance(x, list) else np.array_equal(x, y)


def test_alignment_defined_cases(spark):
    docs = documents(spark, awkward(random.Random(8)))
    got = alignment.with_counts(alignment.alignments(docs, A_FILE, B_FILE)).collect()
    assert len(got) == docs.count()
    assert all(r["n_links"] == 0 and r["groups"] == "" for r in got if r["doc_id"] in (5, 6)) and sum(r["doc_id"] is None for r in got) == 1
    assert alignment.with_counts(alignment.alignments(docs.limit(0), A_FILE, B_FILE)).count() == 0
