"""Secret scans: candidate strings, and a random forest that removes false positives.

Candidates are (1) blocks of private keys, from their first to their last line; (2) behind a cue such as ``password`` and
an assignment, ``is`` or a blank, values of at least ``SHORT`` characters other than white space and quotes; (3)
elsewhere runs of at least ``LEAST`` characters of the alphabets that keys and tokens use, with both a
letter and a digit; in ``name=value`` the value counts. Of candidates that overlap the first in this order stays. Each is
described by its length, its mix and transitions of characters, how much of it dictionary words cover, its path, its
neighbouring words and how they lead to it. A forest trained by Spark ML from labelled findings gives the
probability that a candidate is a secret; tasks hold it as arrays, so texts are scanned and masked as they are read.

The tables hold no labelled findings, so ``labelled_findings`` makes a fixed number of them by rule, from
the public formats of keys and of the strings that are mistaken for them; pass others to ``train``.

Defined cases: null and empty texts have no candidates; a null path counts as empty; repeated rows are
scanned each; an empty table gives an empty result; other columns of the input, whatever their names, are ignored by
``scan`` and kept by ``redact``.
"""

from __future__ import annotations

import json
import math
import random
import re
import string
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import scratch_path
from .columns import fresh
from .words import slices

LEAST, SHORT = 12, 6
THRESHOLD = 0.5
FINDINGS = 4000
MASK = "[SECRET]"
_RUN = np.zeros(256, bool)
_RUN[list((string.ascii_letters + string.digits + "_+/=.~-").encode())] = True
_DIGIT, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_DIGIT[list(string.digits.encode())] = True
_LETTER[list(string.ascii_letters.encode())] = True
_ASSIGNED = re.compile(r"([A-Za-z_][\w.-]*)=+(.+)")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]{2,}")
_CUE = re.compile("token|secret|passw|pwd|passphrase|api.?key|access.?key|private.?key|bearer|credential", re.IGNORECASE)
#: One of these is in every cue.
_STEMS = ("token", "secret", "passw", "pwd", "passphrase", "key", "bearer", "credential")
#: the rest of the cue's name, what leads to the value, and the value, in quotes or not
_VALUE = re.compile(r"""[\w.-]*["'`\]]*(?:\s{0,3}(?::=|=>|=|:)\s{0,3}|\s{1,3}is\s{1,3}|\s)(?:"([^"\s]+)"|'([^'\s]+)'|`([^`\s]+)`|([^\s"'`]+))""")
_NAME = re.compile(r"[\w.-]*\Z")
_CLOSING = ",;.)]}>"
_LINKED = (re.compile(r"(?:=|:|=>)\s*[\"'`]?\Z"), re.compile(r"\bis\s+[\"'`]?\Z"), re.compile(r"[\"'`]\Z"))
_KEY_BEGIN, _KEY_END = re.compile("-----BEGIN [A-Z ]*PRIVATE KEY-----"), re.compile("-----END [A-Z ]*PRIVATE KEY-----")
_ARMOUR = re.compile(r"(?:[ \t]*(?:\\n|\r?\n)[ \t]*(?:[A-Za-z-]+: [^\n]*|[A-Za-z0-9+/=]*)(?=[ \t]*(?:\\n|\r?\n|-----|\Z)))*")
# Prefixes of public key formats.
PREFIXES = ("AKIA", "ASIA", "AIza", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "sk_live_", "rk_live_", "xoxb-", "xoxp-", "eyJ", "SG.", "hf_", "npm_", "-----BEGIN")
# Words that stand beside secrets, beside other identifiers, and in paths of examples.
CUES = ("token", "secret", "password", "passwd", "pwd", "apikey", "api", "key", "auth", "bearer", "credential", "private", "access", "passphrase")
HARMLESS = ("sha", "commit", "checksum", "md5", "digest", "hash", "uuid", "guid", "id", "version", "file", "path", "url", "http", "https", "integrity", "etag", "rev", "mail", "www", "ref", "date", "page")
EXAMPLES = ("test", "example", "sample", "fixture", "doc", "lock", "dummy", "mock", "min.js")


@lru_cache(maxsize=2)
def _dictionary(path: str) -> tuple[frozenset[str], np.ndarray]:
    """(words of four letters or more, log probabilities of letter pairs) of a tokenizer's vocabulary."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    words = [w for p in vocab if (w := p.removesuffix("</w>")).isascii() and w.isalpha() and len(w) >= 4]
    pairs = np.ones((26, 26))
    for w in words:
        a = np.frombuffer(w.lower().encode(), np.uint8) - 97
        np.add.at(pairs, (a[:-1], a[1:]), 1)
    return frozenset(w.lower() for w in words), np.log(pairs / pairs.sum(1, keepdims=True))


def _covered(text: str, words: frozenset[str]) -> float:
    """The share of characters inside dictionary words, longest first from each place."""
    low, at, hit = text.lower(), 0, 0
    while at < len(low):
        size = next((n for n in range(min(12, len(low) - at), 3, -1) if low[at : at + n] in words), 0)
        hit += size
        at += size or 1
    return hit / len(low)


def describe(candidate: str, name: str, before: str, after: str, path: str, dictionary: str) -> list[float]:
    words, pairs = _dictionary(dictionary)
    n = len(candidate)
    raw = np.frombuffer(candidate.encode("ascii", "replace"), np.uint8)
    kind = np.where(_DIGIT[raw], 0, np.where((raw >= 65) & (raw <= 90), 1, np.where(_LETTER[raw], 2, 3)))
    counts = np.bincount(raw)
    share = counts[counts > 0] / n
    letters = np.frombuffer(candidate.lower().encode("ascii", "replace"), np.uint8).astype(int) - 97
    follow = [(a, b) for a, b in zip(letters[:-1], letters[1:], strict=True) if 0 <= a < 26 and 0 <= b < 26]
    near = {w.lower() for w in _WORD.findall(f"{before} {name}")}
    next_to = {w.lower() for w in _WORD.findall(f"{before[-20:]} {name}")}
    behind = {w.lower() for w in _WORD.findall(after)}
    runs = np.diff(np.concatenate(([-1], np.flatnonzero(np.diff(kind)), [n - 1])))
    return [
        float(n), float((kind == 0).mean()), float((kind == 1).mean()), float((kind == 2).mean()), float((kind == 3).mean()),
        len(share) / n, float(-(share * np.log2(share)).sum()), float((np.diff(kind) != 0).mean()) if n > 1 else 0.0, float(runs.max()) / n,
        float(np.mean([pairs[a, b] for a, b in follow])) if follow else math.log(1 / 26), _covered(candidate, words),
        float(all(c in string.hexdigits for c in candidate)), float(candidate.startswith(PREFIXES)),
        float(any(c in near for c in CUES)), float(any(h in near for h in HARMLESS)), float(any(h in behind for h in HARMLESS)),
        float(any(e in path.lower() for e in EXAMPLES)), float(any(c in next_to for c in CUES)), *(float(bool(link.search(before))) for link in _LINKED),
    ]


def _runs(text: str) -> list[tuple[int, int, str]]:
    """(start, end, name) of the runs with a letter and a digit, places in characters."""
    data = text.encode("utf-8", "replace")
    raw = np.frombuffer(data, np.uint8)
    edge = np.diff(_RUN[raw].view(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    digits = np.concatenate(([0], np.cumsum(_DIGIT[raw])))
    long = (ends - starts >= LEAST) & (digits[ends] > digits[starts])
    out = []
    for a, b in zip(starts[long], ends[long], strict=True):
        a, b, name = int(a), int(b), ""
        found = _ASSIGNED.fullmatch(data[a:b].decode())
        if found:
            name, a = found[1], a + found.start(2)
        run = data[a:b].decode()
        value = run.strip("=.-~/+")
        a += run.index(value) if value else 0
        if len(value) >= LEAST and any(map(str.isdigit, value)) and any(map(str.isalpha, value)):
            out.append((a, a + len(value), name))
    if out and len(data) != len(text):  # byte places to characters
        chars = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
        out = [(int(chars[a]), int(chars[b]), name) for a, b, name in out]
    return out


def _keys(text: str) -> list[tuple[int, int, str]]:
    """Blocks of private keys, their lines apart by line feeds or by the signs that stand for them; one without a last line goes as
    far as lines of its alphabet do."""
    out, at = [], 0
    while found := _KEY_BEGIN.search(text, at):
        body = _ARMOUR.match(text, found.end()).end()
        last = _KEY_END.search(text, found.end())
        at = last.end() if last and last.start() <= body else max(found.end(), body)
        out.append((found.start(), at, ""))
    return out


def _led(text: str, keys: Sequence[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Values behind cues that are not inside ``keys``, with the cue's whole name."""
    low, out = text.lower(), []
    if not any(stem in low for stem in _STEMS):
        return out
    for cue in _CUE.finditer(text):
        found = _VALUE.match(text, cue.end())
        if found and not any(a <= cue.start() < b for a, b, _ in keys):
            a, b = found.span(found.lastindex)
            if found.lastindex == 4:
                while b > a and text[b - 1] in _CLOSING:
                    b -= 1
            if b - a >= SHORT:
                name = _NAME.search(text, max(0, cue.start() - 40), cue.start())[0] + re.match(r"[\w.-]*", text[cue.start() : a])[0]
                out.append((a, b, name))
    return out


def candidates(text: str | None) -> list[tuple[int, int, str, str, str, str]]:
    """(start, end, candidate, name, words before, words after), places in characters, in order."""
    if not text or len(text) < SHORT:
        return []
    taken: list[tuple[int, int, str]] = []
    keys = _keys(text) if "-----BEGIN" in text else []
    for found in (keys, _led(text, keys), _runs(text)):
        if not taken:
            new = list(found)
        else:
            ends = np.array(sorted((a, b) for a, b, _ in taken))
            at = [int(np.searchsorted(ends[:, 0], b)) - 1 for _, b, _ in found]
            new = [f for f, i in zip(found, at, strict=True) if i < 0 or ends[i, 1] <= f[0]]
        last = 0
        for a, b, name in sorted(new):
            if a >= last:
                taken.append((a, b, name))
                last = b
    return [(a, b, text[a:b], name, text[max(0, a - 48) : a], text[b : b + 24]) for a, b, name in sorted(taken)]


def labelled_findings(count: int = FINDINGS, seed: int = 3, kinds: Sequence[int] | None = None) -> list[tuple[str, str, str, str, str, int]]:
    """(candidate, name, before, after, path, label), half of them secrets, made by rule; ``kinds`` limits the secrets'
    kinds (0 to 9)."""
    rng = random.Random(seed)
    hexes, alnum, b64 = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    signs = "!@#$%^&*-_+?.:~"
    pairs = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it", "st", "io", "le", "is", "ou", "ar", "as", "de", "rt", "ve"]
    names = ["token", "secret", "password", "passwd", "pwd", "api_key", "apiKey", "access_key", "auth_token", "client_secret", "DB_PASSWORD", "SECRET_KEY", "credential"]

    def of(alphabet: str, n: int) -> str:
        return "".join(rng.choice(alphabet) for _ in range(n))

    def word() -> str:
        return "".join(rng.choice(pairs) for _ in range(rng.randint(1, 4)))

    def led() -> tuple[str, str]:
        """What leads to an assigned value, and what closes it."""
        quote = rng.choice(["", '"', "'"])
        return f"{rng.choice(names)}{rng.choice(['=', ' = ', ': ', ':', ' is ', ' => '])}{quote}", quote

    def secret() -> tuple[str, str, str]:
        kind = rng.choice(kinds) if kinds else rng.randrange(10)
        loose = ("", "") if rng.random() < 0.5 else led()
        if kind == 0:
            return rng.choice(["AKIA", "ASIA"]) + of(string.ascii_uppercase + string.digits, 15) + rng.choice(string.digits), *loose
        if kind == 1:
            return rng.choice(["ghp_", "gho_", "hf_", "npm_", "glpat-", "sk_live_"]) + of(alnum, rng.randint(18, 39)) + rng.choice(string.digits), *loose
        if kind == 2:
            return "eyJ" + of(alnum, rng.randint(20, 60)) + "." + of(alnum + "_-", rng.randint(20, 80)) + rng.choice(string.digits), rng.choice(["bearer ", "", "token: "]), ""
        if kind == 3:
            return "AIza" + of(alnum + "_-", 34) + rng.choice(string.digits), *loose
        if kind == 4:
            return f"-----BEGIN {rng.choice(['RSA ', 'EC ', '', 'OPENSSH '])}PRIVATE KEY-----\n" + "\n".join(of(b64, 64) for _ in range(rng.randint(2, 8))) + "\n-----END PRIVATE KEY-----", "", ""
        if kind == 5:  # short passwords with signs
            return of(alnum + signs * 3, rng.randint(6, 12)) + rng.choice(signs[:8]) + rng.choice(string.digits), *led()
        if kind == 6:  # of letters alone, of digits alone
            return rng.choice([of(string.ascii_letters, rng.randint(8, 24)), of(string.digits, rng.randint(8, 16))]), *led()
        if kind == 7:  # words with something added
            return f"{word().title()}{rng.choice(signs)}{word()}{rng.randint(10, 9999)}", *led()
        return of(rng.choice([hexes, alnum, b64]), rng.randint(16, 64)) + rng.choice(string.digits), *led()

    def other() -> tuple[str, str, str]:
        kind = rng.randrange(14)
        if kind == 0:
            return of(hexes, rng.choice([32, 40, 64])), rng.choice(["commit ", "sha1 ", "checksum: ", "md5: ", "sha256-", "digest ", "etag ", "rev "]), ""
        if kind == 1:
            return "-".join(of(hexes, n) for n in (8, 4, 4, 4, 12)), rng.choice(["uuid ", "id: ", "guid=", ""]), ""
        if kind == 2:
            return f"{word()}{rng.randint(1, 99)}.{rng.choice(['example', 'mail', 'host'])}.{rng.choice(['com', 'org', 'net'])}", rng.choice(["mail ", "http ", "www ", ""]), ""
        if kind == 3:
            return "/".join(word() for _ in range(3)) + f"{rng.randint(1, 999)}.{rng.choice(['html', 'txt', 'js'])}", rng.choice(["file ", "path ", ""]), ""
        if kind == 4:
            return f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T{rng.randint(10, 23)}", rng.choice(["date ", ""]), ""
        if kind == 5:
            return f"{word()}_{word()}_{word()}_{rng.randint(1, 999)}", "", ""
        if kind == 6:
            return rng.choice(["xxxxxxxxxxxxxx1", "your_api_key_here1", "changeme12345", "password12345", "EXAMPLE0000000000", "000000000000000a", "aaaaaaaaaaaaaaa1", "changeme", "********", "xxxxxxxx", "<password>", "${TOKEN}", "your-password", "required", "undefined", "REDACTED", "placeholder"]), *led()
        if kind == 7:
            return "".join(word().title() for _ in range(4)) + str(rng.randint(1, 9)), "", ""
        if kind == 8:
            return "".join(word() for _ in range(4)) + str(rng.randint(1, 9999)), "", ""
        if kind == 9:  # code that fetches a value
            return f"{word()}.{word()}{rng.choice(['()', '.get()', '[0]', '_' + word()])}", *led()
        if kind in (10, 11):  # prose behind a cue
            return (word() + word()), rng.choice(["the secret ", "a token ", "token of ", "passwords ", "the password ", "access key ", "secret ", "the password is ", "the secret is ", "credentials "]), ""
        if kind == 12:
            return word() + word() + word(), f"{rng.choice(['tokens', 'token', 'secret'])}: ", ""
        return f"v{rng.randint(0, 9)}.{rng.randint(0, 99)}.{rng.randint(0, 999)}-{rng.choice(['beta', 'alpha', 'release'])}{rng.randint(1, 9)}", rng.choice(["version ", ""]), ""

    out = []
    for i in range(count):
        value, before, closing = secret() if i % 2 else other()
        path = rng.choice(["", "src", f"src{rng.randint(0, 30)}", "app/settings.py"]) if i % 2 or rng.random() < 0.7 else rng.choice(["tests/x.py", "docs/example.md", "package.lock"])
        out.append((value, "", f"{word()} {word()} {before}", f"{closing} {word()} {word()}", path, i % 2))
    return out


@dataclass(frozen=True)
class Forest:
    """One row per node of all trees: a feature (-1 at a leaf), its threshold, the two children's rows, and the share of
    secrets at a leaf; ``roots`` are the trees' first rows."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    share: np.ndarray
    roots: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The mean over the trees of the share at the leaf that each row of ``x`` comes to."""
        row = np.arange(len(x))
        total = np.zeros(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            while (inner := self.feature[node] >= 0).any():
                low = x[row, self.feature[node]] <= self.threshold[node]
                node = np.where(inner, np.where(low, self.left[node], self.right[node]), node)
            total += self.share[node]
        return total / len(self.roots)


def forest(model: RandomForestClassificationModel, spark: SparkSession) -> Forest:
    """The nodes of a fitted model, a few thousand rows, from its saved form."""
    path = scratch_path(spark, "forest")
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").orderBy("treeID", "id").collect()
    first: dict[int, int] = {}
    for row, n in enumerate(nodes):
        first.setdefault(n["treeID"], row)
    start = np.array([first[n["treeID"]] for n in nodes])
    left, right = (np.array([n[c] for n in nodes]) + start for c in ("leftChild", "rightChild"))
    inner = np.array([n["leftChild"] >= 0 for n in nodes])
    stats = np.array([n["impurityStats"][:2] for n in nodes], float)
    cuts = [n["split"]["leftCategoriesOrThreshold"] for n in nodes]
    return Forest(
        np.where(inner, [n["split"]["featureIndex"] for n in nodes], -1), np.array([c[0] if c else 0.0 for c in cuts]), np.where(inner, left, 0), np.where(inner, right, 0),
        stats[:, 1] / np.maximum(stats.sum(1), 1e-300), np.array(sorted(first.values())),
    )


def train(spark: SparkSession, findings: Sequence[tuple[str, str, str, str, str, int]], dictionary: str, *, trees: int = 40, depth: int = 8) -> RandomForestClassificationModel:
    """A forest from labelled findings; their number is the caller's bound."""
    rows = [(describe(v, name, before, after, path, dictionary), float(label)) for v, name, before, after, path, label in findings]
    data = spark.createDataFrame(rows, "x array<double>, label double").select(array_to_vector("x").alias("features"), "label").coalesce(2)
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=17, featureSubsetStrategy="sqrt").fit(data)


def _judge(model: Forest, texts: Sequence[str | None], paths: Sequence[str | None], dictionary: str) -> tuple[list[tuple[int, tuple]], np.ndarray]:
    """(text's number, candidate) of all candidates, and their probabilities."""
    found = [(i, c) for i, text in enumerate(texts) for c in candidates(text)]
    x = [describe(c[2], c[3], c[4], c[5], paths[i] or "", dictionary) for i, c in found]
    return found, model.predict(np.array(x)) if x else np.zeros(0)


def scan(docs: DataFrame, dictionary: str, *, path: Column | None = None, model: RandomForestClassificationModel | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, start, end, candidate, probability, is_secret: all candidates."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(forest(model or train(spark, labelled_findings(), dictionary), spark))
    base = docs.select("doc_id", "text", (F.lit("") if path is None else path.cast("string")).alias("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found, p = _judge(shared.value, b.column("text").to_pylist(), b.column("path").to_pylist(), dictionary)
            at = pa.array([i for i, _ in found], pa.int64())
            cols = [pa.array([c[k] for _, c in found], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(at), *cols, pa.array(p), pa.array(p >= threshold)], ["doc_id", "start", "end", "candidate", "probability", "is_secret"])

    return base.mapInArrow(run, "doc_id long, start int, end int, candidate string, probability double, is_secret boolean")


def redact(docs: DataFrame, dictionary: str, *, path: Column | None = None, model: RandomForestClassificationModel | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by a mask as it is read; all columns and rows kept."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(forest(model or train(spark, labelled_findings(), dictionary), spark))
    [where] = fresh(docs, "_path")
    names = docs.columns
    text_at = next(i for i, c in enumerate(names) if c.lower() == "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            columns = list(b.columns)
            texts = columns[text_at].to_pylist()
            found, p = _judge(shared.value, texts, columns.pop().to_pylist(), dictionary)
            for (i, c), probability in zip(reversed(found), p[::-1], strict=True):  # from the end, so that places hold
                if probability >= threshold:
                    texts[i] = texts[i][: c[0]] + MASK + texts[i][c[1] :]
            columns[text_at] = pa.array(texts, columns[text_at].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.withColumn(where, F.lit("") if path is None else path.cast("string")).mapInArrow(run, docs.schema)
