"""Secret scans: candidates found by their characters, judged by a random forest.

Runs of token characters that are long, or directly assigned to a name, are candidates.
A random forest (Spark ML), trained from labelled findings, removes the false positives:
digests, identifiers, paths, placeholders, numbers, long words. It sees the candidate's
length, character classes and transitions (likelihood under the corpus's own character
bigrams, counted over all texts), its coverage by the corpus's most frequent words, the name
it is assigned to, the path it comes from and the words beside it. Reviewed findings may be
given as a table; the query learns from findings planted into texts (``secret_examples``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumen.llm import textops as tx
from lumen.llm.common import crc_of_id, materialize, read_table
from lumen.llm.op4_lm import most_frequent, word_counts
from lumen.llm.secret_examples import planted

U = np.uint64
#: Shortest candidate, and shortest one that is assigned to a name.
LONG, ASSIGNED = 16, 8
#: Words of the dictionary: the most frequent of the corpus.
DICTIONARY = 20_000
TREES, DEPTH = 40, 8
#: Planted findings the query's forest learns from, and bytes of text around each.
PLANTED, CONTEXT = 6_000, 200
# fixed values: words of names that secrets, and that other values, are commonly assigned to
SECRET_NAMES = frozenset("password passwd pwd pass token secret key apikey auth bearer credential credentials".split())
PLAIN_NAMES = frozenset("commit sha sha1 sha256 md5 checksum digest hash etag rev revision integrity id uuid guid name "
                        "author user path file class url version title branch host date".split())
# fixed values: words of placeholders
PLACEHOLDERS = ("redacted", "placeholder", "example", "changeme", "your", "dummy", "sample", "insert", "todo", "masked",
                "hidden", "replace", "xxxx", "****")
# fixed values: published formats of issued keys
ISSUED = r"^(AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z]{32,}|xox[abp]-[0-9A-Za-z-]{10,})$"
UUID = re.compile(rb"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
NAME = re.compile(rb"([A-Za-z][A-Za-z0-9_-]*)[\"' ]*[:=]?[\"' ]*$")
PIECE = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
FEATURES = ("length", "digits", "upper", "lower", "other", "changes", "longest_run", "entropy", "transitions",
            "coverage", "hex", "uuid", "pieces", "letters_a_piece", "placeholder", "quoted", "assigned", "secret_name",
            "plain_name", "known_neighbours", "path_depth", "path_digits", "path_test")


def _classes() -> np.ndarray:
    t = np.full(256, 4, np.int8)
    t[48:58], t[65:91], t[97:123] = 0, 1, 2
    t[[ord(c) for c in "_-+/"]] = 3
    return t


def _alphabet() -> np.ndarray:
    t = np.full(256, 37, np.int64)
    t[128:] = 36
    t[97:123] = np.arange(26)
    t[65:91] = np.arange(26)
    t[48:58] = np.arange(26, 36)
    return t


CLASS, LETTER = _classes(), _alphabet()
ALPHABET = 38


def transitions(texts: DataFrame) -> np.ndarray:
    """log2 P(next | character) over the letters, digits and rest of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ALPHABET * ALPHABET, np.int64)
        for batch in batches:
            data, offsets = tx.column_bytes(batch.column("text"))
            for _, d, o in tx.chunks(data, offsets, tx.SCAN_BYTES, piece=tx.CHUNK_BYTES):
                a = LETTER[d]
                pair = a[:-1] * ALPHABET + a[1:]
                cut = o[1:-1] - 1
                cut = np.unique(cut[(cut >= 0) & (cut < len(pair))])       # pairs across documents
                total += np.bincount(pair, minlength=len(total)) - np.bincount(pair[cut], minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)],
                                         names=["cell", "n"])

    n = np.ones(ALPHABET * ALPHABET)
    for r in texts.select("text").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        n[r["cell"]] += r["n"]
    n = n.reshape(ALPHABET, ALPHABET)
    return np.log2(n / n.sum(1, keepdims=True))


def dictionary(texts: DataFrame) -> np.ndarray:
    """Sorted hashes of the most frequent words (A-Z lowered) of all texts."""
    rows = most_frequent(materialize(word_counts(texts)), DICTIONARY).select("word").toArrow()
    return np.sort(np.asarray(rows.column("word"), np.int64))


class Scanner:
    def __init__(self, bigrams: np.ndarray, words: np.ndarray) -> None:
        self.bigrams, self.words, self.hasher = bigrams, words, tx.Hasher(ASSIGNED << 8)

    def known(self, h: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(h), bool)
        h = h.view(np.int64)
        return self.words[np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)] == h

    def coverage(self, token: np.ndarray) -> float:
        """Share of the token's bytes inside dictionary words of 3 to 12 letters."""
        n = len(token)
        self.hasher._grow(n + 1)
        total = np.zeros(n + 1, U)
        np.cumsum(self.hasher.table[tx.LOWER[token]] * self.hasher.power[:n], out=total[1:])
        covered = np.zeros(n + 1, np.int64)
        for size in range(3, min(12, n) + 1):
            at = np.arange(n - size + 1)
            h = tx.mix((total[at + size] - total[at]) * self.hasher.inverse[at] + U(size))
            hit = at[self.known(h)]
            np.add.at(covered, hit, 1)
            np.add.at(covered, hit + size, -1)
        return float((np.cumsum(covered)[:n] > 0).mean()) if n else 0.0

    def find(self, data: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> Iterator[tuple[int, int, int]]:
        """(document, start, end) of the candidates in bytes ``lo`` to ``hi`` of a batch."""
        token = CLASS[data[lo:hi]] < 4
        first = token.copy()
        first[1:] &= ~token[:-1]
        cuts = offsets[np.searchsorted(offsets, lo, side="right"):np.searchsorted(offsets, hi)] - lo
        first[cuts] = token[cuts]                        # runs must not cross documents
        last = token.copy()
        last[:-1] &= ~token[1:] | first[1:]
        start, end = np.flatnonzero(first) + lo, np.flatnonzero(last) + 1 + lo
        big = end - start >= ASSIGNED
        start, end = start[big], end[big]
        doc = np.searchsorted(offsets, start, side="right") - 1
        for i, s, e in zip(doc.tolist(), start.tolist(), end.tolist()):
            if e - s >= LONG or (e - s >= ASSIGNED and self.assignment(data[max(int(offsets[i]), s - 4):s])):
                yield i, s, e

    @staticmethod
    def assignment(before: np.ndarray) -> bool:
        left = bytes(before).rstrip(b" \"'")
        return left.endswith((b"=", b":"))

    def features(self, d: np.ndarray, lo: int, hi: int, s: int, e: int, path: str) -> list[float]:
        t = d[s:e]
        n = len(t)
        cls = CLASS[t]
        share = [float((cls == c).mean()) for c in range(4)]
        change = np.flatnonzero(np.diff(cls)) + 1
        runs = np.diff(np.concatenate(([0], change, [n])))
        p = np.bincount(t, minlength=256) / n
        p = p[p > 0]
        a = LETTER[t]
        likely = float(self.bigrams[a[:-1], a[1:]].mean()) if n > 1 else 0.0
        before, after = bytes(d[max(lo, s - 32):s]), bytes(d[e:min(hi, e + 32)])
        named = NAME.search(before)
        name = set() if named is None else {w.lower() for w in PIECE.findall(named[1].decode())} | {named[1].decode().lower()}
        text = bytes(t).decode("ascii")
        pieces = PIECE.findall(text)
        letters = [len(w) for w in pieces if w[0] > "9"]
        beside = before.split()[:-1][-2:] + after.split()[1:][:2]
        hashes = np.array([self.hasher.words(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[2][0] for w in beside], U)
        hexes = bool(np.isin(t, np.frombuffer(b"0123456789abcdefABCDEF", np.uint8)).all())
        low = path.lower()
        return [float(n), *share, len(change) / n, float(runs.max()) / n, float(-(p * np.log2(p)).sum()), likely,
                self.coverage(t), float(hexes), float(UUID.fullmatch(text.encode()) is not None), len(pieces) / n,
                sum(letters) / max(1, len(letters)), float(any(w in text.lower() for w in PLACEHOLDERS)),
                float(before[-1:] in (b'"', b"'")), float(self.assignment(d[max(lo, s - 4):s])),
                float(bool(name & SECRET_NAMES)), float(bool(name & PLAIN_NAMES)),
                float(self.known(hashes).mean()) if len(hashes) else 0.0, float(path.count("/")),
                sum(c.isdigit() for c in path) / max(1, len(path)), float("test" in low or "example" in low)]


def _found(scanner: Scanner, column: pa.Array, paths: pa.Array) -> dict[str, list]:
    """Row, start, end, token and features of the candidates of a text column."""
    out: dict[str, list] = {"row": [], "start": [], "end": [], "token": [], "features": []}
    data, offsets = tx.column_bytes(column)
    at = int(offsets[0])
    for _, d, _ in tx.chunks(data, offsets, tx.SCAN_BYTES, piece=tx.CHUNK_BYTES):       # contiguous, the words beside are read from the batch
        for i, s, e in scanner.find(data, offsets, at, at + len(d)):
            lo, hi = int(offsets[i]), int(offsets[i + 1])
            values = (i, s - lo, e - lo, bytes(data[s:e]).decode("ascii"),
                      scanner.features(data, lo, hi, s, e, paths[i].as_py() or ""))
            for name, value in zip(out, values):
                out[name].append(value)
        at += len(d)
    return out


def candidates(docs: DataFrame, bigrams: np.ndarray, words: np.ndarray) -> DataFrame:
    """doc_id, start, end (byte offsets), token and features of every candidate in the
    texts of ``docs`` (doc_id, text, path). Null and empty texts have none, null paths are
    empty; a very long text is scanned in pieces cut after white space,
    with the bytes beside a candidate read across the cuts; repeated rows repeat."""
    schema = "doc_id long, start long, end long, token string, features array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(bigrams, words)
        with np.errstate(over="ignore"):
            for batch in batches:
                f = _found(scanner, batch.column("text"), batch.column("path"))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(f["row"], pa.int64())), pa.array(f["start"], pa.int64()),
                     pa.array(f["end"], pa.int64()), pa.array(f["token"], pa.string()),
                     pa.array(f["features"], pa.list_(pa.float64()))], names=["doc_id", "start", "end", "token", "features"])

    return docs.select("doc_id", "text", "path").mapInArrow(run, schema)


def planted_findings(docs: DataFrame, bigrams: np.ndarray, words: np.ndarray, count: int = PLANTED) -> DataFrame:
    """(features, label, kind) of about ``count`` findings planted into pieces of ``CONTEXT``
    characters of the texts of ``docs`` (doc_id, text, path). Texts are drawn by a hash of
    their id and text, a small table's repeatedly; null and empty texts and an empty table
    have none. Only what the scan finds of the planted token counts: its longest part."""
    texts = docs.where(F.length("text") > 0)
    n = texts.count()
    draws = max(1, -(-count // n)) if n else 1
    own = F.xxhash64("doc_id", "text")
    drawn = texts.where(F.pmod(own, F.lit(1 << 30)) < int(min(1.0, count / max(1, n)) * (1 << 30))).select(
        own.alias("seed"), "path",
        F.expr(f"substring(text, cast(1 + pmod(xxhash64(doc_id, text, 1), greatest(length(text) - {CONTEXT}, 1)) AS int), {CONTEXT})")
        .alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(bigrams, words)
        with np.errstate(over="ignore"):
            for batch in batches:
                made, paths = [], []
                for seed, path, text in zip(*(batch.column(c).to_pylist() for c in ("seed", "path", "text"))):
                    made += [planted(text, (seed + k * 0x9E3779B97F4A7C15) % (1 << 64), ASSIGNED) for k in range(draws)]
                    paths += [path] * draws
                f = _found(scanner, pa.array([m[0] for m in made], pa.string()), pa.array(paths, pa.string()))
                best: dict[int, tuple[int, list[float]]] = {}
                for row, lo, hi, x in zip(f["row"], f["start"], f["end"], f["features"]):
                    shared = min(hi, made[row][2]) - max(lo, made[row][1])
                    if shared >= ASSIGNED and shared > best.get(row, (0, []))[0]:
                        best[row] = shared, x
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x for _, x in best.values()], pa.list_(pa.float64())),
                     pa.array([made[r][3] for r in best], pa.int32()), pa.array([made[r][4] for r in best], pa.string())],
                    names=["features", "label", "kind"])

    return drawn.mapInArrow(run, "features array<double>, label int, kind string")


def train_forest(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH) -> RandomForestClassificationModel | None:
    """Forest of ``labelled`` (features, label 0 or 1); None unless both labels occur."""
    rows = labelled.select(array_to_vector("features").alias("features"), F.col("label").cast("double").alias("label"))
    if rows.select("label").distinct().count() < 2:
        return None
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=5, subsamplingRate=0.8).fit(rows)


def judge(found: DataFrame, model: RandomForestClassificationModel | None) -> DataFrame:
    """``found`` with score (the forest's probability of a secret) and is_secret (score >=
    0.5). Without a model nothing is removed: score 1."""
    if model is None:
        return found.withColumn("score", F.lit(1.0)).withColumn("is_secret", F.lit(True))
    scored = model.transform(found.withColumn("__x", array_to_vector("features")).withColumnRenamed("features", "__f")
                             .withColumnRenamed("__x", "features"))
    return (scored.withColumn("score", vector_to_array("probability")[1])
            .withColumn("is_secret", F.col("score") >= 0.5)
            .drop("features", "rawPrediction", "probability", "prediction").withColumnRenamed("__f", "features"))


def issued(token: Column) -> Column:
    """1 for tokens in a published format of issued keys, null for others."""
    return F.when(F.regexp_like(token, F.lit(ISSUED)), 1)


def op10_secrets(spark: SparkSession, sf_dir: str, labelled: DataFrame | None = None) -> DataFrame:
    """All candidates of ``documents`` with the forest's verdict. It learns from ``labelled``
    (doc_id, start, end, label: reviewed findings; those that are no candidates are passed
    over) where given, else from findings planted into documents whose crc32(doc_id as text)
    mod 3 is not 1; the rest are ``held_out``. ``label`` is the reviewed one, or 1 for
    published formats; the forest does not see it. Null and empty texts have no candidates,
    repeated rows repeat theirs; an empty table gives no rows; extra columns are ignored."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("path"))
    bigrams, words = transitions(docs), dictionary(docs)
    held = F.coalesce(crc_of_id(F.col("doc_id")) % 3 == 1, F.lit(False))
    found = candidates(docs, bigrams, words).withColumn("held_out", held)
    if labelled is None:
        found = materialize(found.withColumn("label", issued(F.col("token"))))
        learn = planted_findings(docs.where(~held), bigrams, words)
    else:
        reviewed = labelled.groupBy("doc_id", "start", "end").agg(F.max("label").alias("label"))
        found = materialize(found.join(reviewed, ["doc_id", "start", "end"], "left"))
        learn = found.where("label is not null and not held_out")
    model = train_forest(materialize(learn.select("features", "label")))
    return judge(found, model).select(
        "doc_id", "start", "end", F.crc32(F.col("token").cast("binary")).alias("token_crc32"), "held_out", "label",
        "score", "is_secret")
