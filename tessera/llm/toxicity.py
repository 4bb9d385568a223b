"""Toxicity: noisy-channel deobfuscation, then a classifier over restored words."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batched, materialize, table, texts

#: Labelled documents that the classifier is fitted on, at most.
MAX_TRAIN = 20_000
#: Words and word beginnings that it knows, at most.
MAX_FEATURES = 3_000
#: A word or beginning counts from so many toxic documents on, and at this distance from chance.
LEAST_DOCS, LEAST_Z = 4, 5.0
STEMS = (4, 5, 6)
THRESHOLD = 0.3
HELD_OUT = 2
#: Longer words are decoded too, but not remembered.
LONGEST = 40

#: Characters that stand for letters, and what may come between letters.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c"}
BETWEEN = " .-_*~,'·"

# --- character language model ---------------------------------------------------------

OTHER, EDGE, KINDS = 26, 27, 28
_KIND = np.full(256, EDGE, np.uint8)
_KIND[97:123] = _KIND[65:91] = np.arange(26)
_KIND[128:] = OTHER


def count_trigrams(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Counts of character trigrams over all texts; a table of fixed size, 28 kinds of characters cubed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(KINDS**3, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                kinds = _KIND[np.frombuffer("\n\n".join(["", *texts(batch.column(0).slice(at, 256)), ""]).encode("utf-8", "surrogatepass"), np.uint8)].astype(np.int32)
                total += np.bincount((kinds[:-2] * KINDS + kinds[1:-1]) * KINDS + kinds[2:], minlength=KINDS**3)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["trigram", "n"])

    out = np.zeros(KINDS**3, np.int64)
    for row in docs.select(text).mapInArrow(run, "trigram int, n long").groupBy("trigram").agg(F.sum("n").alias("n")).collect():
        out[row.trigram] = row.n
    return out


def language_model(counts: np.ndarray) -> np.ndarray:
    """Log probability of a character after two others, mixed with shorter histories."""
    three = counts.reshape(KINDS, KINDS, KINDS).astype(float)
    two, one = three.sum(axis=0), three.sum(axis=(0, 1))
    p1 = (one + 1) / (one.sum() + KINDS)
    p2 = (two + 5 * p1) / (two.sum(axis=1, keepdims=True) + 5)
    p3 = (three + 5 * p2[None]) / (three.sum(axis=2, keepdims=True) + 5)
    return np.log(p3).astype(np.float32)


# --- channel --------------------------------------------------------------------------

#: Log probabilities of the channel.
KEPT, STOOD_FOR, REPEATED, INSERTED = np.log(0.9), np.log(0.1), np.log(0.2), np.log(0.05)

_SUSPECT = re.compile(r"(?=.*[a-z])(?:.*[0-9@$!|+€(].*|.*([a-z])\1\1.*|[a-z](?:[ .\-_*~,'·]+[a-z0-9@$!|+€(]){2,})", re.S)
_EDGES = re.compile(r"^[^\w@$!|+€(]+|[^\w@$]+$")


def lattice(word: str, parted: float | None = None) -> list[list[tuple[str, float]]]:
    """For each run of a written word, what letters it may stand for, with log probabilities.

    With ``parted``, what comes between letters may also, at that log probability, be the border of two words.
    """
    out: list[list[tuple[str, float]]] = []
    for run in re.finditer(r"(.)\1*", word, re.S):
        char, n = run[1], len(run[0])
        if char in BETWEEN:
            out.append([("", INSERTED * n), *([] if parted is None else [(" ", parted)])])
            continue
        letters = [(char, KEPT)] if char.isalpha() else [(c, STOOD_FOR) for c in LEET.get(char, "")] or [(char, KEPT)]
        once = [(c, p if n == 1 else p + REPEATED) for c, p in letters]
        twice = [(c * 2, p + p) for c, p in letters] if n > 1 else []
        out.append(once + twice)
    return out


def _kind(c: str) -> int:
    return ord(c) - 97 if "a" <= c <= "z" else EDGE if not c.isalpha() else OTHER


def restore(word: str, model: np.ndarray, parted: float | None = None) -> str:
    """The likeliest letters behind a written word: Viterbi search of its lattice under the language model.

    With ``parted``, several words with blanks between. Any length will do: a
    step keeps the best way to each pair of last characters, as a chain.
    """
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(EDGE, EDGE): (0.0, None)}
    for choices in lattice(word, parted):
        new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, done) in best.items():
            for letters, p in choices:
                x, y, total = a, b, score + p
                for c in letters:
                    k = _kind(c)
                    total += model[x, y, k]
                    x, y = y, k
                if (x, y) not in new or total > new[x, y][0]:
                    new[x, y] = (total, (done, letters) if letters else done)
        best = new
    chain = max(((score + model[a, b, EDGE], done) for (a, b), (score, done) in best.items()), key=lambda x: x[0])[1]
    out = []
    while chain is not None:
        chain, letters = chain
        out.append(letters)
    return "".join(reversed(out))


#: Border probabilities that are tried: as likely as a letter's gap, or as a border that is kept.
PARTED = (INSERTED, KEPT)


class Restorer:
    """Words of a text as they are and as they were meant; remembers words up to a bound."""

    LIMIT = 200_000

    def __init__(self, model: np.ndarray, features: dict[str, int] | None = None):
        self.model, self.features = model, features
        self.known: dict[str, tuple] = {}

    def forms(self, word: str) -> set[str]:
        bare = _EDGES.sub("", word)
        forms = {bare} if bare else set()
        if _SUSPECT.fullmatch(word):
            forms |= {restore(x, self.model) for x in {word, bare} if x}
            if any(c in BETWEEN for c in bare):
                forms |= self.parted(bare)
        return forms

    def parted(self, word: str) -> set[str]:
        """The words that a row of letters spells, with borders where the language model puts them."""
        return {x for p in PARTED for x in restore(word, self.model, p).split()}

    def tags(self, word: str) -> tuple:
        """Features of one word: its forms, and their beginnings; only known ones once there is a list."""
        if (found := self.known.get(word)) is None:
            found = self.named(self.forms(word))
            if len(word) > LONGEST:
                return found
            if len(self.known) >= self.LIMIT:
                self.known.clear()
            self.known[word] = found
        return found

    def named(self, forms: set[str]) -> tuple:
        names = {x for form in forms for x in (form, *(f"{form[:n]}*" for n in STEMS if len(form) >= n))}
        return tuple(sorted(names)) if self.features is None else tuple(sorted({self.features[x] for x in names if x in self.features}))

    def of(self, text: str) -> set:
        """Features of a text: those of its words, and of what runs of single characters spell."""
        words = text.lower().split()
        distinct = set(words)
        out: set = set()
        known = self.known
        for word in distinct:
            found = known.get(word)
            if found is None:
                found = self.tags(word)
            if found:
                out.update(found)
        if sum(len(w) == 1 for w in distinct) > 1:
            run: list[str] = []
            for word in [*words, "--"]:
                if len(word) == 1:
                    run.append(word)
                    continue
                if len(run) > 2 and any(c.isalpha() for c in run):
                    spelled = " ".join(run)
                    out.update(self.named({restore(spelled, self.model)} | self.parted(spelled)))
                run = []
        return out


# --- classifier -----------------------------------------------------------------------


def held_out(doc_id: str) -> Column:
    """Rows that are kept for testing: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == HELD_OUT, F.lit(False))


def fit_logistic(rows: list[tuple[float, list[int]]], size: int, rounds: int = 600, l2: float = 2e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on sets of features, by accelerated gradient descent."""
    lengths = [len(x) for _, x in rows]
    row, col = np.repeat(np.arange(len(rows)), lengths), np.array([i for _, x in rows for i in x], np.int64)
    y = np.array([label for label, _ in rows])
    w, step = np.zeros(size + 1), 0.0
    held = w.copy()
    rate = 4.0 / (1 + max([1, *lengths]))
    for k in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, held[col], len(rows)) + held[-1], -30, 30)))
        g = np.append(np.bincount(col, (p - y)[row], size), (p - y).sum()) / len(rows)
        new = held - rate * (g + l2 * np.append(held[:-1], 0.0))
        step = k / (k + 3)
        held, w = new + step * (new - w), new
    return w[:-1], float(w[-1])


class ToxicityModel:
    """Language model, features and weights; small, of bounded size, and sent to tasks."""

    def __init__(self, model: np.ndarray, features: dict[str, int], weights: np.ndarray, bias: float):
        self.model, self.features, self.weights, self.bias = model, features, weights, bias

    def scores(self, restorer: Restorer, batch: list[str]) -> list[float]:
        out = []
        for text in batch:
            z = self.bias + float(sum(self.weights[i] for i in restorer.of(text)))
            out.append(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))))
        return out


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", max_train: int = MAX_TRAIN) -> ToxicityModel:
    """Learn from labelled documents that are not held out.

    The language model counts all texts. The classifier is fitted on at most
    ``max_train`` labelled documents, about as many as that, drawn by a hash of
    the id. Its features are words and word beginnings that are far likelier in
    toxic documents. Without labels of both kinds every score is the share of
    toxic ones (0 without labels).
    """
    model = language_model(count_trigrams(batched(docs), text))
    known = labels.where(~held_out(doc_id) & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("doc")).agg(F.max(F.col(label).cast("double")).alias("y"))
    total = known.count()
    share = min(1.0, max_train / max(total, 1) * 0.98)
    drawn = known.where(F.pmod(F.xxhash64("doc"), F.lit(1 << 20)) < int(share * (1 << 20))).limit(max_train)
    sample = materialize(docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).join(F.broadcast(drawn), "doc").select("y", "text"), "labelled")
    sums = sample.agg(F.count(F.lit(1)), F.sum("y")).first()
    n1, n0 = sums[1] or 0.0, (sums[0] or 0) - (sums[1] or 0.0)
    if not n1 or not n0:
        share = n1 / (n1 + n0) if n1 + n0 else 0.0
        return ToxicityModel(model, {}, np.zeros(0), float(np.clip(np.log(max(share, 1e-9) / max(1 - share, 1e-9)), -30, 30)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model)
        seen: tuple[Counter, Counter] = Counter(), Counter()

        def emit() -> pa.RecordBatch:
            names = list(seen[0].keys() | seen[1].keys())
            batch = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *[pa.array([c[x] for x in names], pa.int64()) for c in seen]], ["feature", "n0", "n1"])
            seen[0].clear(), seen[1].clear()
            return batch

        for batch in batches:
            for y, x in zip(batch.column("y").to_pylist(), texts(batch.column("text")), strict=True):
                seen[int(y > 0)].update(restorer.of(x))
                if len(seen[0]) > 500_000:
                    yield emit()
        yield emit()

    share = F.lit((n1) / (n1 + n0))
    every = F.col("n0") + F.col("n1")
    z = (F.col("n1") - every * share) / F.sqrt(every * share * (1 - share))
    counted = sample.mapInArrow(count, "feature string, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    best = counted.where((F.col("n1") >= LEAST_DOCS) & (z >= LEAST_Z)).orderBy(z.desc(), "feature").limit(MAX_FEATURES).collect()
    features = {r.feature: k for k, r in enumerate(best)}

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model, features)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array([sorted(restorer.of(x)) for x in texts(batch.column("text"))], pa.list_(pa.int32()))], ["y", "found"])

    rows = sorted((r.y, list(r.found)) for r in sample.mapInArrow(vectors, "y double, found array<int>").collect())
    return ToxicityModel(model, features, *fit_logistic(rows, len(features)))


def score_toxicity(docs: DataFrame, fitted: ToxicityModel, text: str = "text") -> DataFrame:
    """Add ``score``, the probability that a text is toxic; an input column of the name gives way.

    Each text is scored alone and whole, so copies agree; null and empty texts
    get the score of a text without known words. An empty table gives an empty
    result, and nothing is shuffled.
    """
    sent = docs.sparkSession.sparkContext.broadcast((fitted.model, fitted.features, fitted.weights, fitted.bias))
    kept = [c for c in docs.columns if c.lower() != "score" and c != text]
    rows = batched(docs).select(F.struct(*([F.col(c) for c in kept] or [F.lit(0)])).alias("row"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ToxicityModel(*sent.value)
        restorer = Restorer(own.model, own.features)
        for batch in batches:
            yield batch.append_column("score", pa.array(own.scores(restorer, texts(batch.column("text"))), pa.float64()))

    done = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, text string, score double")
    return done.select(*[F.col("text").alias(c) if c == text else F.col(f"row.{c}").alias(c) for c in docs.columns if c.lower() != "score"], "score")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fitted = fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return score_toxicity(docs, fitted).select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
