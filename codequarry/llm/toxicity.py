"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding lower-cases, replaces look-alike letters and accented ones by the ASCII letter that they
resemble, reads digits and signs inside a word as letters, and writes l as i, which 1, ! and | also
stand for.  A word that ends in digits or signs is read without them, and as letters to its end.  The lexicon and its weights are learned from labelled documents: words that occur in
toxic documents, in ever new surroundings, far more often than in others.  Phrases in which such a
word is mostly harmless are learned as exceptions, and more can be given.

Rows: NULL and empty texts have no words and get the score of a text without hits.  Rows are scored by
themselves, so repeated rows repeat; labels other than 0 and 1 and NULL ids are not learned from.
Without labels of both kinds the score is their share, or 0.5 without labels.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.llm.common import kept_in_worker, labelled_sample, slices, texts

SAMPLE = 10_000  # labelled documents learned from, at most
LEXICON = 2_000  # words of the lexicon, at most
LEAST_DOCS = 5  # toxic documents a word must occur in
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "pond scum")

# Letters of other scripts that look like Latin ones.
LOOKALIKES = dict(zip("абвгдеёзікмнорстухѕјԛԝһӏαβεηικνορτυχγ", "abbrdee3ikmhopctyxsjqwhlaaenikvoptuxy", strict=False)) | {"β": "b", "γ": "y", "ν": "v"}
# Digits and signs read as letters.
DIGITS = dict(zip("0134578@$!|9", "oieastbasiig", strict=True))


class _Folding(dict):
    """What ``str.translate`` writes for a character: its look-alike, worked out when first met."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        base = unicodedata.normalize("NFKD", char).lower()
        kept = "".join(LOOKALIKES.get(c, c) for c in base if unicodedata.category(c) not in ("Mn", "Cf"))
        self[code] = kept
        return kept


_FOLDING = _Folding((c, chr(c)) for c in range(128))
_SIGNS = re.compile(r"[0-9@$!|]+")
_ENDINGS = re.compile(r"[0-9@$!|]+(?![a-z0-9@$!|])")
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789@$!|")
_LETTERS = bytes(b if 0x61 <= b <= 0x7A and b != 0x6C else 0x69 if b == 0x6C else 0x20 for b in range(256))


def _read(match: re.Match) -> str:
    """Digits and signs as letters if letters follow, or digits if letters go before."""
    text, (start, end) = match.string, match.span()
    before = start > 0 and "a" <= text[start - 1] <= "z"
    after = end < len(text) and "a" <= text[end] <= "z"
    run = match.group()
    if after or before and run.isdigit() and len(run) == 1:
        return "".join(DIGITS.get(c, " ") for c in run)
    return run


def _plain(text: str) -> str:
    """Lower case, with look-alikes as the letters they resemble."""
    text = text.lower()
    return text if text.isascii() else text.translate(_FOLDING)


def _words(plain: str) -> list[str]:
    if _SIGNS.search(plain):
        plain = _SIGNS.sub(_read, plain)
    return plain.encode("ascii", "replace").translate(_LETTERS).decode("ascii").split()


def folded_words(text: str) -> list[str]:
    return _words(_plain(text))


def _other_endings(plain: str) -> Iterator[str]:
    """The other reading of words that end in digits or signs: as letters to the end.

    A single digit after letters is read so already.
    """
    for match in _ENDINGS.finditer(plain):
        start, end = match.span()
        if start and "a" <= plain[start - 1] <= "z":
            while start and plain[start - 1] in _WORD:
                start -= 1
            word = plain[start:end]
            if not (word[-1].isdigit() and word[:-1].isalpha()):
                yield "".join(DIGITS.get(c, c) for c in word).replace("l", "i")


@dataclass(frozen=True)
class Model:
    """Weights of folded words, exception phrases, and the curve from evidence to score."""

    weights: dict[str, float]
    exceptions: tuple[str, ...]
    curve: tuple[float, float, float]  # constant, for the evidence, for the evidence per word
    name: str = field(default_factory=lambda: uuid.uuid4().hex)


class Lexicon:
    """The automaton of a model's words and exceptions."""

    def __init__(self, model: Model):
        self.model, self.automaton = model, ahocorasick.Automaton()
        for word, weight in model.weights.items():
            self.automaton.add_word(f" {word} ", (len(word), weight))
        for phrase in model.exceptions:
            self.automaton.add_word(f" {phrase} ", (len(phrase), 0.0))
        if len(self.automaton):
            self.automaton.make_automaton()

    def evidence(self, words: list[str]) -> float:
        """The weights of all hits that lie in no exception."""
        if not len(self.automaton) or not words:
            return 0.0
        hits = [(end - size, end, weight) for end, (size, weight) in self.automaton.iter(f" {' '.join(words)} ")]
        spared = sorted((a, b) for a, b, w in hits if w == 0.0)
        if not spared:
            return sum(w for _, _, w in hits)
        # of the exceptions that begin no later than a hit, the one that reaches furthest tells
        starts, reach = [a for a, _ in spared], list(accumulate((b for _, b in spared), max))
        total = 0.0
        for a, b, weight in hits:
            before = bisect_right(starts, a)
            if not before or reach[before - 1] < b:
                total += weight
        return total

    def features(self, text: str) -> tuple[float, float]:
        plain = _plain(text)
        words = _words(plain)
        total = self.evidence(words) + sum(self.model.weights.get(w, 0.0) for w in _other_endings(plain))
        return math.log1p(total), math.log1p(100 * total / max(1, len(words)))

    def score(self, text: str) -> float:
        base, total, dense = self.model.curve
        x, y = self.features(text)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, base + total * x + dense * y))))


def _word_counts(sample: DataFrame) -> DataFrame:
    """(word, toxic, clean): documents with each folded word, by label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())
        for batch in batches:
            for text, label in zip(texts(batch), batch.column("label").to_pylist(), strict=True):
                counts[label].update(set(folded_words(text)))
        words = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(words, pa.string()), *(pa.array([counts[k][w] for w in words], pa.int64()) for k in (1, 0))], ["word", "toxic", "clean"]
        )

    counted = sample.select("text", "label").mapInArrow(run, "word string, toxic bigint, clean bigint")
    return counted.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _contexts(sample: DataFrame, words: frozenset[str]) -> DataFrame:
    """(word, before, after, label), distinct: what stands around the given words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = set()
            for text, label in zip(texts(batch), batch.column("label").to_pylist(), strict=True):
                found = ["", *folded_words(text), ""]
                seen.update((w, found[i], found[i + 2], label) for i, w in enumerate(found[1:-1]) if w in words)
            yield pa.RecordBatch.from_arrays(
                [pa.array([s[k] for s in seen], pa.string() if k < 3 else pa.int32()) for k in range(4)], ["word", "before", "after", "label"]
            )

    return sample.select("text", "label").mapInArrow(run, "word string, before string, after string, label int").distinct()


def _curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float, float]:
    """Logistic regression with a small ridge, by Newton's method."""
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def fit(docs: DataFrame, labels: DataFrame, trained: Column, rows: int = SAMPLE, exceptions: tuple[str, ...] = EXCEPTIONS) -> Model:
    """Learn from at most ``rows`` labelled documents, of the label rows that ``trained`` allows."""
    sample = labelled_sample(docs, labels, "toxic", trained, rows).select("text", "label").persist()
    try:
        sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
        toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
        given = tuple(" ".join(folded_words(e)) for e in exceptions)
        if not toxic or not clean:
            share = toxic / (toxic + clean) if toxic + clean else 0.5
            return Model({}, given, (math.log((share + 1e-6) / (1 - share + 1e-6)), 0.0, 0.0))
        odds = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (clean + 1.0))
        error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
        likely = _word_counts(sample).where(F.col("toxic") >= LEAST_DOCS).withColumn("z", odds / error).where("z >= 3")
        words = {r["word"]: r["toxic"] for r in likely.orderBy(F.desc("z"), "word").limit(LEXICON).collect()}
        around = _contexts(sample, frozenset(words))
        counts = around.groupBy("word").agg(F.count_if(F.col("label") == 1).alias("toxic"), F.count_if(F.col("label") == 0).alias("clean"))
        weights = {}
        for r in counts.collect():
            # copies of one text repeat their surroundings; a lexicon's word has as many as documents, or more
            if r["toxic"] < max(LEAST_DOCS, words[r["word"]] / 2) or r["toxic"] < 2 * r["clean"]:
                continue
            weights[r["word"]] = math.log((r["toxic"] + 0.5) / (toxic + 1)) - math.log((r["clean"] + 0.5) / (clean + 1))
        weights = {w: v for w, v in weights.items() if v > 0}
        kept = around.where(F.col("word").isin(*weights)) if weights else around.limit(0)
        pairs = kept.select(
            F.explode(F.array(F.concat_ws(" ", "before", "word"), F.concat_ws(" ", "word", "after"))).alias("phrase"), "label"
        ).where("phrase LIKE '_% _%'")
        harmless = pairs.groupBy("phrase").agg(F.count_if(F.col("label") == 0).alias("clean"), F.count(F.lit(1)).alias("all"))
        learned = harmless.where((F.col("clean") >= LEAST_DOCS) & (F.col("clean") >= 0.8 * F.col("all"))).orderBy(F.desc("clean"), "phrase").limit(LEXICON)
        model = Model(weights, (*given, *(r["phrase"] for r in learned.collect())), (0.0, 0.0, 0.0))
        rows_ = _evidence(sample, model).collect()
        curve = _curve(np.array([[r["x"], r["y"]] for r in rows_]), np.array([r["label"] for r in rows_], float))
        return Model(weights, model.exceptions, curve)
    finally:
        sample.unpersist()


def _evidence(sample: DataFrame, model: Model) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(model)
        for batch in batches:
            found = [lexicon.features(t) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([f[k] for f in found], pa.float64()) for k in range(2)), batch.column("label")], ["x", "y", "label"]
            )

    return sample.select("text", "label").mapInArrow(run, "x double, y double, label int")


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row; the model is at most ``LEXICON`` words and phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = kept_in_worker("lexicon", model.name, lambda: Lexicon(model))
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([lexicon.score(t) for t in texts(part)], pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
