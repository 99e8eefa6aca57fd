"""Toxicity by a weighted lexicon, matched with Aho-Corasick.

Texts are folded first: lower case, homoglyphs and accents to plain Latin
letters, digits and signs that stand for letters inside a word to those
letters, anything else to one space.  ``i``, ``l``, ``1``, ``!`` and ``|`` are
one letter after folding, on both sides.

The lexicon is learned from labelled rows: whole words and beginnings of words
with their log odds.  A beginning counts only where ``SHARED`` or more different words of toxic
documents have it and none of them makes up more than half of its occurrences, so that "worthless" and
"pathetic" say nothing of "worth" and "path"; a whole word also stands for its forms with a
known ending, unless labelled documents show such a form to be harmless.  At each place only the heaviest match counts, and none
inside an exception phrase.  The sum is normalised by the text's length; a
logistic curve with few coefficients brings it to a probability.

Fitting reads at most ``max_rows`` labelled documents of each label, those with
the least hash of their id; statistics of those are aggregated on the executors
and only the lexicon (``max_terms``) and a few numbers a document reach the
driver.  In the curve the sampled documents weigh as all labelled ones of their
label do, so the bound doesn't shift the scores.

Defined results: null and empty texts have no match and get the score of a
text without matches.  Labels that are null, or of no document, teach nothing;
without any toxic label every score is 0.  Of repeated labels the largest
counts, and of rows that repeat a labelled id the largest text teaches.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table, tidy

#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = dict(zip("аеорсухіјѕԁһӏкмтвнгпΑαΒβΕεΖΗΙιΚκΜΝνΟοΡρΤτΥυΧχ", "aeopcyxijsdhikmtbhrnaabbeezhiikkmnvooppttyyxx", strict=True))
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i"}
#: Phrases in which a word of the lexicon means no harm; fixed values.
EXCEPTIONS = (
    "trash can", "trash bin", "trash bag", "trash day", "clown fish", "sore loser rule", "idiot proof", "idiot light", "idiot board", "stupid simple", "keep it simple stupid",
    "dumb waiter", "dumb bell", "dumb terminal", "struck dumb", "moron test", "garbage collector", "garbage collection", "garbage truck", "pond scum", "soap scum", "scum line",
    "pathetic fallacy", "loser bracket", "worthless check", "toxic waste", "toxic asset", "killer whale", "killer app", "kill process", "kill switch",
)
PREFIX = range(4, 10)
SHARED = 2
#: Endings with which a learned word keeps its meaning; fixed values.
ENDINGS = ("s", "es", "ed", "er", "ers", "ing", "ly", "y", "ish", "ness", "e", "en", "n", "os", "as")

_table = {ord(k): v for k, v in HOMOGLYPHS.items()} | {ord("l"): "i", ord("ı"): "i", 0x200B: None, 0x200C: None, 0x200D: None, 0xAD: None}
for _c in map(chr, range(0xC0, 0x250)):
    _d = unicodedata.normalize("NFKD", _c)[0].lower()
    if _d != _c and _d.isascii() and _d.isalpha():
        _table[ord(_c)] = "i" if _d == "l" else _d
_leet = re.compile(r"(?<=[^\W\d_])[013457@$!|]+(?=\w)|\b[013457@$]+(?=[^\W\d_])|(?<=[^\W\d_])[013457]+\b")
_gap = re.compile(r"[\W\d_]+")
_swap = str.maketrans(LEET)


def fold(text: str | None) -> str:
    """Folded text, with a space at both ends."""
    t = text or ""
    if not t.isascii() and not unicodedata.is_normalized("NFKC", t):
        t = unicodedata.normalize("NFKC", t)
    t = t.lower().translate(_table)
    t = _leet.sub(lambda m: m[0].translate(_swap), t)
    return f" {_gap.sub(' ', t).strip()} "


def forms(pattern: str) -> list[str]:
    """A whole word's patterns with the known endings."""
    return [f"{pattern[:-1]}{fold(e).strip()} " for e in ENDINGS] if pattern.endswith(" ") and len(pattern) > 5 else []


def terms(folded: str) -> set[str]:
    """Whole words `` w `` and beginnings of words `` w``."""
    words = set(folded.split())
    return {f" {w} " for w in words} | {f" {w[:k]}" for w in words for k in PREFIX if k <= len(w)}


@dataclass
class Lexicon:
    """Weights of folded patterns, phrases that cancel them, and the curve."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)
    fitted: bool = False

    def automaton(self):
        auto = ahocorasick.Automaton()
        for p, w in self.weights.items():
            auto.add_word(p, (len(p), w, False))
        for p in self.exceptions:
            auto.add_word(q := fold(p)[:-1], (len(q), 0.0, True))
        if len(auto):
            auto.make_automaton()
        return auto

    def features(self, auto, text: str | None) -> tuple[float, float]:
        """The sum of weights normalised by length, and the heaviest match."""
        folded = fold(text)
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        if len(auto):
            for end, (n, w, spare) in auto.iter(folded):
                at = end - n + 1
                if spare:
                    spared.append((at, end))
                elif w > best.get(at, 0.0):
                    best[at] = w
        for lo, hi in spared:
            for at in [k for k in best if lo <= k < hi]:
                del best[at]
        if not best:
            return 0.0, 0.0
        return math.log1p(sum(best.values()) / math.sqrt(folded.count(" "))), max(best.values())

    def probability(self, total, heaviest):
        """Works on numbers and on arrays; 0 before fitting."""
        if not self.fitted:
            return np.zeros_like(np.asarray(total, float))
        a, b, c = self.curve
        return 1.0 / (1.0 + np.exp(-(a * np.asarray(total) + b * np.asarray(heaviest) + c)))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            pos, neg = Counter(), Counter()
            for text, toxic in zip(batch.column(0).slice(at, 500).to_pylist(), batch.column(1).slice(at, 500).to_pylist(), strict=True):
                (pos if toxic else neg).update(terms(fold(text)))
            names = list(pos.keys() | neg.keys())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([pos[t] for t in names], pa.int64()), pa.array([neg[t] for t in names], pa.int64())], names=["term", "pos", "neg"])


def _features(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = lexicon.automaton()
        for batch in batches:
            found = [lexicon.features(auto, t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([x for x, _ in found], pa.float64()), pa.array([x for _, x in found], pa.float64())], names=["y", "total", "heaviest"])

    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 4000, max_terms: int = 5000, min_rows: int = 4, min_ratio: float = 20.0) -> Lexicon:
    """Learn a lexicon from at most ``max_rows`` rows of each label."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("l_id")).agg(F.max((F.col(label_col) == 1).cast("int")).alias("y"))
    known = staged(known, "labels")
    some = [known.filter(F.col("y") == y).orderBy(F.xxhash64("l_id"), "l_id").limit(max_rows) for y in (0, 1)]
    chosen = F.broadcast(staged(some[0].unionByName(some[1]), "chosen"))  # 2 * max_rows rows at most
    texts = docs.select(F.col(id_col).alias("d_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    met = texts.join(chosen, F.col("d_id") == F.col("l_id")).groupBy("l_id", "y").agg(F.max("text").alias("text"))
    rows = staged(met.select("text", "y"), "labelled").repartition(24)
    n = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1:
        return Lexicon()
    every = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    weight = {y: every[y] / n[y] for y in n}
    counted = rows.mapInArrow(tidy(_counts), "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    odds = F.log(((F.col("pos") + 0.5) / (n1 + 1.0)) / ((F.col("neg") + 0.5) / (n0 + 1.0)))
    counted = staged(counted, "terms")
    whole = counted.filter(F.col("term").endswith(" "))
    begin = F.explode(F.transform(F.filter(F.sequence(F.lit(PREFIX[0]), F.lit(PREFIX[-1])), lambda k: k <= F.char_length("term") - 2), lambda k: F.substr("term", F.lit(1), k + 1)))
    shared = whole.filter("pos > 0").select("pos", begin.alias("begin")).groupBy("begin").agg(F.count("*").alias("n"), F.max("pos").alias("most"), F.sum("pos").alias("all")).filter((F.col("n") >= SHARED) & (2 * F.col("most") <= F.col("all")))
    fit_terms = whole.unionByName(counted.join(shared, F.col("term") == F.col("begin"), "left_semi"))
    top = fit_terms.filter(F.col("pos") >= min(min_rows, n1)).withColumn("w", odds).filter(F.col("w") >= math.log(min_ratio)).withColumn("gain", F.col("w") * F.sqrt("pos"))
    found = top.orderBy(F.desc("gain"), "term").limit(max_terms).collect()
    lexicon = Lexicon({r["term"]: round(r["w"], 6) for r in found})
    inflected: dict[str, float] = {}
    for p, w in lexicon.weights.items():
        for form in forms(p):
            inflected[form] = max(w, inflected.get(form, 0.0))
    if inflected:  # max_terms times the endings at most
        asked = docs.sparkSession.createDataFrame([(t,) for t in sorted(inflected)], "term string")
        harmless = {r["term"] for r in counted.join(asked, "term").filter((F.col("neg") > 0) & (odds < math.log(min_ratio))).select("term").collect()}
        lexicon.weights = {t: w for t, w in inflected.items() if t not in harmless} | lexicon.weights
    seen = rows.mapInArrow(tidy(_features(lexicon)), "y int, total double, heaviest double").collect()  # 2 * max_rows rows at most
    seen = sorted(seen)
    x, y = np.array([[r["total"], r["heaviest"], 1.0] for r in seen]), np.array([r["y"] for r in seen], float)
    lexicon.curve = _logistic(x, y, np.array([weight[r["y"]] for r in seen]))
    lexicon.fitted = True
    return lexicon


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> tuple[float, float, float]:
    """Ridge logistic regression of weighted rows by Newton's steps."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge * w
        hess = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def _scored(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = lexicon.automaton()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                found = np.array([lexicon.features(auto, t.as_py()) for t in batch.column(batch.num_columns - 1).slice(at, 512)]).reshape(-1, 2)
                score = lexicon.probability(found[:, 0], found[:, 1])
                yield pa.RecordBatch.from_arrays([*(c.slice(at, 512) for c in batch.columns[:-1]), pa.array(score, pa.float64()), pa.array(found[:, 0], pa.float64())], names=[*batch.schema.names[:-1], "score", "density"])

    return run


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, score, density."""
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("__text"))
    return rows.mapInArrow(tidy(_scored(lexicon)), f"`{id_col}` long, score double, density double")


def taught(labels: DataFrame) -> DataFrame:
    """The labels that may be learned from: crc32 of the id's text, modulo 4, is not 2."""
    return labels.filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)


def drop_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with a score below the threshold, with all their columns."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = lexicon.automaton()
        at = names.index(text_col)
        for batch in batches:
            found = np.array([lexicon.features(auto, t.as_py()) for t in batch.column(at)]).reshape(-1, 2)
            yield batch.filter(pa.array(lexicon.probability(found[:, 0], found[:, 1]) < threshold))

    return docs.mapInArrow(tidy(run), docs.schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, taught(table(spark, sf_dir, "labels"))))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "density")
