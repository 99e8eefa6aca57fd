"""Language by a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are cut into windows of ``WINDOW``; the network reads each
window from both ends, labels every byte with the probabilities of the
languages, and the mean over all bytes of the text is the document's.  Every
byte of every text is read once.

Training is backpropagation through time in numpy, on the driver, from at most
``per_lang`` documents of each of the ``max_langs`` most frequent languages and
``per_doc`` windows of each document: ``max_langs * per_lang * per_doc * WINDOW``
bytes.  Documents are chosen by hash.  The model is a few kilobytes and goes to
the tasks with their function.  Nothing is shuffled for prediction.

Defined results: a null text and one without letters are ``und`` with score 0;
so is every text when there is nothing to learn from.  A null language teaches
nothing.  Rows that repeat are each labelled.  Very long texts take memory for
some thousand windows at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table, tidy

WINDOW, PAD, TOGETHER = 128, 256, 2048
UNKNOWN = "und"
_letter = re.compile(r"[^\W\d_]").search


def windows(data: bytes, size: int = WINDOW) -> np.ndarray:
    """The bytes in rows of ``size``, the last one padded."""
    n = max(1, -(-len(data) // size))
    out = np.full(n * size, PAD, np.int16)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(n, size)


def _squash(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    """Weights of both directions: ``enter`` (byte to gates), ``again`` (state to gates), ``leave`` (state to labels).

    Gates are in the order update, reset, candidate; arrays hold features by rows and sequences by columns.
    """

    langs: list[str]
    enter: np.ndarray  # (2, 3h, 257)
    again: np.ndarray  # (2, 3h, h)
    leave: np.ndarray  # (2, labels, h)
    bias: np.ndarray  # (labels, 1)

    @classmethod
    def start(cls, langs: list[str], hidden: int, rng: np.random.Generator) -> Network:
        draw = lambda *shape, by: (rng.standard_normal(shape) * by).astype(np.float32)
        return cls(langs, draw(2, 3 * hidden, PAD + 1, by=0.3), draw(2, 3 * hidden, hidden, by=hidden**-0.5), draw(2, len(langs), hidden, by=hidden**-0.5), np.zeros((len(langs), 1), np.float32))

    def weights(self) -> list[np.ndarray]:
        return [self.enter, self.again, self.leave, self.bias]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """The mean loss over all bytes of ``x`` (sequences by rows) with labels ``y``, and its gradients by backpropagation through time."""
        x = x.T
        steps, n = x.shape
        h = self.again.shape[2]
        real = x != PAD
        logits = np.broadcast_to(self.bias, (steps, len(self.langs), n)).copy()
        memory = []
        for side in (0, 1):
            state, past = np.zeros((h, n), np.float32), [None] * steps
            for t in range(steps) if side == 0 else range(steps - 1, -1, -1):
                a, g = self.enter[side][:, x[t]], self.again[side] @ state
                gates = _squash(a[: 2 * h] + g[: 2 * h])
                z, r = gates[:h], gates[h:]
                new = np.tanh(a[2 * h :] + r * g[2 * h :])
                past[t] = (state, z, r, new, g[2 * h :])
                state = new + z * (state - new)
                logits[t] += self.leave[side] @ state
            memory.append(past)
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        at = np.arange(n)
        total = max(int(real.sum()), 1)
        loss = -float((np.log(p[:, y, at] + 1e-9) * real).sum()) / total
        p[:, y, at] -= 1
        p *= real[:, None, :] / total
        enter, again, leave = np.zeros_like(self.enter), np.zeros_like(self.again), np.zeros_like(self.leave)
        for side in (0, 1):
            back, out = np.zeros((h, n), np.float32), np.empty((steps, 3 * h, n), np.float32)
            for t in range(steps - 1, -1, -1) if side == 0 else range(steps):
                state, z, r, new, g = memory[side][t]
                leave[side] += p[t] @ (new + z * (state - new)).T
                back = back + self.leave[side].T @ p[t]
                d_new = back * (1 - z) * (1 - new * new)
                d_update, d_reset = back * (state - new) * z * (1 - z), d_new * g * r * (1 - r)
                d_gates = np.concatenate([d_update, d_reset, d_new * r])
                out[t] = np.concatenate([d_update, d_reset, d_new])
                again[side] += d_gates @ state.T
                back = back * z + self.again[side].T @ d_gates
            flat = x.ravel()
            order = np.argsort(flat, kind="stable")
            which, begin = np.unique(flat[order], return_index=True)
            enter[side][:, which] = np.add.reduceat(out.transpose(0, 2, 1).reshape(-1, 3 * h)[order], begin, axis=0).T
        return loss, [enter, again, leave, p.sum(axis=(0, 2))[:, None]]

    def pooled(self, x: np.ndarray) -> np.ndarray:
        """For each window (rows of ``x``) the sum of its bytes' label probabilities."""
        x = np.ascontiguousarray(x.T)
        steps, n = x.shape
        h, labels = self.again.shape[2], len(self.langs)
        half = np.concatenate([np.full(2 * h, 0.5, np.float32), np.ones(h, np.float32)])[:, None]
        logits = np.broadcast_to(self.bias, (steps, labels, n)).copy()
        a, g, product = np.empty((3 * h, n), np.float32), np.empty((3 * h, n), np.float32), np.empty((labels, n), np.float32)
        for side in (0, 1):
            enter, again, leave = self.enter[side] * half, self.again[side] * half, self.leave[side]
            state = np.zeros((h, n), np.float32)
            for t in range(steps) if side == 0 else range(steps - 1, -1, -1):
                np.take(enter, x[t], axis=1, out=a, mode="clip")
                np.matmul(again, state, out=g)
                gates, new = a[: 2 * h], a[2 * h :]
                gates += g[: 2 * h]
                np.tanh(gates, out=gates)
                gates *= 0.5
                gates += 0.5
                g[2 * h :] *= gates[h:]
                new += g[2 * h :]
                np.tanh(new, out=new)
                state -= new
                state *= gates[:h]
                state += new
                np.matmul(leave, state, out=product)
                logits[t] += product
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        logits *= (x != PAD)[:, None, :]
        return logits.sum(axis=0).T

    def probabilities(self, texts: list[str]) -> np.ndarray:
        """One row a text: the mean of its bytes' label probabilities."""
        cut = [windows(t.encode("utf-8", "surrogatepass")) for t in texts]
        owner = np.repeat(np.arange(len(cut)), [len(c) for c in cut])
        rows, out = np.concatenate(cut), np.zeros((len(cut), len(self.langs)))
        for at in range(0, len(rows), TOGETHER):
            np.add.at(out, owner[at : at + TOGETHER], self.pooled(rows[at : at + TOGETHER]))
        return out / np.maximum(out.sum(axis=1, keepdims=True), 1e-9)


def train(x: np.ndarray, y: np.ndarray, langs: list[str], hidden: int = 8, epochs: int = 12, together: int = 256, rate: float = 0.02, seed: int = 5) -> Network:
    """Adam on minibatches of windows, each language weighing the same."""
    rng = np.random.default_rng(seed)
    net = Network.start(langs, hidden, rng)
    first, second = [np.zeros_like(w) for w in net.weights()], [np.zeros_like(w) for w in net.weights()]
    counts = np.bincount(y, minlength=len(langs))
    each, step = int(counts.max()), 0
    for epoch in range(epochs):
        order = np.concatenate([rng.choice(np.flatnonzero(y == k), each, replace=counts[k] < each) for k in range(len(langs))])
        rng.shuffle(order)
        for at in range(0, len(order), together):
            some = order[at : at + together]
            _, grads = net.gradients(x[some], y[some])
            step += 1
            norm = max(1.0, float(np.sqrt(sum((g * g).sum() for g in grads))))
            for w, g, m, v in zip(net.weights(), grads, first, second, strict=True):
                g = g / norm
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= rate * (1 - epoch / epochs) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return net


def _samples(per_doc: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, cut = [], []
            for lang, text, h in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = windows(text.encode("utf-8", "surrogatepass"))
                for k in np.random.default_rng([abs(h), seed]).permutation(len(rows))[:per_doc]:
                    langs.append(lang)
                    cut.append(bytes(rows[k][rows[k] != PAD].astype(np.uint8)))
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(cut, pa.binary())], names=["lang", "cut"])

    return run


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 500, per_doc: int = 2, max_langs: int = 200, hidden: int = 8, epochs: int = 12, seed: int = 5) -> Network | None:
    """A network learned from a bounded sample of the rows of ``docs`` that have a language, or None without any."""
    known = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("h")).filter("lang IS NOT NULL AND text IS NOT NULL")
    known = known.filter(F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs).collect()}
    langs = sorted(counts)
    if not langs:
        return None
    # Hashes below a threshold leave about twice the wanted rows of each language, so no task ranks all rows of a frequent one.
    limits = F.create_map(*[F.lit(v) for lang in langs for v in (lang, min(1 << 30, 2 * per_lang * (1 << 30) // counts[lang] + 1))])
    few = known.filter(F.col("lang").isin(langs)).select("lang", "h").filter(F.pmod("h", F.lit(1 << 30)) < F.element_at(limits, F.col("lang")))
    ranked = few.distinct().withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
    chosen = F.broadcast(staged(ranked.filter(F.col("k") <= per_lang).select("lang", "h"), "chosen"))  # max_langs * per_lang rows at most
    texts = known.join(chosen, ["lang", "h"]).dropDuplicates(["lang", "h"]).select("lang", "text", "h")
    rows = sorted((r["lang"], bytes(r["cut"])) for r in texts.mapInArrow(tidy(_samples(per_doc, seed)), "lang string, cut binary").collect())
    x = np.concatenate([windows(cut) for _, cut in rows])
    y = np.array([langs.index(lang) for lang, _ in rows])
    return train(x, y, langs, hidden, epochs, seed=seed)


def _labelled(net: Network | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                texts, held = [], 0
                while at + len(texts) < batch.num_rows and held < 4 * TOGETHER * WINDOW and len(texts) < 2048:
                    text = batch.column(1)[at + len(texts)].as_py() or ""
                    texts.append(text if net is not None and _letter(text) else "")
                    held += len(texts[-1])
                some = [k for k, t in enumerate(texts) if t]
                lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
                if some:
                    p = net.probabilities([texts[k] for k in some])
                    for k, best, value in zip(some, p.argmax(axis=1), p.max(axis=1), strict=True):
                        lang[k], score[k] = net.langs[best], min(float(value), 1.0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[batch.schema.names[0], "lang_pred", "score"])
                at += len(texts)

    return run


def label(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, lang_pred, score."""
    rows = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("__text"))
    return rows.mapInArrow(tidy(_labelled(net)), f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double")


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    part = F.crc32(F.col("doc_id").cast("string")) % 3
    out = label(docs, fit(docs.filter(part != 1)))
    return out.select("doc_id", F.coalesce(part == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
