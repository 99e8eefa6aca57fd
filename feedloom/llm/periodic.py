"""Periodic runs of words by Kolpakov and Kucherov's algorithm.

A text's words are factorised by Lempel and Ziv: each factor is the longest
stretch that also starts earlier, which a suffix automaton with the first end
of every state tells.  Runs that touch a boundary between factors are found by
Main's algorithm, from common prefixes and suffixes around that boundary in a
window of twice the two factors; a run strictly inside a factor is the copy of
one at the factor's earlier place.

Each row is one document and is worked on in the task that reads it; nothing is
shuffled.  Work and memory are linear in the words.  A run of at least ``least``
words has every word in a stretch of ``least // 2`` words that occurs twice in the
text, so words outside such stretches cut the text and only the rest goes to the
automaton.

Defined results: a null text has no words, like an empty one; a null id damages
nothing in the query; rows that repeat are each reported; very long texts take
linear time and a few hundred bytes a repeated word.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import WORD, scratch_name, table, tidy

words_of = re.compile(WORD).findall
LEAST = 12
FOUND = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


class SuffixAutomaton:
    """The suffix automaton of a word sequence; most states have one way out, kept in two arrays."""

    def __init__(self, seq: list[int]):
        self.word, self.to, self.more = array("q", [-1]), array("q", [-1]), {}
        self.first_end = array("q", [-1])  # where the state's words first end
        size, link = array("q", [0]), array("q", [-1])
        word, to, more, first_end, step = self.word, self.to, self.more, self.first_end, self.step
        last = 0
        for at, c in enumerate(seq):
            new = len(size)
            size.append(size[last] + 1)
            link.append(0)
            word.append(-1)
            to.append(-1)
            first_end.append(at)
            p = last
            q = -1
            while p >= 0:
                q = step(p, c)
                if q >= 0:
                    break
                if word[p] < 0:
                    word[p], to[p] = c, new
                else:
                    more.setdefault(p, {})[c] = new
                p = link[p]
            if p >= 0:
                if size[p] + 1 == size[q]:
                    link[new] = q
                else:
                    clone = len(size)
                    size.append(size[p] + 1)
                    link.append(link[q])
                    word.append(word[q])
                    to.append(to[q])
                    first_end.append(first_end[q])
                    if q in more:
                        more[clone] = dict(more[q])
                    while p >= 0 and step(p, c) == q:
                        if word[p] == c:
                            to[p] = clone
                        else:
                            more[p][c] = clone
                        p = link[p]
                    link[q] = link[new] = clone
            last = new

    def step(self, state: int, c: int) -> int:
        if self.word[state] == c:
            return self.to[state]
        others = self.more.get(state)
        return others.get(c, -1) if others else -1


def factors(seq: list[int]) -> Iterator[tuple[int, int, int]]:
    """(start, length, start of an earlier occurrence or -1) of each Lempel-Ziv factor."""
    auto, n, at = SuffixAutomaton(seq), len(seq), 0
    step, first_end = auto.step, auto.first_end
    while at < n:
        state, size, earlier = 0, 0, -1
        while at + size < n:
            state = step(state, seq[at + size])
            begin = first_end[state] - size
            if begin >= at:
                break
            size, earlier = size + 1, begin
        yield at, max(size, 1), earlier
        at += max(size, 1)


def prefix_lengths(seq: list[int]) -> list[int]:
    """For each place, how many words from there on equal those from the start."""
    n = len(seq)
    out = [0] * n
    if n:
        out[0] = n
    lo = hi = 0
    for i in range(1, n):
        k = min(hi - i, out[i - lo]) if i < hi else 0
        while i + k < n and seq[k] == seq[i + k]:
            k += 1
        out[i] = k
        if i + k > hi:
            lo, hi = i, i + k
    return out


def touching(seq: list[int], at: int, size: int, left: int) -> Iterator[tuple[int, int, int]]:
    """Main's algorithm: (start, end, period) of repetitions that touch ``at``, start within ``left`` words before it
    and end within ``size`` words after it."""
    before, after = seq[at - left : at], seq[at : at + size]
    back = before[::-1]
    n = len(seq)

    def whole(lo: int, hi: int, p: int) -> bool:
        """Whether no neighbour continues the period; what goes on is found at a later boundary."""
        return (hi == n or seq[hi] != seq[hi - p]) and (lo == 0 or seq[lo - 1] != seq[lo - 1 + p])

    on, off = prefix_lengths(after), prefix_lengths(back)
    ahead = prefix_lengths(back + [-1] + after[::-1] + back)  # suffixes common with those that end in `after`
    for p in range(1, size + 1):
        forth = on[p] if p < size else 0
        behind = min(ahead[left + 1 + size - p], left)
        if forth + behind >= p and whole(at - behind, at + p + forth, p):
            yield at - behind, at + p + forth, p
    astern = prefix_lengths(after + [-1] + before + after)  # prefixes common with those that begin in `before`
    for p in range(1, left + 1):
        forth = min(astern[size + 1 + left - p], size)
        behind = off[p] if p < left else 0
        if forth + behind >= p and whole(at - p - behind, at + forth, p):
            yield at - p - behind, at + forth, p


def kolpakov_kucherov(seq: list[int], least: int = LEAST) -> dict[tuple[int, int], int]:
    """{(start, end): smallest period} of the runs of at least ``least`` elements."""
    found: dict[tuple[int, int], int] = {}
    ends_at: dict[int, set[int]] = {}  # by start

    def add(lo: int, hi: int, p: int) -> None:
        if hi - lo >= least and p < found.get((lo, hi), p + 1):
            found[lo, hi] = p
            ends_at.setdefault(lo, set()).add(hi)

    n, previous = len(seq), 0
    for at, size, earlier in factors(seq):
        if 2 * (previous + size) > least:  # a run that ends in this factor is shorter than that
            for run in touching(seq, at, size, min(at, 2 * (previous + size))):
                add(*run)
        if size > least + 1 and earlier >= 0:
            shift = at - earlier
            for lo in range(earlier + 1, earlier + size - least):
                for hi in ends_at.get(lo, ()):
                    if hi < earlier + size:
                        add(lo + shift, hi + shift, found[lo, hi])
        previous = size
    for run in touching(seq, n, 0, min(n, 2 * previous)):
        add(*run)
    return found


def stretches(ids: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """The stretches of at least ``least`` words whose every word lies in a window of ``least // 2`` words that occurs twice.

    Windows are compared by hash: equal ones are never missed.
    """
    k, n = max(least // 2, 1), len(ids)
    if n < least:
        return []
    key = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        key = (key ^ ids[j : n - k + 1 + j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return []
    twice = np.zeros(len(key) + 1, np.int32)
    twice[order[1:][same]] = 1
    twice[order[:-1][same]] = 1
    starts = np.zeros(n + 1, np.int32)
    starts[: n - k + 1] += twice[:-1]
    starts[k : n + 1] -= twice[:-1]
    covered = np.concatenate([[0], np.cumsum(starts[:n]) > 0, [0]]).astype(np.int8)
    edges = np.flatnonzero(np.diff(covered))
    return [(int(lo), int(hi)) for lo, hi in zip(edges[::2], edges[1::2], strict=True) if hi - lo >= least]


def runs(words: list, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of every run of at least ``least`` words and twice its period, in order."""
    if len(words) < least:
        return []
    known: dict = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    found = []
    for lo, hi in stretches(ids, least):
        found += [(lo + a, b - a, p) for (a, b), p in kolpakov_kucherov(ids[lo:hi].tolist(), least).items()]
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept_words(words: list[str], found: list[tuple[int, int, int]]) -> list[str]:
    """The words that no run contains after its first period."""
    if not found:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    return [w for w, d in zip(words, np.cumsum(change[:-1]), strict=True) if d == 0]


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def report(words: list[str], least: int = LEAST) -> tuple:
    """The columns ``FOUND`` of one text."""
    found = runs(words, least)
    longest = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    best = (*longest, 1000 * longest[1] // longest[2]) if longest else (None,) * 4
    return len(found), *best, _sha("".join(f"{s},{n},{p}\n" for s, n, p in found)), _sha(" ".join(kept_words(words, found)))


def with_repeated_tail(words: list[str], doc_id: int | None) -> list[str]:
    """One text in ten gets a tail that repeats one of its stretches, by the id's crc32."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    block = words[a : a + p]
    return words[:a] + (block * ((n - a) // p + 1))[: n - a]


def _reported(least: int, change: Callable | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some, out = batch.slice(at, 256), []
                for key, text in zip(some.column(0), some.column(1), strict=True):
                    words = words_of(text.as_py() or "")
                    out.append(report(change(words, key.as_py()) if change else words, least))
                columns = [some.column(0)]
                for field, values in zip(FOUND.split(", "), zip(*out, strict=True), strict=True):
                    columns.append(pa.array(values, pa.string() if field.endswith("string") else pa.int64()))
                yield pa.RecordBatch.from_arrays(columns, names=[batch.schema.names[0], *(f.split()[0] for f in FOUND.split(", "))])

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, change: Callable | None = None) -> DataFrame:
    """One row a document: number of runs, the longest one, digests of all runs and of the text without repeats.

    ``change(words, id)`` may replace the words first.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("__text"))
    return rows.mapInArrow(tidy(_reported(least, change)), f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, {FOUND}")


def without_repeats(docs: DataFrame, text_col: str = "text", least: int = LEAST) -> DataFrame:
    """``docs`` with every run of a text shortened to its first period and words joined by one space; texts without
    runs stay as they are."""
    at, name = docs.columns.index(text_col), scratch_name(docs, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(at):
                words = words_of(text.as_py() or "")
                found = runs(words, least)
                out.append(" ".join(kept_words(words, found)) if found else text.as_py())
            yield batch.append_column(name, pa.array(out, pa.string()))

    short = docs.mapInArrow(tidy(run), StructType([*docs.schema.fields, StructField(name, StringType())]))
    return short.select(*[F.col(f"`{name}`").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), change=with_repeated_tail)
