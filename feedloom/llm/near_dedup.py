"""MinHash near-duplicates by SuperMinHash signatures.

A document's set holds its distinct shingles of ``words`` words, each as a
64-bit hash.  SuperMinHash gives every element a permutation of the signature's
places and uniform ranks in [j, j+1) at its j-th place, so the ranks of one
element are correlated and the estimate varies less than with independent
hashes.  Places hold the least rank seen; once every place is below j no
element needs its j-th place, so a long document stops after a few places.

Signatures are cut into bands.  Documents with equal sets are first collapsed
into one class, so copies of a text cost one row whatever their number.  Within
a bucket (equal band) pairs are *not* all made.  First one member leads, the
one that shares most buckets with most others, and the rest are verified
against it; verified links merge components.  Only pairs of different
components are left then: small buckets give theirs, and members of large ones
meet on the rare shingles that any two sets of that similarity share, which is
exact.  Components are found by union by minimum with pointer jumping, as joins.

Defined results: a null or empty text, or one of white space only, has an empty
set and links with nothing; a document shorter than a shingle has its whole
word sequence as the one shingle.  Rows with a null id link with nothing, get a
null component and are kept.  Rows that share an id are one node: each links
what any of them links.

A hot class (copies of one text), bucket or leader is met by broadcast or spread
over several tasks, and only documents that share a bucket have their text moved.
Pairs first meet on marks, 16 bits of each shingle's hash, which bound how many
shingles two sets can share; full sets move for the pairs that the bound leaves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frequent, join_counted, key_filter, might_hold, scratch_name, staged, table, tidy, unstage

M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
GOLD = np.uint64(0x9E3779B97F4A7C15)
CACHE = 300_000


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Hashes of words, kept while they are few enough for a worker's memory."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_hashes = WordHashes()


def forget_words() -> None:
    _hashes.clear()


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a whole text."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z, and the six ASCII white-space characters
    if not parts:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, parts), np.uint64, len(parts))
    k = min(words, len(parts))
    out = mix64(h[: len(h) - k + 1] + np.uint64(int(GOLD) * k % 2**64))
    for i in range(1, k):
        out = mix64(out * np.uint64(3) + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def signatures(sets: list[np.ndarray], m: int) -> np.ndarray:
    """SuperMinHash signatures of non-empty sets, one row each."""
    n = len(sets)
    h = np.full((n, m), np.inf)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    elems = np.concatenate(sets)
    perm = None
    for j in range(m):
        if j:
            need = h.max(axis=1) > j  # early stopping, document by document
            if not need.any():
                break
            live = need[owner]
            owner, elems = owner[live], elems[live]
            perm = np.broadcast_to(np.arange(m, dtype=np.uint8), (len(elems), m)).copy() if perm is None else perm[live]
            if j == 1:  # redo the first swap of the permutation
                at = first_slot[live]
                rows = np.arange(len(elems))
                perm[rows, at], perm[rows, 0] = 0, at.astype(np.uint8)
        r = mix64(elems + np.uint64(int(GOLD) * (j + 1) % 2**64))
        slot = j + ((r & np.uint64(0xFFFFFFFF)) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64)
        rank = j + (r >> np.uint64(32)).astype(np.float64) / 2.0**32
        if perm is None:
            first_slot, place = slot, slot
        else:
            rows = np.arange(len(elems))
            place = perm[rows, slot].astype(np.int64)
            perm[rows, slot] = perm[rows, j]
            perm[rows, j] = place
        np.minimum.at(h.reshape(-1), owner * m + place, rank)
    return h


def _scan(words: int, m: int, bands: int):
    rows = m // bands

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at in range(0, batch.num_rows, 64):
                sets = [shingles(t.as_py(), words) for t in texts.slice(at, 64)]
                full = [i for i, s in enumerate(sets) if len(s)]
                keys, cut = [None] * len(sets), [None] * len(sets)
                if full:
                    sig = np.ascontiguousarray(signatures([sets[i] for i in full], m).reshape(len(full), bands, rows))
                    for i, s in zip(full, sig, strict=True):
                        keys[i] = xxhash.xxh3_128_digest(sets[i].tobytes())
                        cut[i] = [xxhash.xxh64_intdigest(s[b].tobytes(), seed=b) - 2**63 for b in range(bands)]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, 64), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(cut, pa.list_(pa.int64()))],
                    names=["id", "n_shingles", "key", "bands"],
                )

    return scan


def _sets(words: int):
    """The sets of classes and their marks: rows whose text has another set than the class don't count."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                node, key, text = (batch.column(k).slice(at, 64).to_pylist() for k in range(3))
                found = [(i, s) for i, k, t in zip(node, key, text, strict=True) for s in (shingles(t, words),) if xxhash.xxh3_128_digest(s.tobytes()) == k]
                marks = [np.unique(s >> np.uint64(48)).astype(np.uint16).view(np.int16) for _, s in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([i for i, _ in found], pa.int64()),
                        pa.array([len(s) for _, s in found], pa.int64()),
                        pa.array(marks, pa.list_(pa.int16())),
                        pa.array([s.view(np.int64) for _, s in found], pa.list_(pa.int64())),
                    ],
                    names=["id", "n", "marks", "items"],
                )

    return sets


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Label each ``id`` with the least id reachable: (id, comp).

    ``links`` has columns a, b.  Every round takes the least label among the
    neighbours and then the label's own label (pointer jumping).
    """
    both = staged(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = staged(nodes.select("id", F.col("id").alias("comp")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("comp").alias("least"))
        hooked = staged(labels.join(near, labels["id"] == near["a"], "left").select("id", F.least("comp", F.coalesce("least", "comp")).alias("new"), "comp"), "hooked")
        roots = hooked.select(F.col("id").alias("root"), F.col("new").alias("jump"))
        moved = staged(hooked.join(roots, hooked["new"] == roots["root"]).select("id", F.col("jump").alias("comp"), (F.col("jump") != F.col("comp")).alias("moved")), "labels")
        unstage(labels, hooked)
        labels = moved
        if labels.filter("moved").isEmpty():
            unstage(both)
            return labels.select("id", "comp")


def _some(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key`` may be among ``keys``, found before any of them moves."""
    return might_hold(rows, key_filter(keys, key, keys.count()), F.col(key), "hit").filter("hit").drop("hit")


def verified(pairs: DataFrame, sets: DataFrame, percent: int, each: int = 2000) -> DataFrame:
    """The pairs (a, b) whose full sets have Jaccard similarity of ``percent`` or more.

    ``sets`` has columns id, n, marks, items.  A mark that only one of two sets has stands for a shingle at least that the other
    lacks, so marks rule out most pairs that aren't links and never one that is; the full sets of the others are compared.
    A set that leads very many pairs is copied once for every ``each`` of them, so its pairs are spread over tasks.
    """
    led = pairs.groupBy("a").agg(F.count("*").alias("led"))
    often = F.broadcast(staged(led.filter(F.col("led") > frequent(pairs.count())).select("a", F.ceil(F.col("led") / each).cast("int").alias("copies")), "leads"))

    def met(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
        copies = F.coalesce("copies", F.lit(1))
        pairs = pairs.join(often, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), copies).cast("int").alias("part"))
        left = sets.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col(column).alias("x_a"))
        left = left.join(often, "a", "left").withColumn("part", F.explode(F.sequence(F.lit(0), copies - 1))).drop("copies")
        right = sets.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col(column).alias("x_b"))
        return pairs.join(left, ["a", "part"]).join(right, "b")

    both = F.size(F.array_intersect("x_a", "x_b")).cast("long")

    def similar(shared: Column) -> Column:
        return shared * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent

    most = both + F.least(F.col("n_a") - F.size("x_a"), F.col("n_b") - F.size("x_b"))
    likely = staged(met(pairs, sets, "marks").filter(similar(most)).select("a", "b"), "likely")
    if likely.isEmpty():
        return likely
    ends = likely.select(F.explode(F.array("a", "b")).alias("id"))
    return met(likely, _some(sets.select("id", "n", "items"), ends, "id"), "items").filter(similar(both)).select("a", "b")


def _leader_pairs(buckets: DataFrame, comps: DataFrame, percent: int) -> DataFrame:
    """Pairs of each bucket's leader and its members; the leader shares most buckets with most others."""
    at = buckets.join(comps, "id").select("id", "n", "bucket", "central")
    lead = at.groupBy("bucket").agg(F.min(F.struct((-F.col("central")).alias("c"), "id", "n")).alias("lead"), F.count("*").alias("members"))
    lead = staged(lead.select("bucket", F.col("lead.id").alias("a"), F.col("lead.n").alias("n_a"), "members"), "leaders")
    met = join_counted(buckets.withColumnsRenamed({"id": "b", "n": "n_b"}), lead, ["bucket"], "members", buckets.count())
    return _ordered(met.filter((F.col("a") != F.col("b")) & _close(percent)), leader=True)


def _close(percent: int):
    """Else the sizes alone rule the pair out."""
    return F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent


def _ordered(pairs: DataFrame, leader: bool = False) -> DataFrame:
    """Distinct pairs, the smaller node first, or a leader of the two."""
    lo, hi = F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")
    if not leader:
        return pairs.select(lo.alias("a"), hi.alias("b")).distinct()
    once = pairs.select(lo, hi, "a").groupBy("lo", "hi").agg(F.min("a").alias("a"))
    return once.select("a", F.when(F.col("a") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("b"))


def _rest_pairs(buckets: DataFrame, comps: DataFrame, sets: DataFrame, percent: int, small: int) -> DataFrame:
    """Candidates of different components, of all buckets.

    Buckets of up to ``small`` members give their pairs.  Members of larger
    ones meet on prefixes: of the shingles of a set, ordered from rare to
    frequent, similar sets share one among the first n - ceil(s n) + 1, and
    the first one that they share leaves room for as many as they must share.
    """
    at = staged(buckets.join(comps, "id").select("id", "n", "bucket", "comp"), "members")
    mixed = at.groupBy("bucket").agg(F.count("*").alias("members"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("bucket", "members")
    mixed = staged(mixed, "mixed")
    few = staged(at.join(mixed.filter(F.col("members") <= small).select("bucket"), "bucket", "left_semi"), "few")
    pairs = _meet(few, "bucket", percent)
    if not mixed.filter(F.col("members") > small).isEmpty():
        many = at.join(mixed.filter(F.col("members") > small).select("bucket"), "bucket", "left_semi").select("id", "n", "comp").distinct()
        many = staged(many, "many")
        items = staged(many.join(_some(sets.select("id", "items"), many, "id"), "id").select("id", "n", "comp", F.explode("items").alias("item")), "items")
        counts = items.groupBy("item").agg(F.count("*").alias("df"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
        counts = staged(counts.select("item", "df", (F.col("lo") < F.col("hi")).alias("open")), "counts")
        met = join_counted(items, counts, ["item"], "df", items.count())  # no task gets all rows of a shingle that most texts have
        ranked = met.groupBy("id", "n", "comp").agg(F.array_sort(F.collect_list(F.struct("df", "item", "open"))).alias("all"))
        first = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
        heads = ranked.select("id", "n", "comp", F.posexplode(F.slice("all", F.lit(1), first.cast("int"))).alias("at", "x")).filter("x.open")
        heads = staged(heads.select("id", "n", "comp", F.col("x.item").alias("item"), "at"), "heads")
        # If this is the first shingle that both share, no more than the shorter rest can follow.
        most = 1 + F.least(F.col("n_a") - F.col("at_a") - 1, F.col("n_b") - F.col("at_b") - 1)
        pairs = pairs.unionByName(_meet(heads, "item", percent, ("at",), most * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent))
    return pairs.distinct()


def _meet(rows: DataFrame, key: str, percent: int, more: tuple[str, ...] = (), bound=None) -> DataFrame:
    """Pairs of different components with the same key, as far as sizes (and ``bound``) allow."""
    left = rows.withColumnsRenamed({"id": "a"} | {c: f"{c}_a" for c in ("n", "comp", *more)})
    right = rows.withColumnsRenamed({"id": "b"} | {c: f"{c}_b" for c in ("n", "comp", *more)})
    met = left.join(right, key).filter((F.col("a") < F.col("b")) & (F.col("comp_a") != F.col("comp_b")) & _close(percent))
    return _ordered(met if bound is None else met.filter(bound))


def _same_id(named: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of rows that share an id."""
    h = F.xxhash64("key")
    torn = named.groupBy("id").agg(F.min(h).alias("lo"), F.max(h).alias("hi")).filter("lo < hi").select("id")
    nodes = named.join(torn, "id").select("id", "key").distinct().join(classes.select("key", "node"), "key").select("id", "node")
    least = nodes.groupBy("id").agg(F.min("node").alias("a"))
    return staged(nodes.join(least, "id").filter("a <> node").select("a", F.col("node").alias("b")), "links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, bands: int = 25, rows: int = 5, small: int = 24) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept."""
    scanned = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    hashed = staged(scanned.mapInArrow(tidy(_scan(words, bands * rows, bands), forget_words), "id long, n_shingles long, key binary, bands array<long>"), "signed")
    named = hashed.filter("id IS NOT NULL AND key IS NOT NULL")
    # Of a class's bands any will do: equal sets have equal signatures.  A class is a node, numbered once it is written.
    classes = named.groupBy("key").agg(F.min("id").alias("rep"), F.max("n_shingles").alias("n"), F.count("*").alias("copies"), F.any_value("bands").alias("bands"))
    numbered = staged(classes.withColumn("node", F.monotonically_increasing_id()), "numbered")
    every = staged(numbered.select(F.col("node").alias("id"), "n", F.posexplode("bands").alias("band", "value")).select("id", "n", F.xxhash64("band", "value").alias("bucket")), "buckets")
    classes = staged(numbered.select("key", "rep", "copies", "node"), "classes")
    unstage(numbered)
    # Few buckets have two members, and only rows that may be in one of those are joined.
    shared = staged(every.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1"), "members")
    buckets = staged(join_counted(_some(every, shared, "bucket"), shared, ["bucket"], "members", every.count()), "shared")
    unstage(every)
    nodes = staged(buckets.groupBy("id").agg(F.sum("members").alias("central")), "nodes")
    buckets = buckets.drop("members")
    wanted = staged(classes.join(nodes, classes["node"] == nodes["id"], "left_semi").select("node", "key", "rep"), "wanted")
    sets = staged(_some(scanned, wanted.withColumnRenamed("rep", "id"), "id").join(wanted, F.col("id") == F.col("rep")).select("node", "key", "text").mapInArrow(tidy(_sets(words), forget_words), "id long, n long, marks array<short>, items array<long>"), "sets")
    if sets.count() > wanted.count():  # rows that repeat an id and its text
        sets = staged(sets.dropDuplicates(["id"]), "sets")
    links = staged(verified(staged(_leader_pairs(buckets, nodes, percent), "pairs"), sets, percent), "links")
    comps = components(nodes, links)
    more = staged(verified(staged(_rest_pairs(buckets, comps, sets, percent, small), "pairs"), sets, percent), "links").unionByName(_same_id(named, classes))
    unstage(sets)
    if not more.isEmpty():
        every = nodes.select("id").unionByName(more.select(F.col("a").alias("id"))).unionByName(more.select(F.col("b").alias("id"))).distinct()
        comps = components(every, links.unionByName(more))
    reached = classes.select("key", "rep", "copies", "node").join(comps, F.col("node") == F.col("id"), "left").select("key", "rep", "copies", F.coalesce("comp", "node").alias("comp"))
    reached = staged(reached, "reached")
    least = reached.groupBy("comp").agg(F.min("rep").alias("component"), F.count("*").alias("members"))
    of_class = staged(join_counted(reached, staged(least, "components"), ["comp"], "members", classes.count()).select("key", "copies", "component"), "of_class")
    out = hashed.select("id", "n_shingles", "key")
    met = join_counted(out.filter("id IS NOT NULL AND key IS NOT NULL"), of_class, ["key"], "copies", hashed.count()).select("id", "n_shingles", "component")
    alone = out.filter("id IS NULL OR key IS NULL").select("id", "n_shingles", F.col("id").alias("component"))
    return met.unionByName(alone).select(F.col("id").alias(id_col), "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The rows of ``docs`` of which each group keeps one, with all their columns.

    Only rows whose id passes the filter of the dropped ids are joined; the others stay where they are.
    """
    gone = staged(near_duplicates(docs, id_col, text_col, **kw).filter("not kept").select(F.col(id_col).alias("__gone_id")).distinct(), "gone")
    hit = scratch_name(docs, "feedloom_hit")
    flagged = might_hold(docs, key_filter(gone, "__gone_id", gone.count()), F.col(id_col), hit)
    some = flagged.filter(F.col(hit))
    some = some.join(gone, some[id_col] == gone["__gone_id"], "left_anti")
    return flagged.filter(~F.col(hit)).select(*docs.columns).unionByName(some.select(*docs.columns))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4).select("doc_id", "n_shingles", "component_id", "kept")
