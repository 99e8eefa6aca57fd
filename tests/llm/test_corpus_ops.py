"""The operators against brute force on small tables with nulls, ties, repeats and clashes."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from feedloom.llm import exact_dedup, mixing, near_dedup, packing, planes, toxicity
from feedloom.llm.tokens import encoder, tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, id string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(7)
    vocab = [f"w{k}é" if k % 9 == 0 else f"W{k}" for k in range(400)]
    out = []
    for i in range(60):
        out.append([i, " ".join(rng.choice(vocab, rng.integers(1, 80))), "en", f"s{i % 4}"])
    for i in range(60, 100):  # near copies
        words = out[i % 7 + 20][1].split()
        if words:
            words[int(rng.integers(len(words)))] = "changed"
        out.append([i, " ".join(words), "en", "s0"])
    for i in range(100, 130):  # copies
        out.append([i, out[i % 5][1].upper() if i % 2 else out[i % 5][1], None, "s0"])
    out += [[200, None, None, None], [201, "", "en", "s1"], [202, " \t\n", "en", "s1"], [None, "null id here now ok", "en", "s1"], [None, None, None, None], [203, "Ä É", "de", "s2"], [204, "ä é", "de", "s2"], [205, "a b c", "en", "s2"], [206, "A b\tC", "en", "s2"], [206, "A b\tC", "en", "s2"], [207, "x y z w " * 3000, "en", "s3"], [208, " a  b c\x1cd  \n\n e<|x|>'s 12 ", "en", "s3"]]
    return [(*r, len(r[1] or ""), "clash", "clash") for r in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs, rows):
    groups = defaultdict(list)
    for r in rows:
        groups[lower(r[1])].append(r[0])
    want = Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[(i, keep, len(ids), i == keep)] += 1
    for got in [exact_dedup.exact_dedup(docs, keep="max")]:
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got.collect()) == want
    left = exact_dedup.drop_exact_duplicates(docs)
    assert left.columns == docs.columns
    assert {lower(r.text) for r in left.collect()} == set(groups)
    assert exact_dedup.exact_dedup(docs, keep="min").filter("kept and doc_id = 100").isEmpty()


def test_digest_index_merges_runs_and_probes_by_filters(spark, docs):
    rows = exact_dedup.with_digest(docs.filter("doc_id IS NOT NULL"), "doc_id", "text").select("digest", "id")
    rows = rows.withColumn("slot", (F.col("id") / 30).cast("int"))
    index = exact_dedup.DigestIndex(spark, fanout=3)
    index.flush(rows, F.col("slot"), 7)
    runs = len(index.runs())
    assert runs > 3 and all([r.digest for r in run.table.collect()] for run in index.runs())
    want = sorted(tuple(r) for r in rows.groupBy("digest").agg(F.min("id"), F.max("id"), F.count("*")).collect())
    some = rows.filter("id = 205").select("digest")
    found = index.probe(some).collect()
    assert 0 < index.read_runs < runs  # the others' filters stop it
    assert [tuple(r) for r in found] == [w for w in want if w[0] == found[0].digest]
    index.read_runs = 0
    assert index.probe(spark.createDataFrame([(b"none",)], "digest binary")).isEmpty() and index.read_runs == 0
    index.compact()
    assert len(index.runs()) == 1 and len(index.levels) == 3
    table = index.runs()[0].table
    assert sorted(tuple(r) for r in table.collect()) == want and sorted(tuple(r) for r in index.probe(rows).collect()) == want
    parts = [[r.digest for r in p] for p in table.rdd.glom().collect()]
    assert all(p == sorted(p) for p in parts)


def test_exact_dedup_is_the_same_for_any_number_of_memtables(docs):
    a, b = exact_dedup.exact_dedup(docs), exact_dedup.exact_dedup(docs.repartition(11), memtable_rows=10)
    assert Counter(map(tuple, a.collect())) == Counter(map(tuple, b.collect()))


def test_the_filters_of_runs_are_asked_on_the_way(spark, docs, rows):
    """Runs that share nothing with a new one aren't read; batches after one another give what all at once give."""
    ids = [r for r in rows if r[0] is not None]
    df = spark.createDataFrame(ids, SCHEMA)
    apart = exact_dedup.DigestIndex(spark)
    plain = df.filter("doc_id BETWEEN 0 AND 59").dropDuplicates(["text"])
    exact_dedup.exact_dedup(plain.coalesce(1), memtable_rows=8, index=apart).collect()
    assert apart.read_runs == 0 or apart.stopped_runs > 0
    one = {tuple(r) for r in exact_dedup.exact_dedup(df).collect()}
    for fanout in (2, 8):
        index = exact_dedup.DigestIndex(spark, fanout=fanout)
        first = exact_dedup.exact_dedup(df.filter("doc_id < 90").repartition(6), memtable_rows=20, index=index)
        assert {tuple(r) for r in first.collect()} == {tuple(r) for r in exact_dedup.exact_dedup(df.filter("doc_id < 90")).collect()}
        asked = index.stopped_runs
        fresh = df.filter("doc_id = 205").withColumn("text", F.lit("never seen before"))
        exact_dedup.exact_dedup(fresh, index=index).collect()
        assert index.stopped_runs > asked  # nothing of a run was read for it
        index = exact_dedup.DigestIndex(spark, fanout=fanout)
        exact_dedup.exact_dedup(df.filter("doc_id < 90").repartition(6), memtable_rows=20, index=index).collect()
        second = exact_dedup.exact_dedup(df.filter("doc_id >= 90").repartition(3), memtable_rows=20, index=index)
        assert {tuple(r) for r in second.collect()} == {r for r in one if r[0] >= 90}
        assert max(map(len, index.levels)) < fanout


def test_filters_grow_with_their_keys(spark, monkeypatch):
    """A filter of more blocks than may be broadcast is met by a join and stops as many keys."""
    from feedloom.llm import common

    keys = spark.range(200_000).select(F.sha2(F.col("id").cast("string"), 256).alias("k"))
    others = spark.range(200_000, 260_000).select(F.sha2(F.col("id").cast("string"), 256).alias("k"))
    for most in (common.BROADCAST_BLOCKS, 8):
        monkeypatch.setattr(common, "BROADCAST_BLOCKS", most)
        made = common.key_filter(keys, "k", 200_000, most=None)
        assert made._feedloom_blocks > 90
        assert common.might_hold(keys, made, F.col("k"), "hit").filter("NOT hit").isEmpty()
        plan = common.might_hold(others, made, F.col("k"), "hit")
        assert plan.filter("hit").count() < 1200  # two in a hundred


def test_exact_dedup_separates_colliding_digests(spark):
    s = "id long, digest string, keep_id long, group_size long, same boolean"
    checked = spark.createDataFrame([(1, "d", 3, 3, True), (2, "d", 3, 3, False), (3, "d", 3, 3, True), (9, "e", 9, 1, True)], s)
    members = spark.createDataFrame([(1, "d", "x"), (2, "d", "y"), (3, "d", "x"), (9, "e", "z")], "id long, digest string, text string")
    got = exact_dedup.regroup(members, checked, "max").collect()
    assert sorted((r.id, r.keep_id, r.group_size) for r in got) == [(1, 3, 2), (2, 2, 1), (3, 3, 2), (9, 9, 1)]


def shingle_sets(rows, k):
    out = []
    for r in rows:
        w = WORD.findall(lower(r[1]))
        n = min(k, len(w))
        out.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    return out


def brute_components(rows, k):
    sets, comp = shingle_sets(rows, k), {}
    nodes = [i for i, r in enumerate(rows) if r[0] is not None]
    root = {rows[i][0]: rows[i][0] for i in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(rows[a][0]), find(rows[b][0])
                root[max(x, y)] = min(x, y)
    return sets, {x: find(x) for x in root}


def test_near_dedup(docs, rows):
    for k, small in ((4, 24), (5, 24), (4, 0)):  # 0: every bucket takes the way of the large ones
        sets, comp = brute_components(rows, k)
        want = Counter((r[0], len(s), comp.get(r[0]), r[0] is None or comp[r[0]] == r[0]) for r, s in zip(rows, sets))
        got = near_dedup.near_duplicates(docs, words=k, small=small).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == want
    _, comp = brute_components(rows, 5)
    left = near_dedup.drop_near_duplicates(docs, words=5)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {i for i, c in comp.items() if i == c} | {None}


def test_near_dedup_of_rows_that_share_an_id(spark):
    rng = np.random.default_rng(2)
    base = [[f"w{k}" for k in rng.integers(0, 500, 60)] for _ in range(12)]
    rows = [[i, " ".join(w), "en", "s", 0, "x", "x"] for i, w in enumerate(base)]
    rows += [[100 + i // 2, " ".join([*w[:30], "other", *w[31:]]), "en", "s", 0, "x", "x"] for i, w in enumerate(base[:10])]  # two texts an id
    rows += [[100, " ".join(base[11]), "en", "s", 0, "x", "x"]] * 3
    _, comp = brute_components(rows, 4)
    got = near_dedup.near_duplicates(spark.createDataFrame([tuple(r) for r in rows], SCHEMA), words=4).collect()
    assert len(got) == len(rows) and {r.doc_id: r.component_id for r in got} == comp
    assert {comp[i] for i in (0, 1, 11, 100)} == {0}


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 300).astype(np.uint64)
    b = np.concatenate([a[:240], rng.integers(0, 2**63, 60).astype(np.uint64)])
    short = a[:3]
    sig = near_dedup.signatures([np.unique(a), np.unique(b), short], 250)
    assert np.isfinite(sig).all()
    assert abs((sig[0] == sig[1]).mean() - 240 / 360) < 0.1
    assert (sig[2].astype(int) >= 0).all() and len(np.unique(sig[2])) == 250  # each element's ranks form a permutation


def test_components_of_a_chain(spark):
    nodes = spark.range(50).select("id")
    links = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(30, 40), (40, 49)], "a long, b long")
    got = {r.id: r.comp for r in near_dedup.components(nodes, links).collect()}
    assert all(got[i] == 0 for i in range(21)) and got[49] == got[40] == 30 and got[25] == 25


def test_targets():
    assert mixing.targets({"a": 100, "b": 100, None: 10}) == {"a": 200.0, "b": 95.0, None: 20.0}
    assert sum(mixing.targets({"a": 5, "b": 7, "c": 1000}).values()) == pytest.approx(1.5 * 1012)
    assert mixing.targets({}) == {}


def test_mixing(docs, rows):
    got = mixing.mix(docs).collect()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    goal = mixing.targets(dict(sizes))
    assert len(got) == len(rows)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == goal[r.source]
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
    for s in sizes:
        assert taken[s] <= goal[s] + 1e-6 and (s == "s3" or goal[s] - taken[s] <= 0.05 * goal[s] + 3)
    again = mixing.mix(docs.repartition(5)).collect()
    assert Counter((r.doc_id, r.taken) for r in again) == Counter((r.doc_id, r.taken) for r in got)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect() if r.doc_id != 206) == Counter({r.doc_id: r.repeats for r in got if r.repeats and r.doc_id not in (206, None)}) + Counter([None] * sum(r.repeats for r in got if r.doc_id is None))


def whole_ids(text):
    t = encoder(tokenizer_path("byte_bpe_50k.json")).tokenizer
    return t.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_those_of_whole_texts(rows):
    code = encoder(tokenizer_path("byte_bpe_50k.json"))
    texts = [r[1] for r in rows] + ["\n\nfoo \n bar\tbaz  x\u0085 y ", "a\x1c b\x1f\x1f c", "I'll　go 's", "  ", "a <|endoftext|>b", "​ ᠎ x"]
    assert [np.frombuffer(x, code.dtype).tolist() for x in code.encode(texts)] == [whole_ids(t) for t in texts]


def test_packing(docs, rows):
    got = packing.pack(docs, size=64).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    for r in rows:
        if r[0] in (None, 206):
            continue
        ids, at = np.array([*whole_ids(r[1]), 0], "<u4"), 0
        for p in sorted(by_doc[r[0]], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    short = 0
    for s in by_seq.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at == 64 or at & (at - 1) == 0
        short += at < 64
    assert short <= 6 and sum(r.length for r in got) == sum(len(whole_ids(r[1])) + 1 for r in rows)


def test_hilbert_curve_visits_neighbours():
    grid = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    keys = packing.hilbert_keys(grid, 3)
    assert sorted(keys) == list(range(512))
    steps = np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1)
    assert (steps == 1).all()


@pytest.mark.parametrize("bits", [False, True])
def test_planes_round_trip(spark, docs, rows, tmp_path, bits):
    shards = planes.write_planes(docs, str(tmp_path / "planes"), bits=bits)
    got = planes.read_planes(spark, shards).collect()
    want, at = [], 0
    for doc, text in sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array([*whole_ids(text), 2], "<u4")
        want.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted((r.start, r) for r in got) and [tuple(r) for r in sorted(got, key=lambda r: r.start)] == want


def test_planes_in_memory():
    import io

    rng = np.random.default_rng(0)
    out = io.BytesIO()
    w = planes.PlaneWriter(out, width=4, bits=True, chunk=100)
    texts = [rng.integers(0, 2**32, n).astype("<u4") for n in (0, 1, 99, 350, 100)]
    for i, t in enumerate(texts):
        w.add(i, t)
    w.close()
    back = {d: np.concatenate(p) if p else np.empty(0, "<u4") for d, p in planes.PlaneReader(out)}
    assert all((back[i] == t).all() for i, t in enumerate(texts))


def test_fold():
    assert toxicity.fold("Ѕtuріd!!") == toxicity.fold("stupid")
    assert toxicity.fold("1d1ot") == toxicity.fold("IDIOT###") == toxicity.fold("ídіot")
    assert toxicity.fold("l0ser in 2001") == toxicity.fold("loser in")
    assert toxicity.fold(None) == "  "


def test_lexicon_exceptions_and_length():
    lex = toxicity.Lexicon({f"{toxicity.fold('trash')}": 5.0}, curve=(1.0, 0.0, -1.0), fitted=True)
    auto = lex.automaton()
    assert lex.features(auto, "the trash can") == (0.0, 0.0)
    assert lex.features(auto, "what trash")[0] > lex.features(auto, "what trash " + "word " * 50)[0] > 0


def naive_features(lex, text):
    """Every pattern tried at every place, without an automaton."""
    folded = toxicity.fold(text)
    spared = [(k, k + len(p) - 1) for e in lex.exceptions for p in [toxicity.fold(e)[:-1]] for k in range(len(folded)) if folded.startswith(p, k)]
    best = {}
    for p, w in lex.weights.items():
        for k in range(len(folded)):
            if folded.startswith(p, k) and not any(lo <= k < hi for lo, hi in spared):
                best[k] = max(best.get(k, 0.0), w)
    best = {k: w for k, w in best.items() if w > 0}
    return (np.log1p(sum(best.values()) / np.sqrt(folded.count(" "))), max(best.values())) if best else (0.0, 0.0)


def test_matcher_against_every_pattern_at_every_place():
    rng = np.random.default_rng(5)
    parts = ["scum", "Sсum", "5cum", "pond", "soap", "trash", "can", "tra5h", "line", "stupid", "stup1dity", "simple", "ab", "ñ", "x9x", "12", "!", "\n", "scummy"]
    weights = {" scum ": 3.0, " scu": 1.5, " stup": 2.0, " stupid ": 1.0, " trash ": 2.5, " tras": 0.5, " can ": 0.25}
    lex = toxicity.Lexicon({toxicity.fold(p.strip())[: len(p)] if p.endswith(" ") else toxicity.fold(p)[:-1]: w for p, w in weights.items()}, curve=(1.0, 1.0, -2.0), fitted=True)
    auto = lex.automaton()
    texts = [" ".join(rng.choice(parts, rng.integers(0, 14))) for _ in range(400)] + ["", None, "scum " * 5000]
    for t in texts[:-1]:
        assert lex.features(auto, t) == pytest.approx(naive_features(lex, t))
    assert sum(lex.features(auto, t)[1] > 0 for t in texts) > 200
    assert lex.features(auto, texts[-1])[1] == 3.0


def test_toxicity_more_labels_than_its_bound_ties_and_repeated_rows(spark):
    rows = [(i, f"good words here {i}") for i in range(300)] + [(1000 + i, f"vile scum number {i}") for i in range(60)]
    rows += [(1000, "again vile scum")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 1000)) for i, _ in rows], "doc_id long, toxic int")
    for bound in (20, 1000):
        lex = toxicity.fit(docs, labels, max_rows=bound)
        got = {(r.doc_id >= 1000, r.score > 0.5) for r in toxicity.score(docs, lex).collect()}
        assert got == {(True, True), (False, False)}
    counts = Counter(r.doc_id for r in toxicity.score(docs, lex).collect())
    assert counts[1000] == 51 and len(counts) == 360


@pytest.fixture(scope="module")
def small():
    return "/root/testdata/sf0.01"


def test_toxicity_held_out(spark, small):
    got = toxicity.op4_toxicity(spark, small)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    rows = got.collect()
    assert len(rows) == spark.read.parquet(f"{small}/documents.parquet").count()
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([p == y for p, y in held]) > 0.85
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


HARMLESS = """path paths pathway pathology pathos pathogen pathfinder worth worthy worthwhile worthiness idiom idioms idiomatic idiosyncrasy disguise disguised disgorge disgruntled stupor stupefy stupendous
trashcan mortal moral morale morning more lose loses losing lost loss loose loosen close closer clover clothes cloud clowder scumble sculpture scurry school scope trace track tradition transparent
tragedy travel treasure pathless footpath empathy sympathy apathy pathname worthies noteworthy praiseworthy idiolect idle ideal idea identity distinct district disgust-free discuss discover display""".split()


def test_toxicity_leaves_harmless_words_alone(spark):
    """Words that begin like a learned one, alone and at the end of long neutral texts; forms of learned words are found."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    lex = toxicity.fit(docs, toxicity.taught(labels))
    neutral = "many plain words stand in this line " * 15
    mild = ["She took the path.", "Is it worth the trip? We think the museum is well worth it.", *HARMLESS, *[f"{neutral}{w}" for w in HARMLESS], *[f"the {w} of a day" for w in HARMLESS]]
    bad = ["you idiots", "what trashy, worthless scum", "She is STUP1D", f"{neutral}you disgusting moron"]
    rows = spark.createDataFrame(list(enumerate(mild + bad)), "doc_id long, text string")
    score = {r.doc_id: r.score for r in toxicity.score(rows, lex).collect()}
    assert [mild[k] for k in range(len(mild)) if score[k] >= 0.3] == []
    assert all(score[len(mild) + k] >= 0.3 for k in range(len(bad)))
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [(r.score, truth[r.doc_id]) for r in toxicity.score(docs, lex).collect() if r.doc_id in truth and truth[r.doc_id] is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    clean = np.array([s for s, y in held if not y])
    auc = np.mean([(clean < s).mean() + 0.5 * (clean == s).mean() for s, y in held if y])
    assert auc >= 0.97 and (clean >= 0.3).mean() < 0.01


def test_toxicity_without_labels(spark, docs, empty):
    none = spark.createDataFrame([(None, 1), (3, None)], "doc_id long, toxic int")
    lex = toxicity.fit(docs, none)
    assert {r.score for r in toxicity.score(docs, lex).collect()} == {0.0}
    some = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (200, 0)], "doc_id long, toxic int")
    assert toxicity.fit(docs, some).fitted
    assert toxicity.drop_toxic(empty, lex).columns == empty.columns


def test_empty_tables(spark, empty, tmp_path):
    for f in (exact_dedup.exact_dedup, near_dedup.near_duplicates, mixing.mix, packing.pack, exact_dedup.drop_exact_duplicates, near_dedup.drop_near_duplicates, mixing.mixed_documents):
        assert f(empty).count() == 0
    assert planes.read_planes(spark, planes.write_planes(empty, str(tmp_path / "e"))).count() == 0


def test_pipeline_stage_by_stage(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small).cache()
        sizes.append(out.count())
        if name != "packing":
            assert out.columns == columns
            before = docs
            docs = out
    assert 0 < sizes[2] <= sizes[1] <= sizes[0] < 1000
    words = before.select(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).alias("n"), "source")
    assert docs.select(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0] == pytest.approx(1.5 * words.select(F.sum("n")).first()[0], rel=0.05)


def test_pipeline_against_brute_force(spark):
    """run() on a small table, stage by stage in plain Python: who stays, how often, and that every id lies in one piece."""
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    lex = toxicity.fit(spark.read.parquet(f"{sf}/documents.parquet"), toxicity.taught(labels))
    auto = lex.automaton()
    left = [d for d in docs.values() if lex.probability(*lex.features(auto, d.text)) < 0.3]
    groups = defaultdict(list)
    for d in left:
        groups[lower(d.text)].append(d.doc_id)
    left = [d for d in left if d.doc_id == max(groups[lower(d.text)])]
    _, comp = brute_components([(d.doc_id, d.text) for d in left], 5)
    left = {i: docs[i] for i, c in comp.items() if i == c}
    size = {i: len(WORD.findall(d.text or "")) for i, d in left.items()}
    by_source = Counter()
    for i, d in left.items():
        by_source[d.source] += size[i]
    goal = mixing.targets(dict(by_source))
    pieces = defaultdict(list)
    for r in corpus_pipeline.run(spark, sf).collect():
        pieces[r.doc_id].append(r)
    enc = encoder(tokenizer_path("byte_bpe_50k.json"))
    taken, repeats = Counter(), {}
    for i, rows in pieces.items():
        assert i in left
        n = len(np.frombuffer(enc.encode([left[i].text])[0], enc.dtype)) + 1
        repeats[i] = sum(r.start == 0 for r in rows)
        assert {r.doc_tokens for r in rows} == {n} and sum(r.length for r in rows) == n * repeats[i]
        starts = Counter()
        for r in rows:  # every id of every copy once
            starts[r.start] += 1
            starts[r.start + r.length] -= 1
        assert {k: v for k, v in starts.items() if v} == {0: repeats[i], n: -repeats[i]}
        taken[left[i].source] += size[i] * repeats[i]
    for s, total in by_source.items():
        base = min(int(goal[s] // total), 2) if total else 0
        own = [i for i in left if left[i].source == s and size[i]]
        assert all(repeats.get(i, 0) in (base, base + 1) and repeats.get(i, 0) <= 2 for i in own)
        assert abs(taken[s] - goal[s]) <= max(size[i] for i in own)


def shuffled(spark, run):
    """What ``run`` returns, and the bytes and rows that it shuffled, with joins as those of large tables."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        jvm, store = spark._jvm, spark._jsc.sc().statusStore()
        stages = lambda: store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        done = max((s.stageId() for s in map(stages().apply, range(stages().size()))), default=-1)
        out, found = run(), stages()
        new = [s for s in map(found.apply, range(found.size())) if s.stageId() > done]
        return out, sum(s.shuffleWriteBytes() for s in new), sum(s.shuffleWriteRecords() for s in new)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_verification_moves_full_sets_of_likely_pairs_only(spark):
    rng = np.random.default_rng(3)
    sets, kinds = {}, (0.2, 0.5, 0.7, 0.795, 0.805, 1.0)  # similarity of two neighbours
    for k in range(96):
        n = 60_000 if k == 5 else 1500 + 10 * k
        both, j = rng.integers(0, 2**64, n, dtype=np.uint64), kinds[k % 6] if k % 12 in (4, 5) else kinds[k % 3]
        own = round((1 - j) / (2 * j) * n)
        for side in range(2):
            sets[2 * k + side] = np.unique(np.concatenate([both, rng.integers(0, 2**64, own, dtype=np.uint64)]))
    sets[192], sets[193] = (np.arange(a, a + 900, dtype=np.uint64) << np.uint64(40) for a in (0, 100))  # exactly 0.8, with many equal marks
    rows = [(i, len(s), np.unique(s >> np.uint64(48)).astype(np.uint16).view(np.int16).tolist(), s.view(np.int64).tolist()) for i, s in sets.items()]
    table = spark.createDataFrame(rows, "id long, n long, marks array<short>, items array<long>").repartition(4).localCheckpoint()
    pairs = spark.createDataFrame([(i, i + 1) for i in range(0, 194, 2)], "a long, b long").localCheckpoint()
    got, moved, _ = shuffled(spark, lambda: {tuple(r) for r in near_dedup.verified(pairs, table, 80).collect()})
    same = {i: len(np.intersect1d(sets[i], sets[i + 1])) for i in range(0, 194, 2)}
    assert got == {(i, i + 1) for i, s in same.items() if 100 * s >= 80 * (len(sets[i]) + len(sets[i + 1]) - s)} and 192 in {a for a, _ in got}
    assert moved < 1.5 * sum(8 * len(s) for s in sets.values())


def test_near_dedup_moves_few_buckets_twice(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{w}" for w in rng.integers(0, 10**6, 60)) for _ in range(3000)]
    docs = spark.createDataFrame(list(enumerate(texts + [t + " more" for t in texts[:20]])), "doc_id long, text string")
    got, _, rows = shuffled(spark, lambda: {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, words=4).collect()})
    assert got == {i: i if i < 3000 else i - 3000 for i in range(3020)}
    assert rows < 2 * 25 * 3000  # each once to be counted; 43,000 rows of other steps
