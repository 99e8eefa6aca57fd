"""Secret scans with a random forest that removes false positives (native operators only).

Candidates are private keys with their bodies, runs of key-like characters with
a digit, and values assigned to words like ``password`` or ``token``.  Each gets
features of its length, its character transitions (also their surprise under
letter pairs of ordinary words), its coverage by a dictionary, its path and its
neighbouring words, all as column expressions, and a random forest (Spark
ML, in the JVM) gives the probability that it is a secret.

The dictionary is read from the vocabulary of a public tokenizer, whose path is a
parameter; its size doesn't depend on the corpus.  The forest is trained from
labelled findings ``(text, label)``.  By default those are generated by rule
(``labelled_findings``, the bound is its ``n``): names, forms of assignment and
values are drawn independently, so the forest can be tested on forms that it
never saw; a caller can give reviewed findings instead.

Every text is matched once; a candidate's place follows from the matches
themselves, and its neighbours are read from the pieces between them, so the work
is in proportion to the text.

Defined results: null and empty texts give no finding; a secret that occurs
twice gives two findings, and rows that repeat give theirs each.  Offsets count
characters from 0.  The secret itself is returned only as its SHA-256 and its
first four characters.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from functools import cache
from itertools import accumulate

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CLOSE, ESCAPE, OPEN, enclosed, running_sums, staged, table
from .tokens import tokenizer_path

KEYLIKE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+={0,2}(?![A-Za-z0-9+/_=-])"
_NAME = r"(?i:password|passwd|pwd|secret|passphrase|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?)"
_TO = _NAME + r"[\"']?[ ]?(?:[:=]|=>)[ ]?"
#: Values to their closing quote (no templates like "${NAME}"), of a URL's parameters, and others; the short lookbehinds only save time.
ASSIGNED = "|".join(
    [
        *(f"(?<={q})(?<=[:=>][ ]?{q})(?<={_TO}{q})(?![$%#]?[{{<])[^\\s{q}]{{8,}}+(?={q})" for q in "\"'"),
        rf"(?<==)(?<=[?&]\w{{0,24}}{_NAME}=)[^\s\"'<>{{}}&#]{{8,}}",
        rf"(?<=[:=> \"'])(?<=[:=>][ \"']{{0,2}})(?<={_TO}[\"']?)[^\s\"'<>{{}}]{{8,}}",
        r"(?<= )(?<=(?i:bearer) )[^\s\"'<>{}]{12,}",
    ]
)
_BODY = r"[A-Za-z0-9+/=\s:,\\.]*+"
#: A private key to its end; a header without one is a candidate too.
PEM = rf"-----BEGIN [A-Z ]{{0,30}}PRIVATE KEY(?: BLOCK)?-----(?:{_BODY}(?:-(?!----){_BODY}){{0,40}}+-----END [A-Z ]{{0,30}}PRIVATE KEY(?: BLOCK)?-----)?+"
CANDIDATE = f"{PEM}|{ASSIGNED}|{KEYLIKE}"

NEAR_KEY = r"(?i)(?:token|secret|password|passwd|pwd|passphrase|api[_-]?key|access[_-]?key|private[_-]?key|auth\w*|bearer|credential\w*)[\w\"' -]{0,12}(?:[:=]|=>|bearer )\s*[\"']?(?:bearer )?$"
NEAR_HASH = r"(?i)(?:commit|sha\d*|md5|checksum|digest|integrity|revision|rev|uuid|guid|etag|hash|blob|tree|fingerprint|trace|request|build|order|version)\W{0,4}\w{0,4}\W{0,3}$"
HOLLOW = r"(?i)example|sample|dummy|fake|placeholder|changeme|change_me|your[_-]|xxxx|0000000|1234567|abcdefg|\*\*\*|<|redacted|insert[_-]"
KNOWN = r"^(?:AKIA|ASIA)[A-Z0-9]{16}$|^gh[pousr]_[A-Za-z0-9]{36}$|^xox[abprs]-|^[sr]k_live_|^eyJ[A-Za-z0-9_-]+|^AIza[A-Za-z0-9_-]{35}$|^glpat-"
FEATURES = ["length", "transitions", "surprise", "digits", "uppers", "distinct", "covered", "longest_word", "slashes", "dashes", "hex", "decimal", "path", "near_key", "near_hash", "hollow", "quoted", "known", "pem"]


@cache
def dictionary(path: str | None = None) -> tuple[str, ...]:
    """The whole words of four letters or more in a tokenizer's vocabulary."""
    with open(path or tokenizer_path("byte_bpe_50k.json"), encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    return tuple(sorted(w[1:] for w in vocabulary if re.fullmatch("Ġ[a-z]{4,}", w)))


def letter_pairs(words: tuple[str, ...]) -> list[float]:
    """Bits of surprise of each letter after each, 26 rows of 26."""
    seen = Counter(pair for w in words for pair in zip(w, w[1:], strict=False))
    letters = "abcdefghijklmnopqrstuvwxyz"
    sums = {a: sum(seen[a, b] + 1 for b in letters) for a in letters}
    return [round(-math.log2((seen[a, b] + 1) / sums[a]), 4) for a in letters for b in letters]


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("double")


def _once(value: Column, use) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _covered(c: Column, words: tuple[str, ...]) -> tuple[Column, Column]:
    """Letters in parts that are one word of the dictionary, or two in a row, from the column ``asked_words``, which is the second."""
    parts = F.regexp_extract_all(c, F.lit("[A-Z]?[a-z]{3,}|[A-Z]{4,}"), F.lit(0))
    cuts = lambda n: F.when((n >= 8) & (n <= 40), F.sequence(F.lit(4), F.greatest(n - 4, F.lit(4)))).otherwise(F.array().cast("array<int>"))

    def asked(part: Column) -> Column:
        w, n = F.lower(part), F.char_length(part)
        return F.concat(F.array(w), F.transform(cuts(n), lambda k: F.substring(w, F.lit(1), k)), F.transform(cuts(n), lambda k: F.substring(w, k + 1, n)))

    def letters(known: Column, part: Column) -> Column:
        w, n = F.lower(part), F.char_length(part)
        two = F.exists(cuts(n), lambda k: F.array_contains(known, F.substring(w, F.lit(1), k)) & F.array_contains(known, F.substring(w, k + 1, n)))
        return F.when(F.array_contains(known, w) | two, n).otherwise(0)

    # One list of the words in the plan, written as SQL: as columns they would take seconds to build.
    listed = ",".join(f"'{w}'" for w in words)
    strings = F.array_distinct(F.flatten(F.transform(parts, asked)))
    known = F.expr(f"filter(asked_words, s -> s IN ({listed}))")
    return _once(known, lambda k: F.aggregate(parts, F.lit(0), lambda a, p: a + letters(k, p))), strings


def _surprise(c: Column, pairs: list[float]) -> Column:
    """Mean bits of surprise of its letters, each after the one before; 0 with fewer than two."""
    bits = F.array(*map(F.lit, pairs))
    codes = F.transform(F.filter(F.split(F.lower(F.regexp_replace(c, "[^A-Za-z]", "")), ""), lambda x: x != ""), lambda x: F.ascii(x) - 97)

    def mean(cs: Column) -> Column:
        n = F.size(cs) - 1
        after = F.zip_with(F.slice(cs, F.lit(1), n), F.slice(cs, F.lit(2), n), lambda a, b: F.get(bits, a * 26 + b))
        return F.when(n > 0, F.aggregate(after, F.lit(0.0), lambda s, x: s + x) / n).otherwise(0.0)

    return _once(codes, lambda cs: F.when(F.size(cs) > 1, mean(cs)).otherwise(0.0))


def with_features(found: DataFrame, words: tuple[str, ...] | None = None) -> DataFrame:
    """Adds the features of columns candidate, before, after."""
    words = words or dictionary()
    c = F.col("candidate")
    n = F.greatest(F.char_length(c), F.lit(1)).cast("double")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0")
    runs = F.regexp_extract_all(c, F.lit("[a-z]+|[A-Z]+"), F.lit(0))
    covered, asked = _covered(c, words)
    return found.withColumn("asked_words", asked).withColumns(
        {
            "length": F.log2(n),
            "transitions": (F.regexp_count(kinds, F.lit("a+|A+|0+|[^aA0]+")) - 1) / n,
            "surprise": _surprise(c, letter_pairs(words)),
            "digits": F.regexp_count(c, F.lit("[0-9]")) / n,
            "uppers": F.regexp_count(c, F.lit("[A-Z]")) / n,
            "distinct": F.size(F.array_distinct(F.split(c, ""))) / n,
            "covered": covered / n,
            "longest_word": F.coalesce(F.array_max(F.transform(runs, F.char_length)), F.lit(0)) / n,
            "slashes": F.regexp_count(c, F.lit("/")) / n,
            "dashes": F.regexp_count(c, F.lit("[-_]")) / n,
            "hex": _flag(c.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
            "decimal": _flag(c.rlike("^[0-9]+$")),
            "path": _flag(F.col("before").rlike(r"(?:https?://|[/\\~.])[^\s=?&]*$") | F.col("after").rlike(r"^\.[a-z]{1,4}\b|^/") | c.rlike(r"^/|/.*/.*/")),
            "near_key": _flag(F.col("before").rlike(NEAR_KEY)),
            "near_hash": _flag(F.col("before").rlike(NEAR_HASH)),
            "hollow": _flag(c.rlike(HOLLOW)),
            "quoted": _flag(F.col("before").rlike("[\"']$") & F.col("after").rlike("^[\"']")),
            "known": _flag(c.rlike(KNOWN)),
            "pem": _flag(c.rlike("^-----BEGIN")),
        }
    ).drop("asked_words")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per candidate: id, start, candidate, before (48 characters, as far as two pieces hold them), after (12)."""
    text = F.col(text_col)
    plain = F.when(text.rlike(f"[{OPEN}{CLOSE}{ESCAPE}]"), F.translate(text, OPEN + CLOSE + ESCAPE, "�" * 3)).otherwise(text)
    rows = docs.select(F.col(id_col).alias("doc_id"), *keep, F.split(enclosed(plain, CANDIDATE), OPEN, -1).alias("pieces")).filter(F.size("pieces") > 1)
    p = F.col("pieces")
    bare = lambda x: F.replace(F.coalesce(x, F.lit("")), F.lit(CLOSE), F.lit(""))
    lengths = F.transform(p, lambda x, i: F.char_length(x) - F.when(i > 0, 1).otherwise(0))

    def one(x: Column, i: Column) -> Column:
        return F.struct(
            F.get(F.col("starts"), i + 1).cast("int").alias("start"),
            F.substring_index(x, CLOSE, 1).alias("candidate"),
            F.right(F.concat(F.when(i > 0, bare(F.get(p, i - 1))).otherwise(""), bare(F.get(p, i))), F.lit(48)).alias("before"),
            F.left(F.concat(F.substring_index(x, CLOSE, -1), bare(F.get(p, i + 2))), F.lit(12)).alias("after"),
        )

    found = rows.withColumn("starts", running_sums(lengths)).withColumn("x", F.explode(F.transform(F.slice(p, F.lit(2), F.size(p) - 1), one)))
    return found.select("doc_id", *keep, "x.*")


# Parts of the labelled findings; fixed values.
SECRET_NAMES = "token api_key apikey secret client_secret aws_secret_access_key access_token auth_token private_key password passwd db_password credentials access_key".split()
HASH_NAMES = "commit sha1 sha256 md5 checksum digest etag uuid revision integrity build request_id trace_id order card id version image ref blob fingerprint rev".split()
SECRET_FORMS = ['{n} = "{v}"', "{n}: '{v}'", "{N}={v}\n", '"{n}": "{v}",', "https://www.example.org/a?{n}={v}&b=1", "{n} => '{v}'", 'export {N}="{v}"', "const {n} = '{v}';", "{n}: {v}\n", "the {n}={v} of", "x\n{N}={v}\nHOST=db", "auth bearer {v} end"]
HASH_FORMS = ["{n} {v} by", "{n}: {v}\n", '{n} = "{v}"', "{n}={v} in", '"{n}": "{v}",', "see {n} ({v})", "https://www.example.org/{n}/{v}/x", "https://www.example.org/a?{n}={v}&b=1", "{n}-{v}.tar"]
PROSE_FORMS = ["in {v} the", "see {v} for", "({v})", '"{v}"', "call {v}(x)", "file={v} of", "<{v}>", "the {v}."]


def labelled_findings(spark: SparkSession, n: int = 6000) -> DataFrame:
    """``n`` labelled findings by rule: doc_id, form, text, label; ``form`` names the kind of value and the form around it."""
    i = F.col("id").cast("string")
    words = dictionary()
    some = [words[k] for k in range(7, len(words), len(words) // 180)]  # even over the alphabet

    def place(size: Column, salt: int) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(salt)), size).cast("int")

    def pick(options: Column, salt: int) -> Column:
        return F.get(options, place(F.size(options), salt))

    literal = lambda texts: F.array(*map(F.lit, texts))
    rows = spark.range(n).withColumns({"sha": F.sha2(i, 512), "b64": F.regexp_replace(F.base64(F.unhex(F.concat(F.sha2(i, 512), F.sha2(F.concat(i, F.lit("b")), 512)))), "[\r\n]", "")})
    rows = rows.withColumns({"mixed": F.translate("b64", "+/=", "Q7x"), "digits": F.translate("sha", "abcdef", "123456"), "few": place(F.lit(90), 9).cast("string")} | {f"w{k}": pick(literal(some), 20 + k) for k in range(3)})
    rows = staged(rows, "parts")  # else each use of a column would be planned with all that it is made of
    cut = lambda c, at, k: F.substring(c, at, k)
    c, text = F.concat, F.lit
    values = {
        "secret": [
            cut("sha", 1, 32), cut("sha", 3, 40), cut("sha", 5, 64), cut("b64", 1, 40), c(cut("b64", 2, 62), text("==")), cut("mixed", 1, 24), cut("mixed", 3, 32), cut("mixed", 2, 44),
            c(cut("mixed", 1, 6), text("!"), cut("mixed", 9, 4), text("#"), cut("mixed", 20, 3)), c(cut("mixed", 5, 12), text("!")),
        ],
        "issued": [
            c(text("AKIA7"), F.upper(cut("mixed", 1, 15))), c(text("ghp_2"), cut("mixed", 1, 35)), c(text("xoxb-"), cut("digits", 1, 11), text("-"), cut("mixed", 1, 24)), c(text("sk_live_3"), cut("mixed", 4, 23)), c(text("eyJhbGciOiJIUzI1NiJ9"), cut("mixed", 1, 50)),
            c(text("AIza4"), cut("mixed", 3, 34)),
        ],
        "block": [
            c(text("-----BEGIN RSA PRIVATE KEY-----\n"), cut("b64", 1, 64), text("\n"), cut("b64", 9, 60), text("\n-----END RSA PRIVATE KEY-----")), c(text("-----BEGIN EC PRIVATE KEY-----\n"), cut("b64", 5, 50), text("\n-----END EC PRIVATE KEY-----")),
            c(text("-----BEGIN OPENSSH PRIVATE KEY-----\n"), F.repeat(c(cut("b64", 3, 70), text("\n")), text(8)), text("-----END OPENSSH PRIVATE KEY-----")), text("-----BEGIN PRIVATE KEY-----"),
        ],
        "digest": [cut("sha", 1, 32), cut("sha", 1, 40), cut("sha", 1, 64), F.concat_ws("-", cut("sha", 1, 8), cut("sha", 9, 4), cut("sha", 13, 4), cut("sha", 17, 4), cut("sha", 21, 12)), cut("digits", 1, 16), cut("digits", 3, 20), c(text("sha512-"), cut("b64", 1, 86))],
        "hollow": [
            c(text("your_"), "w0", text("_key_"), "few", text("1")), c(text("example-"), "w0", text("-"), "w1", text("-0000000")), c("w0", text("changeme123")), F.concat_ws("_", "w0", "w1", "w2", "few"), c(text("xxxxxxxx0000000000"), "few"),
            c(text("get"), F.initcap("w0"), F.initcap("w1"), text("Value2")), F.concat_ws("-", "w0", "w1", "w2", text("2024")),
        ],
        "prose": [
            c(text("/usr/lib/"), "w0", text("3/"), "w1", text("/v2/"), "w2", text(".py")), c("w0", text("-"), "w1", text("-2024-"), "w2"), c("w0", F.initcap("w1"), F.initcap("w2"), text("V2")), F.concat_ws("_", "w0", "w1", "w2", text("2")), cut("digits", 2, 16),
            c(F.repeat(cut("sha", 1, 1), text(20)), text("0")), c(F.translate(cut("sha", 1, 20), "0123456789abcdef", "etaonihsrdlucmfw"), text("5")), c("w0", "w1", "w2", "few"),
        ],
    }
    issued = [*PROSE_FORMS[:4], "key {v} of", "{n} = '{v}'"]
    kinds = [("secret", 1, SECRET_FORMS, SECRET_NAMES), ("secret", 1, SECRET_FORMS, SECRET_NAMES), ("issued", 1, issued, SECRET_NAMES), ("block", 1, [*PROSE_FORMS[:4], "{v}", "{n} = '{v}'", "x\n{v}\ny"], SECRET_NAMES), ("digest", 0, HASH_FORMS, HASH_NAMES), ("hollow", 0, SECRET_FORMS[:-1], SECRET_NAMES), ("prose", 0, PROSE_FORMS, HASH_NAMES)]
    starts = dict(zip(values, accumulate([0, *map(len, values.values())]), strict=False))
    table_ = F.array(*[F.struct(text(kind).alias("kind"), text(y).alias("label"), text(starts[kind]).alias("start"), text(len(values[kind])).alias("size"), literal(forms).alias("forms"), literal(names).alias("names")) for kind, y, forms, names in kinds])
    rows = staged(rows.withColumn("k", pick(table_, 1)), "kinds")
    rows = rows.withColumns({"at": F.col("k.start") + place(F.col("k.size"), 40), "form": pick(F.col("k.forms"), 60), "name": pick(F.col("k.names"), 80), "front": pick(literal(["", "x ", "of the ", "# "]), 90)})
    rows = rows.withColumn("value", F.get(F.array(*[v for vs in values.values() for v in vs]), F.col("at")))
    filled = F.replace(F.replace(F.replace("form", text("{N}"), F.upper("name")), text("{n}"), F.col("name")), text("{v}"), F.col("value"))
    return rows.select(F.col("id").alias("doc_id"), F.col("k.label").alias("label"), F.concat_ws("|", "at", "form").alias("form"), c("front", filled).alias("text"))


def train(findings: DataFrame, trees: int = 32, depth: int = 9, seed: int = 5):
    """A forest from labelled findings (text, label); every candidate of a text has its label."""
    rows = staged(with_features(candidates(findings, keep=("label",))).select("doc_id", "start", "label", *FEATURES), "findings")
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows.coalesce(1).sortWithinPartitions("doc_id", "start")).select("features", F.col("label").cast("double").alias("label"))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(rows)


def scan_secrets(docs: DataFrame, forest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All candidates: doc_id, start, secret_length, kind, head, sha256, probability."""
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_features(candidates(docs, id_col, text_col)))
    scored = forest.transform(rows)
    c = F.col("candidate")
    kind = (
        F.when(F.col("pem") > 0, "private_key").when(c.rlike("^(?:AKIA|ASIA)[A-Z0-9]{16}$"), "cloud_key_id").when(c.rlike("^gh[pousr]_"), "hosting_token").when(c.startswith("eyJ"), "web_token")
        .when((F.col("near_key") > 0) & F.col("before").rlike("(?i)pass|pwd"), "password").when(F.col("near_key") > 0, "assigned_key").otherwise("key_like")
    )
    return scored.select("doc_id", "start", F.char_length(c).alias("secret_length"), kind.alias("kind"), F.substring(c, 1, 4).alias("head"), F.sha2(c, 256).alias("sha256"), F.round(vector_to_array("probability")[1], 6).alias("probability"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings that the forest takes for secrets."""
    return scan_secrets(table(spark, sf_dir, "documents"), train(labelled_findings(spark))).filter("probability >= 0.5")
