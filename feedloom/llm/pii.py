"""Surrogates for personal data (native operators only).

Detected are e-mail addresses, card numbers, IBANs, phone numbers, IPv4 and IPv6
addresses, social security numbers and names.  Names are found by lists (a given
name or a title before a capitalised word, also in capitals), by context ("written
by", "Dear") and by what follows ("said", "met"); every word of a name found
in a document is then found wherever it stands in that document, capitalised or
in capitals.

Every distinct entity of the corpus gets one surrogate from a keyed digest, so
mentions of the same entity stay the same (coreference).  A name's entities are
its words, so "John Smith", "Mr Smith", "Smith" and "JOHN SMITH" keep their
relation.  Digits stay digits and letters letters at their places, separators
stay, a phone number keeps its country, a card number its first digit, card
numbers and IBANs the validity of their check digits; a given name is replaced by
one of its gender and script, another word of a name by syllables of its script.

Surrogates are checked: two entities of a type never share one, and none equals
an entity of the corpus.  Whatever collides is drawn again; where a format is
crowded, later attempts widen it, so every corpus comes to an end.  Each text is
matched once; only texts with an entity are shuffled, and very frequent
entities are met by broadcast (fewer than a thousand).

Defined results: a null text stays null with no entities, and so does an empty
one.  Rows that repeat an id are treated one by one.  The original entities are
not returned.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CLOSE, OPEN, enclosed, escaped, staged, table, unescaped, unstage

#: Given names by script and gender; fixed values.
GIVEN = {
    ("latin", "f"): "Aisha Alice Amelia Amina Anna Anne Barbara Beatriz Camille Carla Carmen Carol Caroline Catherine Charlotte Chloe Claire Clara Diana Elena Elizabeth Emily Emma Eva Fatima Giulia Grace Hannah Helen Ingrid Isabella Jane Jennifer Jessica Julia Karen Katharina Laura Linda Lisa Lucia Margaret Maria Marie Martina Mary Mei Monica Nancy Nora Olivia Patricia Paula Priya Rachel Rosa Ruth Sandra Sarah Sofia Sophie Susan Ursula Yuki Zoe".split(),
    ("latin", "m"): "Adam Ahmed Alexander Andrew Anthony Antonio Arjun Benjamin Brian Carlos Charles Christopher Daniel David Diego Edward Eric Felix Francesco Frank George Giovanni Hans Henri Henry Hugo Ivan Jack James Jan Javier Johann John Jonathan Joseph Juan Karl Kenji Kevin Klaus Lars Louis Luca Marco Mark Martin Matthew Michael Mohammed Nicolas Oliver Omar Oscar Pablo Patrick Paul Pedro Peter Philip Pierre Rahul Richard Robert Samuel Stefan Steven Thomas Tobias William".split(),
    ("cyrillic", "f"): "Анна Мария Ольга Елена Ирина Наталья Татьяна Светлана".split(),
    ("cyrillic", "m"): "Иван Пётр Сергей Алексей Дмитрий Николай Андрей Михаил".split(),
    ("greek", "f"): "Ελένη Μαρία Σοφία Κατερίνα Άννα Ιωάννα".split(),
    ("greek", "m"): "Γιώργος Νίκος Κώστας Δημήτρης Γιάννης Παύλος".split(),
}
TITLES = {"f": "Mrs Ms Miss Frau Madame Mme Señora Signora Lady".split(), "m": "Mr Herr Monsieur Señor Signor Sir Lord".split(), "": "Dr Prof Professor".split()}
PARTICLES = "von der van den de la los del della di da dos le al bin ibn zu".split()
SYLLABLES = {
    "latin": "bar ben cor dal del far fen gar hol kel lan lor mar men nor pel ral ren sal sen tam tel tor val ven wal wen yor zan mil dor kas".split(),
    "cyrillic": "бар вел гор дан ден зор кар лан лор мар нев пел рам сал тан вор".split(),
    "greek": "βαρ γελ δαν θορ καλ λαν μαρ νελ παλ ραν σαλ ταν φορ χαλ ζαν δορ".split(),
}
ENDINGS = {("latin", "f"): "ia ina elle ette".split(), ("latin", "m"): "us an ert os".split(), ("cyrillic", "f"): "ина ия".split(), ("cyrillic", "m"): "ий ан".split(), ("greek", "f"): "ία ίνα".split(), ("greek", "m"): "ος ης".split()}
#: Signs of a name before or after it; fixed values.
BEFORE = "named|called|name is|name:|I am|I'm|Dear|[Rr]egards,|[Ss]incerely,|[Ss]igned by|[Ss]igned:|[Aa]uthor:|[Ww]ritten by|[Cc]ontact:|[Cc]ontact|[Aa]ttn:|[Tt]hanks,|[Cc]c:"
AFTER = "said|says|wrote|writes|asked|replied|told|lives|lived|works|worked|was born|met|called|signed|paid|owes|and I"
_NO_NAMES = "Sir|Madam|All|Team|Customer|Friends?|Reader|Editor|Colleagues?"
_all_given = [n for names in GIVEN.values() for n in names]
_given, _given_caps = "|".join(_all_given), "|".join(n.upper() for n in _all_given)
_titles = "|".join(sorted((t for ts in TITLES.values() for t in ts), key=lambda t: (-len(t), t)))
_word = r"(?:\p{Lu}['’])?\p{Lu}\p{L}+(?:[-'’]\p{Lu}\p{L}+)*"
_caps = r"\p{Lu}{2,}(?:[-'’]\p{Lu}{2,})*(?!\p{L})"
_particle = "(?:(?:" + "|".join(PARTICLES) + ") ){0,2}"
EMAIL = r"(?<![\p{L}\p{N}])[\p{L}\p{N}][\p{L}\p{N}._%+-]{0,63}+@[\p{L}\p{N}][\p{L}\p{N}.-]{0,250}\.\p{L}{2,}"
CARD = r"(?<![\d.-])(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{4}[ -]\d{6}[ -]\d{5}|\d{15,16})(?![\d-])"
IBAN = r"(?<!\w)[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?!\w)"
PHONE = r"(?<![\w.])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}[ .-]?\d{3,4}(?:[ .-]?\d{2,4}){0,2}(?!\w)|\(\d{3}\) ?\d{3}-\d{4}(?!\w)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])"
IP = r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d|\w)"
_hex = "[0-9A-Fa-f]{1,4}"
IP6 = rf"(?<![\w:.])(?=[0-9A-Fa-f:]*[0-9])(?:(?:{_hex}:){{7}}{_hex}|(?:{_hex}:){{1,6}}(?::{_hex}){{1,6}}|(?:{_hex}:){{1,7}}:|::(?:{_hex}:){{0,6}}{_hex})(?![\w:])"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
NAME = (
    rf"(?<!\p{{L}})(?=\p{{Lu}})(?:(?:{_titles})\.? (?:(?:{_given}|\p{{Lu}}\.) )?{_particle}(?!(?:{_titles})\b){_word}(?:(?<!(?:Herr|Frau) \p{{L}}{{1,40}}) {_word})?"
    rf"|(?:{_given})(?: (?:{_given}|\p{{Lu}}\.))? {_particle}{_word}|(?:{_given_caps})(?: \p{{Lu}}\.)? {_caps}"
    rf"|(?<=(?:{BEFORE})\s)(?!(?:{_NO_NAMES})\b){_word} {_particle}{_word}|(?<=(?:Dear|name is) )(?!(?:{_NO_NAMES})\b){_word}"
    rf"|{_word} {_particle}{_word}(?=,? (?:{AFTER})\b))"
)
ENTITY = f"{EMAIL}|{IBAN}|{CARD}|{SSN}|{PHONE}|{IP}|{IP6}|{NAME}"
#: Country calling codes: one digit, two digits, else three; fixed values.
CALLING = r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
NUMBERS = ("card", "phone", "ssn")


def kind_of(m: Column) -> Column:
    return (
        F.when(m.contains("@"), "email").when(m.rlike(f"^(?:{IP})$"), "ip").when(m.rlike("^[0-9A-Fa-f:]*::[0-9A-Fa-f:]*$|^(?:[0-9A-Fa-f]{1,4}:){7}"), "ipv6").when(m.rlike(f"^(?:{SSN})$"), "ssn").when(m.rlike(r"^[A-Z]{2}\d{2}"), "iban")
        .when(m.rlike(r"^(?:\d{15,16}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{4}[ -]\d{6}[ -]\d{5})$"), "card").when(m.rlike(r"\d"), "phone").otherwise("name")
    )


def canonical(m: Column, kind: Column) -> Column:
    """What makes two mentions the same entity; for names, of one word."""
    return F.when(kind.isin("email", "ipv6", "name"), F.lower(m)).when(kind == "phone", F.regexp_replace(m, r"(?<!^)\+|[^\d+]", "")).when(kind.isin("card", "ssn"), F.regexp_replace(m, r"\D", "")).when(kind == "iban", F.replace(m, F.lit(" "), F.lit(""))).otherwise(m)


def _stream(key: str, what: Column, attempt: Column) -> Column:
    seed = F.concat_ws("|", F.lit(key), what, attempt.cast("string"))
    return F.concat(F.sha2(seed, 256), F.sha2(F.concat(seed, F.lit("+")), 256))


def _byte(stream: Column, i: Column) -> Column:
    return F.conv(F.substring(stream, (F.pmod(i, F.lit(64)) * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def _marks(pattern: Column) -> Column:
    return F.filter(F.split(pattern, ""), lambda c: c != "")


def fill(pattern: Column, stream: Column, hexadecimal: bool = False) -> Column:
    """Letters and digits of the pattern drawn anew; everything else stays."""
    digits = F.lit("0123456789abcdef")

    def draw(ch: Column, i: Column) -> Column:
        b = _byte(stream, i)
        if hexadecimal:
            return F.when(ch.rlike("[0-9a-f]"), F.substring(digits, b % 16 + 1, F.lit(1))).otherwise(ch)
        return F.when(ch.rlike("[0-9]"), (b % 10).cast("string")).when(ch.rlike(r"\p{Lu}"), F.char(b % 26 + 65)).when(ch.rlike(r"\p{L}"), F.char(b % 26 + 97)).otherwise(ch)

    return F.array_join(F.transform(_marks(pattern), draw), "")


def luhn(digits: Column) -> Column:
    """The Luhn sum modulo 10, 0 for a valid number."""
    marks = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(marks, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10


def mod97(iban: Column) -> Column:
    """The remainder of an IBAN, 1 for a valid one."""
    turned = F.concat(F.substring(iban, F.lit(5), F.char_length(iban)), F.substring(iban, 1, 4))
    return F.aggregate(_marks(turned), F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def script_of(s: Column) -> Column:
    return F.when(s.rlike(r"\p{IsCyrillic}"), "cyrillic").when(s.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def gender_of(word: Column) -> Column:
    """Of a given name in lower case; null for any other word."""
    out = F.lit(None).cast("string")
    for g in ("f", "m"):
        out = F.when(word.isin(*[n.lower() for (_, x), names in GIVEN.items() if x == g for n in names]), g).otherwise(out)
    return out


def titled(mention: Column) -> Column:
    """The gender that a name's title tells."""
    return F.when(mention.rlike(rf"^(?:{'|'.join(TITLES['f'])})\b"), "f").when(mention.rlike(rf"^(?:{'|'.join(TITLES['m'])})\b"), "m")


def _choose(options: list[str], b: Column) -> Column:
    return F.get(F.array(*map(F.lit, options)), b % len(options))


def surrogate(kind: Column, entity: Column, hint: Column, attempt: Column, key: str) -> Column:
    """The surrogate of a canonical entity at an attempt; later attempts widen its format."""
    s = _stream(key, F.concat_ws(":", kind, entity), attempt)
    local, host = F.substring_index(entity, "@", 1), F.substring_index(entity, "@", -1)
    tld = F.substring_index(host, ".", -1)
    stem = F.substring(host, F.lit(1), F.char_length(host) - F.char_length(tld) - 1)
    wider = F.when(attempt > 4, F.translate(F.substring(s, F.lit(1), F.least(attempt - 4, F.lit(60))), "abcdef", "123456")).otherwise("")
    mail = F.concat(fill(local, s), wider, F.lit("@"), fill(stem, _stream(key, host, F.lit(0))), F.lit("."), tld)
    rest = F.substring(entity, F.lit(2), F.char_length(entity))
    digits = F.concat(F.substring(entity, 1, 1), fill(rest, s), wider)
    calling = F.regexp_extract(entity, CALLING, 0)
    national = fill(F.substring(entity, F.char_length(calling) + 1, F.char_length(entity)), s)
    first = F.when(F.substring(entity, F.char_length(calling) + 1, F.lit(1)) == "0", "0").otherwise((_byte(s, F.lit(62)) % 8 + 2).cast("string"))
    phone = F.concat(calling, first, F.substring(national, F.lit(2), F.char_length(national)), wider)
    head = F.substring(digits, F.lit(1), F.char_length(digits) - 1)
    check = (10 - luhn(F.concat(head, F.lit("0")))) % 10
    # Another last digit where the original isn't a valid card number.
    card = F.concat(head, F.when(luhn(entity) == 0, check).otherwise((check + 1 + F.pmod(_byte(s, F.lit(63)), F.lit(9))) % 10).cast("string"))
    account = F.concat(fill(F.substring(entity, F.lit(5), F.char_length(entity)), s), wider)
    land = F.substring(entity, 1, 2)
    sum97 = F.lpad((98 - mod97(F.concat(land, F.lit("00"), account))).cast("string"), 2, "0")
    iban = F.concat(land, F.when(mod97(entity) == 1, sum97).otherwise(fill(F.substring(entity, 3, 2), _stream(key, entity, F.lit(1)))), account)
    b = [_byte(s, F.lit(i)) for i in range(12)]
    octets = [(x % 254 + 1).cast("string") for x in b[:4]]
    hexes = F.concat_ws(":", F.lit("2001"), F.lit("db8"), *[F.substring(s, 4 * i + 1, 4) for i in range(6)])
    ip = (
        F.when((attempt <= 8) & entity.startswith("10."), F.concat_ws(".", F.lit("10"), *octets[1:])).when((attempt <= 8) & entity.startswith("192.168."), F.concat_ws(".", F.lit("192"), F.lit("168"), *octets[2:]))
        .when(attempt <= 16, F.concat_ws(".", (b[0] % 200 + 11).cast("string"), *octets[1:])).otherwise(hexes)
    )
    ip6 = F.when(attempt > 8, hexes).otherwise(fill(entity, s, hexadecimal=True))
    gender = F.coalesce(gender_of(entity), hint)
    script, name = script_of(entity), F.lit(None).cast("string")
    two = b[0] * 256 + b[1]
    for sc, syllables in SYLLABLES.items():
        parts = [_choose(syllables, b[i]) for i in range(2, 8)]
        many = F.when((F.char_length(entity) > 7) | (attempt > 4), F.concat(*parts[:3])).otherwise(F.concat(*parts[:2]))
        made = F.when(attempt > 8, F.concat(many, *parts[3:])).otherwise(many)
        for g in ("f", "m"):
            new = F.concat(F.when(attempt > 12, made).otherwise(F.concat(*parts[:2])), _choose(ENDINGS[sc, g], b[8]))
            name = F.when((script == sc) & (gender == g), F.when(attempt < 3, _choose([n.lower() for n in GIVEN[sc, g]], two)).otherwise(new)).otherwise(name)
        name = F.when((script == sc) & gender.isNull(), made).otherwise(name)
    name = F.when(attempt > 16, F.concat(name, F.translate(F.substring(s, F.lit(1), F.least(attempt - 16, F.lit(60))), "0123456789", "abcdefghij"))).otherwise(name)
    return F.when(kind == "email", mail).when(kind == "card", card).when(kind == "phone", phone).when(kind == "iban", iban).when(kind == "ip", ip).when(kind == "ipv6", ip6).when(kind == "name", name).otherwise(digits)


def render(kind: Column, mention: Column, drawn: Column) -> Column:
    """The surrogate in the mention's own format."""

    def dressed(signs: Column, at: str) -> Column:
        """The drawn signs at the places of the mention's own; what is left over at its end."""
        state = F.struct(F.array().cast("array<string>").alias("out"), F.lit(1).alias("k"))
        step = lambda a, ch: F.when(ch.rlike(at), F.struct(F.concat(a["out"], F.array(F.substring(signs, a["k"], F.lit(1)))).alias("out"), (a["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(a["out"], F.array(ch)).alias("out"), a["k"].alias("k")))
        return F.aggregate(_marks(mention), state, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(signs, a["k"], F.lit(80))))

    cased = F.when(F.upper(mention) == mention, F.upper(drawn)).otherwise(F.initcap(drawn))
    return F.when(kind.isin(*NUMBERS), dressed(F.replace(drawn, F.lit("+"), F.lit("")), "[0-9]")).when(kind == "iban", dressed(drawn, "[A-Z0-9]")).when(kind == "name", cased).otherwise(drawn)


def dictionary(entities: DataFrame, key: str) -> DataFrame:
    """Distinct (kind, entity) with surrogates that collide with nothing."""
    if "hint" not in entities.columns:
        entities = entities.withColumn("hint", F.lit(None).cast("string"))
    entities = staged(entities.groupBy("kind", "entity").agg(F.max("hint").alias("hint")), "entities")
    settled, pending = None, entities.withColumn("attempt", F.lit(0))
    while True:  # later attempts widen the format, so this ends
        drawn = staged(pending.withColumn("drawn", surrogate(F.col("kind"), F.col("entity"), F.col("hint"), F.col("attempt"), key)), "drawn")
        pool = drawn.select("kind", "drawn", "entity", F.lit(1).alias("late"))
        if settled is not None:
            pool = pool.unionByName(settled.select("kind", "drawn", "entity", F.lit(0).alias("late")))
        winners = pool.groupBy("kind", "drawn").agg(F.min(F.struct("late", "entity")).alias("w")).select("kind", "drawn", F.col("w.entity").alias("entity"))
        real = entities.select("kind", F.col("entity").alias("drawn"))
        good = drawn.join(winners, ["kind", "drawn", "entity"], "left_semi").join(real, ["kind", "drawn"], "left_anti").select("kind", "entity", "drawn")
        good = staged(good if settled is None else settled.unionByName(good), "good")
        bad = staged(drawn.join(good, ["kind", "entity"], "left_anti").select("kind", "entity", "hint", (F.col("attempt") + 1).alias("attempt")), "bad")
        unstage(drawn, *([settled] if settled is not None else []))
        if bad.isEmpty():
            unstage(bad, entities)
            return good
        settled, pending = good, bad


def _mentions(marked: Column) -> Column:
    after = F.split(F.substring(marked, F.instr(marked, OPEN) + 1, F.char_length(marked)), OPEN, -1)
    return F.transform(F.when(marked.contains(OPEN), after), lambda p: F.substring_index(p, CLOSE, 1))


def with_bare_names(marked: Column) -> Column:
    """Encloses every other place of the words of names that the document holds, capitalised or in capitals."""
    names = F.filter(_mentions(marked), lambda m: kind_of(m) == "name")
    words = F.flatten(F.transform(names, lambda m: F.regexp_extract_all(F.regexp_replace(m, rf"^(?:{_titles})\b", ""), F.lit(r"\p{L}{3,}"), F.lit(0))))
    words = F.array_distinct(F.filter(F.transform(words, lambda w: F.lower(w)), lambda w: ~w.isin(*PARTICLES)))

    def again(ws: Column) -> Column:
        forms = F.concat(F.transform(ws, F.initcap), F.transform(ws, F.upper))
        pattern = F.concat(F.lit(rf"{OPEN}[^{CLOSE}]*{CLOSE}|(?<!\p{{L}})(?:"), F.array_join(forms, "|"), F.lit(r")(?!\p{L})"))
        twice = F.regexp_replace(marked, pattern, F.lit(OPEN + "$0" + CLOSE))
        return F.when(F.size(ws) > 0, F.replace(F.replace(twice, F.lit(OPEN * 2), F.lit(OPEN)), F.lit(CLOSE * 2), F.lit(CLOSE))).otherwise(marked)

    return F.get(F.transform(F.array(words), again), F.lit(0))


def replace_pii(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, text with surrogates, n_entities, entities (kind, surrogate)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), enclosed(escaped(F.col(text_col)), ENTITY).alias("marked"), F.monotonically_increasing_id().alias("row"))
    rows = staged(rows, "marked")
    has = F.coalesce(F.col("marked").contains(OPEN), F.lit(False))
    kinds = "array<struct<kind:string,surrogate:string>>"
    clean = rows.filter(~has).select("doc_id", unescaped(F.col("marked")).alias("text"), F.lit(0).alias("n_entities"), F.array().cast(kinds).alias("entities"))
    found = staged(rows.filter(has).withColumn("marked", with_bare_names(F.col("marked"))), "mentions")
    each = found.select("row", F.posexplode(_mentions(F.col("marked"))).alias("pos", "mention")).withColumn("kind", kind_of(F.col("mention")))
    name = F.col("kind") == "name"
    each = each.withColumn("words", F.when(name, F.regexp_extract_all("mention", F.lit(r"\p{L}+"), F.lit(0))).otherwise(F.array("mention")))
    each = each.select("row", "pos", "kind", "mention", F.size("words").alias("n"), F.posexplode("words").alias("at", "word"))
    stays = name & ((F.char_length("word") == 1) | F.lower("word").isin(*PARTICLES) | ((F.col("at") == 0) & (F.col("n") > 1) & F.col("word").rlike(f"^(?:{_titles})$")))
    hint = F.when(name & (F.col("at") < F.col("n") - 1), titled(F.col("mention")))
    each = each.withColumns({"entity": F.when(~stays, canonical(F.col("word"), F.col("kind"))), "hint": hint})
    each = staged(each.select("row", "pos", "at", "kind", "mention", "word", "entity", "hint"), "each")
    named = each.filter("entity IS NOT NULL")
    known = dictionary(named.select("kind", "entity", "hint"), key)
    counts = named.groupBy("kind", "entity").agg(F.count("*").alias("rows")).filter("rows > 10000")
    often = counts.filter(F.col("rows") > named.count() // 1000).select("kind", "entity")  # fewer than a thousand
    hot = F.broadcast(staged(known.join(often, ["kind", "entity"]), "hot"))
    both = named.join(hot, ["kind", "entity"]).unionByName(named.join(hot, ["kind", "entity"], "left_anti").join(known, ["kind", "entity"]))
    shown = both.withColumn("shown", render(F.col("kind"), F.col("word"), F.col("drawn"))).drop("drawn").unionByName(each.filter("entity IS NULL").withColumn("shown", F.col("word")))
    words = shown.repartition("row").groupBy("row", "pos").agg(F.min("kind").alias("kind"), F.min("mention").alias("mention"), F.array_sort(F.collect_list(F.struct("at", "shown"))).alias("words"))
    gaps = F.split("mention", r"\p{L}+", -1)
    joined = F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(F.col("words"), i)["shown"], F.lit("")))), "")
    whole = F.when(F.col("kind") == "name", joined).otherwise(F.get(F.col("words"), F.lit(0))["shown"])
    new = words.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "kind", whole.alias("surrogate")))).alias("all"))
    pieces = F.split("marked", OPEN, -1)
    text = F.array_join(F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.get(F.col("all"), i - 1)["surrogate"], F.substring_index(p, CLOSE, -1)))), "")
    dirty = found.join(new, "row").select("doc_id", unescaped(text).alias("text"), F.size("all").alias("n_entities"), F.transform("all", lambda x: F.struct(x["kind"].alias("kind"), x["surrogate"].alias("surrogate"))).alias("entities"))
    return clean.unionByName(dirty).withColumnsRenamed({"doc_id": id_col, "text": text_col})


KEY = "spark.feedloom.pii.key"
_keys: dict[str, str] = {}


def key_of(spark: SparkSession) -> str:
    """The key of the session's setting; without one a random key, which lasts as long as the application."""
    return spark.conf.get(KEY, None) or _keys.setdefault(spark.sparkContext.applicationId, secrets.token_hex(16))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_pii(table(spark, sf_dir, "documents"), key=key_of(spark))
