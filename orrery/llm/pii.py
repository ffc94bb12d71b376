"""Personal data replaced by surrogates. DataFrame functions only.

Entities are found by patterns. Each gets a replacement drawn from a keyed hash (HMAC) of its type and normalised form,
so the same entity has the same surrogate everywhere (coreference), however it is written, and nothing about it can be
read without the key. The replacement keeps type and format: letters stay letters of the same case, digits digits,
separators and country codes stay, octets of an address stay below 256, a card or account number that passes its check
digits passes them again, a given name is replaced by one of the same gender and script, a family name by one of the
same script. Names are found after a title; in the same document the words of a found name are then found again without
one. Surrogates that collide with each other or with an entity of the corpus are drawn anew until all are distinct;
where a kind runs out of them, they grow by syllables or characters.
"""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lookup, materialize

#: Titles by gender, given names by gender and script, syllables of family names by script, and telephone
#: country codes (of one and two digits; others have three).
TITLES_M = r"Mr|Mister|Herr|Monsieur|Señor|Don|господин|г-н"
TITLES_F = r"Mrs|Ms|Miss|Frau|Madame|Mademoiselle|Señora|Señorita|Doña|госпожа|г-жа"
TITLES_N = r"Dr|Doctor|Doktor|Docteur|Prof|Professor|доктор|профессор"
GIVEN = {
    "ml": ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Hugo", "Jonas", "Lucas", "Martin", "Oscar", "Simon"],
    "fl": ["Alice", "Bella", "Clara", "Diana", "Emma", "Flora", "Greta", "Helena", "Julia", "Laura", "Nora", "Sofia"],
    "mc": ["Андрей", "Борис", "Виктор", "Глеб", "Денис", "Иван", "Кирилл", "Максим", "Олег", "Павел", "Роман", "Юрий"],
    "fc": ["Алла", "Вера", "Галина", "Дарья", "Елена", "Инна", "Лидия", "Мария", "Нина", "Ольга", "Раиса", "Юлия"],
}
GIVEN |= {"n" + s: GIVEN["m" + s] + GIVEN["f" + s] for s in "lc"}
SYLLABLES = {
    "l": ["ba", "den", "fal", "gor", "hin", "kel", "lan", "mor", "nes", "pal", "ran", "sel", "tor", "val", "wen", "zan"],
    "c": ["ба", "вен", "гор", "дал", "зин", "кел", "лан", "мор", "нес", "пал", "ран", "сел", "тор", "фан", "хол", "шин"],
}
COUNTRY = r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
PREFIX = r"(?:sk|pk|rk)[-_](?:live_|test_|proj-)?|gh[pousr]_|github_pat_|xox[abprs]-|AKIA|ASIA"

TITLES = f"{TITLES_M}|{TITLES_F}|{TITLES_N}"
NAME = r"\p{Lu}['’]?\p{L}++(?:-\p{Lu}\p{L}++)?"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+)+",
    "key": rf"(?<![A-Za-z0-9_-])(?:{PREFIX})[A-Za-z0-9_-]{{16,}}+",
    "secret": r"(?<![A-Za-z0-9])[0-9A-Fa-f]{32,128}+(?![A-Za-z0-9])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<!\d)(?:\d{4}([ -]?)\d{4}\2\d{4}\2\d{4}|3[47]\d\d[ -]?\d{6}[ -]?\d{5})(?!\d)",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d)|(?<![\d+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)",
    "name": rf"(?<![\p{{L}}-])(?:{TITLES})\.? (?:(?:{TITLES_N})\.? )?(?:\p{{Lu}}\. ){{0,2}}{NAME}(?:(?: \p{{Lu}}\.){{0,2}} {NAME})?",
}
#: Whether a text can hold any entity at all, a cheap test for most of them, and whether it can hold a name.
TITLED = rf"(?<![\p{{L}}-])(?:{TITLES})\.? \p{{Lu}}"
HINT = rf"[0-9@]|{TITLED}|[A-Fa-f]{{32}}|(?<![A-Za-z0-9_-])(?:{PREFIX})[A-Za-z_-]{{16}}"
UNION = "(" + "|".join(PATTERNS[k] for k in PATTERNS) + ")"
#: In texts that can hold names, capitalised words are found too, as mentions that may repeat a name.
WORDS_TOO = UNION[:-1] + rf"|(?<![\p{{L}}\p{{N}}_-]){NAME})"
#: Rounds of drawing before surrogates grow, and rounds in all.
SAME, ROUNDS = 4, 64


def kind(m: Column) -> Column:
    out = F.when(m.rlike(f"^(?:{TITLES})\\.? "), "name").otherwise("word")
    for k in reversed([k for k in PATTERNS if k != "name"]):
        out = F.when(m.rlike("^(?:" + PATTERNS[k].replace(r"\2", r"\1") + ")$"), k).otherwise(out)
    return out


def digest(*parts: Column) -> Column:
    """64 hex digits of SHA-256."""
    return F.sha2(F.concat_ws("|", *parts), 256)


def keyed(key: str, *parts: Column) -> Column:
    """64 hex digits of HMAC-SHA-256 under ``key``."""
    raw = key.encode()
    block = (sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ x for b in block).hex())) for x in (0x36, 0x5C))
    message = F.concat_ws("|", *parts).cast("binary")
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256)


def byte(d: Column, i: Column) -> Column:
    return F.conv(F.substring(d, i * 2 + 1, F.lit(2)), 16, 10).cast("int")


def redraw(text: Column, key: Column) -> Column:
    """``text`` with every ASCII letter and digit drawn anew in its class; hexadecimal stays hexadecimal."""
    hexadecimal = text.rlike("^[0-9A-Fa-f]{32,}$")
    # a digest holds the draws of 32 characters; the array of one binds them all
    draws = F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / 32).cast("int")), lambda b: F.sha2(F.concat_ws("|", key, b.cast("string")), 512)), "")

    def drawn(stream: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            n = F.conv(F.substring(stream, i * 4 + 1, F.lit(4)), 16, 10).cast("int")
            lower = F.chr(F.lit(97) + F.when(hexadecimal, n % 6).otherwise(n % 26))
            return F.when(c.rlike("[0-9]"), F.chr(F.lit(48) + n % 10)).when(c.rlike("[a-z]"), lower).when(c.rlike("[A-Z]"), F.upper(lower)).otherwise(c)

        return F.array_join(F.transform(F.split(text, ""), one), "")

    return F.transform(F.array(draws), drawn)[0]


def luhn(digits: Column) -> Column:
    """Sum of the check-digit rule over an array of digits, the last one counting once."""
    n = F.size(digits)
    weighed = F.transform(digits, lambda d, i: F.when((n - i) % 2 == 0, F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)).otherwise(d))
    return F.aggregate(weighed, F.lit(0), lambda a, x: a + x)


def numbers(text: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(text, "[^0-9]", ""), ""), lambda c: c.cast("int"))


def card(text: Column, key: Column) -> Column:
    new = redraw(text, key)
    base = F.concat(F.substring(new, F.lit(1), F.length(new) - 1), F.lit("0"))
    check = (F.lit(10) - luhn(numbers(base)) % 10) % 10
    return F.when(luhn(numbers(text)) % 10 == 0, F.concat(F.substring(new, F.lit(1), F.length(new) - 1), check.cast("string"))).otherwise(new)


def mod97(text: Column) -> Column:
    """Remainder of a number in which A to Z stand for 10 to 35."""
    def more(a: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), a * 10 + c.cast("int")).when(c.rlike("[A-Z]"), a * 100 + F.ascii(c) - 55).otherwise(a) % 97

    return F.aggregate(F.split(text, ""), F.lit(0), more)


def account(text: Column, extra: str, key: Column) -> Column:
    """The country stays; check digits that are right are right again."""
    country, check, rest = F.substring(text, 1, 2), F.substring(text, 3, 2), F.substring(text, F.lit(5), F.length(text))
    right = mod97(F.concat(rest, country, check)) == 1
    fresh = F.transform(F.array(redraw(F.concat(rest, F.lit(extra)), key)), lambda n: F.concat(country, F.lpad((F.lit(98) - mod97(F.concat(n, country, F.lit("00")))).cast("string"), 2, "0"), n))[0]
    return F.when(right, fresh).otherwise(F.concat(country, redraw(F.concat(check, rest, F.lit(extra)), key)))


def address(text: Column, extra: int, key: Column) -> Column:
    octets = F.array_repeat(F.lit("0"), 4 + extra)
    return F.array_join(F.transform(octets, lambda c, i: (byte(digest(key, i.cast("string")), F.lit(0)) % 223 + 1).cast("string")), ".")


def behind(text: Column, pattern: str, extra: str, key: Column) -> Column:
    """What ``pattern`` matches at the beginning stays."""
    kept = F.regexp_extract(text, pattern, 0)
    return F.concat(kept, redraw(F.concat(F.substring(text, F.length(kept) + 1, F.length(text)), F.lit(extra)), key))


def choose(options: list[str], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), n % len(options) + 1)


def person(kind: Column, key: Column, attempt: int) -> Column:
    """A name; later attempts have more syllables, so there is no end of them."""
    d = digest(key, F.lit("name"))

    def syllables(s: str, first: int, n: int) -> Column:
        return F.concat(*[choose(SYLLABLES[s], byte(d, F.lit((first + i) % 32))) for i in range(min(n, 24))])

    out = F.initcap(syllables("l", 0, 4 + attempt))
    out = F.when(kind == "family_c", F.initcap(syllables("c", 0, 4 + attempt))).otherwise(out)
    for k, names in GIVEN.items():  # the listed names first
        given = choose(names, byte(d, F.lit(31)))
        out = F.when(kind == f"given_{k}", F.concat(given, syllables(k[1], 8, 2 + attempt)) if attempt else given).otherwise(out)
    return out


def surrogate(kind: Column, form: Column, key: str, attempt: int) -> Column:
    """The replacement of a normalised entity; case and separators are put back where it is used."""
    k = keyed(key, kind, form, F.lit(str(attempt)))
    extra = max(0, attempt - SAME + 1)
    zeros, letters = "0" * extra, "a" * extra
    mail = F.concat(redraw(F.concat(F.regexp_extract(form, r"^([^@]*)@", 1), F.lit(letters), F.regexp_extract(form, r"@.*(?=\.[^.]*$)", 0)), k), F.regexp_extract(form, r"\.[^.]*$", 0))
    return (
        F.when(kind == "card", card(F.concat(form, F.lit(zeros)), k)).when(kind == "ip", address(form, extra, k))
        .when(kind == "phone", behind(form, COUNTRY, zeros, k)).when(kind == "key", behind(form, f"^(?:{PREFIX})", zeros, k)).when(kind == "iban", account(form, zeros, k))
        .when(kind.rlike("^(given|family)"), person(kind, k, attempt)).when(kind == "email", mail)
        .otherwise(redraw(F.concat(form, F.lit(zeros)), k))
    )


def assign(entities: DataFrame, key: str) -> DataFrame:
    """(kind, form, n, new): distinct surrogates within a kind (within all names), none of them an entity of the corpus.

    Each round draws for the entities that have none. A draw holds if it isn't an entity of its kind, wasn't given out
    in an earlier round, and its entity is the first (by kind and form) to draw it; the others draw again with the next
    attempt. After SAME rounds surrogates get longer by a character a round (names from the second on), so the
    supply grows ten-fold or more a round and the rounds end; after ROUNDS of them an error says so.
    """
    space = F.regexp_replace("kind", "^(given|family)_.*", "name")
    known = entities.select(space.alias("space"), F.col("form").alias("new"))
    parts = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    given, left = None, entities
    for attempt in range(ROUNDS):
        # drawing costs far more than an entity's bytes, by which partitions would be joined together
        spread = left.repartition(parts, "kind", "form")
        drawn = spread.withColumn("new", surrogate(F.col("kind"), F.col("form"), key, attempt)).withColumn("space", space)
        taken = known if given is None else known.unionByName(given.select(space.alias("space"), "new"))
        free = drawn.join(taken, ["space", "new"], "left_anti")
        first = free.groupBy("space", "new").agg(F.min(F.struct("kind", "form")).alias("f")).select("f.kind", "f.form", "new")
        held = materialize(entities.join(first, ["kind", "form"]).select("kind", "form", "n", "new"), "surrogates")
        given = held if given is None else given.unionByName(held)
        left = left.join(held.select("kind", "form"), ["kind", "form"], "left_anti")
        if left.isEmpty():
            return given
        left = materialize(left, "again")
    raise RuntimeError(f"{left.count()} entities have no surrogate after {ROUNDS} rounds")


def laid(raw: Column, new: Column) -> Column:
    """``new`` in the places of the letters, digits and plus signs of ``raw``, whose separators stay; what is left at the end."""
    bare = lambda c: F.length(F.regexp_replace(c, "[^A-Za-z0-9+]", ""))
    places = F.transform(F.split(raw, ""), lambda c, i: F.when(c.rlike("[A-Za-z0-9+]"), F.substring(new, bare(F.substring(raw, F.lit(1), i + 1)), F.lit(1))).otherwise(c))
    return F.concat(F.array_join(places, ""), F.substring(new, bare(raw) + 1, F.length(new)))


def units_of(hit: DataFrame) -> DataFrame:
    """(_row, at, part, raw, kind, form, gender) of the mentions: a name's words one by one, kind ``keep`` for what stays."""
    mentions = hit.select("_row", F.posexplode("found").alias("at", "raw")).withColumn("kind", kind(F.col("raw")))
    gender = F.when(F.col("raw").rlike(f"^(?:{TITLES_M})[. ]"), "m").when(F.col("raw").rlike(f"^(?:{TITLES_F})[. ]"), "f")
    words = F.split("raw", " ")

    def part(w: Column, i: Column) -> Column:
        script = F.when(w.rlike(r"\p{IsCyrillic}"), "c").otherwise("l")
        last = i == F.size(words) - 1
        stays = (i == 0) | w.rlike(r"^\p{Lu}\.$") | (~last & w.rlike(f"^(?:{TITLES_N})\\.?$"))
        return F.struct(w.alias("raw"), F.when(stays, "keep").otherwise(F.concat(F.when(last, "family_").otherwise("given_"), script)).alias("kind"))

    parts = F.when(F.col("kind") == "name", F.transform(words, part)).otherwise(F.array(F.struct(F.col("raw").alias("raw"), F.col("kind").alias("kind"))))
    units = mentions.select("_row", "at", gender.alias("gender"), F.posexplode(parts).alias("part", "u")).select("_row", "at", "part", "u.raw", "u.kind", "gender")
    form = (
        F.when(F.col("kind").isin("email", "secret"), F.lower("raw")).when(F.col("kind") == "card", F.regexp_replace("raw", "[^0-9]", ""))
        .when(F.col("kind") == "phone", F.regexp_replace("raw", "[^0-9+]", "")).when(F.col("kind") == "iban", F.replace("raw", F.lit(" "), F.lit("")))
        .when(F.col("kind").rlike("^(given|family|word)"), F.initcap("raw")).otherwise(F.col("raw"))
    )
    return units.withColumn("form", form)


def repeats(units: DataFrame) -> DataFrame:
    """``units`` with the capitalised words of a document that are words of its names as such (family names first), others kept."""
    names = units.filter(F.col("kind").rlike("^(given|family)")).groupBy("_row", "form").agg(F.min("kind").alias("named"))
    words = units.filter("kind = 'word'").join(names, ["_row", "form"], "left").withColumn("kind", F.coalesce("named", F.lit("keep")))
    return units.filter("kind <> 'word'").unionByName(words.select(units.columns))


def anonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_entities, kinds) of every row, entities replaced; whole texts.

    Kinds: email, key (prefixed tokens), secret (32 hexadecimal digits or more), ip, iban, ssn, card, phone, and names
    after a title, with later mentions of their words in the same document. A given name's gender is that of most of its
    titles in the corpus. Null text stays null, with no entities; an empty one stays empty. Null ids and repeated rows
    are kept. Very long texts are handled in time linear in their length. Distinct entities get distinct surrogates,
    longer ones where their kind has run out. An empty table gives no rows. Other columns are not looked at.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    titled = F.col("text").rlike(TITLED)
    none = F.array().cast("array<string>")
    found = F.when(titled, F.regexp_extract_all(F.col("text"), F.lit(WORDS_TOO), F.lit(0))).when(F.col("text").rlike(HINT), F.regexp_extract_all(F.col("text"), F.lit(UNION), F.lit(0)))
    clean = rows.withColumn("found", F.coalesce(found, none))
    pieces = F.when(titled, F.split("text", WORDS_TOO, -1)).otherwise(F.split("text", UNION, -1))
    hit = clean.filter("size(found) > 0").withColumn("_row", F.monotonically_increasing_id()).withColumn("pieces", pieces)
    hit = materialize(hit.select("_row", "doc_id", "found", "pieces"), "found")
    units = materialize(repeats(materialize(units_of(hit), "mentions")), "units")
    counts = units.filter("kind <> 'keep'").groupBy("kind", "form").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("gender") == "m", 1)).alias("m"), F.count(F.when(F.col("gender") == "f", 1)).alias("f"))
    gender = F.when(F.col("m") > F.col("f"), "m").when(F.col("m") < F.col("f"), "f").otherwise("n")
    full = F.when(F.col("kind").startswith("given_"), F.concat(F.lit("given_"), gender, F.substring("kind", -1, 1))).otherwise(F.col("kind"))
    entities = materialize(counts.select(full.alias("kind"), "form", "n"), "entities")
    plain = F.regexp_replace("kind", "^given_.(.)$", "given_$1")
    named = assign(entities, key).withColumn("entity", F.concat_ws(":", plain, "form")).select("entity", "new", "n")
    new = lookup(units.filter("kind <> 'keep'").withColumn("entity", F.concat_ws(":", "kind", "form")), named, "entity", "n")
    # a mention keeps its own capitals and separators
    capitals = F.col("kind").rlike("^(email|secret|given|family)") & (F.col("raw") == F.upper("raw"))
    shown = F.when(F.col("kind").isin("card", "phone", "iban"), laid(F.col("raw"), F.col("new"))).when(capitals, F.upper("new")).otherwise(F.col("new"))
    new = new.select("_row", "at", "part", "kind", shown.alias("new"))
    new = new.unionByName(units.filter("kind = 'keep'").select("_row", "at", "part", "kind", F.col("raw").alias("new")))
    whole = new.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("at", "part", "new", "kind"))).alias("u"))  # a document's own mentions
    joined = hit.join(whole, "_row")
    text = F.concat(F.array_join(F.transform("u", lambda x: F.concat(F.when(x["part"] == 0, F.get("pieces", x["at"])).otherwise(" "), x["new"])), ""), F.element_at("pieces", -1))
    replaced = F.filter("u", lambda x: x["kind"] != "keep")
    n = F.size(F.array_distinct(F.transform(replaced, lambda x: x["at"])))
    kinds = F.array_sort(F.array_distinct(F.transform(replaced, lambda x: F.regexp_replace(x["kind"], "_.*", ""))))
    done = joined.select("doc_id", text.alias("text"), n.alias("n_entities"), kinds.alias("kinds"))
    same = clean.filter("size(found) = 0").select("doc_id", "text", F.lit(0).alias("n_entities"), none.alias("kinds"))
    return same.unionByName(done)
