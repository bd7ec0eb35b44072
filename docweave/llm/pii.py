"""Surrogates for personal data, in DataFrame expressions only.

Entities (e-mail and IP addresses, phone and card numbers, IBANs, national ids, names, street addresses, access keys and
secrets) are found by patterns and brought to a canonical form, so that spellings of one entity share a surrogate everywhere
in the corpus.  A name's given and family names are entities of their own: "Mr Smith", "Mr. John Smith" and a bare "Smith"
later in the same text agree, whatever the title.  Numbers are compared by their digits, phone numbers of the +1 region without
the region.

A surrogate is drawn from a keyed hash (HMAC-SHA512) of type, canonical form and attempt: digits give digits, letters give
letters of the same case and script, punctuation and layout stay, cards keep a valid check digit, given names keep their gender
(by title, or by the name), a name keeps its number of words.  Surrogates that two entities share, of whatever types, or that
are themselves entities of the corpus, are drawn again until all differ; where a type's values run out they become longer.

Names are found after a title or by a common given name; other names are not told from other words.  A bare mention is a word
equal to a name found in the same text, of three letters or more.

Edge cases: null and empty texts come back as they are; entities that overlap are taken from the left, longest pattern first;
identical texts get identical results; ids may repeat or be null; extra columns are kept, whatever their names.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import materialize

# fixed values: titles, given names by gender, words of street names
FEMALE_TITLES = "Mrs Ms Miss Lady Madam Frau Madame Mademoiselle Mme Mlle Señora Señorita Sra Srta Doña Signora".split()
MALE_TITLES = "Mr Sir Lord Herr Herrn Monsieur Señor Sr Don Signor".split()
OTHER_TITLES = "Dr Prof Professor Mx".split()
FEMALE = "Alice Amelia Ana Andrea Anna Anne Barbara Berta Brigitte Camille Carla Carmen Caroline Catherine Charlotte Chloé Christine Clara Diana Elena Elisabeth Elizabeth Emily Emma Eva Florence Frances Grace Greta Hannah Heike Helen Helena Irene Isabel Isabella Jane Jennifer Jessica Joan Julia Karen Katharina Kate Laura Lea Linda Lisa Louise Lucia Lucy Margaret Maria María Marie Marta Mary Monika Nancy Nathalie Nicole Nina Olga Olivia Patricia Paula Petra Rachel Rosa Ruth Sandra Sara Sarah Sofia Sophie Susan Susanne Teresa Ursula Valérie Vera Victoria".split()
MALE = "Adam Albert Alexander Andreas Andrew Anthony Antonio Benjamin Bob Brian Bruno Carlos Charles Christian Christopher Daniel David Diego Edward Emil Eric Felix Fernando François Frank Fritz Georg George Hans Henri Henry Hugo Ivan Jack Jacques Jakob James Javier Jean Jeff Johann John Jorge Joseph José Juan Jürgen Karl Kevin Klaus Lars Leon Louis Luis Lukas Manuel Marco Mark Martin Matthew Michael Miguel Nicolas Oscar Otto Pablo Paul Pedro Peter Philippe Pierre Ralf Richard Robert Simon Stefan Steven Thomas Victor Walter Werner William Wolfgang".split()
NEUTRAL = "Alex Ariel Chris Dana Jamie Jordan Kim Lee Morgan Pat Robin Sam Sasha Terry Toni".split()
STREET_WORDS = "street road avenue lane drive boulevard court square st rd ave ln dr blvd ct sq rue place quai impasse calle avenida plaza paseo".split()
SYLLABLES = ["ba", "del", "fer", "gar", "hol", "kin", "lan", "mar", "nor", "pel", "ros", "san", "tor", "val", "wen", "zel"]
ENDINGS = {"given_f": ["a", "ia", "ina", "ella"], "given_m": ["o", "us", "in", "ert"], "given_n": ["y", "e", "is", "en"]}
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: The letters that write a surrogate in the scripts of names.
CYRILLIC, GREEK = "абкдефгхийклмнопкрстувшхыз", "αβκδεφγχιξκλμνοπκρστυβωχψζ"

_TITLE = "(?:" + "|".join(sorted(FEMALE_TITLES + MALE_TITLES + OTHER_TITLES, key=len, reverse=True)) + r")(?![\p{L}])\.?"
_GIVEN = "(?:" + "|".join(sorted(FEMALE + MALE, key=len, reverse=True)) + r")(?![\p{L}])"
_WORD = r"\p{Lu}\p{L}+(?:['’-]\p{L}+)*+"
_STREET = r"\p{Lu}[\p{L}'’.-]*+"
#: What to look for: (type, pattern), tried in this order at each place.
ENTITIES = [
    ("email", r"[\p{L}0-9][\p{L}0-9._%+-]*+@[\p{L}0-9](?:[\p{L}0-9-]*[\p{L}0-9])?(?:\.[\p{L}0-9](?:[\p{L}0-9-]*[\p{L}0-9])?)*\.[\p{L}]{2,}"),
    ("key", r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b|\bgh[pousr]_[A-Za-z0-9]{30,}|\bsk-[A-Za-z0-9_-]{20,}|\bAIza[A-Za-z0-9_-]{35}"),
    ("secret", r"(?i:\b(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)\b[\"']?\s{0,3}[:=]\s{0,3}[\"']?)(?=[\p{L}+/_.~-]*[0-9])[\p{L}0-9+/_.~-]{8,}"),
    ("iban", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("card", r"(?<![0-9.-])(?:[0-9]{4}[ -]?){3}[0-9]{1,7}(?![0-9-])|(?<![0-9.-])3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}(?![0-9-])"),
    ("ip", r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?!\.?[0-9])"),
    ("ip6", r"(?<![0-9A-Fa-f:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[0-9A-Fa-f:]{6})(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Fa-f:])"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("phone", r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9])"),
    ("address", rf"(?<![0-9.,])[0-9]{{1,5}}[A-Za-z]? (?:{_STREET} ){{1,3}}(?:Street|Road|Avenue|Lane|Drive|Boulevard|Court|Square|St|Rd|Ave|Ln|Dr|Blvd|Ct|Sq)(?![\p{{L}}])"
                rf"|(?<![0-9.,])[0-9]{{1,4}},? (?:rue|avenue|boulevard|place|quai|impasse) (?:(?:de|du|des|la|le|les) |d['’]|l['’]){{0,2}}{_STREET}(?: {_STREET}){{0,2}}"
                rf"|\p{{Lu}}\p{{Ll}}+(?:straße|strasse|weg|platz|allee|gasse) [0-9]{{1,4}}[a-z]?(?![0-9A-Za-z])"
                rf"|(?:Calle|Avenida|Plaza|Paseo) (?:(?:de|del|la|las|los|el) ){{0,2}}{_STREET}(?: {_STREET}){{0,2}},? [0-9]{{1,4}}(?![0-9])"),
    ("name", rf"{_TITLE}(?: +{_TITLE})* +(?:\p{{Lu}}\. *)*{_WORD}(?: +{_WORD})?|{_GIVEN}(?: +\p{{Lu}}\.)* +{_WORD}"),
]
#: No entity begins inside a word, which spares most places of a text all these patterns.
ANY = r"(?<![\p{L}0-9])(?:" + "|".join(f"(?:{p})" for _, p in ENTITIES) + ")"
#: What every entity holds: a digit, an @, a key's first letters, "::", or a title or given name before a capital.  Most texts have none.
HINT = rf"[0-9@]|AKIA|ASIA|gh[pousr]_|sk-|AIza|::|(?<![\p{{L}}0-9])(?=\p{{Lu}})(?:{_TITLE}|{_GIVEN})(?: +\p{{Lu}}\.)* +\p{{Lu}}"
#: Rounds of drawing again.  Each lowers the number of shared surrogates by far more than half.
ROUNDS = 40
#: Attempts after which surrogates begin to grow, one character each.
GROW = 8


def kind_of(raw: Column) -> Column:
    """The first type whose pattern fits all of an entity."""
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(ENTITIES):
        fits = raw.rlike(rf"^(?:{pattern})$")
        if kind == "card":
            digits = F.regexp_replace(raw, "[^0-9]", "")
            fits = F.when(fits, (luhn_sum(F.substr(digits, F.lit(1), F.length(digits) - 1)) + F.right(digits, F.lit(1)).try_cast("int")) % 10 == 0).otherwise(False)
        out = F.when(fits, kind).otherwise(out)
    return out


def secret_prefix(raw: Column) -> Column:
    return F.regexp_extract(raw, r"^(?i:[a-z_-]+[\"']?\s{0,3}[:=]\s{0,3}[\"']?)", 0)


def canonical(raw: Column, kind: Column) -> Column:
    """What spellings of one entity share (names excepted)."""
    digits = F.regexp_replace(raw, "[^0-9]", "")
    return (
        F.when(kind.isin("email", "ip6"), F.lower(raw))
        .when(kind.isin("card", "ssn"), digits)
        .when(kind == "phone", F.when((F.length(digits) == 11) & digits.startswith("1"), F.substr(digits, F.lit(2))).otherwise(digits))
        .when(kind == "iban", F.regexp_replace(raw, " ", ""))
        .when(kind == "secret", F.substr(raw, F.length(secret_prefix(raw)) + 1))
        .when(kind == "address", F.lower(F.regexp_replace(raw, ",", "")))
        .otherwise(raw)
    )


def name_words(raw: Column) -> Column:
    """The names in a titled or full name, without titles and initials."""
    return F.filter(F.split(raw, " +"), lambda w: ~w.rlike(rf"^(?:{_TITLE}|\p{{Lu}}\.)$"))


def components(raw: Column, kind: Column) -> Column:
    """What of an entity gets a surrogate of its own: an array of (kind, value, word), given names before the family name."""
    words = name_words(raw)
    has = lambda titles: raw.rlike(r"(?:^| )(?:" + "|".join(titles) + r")\.? ")
    first = F.element_at(words, 1)
    gender = F.when(has(FEMALE_TITLES), "given_f").when(has(MALE_TITLES), "given_m").when(first.isin(FEMALE), "given_f").when(first.isin(MALE), "given_m").otherwise("given_n")
    named = F.transform(words, lambda w, i: F.struct(F.when(i < F.size(words) - 1, gender).otherwise("family").alias("kind"), F.lower(w).alias("value"), w.alias("word")))
    return F.when(kind == "name", named).otherwise(F.array(F.struct(kind.alias("kind"), canonical(raw, kind).alias("value"), F.lit(None).cast("string").alias("word"))))


def stream(key: str, kind: Column, value: Column, attempt: Column, part: int | Column = 0) -> Column:
    """128 hexadecimal digits: HMAC-SHA512 of the message under the key."""
    block = key.encode() if len(key.encode()) <= 128 else hashlib.sha512(key.encode()).digest()
    inner, outer = (F.lit(bytes(b ^ pad for b in block.ljust(128, b"\0"))) for pad in (0x36, 0x5C))
    message = F.concat_ws("\0", kind, value, attempt.cast("string"), F.lit(part).cast("string") if isinstance(part, int) else part.cast("string"))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 512))), 512)


def drawn(hexes: Column, i: Column, below: int) -> Column:
    """The i-th number (from 0) of a stream, under ``below``: four hexadecimal digits each, 32 to a stream."""
    return (F.conv(F.substr(hexes, (i % 32) * 4 + 1, F.lit(4)), 16, 10).cast("int") % below).cast("int")


def shaped(text: Column, key: str, kind: Column, value: Column, attempt: Column) -> Column:
    """Each letter and digit replaced by one of its own class, case and script, at its own place."""

    def one(c: Column, i: Column) -> Column:
        hexes = stream(key, kind, value, attempt, F.floor(i / 32))
        of = lambda letters: F.substr(F.lit(letters), drawn(hexes, i, len(letters)) + 1, F.lit(1))
        cased = lambda letters: F.when(c.rlike(r"^\p{Lu}$"), F.upper(of(letters))).otherwise(of(letters))
        other = (
            F.when(c.rlike(r"^\p{IsCyrillic}$"), cased(CYRILLIC)).when(c.rlike(r"^\p{IsGreek}$"), cased(GREEK)).when(c.rlike(r"^(?=\p{L})(?:\p{Lu}|\p{Ll})$"), cased(LOWER))
            # of scripts without case: a letter of the common Han block, or of the Arabic or Hebrew alphabet
            .when(c.rlike(r"^\p{IsArabic}$"), of("ابتثجحخدذرزسشصضطظعغفقكلمنهوي")).when(c.rlike(r"^\p{IsHebrew}$"), of("אבגדהוזחטיכלמנסעפצקרשת")).when(c.rlike(r"^\p{L}$"), of("一二三四五六七八九十人口日月山水火木金土"))
            .when(c.rlike(r"^\p{Nd}$"), of(DIGITS)).otherwise(c)
        )
        return F.when((c >= "0") & (c <= "9"), of(DIGITS)).when((c >= "a") & (c <= "z"), of(LOWER)).when((c >= "A") & (c <= "Z"), of(UPPER)).when(c < "\u0080", c).otherwise(other)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def hexed(text: Column, key: str, kind: Column, value: Column, attempt: Column) -> Column:
    """As ``shaped``, for secrets written in hexadecimal digits."""
    return F.array_join(F.transform(F.split(text, ""), lambda c, i: F.substr(stream(key, kind, value, attempt, F.floor(i / 32)), (i % 32) * 4 + 1, F.lit(1))), "")


def luhn_sum(digits: Column) -> Column:
    """Of digits that stand before a check digit."""
    n, d = F.length(digits), lambda c: c.try_cast("int")
    doubled = lambda c: F.when(d(c) > 4, d(c) * 2 - 9).otherwise(d(c) * 2)
    step = lambda a, c: F.struct((a["s"] + F.when((n - a["i"]) % 2 == 1, doubled(c)).otherwise(d(c))).alias("s"), (a["i"] + 1).alias("i"))
    return F.aggregate(F.split(digits, ""), F.struct(F.lit(0).alias("s"), F.lit(0).alias("i")), step, lambda a: a["s"])


def syllables(hexes: Column, n: Column, at: int = 1) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(at), F.lit(at - 1) + n), lambda i: F.element_at(F.array(*map(F.lit, SYLLABLES)), drawn(hexes, i, len(SYLLABLES)) + 1)), "")


def in_script(latin: Column, like: Column) -> Column:
    return F.when(like.rlike(r"^\p{IsCyrillic}"), F.translate(latin, LOWER, CYRILLIC)).when(like.rlike(r"^\p{IsGreek}"), F.translate(latin, LOWER, GREEK)).otherwise(latin)


def surrogate(key: str, kind: Column, value: Column, attempt: Column) -> Column:
    """The canonical surrogate of a canonical entity."""
    hexes, longer = stream(key, kind, value, attempt), F.greatest(attempt - GROW, F.lit(0))
    more = lambda pattern: shaped(F.repeat(F.lit(pattern), longer), key, F.lit("more"), value, attempt)
    like = shaped(value, key, kind, value, attempt)
    domain = F.substring_index(value, "@", -1)
    host, tld = F.regexp_replace(domain, r"\.[^.]*$", ""), F.substring_index(domain, ".", -1)
    # a domain's surrogate depends on the domain alone: addresses of one domain still share one
    email = F.concat(shaped(F.substring_index(value, "@", 1), key, kind, value, attempt), more("a"), F.lit("@"), shaped(host, key, F.lit("domain"), domain, F.lit(0)), F.lit("."), tld)
    head = F.concat(F.substr(value, F.lit(1), F.lit(1)), F.substr(like, F.lit(2), F.length(value) - 2))
    card = F.concat(head, ((10 - luhn_sum(head) % 10) % 10).cast("int").cast("string"))
    ip = F.array_join(F.transform(F.array(*(F.lit(i) for i in range(4))), lambda i: (drawn(hexes, i, 254) + 1).cast("string")), ".")
    ip6 = hexed_fields(value, key, kind, attempt)
    given = F.lit(None).cast("string")
    for of, names in (("given_f", FEMALE), ("given_m", MALE), ("given_n", NEUTRAL)):
        known = F.element_at(F.array(*(F.lit(x.lower()) for x in names)), drawn(hexes, F.lit(0), len(names)) + 1)
        made = F.concat(syllables(hexes, 2 + F.floor(attempt / 4).cast("int")), F.element_at(F.array(*map(F.lit, ENDINGS[of])), drawn(hexes, F.lit(0), 4) + 1))
        given = F.when(kind == of, F.when(attempt == 0, F.translate(known, "áéíóúñçüöä", "aeiouncuoa")).otherwise(made)).otherwise(given)
    family = syllables(hexes, 3 + F.floor(attempt / 4).cast("int"))
    digits = lambda w, i: shaped(w, key, kind, value, attempt * 8 + i)
    suffix = lambda w: F.regexp_extract(w, "(straße|strasse|weg|platz|allee|gasse)$", 1)
    small = lambda w: w.isin(STREET_WORDS) | w.rlike(r"^(?:de|del|du|des|la|le|les|las|los|el)$")
    street = F.array_join(F.transform(F.split(value, " "), lambda w, i: F.when(w.rlike("^[0-9]"), digits(w, i)).when(small(w), w).otherwise(F.concat(F.regexp_extract(w, "^[dl]['’]", 0), syllables(stream(key, kind, value, attempt * 8 + i), 2 + F.floor(attempt / GROW).cast("int")), suffix(w)))), " ")
    fixed = F.when(kind == "phone", F.when(F.length(value) > 10, F.length(value) - 10).otherwise(0)).when(kind == "iban", 2).when(value.rlike("^(gh._|sk-)"), F.length(F.regexp_extract(value, "^(gh._|sk-)", 0))).otherwise(4)
    kept = F.concat(F.substr(value, F.lit(1), fixed), F.substr(like, fixed + 1))
    return (
        F.when(kind == "email", email)
        .when(kind == "card", card)
        .when(kind == "ip", ip)
        .when(kind == "ip6", ip6)
        .when(kind.isin(*ENDINGS), in_script(given, value))
        .when(kind == "family", in_script(family, value))
        .when(kind == "address", street)
        .when(kind == "secret", F.concat(F.when(value.rlike("^[0-9a-f]+$"), hexed(value, key, kind, value, attempt)).otherwise(like), more("0")))
        .when(kind.isin("phone", "key", "iban"), F.concat(kept, more("0")))
        .otherwise(F.concat(like, more("0")))
    )


def hexed_fields(value: Column, key: str, kind: Column, attempt: Column) -> Column:
    """Hexadecimal digits anew, colons where they are."""
    return F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when(c == ":", c).otherwise(F.substr(stream(key, kind, value, attempt, F.floor(i / 32)), (i % 32) * 4 + 1, F.lit(1)))), "")


def cased(new: Column, word: Column) -> Column:
    """A lower-case surrogate as the word it stands for is written."""
    return F.when((F.length(word) > 1) & (word == F.upper(word)), F.upper(new)).otherwise(F.initcap(new))


def written(raw: Column, kind: Column, news: Column) -> Column:
    """Canonical surrogates, one for each component, in the layout of one spelling."""
    new = F.element_at(news, 1)
    digits = F.length(F.regexp_replace(raw, "[^0-9]", ""))
    # leading digits that the canonical form leaves out stay; the others are replaced in turn, and what is left is appended
    skip = F.when(kind == "phone", F.greatest(digits - F.length(new), F.lit(0))).otherwise(0)
    start = F.struct(F.lit("").alias("out"), (F.lit(1) - skip).alias("i"))

    def fill(a: Column, c: Column) -> Column:
        takes = c.rlike("[A-Z0-9]") & ((kind == "iban") | c.rlike("[0-9]"))
        put = F.when(a["i"] > 0, F.substr(new, a["i"], F.lit(1))).otherwise(c)
        return F.when(takes, F.struct(F.concat(a["out"], put).alias("out"), (a["i"] + 1).alias("i"))).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["i"].alias("i")))

    filled = F.aggregate(F.split(raw, ""), start, fill, lambda a: F.concat(a["out"], F.substr(new, a["i"])))
    upper = F.when(raw == F.upper(raw), F.upper(new)).otherwise(new)
    # words of a name are replaced in turn; titles, initials and spaces stay
    pieces = F.split(raw, r"(?<= )(?=[^ ])|(?<=[^ ])(?= )")
    is_name = lambda w: ~w.rlike(rf"^(?: +|{_TITLE}|\p{{Lu}}\.)$")
    step = lambda a, w: F.when(is_name(w), F.struct(F.concat(a["out"], cased(F.element_at(news, a["i"]), w)).alias("out"), (a["i"] + 1).alias("i"))).otherwise(F.struct(F.concat(a["out"], w).alias("out"), a["i"].alias("i")))
    name = F.aggregate(pieces, F.struct(F.lit("").alias("out"), F.lit(1).alias("i")), step, lambda a: a["out"])
    words = F.split(new, " ")
    spelled = F.array_join(F.transform(F.split(raw, " "), lambda w, i: F.concat(F.when(w.rlike(r"^\p{Lu}"), F.initcap(F.get(words, i))).otherwise(F.get(words, i)), F.when(w.endswith(","), ",").otherwise(""))), " ")
    return (
        F.when(kind == "name", name).when(kind == "address", spelled).when(kind.isin("card", "phone", "ssn", "iban"), filled).when(kind.isin("email", "ip6"), upper)
        .when(kind == "secret", F.concat(secret_prefix(raw), new)).otherwise(new)
    )


def with_surrogates(found: DataFrame, key: str) -> DataFrame:
    """(kind, value, surrogate) of distinct entities (kind, value): no two alike, and none an entity itself, whatever the types."""
    now = materialize(found.select("kind", "value", F.lit(0).alias("attempt")), "entities")
    settled: list[DataFrame] = []
    taken = now.select(F.col("value").alias("new"))
    for _ in range(ROUNDS):
        tried = materialize(now.withColumn("new", surrogate(key, F.col("kind"), F.col("value"), F.col("attempt"))), "surrogates")
        # the smallest entity that draws a surrogate keeps it, unless it is taken
        first = tried.groupBy("new").agg(F.min(F.struct("kind", "value")).alias("of")).join(taken, "new", "left_anti").select("new", "of.kind", "of.value")
        kept = materialize(tried.join(first, ["kind", "new", "value"], "left_semi"), "settled")
        settled.append(kept.select("kind", "value", F.col("new").alias("surrogate")))
        again = tried.join(kept.select("kind", "value"), ["kind", "value"], "left_anti")
        if again.isEmpty():
            return reduce(DataFrame.unionByName, settled)
        taken = taken.unionByName(kept.select("new"))
        now = materialize(again.select("kind", "value", (F.col("attempt") + 1).alias("attempt")), "entities")
    # only IP and card numbers do not grow, and no corpus has half of those that there are
    raise ValueError("a type's surrogates are exhausted")


def replace_private(docs: DataFrame, key: str, text_column: str = "text") -> DataFrame:
    """All columns, the text with surrogates, and n_entities (which takes the place of a column of that name)."""
    text, raw, kind = F.col("_text"), F.col("raw"), F.col("kind")
    # a row travels as one column, so that its names meet none of those used here
    source = docs.select(F.struct("*").alias("_row"), F.col(text_column).alias("_text"))
    empty = F.array().cast("array<string>")
    found = F.coalesce(F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(f"({ANY})"), F.lit(1))), empty)
    # texts are searched once: what is found is written with them
    source = materialize(source.withColumn("_found", found), "searched")
    some, none = source.where("size(_found) > 0").withColumn("_text_key", F.xxhash64(text)), source.where("size(_found) = 0")
    # identical texts count once; then identical spellings
    spelled = materialize(some.select("_text_key", F.explode(F.array_distinct("_found")).alias("raw")).distinct(), "spellings")
    raws = spelled.select("raw").distinct().withColumn("kind", kind_of(raw)).where("kind IS NOT NULL")
    parts = materialize(raws.select("raw", "kind", F.posexplode(components(raw, kind)).alias("at", "part")).select("raw", "kind", "at", F.col("part.kind").alias("part_kind"), "part.value", "part.word"), "parts")
    drawn_for = with_surrogates(parts.select(F.col("part_kind").alias("kind"), "value").distinct(), key)
    news = parts.join(drawn_for.withColumnRenamed("kind", "part_kind"), ["part_kind", "value"])
    news = news.groupBy("raw", "kind").agg(F.array_sort(F.collect_list(F.struct("at", "surrogate", "word"))).alias("parts"))
    words = F.transform(F.filter("parts", lambda p: F.length(p["word"]) > 2), lambda p: F.struct(p["word"].alias("word"), p["surrogate"].alias("new")))
    news = news.select("raw", written(raw, kind, F.transform("parts", lambda p: p["surrogate"])).alias("new"), words.alias("words"))
    mapped = spelled.join(news, "raw")
    of_text = mapped.groupBy("_text_key").agg(F.map_from_entries(F.collect_list(F.struct("raw", "new"))).alias("_map"), F.array_distinct(F.flatten(F.collect_list("words"))).alias("_words"))
    changed = some.join(of_text, "_text_key", "left")
    # entities as they follow one another, and the text between them, where names stand alone
    between = F.transform(F.split(text, ANY, -1), lambda s: F.when(F.size("_words") > 0, bare_names(s)).otherwise(s))
    news = F.transform("_found", lambda x: F.coalesce(F.element_at("_map", x), x))
    woven = F.array_join(F.flatten(F.zip_with(between, F.concat(news, F.array(F.lit(""))), lambda a, b: F.array(a, b))), "")
    n = F.size(F.filter("_found", lambda x: F.element_at("_map", x).isNotNull()))
    done = changed.select("_row", F.when(F.col("_map").isNull(), text).otherwise(woven).alias("_text"), F.when(F.col("_map").isNull(), 0).otherwise(n).alias("_n"))
    every = done.unionByName(none.select("_row", "_text", F.lit(0).alias("_n")))
    kept = [F.col("_text").alias(c) if c == text_column else F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c.lower() != "n_entities"]
    return every.select(*kept, F.col("_n").alias("n_entities"))


def bare_names(segment: Column) -> Column:
    """A piece of text with the words replaced that are names found in its text, as they are or in upper case, with or without
    a genitive s."""
    words = F.split(segment, r"(?<=[\p{L}'’-])(?![\p{L}'’-])|(?<![\p{L}'’-])(?=[\p{L}'’-])|(?<=\p{L})(?=['’]s(?!\p{L}))")
    hit = lambda w: F.get(F.filter("_words", lambda p: (p["word"] == w) | (F.upper(p["word"]) == w)), F.lit(0))["new"]
    return F.array_join(F.transform(words, lambda w: F.when(w.rlike(r"^\p{Lu}"), F.coalesce(cased(hit(w), w), w)).otherwise(w)), "")
