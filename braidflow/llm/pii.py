"""Personal data replaced by keyed surrogates, with SQL functions only.

Entities are found by one pattern in one pass, which parts a text into entities and what lies between; it is put together
again from that and the surrogates, so that no replacement meets another. A surrogate depends on the key, the entity's kind
and its canonical form, and, where surrogates met in a corpus, on the attempt that told them apart: the same address or
number gets the same one in every document, in whatever case or grouping it is written. A person's given name and surname
are entities of their own: a surname has one surrogate throughout, and where it stands alone in a document that names its
bearer, it is replaced too. Characters are replaced within their class (digits, hexadecimal digits, upper and lower case of
Latin, Greek and Cyrillic, in surnames vowels and consonants apart; letters and digits of other scripts become Latin and
ASCII ones), all others stay; card numbers, which only a right check digit makes, keep their first digit and a right check
digit, IBANs their country and right check digits, telephone numbers their country code, access keys their prefix,
addresses form valid quads, mail addresses keep their last label. A given name becomes another one of the same gender and
script, a form of address stays.

Surrogates must neither meet each other nor a real entity. The distinct entities are checked for that in rounds: of those
that meet all but the smallest go on to their next attempt. Later attempts compose a given name of several and make short
forms longer, so that there are always more surrogates than real entities. Attempts other than the first are rare; they are a small map
in the plan while they are few, and joined to the documents' entities beyond that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import discard, materialise, own, prepare

KEY = "surrogate-key-1"
#: Entities with a later attempt up to which the plan holds them as a map.
MAP_ENTITIES = 2000
#: Rounds after which the search for distinct surrogates fails; each makes the space of short forms larger.
ROUNDS = 64

# Forms of address by gender, and common given names by gender and script.
TITLES = {"f": "Mrs Ms Miss Frau Señora Madame Mme госпожа".split(), "m": "Mr Herr Señor Monsieur господин".split()}
GIVEN = {
    ("f", "Latn"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Anna Julia Laura Sophie Marie Claire Camille Carmen Lucía Elena Ursula Greta".split(),
    ("m", "Latn"): "James Robert John Michael David William Richard Joseph Thomas Charles Hans Peter Stefan Jürgen Pierre Jean Louis François Carlos Miguel Javier Antonio".split(),
    ("f", "Cyrl"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Екатерина Светлана Юлия".split(),
    ("m", "Cyrl"): "Иван Александр Сергей Дмитрий Андрей Алексей Михаил Николай Владимир Павел".split(),
}

_UPPER = r"\p{Lu}\p{Ll}+"


def _any_of(words: list[str]) -> str:
    """A pattern of the words, the longest of those that start alike first, that reads each character once."""
    heads: dict[str, list[str]] = {}
    for w in words:
        heads.setdefault(w[:1], []).append(w[1:])
    tails = [f"{c}{_any_of(rest)}" for c, rest in heads.items() if c]
    return (f"(?:{'|'.join(tails)})" if len(tails) > 1 or "" in heads and tails else "".join(tails)) + ("?" if "" in heads and tails else "")


_TITLES = _any_of([t for v in TITLES.values() for t in v])
_NAMES = _any_of([n for v in GIVEN.values() for n in v])
_FIRST = "".join(sorted({n[0] for v in (*TITLES.values(), *GIVEN.values()) for n in v}))
_WORDS_OF_SECRETS = "password|passwd|pwd|token|secret|api_?key"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Kinds and their patterns; those of one first character are tried in this order.
KINDS = {
    # No longer than the standards allow: 64 characters before the sign, 63 in a label.
    "mail": r"[\p{L}\p{N}][\p{L}\p{N}._%+-]{0,63}+@[\p{L}\p{N}-]{1,63}+(?:\.[\p{L}\p{N}-]{1,63}+){0,30}\.\p{L}{2,63}",
    "key": r"AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "hex": r"(?=[a-fA-F]*+[0-9])(?=[0-9]*+[a-fA-F])(?:[0-9a-f]{16,}|[0-9A-F]{16,})(?![A-Za-z0-9])",
    "secret": rf"(?:{_WORDS_OF_SECRETS})[\x20]?[=:][\x20]?[\"']?(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{{8,}}",
    "iban": r"[A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]{4}){3,7}(?:[\x20]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<!\.)[3-6][0-9]{3}(?:[\x20-]?[0-9]{4}){2}[\x20-]?[0-9]{1,4}(?![\p{L}0-9])",
    "ip": rf"(?<!\.)(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?[0-9])",
    "ssn": r"(?<!-)[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<!\+)(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,4}\)[\x20.-]?|[0-9]{3}[.-])[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9])|(?<!\+)\+[0-9]{1,3}(?:[\x20.-]?[0-9]{2,4}){2,4}(?![0-9])",
    "person": rf"(?=[{_FIRST}])(?:{_TITLES}\.?[\x20]{_UPPER}(?:[\x20]{_UPPER})?|{_NAMES}(?!\p{{L}})(?:[\x20]{_UPPER})?)(?!\p{{L}})",
}


def _any(*kinds: str) -> str:
    return "|".join(f"(?:{KINDS[k]})" for k in kinds)


#: An entity starts a word. What it can be is told by its first character, so that most places cost one comparison.
_STARTS = rf"(?<![\p{{L}}\p{{N}}_])(?:(?=[0-9+(])(?:{_any('ip', 'card', 'ssn', 'phone', 'mail', 'hex')})|(?=\p{{Lu}})(?:{_any('key', 'iban', 'person', 'mail', 'hex')})|(?=\p{{Ll}})(?:{_any('secret', 'mail', 'hex')})|(?=\p{{L}})(?:{_any('mail', 'person')}))"
#: In a word: a secret's word ends longer ones (access_token); keys, IBANs and hexadecimal digits only mind ASCII letters and
#: digits before them, numbers also other letters, names letters alone.
_INSIDE = rf"(?=[apst])(?:{_any('secret')})|(?<=[\p{{L}}\p{{N}}_&&[^A-Za-z0-9]])(?:(?=[0-9+(])(?:(?<!\p{{L}})(?:{_any('ip', 'card', 'ssn', 'phone')})|{_any('hex')})|(?=[A-Z])(?:{_any('key', 'iban')})|(?=\p{{Lu}})(?<!\p{{L}})(?:{_any('person')})|(?=[A-Fa-f])(?:{_any('hex')})|(?=\p{{Ll}})(?<!\p{{L}})(?:{_any('person')}))|(?<=[0-9])(?=\p{{L}})(?:{_any('person')})"
PATTERN = rf"(?:{_STARTS}|{_INSIDE})"
#: All that can be found where no digit and no sign of mail stands.
PERSONS = rf"(?=[{_FIRST}])(?<!\p{{L}})(?:{KINDS['person']})"
#: Marks both ends of an entity while a text is parted; a text that holds it itself is parted by two passes.
MARK = "\ue000"


def characters(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def kind_of(e: Column) -> Column:
    """An entity's kind, by its form; `none` for a number like a card's whose check digit is wrong: it stays as it is."""
    out = F.when(F.contains(e, F.lit("@")), "mail").when(e.rlike(r"^[+(]"), "phone")
    out = out.when(e.rlike(rf"^(?:{_WORDS_OF_SECRETS})[\x20]?[=:]"), "secret")
    for k in ("key", "ip", "ssn", "hex"):
        out = out.when(e.rlike(rf"^(?:{KINDS[k]})$"), k)
    number = e.rlike(rf"^(?:{KINDS['card']})$")
    out = out.when(number & (luhn(F.regexp_replace(e, r"[^0-9]", "")) == 0), "card").when(number, "none").when(e.rlike(rf"^(?:{KINDS['iban']})$"), "iban")
    return out.when(e.rlike(r"^[0-9]"), "phone").otherwise("person")


def canonical(e: Column, kind: Column) -> Column:
    """The form that writings of one entity share: numbers without their grouping, mail addresses in lower case."""
    bare = F.regexp_replace(e, r"[^\p{L}\p{N}]", "")
    return F.when(kind.isin("phone", "card", "ssn", "iban"), bare).when(kind.isin("mail", "hex"), F.lower(e)).otherwise(e)


def keyed(key: str, *parts: Column) -> Column:
    """64 hexadecimal digits."""
    return F.sha2(F.concat_ws("\x1f", F.lit(key), *parts).cast("binary"), 256)


def byte(h: Column, i: Column) -> Column:
    """The i-th of the digest's 32 bytes, around its end; later rounds of it differ by a shift."""
    at = F.pmod(i, F.lit(32))
    return (F.conv(F.substr(h, at * 2 + 1, F.lit(2)), 16, 10).cast("int") + F.floor(i / 32).cast("int") * 7) % 256


def one_of(letters: str, n: Column) -> Column:
    return F.substr(F.lit(letters), (n % len(letters)) + 1, F.lit(1))


def replaced(c: Column, n: Column, hexadecimal: Column) -> Column:
    """Another character of c's class, by the number n from 0 to 255."""
    latin, cyrillic, greek = "abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуфхцчшэюя", "αβγδεζηθικλμνξοπρστυφχψω"
    digit = (c >= "0") & (c <= "9")
    out = F.when(hexadecimal & (digit | (c >= "a") & (c <= "f")), one_of("0123456789abcdef", n)).when(hexadecimal & (c >= "A") & (c <= "F"), one_of("0123456789ABCDEF", n))
    out = out.when(digit, one_of("0123456789", n))
    for letters, low, high in ((cyrillic, "Ѐ", "ӿ"), (greek, "Ͱ", "Ͽ"), (latin, "A", "ɏ")):
        here = (c >= low) & (c <= high) & c.rlike(r"^\p{L}$")
        out = out.when(here & (F.lower(c) == c), one_of(letters, n)).when(here, one_of(letters.upper(), n))
    # Of other scripts: no entity may be left as it is.
    out = out.when(c.rlike(r"^\p{N}$"), one_of("0123456789", n)).when(c.rlike(r"^\p{Lu}$"), one_of(latin.upper(), n))
    return out.when(c.rlike(r"^\p{L}$"), one_of(latin, n)).otherwise(c)


def substituted(e: Column, h: Column, kept: Column, hexadecimal: Column) -> Column:
    """e with its letters and digits replaced, but for those of which kept(ordinal) is true; others stay."""
    start = F.struct(F.lit(0).alias("i"), F.lit("").alias("s"))

    def step(acc: Column, c: Column) -> Column:
        counts = c.rlike(r"^[\p{L}\p{N}]$")
        new = F.when(counts & ~(acc["i"] < kept), replaced(c, byte(h, acc["i"]), hexadecimal)).otherwise(c)
        return F.struct((acc["i"] + counts.cast("int")).alias("i"), F.concat(acc["s"], new).alias("s"))

    return F.aggregate(characters(e), start, step, lambda acc: acc["s"])


def luhn(digits: Column) -> Column:
    """The check sum of a number, modulo 10."""
    size = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substr(digits, size - i, F.lit(1)).cast("int")
        twice = d * (1 + i % 2)
        return twice - F.when(twice > 9, 9).otherwise(0)

    return F.aggregate(F.transform(F.sequence(F.lit(0), size - 1), value), F.lit(0), lambda a, b: a + b) % 10


def last_digit(card: Column, digit: Column) -> Column:
    return F.concat(F.substr(card, F.lit(1), F.length(card) - 1), digit.cast("string"))


def iban_checked(iban: Column) -> Column:
    """An IBAN with the check digits that its other characters need."""
    bare = F.regexp_replace(iban, " ", "")
    moved = F.concat(F.substr(bare, F.lit(5), F.length(bare)), F.substr(bare, F.lit(1), F.lit(2)), F.lit("00"))
    value = lambda c: F.when(c <= "9", c.cast("int")).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(characters(moved), F.lit(0), lambda acc, c: (acc * F.when(c <= "9", 10).otherwise(100) + value(c)) % 97)
    return F.concat(F.substr(iban, F.lit(1), F.lit(2)), F.lpad((98 - rest).cast("string"), 2, "0"), F.substr(iban, F.lit(5), F.length(iban)))


def longer(attempt: Column) -> Column:
    """By how many characters or names a surrogate is longer than its entity: forms of few characters have few surrogates."""
    return F.floor(attempt / 4).cast("int")


def units(e: Column, kind: Column) -> Column:
    """An entity's (kind, canon, e): itself, or, of a person, each word as a title, a given name or a surname."""

    def unit(kind: Column, canon: Column, e: Column) -> Column:
        return F.struct(kind.alias("kind"), canon.alias("canon"), e.alias("e"))

    def word(w: Column, i: Column) -> Column:
        title = (i == 0) & F.regexp_replace(w, r"\.$", "").isin(*[t for v in TITLES.values() for t in v])
        return unit(F.when(title, "title").when(w.isin(*[n for v in GIVEN.values() for n in v]), "given").otherwise("surname"), w, w)

    return F.when(kind == "person", F.transform(F.split(e, " "), word)).otherwise(F.array(unit(kind, canonical(e, kind), e)))


def given(w: Column, h: Column, attempt: Column) -> Column:
    """Another name of the same gender and script; as all of a list may be real, later attempts compose it of several."""
    more = F.when(attempt > 0, longer(attempt) + 1).otherwise(0)
    out = F.lit(None).cast("string")
    for names in GIVEN.values():
        listed, n = F.array(*map(F.lit, names)), len(names)
        other = (F.array_position(listed, w) + byte(h, F.lit(0)) % (n - 1)) % n + 1
        rest = F.transform(F.sequence(F.lit(1), more), lambda i: F.element_at(listed, (byte(h, i) % n) + 1))  # noqa: B023
        rest = F.when(more > 0, rest).otherwise(F.array().cast("array<string>"))
        pick = F.initcap(F.concat(F.element_at(listed, other.cast("int")), F.array_join(rest, "")))
        out = F.when(w.isin(*names), pick).otherwise(out)
    return out


def surname(w: Column, h: Column, attempt: Column) -> Column:
    """Vowels for vowels and consonants for consonants of its script, in their case."""
    vowels, consonants = {"Latn": "aeiou", "Cyrl": "аеиоу", "Grek": "αεηιου"}, {"Latn": "bcdfghklmnprstvwz", "Cyrl": "бвгдзклмнпрстх", "Grek": "βγδζθκλμνπρστφχ"}
    ranges = {"Latn": ("A", "ɏ"), "Cyrl": ("Ѐ", "ӿ"), "Grek": ("Ͱ", "Ͽ")}
    long = F.concat(w, F.repeat(F.right(w, F.lit(1)), longer(attempt)))

    def letter(c: Column, i: Column) -> Column:
        n = byte(h, i)
        out = replaced(c, n, F.lit(False))
        for script, (low, high) in ranges.items():
            sound = F.lower(c).rlike("[aeiouyà-æè-ïò-öø-ýœаеёиоуыэюяіїєαεηιουωάέήίόύώ]")
            new = F.when(sound, one_of(vowels[script], n)).otherwise(one_of(consonants[script], n))
            out = F.when((c >= low) & (c <= high), F.when(F.lower(c) == c, new).otherwise(F.upper(new))).otherwise(out)
        return out

    return F.array_join(F.transform(characters(long), letter), "")


def surrogates_of(entities: Column, attempt, key: str = KEY) -> Column:
    """Of each entity of an array (made, kind, units): what stands in for it, written as it is, and the same of its units.
    attempt(kind, canonical form) gives a number.

    Each step adds a field, so that none is computed again for every character."""
    x = F.transform(entities, lambda e: F.struct(e.alias("e"), kind_of(e).alias("kind")))
    x = F.transform(x, lambda r: F.struct(r["kind"].alias("kind"), units(r["e"], r["kind"]).alias("units")))

    def step(x: Column, name: str, value) -> Column:
        fields = ["kind", "canon", "e", "attempt", "h"]
        held = fields[: fields.index(name)] if name in fields else fields
        return F.transform(x, lambda r: F.struct(r["kind"].alias("kind"), F.transform(r["units"], lambda u: F.struct(*[u[f].alias(f) for f in held], value(u).alias(name))).alias("units")))

    x = step(x, "attempt", lambda u: attempt(u["kind"], u["canon"]))
    x = step(x, "h", lambda u: keyed(key, u["kind"], u["canon"], u["attempt"].cast("string")))
    x = step(x, "made", lambda u: _made(u["e"], u["kind"], u["h"], u["attempt"]))
    return F.transform(x, lambda r: F.struct(F.array_join(F.transform(r["units"], lambda u: u["made"]), " ").alias("made"), r["kind"].alias("kind"), F.transform(r["units"], lambda u: F.struct(u["kind"].alias("kind"), u["e"].alias("e"), u["made"].alias("made"))).alias("units")))


def _made(e: Column, kind: Column, h: Column, attempt: Column) -> Column:
    more = F.repeat(F.lit("0"), longer(attempt))
    octets = [byte(h, F.lit(i)) for i in range(4)]
    ip = F.concat_ws(".", (octets[0] % 223 + 1).cast("string"), *[o.cast("string") for o in octets[1:3]], (octets[3] % 254 + 1).cast("string"))
    code = F.length(F.regexp_replace(F.regexp_extract(e, r"^\+[0-9]{1,3}(?=[^0-9])", 0), r"\+", ""))
    label = F.regexp_extract(e, r"\.\p{L}+$", 0)
    no = F.lit(False)
    mail = F.concat(substituted(F.concat(more, F.substr(e, F.lit(1), F.length(e) - F.length(label))), h, F.lit(0), no), label)
    word = F.regexp_extract(e, rf"^(?:{_WORDS_OF_SECRETS})[\x20]?[=:][\x20]?[\"']?", 0)
    value = F.concat(F.substr(e, F.length(word) + 1, F.length(e)), more)
    secret = F.concat(word, F.when(value.rlike("^[0-9a-f]+$"), substituted(value, h, F.lit(0), F.lit(True))).otherwise(substituted(value, h, F.lit(0), no)))
    plain = substituted(e, h, F.lit(1), no)
    new = F.regexp_replace(plain, r"[^0-9]", "")
    fixed = last_digit(plain, F.pmod(10 - luhn(last_digit(new, F.lit(0))), F.lit(10)))
    out = F.when(kind.isin("none", "title"), e).when(kind == "mail", mail).when(kind == "ip", ip).when(kind == "card", fixed).when(kind == "secret", secret)
    out = out.when(kind == "given", given(e, h, attempt)).when(kind == "surname", surname(e, h, attempt))
    out = out.when(kind == "phone", substituted(F.concat(e, more), h, code, no)).when(kind == "hex", substituted(e, h, F.lit(0), F.lit(True)))
    return out.when(kind == "key", substituted(e, h, F.lit(4), no)).when(kind == "iban", iban_checked(substituted(e, h, F.lit(2), no))).otherwise(substituted(e, h, F.lit(0), no))


def parted(text: Column) -> Column:
    """What lies between a text's entities at even places and these at odd ones; null for a null text."""
    with_marks = lambda pattern: F.regexp_replace(text, f"({pattern})", f"{MARK}$1{MARK}")
    parts = F.split(F.when(text.rlike("[0-9@]"), with_marks(PATTERN)).otherwise(with_marks(PERSONS)), MARK, -1)
    two = F.zip_with(F.split(text, PATTERN, -1), F.regexp_extract_all(text, F.lit(f"({PATTERN})"), F.lit(0)), lambda a, b: F.array(a, b))
    return F.when(F.contains(text, F.lit(MARK)), F.filter(F.flatten(two), lambda x: x.isNotNull())).otherwise(parts)


def entities_in(parts: Column) -> Column:
    return F.coalesce(F.filter(parts, lambda x, i: i % 2 == 1), F.array().cast("array<string>"))


def attempts(entities: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, canon, attempt) of the distinct units of a column `entity` whose first surrogate isn't theirs to keep."""
    parts = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = entities.select(F.explode(units(F.col("entity"), kind_of(F.col("entity")))).alias("u")).select("u.*").filter("kind NOT IN ('none', 'title')")
    # Two writings of one entity share their surrogate's canonical form; one of them stands for both.
    table = each.groupBy("kind", "canon").agg(F.min("e").alias("e")).withColumn("attempt", F.lit(0))
    table = real_units = materialise(table, "pii-entities")
    real = real_units.select(F.col("canon").alias("real"), F.col("kind").alias("real_kind"))
    for _ in range(ROUNDS):
        made = _made(F.col("e"), F.col("kind"), F.col("h"), F.col("attempt"))
        # Dealt out evenly: a surrogate takes longer than its row is large.
        rows = table.repartition(parts, "canon").withColumn("h", keyed(key, F.col("kind"), F.col("canon"), F.col("attempt").cast("string"))).withColumn("new", made)
        rows = materialise(rows.withColumn("made", canonical(F.col("new"), F.col("kind"))).drop("new", "h"), "pii-surrogates")
        if table is not real_units:
            discard(table)
        first = rows.groupBy(F.col("kind").alias("k"), F.col("made").alias("m")).agg(F.min("canon").alias("first"), F.count("*").alias("n")).filter("n > 1")
        met = rows.join(first, (F.col("kind") == F.col("k")) & (F.col("made") == F.col("m"))).filter("canon <> first").select("kind", "canon")
        taken = rows.join(real, (F.col("kind") == F.col("real_kind")) & (F.col("made") == F.col("real")), "left_semi").select("kind", "canon")
        again = materialise(met.union(taken).distinct().select(F.col("kind").alias("k"), F.col("canon").alias("c")), "pii-again")
        if not again.limit(1).count():
            discard(again)
            return rows.filter("attempt > 0").select("kind", "canon", "attempt")
        step = F.when(F.col("c").isNotNull(), 1).otherwise(0)
        table = materialise(rows.join(again, (F.col("kind") == F.col("k")) & (F.col("canon") == F.col("c")), "left").select("kind", "canon", "e", (F.col("attempt") + step).alias("attempt")), "pii-entities")
        discard(rows, again)
    raise RuntimeError(f"surrogates still meet after {ROUNDS} rounds")


#: Where a text can be parted so that every capitalised word is a part.
_AROUND = r"(?<![\p{L}\p{N}_])(?=\p{Lu}\p{Ll})|(?<=\p{Ll})(?![\p{L}\p{N}_])"


def surnames(made: Column) -> Column:
    """What stands in for each surname of a text's persons."""
    each = F.flatten(F.transform(made, lambda r: F.filter(r["units"], lambda u: u["kind"] == "surname")))
    return F.map_from_entries(F.array_distinct(F.transform(each, lambda u: F.struct(u["e"], u["made"]))))


def rebuilt(parts: Column, made: Column, names: Column) -> Column:
    """A text of its parts, with the entities replaced, and with them the surnames that also stand alone between them.

    made and names have to be columns of their own, or they would be made again for every part."""
    alone = lambda t: F.array_join(F.transform(F.split(t, _AROUND, -1), lambda w: F.coalesce(F.try_element_at(names, w), w)), "")
    return F.array_join(F.transform(parts, lambda t, i: F.when(i % 2 == 1, F.get(made, F.floor(i / 2).cast("int"))["made"]).when(F.size(names) > 0, alone(t)).otherwise(t)), "")


def replace(docs: DataFrame, text: str = "text", key: str = KEY) -> DataFrame:
    """docs with their texts' entities replaced, and __n_entities; a null text stays null and has none.

    Rows, repeated ones too, and all other columns stay; an empty table gives an empty one. Texts are parted once and
    written so; what is made of them reads that.
    """
    prepare(docs.sparkSession)
    parts, made, names, row, maps = own("parts"), own("made"), own("names"), own("row"), own("map")
    docs = docs.drop(parts, made, names, row, maps, own("n_entities"))
    rows = materialise(docs.withColumn(parts, parted(F.col(text))).withColumn(row, F.monotonically_increasing_id()).drop(text), "pii-parts")
    entities = entities_in(F.col(parts))
    later = attempts(rows.filter(F.size(parts) > 1).select(F.explode(entities).alias("entity")).distinct(), key)
    few = later.limit(MAP_ENTITIES + 1).collect()
    if len(few) <= MAP_ENTITIES:

        def attempt(kind: Column, canon: Column) -> Column:
            out = F.lit(0)
            for n in sorted({r["attempt"] for r in few}):
                names = [f"{r['kind']}\x1f{r['canon']}" for r in few if r["attempt"] == n]
                out = F.when(F.concat_ws("\x1f", kind, canon).isin(*names), F.lit(n)).otherwise(out)
            return out

    else:
        # Documents that have such entities get a map of their attempts, by joins on the entities.
        each = rows.filter(F.size(parts) > 1).select(row, F.explode(F.array_distinct(entities)).alias("entity"))
        each = each.select(row, F.explode(units(F.col("entity"), kind_of(F.col("entity")))).alias("u")).select(row, F.col("u.kind").alias("k"), F.col("u.canon").alias("c"))
        each = each.join(later, (F.col("k") == F.col("kind")) & (F.col("c") == F.col("canon")))
        found = each.select(row, F.concat_ws("\x1f", "kind", "canon").alias("name"), "attempt").distinct().groupBy(F.col(row).alias("r")).agg(F.map_from_entries(F.collect_list(F.struct("name", "attempt"))).alias(maps))
        rows = rows.join(found, F.col(row) == F.col("r"), "left").drop("r")

        def attempt(kind: Column, canon: Column) -> Column:
            return F.coalesce(F.try_element_at(maps, F.concat_ws("\x1f", kind, canon)), F.lit(0))

    out = rows.withColumn(made, F.when(F.size(parts) > 1, surrogates_of(entities, attempt, key)))
    out = out.withColumn(names, surnames(F.col(made)))
    whole = F.when(F.size(parts) > 1, rebuilt(F.col(parts), F.col(made), F.col(names))).otherwise(F.get(parts, F.lit(0)))
    count = F.coalesce(F.size(F.filter(made, lambda r: r["kind"] != "none")), F.lit(0))
    return out.select(*[whole.alias(text) if c == text else F.col(c) for c in docs.columns], F.when(F.col(made).isNull(), 0).otherwise(count).cast("long").alias(own("n_entities")))


def surrogates(docs: DataFrame) -> DataFrame:
    """doc_id, text with surrogates, n_entities of every row.

    A null text stays null, an empty one empty, both without entities; equal texts get equal surrogates, rows that repeat a
    doc_id each have their own; an empty table gives an empty one; other columns are ignored.
    """
    out = replace(docs.select("doc_id", "text"))
    return out.select("doc_id", "text", F.col(own("n_entities")).alias("n_entities"))
