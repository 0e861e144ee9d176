"""Surrogates for personal data, in DataFrame functions only.

Entities are found by patterns and brought to a canonical form, so that different writings of one entity get one
surrogate everywhere. A surrogate is drawn from a keyed digest of type and canonical form; it has the entity's type,
format, script and gender. Surrogates that meet each other or a real entity are drawn again until all differ.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axiomflow.llm.common import free_name, materialised, prepare

FEMALE, MALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|г-жа", "Mr|Herr|Monsieur|Señor|Sr|г-н"
HEX = "[0-9a-fA-F]{1,4}"
#: One part of a name: Smith, McDonald, O'Brien.
PART = r"(?:\p{Lu}['’])?\p{Lu}\p{Ll}++(?:\p{Lu}\p{Ll}++)?"
#: Fixed beginnings of keys; what follows is drawn anew.
KEYS = "AKIA|sk-|gh[pousr]_|xox[abprs]-|AIza|eyJ"
#: Country calling codes of one or two digits; the others have three.
CALLING = r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
PATTERNS = {
    # a domain has 127 labels at most
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.){1,126}[A-Za-z]{2,}+",
    "ip": r"(?<![\d.])(?<![vV]ersion )(?<![vV])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)",
    "ipv6": rf"(?<![\p{{L}}\d:.])(?=[a-fA-F:]{{0,4}}\d|[a-fA-F:]{{5,}}+\d)(?:(?:{HEX}:){{7}}{HEX}|(?:{HEX}:){{1,6}}(?::{HEX}){{1,6}}|(?:{HEX}:){{1,7}}:|:(?::{HEX}){{1,7}})(?![\p{{L}}\d:])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\d+])\+\d{1,3}(?:[ .-]?\d{2,4}){3,4}(?!\d)"
    # without brackets or a leading +: 3-3-4 digits, a trunk 0 and an area, pairs
    r"|(?<![\d+.-])(?:\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4}|\d{3} \d{3} \d{4}|0\d(?:[ .-]\d{2}){4}|0\d{1,4}[ /-]\d{3,4}[ -]?\d{3,5})(?![\d-]|\.\d)",
    "card": r"(?<![\d+-])(?:\d{4}[ -]?){3}\d{1,7}(?!\d)",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}| [A-Z0-9]{4}(?: (?=[A-Z]{0,3}\d)[A-Z0-9]{4}){2,6}(?: (?=[A-Z]{0,2}\d)[A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9])(?:[a-f0-9]{32,64}|AKIA[0-9A-Z]{16}|sk-[A-Za-z0-9_-]{20,}+|gh[pousr]_[A-Za-z0-9]{36,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{10,}+(?:\.[A-Za-z0-9_-]{10,}+){2})(?![A-Za-z0-9])",
    "name": rf"(?<!\p{{L}})(?:{FEMALE}|{MALE})\.? {PART}(?:[ -]{PART}){{0,2}}(?!\p{{L}})",
}
DIGITS = ("phone", "card", "ssn")
GIVEN = {
    "female": ["Anna", "Clara", "Elena", "Ida", "Julia", "Laura", "Maria", "Nora", "Olga", "Petra", "Rosa", "Sara", "Sofia", "Tessa", "Vera", "Zoe"],
    "male": ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Hugo", "Ivan", "Jonas", "Leon", "Martin", "Oscar", "Paul", "Simon", "Victor", "Walter"],
    "female_cyrillic": ["Анна", "Вера", "Дарья", "Елена", "Ида", "Клара", "Лариса", "Мария", "Нина", "Ольга", "Полина", "Раиса", "София", "Тамара", "Ульяна", "Юлия"],
    "male_cyrillic": ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Лев", "Максим", "Никита", "Олег", "Павел", "Роман", "Семён", "Фёдор"],
}
SYLLABLES = {"latin": ["ba", "den", "fel", "gar", "hol", "kin", "lem", "mor", "nes", "per", "ran", "sol", "tar", "ven", "wil", "zan"], "cyrillic": ["ба", "ден", "вер", "гор", "зам", "кин", "лев", "мор", "нес", "пер", "ран", "сол", "тар", "вин", "лук", "жан"]}


def kind_of(entity: Column) -> Column:
    out = F.lit("name")
    for kind, pattern in reversed(PATTERNS.items()):
        if kind != "name":
            out = F.when(entity.rlike(f"^(?:{pattern})$"), kind).otherwise(out)
    return out


def canonical(kind: Column, entity: Column) -> Column:
    """One form for all writings: lower-cased e-mails and names (with the title's gender), digits of numbers (of phones
    with a leading +), IBANs without spaces, all eight groups of IPv6 addresses."""
    digits = F.regexp_replace(entity, r"[^0-9]", "")
    phone = F.concat(F.when(entity.startswith("+"), "+").otherwise(""), digits)
    person = F.concat(F.when(entity.rlike(rf"^(?:{FEMALE})\b"), "female ").otherwise("male "), F.lower(F.regexp_extract(entity, r"^\S+ (.*)$", 1)))
    groups = lambda part: F.filter(F.split(part, ":"), lambda g: g != "")
    left, right = groups(F.substring_index(entity, "::", 1)), F.when(entity.contains("::"), groups(F.substring_index(entity, "::", -1))).otherwise(F.array().cast("array<string>"))
    eight = F.concat(left, F.array_repeat(F.lit("0"), F.lit(8) - F.size(left) - F.size(right)), right)
    ipv6 = F.array_join(F.transform(eight, lambda g: F.lpad(F.lower(g), 4, "0")), ":")
    numbers = F.when(kind == "phone", phone).when(kind.isin(*DIGITS), digits).when(kind == "iban", F.regexp_replace(entity, " ", "")).when(kind == "ipv6", ipv6)
    return numbers.when(kind == "email", F.lower(entity)).when(kind == "name", person).otherwise(entity)


def _number(h: Column, place: Column | int, most: int) -> Column:
    """0 to most - 1 from the digest's byte at a place."""
    at = (F.lit(place) if isinstance(place, int) else place) * 2 + 1
    return (F.conv(F.substring(h, at, F.lit(2)), 16, 10).cast("int") % most).cast("int")


def _luhn(digits: Column) -> Column:
    """The Luhn sum modulo 10 of a string of digits."""
    n = F.length(digits)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: _doubled(F.substring(digits, i, F.lit(1)).cast("int"), (n - i) % 2 == 1))
    return F.aggregate(each, F.lit(0), lambda a, b: a + b) % 10


def _doubled(d: Column, twice: Column) -> Column:
    return F.when(twice, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)


def _pick(values: list[str], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), at + 1)


def _drawn_like(text: Column, h: Column) -> Column:
    """Digits for digits, capitals for capitals, small letters for small letters; other characters stay."""
    letter = lambda first, i: F.char(F.lit(ord(first)) + _number(h, i % 64, 26))
    one = lambda c, i: F.when(c.rlike("[0-9]"), _number(h, i % 64, 10).cast("string")).when(c.rlike("[A-Z]"), letter("A", i)).when(c.rlike("[a-z]"), letter("a", i)).otherwise(c)
    return F.when(F.length(text) == 0, "").otherwise(F.array_join(F.transform(F.split(text, ""), one), ""))


def _remainder97(text: Column) -> Column:
    """Of a string of digits and capitals (A is 10, ..., Z is 35), read as one number."""
    step = lambda r, c: F.when(c.rlike("[0-9]"), r * 10 + c.cast("int")).otherwise(r * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(F.split(text, ""), F.lit(0), lambda r, c: F.when(c == "", r).otherwise(step(r, c)).cast("int"))


def surrogate(kind: Column, form: Column, key: str, attempt: Column) -> Column:
    """The canonical form of a surrogate, from a keyed digest. Each attempt at a name adds a syllable."""
    h = F.sha2(F.concat_ws("|", F.lit(key), kind, form, attempt.cast("string")), 512)
    plain = F.regexp_replace(form, r"^\+", "")
    n = F.length(plain)
    drawn = F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: _number(h, i % 64, 10).cast("string")), "")
    # a country's code or the first digit stays, an issuer's or a trunk; numbers of one length stay numbers of that length
    code = F.coalesce(F.nullif(F.regexp_extract(plain, rf"^(?:{CALLING})", 0), F.lit("")), F.substring(plain, 1, 3))
    head = F.when(form.startswith("+"), code).otherwise(F.substring(plain, 1, 1))
    number = F.substring(F.concat(head, (_number(h, 63, 8) + 2).cast("string"), drawn), F.lit(1), n)
    phone = F.concat(F.when(form.startswith("+"), "+").otherwise(""), number)
    short = F.substring(number, F.lit(1), n - 1)
    check = (10 - _luhn(F.concat(short, F.lit("0")))) % 10
    card = F.when(_luhn(plain) == 0, F.concat(short, check.cast("string"))).otherwise(number)
    ssn = F.concat(F.lit("9"), F.substring(drawn, 1, 8))
    ip = F.concat_ws(".", *[(_number(h, i, 254) + 1).cast("string") for i in range(4)])
    ipv6 = F.concat_ws(":", F.lit("2001"), F.lit("0db8"), *[F.substring(h, 4 * i + 1, 4) for i in range(6)])
    mail = F.concat(F.lit("u"), F.substring(h, 1, 14), F.lit("@mail"), _number(h, 20, 10).cast("string"), F.lit(".example."), _pick(["com", "net", "org"], _number(h, 21, 3)))
    long_hex = F.concat(h, h)
    begun = F.regexp_extract(form, f"^(?:{KEYS})", 0)
    secret = F.when(form.rlike("^[a-f0-9]+$"), F.substring(long_hex, F.lit(1), n)).otherwise(F.concat(begun, _drawn_like(F.substring(form, F.length(begun) + 1, n), h)))
    account = _drawn_like(F.substring(form, F.lit(5), n), h)
    iban = F.concat(F.substring(form, 1, 2), F.lpad((98 - _remainder97(F.concat(account, F.substring(form, 1, 2), F.lit("00")))).cast("string"), 2, "0"), account)
    who, cyrillic = F.substring_index(form, " ", 1), form.rlike(r"\p{IsCyrillic}")
    given = F.when(cyrillic, F.when(who == "female", _pick(GIVEN["female_cyrillic"], _number(h, 0, 16))).otherwise(_pick(GIVEN["male_cyrillic"], _number(h, 0, 16))))
    given = given.otherwise(F.when(who == "female", _pick(GIVEN["female"], _number(h, 0, 16))).otherwise(_pick(GIVEN["male"], _number(h, 0, 16))))
    syllables = F.sequence(F.lit(1), F.least(attempt, F.lit(55)) + 4)
    family = F.array_join(F.transform(syllables, lambda i: F.when(cyrillic, _pick(SYLLABLES["cyrillic"], _number(h, i, 16))).otherwise(_pick(SYLLABLES["latin"], _number(h, i, 16)))), "")
    words = F.size(F.split(form, r"[ -]"))
    name = F.concat(who, F.lit(" "), F.when(words > 2, F.concat(F.lower(given), F.lit(" "), family)).otherwise(family))
    out = name
    for k, v in {"email": mail, "ip": ip, "ipv6": ipv6, "ssn": ssn, "phone": phone, "card": card, "iban": iban, "secret": secret}.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def rendered(kind: Column, entity: Column, form: Column) -> Column:
    """A surrogate's canonical form in the writing of the entity: separators of numbers, title and capitals of names. IPv6
    addresses are written in full."""
    place = lambda i: F.length(F.regexp_replace(F.substring(entity, F.lit(1), i + 1), r"[^0-9]", ""))
    number = F.array_join(F.transform(F.split(entity, ""), lambda c, i: F.when(c.rlike("[0-9]"), F.substring(F.regexp_replace(form, r"^\+", ""), place(i), F.lit(1))).otherwise(c)), "")
    seen = lambda i: F.length(F.regexp_replace(F.substring(entity, F.lit(1), i + 1), " ", ""))
    iban = F.array_join(F.transform(F.split(entity, ""), lambda c, i: F.when(c == " ", c).otherwise(F.substring(form, seen(i), F.lit(1)))), "")
    whole, title = F.initcap(F.regexp_extract(form, r"^\S+ (.*)$", 1)), F.regexp_extract(entity, rf"^(?:{FEMALE}|{MALE})\.? ", 0)
    # a person who is called by the last part of the name only is so in the surrogate too
    said = F.substring(entity, F.length(title) + 1, F.length(entity))
    name = F.concat(title, F.when(said.rlike("[ -]"), whole).otherwise(F.substring_index(whole, " ", -1)))
    return F.when(kind.isin(*DIGITS), number).when(kind == "iban", iban).when(kind == "name", name).otherwise(form)


#: A kind whose distinct entities come near to all that its format can write would be drawn again without end.
ATTEMPTS = 200


def assign(entities: DataFrame, key: str) -> DataFrame:
    """(kind, form, replacement) for distinct (kind, form): no two replacements of a kind are equal, and none is a
    real entity. What collides is drawn again, the least form of those that meet stays; after ATTEMPTS rounds it is an error."""
    now = entities.withColumn("attempt", F.lit(0))
    for _ in range(ATTEMPTS):
        now = materialised(now.select("kind", "form", "attempt", surrogate(F.col("kind"), F.col("form"), key, F.col("attempt")).alias("replacement")), "surrogates")
        met = now.groupBy("kind", "replacement").agg(F.min("form").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
        twice = now.join(met, ["kind", "replacement"]).filter("form != first").select("kind", "form")
        real = now.join(entities.select("kind", F.col("form").alias("replacement")), ["kind", "replacement"], "left_semi").select("kind", "form")
        again = materialised(twice.union(real).distinct(), "surrogates-again")
        if again.isEmpty():
            return now.select("kind", "form", "replacement")
        marked = now.drop("replacement").join(again.withColumn("again", F.lit(1)), ["kind", "form"], "left")
        now = marked.select("kind", "form", (F.col("attempt") + F.coalesce("again", F.lit(0))).alias("attempt"))
    raise RuntimeError(f"surrogates still collide after {ATTEMPTS} attempts: too many entities for their format")


def _people(titled: Column) -> Column:
    """(form, full, family) of the persons with more than one name part among a text's titled names, in text order."""
    person = lambda e: F.named_struct(F.lit("form"), canonical(F.lit("name"), e), F.lit("full"), F.lower(F.regexp_extract(e, r"^\S+ (.*)$", 1)), F.lit("family"), F.lower(F.regexp_extract(e, r"([^ -]+)$", 1)))
    return F.array_distinct(F.transform(F.filter(titled, lambda e: e.rlike(r"^\S+ .*[ -]")), person))


def _needs(text: Column) -> dict[str, Column]:
    """By kind, cheap conditions that each match must meet; "digits" for the kinds that aren't named."""
    holds = lambda *parts: reduce(Column.__or__, map(text.contains, parts))
    return {
        "digits": text.rlike(r"\d[ .)/-]{0,2}\d"),
        "email": text.contains("@"),
        "ipv6": text.rlike(":[0-9a-fA-F]{0,4}:"),
        "secret": holds("AKIA", "sk-", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "AIza", "eyJ") | text.rlike("[a-f0-9]{32}"),
        "name": holds(*f"{FEMALE}|{MALE}".split("|")),
    }


def _pattern(text: Column, titled: Column) -> Column:
    """The patterns that can match at all, by cheap conditions that each match must meet; for a text with titled persons also
    their names and last parts without a title. Empty if nothing can match."""
    said = F.flatten(F.transform(F.filter(titled, lambda e: e.rlike(r"^\S+ .*[ -]")), lambda e: F.array(F.regexp_extract(e, r"^\S+ (.*)$", 1), F.regexp_extract(e, r"([^ -]+)$", 1))))
    # longer ones first; names hold letters, spaces, hyphens and apostrophes only
    names = F.array_sort(F.array_distinct(said), lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0))
    needs = _needs(text)
    known = [F.when(needs.get(kind, needs["digits"]), F.lit(f"(?:{pattern})")) for kind, pattern in PATTERNS.items()]
    mentions = F.when(F.size(names) > 0, F.concat(F.lit(r"(?<![\p{L}'’])(?:"), F.array_join(names, "|"), F.lit(r")(?![\p{L}])")))
    return F.concat_ws("|", *known, mentions)


def _form(kind: Column, entity: Column, people: Column) -> Column:
    """The canonical form; a mention of a person of the same text by the name without a title, or by its last part, is theirs."""
    own = canonical(kind, entity)
    titled = entity.rlike(rf"^(?:{FEMALE}|{MALE})\b\.? ")
    said = F.when(titled, F.lower(F.regexp_extract(entity, r"^\S+ (.*)$", 1))).otherwise(F.lower(entity))
    gender = F.substring_index(own, " ", 1)
    same = F.filter(people, lambda p: ((p["full"] == said) | (p["family"] == said)) & (~titled | p["form"].startswith(gender)))
    return F.when((kind == "name") & (F.size(same) > 0), F.get(same, F.lit(0))["form"]).otherwise(own)


def pseudonymise(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = "axiomflow") -> DataFrame:
    """Adds ``private_text``, with a surrogate for each entity, and ``n_entities``.

    All rows stay, and rows with equal id and text get the same result. A null or empty text gives an empty one, an empty
    table no rows. The same entity has the same surrogate in all documents under one ``key``, different entities have
    different ones. Texts of any length are taken whole; an e-mail's domain has up to 127 labels. Columns of the
    added names are replaced, others may have any names.
    """
    prepare(df.sparkSession)
    added = ["private_text", "n_entities"]
    passed = [c for c in df.columns if c not in added]
    doc_id, doc_hash, list_id, list_hash, list_r, names = (free_name(df, f"__pii_{c}") for c in ("id", "hash", "id2", "hash2", "r", "text"))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    titled = F.when(_needs(text)["name"], F.regexp_extract_all(text, F.lit(PATTERNS["name"]), 0)).otherwise(F.array().cast("array<string>"))
    doc, body = F.col(f"`{id_col}`").alias(doc_id), F.xxhash64(text).alias(doc_hash)
    given = df.filter(reduce(Column.__or__, _needs(text).values())).select(doc, body, text.alias("text"), titled.alias("titled"))
    given = given.withColumn("pattern", _pattern(F.col("text"), F.col("titled")))
    entities = F.when(F.col("pattern") != "", F.regexp_extract_all("text", F.col("pattern"), 0))
    found = given.select(doc_id, doc_hash, "titled", entities.alias("e"))
    each = found.select(doc_id, doc_hash, _people(F.col("titled")).alias("people"), F.posexplode("e").alias("at", "entity")).withColumn("kind", kind_of(F.col("entity")))
    each = materialised(each.withColumn("form", _form(F.col("kind"), F.col("entity"), F.col("people"))).drop("people"), "entities")
    new = assign(each.select("kind", "form").distinct(), key)
    placed = each.join(new, ["kind", "form"]).select(doc_id, doc_hash, "at", rendered(F.col("kind"), F.col("entity"), F.col("replacement")).alias("r"))
    lists = placed.groupBy(F.col(doc_id).alias(list_id), F.col(doc_hash).alias(list_hash)).agg(F.sort_array(F.collect_set(F.struct("at", "r"))).alias(list_r))
    work = df.select(*[F.col(f"`{c}`") for c in passed], F.col(f"`{text_col}`").cast("string").alias(names), doc, body)
    text = F.coalesce(F.col(names), F.lit(""))
    titled = F.when(_needs(text)["name"], F.regexp_extract_all(text, F.lit(PATTERNS["name"]), 0)).otherwise(F.array().cast("array<string>"))
    joined = work.join(lists, work[doc_id].eqNullSafe(lists[list_id]) & (work[doc_hash] == lists[list_hash]), "left")
    filled = F.array_join(F.transform(F.split(text, _pattern(text, titled), -1), lambda p, i: F.concat(p, F.coalesce(F.get(list_r, i)["r"], F.lit("")))), "")
    return joined.select(*[F.col(f"`{c}`") for c in passed], F.when(F.col(list_r).isNull(), text).otherwise(filled).alias("private_text"), F.coalesce(F.size(list_r), F.lit(0)).cast("bigint").alias("n_entities"))
