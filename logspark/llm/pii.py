"""Surrogates for personal data (operator 10, DataFrame functions only).

Entities are e-mail addresses, IPv4 and IPv6 addresses, card numbers (15 or 16 digits), bank accounts (IBAN), social security numbers, phone numbers
(with a country code, or in the North American form), secrets (token = "...", quoted or not), access keys by their prefix, and names after a title.
One alternation finds them, left to right; the text between them is kept as it is. The surrogate of an entity is a keyed
function of its kind and text: every digit becomes a digit, every letter a letter of the same case and script, separators stay, so
format and length are kept; card numbers and bank accounts get valid check digits, octets stay below 256, a name keeps its script, its double
parts and the gender that its title tells. The same entity has the same surrogate everywhere (coreference), however it is written: numbers
go by their digits, addresses by lower case, secrets by their value, names without title and spacing. A name that is found in a text is
replaced there without its title, too, and so are its first and its last part. A table of all distinct entities, grouped by surrogate, finds collisions: where two
entities would share one, or one would equal a real entity, the later ones in order draw again with the next attempt number,
until all differ (distinctness). After TRIES draws in its format a surrogate gets longer, so draws end whatever the format.

Cases: null and empty texts come back unchanged with 0 entities; null ids, repeated rows and other columns pass through; an
empty table gives an empty result; very long texts are rows like others. The entities of one text stay together in that row's arrays, as the text itself does.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

# Surrogate given and family names by gender and script.
NAMES = {
    ("m", "latin"): ["Alden", "Bruno", "Casper", "Dorian", "Edwin", "Felix", "Gustav", "Henrik", "Ivo", "Jonas", "Konrad", "Leon", "Marek", "Nils", "Oscar", "Pavel"],
    ("f", "latin"): ["Alma", "Brita", "Clara", "Dora", "Edith", "Flora", "Greta", "Hanna", "Ines", "Julia", "Karla", "Lena", "Mara", "Nora", "Olga", "Paula"],
    ("m", "cyrillic"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл"],
    ("f", "cyrillic"): ["Анна", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Ксения", "Мария"],
    ("m", "greek"): ["Γιώργος", "Δημήτρης", "Κώστας", "Νίκος"],
    ("f", "greek"): ["Άννα", "Ελένη", "Κατερίνα", "Μαρία"],
}
FAMILY = {
    "latin": ["Abel", "Brandt", "Cordes", "Dahl", "Ekman", "Falk", "Grau", "Holm", "Ibsen", "Jansen", "Keller", "Lund", "Moser", "Noll", "Otten", "Pohl"],
    "cyrillic": ["Белов", "Волков", "Громов", "Лебедев"],
    "greek": ["Αλεξίου", "Βλάχος", "Λάμπρου", "Παππάς"],
}
# Titles by the gender that they tell.
MALE, FEMALE = "Mr|Herr|Monsieur|Señor|Sr|Господин|Κύριος", "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Госпожа|Κυρία"
CYRILLIC, GREEK = r"\p{IsCyrillic}", r"\p{IsGreek}"

#: Letters that stand for those of the same script.
LETTERS = {CYRILLIC: "абвгдежзиклмнопрстуфхцчшэюя", GREEK: "αβγδεζηθικλμνξοπρστυφχψω", r"\p{IsHebrew}": "אבגדהוזחטיכלמנסעפצקרשת", r"\p{IsArabic}": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي", r"\p{IsHan}": "一二三四五六七八九十人大小中山水火木金土日月"}

OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: What stands before a secret, up to its quote.
SECRET = r"(?<![\p{L}\p{N}])(?i:token|secret|password|passwd|api_?key|access_?key)[\"']?\s{0,4}[=:]\s{0,4}"
#: How access keys begin.
KEYS = r"(?<![A-Za-z0-9_\-])(?:AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk-|sk_live_|rk_live_|AIza)"
#: A part of a name, double ones and those with an apostrophe as wholes, and what stands between a given name and a family name.
NAME = r"\p{Lu}(?:\p{L}|['\u2019\-]\p{Lu}(?=\p{L})){1,40}"
INNER = r"(?:(?:\p{Lu}\.|von|van|der|den|de|di) ){0,3}"
#: Kind and pattern, in order of preference at the same place.
KINDS = (
    ("email", r"[A-Za-z0-9][A-Za-z0-9._%+\-]{0,63}@(?:[A-Za-z0-9\-]{1,63}\.){1,8}[A-Za-z]{2,24}"),
    ("secret", SECRET + r"(?:\"(?=(?:[^\r\n\"]*?[\p{L}\p{N}]){4})[^\r\n\"]{6,}\"|'(?=(?:[^\r\n']*?[\p{L}\p{N}]){4})[^\r\n']{6,}'|(?=(?:[^\s\"',;&]*?[\p{L}\p{N}]){4})[^\s\"',;&]{6,})"),
    ("key", KEYS + r"[A-Za-z0-9_\-]{16,255}(?![A-Za-z0-9])"),
    ("iban", r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){3,7}(?: [A-Z0-9]{1,3})?)(?![\p{L}\p{N}])"),
    ("ip6", r"(?<![\w:.])(?=[0-9A-Fa-f:]*\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|[0-9A-Fa-f]{2,4}(?::[0-9A-Fa-f]{1,4}){0,5}:(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])"),
    ("ip", rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?![\d]|\.\d)"),
    ("phone", r"(?<![\w+])\+\d{1,3}[ .\-]?\(?\d{1,4}\)?(?:[ .\-]?\d{2,4}){2,4}(?!\d)"),
    ("phone", r"(?<![\w+.\-])(?:\([2-9]\d{2}\) ?[2-9]\d{2}[ .\-]\d{4}|[2-9]\d{2}(?: [2-9]\d{2} \d{4}|\.[2-9]\d{2}\.\d{4}|-[2-9]\d{2}-\d{4}))(?![\w\-]|\.\d)"),
    ("national", r"(?<![\w.\-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w\-]|\.\d)"),
    ("card", r"(?<!\d)(?:\d{4}(?:\d{12}| \d{4} \d{4} \d{4}|-\d{4}-\d{4}-\d{4})|3[47]\d{2}(?:\d{11}| \d{6} \d{5}|-\d{6}-\d{5}))(?!\d)"),
    ("person", rf"\b(?:{MALE}|{FEMALE})\b\.? {{1,3}}{NAME}(?: {INNER}{NAME})?"),
)
#: The alternation, without groups of its own.
ANY = "|".join(p for _, p in KINDS)
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Attempts within the format; later ones make a surrogate longer.
TRIES = 8
#: The country code of a phone number; it stays.
COUNTRY = r"^\+\d{1,3}(?=\D)"


def entities(text: Column) -> Column:
    """The entities of a text in order. Null: an empty array."""
    cheap = text.rlike(r"[0-9@\"=:_]|" + f"{MALE}|{FEMALE}")  # most texts need one look only
    return F.when(cheap, F.regexp_extract_all(text, F.lit(f"({ANY})"), F.lit(1))).otherwise(F.array().cast("array<string>"))


def pieces(text: Column) -> Column:
    """What stands between the entities: one more than there are entities."""
    return F.split(text, ANY, -1)


def kind_of(entity: Column) -> Column:
    """The kind of an entity that entities() found."""
    out = F.lit("person")
    for kind, test in reversed((
            ("secret", entity.rlike("^" + SECRET)), ("email", entity.contains("@")), ("phone", entity.rlike(r"^(?:\+|\(|\d{3}[ .\-]\d{3}[ .\-]\d{4}$)")), ("key", entity.rlike("^" + KEYS)),
            ("iban", entity.rlike(r"^[A-Z]{2}\d{2}")), ("ip6", entity.rlike("^[0-9A-Fa-f]{1,4}:")), ("national", entity.rlike(r"^\d{3}-\d{2}-\d{4}$")),
            ("ip", entity.rlike(r"^\d+\.\d")), ("card", entity.rlike(r"^\d")))):
        out = F.when(test, F.lit(kind)).otherwise(out)
    return out


TITLE = rf"^(?:{MALE}|{FEMALE})\.? +"


def _gender(entity: Column) -> Column:
    return F.when(entity.rlike(rf"^(?:{FEMALE})\b"), F.lit("f")).otherwise(F.lit("m"))


def name_of(entity: Column) -> Column:
    """A person's name without title and spacing."""
    return F.regexp_replace(F.regexp_replace(entity, TITLE, ""), " +", " ")


def _value(entity: Column) -> Column:
    """A secret without its key and quotes."""
    return F.regexp_replace(F.regexp_replace(entity, "^" + SECRET + "[\"']?", ""), "[\"']$", "")


def normal(kind: Column, entity: Column) -> Column:
    """What all spellings of an entity share. The gender belongs to names with a given name, whose surrogate tells it."""
    name = name_of(entity)
    return (F.when(kind == "email", F.lower(entity)).when(kind == "secret", _value(entity)).when(kind.isin("phone", "card", "national"), F.regexp_replace(entity, r"[^0-9]", ""))
            .when(kind.isin("ip", "key"), entity).when(kind == "ip6", F.lower(entity)).when(kind == "iban", F.regexp_replace(entity, " ", "")).when(name.contains(" "), F.concat(_gender(entity), F.lit(" "), name)).otherwise(name))


def _let(value: Column, body) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def _stream(key: str, kind: Column, norm: Column, attempt: Column) -> Column:
    """256 hexadecimal digits that follow from key, kind, normal form of the entity and attempt."""
    seed = F.concat_ws("\x1f", F.lit(key), kind, norm, attempt.cast("string"))
    return F.concat(*[F.sha2(F.concat(seed, F.lit(f"\x1f{i}")), 256) for i in range(4)])


def _draw(stream: Column, i: Column, n: int | Column) -> Column:
    """A number below n from the stream, for place i."""
    at = F.pmod(i * 2, F.lit(248)) + 1
    return F.pmod(F.conv(F.substring(stream, at.cast("int"), F.lit(5)), 16, 10).cast("long") + i, F.lit(n))


def _of(letters: str | Column, stream: Column, i: Column) -> Column:
    letters = F.lit(letters)
    return F.substring(letters, (_draw(stream, i, F.length(letters)) + 1).cast("int"), F.lit(1))


def _same_format(text: Column, stream: Column) -> Column:
    """Digits for digits (a leading 0 stays 0, others stay above 0 at the front), letters for letters of the same case and script (LETTERS; Latin ones for the rest)."""
    hexa = text.rlike("^(?=.*[0-9])(?=.*[a-f])[0-9a-f]{16,}$")
    chars = F.split(text, "")

    def one(c: Column, i: Column) -> Column:
        script = reduce(lambda out, x: F.when(c.rlike(x[0]), F.lit(x[1])).otherwise(out), LETTERS.items(), F.lit(LOWER))
        letter = _of(F.when(c < "\x80", F.lit(LOWER)).otherwise(script), stream, i)
        return (F.when(hexa, _of("0123456789abcdef", stream, i))
                .when(c.rlike("^[0-9]$"), F.when((i == 0) & (c != "0"), _draw(stream, i, 9) + 1).when(i == 0, F.lit(0)).otherwise(_draw(stream, i, 10)).cast("string"))
                .when(c.rlike(r"^\p{N}$"), _draw(stream, i, 10).cast("string")).when(c.rlike(r"^\p{Lu}$"), F.upper(letter)).when(c.rlike(r"^\p{L}$"), letter).otherwise(c))

    return F.array_join(F.transform(chars, one), "")


def _ip(text: Column, stream: Column) -> Column:
    return F.array_join(F.transform(F.split(text, r"\."), lambda c, i: (
        F.when(i == 0, _draw(stream, i * 5, 223) + 1).otherwise(_draw(stream, i * 5, 256))).cast("string")), ".")


def _ip6(text: Column, stream: Column) -> Column:
    """Hexadecimal digits for hexadecimal digits of the same case, none 0 at the front of a group."""
    groups = F.split(text, ":")
    lower = ~text.rlike("[A-F]")
    new = F.transform(groups, lambda g, i: F.array_join(F.transform(F.split(g, ""), lambda c, j: F.when(c == "", c).when(j == 0, _of("123456789abcdef", stream, i * 5)).otherwise(_of("0123456789abcdef", stream, i * 5 + j))), ""))
    joined = F.array_join(new, ":")
    return F.when(lower, joined).otherwise(F.upper(joined))


def _iban(text: Column, stream: Column) -> Column:
    """The country stays; new digits and letters in the given grouping, with valid check digits."""
    plain = F.regexp_replace(text, " ", "")
    country = F.substring(plain, 1, 2)

    def add(acc: Column, c: Column) -> Column:
        n = F.when(c.rlike("[A-Z]"), F.ascii(c) - 55).otherwise(c.cast("int"))
        return (acc * F.when(n > 9, 100).otherwise(10) + n) % 97

    def whole(rest: Column) -> Column:
        check = F.lit(98) - F.aggregate(F.split(F.concat(rest, country, F.lit("00")), ""), F.lit(0), add)
        return F.concat(country, F.lpad(check.cast("string"), 2, "0"), rest)

    new = _let(_same_format(F.substring(plain, F.lit(5), F.length(plain)), stream), whole)
    return F.when(text.contains(" "), F.trim(F.regexp_replace(new, "(.{4})", "$1 "))).otherwise(new)


def _card(text: Column, stream: Column) -> Column:
    """15 or 16 digits in the given grouping; the last one is the check digit where the given number's is valid."""
    digits = F.regexp_replace(text, r"\D", "")

    def luhn(d: Column) -> Column:
        def add(acc: Column, p: Column) -> Column:
            v = p["c"].cast("int") * F.when(p["i"] % 2 == 1, 2).otherwise(1)
            return acc + F.when(v > 9, v - 9).otherwise(v)
        return F.aggregate(F.transform(F.split(F.reverse(d), ""), lambda c, i: F.struct(c.alias("c"), i.alias("i"))), F.lit(0), add)

    def checked(drawn: Column) -> Column:
        raw = F.substring(drawn, F.lit(1), F.length(drawn) - 1)
        check = F.pmod(F.lit(10) - luhn(F.concat(raw, F.lit("0"))) % 10, F.lit(10)).cast("string")
        return F.when(luhn(digits) % 10 == 0, F.concat(raw, check)).otherwise(drawn)

    gap = F.when(text.contains(" "), F.lit(" ")).when(text.contains("-"), F.lit("-")).otherwise(F.lit(""))

    def grouped(new: Column) -> Column:
        return F.when(F.length(new) == 15, F.concat_ws("", F.substring(new, 1, 4), gap, F.substring(new, 5, 6), gap, F.substring(new, 11, 5))).otherwise(
            F.concat_ws("", F.substring(new, 1, 4), gap, F.substring(new, 5, 4), gap, F.substring(new, 9, 4), gap, F.substring(new, 13, 4)))

    return _let(_let(_same_format(digits, stream), checked), grouped)


def _pick(names: list[str], stream: Column, place: int) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in names]), (_draw(stream, F.lit(place), len(names)) + 1).cast("int"))


def _person(text: Column, stream: Column, attempt: Column) -> Column:
    """The title, then a name of the same script, gender and number of parts."""
    title, name, gender = F.regexp_extract(text, TITLE, 0), name_of(text), _gender(text)
    script = F.when(name.rlike(CYRILLIC), F.lit("cyrillic")).when(name.rlike(GREEK), F.lit("greek")).otherwise(F.lit("latin"))

    def by(rows):
        return reduce(lambda out, r: F.when(r[0], r[1]).otherwise(out), rows, F.lit(None).cast("string"))

    given = by([((gender == g) & (script == s), _pick(v, stream, 1)) for (g, s), v in NAMES.items()])
    family = by([(script == s, _pick(v, stream, 7)) for s, v in FAMILY.items()])
    # the lists are short: a later attempt adds letters of the script, so names never run out
    tail = by([(script == s, F.array_join(F.transform(F.sequence(F.lit(1), F.least(attempt, F.lit(12))), lambda i: F.element_at(
        F.array(*[F.lit(c) for c in letters]), (_draw(stream, i * 3 + 11, len(letters)) + 1).cast("int"))), ""))
        for s, letters in (("latin", "aeioumnrs"), ("cyrillic", "аеиоумнрс"), ("greek", "αειουμνρς"))])
    more = F.when(attempt > 0, tail).otherwise(F.lit(""))
    # double names stay double
    first = F.when(F.substring_index(name, " ", 1).contains("-"), F.concat(given, F.lit("-"), by([((gender == g) & (script == s), _pick(v, stream, 3)) for (g, s), v in NAMES.items()]))).otherwise(given)
    last = F.when(F.substring_index(name, " ", -1).contains("-"), F.concat(family, F.lit("-"), by([(script == s, _pick(v, stream, 9)) for s, v in FAMILY.items()]))).otherwise(family)
    return F.concat(title, F.when(name.contains(" "), F.concat(first, F.lit(" "), last)).otherwise(last), more)


def _phone(text: Column, stream: Column, country: Column) -> Column:
    """New digits in the given grouping; the first ones, as many as the country code has, stay."""
    digits = F.regexp_replace(text, r"[^0-9]", "")
    new = F.concat(F.substring(digits, F.lit(1), country), _same_format(F.substring(digits, country + 1, F.length(digits)), stream))
    place = lambda i: F.length(F.regexp_replace(F.substring(text, F.lit(1), (i + 1).cast("int")), r"[^0-9]", ""))
    return _let(new, lambda new: F.array_join(F.transform(F.split(text, ""), lambda c, i: F.when(c.rlike("^[0-9]$"), F.substring(new, place(i), F.lit(1))).otherwise(c)), ""))


def _national(text: Column, stream: Column) -> Column:
    """Three, two and four digits that such a number may have."""
    return F.concat_ws("-", (_draw(stream, F.lit(1), 500) + 100).cast("string"), (_draw(stream, F.lit(9), 89) + 10).cast("string"), (_draw(stream, F.lit(19), 8999) + 1000).cast("string"))


def surrogate(entity: Column, kind: Column, norm: Column, attempt: Column, key: str, country: Column) -> Column:
    """The surrogate in an entity's own format; stream and format are computed once."""
    return _let(_stream(key, kind, norm, attempt), lambda stream: _by_kind(entity, kind, attempt, country, stream))


def _by_kind(entity: Column, kind: Column, attempt: Column, country: Column, stream: Column) -> Column:
    host = F.regexp_extract(entity, r"@(.*)$", 1)
    # a format that leaves too little freedom for all entities of its kind gives way to distinctness: later attempts add digits
    more = F.when(attempt > TRIES, F.array_join(F.transform(F.sequence(F.lit(1), F.least(attempt - TRIES, F.lit(24))), lambda i: _draw(stream, i * 3 + 1, 10).cast("string")), "")).otherwise(F.lit(""))
    mail = F.concat(_same_format(F.regexp_extract(entity, r"^(.*)@", 1), stream), more, F.lit("@"), _same_format(F.regexp_extract(host, r"^(.*)\.", 1), F.reverse(stream)), F.lit("."), F.regexp_extract(host, r"([^.]*)$", 1))
    return (F.when(kind == "email", mail)
            .when(kind == "secret", F.concat(F.regexp_extract(entity, "^" + SECRET + "[\"']?", 0), _same_format(_value(entity), stream), more, F.regexp_extract(entity, "[\"']?$", 0)))
            .when(kind == "key", F.concat(F.regexp_extract(entity, KEYS, 0), _same_format(F.regexp_replace(entity, KEYS, ""), stream), more))
            .when(kind == "iban", F.concat(_iban(entity, stream), more)).when(kind == "ip6", F.concat(_ip6(entity, stream), F.when(more != "", F.concat(F.lit("-"), more)).otherwise(F.lit("")))).when(kind == "national", F.concat(_national(entity, stream), more))
            .when(kind == "ip", F.concat(_ip(entity, stream), F.when(more != "", F.concat(F.lit("-"), more)).otherwise(F.lit("")))).when(kind == "card", F.concat(_card(entity, stream), more))
            .when(kind == "phone", F.concat(_phone(entity, stream, country), more)).otherwise(_person(entity, stream, attempt)))


def surrogates(found: DataFrame, key: str) -> DataFrame:
    """Distinct (entity) to (entity, surrogate): the surrogates of different entities differ in normal form from one another and from all entities.

    One round draws for the entities that have none yet and keeps the draws that are free: unlike any entity, unlike any
    surrogate given before, and the first in order among equal draws. One spelling draws for all.
    """
    kind = kind_of(F.col("entity"))
    found = cut(found.select("entity", kind.alias("kind"), normal(kind, F.col("entity")).alias("norm")))
    # one spelling may tell the country code that another hides
    code = F.greatest(F.length(F.regexp_extract("entity", COUNTRY, 0)) - 1, F.lit(0))
    groups = cut(found.groupBy("kind", "norm").agg(F.min("entity").alias("entity"), F.max(code).alias("country")))
    given, todo, attempt = None, groups, 0
    while True:
        draw = surrogate(F.col("entity"), F.col("kind"), F.col("norm"), F.lit(attempt), key, F.col("country"))
        drawn = cut(todo.withColumn("drawn", draw))
        drawn = drawn.withColumn("new", normal(F.col("kind"), F.col("drawn"))).drop("drawn")
        first = drawn.groupBy("kind", "new").agg(F.min_by(F.struct("norm", "country"), "norm").alias("x")).select("kind", "new", "x.*")
        free = first.join(groups.select("kind", F.col("norm").alias("new")), ["kind", "new"], "left_anti")
        if given is not None:
            free = free.join(given.select("kind", "new"), ["kind", "new"], "left_anti")
        free = cut(free.select("kind", "norm", "country", "new", F.lit(attempt).alias("attempt")))
        given = free if given is None else given.union(free)
        todo = drawn.join(free.select("kind", "norm"), ["kind", "norm"], "left_anti").drop("new")
        if todo.isEmpty():
            return found.join(given, ["kind", "norm"]).select("entity", surrogate(F.col("entity"), F.col("kind"), F.col("norm"), F.col("attempt"), key, F.col("country")).alias("surrogate"))
        todo, attempt = cut(todo), attempt + 1


def bare_names(entity: Column, new: Column) -> Column:
    """Aggregate over the entities of a text: names without titles and their surrogates, longest first; the first and the last part of a name are names, too."""
    person = kind_of(entity) == "person"
    first, last = (lambda c, at=at: F.substring_index(c, " ", at) for at in (1, -1))
    one = lambda c, s, whole: F.collect_list(F.when(person, F.struct(F.length(c).alias("n"), F.lit(whole).alias("whole"), c.alias("name"), s.alias("new"))))
    return F.sort_array(F.concat(one(name_of(entity), name_of(new), 1), one(last(name_of(entity)), last(name_of(new)), 0), one(first(name_of(entity)), first(name_of(new)), 0)), False)


def any_name(names: Column) -> Column:
    """Any of the names, but not as a part of a double one."""
    quoted = F.transform(names, lambda x: F.concat(F.lit(r"\Q"), x["name"], F.lit(r"\E")))
    return F.concat(F.lit(r"(?<![\p{L}\p{N}]|\p{L}['\u2019\-])(?:"), F.array_join(quoted, "|"), F.lit(r")(?![\p{L}\p{N}]|['\u2019\-]\p{Lu})"))


def replace_bare(piece: Column, names: Column, pattern: Column) -> Column:
    """A piece of a text with all names replaced, in one pass."""
    new = F.transform(F.regexp_extract_all(piece, pattern, F.lit(0)), lambda h: F.element_at(F.filter(names, lambda x: x["name"] == h), 1)["new"])
    return F.when(F.size(names) == 0, piece).otherwise(F.array_join(F.zip_with(F.split(piece, pattern, -1), new, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), ""))


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with the entities in its text column replaced, and __pii_n, the number of entities. Other columns stay."""
    rows = docs.withColumn("__pii_e", entities(F.col(text)))
    # the entities of a text, by the text's hash: texts with the same hash and length are the same text
    tag = F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(7), text).alias("b"), F.length(text).alias("n"))
    need = cut(rows.where(F.size("__pii_e") > 0).select(tag.alias("t"), F.explode(F.array_distinct("__pii_e")).alias("entity")).distinct())
    given = cut(surrogates(need.select("entity").distinct(), key))
    maps = need.join(given, "entity").groupBy("t").agg(F.map_from_entries(F.collect_list(F.struct("entity", "surrogate"))).alias("__pii_m"), bare_names(F.col("entity"), F.col("surrogate")).alias("__pii_b"))
    maps = maps.withColumn("__pii_p", any_name(F.col("__pii_b")))
    # texts without entities stay out of the join
    joined = rows.where(F.size("__pii_e") > 0).join(maps.select(F.col("t").alias("__pii_k"), "__pii_m", "__pii_b", "__pii_p"), tag == F.col("__pii_k"))
    parts = F.zip_with(pieces(F.col(text)), F.transform(F.col("__pii_e"), lambda e: F.element_at(F.col("__pii_m"), e)),
                       lambda a, b: F.concat(replace_bare(F.coalesce(a, F.lit("")), F.col("__pii_b"), F.col("__pii_p")), F.coalesce(b, F.lit(""))))
    new = joined.select(*[F.array_join(parts, "").alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns], F.size("__pii_e").cast("long").alias("__pii_n"))
    same = rows.where(F.size("__pii_e") == 0).select(*[F.col(f"`{c}`") for c in docs.columns], F.lit(0).cast("long").alias("__pii_n"))
    return same.unionAll(new)


#: Stands for the secret that a deployment passes; results are the same for the same key.
KEY = "replace-me"


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), KEY)
    return out.select("doc_id", F.col("__pii_n").alias("n_entities"), "text")
