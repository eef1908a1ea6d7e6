"""Surrogates for personal data and secrets, in DataFrame functions only.

Entities are found by one pattern with ordered alternatives. What identifies someone is a
unit: an address, a number, a key, a given name, a family name. A unit has a canonical form
(digits with the country code, lower case, no spaces), so that different spellings of it are the same one. Its surrogate
follows from a secret key, its type and its canonical form: the same unit has the same surrogate
in all documents. The surrogate keeps the type and the format of each spelling (length,
separators, letter case, country code, a valid check number of a card or an IBAN), the honorific
and the gender and script of a name.

Names are found after an honorific or several of them, with initials and particles, which stay; an office alone (``Mr. President``) is no name. Wherever
else the same document writes such a name, whole or one of its parts, in capitals or (a family name) in small letters, it is replaced as well; a name that
is a word as well (``Will``, ``Klein``) stays where it stands alone at the start of a sentence, and in small letters. A given name without a gender (``Dr.``) has that of the
document's first mention of it that has one.

Two units of a type may not get the same surrogate, nor one the surrogate that is another
unit of the corpus; what is compared is what will be written. All units of the corpus are checked for that, and those that lose try again
under the next number until none does; only the few that had to are remembered. They are
written into the expression while they are at most ``max_inline``, else joined to the rows
that hold them; both give the same texts. Units that are left after ``rounds``, because their format has too few
values, get a mark with their type and sixteen hexadecimal digits. Hot units are counted before they are shuffled.

Null texts stay null and have no entities. Empty texts, and texts without entities, are unchanged. Repeated rows
change alike; very long texts are read whole; an empty table stays empty. Of forms that could begin at
one place the first in ``FORMS`` is taken. All other columns are kept, whatever their names: the column of types is ``pii_types``, with underscores behind if there is one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.store import materialise

# Forms of entities, in the order in which they are tried. They hold no capturing groups.
_GROUP = r"[0-9A-Fa-f]{1,4}"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_HONORIFIC = r"(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Herrn|Frau|Monsieur|Madame|Mademoiselle|Mme|Señor|Señora|Señorita|Sr|Sra|Господин|Госпожа|Κύριος|Κυρία)"
#: Offices that are spoken to as names are, and may stand before one.
_OFFICE = (
    r"(?:Vice|Prime|President|Speaker|Chair|Chairman|Chairwoman|Chancellor|Minister|Secretary|Ambassador|Mayor|Judge|Justice|Senator|Governor|Director|Doctor|Professor|"
    r"Präsidentin|Präsident|Bundeskanzlerin|Bundeskanzler|Kanzlerin|Kanzler|Ministerin|Direktorin|Direktor|Doktor|Professorin|Président|Présidente|Maire|Ministre|Directeur|Directrice|Docteur|Professeur|Presidente|Presidenta|Ministro|Ministra|Doctora|Profesor|Profesora)"
)
_HONORIFICS = rf"{_HONORIFIC}\b(?:(?<=Mr|Mrs|Ms|Dr|Prof|Mme|Sr|Sra)\.)?(?: (?:{_HONORIFIC}|{_OFFICE})\b(?:(?<=Mr|Mrs|Ms|Dr|Prof|Mme|Sr|Sra)\.)?)*"
_PARTICLE = r"(?:v[ao]n(?: (?:de[mnr]?|het))?|ter|de(?: (?:las?|los))?|del|della|di|da|dos|du|des)"
_KEPT = r"(?:(?:\p{Lu}\.)+|v[ao]n|de[mnr]?|het|ter|las?|los|del|della|di|da|dos|du|des)"
_WORD = rf"(?!(?:{_OFFICE}|{_HONORIFIC})\b)\p{{Lu}}(?:['’]?\p{{L}})+(?:-\p{{Lu}}(?:['’]?\p{{L}})+)*"
_NAME = rf"(?:\p{{Lu}}\. ?){{0,3}}(?:{_PARTICLE} ){{0,3}}{_WORD}(?:(?: \p{{Lu}}\.)? (?:{_PARTICLE} ){{0,3}}{_WORD}){{0,2}}"
#: Names that are words as well, in lower case. Alone at the start of a sentence they stay, and so do they in lower case.
_COMMON = (
    "will may mark bill art rich grant frank rose grace hope faith joy dawn june april august summer autumn young king white brown black green gray grey long short wood woods stone hill field fields lake rivers waters banks bush church hall house park parks "
    "street west north east south day weeks knight bishop pope price cash gold silver rice bean berry cherry lamb wolf fox bird drake swan crane marsh moss reed snow frost winter storm bright best good strong sharp small little love moody noble power powers smith "
    "baker carter cook fisher hunter mason miller parker porter potter turner walker ward weaver carpenter butler page cross wise savage case chance guy penny klein groß gross lang kurz schwarz weiß weiss braun jung neu alt könig kaiser vogel bach berg stein wald "
    "baum busch sommer herbst ernst koch petit grand blanc noir roux fort bon roi pierre marchand boulanger fontaine blanco rubio moreno bueno delgado cruz flores rosa león reyes rey iglesias campos prado pastor guerra paz sol luz pilar dolores santos rojo calvo"
).split()
FORMS = {
    "key": r"\bAKIA[0-9A-Z]{16}\b|\bgh[pousr]_[A-Za-z0-9]{20,}\b|\bsk-[A-Za-z0-9_-]{20,}|\beyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,}",
    "secret": r"(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\b) ?[=:] ?[\"']?[^\s\"',;]{6,}",
    "email": r"(?<![\p{IsLatin}0-9._%+-])[\p{IsLatin}0-9._%+-]{1,256}+@(?:[\p{IsLatin}0-9-]{1,63}\.){1,20}[\p{IsLatin}]{2,24}",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)|(?<![\w:])(?:{_GROUP}:){{7}}{_GROUP}(?![\w:])|(?<![\w:])(?=[0-9A-Fa-f:]{{0,39}}\d)(?:(?:{_GROUP}:){{2,6}}|{_GROUP}:(?=(?::{_GROUP}){{2}}))(?::{_GROUP}){{1,5}}(?![\w:])",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?(?:\d[ .-])?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<![\w(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])"
    r"|(?<![\w.,+-])00[1-9]\d{0,2}[ .-]?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?![\w-])|(?<![\w.,+-])0[1-9]\d{1,3}[ /-]\d{5,8}(?![\w-])|(?<![\w.,+-])0[1-9](?:[ .-]\d{2}){4}(?![\w-])",
    "card": r"(?<![\w.-])[3-6]\d{3}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?!\d)",
    "person": rf"\b{_HONORIFICS} {_NAME}",
}
#: Inside a word nothing begins but an address after a letter that addresses don't have, and groups of digits.
ANY = rf"(?<!\p{{L}})(?:{'|'.join(f'(?:{p})' for p in FORMS.values())})|(?<=[^\x00-\x7F])(?:{FORMS['email']})|(?<=\p{{L}})(?:{FORMS['ssn']}|{FORMS['ip']})"
#: What every entity has; a cheap test that most texts fail.
HINT = rf"[0-9@]|(?<!\p{{L}})(?:(?i:password|passwd|pwd|secret|token|[a-z]+[_-]?key|key)\b ?[=:]|{_HONORIFIC}\.? (?:\p{{Lu}}|{_PARTICLE} )|sk-|eyJ|gh[pousr]_)"
#: Characters beyond which a key is not changed character by character.
LONG = 4096
#: The country code at the head of a phone number.
_COUNTRY = r"^\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
_FEMALE = r"^(?:Mrs|Ms|Miss|Frau|Madame|Mademoiselle|Mme|Señora|Señorita|Sra|Госпожа|Κυρία)\b"
_MALE = r"^(?:Mr|Herrn|Herr|Monsieur|Señor|Sr|Господин|Κύριος)\b"
_SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga ge ha he ka ke la le li lo ma me mi mo na ne ni no ra re ri ro sa se so ta te to va ve".split(),
    "cyrillic": "ба бе бо ва ве во га ге да де до за зе ка ко ла ле ли ло ма ме ми мо на не ни но ра ре ро са се со та те то".split(),
    "greek": "βα βε βο γα γε δα δε δο ζα ζε θα θε κα κε κο λα λε λι λο μα με μι μο να νε νι νο ρα ρε ρο σα σε σο τα τε το".split(),
}
_ENDINGS = {"latin": {"f": "lina", "m": "bert", "n": "ky", "last": "mond"}, "cyrillic": {"f": "лина", "m": "мир", "n": "ша", "last": "лов"}, "greek": {"f": "λίνα", "m": "νος", "n": "λη", "last": "δης"}}


def let(x: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _type(e: Column) -> Column:
    return reduce(lambda rest, k: F.when(e.rlike(f"^(?:{FORMS[k]})$"), F.lit(k)).otherwise(rest), reversed([k for k in FORMS if k != "secret"]), F.lit("secret"))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _script(s: Column) -> Column:
    return F.when(s.rlike(r"\p{IsCyrillic}"), "cyrillic").when(s.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _gender(e: Column) -> Column:
    return F.when(e.rlike(_FEMALE), "f").when(e.rlike(_MALE), "m").otherwise("n")


#: Units of a spelling: type (for names with gender and script), canonical form, and the part of the spelling that is replaced.
_UNIT = "struct<kind:string,canon:string,part:string>"


def _unit(kind: Column, canon: Column, part: Column) -> Column:
    return F.struct(kind.alias("kind"), canon.alias("canon"), part.alias("part"))


def _phone(e: Column) -> Column:
    """A number with its country code (after + or 00); one that begins with a single 0 is of a country that it does not tell; any other is taken for one of the North American plan, whose form it has."""
    digits = _digits(e)
    return F.when(e.startswith("+"), F.concat(F.lit("+"), digits)).when(e.startswith("00"), F.concat(F.lit("+"), F.substring(digits, F.lit(3), F.length(digits)))).when(e.startswith("0"), digits).otherwise(F.concat(F.lit("+1"), digits))


def _units(e: Column, kind: Column, head: Column, gender: Column) -> Column:
    part = F.substring(e, F.length(head) + 1, F.length(e))
    words = F.split(part, " ")
    family = lambda w: _unit(F.concat(F.lit("last:"), _script(w)), F.lower(w), w)
    given = lambda w: _unit(F.concat_ws(":", F.lit("given"), gender, _script(w)), F.lower(w), w)
    # Initials and particles are no units and stay; what is left before the last word are given names.
    person = F.transform(words, lambda w, i: F.when(w.rlike(rf"^{_KEPT}$"), _unit(F.lit(""), w, w)).when(i == F.size(words) - 1, family(w)).otherwise(given(w)))
    canon = F.when(kind == "email", F.lower(part)).when(kind.isin("ssn", "card"), _digits(part)).when(kind == "ip", F.lower(part)).when(kind == "phone", _phone(part)).when(kind == "iban", F.regexp_replace(part, " ", "")).otherwise(part)
    return F.when(kind == "none", F.array().cast(f"array<{_UNIT}>")).when(kind != "person", F.array(_unit(kind, canon, part))).otherwise(person)


def entities(spelled: Column) -> Column:
    """Entities of a text, given in its order: type, what stays before its units (an honorific, the name of a secret), and units."""
    before = {"person": rf"^({_HONORIFICS} )", "secret": r"^([^=:]*[=:] ?[\"']?)"}
    # A number of a card's form whose check digit does not fit is no card, and stays.
    kind = lambda e: let(_type(e), lambda k: F.when((k == "card") & (_luhn(_digits(e)) != 0), "none").otherwise(k))
    typed = F.transform(spelled, lambda e: F.struct(e.alias("e"), kind(e).alias("kind")))
    head = lambda x: F.when(x["kind"] == "person", F.regexp_extract(x["e"], before["person"], 1)).when(x["kind"] == "secret", F.regexp_extract(x["e"], before["secret"], 1)).when(x["kind"] == "none", x["e"]).otherwise(F.lit(""))
    name = lambda x: F.lower(F.substring_index(F.substring(x["e"], F.length(head(x)) + 1, F.length(x["e"])), " ", 1))
    cut = F.transform(typed, lambda x: F.struct(x["e"].alias("e"), x["kind"].alias("kind"), head(x).alias("head"), F.when(x["kind"] == "person", name(x)).alias("name"), F.when(x["kind"] == "person", _gender(x["e"])).alias("gender")))

    def solved(all_of: Column) -> Column:
        told = F.filter(all_of, lambda y: y["gender"].isin("f", "m"))
        gender = lambda x: F.when(x["gender"] != "n", x["gender"]).otherwise(F.coalesce(F.get(F.filter(told, lambda y: y["name"] == x["name"]), F.lit(0))["gender"], F.lit("n")))
        return F.transform(all_of, lambda x: F.struct(x["kind"].alias("kind"), x["head"].alias("head"), _units(x["e"], x["kind"], x["head"], gender(x)).alias("units")))

    return let(cut, solved)


#: Stands around entities while a text is taken apart; three characters for private use.
_FENCE = "\ue000\ue013\ue007"


def taken_apart(text: Column) -> Column:
    """Gaps and entities of a text in turn, a gap first and last; a text without entities is one gap. The pattern goes over the text once."""
    whole = F.array(text)
    once = F.split(F.regexp_replace(text, ANY, f"{_FENCE}$0{_FENCE}"), _FENCE, -1)
    gaps, found = F.split(text, ANY, -1), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    twice = F.filter(F.flatten(F.zip_with(gaps, found, lambda a, b: F.array(a, b))), lambda x: x.isNotNull())
    return F.when(~text.rlike(HINT), whole).when(F.contains(text, F.lit(_FENCE)), twice).otherwise(once)


def _every_other(parts: Column, first: int) -> Column:
    return F.filter(parts, lambda x, i: i % 2 == first)


def _stream(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """256 hexadecimal digits that follow from key, type, canonical form and attempt."""
    seed = F.concat_ws("\x1f", F.lit(key), kind, canon, attempt.cast("string"))
    return F.concat(*(F.sha2(F.concat(seed, F.lit(f"\x1f{i}")), 256) for i in range(4)))


def _draw(stream: Column, i: Column) -> Column:
    """A number below 65,536 for place ``i``."""
    return F.conv(F.substring(stream, F.pmod(i, F.lit(64)) * 4 + 1, F.lit(4)), 16, 10).cast("int")


def _pick(alphabet: str, n: Column) -> Column:
    return F.substring(F.lit(alphabet), F.pmod(n, F.lit(len(alphabet))) + 1, F.lit(1))


def _chars(s: Column, change) -> Column:
    """A string with each character changed by ``change(character, place from 1)``."""
    places = F.when(F.length(s) > 0, F.sequence(F.lit(1), F.length(s))).otherwise(F.array().cast("array<int>"))
    pairs = F.transform(places, lambda i: F.struct(F.substring(s, i, F.lit(1)).alias("c"), i.alias("i")))
    return F.array_join(F.transform(pairs, lambda p: change(p["c"], p["i"])), "")


def _like(s: Column, stream: Column, hexadecimal: Column | None = None) -> Column:
    """Letters for letters, digits for digits, all else as it is."""
    lower, digit = "abcdefghijklmnopqrstuvwxyz", "0123456789"

    def change(c: Column, i: Column) -> Column:
        def new(n: Column) -> Column:
            out = F.when(c.rlike("[0-9]"), _pick(digit, n)).when(c.rlike(r"\p{Ll}"), _pick(lower, n)).when(c.rlike(r"\p{Lu}"), _pick(lower.upper(), n)).otherwise(c)
            return out if hexadecimal is None else F.when(hexadecimal & c.rlike("[0-9a-f]"), _pick(digit + "abcdef", n)).otherwise(out)

        return let(_draw(stream, i), new)

    return _chars(s, change)


def _numbers(s: Column, stream: Column, fixed: Column) -> Column:
    """Digits for digits, counted from the end; the ``fixed`` first characters stay."""

    def change(c: Column, i: Column) -> Column:
        # No leading zero or one where a subscriber number begins.
        new = lambda left: F.when((left == 10) & (c > "1"), _pick("23456789", _draw(stream, left))).otherwise(_pick("0123456789", _draw(stream, left)))
        return F.when((i > fixed) & c.rlike("[0-9]"), let(F.length(_digits(F.substring(s, i, F.length(s)))), new)).otherwise(c)

    return _chars(s, change)


def _luhn(d: Column) -> Column:
    """Luhn sum modulo 10 of a string of digits."""
    values = F.transform(F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1))), lambda i: F.substring(d, -i, F.lit(1)).cast("int") * F.when(F.pmod(i, F.lit(2)) == 0, 2).otherwise(1))
    return F.pmod(F.aggregate(values, F.lit(0), lambda t, v: t + F.when(v > 9, v - 9).otherwise(v)), F.lit(10))


def _iban(s: Column, canon: Column, stream: Column) -> Column:
    """The country stays, letters and digits are drawn for their like, the check number fits, and spaces stand where they stood."""
    body = _like(F.substring(canon, F.lit(5), F.length(canon)), stream)
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)

    def checked(made: Column) -> Column:
        turned = F.filter(F.split(F.concat(F.upper(made), F.substring(canon, 1, 2), F.lit("00")), ""), lambda c: c != "")
        rest = F.aggregate(turned, F.lit(0), lambda t, c: F.pmod(t * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c), F.lit(97)))
        return F.concat(F.substring(canon, 1, 2), F.lpad((98 - rest).cast("string"), 2, "0"), made)

    spaced = lambda made: _chars(s, lambda c, i: F.when(c == " ", c).otherwise(F.substring(made, F.length(F.regexp_replace(F.substring(s, F.lit(1), i), " ", "")), F.lit(1))))
    return let(let(body, checked), spaced)


def _card(s: Column, stream: Column) -> Column:
    """Digits after the first; the last one keeps a valid number valid."""

    def valid(made: Column) -> Column:
        head = F.substring(made, F.lit(1), F.length(made) - 1)
        fitting = F.filter(F.sequence(F.lit(0), F.lit(9)), lambda x: _luhn(F.concat(_digits(head), x.cast("string"))) == 0)
        return F.when(_luhn(_digits(s)) == 0, F.concat(head, F.element_at(fitting, 1).cast("string"))).otherwise(made)

    return let(_numbers(s, stream, F.lit(1)), valid)


def _ip(stream: Column) -> Column:
    first = F.pmod(_draw(stream, F.lit(1)), F.lit(199)) + 11
    rest = [F.pmod(_draw(stream, F.lit(i)), F.lit(254)) + 1 for i in (2, 3, 4)]
    return F.concat_ws(".", F.when(first == 127, F.lit(210)).otherwise(first).cast("string"), *(x.cast("string") for x in rest))


def _name(kind: Column, stream: Column, attempt: Column) -> Column:
    """A made-up name with the ending of its script and gender; longer at each attempt."""
    some = F.when(kind.endswith("cyrillic"), _words("cyrillic")).when(kind.endswith("greek"), _words("greek")).otherwise(_words("latin"))
    stem = let(some, lambda words: F.array_join(F.transform(F.sequence(F.lit(1), F.lit(2) + F.least(attempt, F.lit(20))), lambda i: F.element_at(words, F.pmod(_draw(stream, i), F.size(words)) + 1)), ""))
    end = F.lit("")
    for script, ends in _ENDINGS.items():
        own = F.when(kind.startswith("last:"), ends["last"]).when(kind.startswith("given:f"), ends["f"]).when(kind.startswith("given:m"), ends["m"]).otherwise(ends["n"])
        end = F.when(kind.endswith(script), own).otherwise(end)
    return F.initcap(F.concat(stem, end))


def _words(script: str) -> Column:
    return F.array(*map(F.lit, _SYLLABLES[script]))


def _email(spelling: Column, stream: Column, key: str) -> Column:
    """The same domain has the same surrogate in all addresses; its ending stays."""
    local, domain = F.substring_index(spelling, "@", 1), F.substring_index(spelling, "@", -1)
    name = F.regexp_replace(domain, r"\.[A-Za-z]+$", "")
    named = let(_stream(key, F.lit("domain"), F.lower(domain), F.lit(0)), lambda own: _like(name, own))
    return F.concat(_like(local, stream), F.lit("@"), named, F.substring(domain, F.length(name) + 1, F.length(domain)))


def unit_surrogate(kind: Column, spelling: Column, canon: Column, attempt: Column, key: str) -> Column:
    """Surrogate of one unit in the format of a spelling of it."""

    def made(stream: Column) -> Column:
        abroad = F.regexp_replace(spelling, "^00", "+")
        country = F.when(abroad.startswith("+"), F.length(F.regexp_extract(abroad, _COUNTRY, 1)) + 1 + F.length(spelling) - F.length(abroad)).when(spelling.startswith("0"), 1).otherwise(0)
        lead = F.regexp_extract(spelling, r"^(AKIA|gh[pousr]_|sk-|eyJ)?", 1)
        name = _name(kind, stream, attempt)
        return (
            F.when(attempt < 0, F.concat(F.lit("["), F.substring_index(kind, ":", 1), F.lit("-"), F.left(stream, F.lit(16)), F.lit("]")))
            # Of very long keys only the length is kept.
            .when(kind.isin("key", "secret") & (F.length(spelling) > LONG), F.left(F.repeat(stream, (F.length(spelling) / 256).cast("int") + 1), F.length(spelling)))
            .when(kind == "email", _email(spelling, stream, key))
            .when((kind == "ip") & F.contains(spelling, F.lit(":")), F.when(spelling.rlike("[A-F]"), F.upper(_like(canon, stream, F.lit(True)))).otherwise(_like(canon, stream, F.lit(True))))
            .when(kind == "ip", _ip(stream))
            .when(kind == "phone", _numbers(spelling, stream, country))
            .when(kind == "ssn", _numbers(spelling, stream, F.lit(0)))
            .when(kind == "card", _card(spelling, stream))
            .when(kind == "iban", _iban(spelling, canon, stream))
            .when(kind == "key", F.concat(lead, _like(F.substring(spelling, F.length(lead) + 1, F.length(spelling)), stream)))
            .when(kind == "secret", _like(spelling, stream, spelling.rlike("^[0-9a-f]+$")))
            .when((F.length(spelling) > 1) & (spelling == F.upper(spelling)), F.upper(name))
            .otherwise(name)
        )

    return let(_stream(key, kind, canon, attempt), made)


def surrogate(entity: Column, attempt_of, key: str) -> Column:
    """What stands for an entity; ``attempt_of(kind, canon)`` is the number of the attempt that a unit has."""
    one = lambda u: F.when(u["kind"] == "", u["part"]).otherwise(let(attempt_of(u["kind"], u["canon"]), lambda n: unit_surrogate(u["kind"], u["part"], u["canon"], n, key)))
    return F.concat(entity["head"], F.array_join(F.transform(entity["units"], one), " "))


def attempts(found: DataFrame, key: str, rounds: int = 50) -> DataFrame:
    """(kind, canon, attempt) for units that need more than attempt 0; ``found`` has each (kind, canon) once."""
    made = F.lower(unit_surrogate(F.col("kind"), F.col("canon"), F.col("canon"), F.col("attempt"), key))
    table = materialise(found.withColumn("attempt", F.lit(0)).withColumn("new", made))
    originals = table.select("kind", F.lower("canon").alias("new")).distinct().withColumn("taken", F.lit(True))
    for _ in range(rounds):
        # Of the units with one surrogate, the one that has had it longest keeps it.
        keeper = table.groupBy("kind", "new").agg(F.min_by("canon", F.struct("attempt", "canon")).alias("keeper"), F.count("*").alias("n")).where("n > 1").drop("n")
        checked = table.join(keeper, ["kind", "new"], "left").join(originals, ["kind", "new"], "left")
        loses = F.coalesce(F.col("keeper") != F.col("canon"), F.lit(False)) | F.coalesce("taken", F.lit(False))
        checked = materialise(checked.select("kind", "canon", "attempt", "new", loses.alias("loses")))
        if checked.where("loses").isEmpty():
            return table.where("attempt > 0").select("kind", "canon", "attempt")
        again = checked.where("loses").select("kind", "canon", (F.col("attempt") + 1).alias("attempt")).withColumn("new", made)
        table = materialise(checked.where("not loses").drop("loses").unionByName(again))
    # The formats of some type have too few values for its units: what still loses gets marks.
    left = checked.select("kind", "canon", F.when(F.col("loses"), F.lit(-1)).otherwise(F.col("attempt")).alias("attempt"))
    return left.where("attempt <> 0")


def pseudonymise(docs: DataFrame, key: str, max_inline: int = 1000, rounds: int = 50, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with surrogates in ``text_col``, and pii_types: the type of each entity in the order of the text."""
    text = F.col(text_col)
    found = docs.where(text.rlike(HINT)).select(entities(_every_other(taken_apart(text), 1)).alias("all")).select(F.explode("all").alias("e")).select(F.explode("e.units").alias("u")).where("u.kind != ''")
    again = materialise(attempts(found.select("u.kind", "u.canon").distinct(), key, rounds))
    rows = again.limit(max_inline + 1).collect()
    join = lambda kind, canon: F.concat_ws("\x1f", kind, canon)
    if not rows:
        return _rewrite(docs, text_col, lambda kind, canon: F.lit(0), key)
    if len(rows) <= max_inline:
        known = F.create_map(*(x for r in rows for x in (F.lit(f"{r.kind}\x1f{r.canon}"), F.lit(r.attempt))))
        return _rewrite(docs, text_col, lambda kind, canon: F.coalesce(F.element_at(known, join(kind, canon)), F.lit(0)), key)
    # Too many to write down: rows that hold one bring it along. Equal texts share their list.
    mark, own = _free(docs, "pii_text"), _free(docs, "pii_attempts")
    held = docs.where(text.rlike(HINT)).select(F.xxhash64(text).alias(mark), F.explode(entities(_every_other(taken_apart(text), 1))).alias("e")).select(mark, F.explode("e.units").alias("u")).where("u.kind != ''").select(mark, "u.kind", "u.canon").distinct()
    lists = held.join(again, ["kind", "canon"]).groupBy(mark).agg(F.map_from_entries(F.collect_list(F.struct(join(F.col("kind"), F.col("canon")), "attempt"))).alias(own))
    joined = docs.withColumn(mark, F.xxhash64(text)).join(lists, mark, "left")
    return _rewrite(joined, text_col, lambda kind, canon: F.coalesce(F.element_at(F.col(own), join(kind, canon)), F.lit(0)), key).drop(mark, own)


def _free(docs: DataFrame, name: str) -> str:
    """A name that no column has."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


#: Where a word of its own begins, ends (a genitive's s may follow), and where a sentence begins.
_BEGIN, _END = r"(?<![\p{L}\p{N}'’-])", r"(?!['’]\p{L}{2})(?=s?(?![\p{L}\p{N}]))"
_INSIDE = r"(?<![.!?:;…][\s\"“„»]{1,3})(?<![\n\"“„»])(?<!\A\s{0,3})"


def _spellings(unit: Column, new: Column) -> Column:
    """Ways to write a name and what stands for each: as it is, in capitals, with one capital, and in small letters; and where: anywhere (0), inside a sentence or before a family name (1), only before a family name (2)."""
    part, plain = unit["part"], ~unit["canon"].isin(_COMMON)
    given = unit["kind"].startswith("given:")
    row = lambda change, where: F.struct(F.when(given, 0).otherwise(1).alias("order"), (-F.length(part)).alias("n"), where.alias("where"), change(part).alias("part"), change(new).alias("new"))
    tall = F.when(plain, 0).otherwise(1)
    some = F.array(row(lambda x: x, tall), row(F.upper, tall), row(F.initcap, tall))
    return F.when(given, F.concat(some, F.array(row(F.lower, F.lit(2))))).when(plain, F.concat(some, F.array(row(F.lower, F.lit(0))))).otherwise(some)


def _bare(gap: Column, names: Column) -> Column:
    """A gap with the names that the document has elsewhere replaced, where they stand as words of their own."""
    families = F.concat(F.lit("(?= (?:"), F.array_join(F.transform(F.filter(names, lambda n: n["order"] == 1), lambda n: F.concat(F.lit(r"\Q"), n["part"], F.lit(r"\E"))), "|"), F.lit(r")(?!\p{L}))"))

    def replaced(t: Column, n: Column) -> Column:
        word = F.concat(F.lit(r"\Q"), n["part"], F.lit(r"\E"))
        before = F.concat(word, families)
        form = F.when(n["where"] == 0, word).when(n["where"] == 2, before).when(n["order"] == 0, F.concat(F.lit("(?:"), before, F.lit(f"|{_INSIDE}"), word, F.lit(")"))).otherwise(F.concat(F.lit(_INSIDE), word))
        return F.when(F.contains(t, n["part"]), F.regexp_replace(t, F.concat(F.lit(_BEGIN), form, F.lit(_END)), n["new"])).otherwise(t)

    return F.aggregate(names, gap, replaced)


def _rewrite(docs: DataFrame, text_col: str, attempt_of, key: str) -> DataFrame:
    text, types = F.col(text_col), _free(docs, "pii_types")
    parts, found = _free(docs, "pii_parts"), _free(docs, "pii_found")
    columns = docs.columns
    docs = docs.withColumn(parts, taken_apart(text))
    docs = docs.withColumn(found, F.when(F.size(parts) > 1, entities(_every_other(F.col(parts), 1))).otherwise(F.array().cast(f"array<struct<kind:string,head:string,units:array<{_UNIT}>>>")))
    # Names and their surrogates, each spelling once; given names first, and longer ones.
    persons = F.filter(F.flatten(F.transform(F.filter(F.col(found), lambda e: e["kind"] == "person"), lambda e: e["units"])), lambda u: u["kind"] != "")
    named = lambda u: let(let(attempt_of(u["kind"], u["canon"]), lambda n: unit_surrogate(u["kind"], u["part"], u["canon"], n, key)), lambda new: _spellings(u, new))
    names = F.array_sort(F.array_distinct(F.flatten(F.transform(F.array_distinct(persons), named))))

    def written(all_names: Column) -> Column:
        gaps = F.transform(_every_other(F.col(parts), 0), lambda g: F.when(F.size(all_names) > 0, _bare(g, all_names)).otherwise(g))
        return F.array_join(F.zip_with(gaps, F.transform(F.col(found), lambda e: surrogate(e, attempt_of, key)), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")

    new = F.when(F.size(parts) > 1, let(names, written)).otherwise(text)
    return docs.select(*(new.alias(c) if c == text_col else F.col(f"`{c}`") for c in columns), F.filter(F.col(found)["kind"], lambda k: k != "none").alias(types))
