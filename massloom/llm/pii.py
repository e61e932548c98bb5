"""Format-preserving pseudonyms by keyed Feistel permutations, in DataFrame functions.

Validated values are replaced by others of the same format. A value is mapped
by a permutation of its format's whole domain, keyed and without state, so
equal values stay linked across documents and different ones stay apart:

- dates (ISO, dotted, with slashes) between 1900 and 2099 that exist, by day
  number: one day has one pseudonym in all its notations;
- payment card numbers with a valid check digit: the first digit stays, the
  check digit is made anew;
- account numbers (IBAN) with valid check digits: letters stay;
- phone numbers, as (area, exchange, line) where they are North American, else
  behind their first two digits;
- social security numbers in their valid ranges, and IPv4 addresses;
- e-mail addresses: letters and digits before the @.

Values may stand side by side: a number ends where another value begins (a
date, an address, a phone, security or card number), an account number has its
country's length, and where a check digit fails, shorter ends are tried. Only
plain digits after a foreign phone number can't be told from its last group.

Separators, brackets and what surrounds a value stay, so the length of a text
is the same but for dates without leading zeros and IPv4 addresses. A null text
stays null, an empty one empty; repeated rows get the same text. A string that
fails validation is left alone.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massloom.functions.numeric import let  # binds a value, so that a body that names it often computes it once

ROUNDS = 8
FIRST_DAY, DAYS = "1900-01-01", 73_049  # 17 * 4297 days up to 2099-12-31

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Kind: pattern of a value that stands alone. Earlier ones win where two fit.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "iso": r"(?<![\d-])(?:19|20)\d\d-\d\d-\d\d(?![\d-])",
    "slash": r"(?<![\d/])\d{1,2}/\d{1,2}/(?:19|20)\d\d(?![\d/])",
    "dot": r"(?<![\d.])\d{1,2}\.\d{1,2}\.(?:19|20)\d\d(?!\d|\.\d)",
    "phone": r"(?<![\w+])\+\d(?:[ ().-]{0,2}\d){7,14}(?!\d)|(?<![\w(])\(\d{3}\) ?\d{3}-\d{4}(?![\d-])|(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "card": r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)",
}
#: Characters of an account number by country.
_IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_FOURS = r"(?<!\d)\d{4}(?:[ -]\d{4}){3}"
_ALIGNED = rf"{_FOURS}(?:(?:[ -]\d{{4}}){{4}}){{0,16}}(?!\d|[ -]\d{{4}}(?!\d))"  # no group of four is left over behind it
_OTHER_CARDS = rf"(?<!\d)\d{{4}}[ -]\d{{6}}[ -]\d{{4,5}}(?!\d)|(?<!\d)\d{{13,19}}(?!\d)"
_CARDS = rf"{_FOURS}(?!\d)|{_OTHER_CARDS}"
_DATED = "|".join(PATTERNS[k] for k in ("email", "iso", "slash", "dot", "ip"))
_LOCAL = PATTERNS["phone"].split("|", 1)[1]
#: What a number may not run into: other values, and at its end parts of words, times and fractions.
_PLACED = f"{_DATED}|{_LOCAL}|{PATTERNS['ssn']}"
_NEXT = f"{_PLACED}|{_CARDS}"
_END = r"(?![\w%@]|[/:,]\d)"
_COUNTRIES = "|".join(rf"(?:{c.replace(' ', '|')})\d{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in _IBAN_LENGTHS.items())
_DIGIT = rf"(?:\d|[ ().-]{{1,2}}(?!{_DATED})\d)"
_STEP = r"(?:\d|(?! ?\(\d{{3}}\) ?\d{{3}}-\d{{4}}(?![\d-]))[ ().-]{{1,2}}(?!{})\d)"
# A group of four behind eight digits may still be the phone's own, before a card; behind ten it is the card's.
_FOREIGN = rf"(?<![\w+])\+\d{_DIGIT}{{7}}{_STEP.format(f'{_PLACED}|{_ALIGNED}|{_OTHER_CARDS}')}{{0,2}}{_STEP.format(_NEXT)}{{0,5}}"
_LOOSE = rf"(?<!\d)\d(?:\d|[ -](?!{_NEXT})\d){{12,18}}"
#: Kind: pattern of a value in a text, the most certain shape first.
_SCAN = PATTERNS | {
    "iban": rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}\d{{2}})(?:(?:{_COUNTRIES})(?![A-Za-z0-9])|[A-Z]{{2}}\d{{2}}[A-Z0-9]{{11,30}}(?![A-Za-z0-9])"
            rf"|[A-Z]{{2}}\d{{2}}(?:[A-Z0-9]| (?!{_PLACED})[A-Z0-9]){{11,30}}(?![A-Za-z0-9]))",
    "phone": rf"(?<![\w+])\+1{_DIGIT}{{10}}(?!\d)|{_FOREIGN}{_END}|{_FOREIGN}(?!\d)|{_LOCAL}",
    "card": rf"{_FOURS}(?:[ -](?!{_PLACED}|{_OTHER_CARDS})\d{{4}}){{1,3}}(?!\w|[/:.,-]\d|[ -]\d{{4}}(?!\d))|{_FOURS}(?:[ -](?!{_NEXT})\d{{1,3}}(?!\w|[/:.,-]\d))?(?!\d)|{_CARDS}|{_LOOSE}{_END}|{_LOOSE}(?!\d)",
}
PATTERN = "|".join(f"(?:{p})" for p in _SCAN.values())


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, F.lit("[^0-9]"), F.lit(""))


def _word(key: str, *parts: Column) -> Column:
    """52 keyed bits of what is given."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts]), 256), 1, 13), 16, 10).cast("long")


def permute_pair(x: Column, a: int, b: int, key: str) -> Column:
    """A permutation of 0 ... a*b-1: alternating additions in the two parts."""
    def turn(s, i):
        left = (s["l"] + _word(key, i, F.lit("l"), s["r"])) % a
        return let(left, lambda v: F.struct(v.alias("l"), ((s["r"] + _word(key, i, F.lit("r"), v)) % b).alias("r")))

    return let(x.cast("long"), lambda v: F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS // 2)), F.struct(F.floor(v / F.lit(b)).cast("long").alias("l"), (v % b).cast("long").alias("r")),
        turn, lambda s: s["l"] * b + s["r"]))


def _shift(s: Column, mask: Column) -> Column:
    """Every letter and digit moved within its own alphabet by hash bytes."""
    def move(c, by):
        out = c
        for alphabet in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"):
            at = F.position(c, F.lit(alphabet))
            out = F.when((c != "") & (at > 0), F.substr(F.lit(alphabet), (at - 1 + by) % len(alphabet) + 1, F.lit(1))).otherwise(out)
        return out

    def step(h):
        return F.array_join(F.transform(F.split(s, ""), lambda c, j: let(F.conv(F.substr(h, (j * 2) % 60 + 1, F.lit(2)), 16, 10).cast("int"), lambda by: move(c, by))), "")

    return let(mask, step)


def permute_text(s: Column, key: str) -> Column:
    """A permutation of all strings of one shape: two halves shift each other in turn."""
    def turn(x, i):
        mask = F.sha2(F.concat_ws("|", F.lit(key), i.cast("string"), x["r"]), 256)
        return F.struct(x["r"].alias("l"), _shift(x["l"], mask).alias("r"))

    def run(v):
        half = F.floor(F.char_length(v) / 2).cast("int")
        start = F.struct(F.substr(v, F.lit(1), half).alias("l"), F.substr(v, half + 1).alias("r"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda x: F.concat(x["l"], x["r"]))

    return let(s, run)


def _pour(shape: Column, digits: Column) -> Column:
    """``digits`` in the places of the digits of ``shape``."""
    def run(d):
        def step(s, c):
            digit = c.rlike("^[0-9]$")
            return F.struct(F.concat(s["out"], F.when(digit, F.substr(d, s["at"], F.lit(1))).otherwise(c)).alias("out"),
                            (s["at"] + digit.cast("int")).alias("at"))

        return F.aggregate(F.split(shape, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), step, lambda s: s["out"])

    return let(digits, run)


def luhn_sum(digits: Column) -> Column:
    def run(d):
        def step(acc, i):
            x = F.substr(d, F.char_length(d) - i + 1, F.lit(1)).cast("int")
            return acc + let(x, lambda v: F.when(i % 2 == 0, F.when(v > 4, 2 * v - 9).otherwise(2 * v)).otherwise(v))

        return F.aggregate(F.sequence(F.lit(1), F.char_length(d)), F.lit(0), step)

    return let(digits, run)


def _mod97(s: Column) -> Column:
    """Letters count as 10 ... 35."""
    def step(acc, c):
        at = F.position(c, F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")) - 1
        return F.when(c == "", acc).otherwise(F.when(at > 9, acc * 100 + at).otherwise(acc * 10 + at) % 97)

    return F.aggregate(F.split(s, ""), F.lit(0), step)


def _day(year: Column, month: Column, day: Column) -> Column:
    """Day number since 1900, null for a date that doesn't exist."""
    text = F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.date_diff(F.try_to_date(text, "yyyy-MM-dd"), F.lit(FIRST_DAY).cast("date")).cast("long")


def _date(number: Column, key: str) -> Column:
    return F.date_add(F.lit(FIRST_DAY).cast("date"), permute_pair(number, 17, 4297, key + "/date").cast("int"))


def _pseudonyms(m: Column, key: str) -> dict[str, Column]:
    """What a match becomes as a value of each kind; null where it isn't a valid one."""
    d = _digits(m)
    n = F.char_length(d)
    got = {}
    local = F.substring_index(m, "@", 1)
    got["email"] = F.concat(permute_text(local, key + "/email"), F.substr(m, F.char_length(local) + 1))

    plain = F.replace(m, F.lit(" "), F.lit(""))
    body = F.substr(plain, F.lit(5))
    inner = _pour(body, permute_text(_digits(body), key + "/iban"))
    def check(text):
        return F.lpad((98 - _mod97(F.concat(text, F.substr(plain, F.lit(1), F.lit(2)), F.lit("00")))).cast("string"), 2, "0")

    def spread(moved):
        start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
        return F.aggregate(F.split(m, ""), start, lambda s, c: F.struct(
            F.concat(s["out"], F.when(c == " ", c).when(c == "", c).otherwise(F.substr(moved, s["at"], F.lit(1)))).alias("out"),
            (s["at"] + ((c != " ") & (c != "")).cast("int")).alias("at")), lambda s: s["out"])

    spaced = let(let(inner, lambda t: F.concat(F.substr(plain, F.lit(1), F.lit(2)), check(t), t)), spread)
    got["iban"] = F.when(_mod97(F.concat(body, F.substr(plain, F.lit(1), F.lit(4)))) == 1, spaced)

    part = lambda sep, i: F.split_part(m, F.lit(sep), F.lit(i))
    got["iso"] = F.date_format(_date(_day(part("-", 1), part("-", 2), part("-", 3)), key), "yyyy-MM-dd")
    two = lambda i, sep: F.char_length(part(sep, i)) == 2

    def dated(sep: str, day_first: bool):
        a, b = part(sep, 1), part(sep, 2)
        names = ("d", "M") if day_first else ("M", "d")

        def written(new):
            # A leading zero stays where there was one; a number without one is written as short as it can be.
            piece = [F.when(two(i + 1, sep), F.date_format(new, p * 2)).otherwise(F.date_format(new, p)) for i, p in enumerate(names)]
            return F.when(new.isNotNull(), F.concat_ws(sep, *piece, F.date_format(new, "yyyy")))

        return let(_date(_day(part(sep, 3), b if day_first else a, a if day_first else b), key), written)

    got["dot"] = dated(".", True)
    got["slash"] = F.coalesce(dated("/", False), dated("/", True))

    national = F.when((n == 11) & d.startswith("1"), F.substr(d, F.lit(2))).when(~m.startswith("+") & (n == 10), d)
    area, exchange, line = (F.substr(national, F.lit(a), F.lit(k)).cast("long") for a, k in ((1, 3), (4, 3), (7, 4)))
    known = national.isNotNull() & (area >= 200) & (exchange >= 200)
    index = permute_pair(((area - 200) * 800 + exchange - 200) * 10_000 + line, 80_000, 80_000, key + "/phone")
    ours = let(index, lambda v: F.concat((F.floor(v / 8_000_000) + 200).cast("string"), (F.floor(v / 10_000) % 800 + 200).cast("string"),
                                         F.lpad((v % 10_000).cast("string"), 4, "0")))
    kept = n - F.when(known, 10).otherwise(F.greatest(n - 2, F.lit(0)))
    fresh = F.when(known, ours).otherwise(permute_text(F.substr(d, kept + 1), key + "/phone"))
    got["phone"] = F.when(m.startswith("+") | known, _pour(m, F.concat(F.substr(d, F.lit(1), kept), fresh)))

    a, g, s = (F.substr(d, F.lit(i), F.lit(k)).cast("long") for i, k in ((1, 3), (4, 2), (6, 4)))
    valid = (a > 0) & (a != 666) & (a < 900) & (g > 0) & (s > 0)
    x = permute_pair(F.when(a > 666, a - 2).otherwise(a - 1) * 989_901 + (g - 1) * 9_999 + s - 1, 898, 989_901, key + "/ssn")

    def social(v):
        na, rest = F.floor(v / 989_901), v % 989_901
        na = F.when(na >= 665, na + 2).otherwise(na + 1)
        return F.concat_ws("-", F.lpad(na.cast("string"), 3, "0"), F.lpad((F.floor(rest / 9_999) + 1).cast("string"), 2, "0"),
                           F.lpad((rest % 9_999 + 1).cast("string"), 4, "0"))

    got["ssn"] = F.when(valid, let(x, social))

    octets = F.transform(F.split(m, r"\."), lambda o: o.cast("long"))
    packed = F.aggregate(octets, F.lit(0).cast("long"), lambda acc, o: acc * 256 + o)
    got["ip"] = let(permute_pair(packed, 65_536, 65_536, key + "/ip"), lambda y: F.concat_ws(
        ".", *[(F.shiftright(y, k).bitwiseAND(255)).cast("string") for k in (24, 16, 8, 0)]))

    payload = F.concat(F.substr(d, F.lit(1), F.lit(1)), permute_text(F.substr(d, F.lit(2), n - 2), key + "/card"))
    checked = let(payload, lambda v: F.concat(v, ((10 - luhn_sum(F.concat(v, F.lit("0"))) % 10) % 10).cast("string")))
    got["card"] = F.when((n >= 13) & (luhn_sum(d) % 10 == 0) & d.rlike("[1-9]"), _pour(m, checked))

    return got


def _first_valid(candidates: Column, valid) -> Column:
    return F.get(F.filter(candidates, lambda c: (c != "") & valid(c)), F.lit(0))


def _card_in(m: Column) -> Column:
    """The part of a match that is a card number: four fours in up to seven, else the longest start; shorter ones only behind a group of four or more."""
    def ending(k):
        return F.regexp_extract(m, rf"^\d(?:[ -]?\d){{{k - 1}}}(?!\d)", 0)

    n = F.char_length(_digits(m))
    fours = [F.regexp_extract(m, rf"^(?:\d{{4}}[ -]){{{k}}}({_FOURS})(?!\d)", 1) for k in range(4)]
    rest = [F.when((n == k) | m.rlike(r"^\d{4}"), ending(k)).otherwise("") for k in range(19, 12, -1)]
    return _first_valid(F.array(*fours, *rest), lambda c: luhn_sum(_digits(c)) % 10 == 0)


def _iban_in(m: Column) -> Column:
    """The start of a match, in whole words, that is an account number; the longest one."""
    def valid(c):
        plain = F.replace(c, F.lit(" "), F.lit(""))
        return (F.char_length(plain) >= 15) & (_mod97(F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))) == 1)

    words = F.split(m, " ")
    return _first_valid(F.transform(F.sequence(F.size(words), F.lit(1), F.lit(-1)), lambda j: F.array_join(F.slice(words, F.lit(1), j), " ")), valid)


def _replaced(m: Column, key: str) -> Column:
    """(kind, old, new) of one match; old is the part of it that is a value, and new is null where there is none."""
    made = _pseudonyms(m, key)
    out = None
    for kind, pattern in PATTERNS.items():  # the match stands alone here, so its surroundings no longer matter
        hit = m.rlike(rf"^(?:{pattern}|\d{{4}}(?:[ -]\d{{4}}){{4,6}})$" if kind == "card" else f"^(?:{pattern})$")
        value = F.struct(F.lit(kind).alias("kind"), m.alias("old"), made[kind].alias("new"))
        if kind in ("iban", "card"):
            value = let(F.coalesce(_iban_in(m) if kind == "iban" else _card_in(m), m), lambda c, kind=kind: F.struct(
                F.lit(kind).alias("kind"), c.alias("old"), _pseudonyms(c, key)[kind].alias("new")))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``text_col`` rewritten, and ``pseudonyms``: (kind, old, new) of every value found, in order.

    Further columns come through; ones named ``pseudonyms`` or ``__made`` give way.
    """
    text = F.col(f"`{text_col}`")
    found = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    made = F.transform(found, lambda m: F.struct(m.alias("match"), _replaced(m, key).alias("r")))
    made = F.transform(made, lambda x: F.struct(x["match"].alias("match"), x["r"]["kind"].alias("kind"), x["r"]["old"].alias("old"), x["r"]["new"].alias("new")))
    empty = F.array().cast("array<struct<match:string,kind:string,old:string,new:string>>")
    rows = docs.withColumn("__made", F.when(text.rlike("[0-9@]"), made).otherwise(empty))
    gaps = F.split(text, PATTERN, -1)
    at = lambda x: F.position(x["old"], x["match"])
    news = F.transform("__made", lambda x: F.coalesce(F.concat(
        F.substr(x["match"], F.lit(1), at(x) - 1), x["new"], F.substr(x["match"], at(x) + F.char_length(x["old"]))), x["match"]))
    joined = F.array_join(F.zip_with(gaps, F.concat(news, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    rows = rows.withColumn(text_col, F.when(F.size("__made") > 0, joined).otherwise(text))
    values = F.transform(F.filter("__made", lambda x: x["new"].isNotNull()), lambda x: F.struct(x["kind"].alias("kind"), x["old"].alias("old"), x["new"].alias("new")))
    return rows.withColumn("pseudonyms", values).drop("__made")
