"""Text expressions: visible page text, redaction, JSON arrays, UTC times."""
from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from massloom import fixed
from massloom.functions.numeric import col

HIDDEN = ("script", "style", "noscript")
BREAK = "\u0001"


def _entity_map() -> Column:
    """Names of the HTML standard, as the Python library lists them, to their characters."""
    return F.from_json(F.lit(json.dumps({k: v for k, v in html5.items() if k.endswith(";")})), "map<string,string>")


def _old_names() -> dict[str, str]:
    return {k: v for k, v in html5.items() if not k.endswith(";")}


def decode_entities(text: Column) -> Column:
    """Character references replaced once, numeric and named, as browsers read them.

    Numbers outside Unicode or for surrogates become U+FFFD, 128 to 159 are read
    as Windows-1252. Names of old standards need no semicolon.
    """
    old = sorted(_old_names(), key=lambda k: (-len(k), k))
    pattern = "&(?:#[xX][0-9a-fA-F]+;?|#[0-9]+;?|[A-Za-z][A-Za-z0-9]*;|(?:" + "|".join(old) + "))"
    old_map = F.create_map(*[F.lit(x) for kv in _old_names().items() for x in kv])
    high = F.create_map(*[F.lit(x) for k in range(128, 160) for x in (k, bytes([k]).decode("cp1252", "ignore") or chr(k))])

    def one(m: Column) -> Column:
        body = F.substr(m, F.lit(2))
        digits = F.regexp_extract(body, "^#[xX]?([0-9a-fA-F]+)", 1)
        hexed = body.rlike("^#[xX]")
        code = F.when(F.length(F.ltrim(digits, F.lit("0"))) > 8, F.lit(2**31)).when(hexed, F.conv(digits, 16, 10).cast("long")).otherwise(F.conv(digits, 10, 10).cast("long"))
        bad = (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        number = F.when(bad, "\ufffd").when(code.between(128, 159), F.try_element_at(high, code.cast("int"))).otherwise(char)
        prefix = F.regexp_extract(body, "^(" + "|".join(old) + ")", 1)
        named = F.coalesce(F.try_element_at(_entity_map(), body),
                           F.when(prefix != "", F.concat(F.try_element_at(old_map, prefix), F.substr(body, F.length(prefix) + 1))))
        return F.coalesce(F.when(body.startswith("#"), number).otherwise(named), m)

    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), one)
    gaps = F.split(text, pattern, -1)
    joined = F.array_join(F.zip_with(gaps, F.concat(found, F.array(F.lit(""))), lambda g, x: F.concat(g, x)), "")
    return F.when(text.rlike(pattern), joined).otherwise(text)


def visible_text(html: Column | str) -> Column:
    """Text nodes outside script/style/noscript, trimmed and joined by newlines."""
    t = col(html)
    for tag in HIDDEN:
        t = F.regexp_replace(t, rf"(?is)<{tag}\b[^>]*>.*?(?:</{tag}\s*>|\z)", BREAK)
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", BREAK)
    t = F.regexp_replace(t, r"<[!/?A-Za-z][^>]*>", BREAK)
    nodes = F.transform(F.split(t, BREAK), lambda x: F.regexp_replace(decode_entities(x), r"^[\s\x{a0}]+|[\s\x{a0}]+$", ""))
    return F.array_join(F.filter(nodes, lambda x: x != ""), "\n")


def redact(text: Column | str, secrets: tuple[str, ...] = ()) -> Column:
    """Known token values and the key pattern replaced, over the whole text."""
    t = col(text)
    for s in secrets:
        if s:
            t = F.replace(t, F.lit(s), F.lit(fixed.REDACTED))
    return F.regexp_replace(t, fixed.SECRET_PATTERN, fixed.REDACTED)


def decode_array(text: Column | str) -> Column:
    """JSON text -> array<double>."""
    return F.from_json(col(text), "array<double>")


def parse_utc(text: Column | str) -> Column:
    """ISO text -> timestamp, naive meaning UTC; text that is not a time fails the job."""
    t = F.trim(col(text))
    zoned = F.when(t.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), t).otherwise(F.concat(t, F.lit("Z")))
    ts = F.try_to_timestamp(zoned)
    return F.when(col(text).isNotNull() & ts.isNull(),
                  F.raise_error(F.concat(F.lit("unrecognised timestamp: "), t)).cast("timestamp")).otherwise(ts)


def epoch_micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a zone-free timestamp, whatever the session zone."""
    t = col(ts)
    seconds = F.unix_date(t.cast("date")).cast("bigint") * 86400 + F.hour(t) * 3600 + F.minute(t) * 60
    return seconds * 1000000 + (F.extract(F.lit("SECOND"), t) * 1000000).cast("bigint")


def is_target_instrument(name: Column | str) -> Column:
    """Name contains 'timstof', blanks and case ignored."""
    return F.coalesce(F.lower(F.replace(col(name), F.lit(" "), F.lit(""))).contains("timstof"), F.lit(False))


def is_bruker(name: Column | str) -> Column:
    return F.coalesce(F.lower(col(name)).contains("bruker"), F.lit(False))
