"""Chat formatting: heterogeneous layouts to canonical turns, and a reversible template.

A layout is known by the fingerprint of its schema: the sorted nested field
paths, hashed. Fingerprints select declarative mappings, each a list of turn
sources; all work is in DataFrame functions. JSON records are fingerprinted one
by one, through the schema of their variant value; a table with typed columns
is fingerprinted once.

A formatted conversation is ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn.
Control strings inside texts (and roles) get a backslash after their first
character, and one more if they hold one already, so none is left and taking
one away restores the text. Line ends in roles are escaped the same way.

Null texts and roles are empty. Turns are ordered by turn number (null first),
then role and text; repeated rows stay. Rows with a null conversation id form
one conversation. Records of an unknown layout keep a null conversation and
their fingerprint, so they can be counted and mapped; no row is dropped.
"""
from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>"
#: Strings that common chat templates and tokenizers treat as control.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_REST = "|".join("\\Q" + c[1:] + "\\E" for c in CONTROL)
_ESCAPE = rf"([<\[])(\\*)(?={_REST})"
_UNESCAPE = rf"([<\[])\\(\\*)(?={_REST})"

TURN = "array<struct<role:string,text:string>>"
#: Layout name: (field paths, turns). A turn source is (role, path) for one field, or
#: (array path, role field, text field) for a list; role names are read through ROLES.
LAYOUTS = {
    "messages": (("messages[].content", "messages[].role"), [("messages", "role", "content")]),
    "conversations": (("conversations[].from", "conversations[].value"), [("conversations", "from", "value")]),
    "instruction": (("instruction", "output"), [("user", "instruction"), ("assistant", "output")]),
    "instruction_input": (("input", "instruction", "output"), [("user", "instruction", "input"), ("assistant", "output")]),
    "instruction_system": (("input", "instruction", "output", "system"),
                           [("system", "system"), ("user", "instruction", "input"), ("assistant", "output")]),
    "prompt_completion": (("completion", "prompt"), [("user", "prompt"), ("assistant", "completion")]),
    "prompt_response": (("prompt", "response"), [("user", "prompt"), ("assistant", "response")]),
    "question_answer": (("answer", "question"), [("user", "question"), ("assistant", "answer")]),
}
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
LISTS = ("messages", "conversations")


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def field_paths(schema: T.DataType, prefix: str = "") -> list[str]:
    """Paths of the leaves of a typed schema; ``[]`` marks the items of a list."""
    if isinstance(schema, T.StructType):
        return [p for f in schema for p in field_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, prefix + "[]")
    return [prefix]


def _record_paths(v: Column) -> Column:
    """Sorted field paths of a variant record: its keys, and the keys of the objects in its lists."""
    def keys(json: Column) -> Column:
        return F.coalesce(F.json_object_keys(json), F.array())

    def inside(name: str) -> Column:
        items = F.coalesce(F.try_variant_get(v, f"$.{name}", "array<variant>"), F.array().cast("array<variant>"))
        return F.transform(F.flatten(F.transform(items, lambda item: keys(F.to_json(item)))), lambda k: F.concat(F.lit(f"{name}[]."), k))

    top = keys(F.to_json(v))
    listed = [inside(name) for name in LISTS]
    plain = F.filter(top, lambda k: ~k.isin(*LISTS))
    return F.array_sort(F.array_distinct(F.concat(plain, *listed)))


def _role(r: Column) -> Column:
    r = F.coalesce(r, F.lit(""))
    return F.coalesce(F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])[F.lower(r)], r)


def _listed_turns(v: Column, name: str, role: str, text: str) -> Column:
    items = F.coalesce(F.try_variant_get(v, f"$.{name}", "array<variant>"), F.array().cast("array<variant>"))
    return F.transform(items, lambda i: F.struct(_role(F.try_variant_get(i, f"$.{role}", "string")).alias("role"),
                                                 F.coalesce(F.try_variant_get(i, f"$.{text}", "string"), F.lit("")).alias("text")))


def _field_turn(v: Column, role: str, *fields: str) -> Column:
    """One turn of the non-empty fields; an empty system turn is none."""
    texts = F.array(*[F.try_variant_get(v, f"$.{f}", "string") for f in fields])
    joined = F.array_join(F.filter(texts, lambda t: t.isNotNull() & (t != "")), "\n")
    turn = F.array(F.struct(F.lit(role).alias("role"), joined.alias("text")))
    return F.when(joined != "", turn).otherwise(F.array().cast(TURN)) if role == "system" else turn


def _turns_of(layout: str, v: Column) -> Column:
    return F.concat(*[_listed_turns(v, *source) if source[0] in LISTS else _field_turn(v, *source) for source in LAYOUTS[layout][1]])


def canonical_records(df: DataFrame, json_col: str = "record", keep: tuple[str, ...] = ()) -> DataFrame:
    """JSON records of any mix of layouts to (keep..., fingerprint, layout, turns)."""
    v = F.try_parse_json(json_col)
    rows = df.select(*keep, v.alias("__v")).withColumn("fingerprint", F.sha2(F.array_join(_record_paths(F.col("__v")), "\n"), 256))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURN)
    for name, (paths, _) in LAYOUTS.items():
        hit = F.col("fingerprint") == fingerprint(paths)
        layout = F.when(hit, F.lit(name)).otherwise(layout)
        turns = F.when(hit, _turns_of(name, F.col("__v"))).otherwise(turns)
    return rows.select(*keep, "fingerprint", layout.alias("layout"), turns.alias("turns"))


#: Tables with one row per turn: (id, order, role, text) columns by fingerprint.
ROW_LAYOUTS = {
    fingerprint(("conv_id", "turn", "role", "text")): ("conv_id", "turn", "role", "text"),
    fingerprint(("conversation_id", "position", "from", "value")): ("conversation_id", "position", "from", "value"),
    fingerprint(("thread", "index", "role", "content")): ("thread", "index", "role", "content"),
}


def canonical_rows(df: DataFrame, columns: tuple[str, ...] | None = None) -> DataFrame:
    """A table of turns to (conv_id, turns); the layout is chosen by the fingerprint of its schema.

    Fields that no layout has are left out before the fingerprint is taken.
    ``columns`` names id, order, role and text of any other table. Roles stay
    as they are.
    """
    if columns is None:
        own = field_paths(df.schema)
        tried = (fingerprint(p for p in own if p in fields) for fields in ROW_LAYOUTS.values())
        found = next((f for f in (fingerprint(own), *tried) if f in ROW_LAYOUTS), None)
        if found is None:
            raise ValueError(f"no mapping for the fields {sorted(own)}")
        columns = ROW_LAYOUTS[found]
    cid, order, role, text = (F.col(f"`{c}`") for c in columns)
    turn = F.struct(order.cast("long").alias("turn"), F.coalesce(role.cast("string"), F.lit("")).alias("role"),
                    F.coalesce(text.cast("string"), F.lit("")).alias("text"))
    return df.select(cid.cast("long").alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(
        F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_ESCAPE), F.lit(r"$1\\$2"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_UNESCAPE), F.lit("$1$2"))


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def format_turns(df: DataFrame, turns: str = "turns") -> DataFrame:
    """Adds ``formatted`` and ``loss``: spans (start, length) of assistant texts in code points.

    Further columns come through; ones named ``formatted``, ``loss`` or ``__bits`` give way.
    """
    bits = F.transform(turns, lambda t: F.struct(
        F.concat(F.lit(START), _escape_role(t["role"]), F.lit("\n")).alias("head"), escape(t["text"]).alias("body"),
        (t["role"] == "assistant").alias("learn")))
    df = df.withColumn("__bits", bits).withColumn("formatted", F.concat(F.lit(""), F.array_join(
        F.transform("__bits", lambda b: F.concat(b["head"], b["body"], F.lit(END + "\n"))), "")))
    step = len(END) + 1
    walk = F.aggregate("__bits", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
                       lambda acc, b: F.struct(
                           (acc["at"] + F.char_length(b["head"]) + F.char_length(b["body"]) + step).alias("at"),
                           F.when(b["learn"], F.concat(acc["spans"], F.array(F.struct(
                               (acc["at"] + F.char_length(b["head"])).alias("start"), F.char_length(b["body"]).alias("length")))))
                           .otherwise(acc["spans"]).alias("spans")))
    return df.withColumn("loss", walk["spans"]).drop("__bits")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation."""
    pieces = F.split(formatted, "\\Q" + END + "\n\\E")
    pieces = F.filter(pieces, lambda p: p != "")
    body = lambda p: F.substr(p, F.lit(len(START) + 1))
    return F.transform(pieces, lambda p: F.struct(
        _unescape_role(F.substring_index(body(p), "\n", 1)).alias("role"),
        unescape(F.substr(body(p), F.locate("\n", body(p)) + 1)).alias("text")))


def read_loss(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, joined."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"]))), "")
