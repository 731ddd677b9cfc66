"""Chat formatting by schema fingerprints, with DataFrame functions only.

A row's fingerprint is the hash of the sorted nested field paths that it fills: a path
through a list is filled if one of the list's elements fills it. Each layout of LAYOUTS is a
declarative mapping: the paths it needs, those it may have, and where its turns come
from; the fingerprint selects the mapping. Tables of different layouts can be united
(missing columns null) or read from JSON with ``RECORD_SCHEMA``; each row is converted by its
own mapping into canonical turns.

The template writes ``<turn>role\\ntext</turn>\\n`` for each turn. Inside roles and
texts control strings are escaped reversibly: ``\\`` as ``\\b``, ``<turn>`` and
``</turn>`` with ``\\c`` for their ``<``, ``### `` with ``\\h`` for its first ``#``,
and a line break in a role as ``\\n``. Literal control strings never occur in
escaped text, so splitting at them reads the turns back.

Defined cases: null text and null role are empty; a row whose fingerprint no
layout has gets layout null, no turns and its record as JSON in ``unmapped``; equal turn
numbers are ordered by role and text, null numbers come first; a null conversation id is one
conversation; rows that repeat are turns of their own; texts of any length are kept whole; an
empty table gives no rows; fingerprint, layout, turns, unmapped, formatted and loss_mask replace
columns of these names, all other columns stay. A conversation is one row, so its turns have to fit a task.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiform.llm.common import let, prefix_sums

#: Read heterogeneous JSON records with this schema.
RECORD_SCHEMA = (
    "messages array<struct<role:string,content:string>>, conversations array<struct<`from`:string,value:string>>, "
    "turns array<struct<turn:long,role:string,text:string>>, system string, instruction string, input string, output string, "
    "prompt string, completion string, question string, answer string"
)
#: needs, may: field paths; turns: (role, source) pairs, or the list and its role and text fields.
LAYOUTS = [
    {"name": "messages", "needs": ["messages[].role"], "may": ["messages[].content"], "list": ("messages", "role", "content")},
    {"name": "conversations", "needs": ["conversations[].from"], "may": ["conversations[].value"], "list": ("conversations", "from", "value")},
    {"name": "turns", "needs": ["turns[].role", "turns[].text"], "may": ["turns[].turn"], "list": ("turns", "role", "text")},
    {"name": "instruction", "needs": ["instruction", "output"], "may": ["input", "system"], "turns": [("system", ["system"]), ("user", ["instruction", "input"]), ("assistant", ["output"])]},
    {"name": "prompt", "needs": ["prompt", "completion"], "may": ["system"], "turns": [("system", ["system"]), ("user", ["prompt"]), ("assistant", ["completion"])]},
    {"name": "question", "needs": ["question", "answer"], "may": ["system"], "turns": [("system", ["system"]), ("user", ["question"]), ("assistant", ["answer"])]},
]
#: Role names of the conversations layout.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "chatbot": "assistant", "model": "assistant"}
OPEN, CLOSE = "<turn>", "</turn>\n"
TURNS = "array<struct<role:string,text:string>>"


def field_paths(schema: T.StructType) -> list[tuple[str, Callable]]:
    """(path, whether a value of the schema fills it) of all leaf fields, by a function of the value; lists add []."""
    found = []

    def inner(get: Callable, test: Callable) -> Callable:
        return lambda value: test(get(value))

    def some(get: Callable, test: Callable) -> Callable:
        return lambda value: F.coalesce(F.exists(get(value), test), F.lit(False))

    for f in schema.fields:
        kind, path, get, wrap = f.dataType, f.name, (lambda value, name=f.name: value[name]), inner
        if isinstance(kind, T.ArrayType):
            kind, path, wrap = kind.elementType, f"{path}[]", some
        leaves = field_paths(kind) if isinstance(kind, T.StructType) else [("", lambda value: value.isNotNull())]
        found += [(f"{path}.{p}" if p else path, wrap(get, test)) for p, test in leaves]
    return found


def _digest(paths: list[str]) -> Column:
    return F.sha2(F.lit("\n".join(sorted(paths))), 256)


def fingerprint(records: DataFrame, columns: list[str]) -> Column:
    """sha256 of the sorted nested field paths that a row fills, of the given columns."""
    own = {c: F.col(f"`{c}`") for c in columns}
    paths = sorted(field_paths(T.StructType([f for f in records.schema.fields if f.name in own])), key=lambda x: x[0])
    return F.sha2(F.array_join(F.filter(F.array(*(F.when(test(own), F.lit(p)) for p, test in paths)), lambda p: p.isNotNull()), "\n"), 256)


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _turns_of(layout: dict, have: set[str]) -> Column:
    if "list" in layout:
        column, role, text = layout["list"]
        items = F.array_sort(F.col(column)) if layout["name"] == "turns" else F.col(column)
        names = F.create_map(*(F.lit(x) for pair in ROLE_NAMES.items() for x in pair))
        known = (lambda r: F.coalesce(F.try_element_at(names, F.lower(r)), r)) if layout["name"] == "conversations" else (lambda r: r)
        return F.transform(items, lambda m: _turn(known(m[role]), m[text]))
    parts = []
    for role, sources in layout["turns"]:
        if held := [c for c in sources if c in have]:
            text = F.array_join(F.filter(F.array(*(F.col(c) for c in held)), lambda x: x.isNotNull() & (x != "")), "\n\n")
            there = F.coalesce(*(F.col(c) for c in held)).isNotNull()
            parts.append(F.when(there, _turn(F.lit(role), text)))
    return F.filter(F.array(*parts), lambda t: t.isNotNull())


def canonical_turns(records: DataFrame) -> DataFrame:
    """records with fingerprint, layout and turns; the columns of RECORD_SCHEMA that it has are looked at."""
    named = set(T.StructType.fromDDL(RECORD_SCHEMA).fieldNames())
    have = [c for c in records.columns if c in named]
    print_ = fingerprint(records, have) if have else F.sha2(F.lit(""), 256)
    out = records.withColumn("fingerprint", print_)
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for x in LAYOUTS:
        if not {p.split("[")[0] for p in x["needs"]} <= set(have):
            continue
        prints = [_digest([*x["needs"], *more]) for n in range(len(x["may"]) + 1) for more in combinations(x["may"], n)]
        hit = F.col("fingerprint").isin(prints)
        layout, turns = F.when(hit, F.lit(x["name"])).otherwise(layout), F.when(hit, _turns_of(x, set(have))).otherwise(turns)
    raw = F.to_json(F.struct(*have)) if have else F.lit("{}")
    out = out.withColumn("layout", layout).withColumn("unmapped", F.when(F.col("layout").isNull(), raw))
    return out.withColumn("turns", F.coalesce(turns, F.array().cast(TURNS)))


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\b"))
    text = F.replace(F.replace(text, F.lit("<turn>"), F.lit("\\cturn>")), F.lit("</turn>"), F.lit("\\c/turn>"))
    return F.replace(text, F.lit("### "), F.lit("\\h## "))


def unescape(text: Column) -> Column:
    for code, char in (("\\c", "<"), ("\\h", "#"), ("\\n", "\n"), ("\\b", "\\")):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def format_chats(records: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """canonical_turns with ``formatted`` and ``loss_mask`` (spans of code points, end exclusive, of the texts of loss_roles)."""
    out = canonical_turns(records)
    head = lambda t: F.concat(F.lit(OPEN), F.replace(escape(t["role"]), F.lit("\n"), F.lit("\\n")), F.lit("\n"))
    parts = F.transform("turns", lambda t: F.struct(head(t).alias("head"), escape(t["text"]).alias("body"), t["role"].isin(*loss_roles).alias("loss")))

    def chat(p: Column) -> Column:
        starts = prefix_sums(F.transform(p, lambda t: (F.length(t["head"]) + F.length(t["body"]) + len(CLOSE)).cast("bigint")))
        bodies = F.zip_with(p, starts, lambda t, at: F.struct((at + F.length(t["head"])).alias("start"), (at + F.length(t["head"]) + F.length(t["body"])).alias("end"), t["loss"].alias("loss")))
        mask = F.transform(F.filter(bodies, lambda s: s["loss"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
        return F.struct(F.array_join(F.transform(p, lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "").alias("formatted"), mask.alias("loss_mask"))

    out = out.withColumn("_lexiform_chat", let(parts, chat))
    return out.withColumn("formatted", F.col("_lexiform_chat.formatted")).withColumn("loss_mask", F.col("_lexiform_chat.loss_mask")).drop("_lexiform_chat")


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text."""
    pieces = F.filter(F.split(formatted, CLOSE), lambda p: p != "")
    return F.transform(pieces, lambda p: F.struct(unescape(F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), "\n", 1)).alias("role"), unescape(F.substr(p, F.locate("\n", p) + 1)).alias("text")))


def conversation_records(rows: DataFrame) -> DataFrame:
    """Rows by turn (conv_id, turn, role, text) as one record of the turns layout each."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.groupBy("conv_id").agg(F.collect_list(turn).alias("turns"))


def dealt_layouts(records: DataFrame) -> DataFrame:
    """Records of the turns layout, dealt over layouts by conv_id: each in a layout that can hold it and give it back."""
    ordered, pick = F.array_sort("turns"), F.coalesce(F.pmod("conv_id", F.lit(4)), F.lit(-1))
    roles = F.transform(ordered, lambda t: t["role"])
    same = lambda *names: roles == F.array(*map(F.lit, names))
    told = ~F.exists(roles, lambda r: F.lower(r).isin(*ROLE_NAMES))
    pair, triple = same("user", "assistant"), same("system", "user", "assistant")
    kind = F.when(pair & (pick == 0), "prompt").when(pair & (pick == 1), "question").when(triple & pick.isin(0, 1), "instruction").when(pick == 2, "messages").when((pick == 3) & told, "conversations").otherwise("turns")
    said = lambda name, i: F.when(F.col("kind") == name, F.get(F.transform(F.array_sort("turns"), lambda t: t["text"]), F.lit(i)))
    names = {"user": "human", "assistant": "gpt"}
    other = lambda r: F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in names.items() for x in p)), r), r)
    out = records.select("conv_id", "turns", kind.alias("kind"))
    return out.select(
        "conv_id",
        F.when(F.col("kind") == "messages", F.transform(ordered, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))).alias("messages"),
        F.when(F.col("kind") == "conversations", F.transform(ordered, lambda t: F.struct(other(t["role"]).alias("from"), t["text"].alias("value")))).alias("conversations"),
        said("instruction", 0).alias("system"), said("instruction", 1).alias("instruction"), said("instruction", 2).alias("output"),
        said("prompt", 0).alias("prompt"), said("prompt", 1).alias("completion"), said("question", 0).alias("question"), said("question", 1).alias("answer"),
        F.when(F.col("kind") == "turns", F.col("turns")).alias("turns"),
    )


def digests(chats: DataFrame) -> DataFrame:
    """What reading the output back gives: from ``formatted`` and ``loss_mask`` alone."""
    back = chats.select("conv_id", "formatted", "loss_mask", read_back(F.col("formatted")).alias("turns"))
    masked = F.array_join(F.transform("loss_mask", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
    back = back.withColumn("loss", masked)
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
