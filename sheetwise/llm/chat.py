"""Chat formatting by schema fingerprint, with DataFrame functions only.

The nested field paths of a layout, in a canonical text, are hashed; the hash selects a declarative
mapping that turns prompt, instruction or message layouts into canonical turns. Turns are then
rendered with a template whose marks cannot occur in a text, because texts are escaped reversibly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Strings that must never stand unescaped inside a text.
CONTROL = (TURN, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_AHEAD = "|".join(sorted({re.escape(c[1:]) for c in CONTROL}))


def _shape(kind: T.DataType, empty: bool = False) -> str:
    """Canonical text of nested field paths, without scalar types; keys in code point order. With empty, that of empty lists."""
    if isinstance(kind, T.StructType):
        inner = (f.name if (s := _shape(f.dataType, empty)) == "" else f"{f.name}: {s}" for f in sorted(kind.fields, key=lambda f: f.name))
        return f"OBJECT<{', '.join(inner)}>"
    if isinstance(kind, T.ArrayType):
        return _NOTHING if empty else f"ARRAY<{_shape(kind.elementType)}>"
    return ""


#: The canonical text of a list without elements.
_NOTHING = "ARRAY<OBJECT<>>"


def fingerprint(schema: T.StructType) -> str:
    """SHA-256 of the canonical paths of a schema."""
    return hashlib.sha256(_shape(schema).encode()).hexdigest()


def _paths(value: Column) -> Column:
    """The canonical text of a variant's nested field paths."""
    schema = F.regexp_replace(F.schema_of_variant(value), "ARRAY<VOID>", _NOTHING)
    schema = F.regexp_replace(schema, r": (?!OBJECT|ARRAY)[A-Z]+(?:\([0-9, ]*\))?", "")
    schema = F.regexp_replace(schema, r"ARRAY<(?!OBJECT|ARRAY)[A-Z]+(?:\([0-9, ]*\))?>", "ARRAY<>")
    return F.regexp_replace(schema, r"^(?!OBJECT|ARRAY)[A-Z]+(?:\([0-9, ]*\))?$", "")


def json_fingerprint(raw: Column | str) -> Column:
    """The same hash for each JSON document of a string column; null for what is no JSON object."""
    paths = _paths(F.try_parse_json(raw))
    return F.when(paths.startswith("OBJECT"), F.sha2(paths.cast("binary"), 256))


@dataclass(frozen=True)
class Layout:
    """A declarative mapping: the layout's schema, and its turns as SQL with {p} before each field."""

    name: str
    ddl: str
    turns: str

    @property
    def schema(self) -> T.StructType:
        return T._parse_datatype_string(self.ddl)

    @property
    def key(self) -> str:
        return fingerprint(self.schema)

    @property
    def keys(self) -> tuple[str, str]:
        """The fingerprints of the layout and of the layout with empty lists."""
        return self.key, hashlib.sha256(_shape(self.schema, empty=True).encode()).hexdigest()


def _pair(user: str, assistant: str) -> str:
    return f"array(struct('user' AS role, {user} AS text), struct('assistant' AS role, {assistant} AS text))"


_FROM = "CASE m.`from` WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE m.`from` END"
_MESSAGES = "transform({p}messages, m -> struct(m.role AS role, m.content AS text))"
LAYOUTS = (
    Layout("messages", "messages array<struct<role:string,content:string>>", _MESSAGES),
    Layout("named_messages", "messages array<struct<role:string,content:string,name:string>>", _MESSAGES),
    Layout("from_value", "conversations array<struct<`from`:string,value:string>>", f"transform({{p}}conversations, m -> struct({_FROM} AS role, m.value AS text))"),
    Layout("prompt_completion", "prompt string, completion string", _pair("{p}prompt", "{p}completion")),
    Layout("prompt_response", "prompt string, response string", _pair("{p}prompt", "{p}response")),
    Layout("system_prompt_response", "system string, prompt string, response string", "concat(array(struct('system' AS role, {p}system AS text)), " + _pair("{p}prompt", "{p}response") + ")"),
    Layout("question_answer", "question string, answer string", _pair("{p}question", "{p}answer")),
    Layout("instruction", "instruction string, output string", _pair("{p}instruction", "{p}output")),
    Layout("instruction_input", "instruction string, input string, output string", _pair("concat_ws('\\n\\n', {p}instruction, nullif({p}input, ''))", "{p}output")),
)
#: Rows by turn: gathered by conversation before the mapping applies.
TURN_ROWS = Layout("turn_rows", "conv_id bigint, turn bigint, role string, text string", "transform({p}turns, t -> struct(t.role AS role, t.text AS text))")


def _clean(turns: Column) -> Column:
    """Null roles and texts as empty; null turns as a turn with both empty."""
    return F.transform(turns, lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))


def turns_from_json(df: DataFrame, raw: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Adds `layout` and `turns` for a column of JSON documents of mixed layouts.

    A document's fingerprint is taken over the fields that a layout names, so further keys beside them do not change the choice;
    of several layouts that fit, the one with most fields wins. Empty lists give no turns. Rows without a mapping stay, with both null.
    """
    df = df.withColumn("_json", F.try_parse_json(F.col(raw)))
    names = sorted({n for x in layouts for n in x.schema.fieldNames()})
    df = df.withColumns({f"_at_{n}": F.when(F.schema_of_variant("_json").startswith("OBJECT"), _paths(F.expr(f"try_variant_get(_json, '$.{n}', 'variant')"))) for n in names})
    name, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role:string,text:string>>")
    for x in sorted(layouts, key=lambda x: (len(x.schema.fieldNames()), x.name)):
        own = [F.concat(F.lit(n), F.when(F.col(f"_at_{n}") == "", F.lit("")).otherwise(F.concat(F.lit(": "), F.col(f"_at_{n}")))) for n in sorted(x.schema.fieldNames())]
        paths = F.concat(F.lit("OBJECT<"), *(c for k, o in enumerate(own) for c in ((F.lit(", "), o) if k else (o,))), F.lit(">"))  # null where a field is missing
        at = F.sha2(paths.cast("binary"), 256).isin(*x.keys)
        # fields are taken from a struct of the layout's own, so clashing columns of df cannot be meant
        df = df.withColumn(f"_{x.name}", F.when(at, F.from_json(F.col(raw), x.schema)))
        name = F.when(at, x.name).otherwise(name)
        turns = F.when(at, F.expr(x.turns.replace("{p}", f"_{x.name}."))).otherwise(turns)
    return df.withColumns({"layout": name, "turns": _clean(turns)}).drop("_json", *(f"_at_{n}" for n in names), *(f"_{x.name}" for x in layouts))


def turns_from_rows(df: DataFrame) -> DataFrame:
    """(conv_id, turns) of rows by turn, ordered by turn, then role and text.

    A conversation is one result row, so its turns meet in one task; conversations are spread by id.
    Null conv_id is a conversation of its own; repeated rows are repeated turns.
    """
    if not {"conv_id", "turn", "role", "text"} <= set(df.columns):
        raise ValueError("rows by turn need conv_id, turn, role and text")
    rows = df.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    gathered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return gathered.select("conv_id", F.lit(TURN_ROWS.name).alias("layout"), _clean(F.expr(TURN_ROWS.turns.replace("{p}", ""))).alias("turns"))


def to_turns(df: DataFrame, raw: str | None = None) -> DataFrame:
    """Canonical turns by fingerprint: of a JSON column, or of the columns of df themselves.

    Extra columns beside a known layout's own do not change the choice: the largest layout whose
    fields df holds wins. No known layout is an error, as it concerns every row.
    """
    if raw:
        return turns_from_json(df, raw)
    known = {x.key: x for x in (TURN_ROWS, *LAYOUTS)}
    layout = known.get(fingerprint(df.schema))
    if layout is None:
        fits = [x for x in known.values() if set(x.schema.fieldNames()) <= set(df.columns) and _shape(T.StructType([df.schema[n] for n in x.schema.fieldNames()])) == _shape(x.schema)]
        if not fits:
            raise ValueError(f"no mapping for {_shape(df.schema)}")
        layout = max(fits, key=lambda x: (len(x.schema.fieldNames()), x.name))
    if layout is TURN_ROWS:
        return turns_from_rows(df)
    return df.withColumns({"layout": F.lit(layout.name), "turns": _clean(F.expr(layout.turns.replace("{p}", "")))})


def escape(text: Column) -> Column:
    """Doubles backslashes, and sets one behind the first character of each control string."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), rf"([<\[])(?={_AHEAD})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """An expression over a value that is computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _before(lengths: Column) -> Column:
    """The sum of the elements before each one, by blocks of the square root of their number: n ** 1.5 steps and no growing array."""
    zero = F.lit(0).cast("long")
    total = lambda xs: F.aggregate(xs, zero, lambda a, x: a + x)

    def by_block(xs: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(xs))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(xs) / width).cast("int") - 1), lambda k: F.slice(xs, k * width + 1, width))
        return _let(blocks, lambda bs: _let(F.transform(bs, total), lambda sums: F.flatten(F.transform(bs, lambda b, k: _let(
            total(F.slice(sums, F.lit(1), k)), lambda base: F.transform(b, lambda _, i: base + total(F.slice(b, F.lit(1), i))))))))

    return _let(lengths, lambda xs: F.when(F.size(xs) > 0, by_block(xs)).otherwise(xs))


def render(df: DataFrame) -> DataFrame:
    """Adds `formatted` and `loss_spans`: [start, end) of each assistant text in code points, [first, last) in UTF-8 bytes, escapes included.

    Columns of df with these names are replaced. Null turns give null.
    """
    parts = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), escape(t["role"]).alias("r"), escape(t["text"]).alias("x")))
    marks, tail = len(TURN) + len(TEXT), len(END) + 1
    sized = F.transform(
        parts,
        lambda p: F.struct(
            F.concat(F.lit(TURN), p["r"], F.lit(TEXT), p["x"], F.lit(END + "\n")).alias("s"),
            (p["role"] == "assistant").alias("loss"),
            *(size(p[c]).cast("long").alias(f"{c}_{unit}") for c in ("r", "x") for size, unit in ((F.length, "points"), (F.octet_length, "bytes"))),
        ),
    )
    made = fresh("_parts", df)
    df = df.withColumn(made, sized)
    whole = lambda unit: F.transform(made, lambda p: p[f"r_{unit}"] + p[f"x_{unit}"] + marks + tail)
    before = {u: fresh(f"_{u}", df) for u in ("points", "bytes")}
    df = df.withColumns({c: _before(whole(u)) for u, c in before.items()})
    each = F.arrays_zip(made, *before.values())

    def span(z: Column) -> Column:
        p = z[made]
        ends = []
        for unit, a, b in (("points", "start", "end"), ("bytes", "first", "last")):
            at = z[before[unit]] + p[f"r_{unit}"] + marks
            ends += [at.alias(a), (at + p[f"x_{unit}"]).alias(b)]
        return F.struct(*ends)

    spans = F.transform(F.filter(each, lambda z: z[made]["loss"]), span)
    return df.withColumns({"formatted": F.array_join(F.transform(made, lambda p: p["s"]), ""), "loss_spans": spans}).drop(made, *before.values())


def parse(formatted: Column) -> Column:
    """The turns of a rendered text, unescaped: the exact inverse of render()."""
    blocks = F.filter(F.split(formatted, re.escape(TURN)), lambda b, i: i > 0)
    return F.transform(
        blocks,
        lambda b: F.struct(
            unescape(F.substring_index(b, TEXT, 1)).alias("role"),
            unescape(F.substring_index(F.substring_index(b, TEXT, -1), END, 1)).alias("text"),
        ),
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order, with nothing between. Bytes are sliced, so a span costs its own length only."""
    cut = lambda raw: F.transform(spans, lambda s: unescape(F.substr(raw, (s["first"] + 1).cast("int"), (s["last"] - s["first"]).cast("int")).cast("string")))
    return _let(formatted.cast("binary"), lambda raw: F.array_join(cut(raw), ""))
