"""Chat formatting: heterogeneous records to canonical turns, and turns to one marked-up text with a loss mask.

Records are told apart by the fingerprint of their schema: a hash of the nested field paths. A fingerprint selects a
declarative mapping, a set of SQL expressions, that gives the record's turns. A mapping's own fingerprint is the hash of the
paths that it names; of a record or table those paths are hashed that the mapping names too, so further fields do no harm.
Everything is DataFrame expressions; the schema of a table of rows is hashed once, while the plan is made.

Control strings inside texts are escaped reversibly: a backslash goes between ``<`` and ``|`` (one more, if there already
are some), so that ``<|`` in the output is always markup. In roles a backslash is doubled and a line feed is ``\\n``.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

START, END = "<|im_start|>", "<|im_end|>"
TURN = "struct<pos:bigint,role:string,text:string>"


def field_paths(kind: DataType, at: str = "") -> list[str]:
    """Nested field paths: ``a.b`` in structs, ``a[]`` in arrays, ``a{}`` in maps; leaves only."""
    if isinstance(kind, StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, ArrayType):
        return field_paths(kind.elementType, at + "[]")
    if isinstance(kind, MapType):
        return field_paths(kind.valueType, at + "{}")
    return [at]


def fingerprint(paths: Column) -> Column:
    """Hash of an array of field paths, whatever their order."""
    return F.xxhash64(F.array_join(F.array_sort(F.array_distinct(paths)), "\x01"))


def schema_fingerprint(paths: Iterable[str]) -> int:
    """What ``fingerprint`` gives for the same paths, for schemas known without reading a row."""
    code = xxhash.xxh64_intdigest("\x01".join(sorted(set(paths), key=str.encode)).encode(), 42)
    return code - (1 << 64) if code >> 63 else code


def json_paths(record: Column) -> Column:
    """Field paths of a JSON record, two levels deep; null for what isn't a JSON object.

    Arrays are told by their first element, ``a[]:none`` is an empty one. Null values count as leaves, so an optional field
    keeps its path.
    """
    top = F.from_json(record, "map<string,string>")

    def inner(v: Column, k: Column, mark: str) -> Column:
        keys = F.map_keys(F.from_json(v, "map<string,string>"))
        return F.transform(F.coalesce(keys, F.array(F.lit(""))), lambda x: F.concat(k, F.lit(mark), x))

    def below(e: Column) -> Column:
        k, v = e["key"], F.ltrim(e["value"])
        first = F.try_element_at(F.from_json(v, "array<string>"), F.lit(1))
        return (
            F.when(v.startswith("{"), inner(v, k, "."))
            .when(v.startswith("[") & F.ltrim(first).startswith("{"), inner(first, k, "[]."))
            .when(v.rlike(r"^\[\s*\]"), F.array(F.concat(k, F.lit("[]:none"))))
            .when(v.startswith("["), F.array(F.concat(k, F.lit("[]"))))
            .otherwise(F.array(k))
        )

    return F.flatten(F.transform(F.map_entries(top), below))


@dataclass(frozen=True)
class Layout:
    """A record layout: its field paths, and the turns as an SQL expression over the columns.

    Its fingerprint is that of its paths. ``turns`` gives an array of struct(pos, role, text). ``id`` and ``group`` say which column names the conversation and
    whether its turns come in several rows. For JSON records the expression sees the string as column ``record``.
    """

    name: str
    paths: tuple[str, ...]
    turns: str
    id: str = "conv_id"
    group: bool = False

    @property
    def key(self) -> int:
        return schema_fingerprint(self.paths)


def _pair(user: str, assistant: str) -> str:
    return (
        f"array(named_struct('pos', 0L, 'role', 'user', 'text', {user}),"
        f" named_struct('pos', 1L, 'role', 'assistant', 'text', {assistant}))"
    )


def _json(*names: str) -> list[str]:
    return [f"get_json_object(record, '$.{n}')" for n in names]


def _messages(field: str, role: str, text: str, roles: str) -> str:
    parsed = f"from_json(get_json_object(record, '$.{field}'), 'array<struct<`{role}`:string,`{text}`:string>>')"
    named = roles.format(f"x.`{role}`")
    return f"transform({parsed}, (x, i) -> named_struct('pos', cast(i as bigint), 'role', {named}, 'text', x.`{text}`))"


#: One row for each turn of a conversation.
TURN_ROWS = Layout(
    "turn rows", ("conv_id", "turn", "role", "text"),
    "array(named_struct('pos', turn, 'role', role, 'text', text))", group=True,
)
_PROMPT, _COMPLETION, _INSTRUCTION, _INPUT, _OUTPUT = _json("prompt", "completion", "instruction", "input", "output")
_SHORT_ROLES = "case {0} when 'human' then 'user' when 'gpt' then 'assistant' else {0} end"
JSON_LAYOUTS = (
    Layout("prompt", ("prompt", "completion"), _pair(_PROMPT, _COMPLETION)),
    Layout(
        "instruction", ("instruction", "input", "output"),
        _pair(f"concat_ws('\\n\\n', {_INSTRUCTION}, nullif({_INPUT}, ''))", _OUTPUT),
    ),
    Layout("instruction without input", ("instruction", "output"), _pair(_INSTRUCTION, _OUTPUT)),
    Layout("messages", ("messages[].role", "messages[].content"), _messages("messages", "role", "content", "{0}")),
    Layout(
        "conversations", ("conversations[].from", "conversations[].value"),
        _messages("conversations", "from", "value", _SHORT_ROLES),
    ),
    Layout("no messages", ("messages[]:none",), "array()"),
    Layout("no conversations", ("conversations[]:none",), "array()"),
)


def _narrowest_first(layouts: Sequence[Layout]) -> list[Layout]:
    """By number of paths; of layouts with equally many the earlier one comes last, where it wins."""
    return sorted(reversed(layouts), key=lambda x: len(x.paths))


def turns_of_rows(df: DataFrame, layouts: Sequence[Layout] = (TURN_ROWS,)) -> DataFrame:
    """(conv_id, turns) of a table whose columns have one of the layouts; its schema's fingerprint selects it.

    Further columns are ignored: of several mappings whose fingerprint the schema has, that with most paths is taken, then
    the first. Turns are in order of (pos, role, text), so ties and repeated rows have a fixed order; rows with a null
    conversation form one conversation with a null id. No fingerprint fits: an error.
    """
    have = {p.lower() for p in field_paths(df.schema)}
    prints = {schema_fingerprint(have.intersection(x.paths)) for x in layouts}
    fits = [x for x in _narrowest_first(layouts) if x.key in prints]
    if not fits:
        raise ValueError(f"no layout for the fields {sorted(have)}")
    layout = fits[-1]
    used = df.select(*sorted({p.partition(".")[0].partition("[")[0] for p in layout.paths} | {layout.id}))
    rows = used.select(F.col(layout.id).alias("conv_id"), F.expr(layout.turns).cast(f"array<{TURN}>").alias("turns"))
    if layout.group:
        rows = rows.groupBy("conv_id").agg(F.array_sort(F.flatten(F.collect_list("turns"))).alias("turns"))
    return rows


def turns_of_json(df: DataFrame, record: str, layouts: Sequence[Layout] = JSON_LAYOUTS) -> DataFrame:
    """The rows with fingerprint, layout and turns; each record's own fingerprint selects its mapping.

    ``fingerprint`` is that of the mapping, or of all paths of the record where no mapping fits. Fields that no mapping names
    are ignored; of several mappings that with most paths is taken, then the first. An empty array of messages gives no turns.
    A record without a known fingerprint, null and what isn't JSON have null layout and turns; no row is lost.
    """
    rows = df.withColumns({"_paths": json_paths(F.col(record)), "record": F.col(record)})
    code, name, turns = fingerprint(F.col("_paths")), F.lit(None).cast("string"), F.lit(None).cast(f"array<{TURN}>")
    for x in _narrowest_first(layouts):
        named = F.array_intersect("_paths", F.array(*[F.lit(p) for p in x.paths]))
        hit = fingerprint(named) == F.lit(x.key)
        code = F.when(hit, F.lit(x.key)).otherwise(code)
        name = F.when(hit, x.name).otherwise(name)
        turns = F.when(hit, F.expr(x.turns).cast(f"array<{TURN}>")).otherwise(turns)
    rows = rows.withColumns({"fingerprint": code, "layout": name, "turns": turns}).drop("_paths")
    return rows if record == "record" else rows.drop("record")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    parts = F.transform(F.split(unescape(role), r"\\\\"), lambda p: F.replace(p, F.lit("\\n"), F.lit("\n")))
    return F.array_join(parts, "\\")


def format_turns(df: DataFrame, turns: str = "turns", learn: Mapping[str, bool] | None = None) -> DataFrame:
    """The rows with ``formatted`` and ``loss_spans``.

    A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``; null roles and texts are empty. ``loss_spans`` holds one
    struct(start, length) in code points for each text of a role in ``learn`` (default: assistant), in order.
    Null or no turns give an empty text without spans.
    """
    roles = [r for r, on in (learn or {"assistant": True}).items() if on]
    empty = F.lit("")

    def marked(t: Column) -> Column:
        role = F.coalesce(t["role"], empty)
        return F.struct(
            F.concat(F.lit(START), escape_role(role), F.lit("\n")).alias("head"),
            escape(F.coalesce(t["text"], empty)).alias("body"),
            role.isin(roles).alias("learn"),
        )

    tail = END + "\n"
    size = lambda s: F.length(s["head"]) + F.length(s["body"]) + F.lit(len(tail))
    spans = F.aggregate(
        "_parts",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda acc, s: F.struct(
            (acc["at"] + size(s)).alias("at"),
            F.when(
                s["learn"],
                F.concat(acc["spans"], F.array(F.struct(
                    (acc["at"] + F.length(s["head"])).alias("start"), F.length(s["body"]).alias("length")))),
            ).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    parts = F.transform(F.coalesce(F.col(turns), F.array().cast(f"array<{TURN}>")), marked)
    text = F.array_join(F.transform("_parts", lambda s: F.concat(s["head"], s["body"], F.lit(tail))), "")
    return df.withColumn("_parts", parts).withColumns({"formatted": text, "loss_spans": spans}).drop("_parts")


def parse_turns(formatted: Column) -> Column:
    """The turns read back from a formatted text: array of struct(role, text)."""
    pieces = F.split(formatted, r"<\|im_start\|>")
    pieces = F.slice(pieces, 2, F.size(pieces))

    def one(p: Column) -> Column:
        head = F.substring_index(p, "\n", 1)
        body = F.substring(p, F.length(head) + 2, F.length(p) - F.length(head) - F.lit(len(END) + 2))
        return F.struct(unescape_role(head).alias("role"), unescape(body).alias("text"))

    return F.transform(pieces, one)


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")
