"""Conversations in many layouts to one chat format, by schema fingerprints.

Method. A record is a JSON value. The paths of all its fields at any depth, with array
positions left out, are its schema; their hash is its fingerprint. Each fingerprint selects one declarative
mapping: a list of (role, path) pairs for flat layouts, or an array path with the names of
its role and text fields. The mapping turns the record into canonical turns, which a
template formats. All of it is column expressions: no Python runs on the rows.

Template. A turn is ``### role: text </turn>`` and a line end. Inside texts and roles the
control strings and the escape sign are replaced by two-character codes that begin with a
backslash, so markers occur only where the template put them and the text can be read back.

Size. A row is one record; nothing is gathered but the turns of one conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

OPEN, MIDDLE, CLOSE = "### ", ": ", " </turn>\n"
#: Control strings and their codes; the escape sign comes first when writing, last when reading.
CODES = (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\t"), (": ", "\\c"))
TURNS = "array<struct<role:string,text:string>>"
#: Characters up to which the variant parser takes every record (its limit for one string is
#: the first it meets), and the options of the reader of those it does not take.
PARSED, UNBOUND = 20_000_000, {"maxStringLen": "2147483647"}
#: Bytes of an outline that the parser takes.
OUTLINE = 120 << 20
#: Types of plain values in a schema text, where a type may stand, and the name all are given.
SCALARS = (r"(?<=^|<|: )(?:STRING|VOID|BOOLEAN|BIGINT|DOUBLE|FLOAT|DECIMAL\(\d+,\d+\))(?=$|>|,)")
PLAIN = "VALUE"
#: A name of a JSON text (kept as $1), or a string value ($2 and $3 are its quotes).
STRINGS = r"""("[^"\\]*+(?:\\.[^"\\]*+)*+"\s*+:)|(")[^"\\]*+(?:\\.[^"\\]*+)*+(")"""

#: Names that the from/value layout gives to the speakers.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

#: Layouts: name, schema paths, then either the array path with its role and text fields, or
#: the flat (role, path) pairs in the order of the turns. A path ends in a plain value, ``[]``
#: stands for the items of an array; ``text[].text`` of a turn's field is the texts in a row.
LAYOUTS = (
    ("prompt", ("prompt", "response"), None, (("user", "prompt"), ("assistant", "response"))),
    ("completion", ("completion", "prompt"), None, (("user", "prompt"), ("assistant", "completion"))),
    ("system_prompt", ("prompt", "response", "system"), None,
     (("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    ("instruction", ("input", "instruction", "output"), None,
     (("system", "instruction"), ("user", "input"), ("assistant", "output"))),
    ("instruction_only", ("instruction", "output"), None, (("user", "instruction"), ("assistant", "output"))),
    ("nested_prompt", ("data.prompt", "data.response"), None, (("user", "data.prompt"), ("assistant", "data.response"))),
    ("messages", ("messages[].content", "messages[].role"), ("messages", "role", "content"), None),
    ("conversations", ("conversations[].from", "conversations[].value"), ("conversations", "from", "value"), None),
    ("parts", ("messages[].content[].text", "messages[].content[].type", "messages[].role"),
     ("messages", "role", "content[].text"), None),
)


def escape(text: Column, role: bool = False) -> Column:
    """Text with control strings as codes; ``role`` also escapes what ends a role."""
    for plain, code in CODES if role else CODES[:3]:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, role: bool = False) -> Column:
    """Undo ``escape``: no code holds a second escape sign, so the order is all that matters."""
    for plain, code in reversed(CODES if role else CODES[:3]):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _shape(paths: tuple[str, ...]) -> str:
    """Schema text of the field paths: objects with sorted names, arrays, plain values."""
    fields: dict[str, list[str]] = {}
    for path in sorted(paths):
        name, dot, rest = path.partition(".")
        fields.setdefault(name, []).append(rest if dot else "")
    each = []
    for name, below in sorted(fields.items()):
        inner = PLAIN if below == [""] else _shape(tuple(below))
        each.append(f"{name[:-2]}: ARRAY<{inner}>" if name.endswith("[]") else f"{name}: {inner}")
    return f"OBJECT<{', '.join(each)}>"


def _digest(paths: tuple[str, ...]) -> Column:
    return F.xxhash64(F.lit(_shape(paths)))


def fingerprint(schema: Column) -> Column:
    """Hash of the field paths of a record, at any depth, from its ``schema_of_variant`` text.

    The text names every field with what is below it, odd names in quotes; the types of plain
    values are made one. A value that is an object in one record and plain in another gives
    two fingerprints, as does any additional field.
    """
    return F.xxhash64(F.regexp_replace(schema, SCALARS, PLAIN))


def canonical_role(role: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    role = text_of(role)
    return F.coalesce(F.try_element_at(names, role), role)


def _reader(role: str, text: str):
    """Reads one item of an array layout; only the from/value layout renames its speakers."""
    def read(item: Column) -> Column:
        name = canonical_role(item[role]) if role == "from" else text_of(item[role])
        field, several, below = text.partition("[].")
        body = F.array_join(F.transform(item[field], lambda p: text_of(p[below])), "") if several else item[field]
        return F.struct(name.alias("role"), text_of(body).alias("text"))
    return read


def _turns(get, print_: Column) -> Column:
    """Turns by the mapping of a fingerprint; ``get`` reads a field as a type."""
    chosen = None
    for _, paths, nested, flat in LAYOUTS:
        if nested:
            field, role, text = nested
            name, several, below = text.partition("[].")
            kind = f"array<struct<`{below}`:string>>" if several else "string"
            turns = F.transform(get(field, f"array<struct<`{role}`:string,`{name}`:{kind}>>"), _reader(role, text))
        else:
            turns = F.array(*[F.struct(F.lit(role).alias("role"), text_of(get(path, "string")).alias("text"))
                              for role, path in flat])
        hit = print_ == _digest(paths)
        chosen = F.when(hit, turns) if chosen is None else chosen.when(hit, turns)
    return chosen


def canonical_turns(record: Column, print_: Column) -> Column:
    """Turns of a parsed record by the mapping of its fingerprint; null for an unknown one."""
    return _turns(lambda path, kind: F.variant_get(record, f"$.{path}", kind), print_)


def _outline(record: Column) -> Column:
    """A JSON text with all string values emptied; names stay."""
    return F.regexp_replace(record, STRINGS, "$1$2$3")


def _long_turns(record: Column, print_: Column) -> Column:
    """``canonical_turns`` of a JSON text of any length, read by field."""
    def get(path: str, kind: str) -> Column:
        names = path.split(".")
        schema = kind
        for name in reversed(names):
            schema = f"struct<`{name}`:{schema}>"
        found = F.from_json(record, schema, UNBOUND)
        for name in names:
            found = found[name]
        return found
    return _turns(get, print_)


def from_records(records: DataFrame, column: str = "record") -> DataFrame:
    """``records`` with schema_print and turns of the JSON text in ``column``.

    Null, broken JSON and layouts without a mapping give null turns, so that they can be
    counted and a mapping added; the row stays. Null texts inside a known layout are empty.
    Records beyond the limits of the variant parser (one string of 20 million characters, 128
    MiB) have the fingerprint of their outline, which is the same, and are read by field; one
    whose outline alone is beyond the limits is an error. Columns already named schema_print
    or turns are replaced.
    """
    record = F.col(column)
    parsed = F.try_parse_json(record)
    long = parsed.isNull() & (F.length(record) > PARSED)
    outline = _outline(record)
    checked = F.when(F.octet_length(outline) < OUTLINE, outline).otherwise(F.raise_error(F.lit(
        "a record has too many fields to be read")).cast("string"))
    known = records.withColumn("schema_print", fingerprint(F.schema_of_variant(
        F.when(long, F.try_parse_json(checked)).otherwise(parsed))))
    print_ = F.col("schema_print")
    return known.withColumn("turns", F.when(long, _long_turns(record, print_)).otherwise(
        canonical_turns(parsed, print_)))


def chat_format(turns: Column) -> Column:
    """Formatted text of canonical turns."""
    each = F.transform(turns, lambda t: F.concat(
        F.lit(OPEN), escape(text_of(t["role"]), True), F.lit(MIDDLE), escape(text_of(t["text"])), F.lit(CLOSE)))
    return F.array_join(each, "")


def _pieces(formatted: Column) -> Column:
    """Bodies between the markers of a formatted text."""
    return F.slice(F.split(formatted, CLOSE), 1, F.size(F.split(formatted, CLOSE)) - 1)


def read_back(formatted: Column) -> Column:
    """Canonical turns read from a formatted text."""
    head = len(OPEN) + 1
    return F.transform(_pieces(formatted), lambda p: F.struct(
        unescape(F.substring_index(p.substr(F.lit(head), F.length(p)), MIDDLE, 1), True).alias("role"),
        unescape(p.substr(F.instr(p, MIDDLE) + len(MIDDLE), F.length(p))).alias("text")))


def loss_mask(formatted: Column, role: str = "assistant") -> Column:
    """Spans (start, length in code points) of the texts of ``role`` in a formatted text."""
    marker = OPEN + role + MIDDLE
    step = F.aggregate(
        _pieces(formatted),
        F.struct(F.lit(0).cast("int").alias("at"),
                 F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p) + len(CLOSE)).cast("int").alias("at"),
            F.when(F.startswith(p, F.lit(marker)), F.concat(acc["spans"], F.array(F.struct(
                (acc["at"] + len(marker)).cast("int").alias("start"),
                (F.length(p) - len(marker)).cast("int").alias("length"))))).otherwise(acc["spans"]).alias("spans")))
    return step["spans"]


def masked_text(formatted: Column, spans: Column) -> Column:
    """Unescaped text under the loss mask, span after span."""
    return F.array_join(F.transform(spans, lambda s: unescape(formatted.substr(s["start"] + 1, s["length"]))), "")


def format_chats(records: DataFrame, column: str = "record") -> DataFrame:
    """``records`` with schema_print, turns, formatted and loss_spans columns."""
    known = from_records(records, column).withColumn("formatted", chat_format(F.col("turns")))
    return known.withColumn("loss_spans", loss_mask(F.col("formatted")))


def to_records(turns: DataFrame) -> DataFrame:
    """(conv_id, record): one JSON record for each conversation of a table of turns.

    Rows of a conversation are put in order of turn (null first), role and text; repeated
    rows stay. A user and an assistant turn become the prompt layout, with a system turn
    before them the system_prompt layout, anything else the messages layout. The turns of a
    null conv_id are one conversation.
    """
    ordered = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(
        F.coalesce(F.col("turn"), F.lit(-1 << 62)).alias("turn"), text_of(F.col("role")).alias("role"),
        text_of(F.col("text")).alias("text")))).alias("all"))
    roles = F.transform("all", lambda t: t["role"])
    text = lambda i: F.get("all", F.lit(i))["text"]
    one = F.to_json(F.struct(text(0).alias("prompt"), text(1).alias("response")))
    two = F.to_json(F.struct(text(0).alias("system"), text(1).alias("prompt"), text(2).alias("response")))
    many = F.to_json(F.struct(F.transform("all", lambda t: F.struct(
        t["role"].alias("role"), t["text"].alias("content"))).alias("messages")))
    pick = (F.when(roles == F.array(F.lit("user"), F.lit("assistant")), one)
            .when(roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant")), two).otherwise(many))
    return ordered.select("conv_id", pick.alias("record"))
