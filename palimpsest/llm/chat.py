"""Chat formatting by schema fingerprints. DataFrame functions only.

A record's fingerprint is the hash of its sorted nested field paths. It selects a declarative mapping, which says where
the roles and texts lie; so prompt, instruction and message layouts become the same canonical turns (turn, role, text).
Tables whose rows are turns have a fingerprint as well, that of their schema's paths.

Template: each turn is ``<|turn|>role\\ntext<|end|>\\n``. In roles and texts a backslash is doubled and a lone backslash is
put after the first character of every control string, which can be undone.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, CLOSE = "<|turn|>", "<|end|>\n"
# Fixed value: strings that chat templates use for control: anything that opens with <|, and these.
CONTROL = r"<(?=\||/?s>|</?SYS>>|</SYS>>)|\[(?=/?INST\])"

# Layouts as (name, field paths, kind, fields). Kind "messages": an array's path, its role and its text
# field; kind "fields": (role, field) pairs in order, empty fields left out unless the first; kind "rows": id, turn, role
# and text columns of a table whose rows are turns.
LAYOUTS = (
    ("turn-rows", ("conv_id", "role", "text", "turn"), "rows", ("conv_id", "turn", "role", "text")),
    ("messages", ("messages[].content", "messages[].role"), "messages", ("messages", "role", "content")),
    ("conversations", ("conversations[].from", "conversations[].value"), "messages", ("conversations", "from", "value")),
    ("prompt", ("completion", "prompt"), "fields", (("user", "prompt"), ("assistant", "completion"))),
    ("response", ("prompt", "response"), "fields", (("user", "prompt"), ("assistant", "response"))),
    ("question", ("answer", "question"), "fields", (("user", "question"), ("assistant", "answer"))),
    ("instruction", ("input", "instruction", "output"), "fields", (("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    ("instruction-short", ("instruction", "output"), "fields", (("user", "instruction"), ("assistant", "output"))),
    ("system-prompt", ("prompt", "response", "system"), "fields", (("system", "system"), ("user", "prompt"), ("assistant", "response"))),
)
# Role names of other layouts.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

TURNS = "array<struct<turn:bigint,role:string,text:string>>"


def path_fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def schema_paths(kind: T.DataType, at: str = "") -> list[str]:
    """The paths of a schema's leaves; arrays add []."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{at}[]")
    return [at]


def _role(role: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    lower = F.lower(role)
    return F.coalesce(F.element_at(known, lower), role, F.lit(""))


def _mapped(record: Column, kind: str, fields) -> Column:
    parsed = F.try_parse_json(record)
    if kind == "messages":
        array, role, text = fields
        found = F.try_variant_get(parsed, f"$.{array}", f"array<struct<`{role}`:string,`{text}`:string>>")
        return F.transform(
            found,
            lambda m, i: F.struct(i.cast("long").alias("turn"), _role(m[role]).alias("role"), F.coalesce(m[text], F.lit("")).alias("text")),
        )
    turns = []
    for k, (role, field) in enumerate(fields):
        text = F.coalesce(F.try_variant_get(parsed, f"$.{field}", "string"), F.lit(""))
        turn = F.struct(F.lit(k).cast("long").alias("turn"), F.lit(role).alias("role"), text.alias("text"))
        turns.append(turn if k == 0 or role == "assistant" else F.when(text != "", turn))
    return F.array_compact(F.array(*turns))


def record_paths(record: Column) -> Column:
    """The sorted field paths of a JSON object, row by row; null for text that is no JSON object.

    Paths of up to one array or object level inside the record are told apart, which all layouts need."""
    parsed = F.try_parse_json(record)
    shape = F.schema_of_variant(parsed)
    inner = F.regexp_extract(shape, r"^OBJECT<(.*)>$", 1)
    # nested fields are marked first: name: ARRAY<OBJECT<a: X, b: Y>> gives name[].a, name[].b
    fields = F.regexp_extract_all(inner, F.lit(r"([^,<>:]+: (?:ARRAY<OBJECT<[^<>]*>>|OBJECT<[^<>]*>|[^,]+))"), 1)

    def leaves(field: Column) -> Column:
        name = F.trim(F.substring_index(field, ": ", 1))
        body = F.regexp_extract(field, r"OBJECT<([^<>]*)>", 1)
        mark = F.when(field.contains(": ARRAY<"), F.lit("[]")).otherwise(F.lit(""))
        below = F.transform(F.split(body, ", "), lambda x: F.concat(name, mark, F.lit("."), F.substring_index(x, ": ", 1)))
        return F.when(body != "", below).otherwise(F.array(F.concat(name, mark)))

    return F.when(inner != "", F.array_sort(F.flatten(F.transform(fields, leaves))))


def _fingerprint(paths: Column) -> Column:
    return F.substring(F.sha2(F.array_join(F.array_sort(paths), "\n"), 256), 1, 16)


def _layout(paths: Column, kinds: tuple[str, ...]) -> Column:
    """The name of the first layout, those with most paths first, whose fingerprint the known paths among ``paths`` give;
    paths that a layout doesn't name play no part in it. Null if there is none."""
    layouts = sorted((x for x in LAYOUTS if x[2] in kinds), key=lambda x: -len(x[1]))
    named = [
        F.when(_fingerprint(F.array_intersect(paths, F.array(*map(F.lit, wanted)))) == path_fingerprint(wanted), F.lit(name))
        for name, wanted, _, _ in layouts
    ]
    return F.coalesce(*named)


def turns_of_records(records: DataFrame) -> DataFrame:
    """(conv_id, layout, turns): canonical turns of JSON records (conv_id, record); other columns are ignored.

    A record may hold more fields than its layout names (ids, sources, names of messages). layout and turns are null
    where no mapping has the record's fingerprint, for null records and for text that is no JSON object; ``unmapped``
    counts these. Very long records are mapped whole; repeated records give repeated results."""
    prints = records.select("conv_id", "record", record_paths(F.col("record")).alias("paths"))
    found = prints.withColumn("layout", _layout(F.col("paths"), ("messages", "fields")))
    turns = F.lit(None).cast(TURNS)
    for name, _, kind, fields in LAYOUTS:
        if kind != "rows":
            turns = F.when(F.col("layout") == name, _mapped(F.col("record"), kind, fields).cast(TURNS)).otherwise(turns)
    return found.select("conv_id", "layout", turns.alias("turns"))


def unmapped(mapped: DataFrame) -> DataFrame:
    """(records, without): how many records there are, and how many no layout fits."""
    return mapped.agg(F.count("*").alias("records"), F.count_if(F.col("layout").isNull()).alias("without"))


def turns_of_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of a table whose rows are turns.

    The field paths of its schema are fingerprinted as a record's are, so a table with further columns maps as well; one
    that fits no layout is an error. Null roles and texts are empty."""
    have = schema_paths(rows.schema)
    known = [x for x in LAYOUTS if x[2] == "rows"]
    prints = {path_fingerprint(paths): fields for _, paths, _, fields in known}
    wanted = [path_fingerprint(set(have) & set(paths)) for _, paths, _, _ in known]
    fields = next((prints[x] for x in wanted if x in prints), None)
    if fields is None:
        raise ValueError(f"no mapping for the field paths {sorted(have)}")
    conv, turn, role, text = fields
    return rows.select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, CONTROL, r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def escape_role(role: Column) -> Column:
    """As a text's escape; a line feed becomes a lone backslash and n, as it ends the role in the template."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    # an odd number of backslashes before n: the last one stands alone
    return unescape(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))


def format_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans): one row per conversation of canonical turn rows.

    Turns are ordered by turn, then role and text, so repeated and tied rows have a fixed order; a null conv_id is one
    conversation, a null turn comes first. loss_spans holds, for each turn, start and end of its escaped text in the
    formatted text (code points) and whether it bears loss (assistant turns).
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    # places among equal rows are equal text, so any order of them is the same output
    head = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit("\n"))
    parts = turns.withColumn("at", F.row_number().over(order)).withColumn("head", head).withColumn("body", escape(F.col("text")))
    size = F.char_length("head") + F.char_length("body") + F.lit(len(CLOSE))
    start = (F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.char_length("body") - F.lit(len(CLOSE))).cast("long")
    span = F.struct(start.alias("start"), (start + F.char_length("body")).alias("end"), (F.col("role") == "assistant").alias("loss"))
    rows = parts.select("conv_id", "at", F.concat("head", "body", F.lit(CLOSE)).alias("piece"), span.alias("span"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "piece", "span"))).alias("xs"))
    return whole.select("conv_id", F.array_join(F.transform("xs", lambda x: x["piece"]), "").alias("formatted"), F.transform("xs", lambda x: x["span"]).alias("loss_spans"))


def read_turns(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_texts, formatted_chars): turns parsed from the formatted text: role, text (both unescaped) and
    whether it bears loss; loss_texts holds what the loss spans cut out of the formatted text, unescaped, in order."""
    pieces = F.filter(F.split("formatted", r"<\|end\|>\n"), lambda x: x != "")

    def parsed(piece: Column, i: Column) -> Column:
        rest = F.substring(piece, len(OPEN) + 1, F.lit(2**31 - 1))
        role = F.substring_index(rest, "\n", 1)
        text = F.substring(rest, F.char_length(role) + 2, F.lit(2**31 - 1))
        return F.struct(unescape_role(role).alias("role"), unescape(text).alias("text"), F.get("loss_spans", i)["loss"].alias("loss"))

    borne = F.filter("loss_spans", lambda s: s["loss"])
    masked = F.transform(borne, lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return formatted.select(
        "conv_id", F.transform(pieces, parsed).alias("turns"), masked.alias("loss_texts"), F.char_length("formatted").cast("long").alias("formatted_chars")
    )
