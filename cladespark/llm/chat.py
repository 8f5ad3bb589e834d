"""Chat formatting: schema fingerprints choose declarative mappings into canonical turns, which a template marks."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Layout:
    """How records of one shape become turns.

    ``paths`` are the nested field paths that the shape consists of, ``[]`` for a list's elements. A layout has either
    ``items`` (list path, role key, text key), ``fields`` (role and path of each turn, empty ones left out) or
    ``rows`` (a table with a row for each turn: conversation, turn, role, text). ``head`` is a path of a system text.
    """

    name: str
    paths: tuple[str, ...]
    items: tuple[str, str, str] | None = None
    fields: tuple[tuple[str, str], ...] = ()
    rows: tuple[str, str, str, str] | None = None
    head: str | None = None
    roles: dict[str, str] = field(default_factory=dict, hash=False)


NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant"}

LAYOUTS = (
    Layout("turn rows", ("conv_id", "turn", "role", "text"), rows=("conv_id", "turn", "role", "text")),
    Layout("messages", ("messages[].role", "messages[].content"), items=("messages", "role", "content"), roles=NAMES),
    Layout("messages with system", ("messages[].role", "messages[].content", "system"), items=("messages", "role", "content"), head="system", roles=NAMES),
    Layout("shared conversations", ("conversations[].from", "conversations[].value"), items=("conversations", "from", "value"), roles=NAMES),
    Layout("shared conversations with system", ("conversations[].from", "conversations[].value", "system"), items=("conversations", "from", "value"), head="system", roles=NAMES),
    Layout("prompt and completion", ("prompt", "completion"), fields=(("user", "prompt"), ("assistant", "completion"))),
    Layout("prompt and response", ("prompt", "response"), fields=(("user", "prompt"), ("assistant", "response"))),
    Layout("instruction", ("instruction", "output"), fields=(("user", "instruction"), ("assistant", "output"))),
    Layout("instruction with input", ("instruction", "input", "output"), fields=(("user", "instruction\n\ninput"), ("assistant", "output"))),
    Layout("question and answer", ("question", "answer"), fields=(("user", "question"), ("assistant", "answer"))),
)
VOCABULARY = tuple(sorted({p for x in LAYOUTS for p in x.paths}))


def fingerprint(paths) -> str:
    """Hash of the known paths among ``paths``, in order; others do not change a shape."""
    return hashlib.md5("\n".join(sorted({*paths} & {*VOCABULARY})).encode()).hexdigest()


BY_FINGERPRINT = {fingerprint(x.paths): x for x in LAYOUTS}


def schema_paths(kind: T.DataType, at: str = "") -> list[str]:
    """All leaf paths of a schema."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{at}[]")
    return [at]


def layout_of(paths) -> Layout | None:
    """The layout of a shape: the one with its fingerprint, else the largest one (the first of equals) whose paths the
    shape holds, whatever other known paths it has besides."""
    paths = {*paths}
    held = [x for x in LAYOUTS if paths >= {*x.paths}]
    return BY_FINGERPRINT.get(fingerprint(paths)) or max(held, key=lambda x: len(x.paths), default=None)


def _has(record: Column, path: str) -> Column:
    """Whether a VARIANT record has a key, be its value null; of a list, whether some element has it."""
    outer, _, inner = path.partition("[].")
    value = F.try_variant_get(record, "$." + outer, "variant")
    if not inner:
        return value.isNotNull()
    return F.coalesce(F.exists(F.try_variant_get(record, "$." + outer, "array<variant>"), lambda x: F.try_variant_get(x, "$." + inner, "variant").isNotNull()), F.lit(False))


def record_fingerprint(record: Column) -> Column:
    """The same hash for a VARIANT record, from the known paths that it has, in whatever element of a list."""
    return F.md5(F.concat_ws("\n", *[F.when(_has(record, p), F.lit(p)) for p in VOCABULARY]).cast("binary"))


def _said(value: Column) -> Column:
    """The text of a VARIANT value: a string, the texts of a list of content parts one after another, else its JSON."""
    part = lambda x: F.coalesce(F.try_variant_get(x, "$.text", "string"), F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")), F.lit(""))
    return F.when(F.schema_of_variant(value).startswith("ARRAY"), F.array_join(F.transform(F.try_variant_get(value, "$", "array<variant>"), part), "")).otherwise(F.try_variant_get(value, "$", "string"))


def _named(role: Column, names: dict[str, str]) -> Column:
    role = F.coalesce(role, F.lit(""))
    out = role
    for k, v in names.items():
        out = F.when(role == k, F.lit(v)).otherwise(out)
    return out


def _turn(role: Column, text: Column) -> Column:
    return F.struct(role.alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _turns(layout: Layout, get, items) -> Column:
    """The turns of a record as an array."""
    if layout.items:
        path, role, text = layout.items
        out = F.transform(items(path, role, text), lambda x: _turn(_named(x[role], layout.roles), x[text]))
    else:
        parts = []
        for role, path in layout.fields:
            values = [get(p) for p in path.split("\n\n")]
            parts.append(_turn(F.lit(role), F.concat_ws("\n\n", *[F.when(v != "", v) for v in values])))
        out = F.array(*parts)
    if layout.head:
        head = get(layout.head)
        out = F.concat(F.when(F.coalesce(head, F.lit("")) != "", F.array(_turn(F.lit("system"), head))).otherwise(F.expr("cast(array() as array<struct<role:string,text:string>>)")), out)
    return F.coalesce(out, F.expr("cast(array() as array<struct<role:string,text:string>>)"))


def canonical_records(records: DataFrame, json: str, id_col: str = "conv_id") -> DataFrame:
    """``(conv_id, layout, turn, role, text)`` of JSON records of any known shape, each by its own fingerprint.

    A shape with other known paths besides those of a layout has the largest layout that it holds. Null or missing
    roles and texts are empty; a content that is a list of parts is its texts, one after another; an element of a list
    that is no object is a turn without role and text. Records of no known shape (as one whose list of turns
    is empty), broken JSON and null give a row with a null layout and turn, so that none is lost.
    """
    v = records.select(F.col(id_col).alias("conv_id"), F.try_parse_json(F.col(json)).alias("v")).withColumn("fp", record_fingerprint(F.col("v")))
    get = lambda p: F.try_variant_get("v", f"$.{p}", "string")
    field_of = lambda x, key: F.try_variant_get(x, f"$.{key}", "variant")
    items = lambda path, role, text: F.transform(F.try_variant_get("v", f"$.{path}", "array<variant>"), lambda x: F.struct(F.try_variant_get(x, f"$.{role}", "string").alias(role), _said(field_of(x, text)).alias(text)))
    known = [x for x in LAYOUTS if not x.rows]
    holds = lambda x: F.col("fp").isNotNull() & F.forall(F.array(*[_has(F.col("v"), p) for p in x.paths]), lambda b: b)
    which = F.lit(None).cast("string")
    for x in sorted(known, key=lambda x: len(x.paths)):
        which = F.when(holds(x), F.lit(x.name)).otherwise(which)
    for x in known:
        which = F.when(F.col("fp") == fingerprint(x.paths), F.lit(x.name)).otherwise(which)
    v = v.withColumn("layout", which)
    turns = F.lit(None)
    for x in known:
        turns = F.when(F.col("layout") == x.name, _turns(x, get, items)).otherwise(turns)
    return v.select("conv_id", "layout", F.posexplode_outer(turns).alias("turn", "t")).select("conv_id", "layout", F.col("turn").cast("long").alias("turn"), F.col("t.role").alias("role"), F.col("t.text").alias("text"))


def canonical(table: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """``(conv_id, layout, turn, role, text)`` of a table, by the fingerprint of its schema.

    Columns that no layout knows do not matter, and a table with known ones besides a layout's has the largest layout
    that it holds. A table of an unknown shape is refused. Ids may be of any type.
    """
    paths = schema_paths(table.schema)
    layout = BY_FINGERPRINT.get(fingerprint(paths)) or layout_of({*paths} - {id_col}) or layout_of(paths)
    if layout is None:
        raise ValueError(f"no layout for the paths {sorted({*paths} & {*VOCABULARY})}")
    if layout.rows:
        conv, turn, role, text = layout.rows
        return table.select(F.col(conv).alias("conv_id"), F.lit(layout.name).alias("layout"), F.col(turn).cast("long").alias("turn"), _named(F.col(role), layout.roles).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    turns = _turns(layout, F.col, lambda path, *_: F.col(path))
    return table.select(F.col(id_col).alias("conv_id"), F.lit(layout.name).alias("layout"), F.posexplode_outer(turns).alias("turn", "t")).select("conv_id", "layout", F.col("turn").cast("long").alias("turn"), "t.role", "t.text")


#: The template's control strings, fixed values; texts may hold them, and get a backslash more inside each.
TURN, BODY, STOP, CLOSE = "<s>", "[INST]", "[/INST]", "</s>"
_CONTROL = r"([<\[])(\\*/?(?:s>|INST\]))"
_ESCAPED = r"([<\[])\\(\\*/?(?:s>|INST\]))"


def escape(text: Column) -> Column:
    """Put a backslash after the bracket of each control string, escaped or not; so no control string is left."""
    return F.when(text.rlike(_CONTROL), F.regexp_replace(text, _CONTROL, r"$1\\$2")).otherwise(text)


def unescape(text: Column) -> Column:
    return F.when(text.rlike(_ESCAPED), F.regexp_replace(text, _ESCAPED, "$1$2")).otherwise(text)


def format_turns(turns: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``(conv_id, formatted, loss_mask)``, one row per conversation.

    A turn is TURN role BODY text STOP CLOSE, role and text escaped. ``loss_mask`` has an entry for each turn, in
    order: the code points of the turn, and where in it the trained text starts and how long it is (0 for turns of
    other roles, which ``loss`` tells from empty texts). Turns are sorted by number (nulls first), then role, then
    text; null roles and texts are empty; repeated turns repeat; turns without a conversation form one of their own
    with a null id. Escaping is done before turns are brought together. A conversation is one training example and one
    value, so it alone must fit in a task.
    """
    role, text = escape(F.coalesce("role", F.lit(""))), escape(F.coalesce("text", F.lit("")))
    marked = turns.select("conv_id", "turn", "role", role.alias("r"), text.alias("x"), F.coalesce("role", F.lit("")).isin(*trained).alias("loss"))
    piece = F.concat(F.lit(TURN), "r", F.lit(BODY), "x", F.lit(STOP + CLOSE))
    one = F.struct("turn", F.col("r").alias("role"), F.col("x").alias("text"), piece.alias("piece"), "loss")
    grouped = marked.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("t"))
    mask = lambda t: F.struct(F.length(t["piece"]).alias("chars"), t["loss"].alias("loss"), (F.length(t["role"]) + len(TURN + BODY)).alias("loss_from"), F.when(t["loss"], F.length(t["text"])).otherwise(0).alias("loss_chars"))
    return grouped.select("conv_id", F.array_join(F.transform("t", lambda t: t["piece"]), "").alias("formatted"), F.transform("t", mask).alias("loss_mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """``(conv_id, turns, loss_text, formatted_chars)``: the turns parsed from the formatted text alone, and the text
    under the loss mask, unescaped, each trained text once and in order."""
    pieces = F.slice(F.split("formatted", CLOSE, -1), 1, F.size("loss_mask"))
    split = formatted.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), "loss_mask", pieces.alias("p"))

    def turn(p):
        role = F.substring_index(p, BODY, 1)
        rest = F.length(role) + len(BODY)
        return F.struct(unescape(F.substr(role, F.lit(len(TURN) + 1))).alias("role"), unescape(F.substr(p, rest + 1, F.length(p) - rest - len(STOP))).alias("text"))

    lost = F.zip_with("p", "loss_mask", lambda p, m: F.when(m["loss"], unescape(F.substr(p, m["loss_from"] + 1, m["loss_chars"]))))
    return split.select("conv_id", F.transform("p", turn).alias("turns"), F.array_join(lost, "").alias("loss_text"), "formatted_chars")


def digests(back: DataFrame) -> DataFrame:
    """The digest columns of a read-back."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
