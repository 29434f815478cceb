"""Chat formatting: records of many layouts become canonical turns, and turns one marked text with a loss mask.

A record is JSON text or a struct. Its fingerprint is the hash of its own nested field paths, scalar types put alike: of
JSON text the schema that parsing gives, of a struct the paths that hold a value. The paths under the fields that some
layout names, hashed, select the one mapping that declares them: each layout lists the paths that it must and may have.
A list of text parts is a layout of its own; a record that none declares (contents that are other lists or objects, or
sometimes text and sometimes not, a part that is no text, a JSON document beyond what parsing takes) has layout and
turns null. Top-level fields that no layout names, and scalar fields beside a turn's role and text, are not looked at.

A formatted turn is ``<|turn|>role<|text|>text<|end|>``. Within roles and texts, a control string gets a backslash
after its first character, before any backslashes that stand there, so none is left, and taking one away gives the
text back. The loss mask is a list of spans (start and length in code points), one per turn of a trained role; they
are summed up in runs of turns, so long conversations cost about in proportion to their length.

Only DataFrame functions are used. A null role or text is empty; an empty list of turns gives an empty text. Turns
that tie keep the order of role and text; repeated rows stay. An empty table gives no rows. Columns of the same names
as those added are replaced; others stay. A conversation is one text, so its turns are gathered in one row.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Control strings of this format, and of common others.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
CONTROL = r"(?=\||/?s>|/?INST\]|</?SYS>>)"
ESCAPE, ESCAPED = rf"([<\[])(\\*){CONTROL}", r"$1\\$2"
UNESCAPE, UNESCAPED = rf"([<\[])\\(\\*){CONTROL}", "$1$2"
LOSS_ROLES = ("assistant",)
RUN = 256  # turns whose spans are summed up together


@dataclass(frozen=True)
class Layout:
    """``turns``: (array, role field, text field), the text being a list of parts where ``parts`` is set; or ``fields``:
    (role, the fields whose texts make the turn)."""

    name: str
    must: tuple[str, ...]
    may: tuple[str, ...] = ()
    turns: tuple[str, str, str] | None = None
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    roles: dict[str, str] = field(default_factory=dict)
    parts: bool = False


# The layouts, and what their roles are called here.
SHARED_ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}
LAYOUTS = (
    Layout("rows", ("turns[]",), ("turns[].role", "turns[].text"), turns=("turns", "role", "text")),
    Layout("messages", ("messages[]",), ("messages[].role", "messages[].content"), turns=("messages", "role", "content"), roles=SHARED_ROLES),
    Layout("message-parts", ("messages[]", "messages[].content[].text"), ("messages[].role", "messages[].content[].type"), turns=("messages", "role", "content"), roles=SHARED_ROLES, parts=True),
    Layout("conversations", ("conversations[]",), ("conversations[].from", "conversations[].value", "system"), turns=("conversations", "from", "value"), fields=(("system", ("system",)),), roles=SHARED_ROLES),
    Layout("instruction", ("instruction", "output"), ("input", "system"), fields=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("prompt-response", ("prompt", "response"), ("system",), fields=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("prompt-completion", ("prompt", "completion"), ("system",), fields=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("question-answer", ("question", "answer"), ("context",), fields=(("user", ("context", "question")), ("assistant", ("answer",)))),
)
ARRAYS = {x.turns[0]: x.turns[1:] for x in LAYOUTS if x.turns}
PLAIN = sorted({p for x in LAYOUTS for p in (*x.must, *x.may) if "[]" not in p})
TURNS = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))


def record_type() -> T.StructType:
    """A struct of every field that some layout names."""
    pair = lambda names: T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in names]))
    return T.StructType([*[T.StructField(n, pair(f)) for n, f in ARRAYS.items()], *[T.StructField(n, T.StringType()) for n in PLAIN]])


def text_of(column: Column, kind: T.DataType) -> Column:
    return F.to_json(column) if isinstance(kind, T.ArrayType | T.StructType | T.MapType) else column.cast("string")


def whole_record(df: DataFrame, record_col: str) -> Column:
    """The record as that struct: JSON is read, a struct's missing fields are null, nested contents are JSON text."""
    kind = df.schema[record_col].dataType
    if isinstance(kind, T.StringType):
        return F.from_json(record_col, record_type())
    held = {f.name: f.dataType for f in kind.fields}

    def own(name: str, inner: tuple[str, ...] | None) -> Column:
        if name not in held or inner is not None and not is_turns(held[name]):
            return F.lit(None).cast(record_type()[name].dataType).alias(name)
        column = F.col(record_col)[name]
        if inner is None:
            return text_of(column, held[name]).alias(name)
        has = {f.name: f.dataType for f in held[name].elementType.fields}
        return F.transform(column, lambda x: F.struct(*[(text_of(x[i], has[i]) if i in has else F.lit(None).cast("string")).alias(i) for i in inner])).alias(name)

    return F.struct(*[own(n, f) for n, f in ARRAYS.items()], *[own(n, None) for n in PLAIN])


def is_turns(kind: T.DataType) -> bool:
    return isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType)


def struct_paths(column: Column, kind: T.DataType, path: str, inner: tuple[str, ...] | None = None) -> list[Column]:
    """The paths below a field that hold a value; ``inner``: of scalar fields there, those that count."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in struct_paths(column[f.name], f.dataType, f"{path}.{f.name}" if path else f.name)]
    if not isinstance(kind, T.ArrayType):
        return [F.when(column.isNotNull(), F.lit(path))]
    found = [F.when(column.isNotNull(), F.lit(f"{path}[]"))]
    if not isinstance(kind.elementType, T.StructType):
        return found if not isinstance(kind.elementType, T.ArrayType) else [F.when(column.isNotNull(), F.lit(f"{path}[][]"))]
    for f in kind.elementType.fields:
        nested = isinstance(f.dataType, T.ArrayType | T.StructType | T.MapType)
        if nested:
            each = F.transform(column, part(f.name))
            each = F.flatten(each) if isinstance(f.dataType, T.ArrayType) else each
            own = struct_paths(each, each_kind(f.dataType), f"{path}[].{f.name}")
            found += own[1:] if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType) else own
        elif inner is None or f.name in inner:
            found.append(F.when(F.exists(column, holds(f.name)), F.lit(f"{path}[].{f.name}")))
    return found


def part(name: str):
    return lambda x: x[name]


def holds(name: str):
    return lambda x: x[name].isNotNull()


def each_kind(kind: T.DataType) -> T.DataType:
    return kind if isinstance(kind, T.ArrayType) else T.ArrayType(kind)


SCALAR = r"\b(STRING|BIGINT|DOUBLE|FLOAT|BOOLEAN|DATE|TIMESTAMP(_NTZ)?|BINARY|UUID|DECIMAL\(\d+, ?\d+\))(?=[,>]|$)"
NAME = r"(\w+|`(?:[^`]|``)*`)"


def shape(variant: Column) -> Column:
    """The schema of a JSON value, scalars alike and null fields left out."""
    alike = F.regexp_replace(F.schema_of_variant(variant), SCALAR, "S")
    return F.regexp_replace(F.regexp_replace(alike, rf"(?<=<){NAME}: VOID(, |(?=>))", ""), rf", {NAME}: VOID(?=[,>])", "")


def json_paths(variant: Column, name: str, inner: tuple[str, ...] | None) -> list[Column]:
    """The paths under one named field of a JSON record; what no layout could declare is a path of its own."""
    own = shape(F.try_variant_get(variant, f"$.{name}", "variant"))
    there = own.isNotNull() & (own != "VOID")
    if inner is None:
        return [F.when(there, F.when(own == "S", F.lit(name)).otherwise(F.concat(F.lit(f"{name} "), own)))]
    text = inner[1]
    fields = F.regexp_extract(own, r"^ARRAY<OBJECT<(.*)>>$", 1)
    parts = F.regexp_extract(fields, rf"(?:^|, ){text}: ARRAY<OBJECT<([^<>]*)>>(?:, |$)", 1)
    flat = F.regexp_replace(fields, rf"(^|, ){text}: ARRAY<OBJECT<(text: S|text: S, type: S)>>(?=, |$)", "$1parts: S")
    listed = F.regexp_like(flat, F.lit(r"(^|, )parts: S(, |$)")) & (parts != "")
    # what is no list of flat objects stands as one undeclared path
    plain = own.isin("ARRAY<VOID>", "ARRAY<OBJECT<>>") | (F.startswith(own, F.lit("ARRAY<OBJECT<")) & F.regexp_like(flat, F.lit(rf"^{NAME}: S(, {NAME}: S)*$")))
    found = [F.when(there, F.when(plain, F.lit(f"{name}[]")).otherwise(F.concat(F.lit(f"{name} "), own)))]
    for i in inner:
        found.append(F.when(there & plain & F.regexp_like(flat, F.lit(rf"(^|, ){i}: S(, |$)")), F.lit(f"{name}[].{i}")))
    found.append(F.when(there & plain & listed, F.lit(f"{name}[].{text}[].text")))
    found.append(F.when(there & plain & listed & F.contains(parts, F.lit("type: S")), F.lit(f"{name}[].{text}[].type")))
    return found


def paths_of(df: DataFrame, record_col: str) -> tuple[Column, Column]:
    """The record's fingerprint, and the sorted paths under the fields that layouts name."""
    kind = df.schema[record_col].dataType
    sort = lambda found: F.array_sort(F.array_distinct(F.array_compact(F.array(*found))))
    if isinstance(kind, T.StringType):
        variant = F.try_parse_json(record_col)
        found = [p for n, f in ARRAYS.items() for p in json_paths(variant, n, f)] + [p for n in PLAIN for p in json_paths(variant, n, None)]
        return F.xxhash64(F.coalesce(shape(variant), F.lit(""))), sort(found)
    every, named = [], []
    for f in kind.fields:
        column = F.col(record_col)[f.name]
        every += struct_paths(column, f.dataType, f.name)
        if f.name in ARRAYS or f.name in PLAIN:
            named += struct_paths(column, f.dataType, f.name, ARRAYS.get(f.name))
    return fingerprint(sort(every)) if every else F.xxhash64(F.lit("")), sort(named) if named else F.array().cast("array<string>")


def fingerprint(paths: Column) -> Column:
    return F.xxhash64(F.array_join(paths, "\n"))


def declared() -> dict[tuple[str, ...], str]:
    """Each set of paths that a layout allows, and the layout's name."""
    out = {}
    for x in LAYOUTS:
        for n in range(len(x.may) + 1):
            for some in combinations(x.may, n):
                out[tuple(sorted((*x.must, *some)))] = x.name
    return out


def turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def turns_by(layout: Layout, record: Column) -> Column:
    parts = []
    for role, names in layout.fields:
        said = F.array_join(F.filter(F.array(*[record[n] for n in names]), lambda x: x.isNotNull() & (x != "")), "\n\n")
        there = [record[n].isNotNull() for n in names]
        any_there = there[0]
        for x in there[1:]:
            any_there = any_there | x
        parts.append(F.when(any_there, F.array(turn(F.lit(role), said))).otherwise(F.array().cast(TURNS)))
    if layout.turns:
        array, role_name, text_name = layout.turns

        def said(x: Column) -> Column:
            if not layout.parts:
                return x[text_name]
            parts = F.from_json(x[text_name], "array<struct<type:string,text:string>>")
            texts = F.forall(parts, lambda p: (p["type"].isNull() | (p["type"] == "text")) & p["text"].isNotNull())
            return F.when(x[text_name].isNull(), F.lit("")).when(texts, F.array_join(F.transform(parts, lambda p: p["text"]), "\n"))

        def own_role(x: Column) -> Column:
            role = x[role_name]
            for old, new in layout.roles.items():
                role = F.when(x[role_name] == old, F.lit(new)).otherwise(role)
            return role

        made = F.transform(record[array], lambda x: turn(own_role(x), said(x)))
        if layout.parts:  # a part that is no text: no turns
            made = F.when(F.forall(record[array], lambda x: said(x).isNotNull()), made)
        parts.append(made)
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def canonical_turns(df: DataFrame, record_col: str) -> DataFrame:
    """Adds fingerprint, layout and turns."""
    whole, paths = paths_of(df, record_col)
    own = df.withColumn("_record", whole_record(df, record_col)).withColumn("fingerprint", whole).withColumn("layout", fingerprint(paths))
    sets = declared()
    marks = F.map_from_arrays(F.array(*[F.xxhash64(F.lit("\n".join(p))) for p in sets]), F.array(*[F.lit(n) for n in sets.values()]))
    own = own.withColumn("layout", F.try_element_at(marks, F.col("layout")))
    turns = F.lit(None).cast(TURNS)
    for x in LAYOUTS:
        turns = F.when(F.col("layout") == x.name, turns_by(x, F.col("_record"))).otherwise(turns)
    own = own.withColumn("turns", turns).drop("_record")
    return own.withColumn("layout", F.when(F.col("turns").isNotNull(), F.col("layout")))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, ESCAPED)


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, UNESCAPED)


def format_turns(df: DataFrame, turns_col: str = "turns", loss_roles: tuple[str, ...] = LOSS_ROLES) -> DataFrame:
    """Adds formatted and loss_spans."""
    pieces = F.transform(turns_col, lambda t: F.struct(t["role"].isin(*loss_roles).alias("trained"), F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT)).alias("head"), escape(t["text"]).alias("body")))
    sized = F.transform("_pieces", lambda p: F.struct(p["trained"].alias("trained"), F.length(p["head"]).cast("long").alias("head"), F.length(p["body"]).cast("long").alias("body")))
    spans = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]))
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(spans).alias("spans"))

    def step(held: Column, p: Column) -> Column:
        span = F.struct((held["at"] + p["head"]).alias("start"), p["body"].alias("length"))
        return F.struct((held["at"] + p["head"] + p["body"] + len(END)).alias("at"), F.when(p["trained"], F.concat(held["spans"], F.array(span))).otherwise(held["spans"]).alias("spans"))

    def sums(held: Column, run: Column) -> Column:
        return F.struct((held["at"] + run["at"]).alias("at"), F.concat(held["starts"], F.array(held["at"])).alias("starts"))

    starts = F.aggregate("_runs", F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("starts")), sums)["starts"]
    moved = F.zip_with("_runs", starts, lambda run, at: F.transform(run["spans"], lambda s: F.struct((s["start"] + at).alias("start"), s["length"].alias("length"))))
    made = df.withColumn("_pieces", pieces).withColumn("_sized", sized)
    firsts = F.filter(F.sequence(F.lit(0), F.greatest(F.size("_sized"), F.lit(0)), F.lit(RUN)), lambda i: i < F.size("_sized"))
    made = made.withColumn("_runs", F.transform(firsts, lambda i: F.aggregate(F.slice("_sized", i + 1, RUN), empty, step)))
    made = made.withColumn("formatted", F.array_join(F.transform("_pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END))), ""))
    return made.withColumn("loss_spans", F.when(F.col("_sized").isNotNull(), F.flatten(moved))).drop("_pieces", "_sized", "_runs")


def parse_turns(formatted: Column) -> Column:
    """The turns back from a formatted text."""
    quoted = {k: "".join("\\" + c if c in "|<>" else c for c in k) for k in (TURN, TEXT)}
    parts = F.slice(F.split(formatted, quoted[TURN]), 2, F.greatest(F.lit(1), F.length(formatted)))

    def read(part: Column) -> Column:
        halves = F.split(part, quoted[TEXT], 2)
        body = F.get(halves, 1)
        return F.struct(unescape(F.get(halves, 0)).alias("role"), unescape(F.substring(body, F.lit(1), F.length(body) - len(END))).alias("text"))

    return F.transform(parts, read)


def loss_text(formatted: Column, loss_spans: Column) -> Column:
    """All text under the mask, unescaped: first cut to runs of spans, so that no span is looked for from the start."""
    def read(i: Column) -> Column:
        run = F.slice(loss_spans, i + 1, RUN)
        begin, last = run[0]["start"], F.element_at(run, -1)
        held = F.struct(begin.alias("at"), F.substring(formatted, (begin + 1).cast("int"), (last["start"] + last["length"] - begin).cast("int")).alias("text"), run.alias("run"))
        texts = F.transform(F.array(held), lambda h: F.array_join(F.transform(h["run"], lambda s: unescape(F.substring(h["text"], (s["start"] - h["at"] + 1).cast("int"), s["length"].cast("int")))), ""))
        return texts[0]

    firsts = F.filter(F.sequence(F.lit(0), F.size(loss_spans), F.lit(RUN)), lambda i: i < F.size(loss_spans))
    return F.array_join(F.transform(firsts, read), "")


def records_from_rows(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One record per conversation, of the layout "rows", from one row per turn."""
    own = F.struct(F.col(turn_col).alias("at"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    grouped = rows.groupBy(F.col(id_col).alias("conv_id")).agg(F.sort_array(F.collect_list(own)).alias("held"))
    return grouped.select("conv_id", F.struct(F.transform("held", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns")).alias("record"))
