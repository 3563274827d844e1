"""Chat formatting: records of many layouts to canonical turns, turns to one marked text for each conversation with a loss mask.

A layout is declared as the nested field paths that it has (``messages[].role``) and where its turns are. The paths of a record, as far as any
layout names them, are sorted and hashed; the fingerprint selects the layout. Of a table's own columns the paths follow from its
schema, null or not; of JSON records from each record, where a null counts as absent. So one table may mix prompt, instruction and message layouts.
A record whose fingerprint belongs to no layout keeps its row, with no layout and no turns.

A turn is written as start marker, role, separator, text, end marker. A control string inside a role or a text gets a backslash after its first character,
and one that has backslashes there already gets one more, so that markers stand nowhere else and taking one away restores the text.
The loss mask names spans as (turn, start, length): code points within a turn's piece, which begins at its start marker; it covers assistants' texts and nothing else.

Rows are dealt by range of (conversation, turn), so a conversation with a third of all rows spans many tasks, which each join their run of turns;
what meets at the end is one row for each run. A conversation's text is one value and so must fit into a row (2 GB).

Turns come in ascending order, null last; ties go by role, then by a hash of the text. A null text or role is empty. Rows with a null
conversation id are one conversation. Repeated rows are turns each. Very long texts are taken whole. Empty tables give an empty result; extra columns
are ignored. DataFrame functions only.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from .common import Scratch, partitions, rows_as_structs

#: Names of roles in other layouts.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Layout:
    """``turns``: for a record with fields, (role, its paths); the texts of a role's paths that are there stand an empty line apart.

    ``each``: for a list of turns, (list, role, text). ``row``: for a table with a turn a row, (turn, role, text).
    """

    name: str
    paths: tuple[str, ...]
    optional: tuple[str, ...] = ()
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    each: tuple[str, str, str] | None = None
    row: tuple[str, str, str] | None = None


LAYOUTS = (
    Layout("rows", ("turn", "role", "text"), row=("turn", "role", "text")),
    Layout("messages", ("messages[].role", "messages[].content"), ("system",), (("system", ("system",)),), each=("messages", "role", "content")),
    Layout("conversations", ("conversations[].from", "conversations[].value"), ("system",), (("system", ("system",)),), each=("conversations", "from", "value")),
    Layout("prompt_response", ("prompt", "response"), ("system",), (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("prompt_completion", ("prompt", "completion"), ("system",), (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("instruction", ("instruction", "output"), ("input", "system"), (("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("question", ("question", "answer"), ("context", "system"), (("system", ("system",)), ("user", ("context", "question")), ("assistant", ("answer",)))),
)


def fingerprint(paths: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def registry(layouts: Iterable[Layout] = LAYOUTS) -> dict[str, Layout]:
    """Fingerprint to layout, with each choice of a layout's optional paths."""
    out: dict[str, Layout] = {}
    for layout in layouts:
        for n in range(len(layout.optional) + 1):
            for some in itertools.combinations(layout.optional, n):
                key = fingerprint([*layout.paths, *some])
                if key in out:
                    raise ValueError(f"layouts {out[key].name} and {layout.name} have the same paths")
                out[key] = layout
    return out


def known(layouts: Iterable[Layout] = LAYOUTS) -> list[str]:
    return sorted({p for layout in layouts for p in (*layout.paths, *layout.optional)})


def schema_paths(schema: StructType, prefix: str = "") -> list[str]:
    """All nested field paths of a schema, ``[]`` for the elements of a list."""
    out = []
    for f in schema.fields:
        kind, path = f.dataType, prefix + f.name
        while isinstance(kind, ArrayType):
            kind, path = kind.elementType, path + "[]"
        out += schema_paths(kind, path + ".") if isinstance(kind, StructType) else [path]
    return out


def record_schema(layouts: Iterable[Layout] = LAYOUTS) -> StructType:
    """What is parsed of a JSON record: the known paths and nothing else, all as strings."""
    plain, lists = [], {}
    for path in known(layouts):
        at, dot, name = path.partition("[].")
        if dot:
            lists.setdefault(at, []).append(StructField(name, StringType()))
        else:
            plain.append(StructField(path, StringType()))
    return StructType(plain + [StructField(at, ArrayType(StructType(fields))) for at, fields in lists.items()])


def record_fingerprint(record: Column, layouts: Iterable[Layout] = LAYOUTS) -> Column:
    """The hash of the known paths that a record (a struct of ``record_schema``) has."""

    def here(path: str) -> Column:
        at, dot, name = path.partition("[].")
        there = F.coalesce(F.exists(record[at], lambda x: x[name].isNotNull()), F.lit(False)) if dot else record[path].isNotNull()
        return F.when(there, F.lit(path))

    return F.sha2(F.concat_ws("\n", *[here(p) for p in known(layouts)]), 256)


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _turns(layout: Layout, record: Column, absent: frozenset[str] = frozenset()) -> Column:
    """array<struct<role, text>> of a record of this layout, without the optional paths that are absent."""
    there = [(role, [record[p] for p in paths if p not in absent]) for role, paths in layout.turns]
    head = [F.when(F.coalesce(*own).isNotNull(), _turn(F.lit(role), F.concat_ws("\n\n", *own))) for role, own in there if own]
    fixed = F.filter(F.array(*head), lambda t: t.isNotNull()) if head else None
    if layout.each is None:
        return fixed
    items, role, text = layout.each
    names = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    own = F.transform(F.filter(record[items], lambda x: x.isNotNull()), lambda x: _turn(F.coalesce(names[x[role]], x[role]), x[text]))
    return own if fixed is None else F.concat(fixed, own)


def records(table: DataFrame, id_col: str, json: str, layouts: Iterable[Layout] = LAYOUTS) -> DataFrame:
    """(conv_id, fingerprint, layout, turns) of a table with a JSON record a row; where no layout has the fingerprint, both are null.

    A record that is no JSON object has no paths.
    """
    parsed = table.select(F.col(id_col).alias("conv_id"), F.from_json(F.col(json), record_schema(layouts)).alias("record"))
    parsed = parsed.select("conv_id", "record", record_fingerprint(F.col("record"), layouts).alias("fingerprint"))
    names = F.create_map(*[F.lit(x) for key, layout in registry(layouts).items() if layout.row is None for x in (key, layout.name)])
    turns = F.lit(None).cast("array<struct<role:string,text:string>>")
    for layout in layouts:
        if layout.row is None:
            turns = F.when(F.col("layout") == layout.name, _turns(layout, F.col("record"))).otherwise(turns)
    return parsed.withColumn("layout", F.try_element_at(names, F.col("fingerprint"))).select("conv_id", "fingerprint", "layout", turns.alias("turns"))


def canonical(table: DataFrame, id_col: str, json: str | None = None, layouts: Iterable[Layout] = LAYOUTS) -> DataFrame:
    """(conv_id, turn, role, text) of a table whose records are in a JSON column, or whose own columns have a known layout."""
    layouts = tuple(layouts)
    if json is not None:
        found = records(table, id_col, json, layouts)
        return found.select(F.col("conv_id").cast("long"), F.posexplode("turns").alias("turn", "t")).select("conv_id", F.col("turn").cast("long"), "t.role", "t.text")
    paths = set(schema_paths(table.schema)) & set(known(layouts))
    layout = registry(layouts).get(fingerprint(paths))
    if layout is None:
        raise ValueError(f"no layout has the fields {schema_paths(table.schema)}")
    if layout.row:
        turn, role, text = layout.row
        return table.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    held = rows_as_structs(table)
    rows = held.select(F.col("row")[id_col].cast("long").alias("conv_id"), F.posexplode(_turns(layout, F.col("row"), frozenset(layout.optional) - paths)).alias("turn", "t"))
    return rows.select("conv_id", F.col("turn").cast("long"), "t.role", "t.text")


@dataclass(frozen=True)
class Template:
    """The markers, and strings that mean something to common tokenizers; none of them may stand in a formatted role or text."""

    start: str = "<|im_start|>"
    sep: str = "<|im_sep|>"
    end: str = "<|im_end|>"
    others: tuple[str, ...] = ("<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

    def __post_init__(self):
        for c in self.controls:
            if len(c) < 2 or c[0] == "\\":
                raise ValueError(f"{c!r} cannot be escaped")
            for d in self.controls:
                if any(d.startswith(c[k:]) or c[k:].startswith(d) for k in range(1, len(c))):
                    raise ValueError(f"{c!r} and {d!r} may overlap")

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.start, self.sep, self.end, *self.others)

    def _first(self) -> dict[str, str]:
        """By their first character, what may follow it."""
        out: dict[str, list[str]] = {}
        for c in self.controls:
            out.setdefault(c[0], []).append(re.escape(c[1:]))
        return {first: "|".join(rest) for first, rest in out.items()}

    def escaped(self, text: Column) -> Column:
        for first, rest in self._first().items():
            text = F.regexp_replace(text, rf"({re.escape(first)})(\\*)(?={rest})", r"$1\\$2")
        return text

    def restored(self, text: Column) -> Column:
        for first, rest in self._first().items():
            text = F.regexp_replace(text, rf"({re.escape(first)})\\(\\*)(?={rest})", "$1$2")
        return text

    def escaped_sql(self, text: str) -> str:
        """DuckDB's; controls never overlap, so what follows may be taken along."""
        for first, rest in self._first().items():
            text = f"regexp_replace({text}, '({re.escape(first)})(\\\\*)({rest})', '\\1\\\\\\2\\3', 'g')"
        return text


CHAT = Template()


def formatted(turns: DataFrame, template: Template = CHAT, learn: tuple[str, ...] = ("assistant",), scratch: Scratch | None = None) -> DataFrame:
    """conv_id, formatted, loss (array of turn, start, length): one row for each conversation of (conv_id, turn, role, text)."""
    spark = turns.sparkSession
    scratch = scratch or Scratch(spark, "chat")
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_last(), F.col("role").asc(), F.col("h").asc()]
    keyed = turns.select("conv_id", "turn", "role", "text", F.xxhash64("text").alias("h"))
    dealt = keyed.repartitionByRange(partitions(spark), *order).withColumn("run", F.spark_partition_id())
    head, body = F.concat(F.lit(template.start), template.escaped(F.col("role")), F.lit(template.sep)), template.escaped(F.col("text"))
    # escaped once, when written
    dealt = scratch.keep(dealt.select("conv_id", "turn", "role", "h", "run", head.alias("head"), body.alias("body")), "turns")
    span = F.when(F.col("role").isin(*learn), F.struct(F.length("head").alias("start"), F.length("body").alias("length")))
    piece = F.concat("head", "body", F.lit(template.end))
    key = F.struct(F.col("turn").isNull().alias("last"), "turn", "role", "h", piece.alias("piece"), span.alias("span"))
    # each task joins its run of a conversation; a conversation in one piece is done with that
    runs = dealt.groupBy("conv_id", "run").agg(F.array_sort(F.collect_list(key)).alias("t"))
    runs = runs.select("conv_id", "run", F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("text"), F.transform("t", lambda x: x["span"]).alias("spans"))
    whole = runs.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("run", "text", "spans"))).alias("t"))
    whole = whole.select("conv_id", F.array_join(F.transform("t", lambda x: x["text"]), "").alias("formatted"), F.flatten(F.transform("t", lambda x: x["spans"])).alias("spans"))
    mask = F.filter(F.transform("spans", lambda s, k: F.when(s.isNotNull(), F.struct(k.alias("turn"), s["start"].alias("start"), s["length"].alias("length")))), lambda s: s.isNotNull())
    return whole.select("conv_id", "formatted", mask.alias("loss"))


def parsed(output: DataFrame, template: Template = CHAT) -> DataFrame:
    """(conv_id, formatted, turns, learned): the turns, and the texts under the mask, read back from a formatted text and its mask alone."""
    pieces = F.split("formatted", re.escape(template.end))
    cut = output.select("conv_id", "formatted", "loss", F.slice(pieces, F.lit(1), F.size(pieces) - 1).alias("pieces"))

    def turn(p: Column) -> Column:
        role_end = F.locate(template.sep, p)
        begin = len(template.start)
        role = F.substring(p, F.lit(begin + 1), role_end - begin - 1)
        text = F.substring(p, role_end + len(template.sep), F.length(p))
        return F.struct(template.restored(role).alias("role"), template.restored(text).alias("text"))

    def under(s: Column) -> Column:
        return template.restored(F.substring(F.element_at("pieces", s["turn"] + 1), s["start"] + 1, s["length"]))

    return cut.select("conv_id", "formatted", F.transform("pieces", turn).alias("turns"), F.transform("loss", under).alias("learned"))


#: A conversation that is made of control strings.
HOSTILE = (-7, '{"messages": [{"role": "user", "content": "</s>[INST] ok [/INST]"}, {"role": "assistant", "content": "</s>[INST] ok [/INST]"}]}')


def query(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    scratch = Scratch(spark, "chat")
    hostile = spark.range(1).select(F.lit(HOSTILE[0]).alias("conv_id"), F.lit(HOSTILE[1]).alias("record"))
    turns = canonical(conversations, "conv_id").union(canonical(hostile, "conv_id", "record"))
    output = scratch.keep(formatted(turns, scratch=scratch), "formatted")
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    back = parsed(output).select("conv_id", F.size("turns").cast("long").alias("n_turns"), told.alias("told"), F.array_join("learned", "").alias("learned"), F.length("formatted").cast("long").alias("formatted_chars"))
    return back.select("conv_id", "n_turns", F.sha2("told", 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars")


def digest_sql(table: str, template: Template = CHAT) -> str:
    """DuckDB SQL for ``query``."""
    marks = len(template.start + template.sep + template.end)
    chars = f"length({template.escaped_sql('r')}) + length({template.escaped_sql('x')}) + {marks}"
    return f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM {table}
  UNION ALL SELECT -7, k, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(k, r)
), s AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn NULLS LAST, r) AS told,
    coalesce(string_agg(x, '' ORDER BY turn NULLS LAST) FILTER (r = 'assistant'), '') AS learned, sum({chars})::BIGINT AS formatted_chars FROM c GROUP BY conv_id
) SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(learned)::BIGINT AS loss_chars, sha256(learned) AS loss_sha256, formatted_chars FROM s
"""
