"""Chat formatting: layouts are recognised by a hash of their nested field paths.

A record's layout is its set of nested field paths, without types or order; the fingerprint is the
hash of that set. LAYOUTS says, as data, which paths a layout requires and how its fields become canonical
turns (role, text): which array holds the turns and which of its fields are role and text, or which plain
fields are turns of which role. Of the layouts whose paths a record has, the most specific one counts, so extra
fields do no harm. That choice is kept in a table from fingerprint to mapping: each new fingerprint is matched with LAYOUTS once,
and records and tables find their mapping by the hash. Text that comes as a list of parts is their
texts in order. Records of an unknown layout are returned with no turns and their fingerprint, so that none is
lost and a layout can be added. A table has the fingerprint of its schema, JSON text one for each record.

The template writes a turn as <|role|>, a line feed, the text and <|end|>. Control strings inside
texts (those of this template and of common others) get a backslash behind their first character, in
addition to any that are there, so unescaping restores every text. The loss mask covers the texts of
assistant turns.

Null text is empty, a null role is the empty role, turns are ordered by turn number (null first) and
then by role and text. Repeated rows are turns of their own. A null conv_id is a conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.llm.common import table

#: Layouts by the field paths that they require. "turns" is the array of turns (empty: the record itself).
LAYOUTS: list[tuple[list[str], dict]] = [
    (["conv_id", "role", "text", "turn"], {"row": ("role", "text")}),
    (["messages[].content", "messages[].role"], {"turns": "messages", "role": "role", "text": "content"}),
    (["conversations[].from", "conversations[].value"], {"turns": "conversations", "role": "from", "text": "value"}),
    (["[].content", "[].role"], {"turns": "", "role": "role", "text": "content"}),
    (["instruction", "output"], {"fields": [("user", ["instruction"]), ("assistant", ["output"])]}),
    (["input", "instruction", "output"], {"fields": [("user", ["instruction", "input"]), ("assistant", ["output"])]}),
    (["prompt", "response"], {"fields": [("user", ["prompt"]), ("assistant", ["response"])]}),
    (["prompt", "completion"], {"fields": [("user", ["prompt"]), ("assistant", ["completion"])]}),
    (["prompt", "response", "system"], {"fields": [("system", ["system"]), ("user", ["prompt"]), ("assistant", ["response"])]}),
    (["answer", "question"], {"fields": [("user", ["question"]), ("assistant", ["answer"])]}),
]
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


def layout_of(paths: list[str]) -> int | None:
    """Which of LAYOUTS counts for a record of such paths: the one that requires most, the first of equals."""
    has = lambda p: any(x == p or x.startswith((f"{p}[]", f"{p}.")) for x in paths)
    fit = [(-len(need), i) for i, (need, _) in enumerate(LAYOUTS) if all(map(has, need))]
    return min(fit)[1] if fit else None


CONTROL = r"/?s>|\|[A-Za-z_]+\|>|/?INST\]|<SYS>>|</SYS>>"
_ESCAPE, _UNESCAPE = rf"([<\[])(\\*)({CONTROL})", rf"([<\[])\\(\\*)({CONTROL})"


def schema_paths(schema: T.DataType, at: str = "") -> list[str]:
    """Nested field paths of a Spark type; [] marks an array."""
    if isinstance(schema, T.ArrayType):
        return schema_paths(schema.elementType, f"{at}[]")
    if isinstance(schema, T.StructType):
        return [p for f in schema for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    return [at]


class Mappings:
    """A table from fingerprint to the number of a layout, or None; MOST fingerprints are kept, the oldest go first."""

    MOST = 100_000

    def __init__(self):
        self.known: dict[str, int | None] = {fingerprint(need): i for i, (need, _) in enumerate(LAYOUTS)}
        self.matched = 0  # fingerprints that weren't in the table

    def of(self, paths: list[str]) -> tuple[str, int | None]:
        key = fingerprint(paths)
        if key not in self.known:
            if len(self.known) >= self.MOST:
                del self.known[next(iter(self.known))]
            self.known[key] = layout_of(paths)
            self.matched += 1
        return key, self.known[key]


#: Of this process: the driver's for tables, each worker's for records.
MAPPINGS = Mappings()

_TOKEN = re.compile(r"`((?:[^`]|``)*)`: |([^<>,`: ]+): |(OBJECT|ARRAY)<|>|, |[A-Z_]+(?:\([\d,]+\))?")


def variant_paths(schema: str) -> list[str]:
    """Nested field paths of what schema_of_variant says; an empty object or array is a path itself."""
    out: list[str] = []
    open_: list[list] = [["", False, True]]  # path, whether it is an array, whether nothing is in it yet
    name = ""
    for m in _TOKEN.finditer(schema):
        path, in_array, _ = open_[-1]
        at = path + "[]" if in_array else f"{path}.{name}" if path and name else path + name
        if m[1] is not None or m[2]:
            name = m[1].replace("``", "`") if m[1] is not None else m[2]
        elif m[3]:
            open_[-1][2] = False
            open_.append([at, m[3] == "ARRAY", True])
            name = ""
        elif m[0] == ">":
            if len(open_) > 1 and open_.pop()[2]:
                out.append(path)
        elif m[0] != ", ":
            open_[-1][2] = False
            out.append(at)
    return out


def _recognised(schema: Column) -> Column:
    """Fingerprint of a variant's schema, hashed once for each different schema of a batch, and the layout under that fingerprint."""

    def run(schemas: pd.Series) -> pd.DataFrame:
        known = {s: MAPPINGS.of(variant_paths(s)) for s in schemas.dropna().unique()}
        rows = [known.get(s, (None, None)) for s in schemas]
        return pd.DataFrame({"fingerprint": pd.Series([r[0] for r in rows], dtype="object"), "layout": pd.array([r[1] for r in rows], "Int32")})

    return F.pandas_udf(run, T.StructType().add("fingerprint", T.StringType()).add("layout", T.IntegerType()))(schema)


def _role(c: Column) -> Column:
    named = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    return F.coalesce(named[F.lower(c)], F.lower(c), F.lit(""))


def _text(v: Column) -> Column:
    """A variant as text: of a list, the texts of its parts in order; a part without text is its JSON."""
    part = lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.try_variant_get(p, "$", "string"), F.lit(""))
    parts = F.try_variant_get(v, "$", "array<variant>")
    return F.when(parts.isNotNull(), F.array_join(F.transform(parts, part), "")).otherwise(F.coalesce(F.try_variant_get(v, "$", "string"), F.lit("")))


def _turn(m: dict):
    return lambda t: F.struct(_role(F.try_variant_get(t, f"$.{m['role']}", "string")).alias("role"), _text(F.try_variant_get(t, f"$.{m['text']}", "variant")).alias("text"))


TURNS = "array<struct<role:string,text:string>>"


def turns_of_json(df: DataFrame, col: str) -> DataFrame:
    """Adds layout (fingerprint, null for text that isn't JSON) and turns array<struct<role, text>>."""
    get = lambda path, kind: F.try_variant_get(F.col("__v"), path, kind)
    plain = lambda p: F.nullif(_text(get(f"$.{p}", "variant")), F.lit(""))
    turns = F.lit(None)
    for i, (_, m) in enumerate(LAYOUTS):
        if "turns" in m:
            many = get(f"$.{m['turns']}" if m["turns"] else "$", "array<variant>")
            made = F.transform(many, _turn(m))
        elif "fields" in m:
            made = F.array(*[F.struct(F.lit(role).alias("role"), F.concat_ws("\n", *map(plain, paths)).alias("text")) for role, paths in m["fields"]])
        else:
            role, text = m["row"]
            made = F.array(F.struct(_role(get(f"$.{role}", "string")).alias("role"), F.coalesce(plain(text), F.lit("")).alias("text")))
        turns = F.when(F.col("__l.layout") == i, made.cast(TURNS)).otherwise(turns)
    out = df.withColumn("__v", F.try_parse_json(F.col(f"`{col}`").cast("string"))).withColumn("__l", _recognised(F.schema_of_variant("__v")))
    return out.withColumn("layout", F.col("__l.fingerprint")).withColumn("turns", F.coalesce(turns, F.array().cast(TURNS))).drop("__v", "__l")


def turn_rows(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of a table of any known layout, by its schema's fingerprint.

    A table of a turn per row is taken as it is. Of a table of a conversation per row, conv_id is the column of that
    name or a number of the row, turn the place in it; roles then get their canonical names.
    """
    paths = schema_paths(df.schema)
    name, found = MAPPINGS.of(paths)
    if found is None:
        raise ValueError(f"no mapping for a table with fields {paths} (fingerprint {name})")
    mapping = LAYOUTS[found][1]
    if "row" in mapping:
        role, text = mapping["row"]
        return df.select("conv_id", "turn", F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    number = F.col("conv_id").cast("long") if "conv_id" in df.columns else F.monotonically_increasing_id()
    records = turns_of_json(df.select(number.alias("conv_id"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("__json")), "__json")
    return records.select("conv_id", F.posexplode("turns").alias("turn", "t")).select("conv_id", "turn", "t.role", "t.text")


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"$1\\$2$3")


def unescaped(text: str) -> str:
    return re.sub(_UNESCAPE, r"\1\2\3", text)


def escaped_role(role: Column) -> Column:
    """Also without |>, which ends a role."""
    return F.regexp_replace(escaped(role), r"\|(\\*)>", r"|\\$1>")


def format_turns(turns: DataFrame) -> DataFrame:
    """The formatted pieces of conversations: (conv_id, turn, piece, loss_start, loss_end).

    A conversation's formatted text is its pieces in order; partitions hold whole conversations, in
    order, so that even one that has no end needs no more memory than a piece. Offsets are code
    points in the piece; they are equal where nothing is learned.
    """
    body = escaped(F.col("text"))
    head = F.concat(F.lit("<|"), escaped_role(F.col("role")), F.lit("|>\n"))
    start = F.length(head)
    learn = F.col("role") == "assistant"
    pieces = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return pieces.select("conv_id", "turn", F.concat(head, body, F.lit("<|end|>")).alias("piece"), start.alias("loss_start"), F.when(learn, start + F.length(body)).otherwise(start).alias("loss_end"))


def parsed(piece: str) -> tuple[str, str]:
    """Role and text of a formatted piece."""
    role, _, rest = piece[2:].partition("|>\n")
    return unescaped(re.sub(r"\|\\(\\*)>", r"|\1>", role)), unescaped(rest.removesuffix("<|end|>"))


DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def digests(pieces: DataFrame) -> DataFrame:
    """Reads formatted conversations back, piece by piece: one row of digests for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        state: list = []

        def row() -> tuple:
            return (now[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(DIGESTS)], schema=DIGESTS)

        for batch in batches:
            out = []
            for conv_id, piece, start, end in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "piece", "loss_start", "loss_end")), strict=True):
                if now != (conv_id,):
                    if now is not None:
                        out.append(row())
                    now, state = (conv_id,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = parsed(piece)
                learned = unescaped(piece[start:end])
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(learned)
                state[3].update(learned.encode())
                state[4] += len(piece)
            yield made(out)
        if now is not None:
            yield made([row()])

    return pieces.select(F.col("conv_id").cast("long"), "piece", "loss_start", "loss_end").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op3_chat_formatting(spark, sf_dir: str) -> DataFrame:
    tricky = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").cast("int").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return digests(format_turns(turn_rows(table(spark, sf_dir, "conversations").unionByName(tricky, allowMissingColumns=True))))


def mixed_records(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, record): each turn as JSON text, in one of four layouts by its number and conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.struct(role.alias("role"), text.alias("content"))
    kinds = [F.to_json(F.struct(F.array(turn).alias("messages"))), F.to_json(F.array(turn)), F.to_json(F.struct(F.lit(1).alias("version"), F.array(F.struct(role.alias("from"), text.alias("value"))).alias("conversations"))), F.to_json(F.struct(F.array(F.struct(F.lit("n").alias("name"), role.alias("role"), F.array(text).alias("content"))).alias("messages"), F.lit("x").alias("source")))]
    which = F.pmod(F.coalesce("conv_id", F.lit(0)) + F.coalesce("turn", F.lit(0)), F.lit(len(kinds)))
    return turns.select("conv_id", "turn", F.coalesce(*[F.when(which == i, k) for i, k in enumerate(kinds)]).alias("record"))


def chat_mixed_layouts(spark, sf_dir: str) -> DataFrame:
    """Conversations whose turns come as records of several layouts, each converted by its fingerprint, then formatted and read back."""
    records = turns_of_json(mixed_records(table(spark, sf_dir, "conversations")), "record")
    turns = records.select("conv_id", "turn", F.explode("turns").alias("t")).select("conv_id", "turn", "t.role", "t.text")
    return digests(format_turns(turns)).select("conv_id", "n_turns", "turns_sha256", "loss_chars")


MIXED_SQL = """
WITH t AS (SELECT conv_id, turn, CASE lower(role) WHEN 'human' THEN 'user' WHEN 'prompter' THEN 'user' WHEN 'gpt' THEN 'assistant' WHEN 'bot' THEN 'assistant' WHEN 'model' THEN 'assistant' ELSE coalesce(lower(role), '') END AS role, coalesce(text, '') AS text FROM conversations)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars FROM t GROUP BY conv_id
"""


def _sql() -> str:
    esc = lambda c: f"regexp_replace({c}, '{_ESCAPE}', '\\1\\\\\\2\\3', 'g')"
    role = rf"regexp_replace({esc('role')}, '\|(\\*)>', '|\\\1>', 'g')"
    return f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
  string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant') AS loss,
  sum(length({role}) + length({esc('text')}) + length('<||>') + 1 + length('<|end|>'))::BIGINT AS formatted_chars FROM t GROUP BY conv_id)
SELECT conv_id, n_turns::BIGINT AS n_turns, sha256(turns) AS turns_sha256, length(coalesce(loss, ''))::BIGINT AS loss_chars, sha256(coalesce(loss, '')) AS loss_sha256, formatted_chars FROM g
"""


OP3_SQL = _sql()
