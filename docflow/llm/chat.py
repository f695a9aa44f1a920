"""Chat formatting: schema fingerprints choose declarative mappings to canonical turns.

Conversations come in many layouts: a row per turn, a list of messages under
various names, an instruction with its output, a prompt with its completion. The
paths of a layout's nested fields, sorted and hashed, are its fingerprint, which
selects a mapping: an expression that gives the array of canonical turns. Rows
of one DataFrame share its schema's fingerprint; rows of a JSON column have one
each. Only DataFrame expressions are used.

The template writes each turn as ``<s>role``, a line feed, the text and
``</s>``. Control strings inside roles and texts get ``\\c`` after their first
character and every backslash is written ``\\e``, which :func:`unescape` undoes,
so no text can open or close a turn. The loss mask covers assistant texts.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN = "struct<turn:bigint,role:string,text:string>"
#: Turns of a conversation that are formatted together.
PIECE = 64

# Control strings of the chat template and of common others, in
# two parts, by first character.
ANGLED = r"<(/?s>|<SYS>>|</SYS>>|\|)"
SQUARED = r"\[(/?INST\])"


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Sorted paths of the leaves of a nested type; ``[]`` steps into an array."""
    if isinstance(kind, T.StructType):
        return sorted(p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name.lower()}" if at else f.name.lower()))
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    return [at]


def fingerprint(paths: list[str]) -> str:
    """Hash of a set of field paths."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def _pair(*turns: tuple[str, str]) -> Column:
    """Turns from columns of one row; blank ones are left out."""
    made = F.array(*(F.struct(F.lit(k).cast("bigint").alias("turn"), F.lit(role).alias("role"), c.cast("string").alias("text")) for k, (role, c) in enumerate(turns)))
    return F.filter(made, lambda t: (t.role != "system") | (F.length(F.coalesce(t.text, F.lit(""))) > 0))


def _messages(name: str, role: str, text: str):
    return lambda c: F.transform(c(name), lambda m, k: F.struct(k.cast("bigint").alias("turn"), _role(m[role]).alias("role"), m[text].cast("string").alias("text")))


def _role(role: Column) -> Column:
    low = F.lower(role)
    return F.when(low.isin("human", "prompter", "customer"), "user").when(low.isin("gpt", "bot", "model", "ai"), "assistant").otherwise(role)


#: (fields below the conversation's id, mapping from a column getter to an array of turns)
LAYOUTS: dict[str, tuple[list[str], object]] = {
    "turn_rows": (["turn", "role", "text"], lambda c: F.array(F.struct(c("turn").cast("bigint").alias("turn"), c("role").alias("role"), c("text").alias("text")))),
    "messages": (["messages[].role", "messages[].content"], _messages("messages", "role", "content")),
    "share": (["conversations[].from", "conversations[].value"], _messages("conversations", "from", "value")),
    "instruction": (
        ["instruction", "input", "output"],
        lambda c: _pair(("user", F.concat_ws("\n\n", c("instruction"), F.when(F.length(c("input")) > 0, c("input")))), ("assistant", c("output"))),
    ),
    "instruction_only": (["instruction", "output"], lambda c: _pair(("user", c("instruction")), ("assistant", c("output")))),
    "prompt": (["prompt", "completion"], lambda c: _pair(("user", c("prompt")), ("assistant", c("completion")))),
    "system_prompt": (["system", "prompt", "response"], lambda c: _pair(("system", c("system")), ("user", c("prompt")), ("assistant", c("response")))),
    "question": (["question", "answer"], lambda c: _pair(("user", c("question")), ("assistant", c("answer")))),
}
BY_FINGERPRINT = {fingerprint(paths): name for name, (paths, _) in LAYOUTS.items()}


def layout_of(df: DataFrame, id: str = "conv_id") -> str:
    """Name of the layout whose fields ``df`` has.

    The exact fingerprint decides. With extra columns, the layout with the most
    fields among those whose every field is there is taken.
    """
    paths = [p for p in field_paths(df.schema) if p != id.lower()]
    found = BY_FINGERPRINT.get(fingerprint(paths))
    if found:
        return found
    fitting = [(len(fields), name) for name, (fields, _) in LAYOUTS.items() if set(fields) <= set(paths)]
    if not fitting:
        raise ValueError(f"no mapping for the fields {', '.join(sorted(paths))}")
    return max(fitting)[1]


def canonical_turns(df: DataFrame, id: str = "conv_id") -> DataFrame:
    """Rows (conv_id, turn, role, text) from any known layout; null roles and texts count as empty."""
    _, mapping = LAYOUTS[layout_of(df, id)]
    each = df.select(F.col(id).cast("bigint").alias("conv_id"), F.explode(mapping(lambda n: F.col(n))).alias("t"))
    return each.select("conv_id", "t.turn", F.coalesce("t.role", F.lit("")).alias("role"), F.coalesce("t.text", F.lit("")).alias("text"))


def record_layout(record: Column) -> Column:
    """Name of the layout that a JSON object's field paths select, null if none does.

    The exact fingerprint decides. With further fields, beside the layout's or
    inside its messages, the layout with the most fields among those whose every
    field is there is taken; for an empty list of messages the list's name is
    enough. As :func:`layout_of` does for a table.
    """

    def chosen(x: Column) -> Column:
        out = F.lit(None).cast("string")
        fitting = sorted(((len(p), name) for name, (p, _) in LAYOUTS.items() if name != "turn_rows"))
        for _, name in fitting:
            fields = LAYOUTS[name][0]
            bare = sorted({f.split("[]")[0] for f in fields if "[]" in f})
            has = F.size(F.array_except(F.array(*map(F.lit, fields)), x.paths)) == 0
            out = F.when(has | (F.arrays_overlap(x.empty, F.array(*map(F.lit, bare))) if bare else F.lit(False)), F.lit(name)).otherwise(out)
        exact = F.create_map(*(F.lit(v) for name, (p, _) in LAYOUTS.items() if name != "turn_rows" for v in (fingerprint(p), name)))
        return F.coalesce(F.element_at(exact, _hashed(x.paths)), out)

    return F.transform(F.array(_paths(record)), chosen)[0]


def json_turns(df: DataFrame, record: str = "record", id: str = "conv_id") -> DataFrame:
    """As :func:`canonical_turns` for a column of JSON objects, each with a layout of its own.

    Records of no known layout have no turns; :func:`json_layouts` counts them. A
    known layout with an empty list has none either. The table is read once.
    """
    types = {
        "messages": "messages array<struct<role:string,content:string>>",
        "share": "conversations array<struct<`from`:string,value:string>>",
    }
    marked = df.select(F.col(id).cast("bigint").alias("conv_id"), F.col(record).alias("r")).withColumn("layout", record_layout(F.col("r")))
    turns = F.lit(None).cast(f"array<{TURN}>")
    for name, (paths, mapping) in LAYOUTS.items():
        if name != "turn_rows":
            ddl = types.get(name) or ", ".join(f"{p} string" for p in paths)
            turns = F.when(F.col("layout") == name, _mapped(F.from_json("r", ddl), mapping)).otherwise(turns)
    out = marked.select("conv_id", F.explode(turns).alias("t"))
    return out.select("conv_id", "t.turn", F.coalesce("t.role", F.lit("")).alias("role"), F.coalesce("t.text", F.lit("")).alias("text"))


def _mapped(parsed: Column, mapping) -> Column:
    return F.transform(F.array(parsed), lambda j: mapping(lambda n: j[n]))[0]


def json_layouts(df: DataFrame, record: str = "record") -> DataFrame:
    """Rows (fingerprint, layout, records): what layouts a column of JSON objects has; layout is null if unknown."""
    each = df.select(record_fingerprint(F.col(record)).alias("fingerprint"), record_layout(F.col(record)).alias("layout"))
    return each.groupBy("fingerprint", "layout").agg(F.count("*").alias("records"))


def _paths(record: Column) -> Column:
    """Struct (paths, empty) of a JSON object: its field paths, two levels deep over all members of a list, and its empty lists."""
    listed = lambda v: F.from_json(v, "array<string>")
    pairs = F.map_entries(F.from_json(record, "map<string,string>"))

    def of(e: Column) -> Column:
        name, is_list = F.lower(e.key), F.startswith(F.ltrim(e.value), F.lit("["))
        inner = F.array_distinct(F.flatten(F.transform(listed(e.value), lambda m: F.coalesce(F.json_object_keys(m), F.array().cast("array<string>")))))
        below = F.transform(inner, lambda m: F.concat(name, F.lit("[]."), F.lower(m)))
        return F.when(is_list & (F.size(inner) > 0), below).otherwise(F.array(name))

    paths = F.array_sort(F.array_distinct(F.flatten(F.transform(pairs, of))))
    empty = F.transform(F.filter(pairs, lambda e: F.regexp_like(e.value, F.lit(r"^\s*\[\s*\]\s*$"))), lambda e: F.lower(e.key))
    return F.struct(F.when(F.json_object_keys(record).isNotNull(), paths).alias("paths"), F.when(F.json_object_keys(record).isNotNull(), empty).alias("empty"))


def _hashed(paths: Column) -> Column:
    return F.substring(F.sha2(F.array_join(paths, "\n").cast("binary"), 256), 1, 16)


def record_fingerprint(record: Column) -> Column:
    """Fingerprint of a JSON object's field paths, two levels deep over all members of a list; null if it is no object."""
    return _hashed(_paths(record).paths)


def escape(text: Column) -> Column:
    """``text`` without control strings, reversibly."""
    plain = F.replace(text, F.lit("\\"), F.lit("\\e"))
    return F.regexp_replace(F.regexp_replace(plain, ANGLED, r"<\\c$1"), SQUARED, r"[\\c$1")


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\c"), F.lit("")), F.lit("\\e"), F.lit("\\"))


def _role_text(role: Column) -> Column:
    """A role on one line: a line feed in it is written as a backslash and n."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def format_pieces(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, piece, n_turns, formatted, loss) from canonical turns.

    A piece holds the turns of ``PIECE`` consecutive turn numbers, so the turns of
    a very long conversation are gathered by the piece; a conversation is its
    pieces in order. Turns with equal numbers are ordered by role, then text;
    turns without a number come first and are one piece, as they have no order
    but that of their texts. ``loss`` has the (start, end) code points
    of assistant texts in ``formatted``, end exclusive.
    """
    piece = F.coalesce(F.floor(F.col("turn") / PIECE), F.lit(-(1 << 62))).cast("bigint")
    grouped = turns.withColumn("piece", piece).groupBy("conv_id", "piece").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    head = lambda t: F.concat(F.lit("<s>"), _role_text(t.role), F.lit("\n"))
    written = F.transform("turns", lambda t: F.struct(head(t).alias("head"), escape(t.text).alias("body"), (t.role == "assistant").alias("loss")))
    made = grouped.select("conv_id", "piece", F.size("turns").cast("long").alias("n_turns"), written.alias("w"))
    sizes = made.withColumn("sizes", F.transform("w", lambda x: F.length(x.head) + F.length(x.body) + 4))
    # Where turn k starts: bounded work, a piece has few turns.
    starts = F.transform("w", lambda x, k: F.aggregate(F.slice("sizes", F.lit(1), k), F.lit(0), lambda a, s: a + s))
    spans = F.zip_with(starts, F.col("w"), lambda at, x: F.struct((at + F.length(x.head)).alias("start"), (at + F.length(x.head) + F.length(x.body)).alias("end"), x.loss.alias("loss")))
    loss = F.transform(F.filter(spans, lambda s: s.loss), lambda s: F.struct(s.start.alias("start"), s.end.alias("end")))
    text = F.array_join(F.transform("w", lambda x: F.concat(x.head, x.body, F.lit("</s>"))), "")
    return sizes.select("conv_id", "piece", "n_turns", text.alias("formatted"), loss.alias("loss"))


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) read back from formatted turns."""
    parts = F.filter(F.split(formatted, "</s>", -1), lambda p: F.startswith(p, F.lit("<s>")))
    at = lambda p: F.instr(p, F.lit("\n"))
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape(F.replace(F.substring(p, F.lit(4), at(p) - 4), F.lit("\\n"), F.lit("\n"))).alias("role"),
            unescape(F.substring(p, at(p) + 1, F.length(p))).alias("text"),
        ),
    )


def chat_digest(turns: DataFrame) -> DataFrame:
    """A row per conversation, all read back from what :func:`format_pieces` wrote.

    conv_id, n_turns, turns_sha256 (role, line feed, text, line feed of each
    turn), loss_chars and loss_sha256 (text under the loss mask, unescaped), and
    formatted_chars. Only the pieces' texts meet at the conversation.
    """
    pieces = format_pieces(turns)
    read = pieces.select(
        "conv_id",
        "piece",
        F.length("formatted").cast("long").alias("chars"),
        read_turns(F.col("formatted")).alias("back"),
        F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s.start + 1, s.end - s.start))), "").alias("loss"),
    )
    flat = read.select(
        "conv_id",
        "piece",
        "chars",
        F.size("back").cast("long").alias("n"),
        F.array_join(F.transform("back", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "").alias("all"),
        "loss",
    )
    whole = flat.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.array_sort(F.collect_list(F.struct("piece", "all", "loss"))).alias("p"))
    text = lambda name: F.array_join(F.transform("p", lambda x: x[name]), "")
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2(text("all").cast("binary"), 256).alias("turns_sha256"),
        F.length(text("loss")).cast("long").alias("loss_chars"),
        F.sha2(text("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


#: The conversation that the query adds: its texts are made of control strings.
EXTRA = [(-7, [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")])]


def formatted_conversations(conversations: DataFrame) -> DataFrame:
    """Digest of all conversations and of conversation -7, which comes in the layout of a message list."""
    extra = conversations.sparkSession.createDataFrame(EXTRA, "conv_id bigint, messages array<struct<role:string,content:string>>")
    return chat_digest(canonical_turns(conversations).unionByName(canonical_turns(extra)))


ORACLE_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), written AS (
  SELECT *, regexp_replace(regexp_replace(replace(text, '\', '\e'), '<(/?s>|<SYS>>|</SYS>>|\|)', '<\\c\1', 'g'), '\[(/?INST\])', '[\\c\1', 'g') AS body,
    replace(regexp_replace(regexp_replace(replace(role, '\', '\e'), '<(/?s>|<SYS>>|</SYS>>|\|)', '<\\c\1', 'g'), '\[(/?INST\])', '[\\c\1', 'g'), chr(10), '\n') AS head
  FROM turns
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(head) + length(body) + 8)::BIGINT AS formatted_chars
FROM written GROUP BY conv_id
"""
