"""Chat formatting: layouts are told by a fingerprint of their field paths and mapped to canonical turns. DataFrame functions only.

Records of a table, or JSON texts of a column, come in layouts of many kinds. The sorted paths of their nested fields are hashed;
the fingerprint selects a declarative mapping that says where roles and texts are. The canonical turns of a conversation are
then written in a template whose control strings can't occur in a text, and read back from it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltspan.tables import table


@dataclass(frozen=True)
class Layout:
    """A mapping: `paths` are the nested fields it is for ([] marks a list), `turns` are (role, path of the text) in order.

    A list of messages has instead the path of the list and the fields of role and text in it. A table with a row for each turn
    has neither: its rows have the fields `role` and `text` and the place `turn`.
    """

    name: str
    paths: tuple[str, ...]
    turns: tuple[tuple[str, str], ...] = ()
    messages: str | None = None
    role: str = "role"
    text: str = "text"
    turn: str | None = None


#: The known layouts. Fields beside these (a key, counts) aren't part of a fingerprint.
LAYOUTS = (
    Layout("rows", ("role", "text", "turn"), turn="turn"),
    Layout("prompt_response", ("prompt", "response"), (("user", "prompt"), ("assistant", "response"))),
    Layout("prompt_completion", ("completion", "prompt"), (("user", "prompt"), ("assistant", "completion"))),
    Layout("system_prompt_response", ("prompt", "response", "system"), (("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("question_answer", ("answer", "question"), (("user", "question"), ("assistant", "answer"))),
    Layout("instruction", ("instruction", "output"), (("user", "instruction"), ("assistant", "output"))),
    Layout("instruction_input", ("input", "instruction", "output"), (("system", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout("messages", ("messages[].content", "messages[].role"), messages="messages", text="content"),
    Layout("conversations", ("conversations[].from", "conversations[].value"), messages="conversations", role="from", text="value"),
)
#: Other names of the roles.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

#: The template. Each role's turn begins and ends with these; another role's name stands between OPEN and NAMED.
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", "</s>"), "system": ("<<SYS>> ", " <</SYS>>")}
OPEN, NAMED, CLOSE = "<|role|>", "<|text|>", "<|end|>"
#: A bracket, the backslashes after it, and the rest of a control string: a backslash more is put in, and taken out on reading.
CONTROL = r"(/?s>|</?SYS>>|/?SYS>>|/?INST\]|\|role\|>|\|text\|>|\|end\|>)"
TURN = "struct<turn:bigint,role:string,text:string>"


def paths(kind: T.DataType, at: str = "") -> list[str]:
    """The paths of the nested fields of a type."""
    if isinstance(kind, T.ArrayType):
        return paths(kind.elementType, f"{at}[]")
    if isinstance(kind, T.StructType):
        return sorted(p for f in kind for p in paths(f.dataType, f"{at}.{f.name}" if at else f.name))
    return [at]


def hashed(names: list[str] | tuple[str, ...]) -> Column:
    """The fingerprint of a set of paths."""
    return F.xxhash64(F.array_join(F.array_sort(F.array(*map(F.lit, names))), "\n"))


def layout_of(df: DataFrame, keys: list[str]) -> Layout:
    """The layout of a table: the one with the most fields of those whose fields are all there (the first of LAYOUTS of ties), by the fingerprint of these fields.

    Other fields, also such as another layout has, don't count.
    """
    found = {p for p in paths(T.StructType([f for f in df.schema if f.name not in keys]))}
    prints = df.sparkSession.range(1).select(*(hashed(sorted(found.intersection(x.paths))).alias(f"own_{x.name}") for x in LAYOUTS), *(hashed(x.paths).alias(x.name) for x in LAYOUTS)).first()
    fit = [x for x in LAYOUTS if prints[x.name] == prints[f"own_{x.name}"]]
    if not fit:
        raise ValueError(f"no layout has the fields {', '.join(sorted(found)) or '(none)'}")
    # a row for each turn is told by its place, so it goes before layouts of whole conversations
    return max(fit, key=lambda x: (x.turn is not None, len(x.paths)))


def has_path(variant: Column, path: str) -> Column:
    """Whether a JSON record has a field of this path; an empty list has the fields of its elements."""
    head, _, tail = path.partition("[].")
    found = F.try_variant_get(variant, f"$.{head}", "variant").isNotNull()
    if not tail:
        return found
    listed = F.try_variant_get(variant, f"$.{head}", "array<variant>")
    return F.coalesce((F.size(listed) == 0) | F.try_variant_get(variant, f"$.{head}[0].{tail}", "variant").isNotNull(), F.lit(False)) & listed.isNotNull()


def json_fingerprint(variant: Column, known: tuple[str, ...]) -> Column:
    """The fingerprint of those of the known paths that a JSON record has; its other fields don't count."""
    return F.xxhash64(F.array_join(F.array_sort(F.array_compact(F.array(*(F.when(has_path(variant, p), F.lit(p)) for p in known)))), "\n"))


def canonical_role(role: Column) -> Column:
    lower = F.coalesce(role, F.lit(""))
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in ROLE_NAMES.items() for x in pair)), lower), lower)


def message_turns(own: Layout, messages: Column) -> Column:
    """The turns in a list of messages; other names of a role become its canonical name."""
    return F.transform(messages, lambda m, i: F.struct(i.cast("long").alias("turn"), canonical_role(m[own.role]).alias("role"), F.coalesce(m[own.text], F.lit("")).alias("text")))


def field_turns(own: Layout, get: Callable[[str], Column]) -> Column:
    """The turns in the fields of a record."""
    return F.array(*(F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.coalesce(get(p), F.lit("")).alias("text")) for i, (r, p) in enumerate(own.turns)))


def json_turns(df: DataFrame, key: str, record: str) -> DataFrame:
    """(key, turns, layout) of a column of JSON texts, each row by its own fingerprints: of the layouts whose fields it has all, that with the most.

    A record of no known layout, or no JSON, has null turns; other fields of a record and an empty list of messages are no hindrance.
    """
    variant = F.try_parse_json(record)
    df = df.select(F.col(key).alias("key"), variant.alias("v"))
    get = lambda path, kind="string": F.try_variant_get("v", f"$.{path}", kind)
    turns, name = F.lit(None).cast(f"array<{TURN}>"), F.lit(None).cast("string")
    for own in sorted(LAYOUTS[::-1], key=lambda x: len(x.paths)):  # a later one that fits takes the place of an earlier
        if own.turn:
            continue
        if own.messages:
            listed = get(own.messages, f"array<struct<{own.role}:string,{own.text}:string>>")
            mapped = message_turns(own, listed)
        else:
            mapped = field_turns(own, get)
        fits = json_fingerprint(F.col("v"), own.paths) == hashed(own.paths)
        turns, name = F.when(fits, mapped.cast(f"array<{TURN}>")).otherwise(turns), F.when(fits, F.lit(own.name)).otherwise(name)
    return df.select(F.col("key").alias(key), turns.alias("turns"), name.alias("layout"))


def canonical_turns(df: DataFrame, key: str) -> DataFrame:
    """(key, turns, layout) of a table in any known layout: one row per conversation, its turns in order.

    Rows of a table of turns are gathered by key (ties by role and text; repeated rows stay); a null text or role counts as
    empty. Extra columns are left alone, also those named like another layout's fields; an empty table has no conversations. A
    conversation is one row, whatever its length: its digest needs all its turns in order.
    """
    own = layout_of(df, [key])
    if own.turn:
        one = F.struct(F.col(own.turn).cast("long").alias("turn"), F.coalesce(F.col(own.role), F.lit("")).alias("role"), F.coalesce(F.col(own.text), F.lit("")).alias("text"))
        out = df.select(F.col(key), one.alias("one")).groupBy(key).agg(F.sort_array(F.collect_list("one")).alias("turns"))
    elif own.messages:
        out = df.select(key, message_turns(own, F.col(own.messages)).alias("turns"))
    else:
        out = df.select(key, field_turns(own, F.col).alias("turns"))
    return out.select(key, F.col("turns").cast(f"array<{TURN}>").alias("turns"), F.lit(own.name).alias("layout"))


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*){CONTROL}", r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*){CONTROL}", "$1$2$3")


def written(turns: Column) -> Column:
    """The turns in the template."""

    def one(t: Column) -> Column:
        out = F.concat(F.lit(OPEN), escaped(t["role"]), F.lit(NAMED), escaped(t["text"]), F.lit(CLOSE))
        for role, (begin, end) in MARKS.items():
            out = F.when(t["role"] == role, F.concat(F.lit(begin), escaped(t["text"]), F.lit(end))).otherwise(out)
        return out

    return F.array_join(F.transform(turns, one), "")


def read_back(formatted: Column) -> Column:
    """The turns in a formatted text, as an array of (role, text), unescaped."""
    quote = lambda s: "".join("\\" + c if c in "[]|\\" else c for c in s)
    spans = [f"{quote(a)}.*?{quote(b)}" for a, b in (*MARKS.values(), (OPEN, CLOSE))]
    parts = F.regexp_extract_all(formatted, F.lit(f"(?s)({'|'.join(spans)})"), F.lit(1))

    def one(part: Column) -> Column:
        body = F.substring(part, len(OPEN) + 1, F.length(part) - len(OPEN) - len(CLOSE))
        role, text = F.substring_index(body, NAMED, 1), F.substring(body, F.length(F.substring_index(body, NAMED, 1)) + len(NAMED) + 1, F.length(body))
        out = F.struct(unescaped(role).alias("role"), unescaped(text).alias("text"))
        for name, (begin, end) in MARKS.items():
            inner = F.substring(part, len(begin) + 1, F.length(part) - len(begin) - len(end))
            out = F.when(part.startswith(begin), F.struct(F.lit(name).alias("role"), unescaped(inner).alias("text"))).otherwise(out)
        return out

    return F.transform(parts, one)


def format_chats(conversations: DataFrame, key: str) -> DataFrame:
    """Adds `formatted` to (key, turns): the text a model is trained on; its loss mask is the text of the assistant's turns."""
    return conversations.withColumn("formatted", written(F.col("turns")))


def digest(formatted: DataFrame, key: str) -> DataFrame:
    """What reading a formatted text back gives: its turns, and the text under the loss mask."""
    back = formatted.select(key, "formatted", read_back(F.col("formatted")).alias("back"))
    lines = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("back", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    found = back.select(key, "formatted", F.size("back").cast("long").alias("n_turns"), lines.alias("lines"), loss.alias("loss"))
    return found.select(
        key, "n_turns", F.sha2("lines", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -1, which comes as a JSON record in another layout."""
    turns = canonical_turns(table(spark, sf_dir, "conversations"), "conv_id")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.to_json(F.struct(F.lit(said).alias("prompt"), F.lit(said).alias("response"))).alias("record"))
    return digest(format_chats(turns.unionByName(json_turns(extra, "conv_id", "record")), "conv_id"), "conv_id")


ORACLE_SQL = r"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
safe AS (SELECT *, regexp_replace(text, '([<\[])(\\*)(/?s>|</?SYS>>|/?SYS>>|/?INST\]|\|role\|>|\|text\|>|\|end\|>)', '\1\\\2\3', 'g') AS t,
  regexp_replace(role, '([<\[])(\\*)(/?s>|</?SYS>>|/?SYS>>|/?INST\]|\|role\|>|\|text\|>|\|end\|>)', '\1\\\2\3', 'g') AS r FROM rows),
marked AS (SELECT *, CASE role WHEN 'user' THEN length(t) + 15 WHEN 'assistant' THEN length(t) + 8 WHEN 'system' THEN length(t) + 17 ELSE length(r) + length(t) + 23 END AS n FROM safe)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, sum(n)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""
