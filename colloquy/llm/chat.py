"""Chat formatting: heterogeneous layouts into canonical turns, turns into one marked text, and back.

A layout is known by a fingerprint: the hash of those of its nested field paths that any
declared mapping names, in order. The fingerprint selects the mapping. For typed columns it
comes from the schema, once; for JSON texts from each row, so that one column may mix layouts.
Everything here is DataFrame expressions; no Python runs on the executors.

The template is ``<|im_start|>role\\ntext<|im_end|>\\n`` for every turn. In a text, ``<`` followed
by any number of ``!`` and a ``|`` gets one ``!`` more, so no control string can arise in it and
the change can be undone exactly; roles are percent-encoded.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain, combinations

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>"
TURNS = "array<struct<role:string,text:string>>"
#: Names of the same role in different layouts.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}


@dataclass(frozen=True)
class Mapping:
    """One layout: its field paths, and where its turns are.

    ``many`` is an array of turns with fields ``role`` and ``text``, or ``rows`` says that each
    row is a turn of the conversation ``key``, in order of ``order``; else ``single`` lists
    (role, paths): the texts at the paths that are there, joined by an empty line.
    """

    name: str
    needed: tuple[str, ...]
    optional: tuple[str, ...] = ()
    many: str = ""
    role: str = ""
    text: str = ""
    order: str = ""
    key: str = ""
    single: tuple[tuple[str, tuple[str, ...]], ...] = ()

    def fingerprints(self) -> set[int]:
        extra = chain.from_iterable(combinations(self.optional, n) for n in range(len(self.optional) + 1))
        return {fingerprint({*self.needed, *some}) for some in extra}


MAPPINGS = (
    Mapping("turn rows", ("conv_id", "role", "text", "turn"), role="role", text="text", order="turn", key="conv_id"),
    Mapping("messages", ("messages[].content", "messages[].role"), ("system",), many="messages", role="role", text="content", single=(("system", ("system",)),)),
    Mapping("from and value", ("conversations[].from", "conversations[].value"), ("system",), many="conversations", role="from", text="value", single=(("system", ("system",)),)),
    Mapping("instruction", ("instruction", "output"), ("input", "system"), single=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("prompt and completion", ("completion", "prompt"), ("system",), single=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("prompt and response", ("prompt", "response"), ("system",), single=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("question and answer", ("answer", "question"), ("context",), single=(("user", ("context", "question")), ("assistant", ("answer",)))),
)
PATHS = sorted({p for m in MAPPINGS for p in (*m.needed, *m.optional)})


def fingerprint(paths: set[str]) -> int:
    """Hash of the paths that mappings name; the same number that Spark's xxhash64 gives."""
    value = xxhash.xxh64_intdigest("\n".join(p for p in PATHS if p in paths).encode(), 42)
    return value - (1 << 64) if value >> 63 else value


def schema_paths(kind: T.DataType, at: str = "") -> set[str]:
    """All nested field paths of a type; ``[]`` marks an array."""
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{at}[]")
    if not isinstance(kind, T.StructType):
        return {at}
    return set().union(*(schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name) for f in kind.fields)) if kind.fields else {at}


def select_mapping(schema: T.StructType) -> Mapping:
    """The mapping of the schema's fingerprint.

    A schema that mixes fields of several layouts has no mapping of its own; it gets the first
    one, in the order declared, all of whose needed fields it has.
    """
    known = {h: m for m in MAPPINGS for h in m.fingerprints()}
    have = schema_paths(schema)
    found = known.get(fingerprint(have)) or next((m for m in MAPPINGS if have.issuperset(m.needed)), None)
    if found is None:
        raise ValueError(f"no mapping for the layout {sorted(have)}")
    return found


def json_paths(value: Column) -> Column:
    """Those of PATHS that a parsed JSON row (VARIANT) has, null values too.

    An array has a path if any element has it, or if there is no element that could.
    """

    def there(path: str) -> Column:
        array, _, field = path.partition("[].")
        if not field:
            return F.try_variant_get(value, f"$.{path}", "variant").isNotNull()
        found = F.try_variant_get(value, f"$.{array}", "array<variant>")
        return F.coalesce((F.size(found) == 0) | F.exists(found, lambda e: F.try_variant_get(e, f"$.{field}", "variant").isNotNull()), F.lit(False))

    return F.array_compact(F.array(*(F.when(there(p), F.lit(p)) for p in PATHS)))


def json_text(value: Column, path: str) -> Column:
    """The string at a path of a VARIANT; anything else but null as its JSON text."""
    found = F.try_variant_get(value, path, "variant")
    return F.when(F.is_variant_null(found), F.lit(None)).otherwise(F.coalesce(F.try_variant_get(value, path, "string"), F.to_json(found)))


def json_mapping(paths: Column) -> Column:
    """Name of the mapping of each row: by the fingerprint of its paths, else as for schemas."""
    h, named = F.xxhash64(F.array_join(paths, "\n")), F.lit(None).cast("string")
    usable = [m for m in MAPPINGS if not m.key]
    for m in reversed(usable):
        named = F.when(F.size(F.array_except(F.array(*map(F.lit, m.needed)), paths)) == 0, m.name).otherwise(named)
    for m in usable:
        named = F.when(h.isin(sorted(m.fingerprints())), m.name).otherwise(named)
    return named


def canonical_role(role: Column) -> Column:
    named = F.lower(role)
    return F.coalesce(F.coalesce(*(F.when(named == k, F.lit(v)) for k, v in ROLES.items())), role, F.lit(""))


def turn(role: Column, text: Column) -> Column:
    return F.struct(role.alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def mapped_turns(mapping: Mapping, get) -> Column:
    """Turns of a mapping that isn't by rows; ``get`` gives the column of a path, null where there is none."""
    parts = []
    for role, paths in mapping.single:
        texts = F.array_compact(F.array(*(get(p).cast("string") for p in paths)))
        spoken = F.array(turn(F.lit(role), F.array_join(texts, "\n\n")))
        # A side text that isn't there makes no turn; question and answer always make one.
        parts.append(F.when(F.size(texts) > 0, spoken).otherwise(F.lit(None).cast(TURNS)) if set(paths) <= set(mapping.optional) else spoken)
    if mapping.many:
        parts.append(F.transform(get(mapping.many), lambda t: turn(canonical_role(t[mapping.role].cast("string")), t[mapping.text].cast("string"))))
    return F.flatten(F.array_compact(F.array(*parts))).cast(TURNS)


def canonical_turns(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Rows (id, turns) of a typed table, whose schema's fingerprint selects the mapping.

    Tables by turn are grouped by conversation, turns in order of their number, nulls first, and
    equal ones by role and text; repeated rows are turns of their own, a null id is a conversation
    of its own. Null texts and roles become empty; columns that no mapping names are ignored. An
    empty table gives no rows. One conversation is one row, as large as its texts.
    """
    mapping = select_mapping(df.schema)
    if mapping.key:
        fields = (mapping.order, F.coalesce(F.col(mapping.role), F.lit("")).alias("role"), F.coalesce(F.col(mapping.text), F.lit("")).alias("text"))
        grouped = df.groupBy(F.col(mapping.key).alias(id_col)).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("t"))
        return grouped.select(id_col, F.transform("t", lambda t: turn(t["role"], t["text"])).alias("turns"))
    have = schema_paths(df.schema) | {f.name for f in df.schema.fields}
    return df.select(id_col, mapped_turns(mapping, lambda p: F.col(p) if p in have else F.lit(None)).alias("turns"))


def canonical_turns_json(df: DataFrame, json_col: str, id_col: str) -> DataFrame:
    """Rows (id, layout, turns) of a column of JSON texts that may mix layouts.

    ``layout`` is the mapping's name; it and ``turns`` are null where no mapping fits or the text
    is no JSON object, so that such rows can be counted and kept. Null texts are empty turns, an
    empty array has no turns, and a text that is an object or array is kept as JSON. Fields of
    other layouts than the one selected are no turns.
    """
    parsed = df.select(F.col(id_col), F.try_parse_json(F.col(json_col)).alias("v"))
    read = parsed.withColumn("layout", json_mapping(json_paths(F.col("v"))))
    turns = F.lit(None).cast(TURNS)
    for mapping in MAPPINGS:
        if mapping.key:
            continue

        def get(path: str, m: Mapping = mapping) -> Column:
            if path == m.many:
                each = F.try_variant_get("v", f"$.{path}", "array<variant>")
                return F.transform(each, lambda e: F.struct(json_text(e, f"$.{m.role}").alias(m.role), json_text(e, f"$.{m.text}").alias(m.text)))
            return json_text(F.col("v"), f"$.{path}")

        turns = F.when(F.col("layout") == mapping.name, mapped_turns(mapping, get)).otherwise(turns)
    return read.select(id_col, "layout", turns.alias("turns"))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(!*)\|", r"<!$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<!(!*)\|", r"<$1|")


def format_turns(turns: Column) -> Column:
    """One text with every turn marked."""
    marked = F.transform(turns, lambda t: F.concat(F.lit(START), F.url_encode(t["role"]), F.lit("\n"), escape(t["text"]), F.lit(END + "\n")))
    return F.array_join(marked, "")


def loss_runs(turns: Column) -> Column:
    """The loss mask of the formatted text as runs (chars, learn): assistants' texts are learned."""
    runs = F.transform(
        turns,
        lambda t: F.array(
            F.struct((F.length(F.url_encode(t["role"])) + len(START) + 1).alias("chars"), F.lit(False).alias("learn")),
            F.struct(F.length(escape(t["text"])).alias("chars"), (t["role"] == "assistant").alias("learn")),
            F.struct(F.lit(len(END) + 1).alias("chars"), F.lit(False).alias("learn")),
        ),
    )
    return F.flatten(runs)


def learned_text(formatted: Column, runs: Column) -> Column:
    """All text of a formatted text under its loss mask, unescaped, nothing between.

    A turn has three runs. The text is cut at the turns' starts first, so that places are
    counted within a turn and the work stays in proportion to the text.
    """
    pieces = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda p: p != "")

    def learned(piece: Column, i: Column) -> Column:
        before = [F.get(runs, 3 * i + k)["chars"] for k in range(3)]
        at = [F.lit(1), before[0] - len(START) + 1, before[0] + before[1] - len(START) + 1]
        chars = [before[0] - len(START), before[1], before[2]]
        parts = (F.when(F.get(runs, 3 * i + k)["learn"], F.substring(piece, at[k], chars[k])).otherwise("") for k in range(3))
        return unescape(F.concat(*parts))

    return F.array_join(F.transform(pieces, learned), "")


def parse_formatted(formatted: Column) -> Column:
    """The turns of a formatted text."""
    pieces = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda p: p != "")

    def read(piece: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        text = F.substring(piece, F.length(role) + 2, F.length(piece) - F.length(role) - (len(END) + 2))
        return turn(F.url_decode(role), unescape(text))

    return F.transform(pieces, read)


def format_chats(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Rows (id, formatted, loss_runs) of a typed table in any known layout."""
    return canonical_turns(df, id_col).select(id_col, format_turns(F.col("turns")).alias("formatted"), loss_runs(F.col("turns")).alias("loss_runs"))
