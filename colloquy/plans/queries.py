"""Registered transcript queries and the SQL that must give the same rows.

The driver's tables hold no chat exports, so ``conversations`` is rendered into transcript lines
first, one file for each conversation; markers that the texts lack (notices, deletions, fences,
unreadable answers) are put in by rules that both sides state. ``events`` gives long histories.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions.grammar import captures
from colloquy.functions.text import strip
from colloquy.operators import messages as M
from colloquy.operators import responses as R
from colloquy.operators.chunks import chunked, prompts
from colloquy.operators.spans import scanned, written_entries
from colloquy.plans.profiles import INSIGHTS, ITEMS, Profile
from colloquy.sources.exports import stem
from colloquy.sources.members import read_transcripts, write_archives
from colloquy.sources.shared import scratch_path

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))


def header(turn: Column, role: Column) -> Column:
    return F.concat(F.lit("12/06/24, 15:"), F.lpad((turn % 60).cast("string"), 2, "0"), F.lit(" - "), role, F.lit(": "))


def transcript(rendered: DataFrame) -> DataFrame:
    """One file for each conversation, from rows (conv_id, turn, rendered)."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "rendered")))
    txt = F.array_join(F.transform(ordered, lambda t: t["rendered"]), "\n")
    files = rendered.groupBy("conv_id").agg(txt.alias("txt"))
    fname = F.concat(F.lit("conv-"), F.col("conv_id").cast("string"), F.lit(".txt"))
    return files.select(F.lit("conversations").alias("src"), fname.alias("fname"), stem(fname).alias("customer_name"), "txt")


def conv_id() -> Column:
    return F.regexp_extract("fname", r"^conv-(-?\d+)", 1).cast("long").alias("conv_id")


def plain_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcript(turns(spark, sf_dir).withColumn("rendered", F.concat(header(F.col("turn"), F.col("role")), "text")))


# Which turns become notices and which say they were deleted; the SQL states the same rules.
NOTICE, DELETION = "(conv_id * 31 + turn) % 7 = 0", "(conv_id * 31 + turn) % 7 <> 0 AND (conv_id * 17 + turn) % 5 = 0"


def marked_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.expr(NOTICE), "Ana added Bob\nwords after it").when(F.expr(DELETION), "This message\nwas  deleted").otherwise(F.col("text"))
    return transcript(turns(spark, sf_dir).withColumn("rendered", F.concat(header(F.col("turn"), F.col("role")), said)))


def line_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = turns(spark, sf_dir).select(F.col("conv_id").cast("string").alias("src"), F.col("turn").cast("string").alias("fname"), F.lit(None).cast("string").alias("customer_name"), F.col("text").alias("txt"))
    found = M.lines(files).where("line <> ''")
    return found.select(F.col("src").cast("long").alias("conv_id"), F.col("fname").cast("long").alias("turn"), F.col("n").cast("long").alias("n"), "line")


def header_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.substring_index(F.concat(header(F.col("turn"), F.col("role")), "text"), "\n", 1)
    c = turns(spark, sf_dir).select("conv_id", "turn", captures(strip(first)).alias("c"))
    return c.select("conv_id", "turn", F.col("c")[0].alias("date"), F.col("c")[1].alias("time"), strip(F.col("c")[2]).alias("sender"), strip(F.col("c")[3]).alias("message"))


def continuation_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.fold(M.lines(plain_files(spark, sf_dir))).select(conv_id(), F.col("g").cast("long").alias("g"), "time", "sender", "message")


def long_history_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as the lines of one file, folded in blocks: every third is a header, the others go on."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").cast("long").alias("n"), F.concat("event_type", F.lit(" "), "props").alias("said"))
    line = F.when(F.col("n") % 3 == 0, F.concat(header(F.col("n"), F.lit("Ana")), F.col("said"))).otherwise(F.col("said"))
    raw = e.select(F.lit("events").alias("src"), F.lit("all.txt").alias("fname"), F.lit("all").alias("customer_name"), "n", line.alias("raw"))
    return M.folded(M.grouped_in_blocks(M.stripped(raw), block=500)).select(F.col("g").cast("long").alias("g"), "time", "message")


def archive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as archives of transcripts by many tasks, read back member by member and folded."""
    path = scratch_path(spark, "archives")
    write_archives(plain_files(spark, sf_dir), path)
    found = M.messages_of_lines(read_transcripts(spark, path).lines)
    return found.select("fname", "customer_name", F.col("g").cast("long").alias("g"), "sender", "message")


def system_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.fold(M.lines(marked_files(spark, sf_dir))).select(conv_id(), F.col("g").cast("long").alias("g"), "sender", "message")


def clean_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.messages(marked_files(spark, sf_dir)).select(conv_id(), F.col("g").cast("long").alias("g"), "sender", "message")


def orphan_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    rendered = F.when(F.col("turn") == 0, F.col("text")).otherwise(F.concat(header(F.col("turn"), F.col("role")), "text"))
    files = transcript(turns(spark, sf_dir).withColumn("rendered", rendered))
    return M.messages(files).select(conv_id(), F.col("g").cast("long").alias("g"), "sender", "message")


def customer_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.messages(plain_files(spark, sf_dir)).select("customer_name", F.col("g").cast("long").alias("g"), "sender")


def silent_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third conversation has nothing but a notice."""
    said = F.when(F.col("conv_id") % 3 == 0, F.concat(header(F.col("turn"), F.col("role")), F.lit("Ana left"))).otherwise(F.concat(header(F.col("turn"), F.col("role")), "text"))
    return transcript(turns(spark, sf_dir).withColumn("rendered", said))


def keep_empty_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.message_counts(M.customers(silent_files(spark, sf_dir))).select("fname", "customer_name", "n_messages")


def nest_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.customers(plain_files(spark, sf_dir))
    line = F.transform("messages", lambda m: F.concat_ws("|", m["customer_name"], m["date"], m["time"], m["sender"], m["message"]))
    return found.select("fname", F.array_join(line, "\n").alias("messages"))


def message_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.messages(plain_files(spark, sf_dir)).groupBy("customer_name", "sender").agg(F.count("*").alias("n_messages"), F.sum(F.length("message")).alias("n_chars"))
    return found.select("customer_name", "sender", "n_messages", F.col("n_chars").cast("long").alias("n_chars"))


def total_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, messages and files without any."""
    counts = M.message_counts(M.customers(silent_files(spark, sf_dir)))
    return counts.agg(F.count("*").alias("n_customers"), F.sum("n_messages").alias("n_messages"), F.count_if(F.col("n_messages") == 0).alias("n_empty"))


def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messages of their users, in order of event."""
    at = F.col("ts")
    return table(spark, sf_dir, "events").select(
        F.lit("events").alias("src"), F.col("user_id").cast("string").alias("fname"), F.col("event_id").cast("long").alias("g"),
        F.date_format(at, "dd/MM/yy").alias("date"), F.date_format(at, "HH:mm").alias("time"), F.col("event_type").alias("sender"), F.col("props").alias("message"),
    )


def chunking(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunked(event_messages(spark, sf_dir), ["src", "fname"], "g")
    found = rows.groupBy("fname", "chunk_no").agg(F.count("*").alias("n_messages"), F.min("g").alias("first_event"), F.max("g").alias("last_event"))
    return found.select(F.col("fname").cast("long").alias("user_id"), F.col("chunk_no").cast("long").alias("chunk_no"), "n_messages", "first_event", "last_event")


def render_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = prompts(event_messages(spark, sf_dir), ITEMS)
    return found.select(F.col("fname").cast("long").alias("user_id"), F.col("chunk_no").cast("long").alias("chunk_no"), "n_messages", "prompt")


def render_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = prompts(event_messages(spark, sf_dir), INSIGHTS)
    return found.select(F.col("fname").cast("long").alias("user_id"), F.col("chunk_no").cast("long").alias("chunk_no"), "n_messages", "prompt")


def fence_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_id") % 4
    raw = (
        F.when(kind == 0, F.col("props"))
        .when(kind == 1, F.concat(F.lit("```json\n"), "props", F.lit("\n```")))
        .when(kind == 2, F.concat(F.lit("  ```JSON"), "props", F.lit("```\n")))
        .otherwise(F.concat(F.lit("Here: ```"), "props", F.lit("```")))
    )
    return table(spark, sf_dir, "events").select("event_id", R.unfenced(raw).alias("answer"))


def event_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers made of events' properties; some are fenced, no JSON, a list, or lack the list."""
    kind = F.col("event_id") % 10
    entry = F.concat(F.lit('{"item_name": "'), "event_type", F.lit('", "quantity": '), F.get_json_object("props", "$.k"), F.lit(', "quantity_unit": "kg"}'))
    whole = F.concat(F.lit('{"items": ['), entry, F.lit(", "), entry, F.lit('], "other": [1]}'))
    raw = (
        F.when(kind == 0, F.concat(F.lit("I can't say: "), "props"))
        .when(kind == 1, F.concat(F.lit("["), "props", F.lit("]")))
        .when(kind == 2, F.lit('{"things": []}'))
        .when(kind == 3, F.lit('{"items": null}'))
        .when(kind == 4, F.concat(F.lit("```json\n"), whole, F.lit("\n```")))
        .otherwise(whole)
    )
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("user_id"), F.col("event_id").cast("long").alias("chunk_no"), raw.alias("raw"))


def json_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each answer came to: its error, and how many items it holds."""
    read = R.answers(event_answers(spark, sf_dir))
    items = F.try_variant_get("v", "$.items", "array<variant>")
    return read.select("chunk_no", F.coalesce("error", F.lit("none")).alias("error"), F.coalesce(F.size(items), F.lit(0)).cast("long").alias("n_items"))


def merge_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.merged(R.entries(R.answers(event_answers(spark, sf_dir)), ITEMS, ["user_id", "chunk_no"]), ["user_id", "chunk_no"])
    name = F.try_variant_get("entry", "$.item_name", "string")
    return found.select("list", F.col("position").cast("long").alias("position"), name.alias("item_name"))


def typed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["user_id", "chunk_no"]
    found = R.typed(R.entries(R.answers(event_answers(spark, sf_dir)), ITEMS, keys), ITEMS, "items", keys)
    return found.select(*keys, F.col("pos").cast("long").alias("pos"), "item_name", "quantity", "quantity_unit", "date")


def first_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.messages(plain_files(spark, sf_dir)).select(conv_id(), F.col("g").cast("long").alias("g"), "sender", "message")
    return found.orderBy("conv_id", "g").limit(1)


def error_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = turns(spark, sf_dir).select("conv_id", "turn", F.concat(F.lit("no json: "), "text").alias("raw"))
    return R.errors(R.answers(long), ["conv_id", "turn"])


#: Around each event's properties: numbers that change when they are read and written, repeated keys, odd spacing.
ODD_ENTRY = '{"z":%s , "a": 5.0,"big":1e400, "n": 0.1234567890123456789, "a":[ ], "t":"\\ud800 \\u00e9 é ]}"}'


def written_as_said(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One answer for each user, whose items are the user's events; the entries come back as they were written."""
    before, after = ODD_ENTRY.split("%s")
    events = table(spark, sf_dir, "events").select("user_id", "event_id", F.concat(F.lit(before), "props", F.lit(after)).alias("e"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "e"))), lambda x: x["e"]), " ,\n")
    answers = events.groupBy("user_id").agg(F.concat(F.lit('```json\n{"other": [1, {"items": [2]}], "items": ['), listed, F.lit("]}\n```")).alias("raw"))
    read = scanned(answers.withColumn("user_id", F.col("user_id").cast("long")), R.unfenced(F.col("raw")), ITEMS.keys, ["user_id"])
    return written_entries(read, ["user_id"]).select("user_id", F.col("pos").cast("long").alias("pos"), F.try_variant_get("entry", "$.z.k", "long").alias("k"), "written")


def meta_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = M.messages(plain_files(spark, sf_dir)).agg(F.count("*").alias("n"))
    found = total.select(R.meta("conversations", F.col("n"), ITEMS.model, "").alias("m"))
    return found.select("m.source_file", "m.total_messages_analyzed", "m.model")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        message_counts, line_scan, archive_scan, header_capture, continuation_fold, long_history_fold, system_filter, clean_messages, orphan_drop, customer_tag, keep_empty_customers,
        nest_messages, total_counts, chunking, render_prompt, render_insights, fence_strip, json_fallback, merge_concat, typed_items, first_message, error_prefix, written_as_said, meta_row,
    )
}

_TURNS = "t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations)"
_COLLAPSED = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
_TIME = "'15:' || lpad(CAST(turn % 60 AS VARCHAR), 2, '0') || ' '"
_JOINED = "list_aggregate(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), 'string_agg', ' ')"
#: Turns after the markers: what is kept, what a header or the words after a notice add.
_MARKED = f"""{_TURNS},
    marked AS (
        SELECT conv_id, turn, role, CASE WHEN {NOTICE} THEN 0 ELSE 1 END AS kept,
            CASE WHEN {NOTICE} THEN 'words after it' WHEN {DELETION} THEN 'This message was  deleted' ELSE {_JOINED} END AS piece
        FROM t
    ),
    numbered AS (SELECT *, sum(kept) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM marked),
    folded AS (
        SELECT conv_id, CAST(g AS BIGINT) AS g, max(role) FILTER (kept = 1) AS sender, string_agg(piece, ' ' ORDER BY turn) AS message
        FROM numbered WHERE g > 0 GROUP BY conv_id, g
    )"""
_ANSWERS = """answers AS (
        SELECT CAST(user_id AS BIGINT) AS user_id, CAST(event_id AS BIGINT) AS chunk_no, event_type AS item_name, CAST(json_extract(props, '$.k') AS DOUBLE) AS quantity, event_id % 10 AS kind FROM events
    ),
    items AS (SELECT *, unnest([0, 1]) AS pos FROM answers WHERE kind > 3)"""


def _prompt_sql(profile: Profile) -> str:
    return f"""WITH e AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 80 AS chunk_no FROM events)
        SELECT CAST(user_id AS BIGINT) AS user_id, CAST(chunk_no AS BIGINT) AS chunk_no, count(*) AS n_messages,
            'The chat to analyse follows.' || chr(10) || chr(10) || '--- CHAT START ---' || chr(10)
            || string_agg('[' || strftime(ts, '%d/%m/%y') || ' ' || strftime(ts, '%H:%M') || '] ' || event_type || ': ' || props, chr(10) ORDER BY event_id)
            || chr(10) || '--- CHAT END ---' || chr(10) || chr(10) || '{profile.schema.replace(chr(10), "' || chr(10) || '")}' AS prompt
        FROM e GROUP BY user_id, chunk_no"""


ORACLES: dict[str, str] = {
    "line_scan": f"""WITH {_TURNS},
        split AS (SELECT conv_id, turn, string_split(text, chr(10)) AS parts FROM t),
        each AS (SELECT conv_id, turn, unnest(parts) AS part, generate_subscripts(parts, 1) AS n FROM split)
        SELECT conv_id, turn, CAST(n - 1 AS BIGINT) AS n, trim(part) AS line FROM each WHERE trim(part) <> ''""",
    "header_capture": f"""WITH {_TURNS}
        SELECT conv_id, turn, '12/06/24' AS date, {_TIME} AS time, role AS sender, trim(string_split(text, chr(10))[1]) AS message FROM t""",
    "continuation_fold": f"""WITH {_TURNS}
        SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS g, {_TIME} AS time, role AS sender, {_JOINED} AS message FROM t""",
    "long_history_fold": f"""WITH e AS (SELECT event_id AS n, event_type || ' ' || props AS said, sum(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END) OVER (ORDER BY event_id) AS g FROM events)
        SELECT CAST(g AS BIGINT) AS g, '15:' || lpad(CAST(min(n) % 60 AS VARCHAR), 2, '0') || ' ' AS time, string_agg(said, ' ' ORDER BY n) AS message FROM e WHERE g > 0 GROUP BY g""",
    "archive_scan": f"""WITH {_TURNS}
        SELECT 'conv-' || conv_id || '.txt' AS fname, 'conv-' || conv_id AS customer_name, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS g, role AS sender, {_COLLAPSED.format("text")} AS message FROM t""",
    "system_filter": f"""WITH {_MARKED} SELECT conv_id, g, sender, message FROM folded""",
    "clean_messages": f"""WITH {_MARKED}
        SELECT conv_id, g, sender, {_COLLAPSED.format("message")} AS message FROM folded WHERE lower({_COLLAPSED.format("message")}) NOT IN ('', 'this message was deleted', '<media omitted>')""",
    "orphan_drop": f"""WITH {_TURNS}
        SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS g, role AS sender, {_COLLAPSED.format("text")} AS message FROM t WHERE turn > 0""",
    "customer_tag": f"""WITH {_TURNS}
        SELECT 'conv-' || conv_id AS customer_name, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS g, role AS sender FROM t""",
    "keep_empty_customers": f"""WITH {_TURNS}
        SELECT 'conv-' || conv_id || '.txt' AS fname, 'conv-' || conv_id AS customer_name, count(*) FILTER (conv_id % 3 <> 0) AS n_messages FROM t GROUP BY conv_id""",
    "nest_messages": f"""WITH {_TURNS}
        SELECT 'conv-' || conv_id || '.txt' AS fname,
            string_agg('conv-' || conv_id || '|12/06/24|' || {_TIME} || '|' || role || '|' || {_COLLAPSED.format("text")}, chr(10) ORDER BY turn) AS messages
        FROM t GROUP BY conv_id""",
    "message_counts": f"""WITH {_TURNS}
        SELECT 'conv-' || conv_id AS customer_name, role AS sender, count(*) AS n_messages, CAST(sum(length({_COLLAPSED.format("text")})) AS BIGINT) AS n_chars FROM t GROUP BY conv_id, role""",
    "total_counts": f"""WITH {_TURNS}, c AS (SELECT conv_id, count(*) FILTER (conv_id % 3 <> 0) AS n FROM t GROUP BY conv_id)
        SELECT count(*) AS n_customers, CAST(sum(n) AS BIGINT) AS n_messages, count(*) FILTER (n = 0) AS n_empty FROM c""",
    "chunking": """WITH e AS (SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 80 AS chunk_no FROM events)
        SELECT CAST(user_id AS BIGINT) AS user_id, CAST(chunk_no AS BIGINT) AS chunk_no, count(*) AS n_messages, min(event_id) AS first_event, max(event_id) AS last_event
        FROM e GROUP BY user_id, chunk_no""",
    "render_prompt": _prompt_sql(ITEMS),
    "render_insights": _prompt_sql(INSIGHTS),
    "fence_strip": """SELECT event_id, CASE WHEN event_id % 4 = 3 THEN 'Here: ```' || props || '```' ELSE trim(props) END AS answer FROM events""",
    "json_fallback": f"""WITH {_ANSWERS}
        SELECT chunk_no, CASE kind WHEN 0 THEN 'not_json' WHEN 1 THEN 'not_object' ELSE 'none' END AS error, CAST(CASE WHEN kind > 3 THEN 2 ELSE 0 END AS BIGINT) AS n_items FROM answers""",
    "merge_concat": f"""WITH {_ANSWERS}
        SELECT 'items' AS list, CAST(row_number() OVER (ORDER BY user_id, chunk_no, pos) - 1 AS BIGINT) AS position, item_name FROM items""",
    "typed_items": f"""WITH {_ANSWERS}
        SELECT user_id, chunk_no, CAST(pos AS BIGINT) AS pos, item_name, quantity, 'kg' AS quantity_unit, CAST(NULL AS VARCHAR) AS date FROM items""",
    "written_as_said": """SELECT CAST(user_id AS BIGINT) AS user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS BIGINT) AS pos, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
            '%s' || props || '%s' AS written
        FROM events""" % tuple(ODD_ENTRY.split("%s")),
    "first_message": f"""WITH {_TURNS}
        SELECT conv_id, CAST(1 AS BIGINT) AS g, role AS sender, {_COLLAPSED.format("text")} AS message FROM t ORDER BY conv_id, turn LIMIT 1""",
    "error_prefix": f"""WITH {_TURNS}
        SELECT conv_id, turn, 'not_json' AS error, left(trim('no json: ' || text), 500) AS answer FROM t""",
    "meta_row": f"""SELECT 'conversations' AS source_file, count(*) AS total_messages_analyzed, '{ITEMS.model}' AS model FROM conversations""",
}
