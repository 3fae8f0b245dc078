"""Model answers into lists: fences off, JSON read, lists of chunks and customers joined in order."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.functions.text import strip
from colloquy.operators.ordering import global_positions
from colloquy.operators.spans import finite
from colloquy.plans.profiles import Profile

#: Fixed value: characters of an unreadable answer that are reported.
ERROR_CHARS = 500


def unfenced(raw: Column) -> Column:
    """Without a code fence: only if the answer starts with three backticks, then all of them at both ends go, and the word json."""
    text = strip(raw)
    bare = F.regexp_replace(text, r"^`+|`+\z", "")
    tagged = F.lower(F.substring(bare, 1, 4)) == "json"
    opened = F.when(tagged, strip(F.substring(bare, 5, 2**31 - 1))).otherwise(bare)
    return F.when(F.startswith(text, F.lit("```")), opened).otherwise(text)


def parsed(raw: Column) -> Column:
    """The answer as VARIANT; null if it is no JSON. Kept leniencies of the reader are in the README."""
    return F.try_parse_json(unfenced(raw))


@F.pandas_udf(T.StringType())
def strict_json(text: pd.Series) -> pd.Series:
    """The text's JSON written anew, null if it is none: of equal keys the last counts, NaN and infinities become null, nothing may follow."""

    def read(one: str | None) -> str | None:
        try:
            return json.dumps(finite(json.loads(one or "")))
        except (ValueError, RecursionError):
            return None

    return text.map(read)


def is_object(value: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(value), F.lit("OBJECT<")), F.lit(False))


def answers(responses: DataFrame, raw_col: str = "raw", strict: bool = False) -> DataFrame:
    """With ``v`` (null if unusable) and ``error``: not_json, not_object or null.

    An answer that is JSON but no object counts as unusable instead of ending the run. ``strict``
    refuses text after the JSON and takes repeated keys and NaN, at the price of Python for each answer.
    """
    raw = F.col(raw_col)
    read = responses.withColumn("v", F.try_parse_json(strict_json(unfenced(raw))) if strict else parsed(raw))
    error = F.when(F.col("v").isNull(), "not_json").when(~is_object(F.col("v")), "not_object")
    return read.withColumn("error", error).withColumn("v", F.when(F.col("error").isNull(), F.col("v")))


def errors(answered: DataFrame, keys: Sequence[str], raw_col: str = "raw") -> DataFrame:
    """What could not be read, with the beginning of the answer."""
    return answered.where(F.col("error").isNotNull()).select(*keys, "error", F.substring(unfenced(F.col(raw_col)), 1, ERROR_CHARS).alias("answer"))


def entries(answered: DataFrame, profile: Profile, keys: Sequence[str]) -> DataFrame:
    """Rows (keys, list, pos, entry): the lists' entries as VARIANT; other keys of an answer are left out.

    A list that is missing, null or no array has no entries.
    """
    lists = F.array(*(F.struct(F.lit(k).alias("list"), F.try_variant_get("v", f"$.{k}", "array<variant>").alias("entries")) for k in profile.keys))
    one = answered.select(*keys, F.explode(lists).alias("l"))
    return one.select(*keys, F.col("l.list").alias("list"), F.posexplode("l.entries").alias("pos", "entry"))


def merged(found: DataFrame, order: Sequence[str], also: Sequence[str] = ()) -> DataFrame:
    """Rows (list, position, entry, also): all entries of a list in order of customer, chunk and place, nothing removed.

    An answer's first position comes from the sizes of those before it, so no list goes through one
    task; ``pos`` says where in its list an entry is.
    """
    return global_positions(found, ["list", *order], "pos", counted=True).select("list", "position", "entry", *also)


def typed(found: DataFrame, profile: Profile, name: str, keys: Sequence[str]) -> DataFrame:
    """One list's entries with typed columns; what can't be cast is null."""
    fields = [f.strip().rsplit(" ", 1) for f in dict(profile.lists)[name].split(",")]
    mine = found.where(F.col("list") == name)
    return mine.select(*keys, "pos", *(F.try_variant_get("entry", f"$.{f}", kind).alias(f) for f, kind in fields))


def meta(source: str, total: Column, model: str, generated_at: str) -> Column:
    return F.struct(
        F.lit(source).alias("source_file"), total.cast("long").alias("total_messages_analyzed"), F.lit(generated_at).alias("generated_at"), F.lit(model).alias("model")
    )
