"""Transcript tables by name, for Spark SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame

from colloquy.operators import messages as M
from colloquy.operators.chunks import prompts
from colloquy.operators.responses import typed
from colloquy.plans.extract import Extraction
from colloquy.plans.profiles import ITEMS, Profile


def register(files: DataFrame, profile: Profile = ITEMS) -> None:
    """``messages``, ``customers`` and ``chunks`` of transcript files."""
    found = M.messages(files)
    found.createOrReplaceTempView("messages")
    M.customers(files).createOrReplaceTempView("customers")
    prompts(found, profile).createOrReplaceTempView("chunks")


def register_extraction(result: Extraction) -> None:
    """``insights`` (all entries) and one view of typed rows for each list, such as ``items``."""
    result.entries.createOrReplaceTempView("insights")
    for name in result.profile.keys:
        typed(result.entries, result.profile, name, ["src", "fname", "chunk_no"]).createOrReplaceTempView(name)
