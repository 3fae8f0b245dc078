"""What is asked of a model, and what its answers hold."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Profile:
    """Wording, answer lists with their typed fields, and how calls are made."""

    name: str
    model: str
    system: str
    notes: str
    lists: tuple[tuple[str, str], ...]
    retries: int
    max_tokens: int | None = None
    json_only: bool = False

    @property
    def keys(self) -> list[str]:
        return [k for k, _ in self.lists]

    @property
    def schema(self) -> str:
        """The answer's shape, made from the lists and their fields, then the notes."""
        shape = {name: [{field: None if kind == "double" else "" for field, kind in (f.rsplit(" ", 1) for f in fields.split(", "))}] for name, fields in self.lists}
        return json.dumps(shape) + "\n" + self.notes

    def prompt(self, chat: Column) -> Column:
        head = "The chat to analyse follows.\n\n--- CHAT START ---\n"
        return F.concat(F.lit(head), chat, F.lit("\n--- CHAT END ---\n\n" + self.schema))


_RULES = "Answer with one valid JSON object of the shape given and nothing else. Use only what the chat says."

# List names, field names and permitted words of the two profiles; chunks, tokens and retries.
ITEMS = Profile(
    name="items",
    model="items-model",
    system="You list every item that a shop's customers and staff mention in a chat, one entry for each mention. " + _RULES,
    notes="quantity is a number or null; date and timestamp are written as in the chat; an unknown text is empty.",
    lists=(("items", "item_name string, quantity double, quantity_unit string, date string, timestamp string, description string"),),
    retries=4,
    json_only=True,
)
INSIGHTS = Profile(
    name="insights",
    model="insights-model",
    system="You summarise what a shop can learn from a chat with its customers. " + _RULES,
    notes="status is order or lead; severity and priority are low, medium or high; owner is shop or customer; "
    "sentiment is positive, neutral, negative or mixed; amount_numeric is a number or null; a list of which the chat says nothing is empty.",
    lists=(
        ("customer_enquiries", "customer string, enquiry string"),
        ("products_services_discussed", "item string, context string"),
        ("orders_leads", "customer string, detail string, status string"),
        ("prices_amounts", "item string, amount_text string, amount_numeric double"),
        ("customer_requirements", "customer string, requirement string"),
        ("complaints_negative_feedback", "customer string, issue string, severity string"),
        ("action_items", "action string, owner string, priority string"),
        ("customer_sentiment", "customer string, sentiment string, reason string"),
        ("business_recommendations", "recommendation string, why string"),
    ),
    retries=1,
    max_tokens=4000,
)
PROFILES = {p.name: p for p in (ITEMS, INSIGHTS)}
