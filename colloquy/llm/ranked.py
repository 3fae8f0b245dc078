"""Ranked lexical search of many items at once, sharing what their term sets have in common.

An item's score of a document is a sum over the item's terms, so partial sums can be shared. The
items are a set of literals (term, nth occurrence) each. Those that the same items hold form one
shared set; sets that neighbour each other in several items are joined in pairs, again and
again, which gives a graph whose leaves are literals and whose sinks are items. Tasks take
documents by the block: each shared set's accumulator, one number for each document of the block,
is filled once, nodes add up two others', and items what is left. Every task keeps the best
documents of each item only.

Texts are read once: what is kept of a document is its length and its counts of the items' terms.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import materialise, scratch_path

#: Distinct terms of all items, and bytes of them, up to which they are broadcast; beyond, words are joined with them.
MOST_TERMS, MOST_TERM_BYTES = 300_000, 8_000_000
#: Rows (item, term) that one plan holds; more items are met in as many rounds over the counts.
PLAN_LITERALS = 200_000
#: Numbers that accumulators hold at a time, and candidates that are kept before the best are chosen.
ACCUMULATED, CANDIDATES = 1 << 22, 1 << 18
#: Bytes of a text whose words are held at a time.
SEGMENT = 1 << 20
#: Parts that an item's candidates are ranked in before all of them are.
SALTS = 16
#: Letters and digits, and whatever is not ASCII; the rest separates terms. Only A-Z are lower-cased.
TERM_BYTES = bytes(b if b > 0x7F or chr(b).isalnum() else 0x20 for b in bytes(range(256)).lower())

COUNTS = "doc_id long, n long, terms array<long>, tfs array<long>"


def term_counts(text: bytes | None) -> Counter[bytes]:
    """Occurrences of each term of a whole UTF-8 text."""
    found: Counter[bytes] = Counter()
    clean = (text or b"").translate(TERM_BYTES)
    at = 0
    while at < len(clean):
        end = clean.find(b" ", at + SEGMENT)
        end = len(clean) if end < 0 else end
        found.update(clean[at:end].split())
        at = end
    return found


@dataclass
class Plan:
    """Items as sums over a graph of shared term sets.

    Literals: ``literal_term`` (place in ``terms``) counts ``literal_times`` into the shared set
    ``literal_set``. Node ``sets + i`` is ``left[i] + right[i]``. Item ``items[i]`` is the sum of
    the nodes from ``first[i]`` on in ``parts``.
    """

    terms: np.ndarray
    weights: np.ndarray
    literal_term: np.ndarray
    literal_set: np.ndarray
    literal_times: np.ndarray
    sets: int
    left: np.ndarray
    right: np.ndarray
    levels: list[np.ndarray]
    items: np.ndarray
    first: np.ndarray
    parts: np.ndarray

    def additions(self) -> int:
        """Whole accumulators that are added for a block of documents, where each item for itself adds one a literal."""
        return len(self.left) + len(self.parts)


def shared_pairs(sequences: list[list[int]], nodes: int) -> list[tuple[int, int]]:
    """Join neighbours that several sequences have, in rounds, in place; returns the joined pairs in order.

    Nodes are numbered on from ``nodes``. Pairs that come to be used once are taken apart again by ``planned``.
    """
    pairs: list[tuple[int, int]] = []
    while True:
        count = Counter(pair for s in sequences for pair in zip(s, s[1:], strict=False))
        new = {pair: nodes + len(pairs) + i for i, pair in enumerate(sorted(p for p, n in count.items() if n > 1))}
        if not new:
            return pairs
        used: Counter[int] = Counter()
        for k, s in enumerate(sequences):
            out, i = [], 0
            while i < len(s):
                mine = count.get(tuple(s[i : i + 2]), 0) if i + 1 < len(s) else 0
                after = count.get(tuple(s[i + 1 : i + 3]), 0) if i + 2 < len(s) else 0
                if mine > 1 and mine >= after:
                    out.append(new[s[i], s[i + 1]])
                    used[out[-1]] += 1
                    i += 2
                else:
                    out.append(s[i])
                    i += 1
            sequences[k] = out
        if not used:
            return pairs
        pairs += sorted(new, key=new.get)


def planned(item: np.ndarray, term: np.ndarray, times: np.ndarray, weight: np.ndarray) -> Plan:
    """The graph of a block of items from rows (item, term, times, weight), one a distinct term of an item."""
    held: dict[int, list[tuple[int, int]]] = {}
    order = np.lexsort((item, -times, term))
    for i, t, n in zip(item[order].tolist(), term[order].tolist(), times[order].tolist(), strict=True):
        held.setdefault(t, []).append((n, i))
    # Literals of the same items are one shared set; those of most items come first in every item.
    sets: dict[tuple[int, ...], Counter[int]] = {}
    for t, who in held.items():
        for j, (n, _) in enumerate(who):
            less = who[j + 1][0] if j + 1 < len(who) else 0
            if n > less:  # occurrences less + 1 to n are in the items up to here
                sets.setdefault(tuple(sorted(i for _, i in who[: j + 1])), Counter())[t] += n - less
    ordered = sorted(sets, key=lambda who: (-len(who), who))
    members: dict[int, list[int]] = {i: [] for i in sorted(set(item.tolist()))}
    for s, who in enumerate(ordered):
        for i in who:
            members[i].append(s)
    sequences = list(members.values())
    pairs = shared_pairs(sequences, len(ordered))
    # What is used once is written where it is used.
    uses = Counter(x for p in pairs for x in p) + Counter(x for s in sequences for x in s)
    gone = {len(ordered) + i for i in range(len(pairs)) if uses[len(ordered) + i] == 0}
    for i in range(len(pairs) - 1, -1, -1):  # a pair that nothing uses frees its own parts
        if len(ordered) + i in gone:
            for x in pairs[i]:
                uses[x] -= 1
                if x >= len(ordered) and uses[x] == 0:
                    gone.add(x)

    def spread(node: int) -> list[int]:
        out, stack = [], [node]
        while stack:
            x = stack.pop()
            if x >= len(ordered) and uses[x] == 1:
                stack += reversed(pairs[x - len(ordered)])
            else:
                out.append(x)
        return out

    sequences = [[y for x in s for y in spread(x)] for s in sequences]
    kept = [i for i in range(len(pairs)) if len(ordered) + i not in gone and uses[len(ordered) + i] > 1]
    # A pair whose part was used once, by it, adds that part's own parts: kept as pairs of helpers.
    number = {s: s for s in range(len(ordered))}
    left, right, level = [], [], [0] * len(ordered)
    for i in kept:
        flat = [y for x in pairs[i] for y in spread(x)]
        at = number[flat[0]]
        for x in flat[1:]:
            left.append(at)
            right.append(number[x])
            level.append(1 + max(level[at], level[number[x]]))
            at = len(level) - 1
        number[len(ordered) + i] = at
    terms, place = np.unique(term, return_inverse=True)
    weights = np.zeros(len(terms), np.int64)
    weights[place] = weight
    literals = [(t, s, n) for s, who in enumerate(ordered) for t, n in sorted(sets[who].items())]
    lt, ls, ln = (np.array([x[c] for x in literals], np.int64) for c in range(3))
    by_term = np.argsort(lt, kind="stable")
    levels = np.array(level[len(ordered) :], np.int64)
    lengths = [len(s) for s in sequences]
    return Plan(
        terms, weights, np.searchsorted(terms, lt[by_term]), ls[by_term], ln[by_term], len(ordered), np.array(left, np.int64), np.array(right, np.int64),
        [np.flatnonzero(levels == x) for x in range(1, levels.max(initial=0) + 1)],
        np.array(list(members), np.int64), np.cumsum([0, *lengths[:-1]]).astype(np.int64), np.array([number[x] for s in sequences for x in s], np.int64),
    )


class Best:
    """The k best (score, doc_id) of each item; ties to smaller ids, null ids last."""

    def __init__(self, items: int, k: int):
        self.k, self.least, self.rows, self.held = k, np.ones(items, np.int64), [], 0

    def add(self, first: int, scores: np.ndarray, docs: np.ndarray, unknown: np.ndarray) -> None:
        """Scores of the items from ``first`` on, one row an item, for each document."""
        item, doc = np.nonzero(scores >= self.least[first : first + len(scores), None])
        self.rows.append((item + first, scores[item, doc], docs[doc], unknown[doc]))
        self.held += len(item)
        if self.held > CANDIDATES:
            self.settle()

    def settle(self) -> tuple[np.ndarray, ...]:
        if not self.rows:
            return tuple(np.zeros(0, np.int64) for _ in range(4))
        item, score, doc, unknown = map(np.concatenate, zip(*self.rows, strict=True))
        order = np.lexsort((doc, unknown, -score, item))
        item = item[order]
        starts = np.flatnonzero(np.r_[True, item[1:] != item[:-1]]) if len(item) else np.zeros(0, np.int64)
        rank = np.arange(len(item)) - np.repeat(starts, np.diff(np.r_[starts, len(item)]))
        keep = rank < self.k
        item, score, doc, unknown = item[keep], score[order][keep], doc[order][keep], unknown[order][keep]
        full = rank[keep] == self.k - 1
        self.least[item[full]] = score[full]  # as good as the last may still come before it
        self.rows, self.held = [(item, score, doc, unknown)], len(item)
        return self.rows[0]


def penalties(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """The length part of each document's score."""
    if 25 * int(n.max(initial=0)) * documents < 1 << 63:
        return 75 + 25 * n * documents // total
    return np.array([75 + 25 * int(x) * documents // total for x in n], np.int64)


def evaluate(plan: Plan, batches: Iterator[pa.RecordBatch], documents: int, total: int, k: int) -> tuple[np.ndarray, ...]:
    """(item, score, doc_id, id is null) of each item's best documents among all batches of term counts."""
    nodes = plan.sets + len(plan.left)
    block = max(16, min(1024, ACCUMULATED // max(1, nodes, len(plan.items))))
    holds = np.searchsorted(plan.literal_term, np.arange(len(plan.terms) + 1))
    ends, best = np.r_[plan.first[1:], len(plan.parts)], Best(len(plan.items), k)
    # Items whose parts' accumulators fit at a time.
    cuts = [0]
    for i in range(len(plan.items)):
        if ends[i] - plan.first[cuts[-1]] > max(1, ACCUMULATED // block) and i > cuts[-1]:
            cuts.append(i)
    cuts.append(len(plan.items))
    for batch in batches:
        for at in range(0, batch.num_rows, block):
            part = batch.slice(at, block)
            ids, n = part.column("doc_id"), part.column("n").to_numpy(zero_copy_only=False)
            docs, unknown = ids.fill_null(0).to_numpy(zero_copy_only=False), np.asarray(ids.is_null())
            lists = part.column("terms")
            doc = np.repeat(np.arange(len(n)), np.asarray(lists.value_lengths()))
            term, tf = (part.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("terms", "tfs"))
            place = np.minimum(np.searchsorted(plan.terms, term), len(plan.terms) - 1)
            mine = plan.terms[place] == term
            doc, place, tf = doc[mine], place[mine], tf[mine]
            value = plan.weights[place] * (1_000_000_000 * tf // (1000 * tf + 12 * penalties(n, documents, total)[doc]))
            # Each count goes to every literal of its term.
            many = holds[place + 1] - holds[place]
            literal = np.repeat(holds[place] - np.cumsum(many) + many, many) + np.arange(many.sum())
            sums = np.zeros((nodes, len(n)), np.int64)
            np.add.at(sums.reshape(-1), plan.literal_set[literal] * len(n) + np.repeat(doc, many), np.repeat(value, many) * plan.literal_times[literal])
            for level in plan.levels:
                sums[plan.sets + level] = sums[plan.left[level]] + sums[plan.right[level]]
            for a, b in zip(cuts, cuts[1:], strict=False):
                scores = np.add.reduceat(sums[plan.parts[plan.first[a] : ends[b - 1]]], plan.first[a:b] - plan.first[a], axis=0)
                best.add(a, scores, docs, unknown)
    item, score, doc, unknown = best.settle()
    return plan.items[item] if len(item) else item, score, doc, unknown.astype(bool)


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (item, item_id, term, times), written once: ``item`` numbers the distinct rows (id, text)."""
    told = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("binary").alias("text")).distinct()
    numbered = materialise(told.withColumn("item", F.monotonically_increasing_id()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, item_id, text in zip(*(batch.column(c).to_pylist() for c in ("item", "item_id", "text")), strict=True):
                found = term_counts(text)
                yield pa.RecordBatch.from_pydict(
                    {"item": pa.array([item] * len(found), pa.int64()), "item_id": pa.array([item_id] * len(found), pa.int64()), "term": pa.array([t.decode() for t in found], pa.string()), "times": pa.array(found.values(), pa.int64())}
                )

    return materialise(numbered.mapInArrow(run, "item long, item_id long, term string, times long"))


def counted(docs: DataFrame, vocabulary: DataFrame, id_col: str, text_col: str, most_terms: int) -> DataFrame:
    """Each document's length and counts of the vocabulary's terms, written once.

    A vocabulary of a checked size goes to the tasks; a larger one is joined with the documents' words.
    """
    spark = docs.sparkSession
    size = vocabulary.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0)).alias("bytes")).first()
    known = {r["term"].encode(): r["t"] for r in vocabulary.toLocalIterator()} if size["n"] <= most_terms and size["bytes"] <= MOST_TERM_BYTES else None
    sent = spark.sparkContext.broadcast(known)
    kind = pa.int64() if known is not None else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = sent.value
        for batch in batches:
            ns, terms, tfs = [], [], []
            for text in batch.column(1):
                found = term_counts(text.as_py())
                ns.append(found.total())
                if place is not None:
                    found = {place[t]: n for t, n in found.items() if t in place}
                terms.append([t if place is not None else t.decode() for t in found])
                tfs.append(list(found.values()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.int64()), pa.array(terms, pa.list_(kind)), pa.array(tfs, pa.list_(pa.int64()))], names=["doc_id", "n", "terms", "tfs"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    if known is not None:
        return materialise(texts.mapInArrow(run, COUNTS).where("n > 0"))
    every = materialise(texts.mapInArrow(run, COUNTS.replace("terms array<long>", "terms array<string>")).where("n > 0").withColumn("row", F.monotonically_increasing_id()))
    words = every.select("row", F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select("row", F.col("x.terms").alias("term"), F.col("x.tfs").alias("tf"))
    met = words.join(vocabulary, "term").groupBy("row").agg(F.collect_list(F.struct("t", "tf")).alias("x"))
    back = every.select("row", "doc_id", "n").join(met, "row", "left")
    nothing = F.array().cast("array<long>")
    return materialise(back.select("doc_id", "n", F.coalesce("x.t", nothing).alias("terms"), F.coalesce("x.tf", nothing).alias("tfs")))


def rank_items(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", most_terms: int = MOST_TERMS, plan_literals: int = PLAN_LITERALS) -> DataFrame:
    """Rows (item_id, rank, doc_id, score): each item's k documents of highest score above 0, ties to smaller ids.

    Null and empty texts have no terms: such documents count for nothing and such items have no
    rows. Equal items (id and text) are one; items of one id and different texts are ranked each
    for itself. Every row of ``docs`` is a document, repeated ones too; null ids come last among
    equal scores. Other columns are ignored; an empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    wanted = item_terms(items, item_col, item_text)
    vocabulary = materialise(wanted.select("term").distinct().withColumn("t", F.monotonically_increasing_id()))
    counts = counted(docs, vocabulary, id_col, text_col, most_terms)
    told = counts.agg(F.count("*").alias("n"), F.sum("n").alias("l")).first()
    documents, total = told["n"], told["l"] or 0
    path = scratch_path(spark)
    spark.createDataFrame([], "item long, doc_id long, score long").write.parquet(path)
    asked = wanted.count()
    rounds = math.ceil(asked / plan_literals) if documents else 0
    if rounds:
        held = counts.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df"))
        weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * documents + 2) / (2 * F.col("df") + 1)))
        weights = vocabulary.join(held, "t").select("term", "t", weight.cast("long").alias("w"))
        literals = materialise(wanted.join(weights, "term").select(F.pmod(F.xxhash64("item"), F.lit(rounds)).alias("round"), "item", "t", "times", "w"))
    for r in range(rounds):
        mine = literals.where(F.col("round") == r).select("item", "t", "times", "w").toArrow()  # of a bounded number of rows
        if not mine.num_rows:
            continue
        sent = spark.sparkContext.broadcast(planned(*(mine[c].to_numpy() for c in ("item", "t", "times", "w"))))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            item, score, doc, unknown = evaluate(sent.value, batches, documents, total, k)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(doc, pa.int64(), mask=unknown), pa.array(score, pa.int64())], names=["item", "doc_id", "score"])

        counts.mapInArrow(run, "item long, doc_id long, score long").write.mode("append").parquet(path)
        sent.destroy()
    found = spark.read.schema("item long, doc_id long, score long").parquet(path)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    parts = found.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    first = parts.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("rank") <= k)
    last = first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    return last.join(wanted.select("item", "item_id").distinct(), "item").select("item_id", "rank", "doc_id", "score")
