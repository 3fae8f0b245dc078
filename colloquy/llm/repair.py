"""Conversation structure repair: the cheapest edits that leave an optional system turn and then pairs of user and assistant.

Rows are kept, given another role or deleted, and turns without text are inserted. The search is
depth-first branch and bound with an explicit stack. A node is (rows consumed, state), and the
state is what may come next, so an edit's initial alone tells where it leads: branches are taken
in order of initials, and of two complete repairs of equal cost the one met first has the least
audit. A node's suffix bound says what the rest costs at least, the incumbent is the best repair so
far, and each node keeps the least cost that it was reached with: what comes later at no less has
an audit that is greater and is dominated.

A conversation may hold any share of all rows. It is cut into segments of bounded length. Each
segment's costs from state to state are a small matrix; going back over a conversation's matrices
gives the bounds at each segment's end, with which its segments are searched side by side, from
every state. Only then is it known which of these follow each other. What a conversation needs in
one place are its edits, a letter a row; its texts pass through one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import materialise

#: Costs of the edits; a truncated row that isn't deleted costs TRUNCATED more.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States: at the start, after the system turn, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
EXPECTED, NEXT = ("user", "user", "assistant", "user"), (USER, USER, ASSISTANT, USER)
NEVER = 1 << 40
#: What may follow the last row: nothing, in these states.
COMPLETE = (0, NEVER, NEVER, 0)
#: Rows of one segment are at most 2 to this.
SEGMENT_BITS = 12
#: ASCII white space.
SPACES = " \t\n\v\f\r"
LEGAL = {"su", "ua", "au"}


@cache
def moves(role: str, fault: str, state: int) -> tuple[tuple[str, int, int, int], ...]:
    """Edits in order of their initials: (initial, cost, rows consumed, next state)."""
    found = [("D", DELETE, 1, state), ("I", INSERT, 0, NEXT[state])]
    if fault not in "bd":
        more = TRUNCATED * (fault == "t")
        if role == EXPECTED[state][0]:
            found.append(("K", more, 1, NEXT[state]))
        elif role == "s" and state == START:
            found.append(("K", more, 1, SYSTEM))
        found.append(("R", REROLE + more, 1, NEXT[state]))
    return tuple(found)


def inserted(costs: Sequence[int]) -> tuple[int, ...]:
    """Costs by state if turns may be inserted first."""
    user, assistant = min(costs[USER], INSERT + costs[ASSISTANT]), min(costs[ASSISTANT], INSERT + costs[USER])
    return min(costs[START], INSERT + user), min(costs[SYSTEM], INSERT + user), user, assistant


def suffix_bounds(roles: str, faults: str, after: Sequence[int]) -> list[tuple[int, ...]]:
    """By rows consumed and state: the least that what follows costs, given what it costs after the last row."""
    found = [tuple(after)]
    for role, fault in zip(reversed(roles), reversed(faults), strict=True):
        ahead = found[-1]
        found.append(inserted([min(cost + ahead[to] for _, cost, rows, to in moves(role, fault, state) if rows) for state in range(4)]))
    return found[::-1]


def cheapest(roles: str, faults: str, entry: int = START, after: Sequence[int] | None = None, bounds: Sequence[Sequence[int]] | None = None) -> tuple[int, str, int] | None:
    """(cost with what follows, audit, state after it) of the best repair of a segment; None if there is none.

    ``after`` tells what the rest costs by state, for a segment that others follow; turns at its
    end are inserted by the next. Any lower bounds will do, tighter ones visit fewer nodes.
    """
    last = after is None
    after = COMPLETE if last else after
    bounds = bounds or suffix_bounds(roles, faults, inserted(after) if last else after)
    n, best = len(roles), None
    reached: dict[tuple[int, int], int] = {}
    path: list[str] = []
    stack = [(0, entry, 0, 0, "")]
    while stack:
        row, state, cost, depth, initial = stack.pop()
        limit = best[0] if best else NEVER
        if cost + bounds[row][state] >= limit or reached.get((row, state), NEVER) <= cost:
            continue
        reached[row, state] = cost
        del path[max(0, depth - 1) :]
        if initial:
            path.append(initial)
        if row == n:
            if cost + after[state] < limit:
                best = cost + after[state], "".join(path), state
            if last:
                stack.append((row, NEXT[state], cost + INSERT, depth + 1, "I"))
            continue
        for letter, more, rows, to in reversed(moves(roles[row], faults[row], state)):
            stack.append((row + rows, to, cost + more, depth + 1, letter))
    return best


def crossing(roles: str, faults: str) -> list[int]:
    """Costs from each state before the segment to each one after its last row, row by row."""
    ends = [suffix_bounds(roles, faults, [0 if s == state else NEVER for s in range(4)])[0] for state in range(4)]
    return [min(NEVER, ends[to][at]) for at in range(4) for to in range(4)]


def lined_up(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, pos, role, text) with places in order of turn, written once: nulls first, ties by role and text."""
    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "text")]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Places grow from partition to partition, and inside each one.
    ranged = rows.select("conv_id", "turn", "role", "text").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return materialise(ranged.withColumn("pos", F.monotonically_increasing_id()))


def same(left: str, right: str, *names: str):
    condition = F.lit(True)
    for name in names:
        condition &= F.col(f"{left}.{name}").eqNullSafe(F.col(f"{right}.{name}"))
    return condition


def faulted(lined: DataFrame) -> DataFrame:
    """Rows (conv_id, pos, r, f): the role's initial (s, u, a or x) and the row's first fault (b, d, t or -)."""
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    initial = F.substring("role", 1, 1)
    facts = lined.select("conv_id", "pos", F.sha2(F.concat("role", F.lit("\x00"), "text"), 256).alias("said"), F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("r"), (bare == "").alias("blank"), F.right(bare, F.lit(1)).isin(".", "!", "?").alias("ended"))
    facts = materialise(facts)
    firsts = facts.groupBy("conv_id", "said").agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1")
    met = facts.alias("a").join(materialise(firsts).alias("b"), same("a", "b", "conv_id", "said"), "left")
    fault = F.when(F.col("blank"), "b").when(F.col("pos") > F.col("first"), "d").when(~F.col("ended"), "t").otherwise("-")
    return met.select("a.conv_id", "pos", "r", fault.alias("f"))


def segments(of: DataFrame, bits: int) -> DataFrame:
    """Rows (conv_id, seg, roles, faults), a letter a row."""
    placed = of.groupBy("conv_id", F.shiftright("pos", bits).alias("seg")).agg(F.sort_array(F.collect_list(F.struct("pos", "r", "f"))).alias("rows"))
    return placed.select("conv_id", "seg", F.array_join("rows.r", "").alias("roles"), F.array_join("rows.f", "").alias("faults"))


def by_row(run, schema: str, columns: Sequence[str]):
    """A function over Arrow batches from one over rows, which yields rows."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [r for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True) for r in run(*row)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, (_, t) in enumerate(schema)], names=[n for n, _ in schema])

    return over


NUMBERS, TEXTS = pa.list_(pa.int64()), pa.list_(pa.string())


def audited(of: DataFrame, bits: int = SEGMENT_BITS) -> DataFrame:
    """Rows (conv_id, audit, cost, blank, duplicate, truncated, illegal) from rows (conv_id, pos, r, f)."""
    pieces = materialise(segments(of, bits))
    several = materialise(pieces.groupBy("conv_id").agg(F.count("*").alias("n")).where("n > 1").select("conv_id"))
    crossed = [("conv_id", pa.int64()), ("seg", pa.int64()), ("costs", NUMBERS)]
    matrices = pieces.alias("a").join(several.alias("b"), same("a", "b", "conv_id"), "left_semi").mapInArrow(by_row(lambda c, s, r, f: [(c, s, crossing(r, f))], crossed, pieces.columns), "conv_id long, seg long, costs array<long>")

    def back(conv_id: int | None, chain: list[dict]) -> Iterator[tuple]:
        """What follows each segment but the last costs, by state."""
        after = inserted(COMPLETE)
        for i in range(len(chain) - 1, 0, -1):
            costs = chain[i]["costs"]
            after = inserted([min(costs[4 * at + to] + after[to] for to in range(4)) for at in range(4)])
            yield conv_id, chain[i - 1]["seg"], list(after)
        for s in chain[-1:]:
            yield conv_id, s["seg"], []

    chains = matrices.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("seg", "costs"))).alias("chain"))
    follow = chains.mapInArrow(by_row(back, [("conv_id", pa.int64()), ("seg", pa.int64()), ("after", NUMBERS)], ["conv_id", "chain"]), "conv_id long, seg long, after array<long>")

    def search(conv_id: int | None, seg: int, roles: str, faults: str, after: list[int] | None) -> Iterator[tuple]:
        found = [cheapest(roles, faults, entry, after or None) if after is not None or entry == START else None for entry in range(4)]
        yield conv_id, seg, roles, faults, [f[1] if f else None for f in found], [f[2] if f else None for f in found]

    solved = pieces.alias("a").join(materialise(follow).alias("b"), same("a", "b", "conv_id", "seg"), "left").select("a.*", "after")
    names = [("conv_id", pa.int64()), ("seg", pa.int64()), ("roles", pa.string()), ("faults", pa.string()), ("audits", TEXTS), ("exits", NUMBERS)]
    solved = solved.mapInArrow(by_row(search, names, ["conv_id", "seg", "roles", "faults", "after"]), "conv_id long, seg long, roles string, faults string, audits array<string>, exits array<long>")

    def chosen(conv_id: int | None, chain: list[dict]) -> Iterator[tuple]:
        state, audit, count, illegal, cost, before = START, [], dict.fromkeys("bdt-", 0), 0, 0, ""
        for s in chain:
            audit.append(s["audits"][state])
            cost += spent(s["faults"], audit[-1])
            state = s["exits"][state]
            for fault in count:
                count[fault] += s["faults"].count(fault)
            roles = before + s["roles"]
            illegal += sum(a + b not in LEGAL for a, b in zip(roles, roles[1:], strict=False))
            before = roles[-1:]
        yield conv_id, "".join(audit), cost, count["b"], count["d"], count["t"], illegal

    told = [("conv_id", pa.int64()), ("audit", pa.string()), *((n, pa.int64()) for n in ("cost", "blank", "duplicate", "truncated", "illegal"))]
    whole = solved.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("seg", "roles", "faults", "audits", "exits"))).alias("chain"))
    return whole.mapInArrow(by_row(chosen, told, ["conv_id", "chain"]), "conv_id long, audit string, cost long, blank long, duplicate long, truncated long, illegal long")


def spent(faults: str, audit: str) -> int:
    """What the edits of an audit cost."""
    cost = DELETE * audit.count("D") + REROLE * audit.count("R") + INSERT * audit.count("I")
    return cost + TRUNCATED * sum(f == "t" and e != "D" for f, e in zip(faults, audit.replace("I", ""), strict=True))


def applied(lined: DataFrame, audits: DataFrame) -> DataFrame:
    """Rows (conv_id, n, edit, role, text) of the repaired conversations, in order inside partitions; n from 0.

    A conversation's rows come to one task, for they have one order there; they pass through it
    one by one.
    """
    first = audits.select("conv_id", F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"))
    streams = first.unionByName(lined.select("conv_id", "pos", "role", "text")).repartition("conv_id").sortWithinPartitions("conv_id", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, edits, at, state, n = None, "", 0, START, 0

        def insertions() -> Iterator[tuple]:
            nonlocal at, state, n
            while at < len(edits) and edits[at] == "I":
                yield conv, n, "I", EXPECTED[state], ""
                state, at, n = NEXT[state], at + 1, n + 1

        def walk(rows: Iterator[tuple]) -> Iterator[tuple]:
            nonlocal conv, edits, at, state, n
            for conv_id, pos, role, text in rows:
                if pos < 0:
                    yield from insertions()  # at the end of the one before
                    conv, edits, at, state, n = conv_id, text, 0, START, 0
                    continue
                yield from insertions()
                edit, at = edits[at], at + 1
                if edit == "D":
                    continue
                yield conv, n, edit, role if edit == "K" else EXPECTED[state], text
                state = SYSTEM if edit == "K" and state == START and role[:1] == "s" else NEXT[state]
                n += 1

        def batched(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, (_, t) in enumerate(names)], names=[c for c, _ in names])

        names = [("conv_id", pa.int64()), ("n", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]
        for batch in batches:
            yield batched(list(walk(zip(*(batch.column(c).to_pylist() for c in ("conv_id", "pos", "role", "text")), strict=True))))
        yield batched(list(insertions()))

    return streams.mapInArrow(run, "conv_id long, n long, edit string, role string, text string")


def digested(repaired: DataFrame) -> DataFrame:
    """Rows (conv_id, repaired_sha256) of what ``applied`` returns, taken as it comes."""
    names = [("conv_id", pa.int64()), ("repaired_sha256", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, sha = None, None
        for batch in batches:
            done = []
            for conv_id, n, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "n", "role", "text")), strict=True):
                if n == 0:
                    done += [(conv, sha.hexdigest())] if sha else []
                    conv, sha = conv_id, hashlib.sha256()
                sha.update(f"{chr(10) if n else ''}{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, (_, t) in enumerate(names)], names=[c for c, _ in names])
        if sha:
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([sha.hexdigest()])], names=[c for c, _ in names])

    return repaired.select("conv_id", "n", "role", "text").mapInArrow(run, "conv_id long, repaired_sha256 string")


def repair(rows: DataFrame, bits: int = SEGMENT_BITS) -> tuple[DataFrame, DataFrame]:
    """(audits, repaired rows) of conversations given as rows (conv_id, turn, role, text).

    Rows follow each other by turn, nulls first, then by role and text. Audits: one row for each
    conversation that has rows: conv_id, audit, cost and counts of faults and of illegal neighbours.
    Repaired rows: conv_id, n, edit, role, text. Null roles and texts are one space: such a role is
    never kept, such a text is blank. Rows of a null conv_id are one conversation. Repeated rows
    are duplicates; other columns are ignored; an empty table gives no rows.
    """
    space = F.lit(" ")
    lined = lined_up(rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text")))
    audits = materialise(audited(faulted(lined), bits))
    return audits, applied(lined, audits)


def damaged(rows: DataFrame) -> DataFrame:
    """Faults put into conversations by the checksum of ``conv_id:turn``, nulls as one space."""
    said = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    kind = F.crc32(F.concat(said[0], F.lit(":"), said[1]).cast("binary")) % 20
    role = F.when(kind == 4, "user").otherwise(said[2])
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(said[3], "[.!?]", "")).otherwise(said[3])
    copies = F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1))
    return rows.where(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def structure_report(conversations: DataFrame, bits: int = SEGMENT_BITS) -> DataFrame:
    """One row for each conv_id of ``conversations``, which are damaged and then repaired: gaps, faults, cost, audit and digest.

    Conversations without a row after the damage have zeros, an empty audit and the digest of
    nothing. As for the rest, see ``repair``.
    """
    rows = damaged(conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text"))
    audits, repaired = repair(rows, bits)
    turns = rows.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    found = conversations.select(F.col("conv_id").cast("long")).distinct().alias("o")
    for name, table in (("t", turns), ("a", audits), ("r", digested(repaired))):
        found = found.join(table.alias(name), same("o", name, "conv_id"), "left")
    count = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("o.conv_id", *count, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
