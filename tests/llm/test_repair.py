import hashlib
import itertools
import random
import re
import zlib

import pytest

from colloquy.llm.repair import cheapest, inserted, repair, spent, structure_report, suffix_bounds

CONV = "conv_id long, turn long, role string, text string"
VALID = re.compile(r"(s?(ua)+)?")


def brute(roles, faults):
    """(cost, audit) over all edits, inserting at most two turns in a place."""
    best = None
    kinds = ["D", "K", "Ru", "Ra"]
    for edits in itertools.product(kinds, repeat=len(roles)):
        if any(f in "bd" and e != "D" for e, f in zip(edits, faults, strict=True)):
            continue
        for inserts in itertools.product(["", "u", "a", "ua", "au"], repeat=len(roles) + 1):
            shape, audit, cost = inserts[0], "I" * len(inserts[0]), 3 * len(inserts[0])
            for e, r, f, i in zip(edits, roles, faults, inserts[1:], strict=True):
                shape += ("" if e == "D" else r if e == "K" else e[1]) + i
                audit += e[0] + "I" * len(i)
                cost += {"D": 4, "K": 0, "R": 3}[e[0]] + 3 * (f == "t" and e != "D") + 3 * len(i)
            if VALID.fullmatch(shape):
                best = min(best or (cost, audit), (cost, audit))
    return best


def dp(rows):
    """(cost, audit) by keeping the least way to each state; rows are (role initial, fault)."""
    ways = {"": (0, "")}  # by what was last: nothing, s, u or a

    def grown(ways):
        for _ in range(2):
            for state, (cost, audit) in list(ways.items()):
                to = "a" if state == "u" else "u"
                ways[to] = min(ways.get(to, (9**9, "")), (cost + 3, audit + "I"))
        return ways

    for r, f in rows:
        new = {}
        for state, (cost, audit) in grown(ways).items():
            to, more = "a" if state == "u" else "u", 3 * (f == "t")
            options = [("D", 4, state)]
            if f not in "bd":
                options += [("R", 3 + more, to)] + [("K", more, to)] * (r == to) + [("K", more, "s")] * (r == "s" and state == "")
            for letter, extra, at in options:
                new[at] = min(new.get(at, (9**9, "")), (cost + extra, audit + letter))
        ways = new
    ways = grown(ways)
    return min(ways[s] for s in ("", "a") if s in ways)


def random_case(rng, n):
    return "".join(rng.choice("suuaax") for _ in range(n)), "".join(rng.choice("-----btd") for _ in range(n))


@pytest.mark.parametrize("seed", range(12))
def test_search_against_all_edits(seed):
    rng = random.Random(seed)
    for n in range(4):
        roles, faults = random_case(rng, n)
        cost, audit, _ = cheapest(roles, faults)
        assert (cost, audit) == brute(roles, faults) == dp(list(zip(roles, faults, strict=True))) and cost == spent(faults, audit)


def test_any_lower_bounds_find_the_same():
    rng = random.Random(1)
    for _ in range(200):
        roles, faults = random_case(rng, rng.randrange(9))
        loose = [[0] * 4 for _ in range(len(roles) + 1)]
        assert cheapest(roles, faults) == cheapest(roles, faults, bounds=loose)
        assert cheapest(roles, faults)[:2] == dp(list(zip(roles, faults, strict=True)))


def test_segments_in_turn_are_the_whole():
    rng = random.Random(2)
    for _ in range(200):
        a, b = random_case(rng, rng.randrange(1, 7)), random_case(rng, rng.randrange(1, 7))
        whole = cheapest(a[0] + b[0], a[1] + b[1])
        first = cheapest(*a, after=suffix_bounds(*b, inserted((0, 1 << 40, 1 << 40, 0)))[0])
        assert first[1] + cheapest(*b, entry=first[2])[1] == whole[1] and first[0] == whole[0]


def report(rows):
    """What ``structure_report`` returns, conversation by conversation."""
    out = {}
    for conv in {r[0] for r in rows}:
        kept = []
        for c, turn, role, text in rows:
            if c == conv:
                key = f"{' ' if c is None else c}:{' ' if turn is None else turn}"
                kind = zlib.crc32(key.encode()) % 20
                role, text = (" " if x is None else x for x in (role, text))
                text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
                kept += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, seen = "", set()
        for _, role, text in kept:
            bare = text.rstrip(" \t\n\v\f\r")
            faults += "b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "-"
            seen.add((role, text))
        cost, audit = dp([(r[1][:1], f) for r, f in zip(kept, faults, strict=True)])
        said, rest, last = [], list(kept), ""
        for e in audit:
            row = rest.pop(0) if e != "I" else (None, None, "")
            if e != "D":
                expected = "assistant" if last == "u" else "user"
                role = row[1] if e == "K" else expected
                last = "s" if role[:1] == "s" and e == "K" else expected[0]
                said.append(f"{role}:{row[2]}")
        turns = {r[0] for r in kept} - {None}
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(kept, kept[1:], strict=False)]
        digest = hashlib.sha256("\n".join(said).encode()).hexdigest()
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in "bdt"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest)
    return out


def rows_of(seed, convs=60):
    rng = random.Random(seed)
    rows = []
    texts = ["Yes.", "No!", "what", "", " \t\n", None, "ok. ", "ok. ", "a\nb?", "é", "...", "x" * 5000 + "."]
    for c in [*range(convs), None]:
        for t in range(rng.randrange(1, 9)):
            rows.append((c, rng.choice([t, t, t, t, None, t * 3]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"]), rng.choice(texts) if rng.random() < 0.5 else f"{c} {t} said."))
    return rows


def checked(df, rows):
    columns = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert df.columns == ["conv_id", *columns]
    found = df.collect()
    assert len(found) == len({r["conv_id"] for r in found})
    assert {r["conv_id"]: tuple(r[c] for c in columns) for r in found} == report(rows)


@pytest.mark.parametrize("bits", [12, 1])
def test_report(spark, bits):
    rows = rows_of(3)
    checked(structure_report(spark.createDataFrame([(*r, 1, "x", 2) for r in rows], CONV + ", pos long, audit string, n long").repartition(5), bits), rows)


def test_one_conversation_holds_most_rows(spark):
    rng = random.Random(4)
    rows = [(7, i, rng.choice(["user", "assistant"]), rng.choice(["same.", f"t {i}.", "cut"])) for i in range(3000)] + rows_of(5, 10)
    rows = [r for r in rows if r[0] != 7 or r[1] is not None]
    checked(structure_report(spark.createDataFrame(rows, CONV).repartition(6), 5), rows)


def test_repeated_rows_and_lost_conversations(spark):
    lost = [c for c in range(2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:3]
    rows = [(c, 0, "user", "hi.") for c in lost] + [(1, 5, "user", "hi.")] * 4 + [(2, 5, "assistant", "long " * 400_000 + ".")]
    checked(structure_report(spark.createDataFrame(rows, CONV)), rows)


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "be kind."), (1, 1, "user", "hi."), (1, 2, "user", "hello?"), (1, 3, "assistant", ""), (1, 4, "assistant", "yes."), (1, 5, "user", "bye!")]
    audits, repaired = repair(spark.createDataFrame(rows, CONV))
    found = [tuple(r) for r in repaired.orderBy("conv_id", "n").collect()]
    assert [f[3][0] for f in found] == list("sua" + "ua" * ((len(found) - 3) // 2)) and (audits.first()["cost"], audits.first()["audit"]) == dp([("s", "-"), ("u", "-"), ("u", "-"), ("a", "b"), ("a", "-"), ("u", "-")])


def test_empty_table(spark):
    assert structure_report(spark.createDataFrame([], CONV)).count() == 0
