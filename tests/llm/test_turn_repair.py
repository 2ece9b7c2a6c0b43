"""Conversation repair against plain Python: every edit sequence for few turns, cheapest (cost, audit) by state for many."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from embedlens.llm import turn_repair

WHITE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string"
GRAMMAR = re.compile(r"(s?(ua)+)?")


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        tail = text.rstrip(WHITE)
        out.append("blank" if not tail else "duplicate" if (role, text) in seen else "truncated" if tail[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, repaired turns) by keeping the least of each grammar state after each turn."""
    def inserted(states):
        todo = list(states)
        while todo:
            s = todo.pop()
            cost, audit, turns = states[s]
            role = "assistant" if s == "u" else "user"
            new = (cost + 5, audit + "I", [*turns, (role, "")])
            if role[0] not in states or new[:2] < states[role[0]][:2]:
                states[role[0]] = new
                todo.append(role[0])
        return states

    states = inserted({"start": (0, "", [])})
    for (role, text), fault in zip(rows, faults(rows)):
        new = {}

        def offer(s, x):
            if s not in new or x[:2] < new[s][:2]:
                new[s] = x

        for s, (cost, audit, turns) in states.items():
            offer(s, (cost + 2, audit + "D", turns))
            if fault in ("blank", "duplicate"):
                continue
            extra = 5 * (fault == "truncated")
            next_role = "assistant" if s == "u" else "user"
            if role[:1] == next_role[0] or (role[:1] == "s" and s == "start"):
                offer(role[:1], (cost + extra, audit + "K", [*turns, (role, text)]))
            offer(next_role[0], (cost + extra + 1, audit + "R", [*turns, (next_role, text)]))
        states = inserted(new)
    return min((states[s] for s in ("start", "a") if s in states), key=lambda x: x[:2])


def exhaustive(rows):
    """All edit sequences with up to three inserts."""
    found, bad = [], faults(rows)
    for inserts in range(4):
        for edits in itertools.product("DKR", repeat=len(rows)):
            for places in itertools.combinations_with_replacement(range(len(rows) + 1), inserts):
                audit = "".join("I" * places.count(i) + (edits[i] if i < len(rows) else "") for i in range(len(rows) + 1))
                options, cost, at = [""], 0, 0
                for letter in audit:
                    if letter == "I":
                        cost, options = cost + 5, [o + r for o in options for r in "ua"]
                        continue
                    role, fault = rows[at][0], bad[at]
                    at += 1
                    if letter == "D":
                        cost += 2
                    elif fault in ("blank", "duplicate"):
                        cost += 10**6
                    else:
                        cost += (letter == "R") + 5 * (fault == "truncated")
                        options = [o + r for o in options for r in ("ua" if letter == "R" else role[:1] or "?")]
                if any(GRAMMAR.fullmatch(o) for o in options):
                    found.append((cost, audit))
    return min(found)


def report(rows):
    """Of (turn, role, text) in order."""
    turns = [t for t, _, _ in rows if t is not None]
    pairs = [(r, t) for _, r, t in rows]
    kinds = Counter(faults(pairs))
    cost, audit, repaired = cheapest(pairs)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, kinds["blank"], kinds["duplicate"], kinds["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()


def want(rows, damaged=True):
    talks = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damaged else 9
        talks[conv]
        if h == 0:
            continue
        text = "" if h == 1 else re.sub(r"[.!?]", "", text) if h == 2 else text
        talks[conv] += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    order = lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())
    return {conv: report(sorted(x, key=order)) for conv, x in talks.items()}


def random_turns(rng, n):
    return [(rng.choice(["user", "assistant", "system", "user", "assistant", "tool", ""]), rng.choice(["a.", "b!", "c", "", f"{rng.random()}.", f"{rng.random()}.", f"{rng.random()}"])) for _ in range(n)]


def test_alignment_by_every_edit():
    rng = random.Random(4)
    for _ in range(120):
        rows = random_turns(rng, rng.randrange(5))
        out = []
        talk = turn_repair.Conversation(lambda letter, *x: out.append(letter))
        for (role, text), fault in zip(rows, faults(rows)):
            talk.add(role, text, None, "x" if fault in ("blank", "duplicate") else "t" if fault else "-")
        assert (talk.end(), "".join(out)) == exhaustive(rows) == cheapest(rows)[:2]


@pytest.mark.parametrize("segment", [64, 7, 1])
def test_long_conversations_in_segments(monkeypatch, segment):
    monkeypatch.setattr(turn_repair, "SEGMENT", segment)
    rng, held = random.Random(segment), []
    for n in [*range(40), 64, 65, 150, 700]:
        rows = random_turns(rng, n)
        out = []
        talk = turn_repair.Conversation(lambda letter, *x: out.append(letter))
        for (role, text), fault in zip(rows, faults(rows)):
            talk.add(role, text, None, "x" if fault in ("blank", "duplicate") else "t" if fault else "-")
            held.append(len(talk.segments))
        assert (talk.end(), "".join(out)) == cheapest(rows)[:2]
    assert max(held) < 15 or segment == 1


def test_repair(spark):
    rng = random.Random(6)
    rows = []
    for conv in range(150):
        for turn, (role, text) in enumerate(random_turns(rng, rng.randrange(1, 12))):
            rows.append((conv, turn + (turn > 5), role, text + rng.choice(["", " ", "\n\t", "\xa0", "\x00"])))
    rows += [(200, t, r, x) for t, (r, x) in enumerate(random_turns(rng, 900))]  # more than a segment
    rows += [(None, 3, "user", "No id."), (None, None, None, None), (201, None, "user", "Q?"), (201, None, "assistant", "A."), (201, None, "assistant", "A."), (202, 5, None, "x."), (203, -(1 << 63), "user", "b."), (203, (1 << 63) - 1, "assistant", "c.")]
    rows += [(204, 1, "user", "long " * 1_000_000 + "."), (204, 2, "assistant", "x" * 3_000_000)]
    gone = next(i for i in range(300, 1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows += [(gone, 0, "user", "Dropped."), rows[0], rows[1]]
    frame = spark.createDataFrame([(*r, 1, 2, "n") for r in rows], SCHEMA + ", again int, blank int, h string").repartition(7)
    expected = want(rows)
    expected[203] = ((1 << 63) - 1, *expected[203][1:])
    damaged = turn_repair.damage(frame)
    got = turn_repair.repair(damaged)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r.conv_id: tuple(r)[1:] for r in got.collect()} == expected
    assert expected[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    turns = defaultdict(list)
    for r in turn_repair.repair(damaged, emit="turns").collect():
        turns[r.conv_id].append((r.position, r.role, r.text, r.edit))
    for conv, (*_, audit, digest) in expected.items():
        mine = sorted(turns[conv])
        assert hashlib.sha256("\n".join(f"{r}:{t}" for _, r, t, _ in mine).encode()).hexdigest() == digest
        assert "".join(e for *_, e in mine) == audit.replace("D", "")
    plain = {r.conv_id: tuple(r)[1:] for r in turn_repair.repair(frame).collect()}
    expected = want(rows, damaged=False)
    expected[203] = ((1 << 63) - 1, *expected[203][1:])
    assert plain == expected
    assert turn_repair.repair(turn_repair.damage(frame.limit(0))).count() == 0


def test_every_given_conversation(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/conversations.parquet")
    got = {r.conv_id: tuple(r)[1:] for r in turn_repair.repair(turn_repair.damage(table)).collect()}
    assert got == want([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])


def test_sql(spark):
    """The SQL form over the given rows and over hard ones."""
    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text")
    rng = random.Random(12)
    rows = [(1000 + c, t if t % 4 else None, *x) for c in range(60) for t, x in enumerate(random_turns(rng, rng.randrange(1, 9)))] + [(None, None, None, None), (2000, 1, None, "x.")]
    both = table.union(spark.createDataFrame(rows, SCHEMA))
    con = duckdb.connect()
    con.register("conversations", both.toArrow())
    found = con.sql(turn_repair.SQL)
    got = turn_repair.repair(turn_repair.damage(both))
    assert found.columns == got.columns
    assert {tuple(r) for r in got.collect()} == set(found.fetchall())
