"""Conversation repair against a plain program over whole strings, and against all edit strings of short conversations."""

from __future__ import annotations

import hashlib
import itertools
import random
import zlib
from collections import defaultdict

import pytest
from test_operators import FIXTURE, collected, same

from tallyhouse.llm import queries, repair

#: Next state by state and initial; states are the strings "", "s", "u", "a".
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
WANTED = {"": "u", "s": "u", "u": "a", "a": "u"}


def plain_faults(rows):
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else None if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return faults


def plain_audit(rows, faults):
    """Cheapest and then least strings by state, as whole strings."""

    def inserted(best):
        for _ in range(4):
            for state, (cost, text) in list(best.items()):
                to = WANTED[state]
                best[to] = min(best.get(to, (10**9, "")), (cost + 2, text + "I"))
        return best

    best = inserted({"": (0, "")})
    for (_, role, _), fault in zip(rows, faults):
        then = {}
        for state, (cost, text) in best.items():
            options = [(state, cost + 3, "D")]
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if (state, role[:1]) in NEXT:
                    options.append((NEXT[state, role[:1]], cost + more, "K"))
                options.append((WANTED[state], cost + 2 + more, "R"))
            for to, price, letter in options:
                then[to] = min(then.get(to, (10**9, "")), (price, text + letter))
        best = inserted(then)
    return min(best[s] for s in ("", "a") if s in best)


def plain_repaired(rows, audit):
    state, left, said = "", iter(rows), []
    for letter in audit:
        _, role, text = (None, None, "") if letter == "I" else next(left)
        if letter == "D":
            continue
        if letter != "K":
            role = {"u": "user", "a": "assistant"}[WANTED[state]]
        state = NEXT[state, role[:1]]
        said.append(f"{role}:{text}")
    assert state in ("", "a") and next(left, None) is None
    return hashlib.sha256("\n".join(said).encode()).hexdigest()


def plain_summary(rows):
    faults = plain_faults(rows)
    cost, audit = plain_audit(rows, faults) if rows else (0, "")
    turns = [t for t, _, _ in rows if t is not None]
    initials = [role[:1] for _, role, _ in rows]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        cost,
        audit,
        plain_repaired(rows, audit),
    )


def ordered(rows):
    digest = lambda text: hashlib.sha256(text.encode()).digest()
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], digest(r[2])))


def audited(rows, faults):
    audit = repair.Audit()
    letters = []
    for (_, role, _), fault in zip(rows, faults):
        letters += audit.row(role[:1], fault)
    cost, rest = audit.end()
    return cost, "".join(letter for letter, _ in [*letters, *rest])


def test_all_short_conversations():
    """Every edit string of up to four rows, by trying them all."""
    for roles in itertools.product("suax", repeat=3):
        for faults in itertools.product((None, "blank", "truncated"), repeat=3):
            best = (10**9, "")
            for choice in itertools.product("DKR", repeat=3):
                for inserts in itertools.product(range(3), repeat=4):
                    audit = "I" * inserts[0] + "".join(c + "I" * n for c, n in zip(choice, inserts[1:]))
                    cost = 2 * sum(inserts) + sum({"D": 3, "K": 0, "R": 2}[c] + (f == "truncated" and c != "D") for c, f in zip(choice, faults))
                    if (cost, audit) >= best or any(f == "blank" and c != "D" for c, f in zip(choice, faults)):
                        continue
                    state, left = "", iter(roles)
                    for letter in audit:
                        role = None if letter == "I" else next(left)
                        if letter != "D":
                            state = NEXT.get((state, role)) if letter == "K" else WANTED[state]
                            if state is None:
                                break
                    if state in ("", "a"):
                        best = (cost, audit)
            rows = [(i, r, "t") for i, r in enumerate(roles)]
            assert audited(rows, faults) == best == plain_audit(rows, faults)


@pytest.mark.parametrize("seed", range(6))
def test_long_conversations(seed):
    """Edits are given out on the way; ties are as by whole strings."""
    r = random.Random(seed)
    kinds = ["ua", "suax", "s", "xx", "uuua", "au"][seed]
    rows = [(i, r.choice(kinds), "t") for i in range(700)]
    faults = [r.choice([None, None, "blank", "truncated"]) if seed != 3 else "blank" for _ in rows]
    assert audited(rows, faults) == plain_audit(rows, faults)


def test_memory_follows_the_undecided_rows():
    audit, given, most = repair.Audit(), 0, 0
    for i in range(20_000):
        given += sum(letter != "I" for letter, _ in audit.row("ua"[i % 2], None))
        most = max(most, i + 1 - given)
    assert most <= 2 * repair.STEP


def test_collisions_are_verified(monkeypatch):
    """With a hash that tells few strings apart, results stay."""
    monkeypatch.setattr(repair, "MODULUS", 3)
    for seed in range(20):
        r = random.Random(seed)
        rows = [(i, r.choice("suax"), "t") for i in range(60)]
        faults = [r.choice([None, "blank", "truncated"]) for _ in rows]
        assert audited(rows, faults) == plain_audit(rows, faults)


def test_summary_of_odd_rows(spark):
    long = [(7, i, r, f"{i}" * 50 + ".") for i, r in enumerate(["user", "assistant"] * 500)]
    odd = [
        (1, None, "user", "a."),
        (1, None, None, None),
        (1, 5, "assistant", "b"),
        (1, 5, "assistant", "b"),
        (1, 9, "assistant", "b"),
        (2, 0, "system", "é!"),
        (3, 3, "bot", " \t"),
        (None, 1, "user", "who?"),
        (None, 2, "user", "x" * 100_000),
        (None, 3, "", ""),
        *long,
    ]
    df = spark.createDataFrame([(*r, 1, 2) for r in odd], "conv_id long, turn int, role string, text string, digest int, copy int")
    turns = defaultdict(list)
    for conv_id, turn, role, text in odd:
        turns[conv_id].append((turn, role or "", text or ""))
    found = collected(repair.summary(repair.edits(df)))
    same(found, [(c, *plain_summary(ordered(rows))) for c, rows in turns.items()])
    edited = repair.edits(df).collect()
    kept = [r for r in edited if r.conv_id == 7]
    assert [(r.turn, r.role, r.text) for r in kept] == [(t, r, x) for _, t, r, x in long]
    assert [r.cost for r in edited if r.cost is not None and r.conv_id == 7] == [0]


def test_repair_of_an_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    assert repair.summary(repair.edits(df)).count() == 0


def test_query(spark):
    rows = spark.read.parquet(f"{FIXTURE}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    turns = defaultdict(list)
    for conv_id, turn, role, text in rows:
        role, text = role or " ", text or ("" if text == "" else " ")
        own = turns[conv_id]
        h = zlib.crc32(f"{conv_id}:{' ' if turn is None else turn}".encode()) % 20
        if h == 0:
            continue
        role = "user" if h == 4 else role
        text = "" if h == 1 else text.translate(dict.fromkeys(map(ord, ".!?"))) if h == 2 else text
        own += [(turn, role, text)] * (1 + (h == 3))
    found = collected(queries.op13_conversation_repair(spark, FIXTURE))
    same(found, [(c, *plain_summary(ordered(own))) for c, own in turns.items()])
    assert any("R" in r[7] for r in found) and any("I" in r[7] for r in found)


def test_conversations_left_empty(spark, tmp_path):
    turn = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    spark.createDataFrame([(5, turn, "user", "x")], "conv_id long, turn long, role string, text string").write.parquet(
        f"{tmp_path}/conversations.parquet"
    )
    nothing = hashlib.sha256(b"").hexdigest()
    assert collected(queries.op13_conversation_repair(spark, str(tmp_path))) == [(5, 0, 0, 0, 0, 0, 0, "", nothing)]
