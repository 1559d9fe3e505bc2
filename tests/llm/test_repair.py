"""Repair of conversations against brute force, rows by rows and whole."""

import hashlib
import random
import re
import zlib
from functools import cache

import pytest

from deskwise.llm import conversations
from deskwise.llm.conversations import ASSISTANT, NEXT, ROLES, START, Repair


def cheapest(rows):
    """Cost, initials and lines of the least edits, from the end: rows are (role, text, must go, truncated)."""

    @cache
    def best(i, state, put_in):
        found = [(0, "", ())] if i == len(rows) and state in (START, ASSISTANT) else []

        def take(cost, mark, rest, line=()):
            if rest:
                found.append((cost + rest[0], mark + rest[1], line + rest[2]))

        if put_in < 3:
            for initial, role in ROLES.items():
                if initial in NEXT[state]:
                    take(5, "I", best(i, NEXT[state][initial], put_in + 1), (f"{role}:",))
        if i < len(rows):
            role, text, must_go, truncated = rows[i]
            take(2, "D", best(i + 1, state, 0))
            for initial, after in NEXT[state].items():
                if must_go:
                    break
                if role[:1] == initial:
                    take(5 * truncated, "K", best(i + 1, after, 0), (f"{role}:{text}",))
                if initial in ROLES:
                    take(1 + 5 * truncated, "R", best(i + 1, after, 0), (f"{ROLES[initial]}:{text}",))
        return min(found, default=None)

    for i in range(len(rows), 0, -1):
        best(i, ASSISTANT, 0)  # so that calls don't nest deeply
    cost, audit, lines = best(0, START, 0)
    return cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def plain(rows):
    """Every conversation's result from (conv_id, turn, role, text)."""
    every, held = [], {}
    for conv, turn, role, text in rows:
        if conv not in every:
            every.append(conv)
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault:
            order = (turn is not None, turn or 0, role, hashlib.sha256(text.encode()).hexdigest())
            new = ("user" if fault == 4 else role, "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text)
            held.setdefault(conv, []).extend([(order, turn, *new)] * (2 if fault == 3 else 1))
    out = []
    for conv in every:
        told, said, given = sorted(held.get(conv, []), key=lambda r: r[0]), set(), []
        count = dict(blank=0, duplicate=0, truncated=0)
        for _, _, role, text in told:
            shown = text.strip(" \t\n\v\f\r")
            kind = "blank" if not shown else "duplicate" if (role, text) in said else "truncated" if shown[-1] not in ".!?" else None
            said.add((role, text))
            if kind:
                count[kind] += 1
            given.append((role, text, kind in ("blank", "duplicate"), kind == "truncated"))
        turns = {t for _, t, _, _ in told if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(given, given[1:], strict=False))
        out.append((conv, gaps, *count.values(), illegal, *cheapest(given)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("flush", [1, 3, 256])
def test_edits(monkeypatch, flush):
    monkeypatch.setattr(conversations, "FLUSH", flush)
    rng = random.Random(flush)
    for _ in range(1500):
        roles = rng.choice(["su", "ua", "suax", ["user", "assistant", "system", "tool", "", "unit"]])
        rows = [(rng.choice(roles), rng.choice("ab"), rng.random() < 0.15, rng.random() < 0.2) for _ in range(rng.randrange(0, 14))]
        repair = Repair()
        for row in rows:
            repair.add(*row)
        assert repair.end() == cheapest(rows), rows


def test_equal_hashes_are_verified(monkeypatch):
    """All hashes meet, and the ways are compared by their edits."""
    monkeypatch.setattr(conversations, "_MOD", 1)
    rng = random.Random(5)
    for _ in range(300):
        rows = [(rng.choice("sua"), "x", rng.random() < 0.1, rng.random() < 0.2) for _ in range(rng.randrange(0, 12))]
        repair = Repair()
        for row in rows:
            repair.add(*row)
        assert repair.end() == cheapest(rows)


def test_long_conversation_is_not_held():
    repair, most = Repair(), 0
    rng = random.Random(3)
    for i in range(20_000):
        repair.add(rng.choice(["user", "assistant"]), str(i), i % 7 == 0, i % 5 == 0)
        most = max(most, *(node.depth - repair.told for _, node in repair.ways.values()))
    assert most < 3 * conversations.FLUSH
    cost, audit, _ = repair.end()
    assert len(audit.replace("I", "")) == 20_000 and cost > 0


def _rows(found):
    return sorted((tuple(r) for r in found.collect()), key=repr)


def test_conversations(spark, small, results):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in spark.read.parquet(f"{small}/conversations.parquet").collect()]
    found = sorted(map(tuple, results("op13_conversation_repair")), key=repr)
    assert found == plain(rows)
    assert len({r[7] for r in found}) > 5


def test_odd_conversations(spark):
    """Nulls in any column, equal turns, repeated rows, odd roles, extra columns of clashing names, one long text."""
    rng = random.Random(9)
    some = lambda *of: rng.choice(of)
    rows = [(some(1, 2, 3, 4, 5, None), some(None, 0, 1, 2, 5, 9), some("user", "assistant", "system", None, "", "User", "ux"), some("A.", "B?", "c", "", None, " \n", "Ünï! ", "x" * 50_000 + ".")) for _ in range(120)]
    rows += rows[:20]
    frame = spark.createDataFrame([(*r, "x", 1, True) for r in rows], "conv_id long, turn long, role string, text string, place string, copy int, gone boolean")
    assert _rows(conversations.repaired(frame)) == plain(rows)
    assert conversations.repaired(frame.limit(0)).count() == 0


def test_many_rows_of_one_conversation(spark):
    rows = [(0, i // 3, ("user", "assistant", "system")[i % 3], f"Text {i % 50}.") for i in range(900)] + [(f, 0, "user", "Hello.") for f in range(1, 60)]
    assert _rows(conversations.repaired(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))) == plain(rows)
