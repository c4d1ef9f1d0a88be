"""Repairs against exhaustive search, blocks against whole conversations, rows against digests."""

import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from mediacat.llm import queries, thread_repair as repair
from mediacat.llm.audit_tree import AuditTree

SCHEMA = "conv_id bigint, turn bigint, role string, text string, place string"
BLANKS = " \t\n\x0b\x0c\r"


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        end = text.rstrip(BLANKS)
        out.append("b" if not end else "d" if (role, text) in seen else "-" if end[-1] in ".!?" else "t")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, repaired) by plain texts: every state keeps its least (cost, audit)."""
    now = {"": (0, "", ())}  # by last initial

    def follow(now, steps):
        out = {}
        for end, (cost, audit, lines) in now.items():
            for more, letters, role, text in steps(end):
                key = end if role is None else role[:1]
                new = (cost + more, audit + letters, lines if role is None else (*lines, f"{role}:{text}"))
                out[key] = min(out.get(key, new), new)
        return out

    def insertions(now):
        for _ in range(2):
            more = follow(now, lambda end: [(5, "I", "assistant" if end == "u" else "user", "")])
            now = {k: min(x for x in (now.get(k), more.get(k)) if x) for k in {*now, *more}}
        return now

    for (role, text), fault in zip(rows, faults_of(rows)):
        extra = 5 if fault == "t" else 0

        def steps(end):
            yield 2, "D", None, None
            if fault in "bd":
                return
            if role[:1] + ">" + end in ("s>", "u>", "u>s", "u>a", "a>u"):
                yield extra, "K", role, text
            yield extra + 1, "R", "assistant" if end == "u" else "user", text

        now = follow(insertions(now), steps)
    now = insertions(now)
    return min(now[k] for k in ("", "a") if k in now)


def brute(rows):
    cost, audit, lines = cheapest(rows)
    faults = faults_of(rows)
    initials = "".join((r[:1] or "-") for r, _ in rows)
    illegal = sum(initials[i : i + 2] not in ("su", "ua", "au") for i in range(len(initials) - 1))
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return (*[faults.count(f) for f in "bdt"], illegal, cost, audit, digest)


def test_exhaustive_search_agrees():
    """The reference above against all scripts of short conversations."""
    def scripts(rows):
        slots = ["", "I", "II"]
        for gaps in itertools.product(slots, repeat=len(rows) + 1):
            for edits in itertools.product("DKR", repeat=len(rows)):
                yield "".join(g + e for g, e in zip(gaps, (*edits, "")))

    def price(rows, faults, audit):
        end, at, cost = "", 0, 0
        for letter in audit:
            nxt = "a" if end == "u" else "u"
            if letter == "I":
                end, cost = nxt, cost + 5
                continue
            (role, _), fault = rows[at], faults[at]
            at += 1
            if letter == "D":
                cost += 2
            elif fault in "bd":
                return None
            elif letter == "K":
                if role[:1] + ">" + end not in ("s>", "u>", "u>s", "u>a", "a>u"):
                    return None
                end, cost = role[:1], cost + 5 * (fault == "t")
            else:
                end, cost = nxt, cost + 1 + 5 * (fault == "t")
        return (cost, audit) if end in ("", "a") else None

    rng = random.Random(2)
    for _ in range(60):
        rows = [(rng.choice(["system", "user", "assistant", "tool"]), rng.choice(["a.", "b", "", "c!"])) for _ in range(rng.randint(0, 3))]
        faults = faults_of(rows)
        best = min(p for a in scripts(rows) if (p := price(rows, faults, a)))
        assert cheapest(rows)[:2] == best


def test_tree_compares_like_texts():
    rng = random.Random(3)
    tree, texts = AuditTree(), {0: []}
    for _ in range(400):
        parent, letter = rng.choice(list(texts)[-30:]), rng.randint(0, 1)
        texts[tree.add(parent, letter)] = [*texts[parent], letter]
    for _ in range(3000):
        a, b = rng.choice(list(texts)), rng.choice(list(texts))
        assert (tree.compare(a, b) > 0) - (tree.compare(a, b) < 0) == (texts[a] > texts[b]) - (texts[a] < texts[b])


def test_hashes_that_collide_are_noticed(monkeypatch):
    from mediacat.llm import audit_tree

    monkeypatch.setattr(audit_tree, "_MODULUS", 3)
    test_tree_compares_like_texts()


@pytest.mark.parametrize("size", [1, 2, 5])
def test_blocks_put_together(size):
    rng = random.Random(size)
    for _ in range(60):
        symbols = [rng.choice("suax") + rng.choice("---tbd") for _ in range(rng.randint(1, 14))]
        whole = repair._block_table("".join(symbols))
        parts = [repair._block_table("".join(symbols[i : i + size])) for i in range(0, len(symbols), size)]
        pairs = [repair._folded(parts[i : i + 3]) for i in range(0, len(parts), 3)]
        assert repair._folded(parts) == whole and repair._folded(pairs) == whole
        tables = [repair._Table(p["costs"], p["ranks"]) for p in parts]
        for entry, exit_ in itertools.product(range(4), repeat=2):
            if whole["costs"][4 * entry + exit_] >= 0:
                ways = repair.states_between(tables, entry, exit_)
                audit = "".join(
                    repair.block_ways("".join(symbols[i * size : (i + 1) * size]), e)[2][x] for i, (e, x) in enumerate(ways)
                )
                assert audit == repair.block_ways("".join(symbols), entry)[2][exit_]


def conversations(rng):
    out, texts = {}, ["a.", "b!", "c", "d? \n", " ", "", None, "e.\x0b", "long " * 40_000 + "."]
    for conv in [None, *range(60)]:
        n = rng.choice([1, 2, 5, 9, 30])
        roles = ["system", "user", "assistant", "user", "assistant", "tool", None, ""]
        out[conv] = [(conv, i if i else None, rng.choice(roles), rng.choice(texts)) for i in range(n)]
    out[100] = [(100, i, ["user", "assistant"][i % 2], f"{i}.") for i in range(40)]
    return out


def test_rows_against_brute_force(spark, monkeypatch):
    made = conversations(random.Random(1))
    rows = [(*r, "x") for c in made.values() for r in c]
    random.Random(2).shuffle(rows)
    for bits in (1, 12):
        monkeypatch.setattr(repair, "_BLOCK_BITS", bits)
        found = repair.repair_threads(spark.createDataFrame(rows, SCHEMA).repartition(3))
        digests = {r.conv_id: r.sha256 for r in repair.thread_digests(found.turns).collect()}
        got = {r.conv_id: r for r in found.conversations.collect()}
        assert set(got) == set(made) == set(digests)
        for conv, turns in made.items():
            r = got[conv]
            want = brute([(a or (" " if a is None else a), b if b is not None else " ") for _, _, a, b in turns])
            assert (r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, digests[conv]) == want
            assert r.n_rows == len(turns) and r.gaps == 0
        edits = [(t.conv_id, t.edit) for t in found.turns.orderBy("place", "step").collect()]
        assert all("".join(e for c, e in edits if c == conv) == got[conv].audit for conv in made)


def test_gaps_and_ties(spark):
    rows = [(1, 3, "user", "a.", ""), (1, 9, "assistant", "b.", ""), (1, None, "system", "s.", ""), (1, 9, "assistant", "b.", ""),
            (2, None, "user", "a.", ""), (3, -(2**63), "user", "x.", ""), (3, 2**63 - 1, "assistant", "y.", "")]
    found = repair.repair_threads(spark.createDataFrame(rows, SCHEMA))
    got = {r.conv_id: r for r in found.conversations.collect()}
    assert (got[1].gaps, got[1].audit, got[1].duplicate, got[1].illegal) == (5, "KKKD", 1, 1)
    assert (got[2].gaps, got[2].audit, got[2].cost) == (0, "D", 2)
    assert got[3].audit == "KK"


def test_no_rows(spark):
    found = repair.repair_threads(spark.createDataFrame([], SCHEMA))
    assert found.conversations.collect() == [] and found.turns.collect() == []
    assert repair.thread_digests(found.turns).collect() == []


def test_damage(spark):
    import zlib

    rows = [(c, t, "assistant", "a.b!c?") for c in [None, *range(30)] for t in [None, *range(6)]]
    got = queries.damaged(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        row = (c, t, "user" if kind == 4 else role, {1: "", 2: "abc"}.get(kind, text))
        want += [row] * {0: 0, 3: 2}.get(kind, 1)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
