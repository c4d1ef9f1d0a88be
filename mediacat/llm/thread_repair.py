"""Repairing the turns of conversations at least cost.

The project has no conversations, so this works on any table of (conv_id, turn, role, text).

A conversation is read by an automaton with four states: nothing yet, after the system turn,
after a user turn, after an assistant turn. The cheapest edits up to a row, for each state,
follow from those up to the row before, and equal costs are told apart by their audits,
which ``audit_tree`` compares. A conversation may be of any length: rows are sorted by
ranges and cut into blocks, each block gives the cost of getting from every state to every
other and the order of the audits that do so, and such tables are put together in the same
way, by task and then by conversation. Then the states are read back down to the blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cmp_to_key, lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from mediacat.llm.audit_tree import AuditTree
from mediacat.llm.registry import written

START, SYSTEM, USER, ASSISTANT = range(4)
_STATES = range(4)
#: What rows and insertions cost.
RE_ROLE, DELETE, INSERT, LEFT_TRUNCATED = 1, 2, 5, 5
_LETTERS = "DIKR"  # in order of code points; edits are letters by their place here
_D, _I, _K, _R = range(4)
#: State after a turn of this initial, by state before.
_AFTER = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
_INSERTED = {START: "user", SYSTEM: "user", ASSISTANT: "user", USER: "assistant"}
_BLOCK_BITS, _TASK_BITS = 12, 33
_NONE = -1
_BLANK_CHARS = " \t\n\x0b\x0c\r"
#: Ways through short conversations are kept, by their rows: many conversations look alike.
_KEPT, _KEPT_ROWS = 20_000, 32


class _Table:
    """Cost of getting from each state to each (-1: no way), and the order of those ways.

    Ways from one state have different ranks: an audit leads to one state only.
    """

    def __init__(self, costs: list[int], ranks: list[int]):
        self.costs, self.ranks = costs, ranks


def _ranked(tree: AuditTree, ends: list[tuple[int, int] | None]) -> tuple[list[int], list[int]]:
    """Costs and ranks of the ways that lead from one state to the others."""
    there = [t for t in _STATES if ends[t] is not None]
    there.sort(key=cmp_to_key(lambda x, y: tree.compare(ends[x][1], ends[y][1])))
    ranks = [_NONE] * 4
    for rank, t in enumerate(there):
        ranks[t] = rank
    return [_NONE if e is None else e[0] for e in ends], ranks


def _better(tree: AuditTree, have: tuple | None, cost: int, parent: int, letter: int) -> tuple:
    """The cheaper of ``have`` and one more letter behind ``parent``, of equal ones the least."""
    if have is not None and have[0] < cost:
        return have
    node = tree.add(parent, letter)
    if have is not None and have[0] == cost and tree.compare(have[1], node) <= 0:
        return have
    return cost, node


def _one_row(tree: AuditTree, now: list, initial: str, fault: str) -> list:
    """The cheapest (cost, audit) of each state after a row."""
    ready = list(now)
    for before, after in ((START, USER), (SYSTEM, USER), (ASSISTANT, USER), (USER, ASSISTANT)):
        origin = ready[before] if before == USER else now[before]
        if origin is not None:
            ready[after] = _better(tree, ready[after], origin[0] + INSERT, origin[1], _I)
    nxt = [None] * 4
    extra = LEFT_TRUNCATED if fault == "t" else 0
    for state in _STATES:
        if ready[state] is None:
            continue
        cost, node = ready[state]
        nxt[state] = _better(tree, nxt[state], cost + DELETE, node, _D)
        if fault in "bd":
            continue
        if (after := _AFTER.get((initial, state))) is not None:
            nxt[after] = _better(tree, nxt[after], cost + extra, node, _K)
        after = ASSISTANT if state == USER else USER
        nxt[after] = _better(tree, nxt[after], cost + extra + RE_ROLE, node, _R)
    return nxt


def block_ways(symbols: str, entry: int) -> tuple[list[int], list[int], list[str | None]]:
    """Costs, ranks and audits from state ``entry`` to each, over rows of two characters.

    The first is the initial of the role, the second the fault: b, d, t or -.
    """
    return (_kept_ways if len(symbols) <= 2 * _KEPT_ROWS else _ways)(symbols, entry)


def _ways(symbols: str, entry: int) -> tuple[list[int], list[int], list[str | None]]:
    tree = AuditTree()
    now: list = [None] * 4
    now[entry] = (0, 0)
    for at in range(0, len(symbols), 2):
        now = _one_row(tree, now, symbols[at], symbols[at + 1])
    audits = [None if e is None else "".join(_LETTERS[x] for x in tree.letters(e[1])) for e in now]
    return *_ranked(tree, now), audits


_kept_ways = lru_cache(maxsize=_KEPT)(_ways)


def _along(tables: list[_Table], entry: int) -> tuple[AuditTree, list, dict]:
    """Ways through consecutive tables: a letter is the rank of the way through one table."""
    tree = AuditTree()
    now: list = [None] * 4
    now[entry] = (0, 0)
    came = {}
    for table in tables:
        nxt: list = [None] * 4
        for s in _STATES:
            if now[s] is None:
                continue
            for t in _STATES:
                if (cost := table.costs[4 * s + t]) != _NONE:
                    found = _better(tree, nxt[t], now[s][0] + cost, now[s][1], table.ranks[4 * s + t])
                    if found is not nxt[t]:
                        came[found[1]] = s
                        nxt[t] = found
        now = nxt
    return tree, now, came


def fold(tables: list[_Table]) -> _Table:
    if len(tables) == 1:
        return tables[0]
    costs, ranks = [], []
    for entry in _STATES:
        tree, ends, _ = _along(tables, entry)
        c, r = _ranked(tree, ends)
        costs += c
        ranks += r
    return _Table(costs, ranks)


def states_between(tables: list[_Table], entry: int, exit_: int) -> list[tuple[int, int]]:
    """(entry, exit) of each table on the best way from one state to another."""
    if len(tables) == 1:
        return [(entry, exit_)]
    tree, ends, came = _along(tables, entry)
    node, out = ends[exit_][1], []
    while node:
        before = came[node]
        out.append((before, exit_))
        exit_, node = before, tree.up[node][0]
    return out[::-1]


def closing(table: _Table) -> tuple[int, int, str]:
    """(cost, last state, insertions at the end) of the best repair of a whole conversation."""
    ways = []
    for t, ending in ((START, ""), (ASSISTANT, ""), (USER, "I"), (SYSTEM, "II")):
        if table.costs[t] != _NONE:
            ways.append((table.costs[t] + INSERT * len(ending), table.ranks[t], t, ending))
    cost, _, state, ending = min(ways)
    return cost, state, ending


def _illegal(initials: str) -> int:
    return sum(initials[i : i + 2] not in ("su", "ua", "au") for i in range(len(initials) - 1))


_COUNTS = ["blank", "duplicate", "truncated", "illegal"]
_TABLE = (
    "costs array<bigint>, ranks array<int>, blank bigint, duplicate bigint, truncated bigint,"
    " illegal bigint, head string, tail string"
)
_TABLE_COLUMNS = ["costs", "ranks", *_COUNTS, "head", "tail"]


def _block_table(symbols: str) -> dict:
    costs, ranks = [], []
    for entry in _STATES:
        c, r, _ = block_ways(symbols, entry)
        costs += c
        ranks += r
    faults, initials = symbols[1::2], symbols[0::2]
    return {
        "costs": costs, "ranks": ranks, "blank": faults.count("b"), "duplicate": faults.count("d"),
        "truncated": faults.count("t"), "illegal": _illegal(initials), "head": initials[0], "tail": initials[-1],
    }


def _folded(tables: list[dict]) -> dict:
    """One table of consecutive ones, with their counts."""
    whole = fold([_Table(t["costs"], t["ranks"]) for t in tables])
    out = {"costs": whole.costs, "ranks": whole.ranks, "head": tables[0]["head"], "tail": tables[-1]["tail"]}
    for name in _COUNTS:
        out[name] = sum(t[name] for t in tables)
    out["illegal"] += sum(_illegal(a["tail"] + b["head"]) for a, b in zip(tables, tables[1:]))
    return out


def _mapped(df: DataFrame, make, schema: str) -> DataFrame:
    """``make`` from the dicts of a batch of rows to dicts of ``schema``."""
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [out for row in batch.to_pylist() for out in make(row)]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_arrow(kind))

    return df.mapInArrow(run, kind)


def _arrow(kind: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(kind)


def sorted_turns(turns: DataFrame) -> DataFrame:
    """Turns in order of conversation and turn (NULL first), numbered by ``place``.

    Ties go by role and text, equal rows stay side by side. NULL roles and texts count as one
    space. The rows are dealt out by ranges, so a long conversation spans several tasks.
    """
    rows = turns.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
        F.xxhash64(F.monotonically_increasing_id()).alias("tie"),
    )
    order = ["conv_id", "turn", "role", F.xxhash64("text"), "text"]
    ranged = rows.repartitionByRange("conv_id", "turn", "role", F.xxhash64("text"), "tie")
    return written(ranged.sortWithinPartitions(*order).drop("tie").withColumn("place", F.monotonically_increasing_id()))


def _initial(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first.isin("s", "u", "a"), first).otherwise("x")


def _blocks(rows: DataFrame) -> DataFrame:
    """(conv_id, start, symbols): faults and initials of up to 4,096 rows of a conversation."""
    trimmed = F.rtrim("text", F.lit(_BLANK_CHARS))
    marks = rows.select(
        "conv_id", "place", _initial(F.col("role")).alias("initial"),
        F.when(trimmed == "", "b").when(~F.right(trimmed, F.lit(1)).isin(".", "!", "?"), "t").otherwise("-").alias("fault"),
        F.sha2(F.concat_ws("\x00", F.length("role").cast("string"), "role", "text"), 256).alias("digest"),
    )
    firsts = marks.groupBy("conv_id", "digest").agg(F.min("place").alias("place"))
    both = marks.drop("digest").withColumn("first", F.lit(0)).unionByName(
        firsts.select("conv_id", "place", F.lit(None).cast("string").alias("initial"),
                      F.lit(None).cast("string").alias("fault"), F.lit(1).alias("first"))
    ).withColumn("block", F.shiftright("place", _BLOCK_BITS))
    each = both.repartition("conv_id", "block").groupBy("conv_id", "block", "place").agg(
        F.max("initial").alias("initial"), F.max("fault").alias("fault"), F.max("first").alias("first")
    )
    symbol = F.concat("initial", F.when((F.col("first") == 0) & (F.col("fault") != "b"), "d").otherwise(F.col("fault")))
    return each.groupBy("conv_id", "block").agg(
        F.min("place").alias("start"), F.sort_array(F.collect_list(F.struct("place", symbol.alias("symbol")))).alias("found")
    ).select("conv_id", "start", F.array_join(F.col("found.symbol"), "").alias("symbols"))


@dataclass
class Repair:
    """``conversations``: one row each. ``turns``: one row per edit, in order of place and step."""

    conversations: DataFrame
    turns: DataFrame


def repair_threads(turns: DataFrame) -> Repair:
    """The cheapest edits that make each conversation an optional system turn and then user
    and assistant turns by turns, or nothing.

    ``turns`` has conv_id, turn, role and text; other columns do not matter. Rows go by turn,
    NULL first, then by role and text. Faults of a row, of which the first counts: blank
    text; a duplicate of an earlier role and text; truncated, if the last character that is
    no space is none of ``.!?``. Keep costs 0, Rerole to user or assistant 1, Delete 2 (a must
    for blank and duplicate rows), Insert of an empty user or assistant turn 5; truncated
    rows that stay cost 5 more. Of equally cheap repairs the one whose audit, the initials of
    its edits in order, is least counts. Roles are told by their first letter (s, u, a).

    ``conversations`` has conv_id, n_rows, gaps (turn numbers left out between the smallest
    and the largest), blank, duplicate, truncated, illegal (neighbours whose initials are not
    su, ua or au), cost and audit. ``turns`` has conv_id, place, step, edit, role and text of
    all edits, deletions among them; places grow with the order of rows.

    NULL conv_ids are one conversation; NULL roles and texts count as one space; duplicates
    are told by SHA-256. Texts may be of any length. No rows, no rows.
    """
    rows = sorted_turns(turns)
    conv = rows.schema["conv_id"]
    id_type = conv.dataType.simpleString()
    blocks = written(_mapped(
        _blocks(rows), lambda r: [r | _block_table(r["symbols"])],
        StructType([conv, *StructType.fromDDL(f"start bigint, symbols string, {_TABLE}").fields]),
    ))
    table = F.struct("start", *_TABLE_COLUMNS).alias("table")

    def gathered(df: DataFrame, *by) -> DataFrame:
        return df.groupBy("conv_id", *by).agg(F.sort_array(F.collect_list(table)).alias("parts")).select("conv_id", "parts")

    by_task = gathered(blocks, F.shiftright("start", _TASK_BITS))
    part_tables = _mapped(
        by_task, lambda r: [_folded(r["parts"]) | {"conv_id": r["conv_id"], "start": r["parts"][0]["start"]}],
        StructType([conv, *StructType.fromDDL(f"start bigint, {_TABLE}").fields]),
    )

    def finish(row: dict) -> list[dict]:
        whole = _folded(row["parts"])
        cost, state, ending = closing(_Table(whole["costs"], whole["ranks"]))
        ways = states_between([_Table(p["costs"], p["ranks"]) for p in row["parts"]], START, state)
        path = [
            {"start": p["start"], "entry": entry, "exit": exit_, "ending": ""} for p, (entry, exit_) in zip(row["parts"], ways)
        ]
        path[-1]["ending"] = ending
        return [{name: whole[name] for name in _COUNTS} | {"conv_id": row["conv_id"], "cost": cost, "path": path}]

    decided = written(_mapped(
        gathered(part_tables), finish,
        StructType([conv, *StructType.fromDDL(
            "blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint,"
            " path array<struct<start: bigint, entry: int, exit: int, ending: string>>"
        ).fields]),
    ))

    def open_parts(row: dict) -> list[dict]:
        ways = states_between([_Table(p["costs"], p["ranks"]) for p in row["parts"]], row["entry"], row["exit"])
        out = [{"start": p["start"], "entry": e, "exit": x, "ending": ""} for p, (e, x) in zip(row["parts"], ways)]
        out[-1]["ending"] = row["ending"]
        return out

    steps = decided.select(F.inline("path"))
    opened = _mapped(
        steps.join(by_task.select(F.col("parts")[0]["start"].alias("start"), "parts"), "start"),
        open_parts, "start bigint, entry int, exit int, ending string",
    )
    audited = written(_mapped(
        opened.join(blocks.select("conv_id", "start", "symbols"), "start"),
        lambda r: [{
            "conv_id": r["conv_id"], "start": r["start"], "entry": r["entry"], "symbols": r["symbols"],
            "audit": block_ways(r["symbols"], r["entry"])[2][r["exit"]] + r["ending"],
        }],
        StructType([conv, *StructType.fromDDL("start bigint, entry int, symbols string, audit string").fields]),
    ))
    audits = audited.groupBy("conv_id").agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("start", "audit")))["audit"], "").alias("audit")
    )
    spans = rows.groupBy("conv_id", "turn").agg(F.count("*").alias("n")).groupBy("conv_id").agg(
        F.sum("n").alias("n_rows"), F.count("turn").alias("numbers"),
        (F.max(F.col("turn").cast("decimal(20,0)")) - F.min("turn") + 1).alias("span"),
    ).select("conv_id", "n_rows", F.expr("coalesce(try_cast(span - numbers AS bigint), 0)").alias("gaps"))
    same = lambda a, b: a["conv_id"].eqNullSafe(b["conv_id"])
    conversations = (
        decided.drop("path").join(spans, same(decided, spans)).drop(spans["conv_id"])
    )
    conversations = conversations.join(audits, same(conversations, audits)).drop(audits["conv_id"]).select(
        "conv_id", "n_rows", "gaps", *_COUNTS, "cost", "audit"
    )
    return Repair(conversations, _edited(rows, audited))


def _row_edits(row: dict) -> list[dict]:
    """The edits of each row of a block: what is inserted before it, its own, what follows."""
    state, place, before, out = row["entry"], row["start"], [], []
    initials = row["symbols"][0::2]
    for letter in row["audit"]:
        if letter == "I":
            before.append(_INSERTED[state])
            state = ASSISTANT if state == USER else USER
            continue
        role = None
        if letter == "R":
            role = _INSERTED[state]
            state = ASSISTANT if state == USER else USER
        elif letter == "K":
            state = _AFTER[initials[len(out)], state]
        out.append({"place": place, "edit": letter, "new_role": role, "before": before, "behind": []})
        before, place = [], place + 1
    out[-1]["behind"] = before
    return out


def _edited(rows: DataFrame, audited: DataFrame) -> DataFrame:
    edits = _mapped(
        audited, _row_edits,
        "place bigint, edit string, new_role string, before array<string>, behind array<string>",
    )

    def inserted(roles):
        return F.transform(roles, lambda role: F.struct(F.lit("I").alias("edit"), role.alias("role"), F.lit("").alias("text")))

    own = F.array(F.struct("edit", F.coalesce("new_role", "role").alias("role"), "text"))
    every = F.concat(inserted("before"), own, inserted("behind"))
    return rows.join(edits, "place").select("conv_id", "place", F.posexplode(every).alias("step", "e")).select(
        "conv_id", "place", "step", "e.edit", "e.role", "e.text"
    )


def thread_digests(turns: DataFrame) -> DataFrame:
    """(conv_id, sha256) of the repaired conversations: lines ``role:text`` joined by newlines.

    A digest is read from beginning to end, so one task reads all turns of a conversation,
    sorted by Spark and held one batch at a time.
    """
    conv = turns.schema["conv_id"]
    wanted = turns.repartition("conv_id").sortWithinPartitions("conv_id", "place", "step")
    schema = StructType([conv, StructField("sha256", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, any_line, open_ = None, False, None
        for batch in batches:
            done = []
            for conv_id, edit, role, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if open_ is None or conv_id != current:
                    if open_ is not None:
                        done.append({"conv_id": current, "sha256": open_.hexdigest()})
                    current, any_line, open_ = conv_id, False, hashlib.sha256()
                if edit != "D":
                    open_.update(f"{chr(10) if any_line else ''}{role}:{text}".encode())
                    any_line = True
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=_arrow(schema))
        if open_ is not None:
            yield pa.RecordBatch.from_pylist([{"conv_id": current, "sha256": open_.hexdigest()}], schema=_arrow(schema))

    return wanted.select("conv_id", "edit", "role", "text").mapInArrow(run, schema)
