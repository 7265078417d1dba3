"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns in alternation, the user's first. A
dynamic program over this automaton chooses for each turn, at the least total cost, to keep it, to give it the role
of user or assistant instead (relabel), or to append it to the turn before (merge, also of relabelled turns), and to put empty turns of
users or assistants before it (insert). Among equal costs the choice that comes first in the list of moves wins, so results are reproducible.
The repaired conversation is rendered as one fragment for each input turn; joined in order of ``place`` they are
the text of the conversation. A merged turn has no head of its own, an inserted one is part of the fragment behind
it, and the last fragment closes the conversation.

Turns are ordered by ``turn``, null first, and turns of equal number by role and text; repeated rows are turns of
their own. Roles are compared in small letters without blanks around them; ``ALIASES`` names other words for the
three roles, any further role or null has to be relabelled. A null text is empty. Rows without ``conv_id`` are one
conversation. ``<|`` in a text is written as ``< |``, so that a text cannot forge a turn.

Long conversations are not gathered: rows are dealt out by ranges of (conversation, turn), and each range gives the
least cost from every state before its turns to every state behind them. These small tables are put together by
conversation, which fixes the states at the borders of the ranges; then each range traces its own moves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citetide.session import pin

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ("", "system", "user", "assistant")
#: Roles that may follow a state, and states in which a conversation may end.
FOLLOWS = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
ENDS = (USER, ASSISTANT, SYSTEM, START)
ALIASES = {"human": USER, "prompter": USER, "bot": ASSISTANT, "model": ASSISTANT, "gpt": ASSISTANT}
#: Costs of the moves.
MERGE, RELABEL, INSERT = 2, 3, 4
MOST_INSERTED = 2


def moves() -> list[tuple[int, int, int, int, str, tuple[int, ...]]]:
    """(state, role, next state, cost, action, inserted roles) of all moves; role 0 stands for an unknown role."""
    found = []
    for state in range(4):
        ways: list[tuple[int, ...]] = [()]
        for _ in range(MOST_INSERTED):
            ways += [way + (n,) for way in ways for n in FOLLOWS[way[-1] if way else state] if n != SYSTEM and way + (n,) not in ways]
        for role in range(4):
            for way in ways:
                last = way[-1] if way else state
                for to in FOLLOWS[last]:
                    if to == SYSTEM != role:
                        continue
                    cost = INSERT * len(way) + (0 if to == role else RELABEL)
                    found.append((state, role, to, cost, "keep" if to == role else "relabel", way))
            if state != START:
                same = state == role
                found.append((state, role, state, MERGE + (0 if same else RELABEL), "merge" if same else "relabel_merge", ()))
    return sorted(found, key=lambda m: (m[3], len(m[5]), m[4], m[2], m[5]))


def best_moves() -> dict[int, dict[tuple[int, int], tuple[int, str, tuple[int, ...]]]]:
    """For each role the cheapest move between each two states."""
    best: dict[int, dict] = {role: {} for role in range(4)}
    for state, role, to, cost, action, way in moves():
        best[role].setdefault((state, to), (cost, action, way))
    return best


def role_number(role: str | None) -> int:
    name = (role or "").strip().lower()
    return ROLES.index(name) if name in ROLES[1:] else ALIASES.get(name, 0)


_FAR = 1 << 40


def cost_table(roles: list[int], best: dict) -> np.ndarray:
    """Least cost from each state before the turns to each state behind them."""
    table = np.full((4, 4), _FAR, np.int64)
    np.fill_diagonal(table, 0)
    steps = {}
    for role, found in best.items():
        step = np.full((4, 4), _FAR, np.int64)
        for (state, to), (cost, _, _) in found.items():
            step[state, to] = cost
        steps[role] = step
    for role in roles:
        table = np.minimum((table[:, :, None] + steps[role][None]).min(axis=1), _FAR)
    return table


def trace(roles: list[int], first: int, last: int, best: dict) -> list[tuple[int, int, str, tuple[int, ...]]]:
    """State behind each turn, cost, action and insertions of the cheapest moves from state to state."""
    reach, back = {first: 0}, []
    for role in roles:
        nxt: dict[int, tuple[int, int]] = {}
        for (state, to), (cost, _, _) in best[role].items():
            if state in reach and (to not in nxt or (reach[state] + cost, state) < nxt[to]):
                nxt[to] = (reach[state] + cost, state)
        back.append({to: state for to, (_, state) in nxt.items()})
        reach = {to: cost for to, (cost, _) in nxt.items()}
    out, state = [], last
    for role, step in zip(reversed(roles), reversed(back)):
        before = step[state]
        out.append((state, *best[role][before, state]))
        state = before
    return out[::-1]


def render(text: str | None, state: int, action: str, inserted: tuple[int, ...], first: bool, last: bool) -> str:
    body = (text or "").replace("<|", "< |")
    if action in ("merge", "relabel_merge"):
        out = "\n" + body
    else:
        out = "" if first else "<|end|>\n"
        out += "".join(f"<|{ROLES[r]}|>\n<|end|>\n" for r in inserted) + f"<|{ROLES[state]}|>\n{body}"
    return out + ("<|end|>\n" if last else "")


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(n, part, np.int64)), pa.array(np.arange(at, at + n))], [*batch.schema.names, "part", "seq"]
        )
        at += n


def _runs(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of each (conv_id, part), which come together: key and the values of the columns ``names``."""
    key, held = None, []
    for batch in batches:
        for conv, part, *row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", *names))):
            if (conv, part) != key and held:
                yield key, held
                held = []
            key = conv, part
            held.append(tuple(row))
    if held:
        yield key, held


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    best = best_moves()
    out: list[tuple] = []
    kind = None

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in out], kind), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.list_(pa.int64()))],
            ["conv_id", "part", "costs"],
        )

    def seen():
        nonlocal kind
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            yield batch

    for (conv, part), rows in _runs(seen(), ("role",)):
        out.append((conv, part, cost_table([role_number(r[0]) for r in rows], best).ravel().tolist()))
        if len(out) >= 4096:
            yield flush()
            out = []
    if out:
        yield flush()


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The states at the borders of a conversation's ranges."""
    for batch in batches:
        out = []
        for conv, pieces in zip(batch.column("conv_id").to_pylist(), batch.column("pieces").to_pylist()):
            reach, back = {START: 0}, []
            for piece in pieces:
                table = np.array(piece["costs"]).reshape(4, 4)
                nxt = {}
                for to in range(4):
                    cost, state = min((c + int(table[s, to]), s) for s, c in reach.items())
                    if cost < _FAR:
                        nxt[to] = (cost, state)
                back.append({to: s for to, (_, s) in nxt.items()})
                reach = {to: c for to, (c, _) in nxt.items()}
            state = min((reach[s], s) for s in ENDS if s in reach)[1]
            for i in range(len(pieces) - 1, -1, -1):
                before = back[i][state]
                out.append((conv, pieces[i]["part"], before, state, i == 0, i == len(pieces) - 1))
                state = before
        kinds = (batch.schema.field("conv_id").type, pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_())
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], ["conv_id", "part", "before", "behind", "opens", "closes"]
        )


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    best = best_moves()
    kinds = None

    def seen():
        nonlocal kinds
        for batch in batches:
            kinds = batch.schema.field("conv_id").type, batch.schema.field("turn").type
            yield batch

    for (conv, part), rows in _runs(seen(), ("turn", "role", "text", "seq", "before", "behind", "opens", "closes")):
        found = trace([role_number(r[1]) for r in rows], rows[0][4], rows[0][5], best)
        n = len(rows)
        fragments = [
            render(r[2], state, action, way, r[6] and i == 0, r[7] and i == n - 1)
            for i, (r, (state, _, action, way)) in enumerate(zip(rows, found))
        ]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([conv] * n, kinds[0]),
                pa.array([r[0] for r in rows], kinds[1]),
                pa.array([(part << 40) + r[3] for r in rows], pa.int64()),
                pa.array([ROLES[x[0]] for x in found]),
                pa.array([x[2] for x in found]),
                pa.array([[ROLES[r] for r in x[3]] for x in found], pa.list_(pa.string())),
                pa.array([x[1] for x in found], pa.int64()),
                pa.array(fragments, pa.string()),
            ],
            ["conv_id", "turn", "place", "role", "action", "inserted", "cost", "fragment"],
        )


def format_chats(conversations: DataFrame, partitions: int | None = None) -> DataFrame:
    """``conv_id``, ``turn``, ``place`` (order within the conversation), repaired ``role``, ``action``, ``inserted``
    roles, ``cost`` and rendered ``fragment`` of every turn."""
    rows = conversations.select("conv_id", "turn", "role", "text")
    order = ["conv_id", "turn", "role", "text"]
    ranged = rows.repartitionByRange(*([partitions] if partitions else []), *order).sortWithinPartitions(*order)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"{c} {kinds[c]}" for c in order)
    pinned = pin(ranged.mapInArrow(_number, f"{schema}, part long, seq long"))
    key = ("conv_id", "part")
    narrow = pinned.select("conv_id", "part", "seq", "role").repartition(*key).sortWithinPartitions(*key, "seq")
    tables = narrow.mapInArrow(_tables, f"conv_id {kinds['conv_id']}, part long, costs array<long>")
    pieces = tables.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "costs"))).alias("pieces"))
    borders = pieces.mapInArrow(
        _borders, f"conv_id {kinds['conv_id']}, part long, before int, behind int, opens boolean, closes boolean"
    ).alias("b")
    same = F.col("r.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("r.part") == F.col("b.part"))
    joined = pinned.alias("r").join(borders, same).select("r.*", "before", "behind", "opens", "closes")
    joined = joined.repartition(*key).sortWithinPartitions(*key, "seq")
    return joined.mapInArrow(
        _repair,
        f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, place long, role string, action string, inserted array<string>, cost long, fragment string",
    )
