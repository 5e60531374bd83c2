"""Chat formatting by minimum-cost role repair.

A legal conversation may open with a system turn, then alternates user and assistant turns, begins with a user and ends with
an assistant turn. Dynamic programming over the automaton of legal turns (start, system, user, assistant) finds the cheapest
repair: a turn may keep its role or be relabelled, be merged into the turn before it, or have an empty turn inserted before
it; empty turns may close the conversation. Ties go to the plainer step (next turn, then merge, then insertion) and to the
earlier role of that list. The repaired sequence is rendered piece by piece, one piece for each input turn, so that the
pieces of a conversation in order of ``position`` are its rendering and no conversation is ever gathered.

Turns are range-partitioned by conversation and turn. A conversation that crosses partitions is cut into segments. A segment
is a 4 x 4 matrix of cheapest costs between entry and exit states; the product of these matrices (in the min-plus sense, at
most two segments of each partition reach the driver) fixes the states at the cuts, and every segment is then decoded on
its own.

Defined results: turns are ordered by (turn, role, text), nulls first; repeated rows are separate turns; null, unknown or
differently cased roles are matched after trimming and lower-casing, and anything else must be relabelled; null text is
empty; null conv_id is one conversation; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecohort.llm.common import materialize

STATES = ("start", "system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
LEGAL = {(START, SYSTEM), (START, USER), (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
STEP, MERGE, INSERT = range(3)
SEGMENTS = "conv_id long, part int, n long, costs array<double>, turns array<long>, roles array<string>, texts array<string>"
PIECES = "conv_id long, turn long, position long, role string, repaired_role string, action string, inserted_before string, inserted_after string, rendered string"


class Costs:
    """Prices of repairs and the moves they allow: ``moves`` lists (from, to, kind, inserted state, price)."""

    def __init__(self, merge: float = 1.0, relabel: float = 2.0, insert: float = 3.0):
        self.relabel = relabel
        moves = [(a, b, STEP, None, 0.0) for a, b in sorted(LEGAL)]
        moves += [(s, s, MERGE, None, merge) for s in (SYSTEM, USER, ASSISTANT)]
        moves += [(a, b, INSERT, x, insert) for a in range(4) for b in range(1, 4) for x in range(1, 4) if (a, x) in LEGAL and (x, b) in LEGAL]
        self.moves = sorted(moves, key=lambda m: (m[4], m[2], m[1], m[0]))
        self.closing = [0.0, 2 * insert, insert, 0.0]

    def price(self, role: str | None, state: int) -> float:
        return 0.0 if (role or "").strip().lower() == STATES[state] else self.relabel


CLOSERS = {START: "", SYSTEM: "user,assistant", USER: "assistant", ASSISTANT: ""}


def forward(roles: list, entry: int, costs: Costs) -> tuple[np.ndarray, list]:
    """Cheapest cost of every exit state from an entry state, and for each turn the best move into every state."""
    best, back = [float("inf")] * 4, []
    best[entry] = 0.0
    for role in roles:
        price = [costs.price(role, s) for s in range(4)]
        new, into = [float("inf")] * 4, [None] * 4
        for move in costs.moves:
            value = best[move[0]] + move[4] + price[move[1]]
            if value < new[move[1]] - 1e-9:
                new[move[1]], into[move[1]] = value, move
        best = new
        back.append(into)
    return np.array(best), back


def decode(roles: list, entry: int, exit_state: int | None, costs: Costs) -> tuple[list, int]:
    """The cheapest moves for all turns; a free exit state (None) includes the cost of closing the conversation."""
    best, back = forward(roles, entry, costs)
    state = int(np.argmin(best + np.array(costs.closing))) if exit_state is None else exit_state
    last, moves = state, []
    for into in reversed(back):
        moves.append(into[state])
        state = into[state][0]
    return moves[::-1], last


def _segments(turns: DataFrame, partitions: int, costs: Costs) -> DataFrame:
    """One row for each conversation and range partition, with its cost matrix where the conversation may go on elsewhere."""
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    dealt = rows.repartitionByRange(partitions, *order).sortWithinPartitions(*order)

    def run(batches):
        part, done, held = TaskContext.get().partitionId(), 0, None

        def row(edge: bool):
            conv, turns, roles, texts = held
            matrix = np.concatenate([forward(roles, s, costs)[0] for s in range(4)]).tolist() if edge else None
            columns = zip([conv], [part], [len(turns)], [matrix], [turns], [roles], [texts], strict=True)
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*columns, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string())), strict=True)], names=["conv_id", "part", "n", "costs", "turns", "roles", "texts"])

        for batch in batches:
            for conv, turn, role, text in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")], strict=True):
                if held is None or held[0] != conv:
                    if held is not None:
                        yield row(done == 0)
                        done += 1
                    held = (conv, [], [], [])
                held[1].append(turn)
                held[2].append(role)
                held[3].append(text)
        if held is not None:
            yield row(True)

    return dealt.mapInArrow(run, SEGMENTS)


def _cuts(segments: DataFrame, costs: Costs) -> dict:
    """For each segment of a conversation in several: (entry state, exit state or None, position of its first turn, first, last)."""
    edges: dict = {}
    for r in segments.filter("costs IS NOT NULL").select("conv_id", "part", "n", "costs").collect():
        edges.setdefault(r["conv_id"], []).append((r["part"], r["n"], np.array(r["costs"]).reshape(4, 4)))
    out = {}
    for conv, own in edges.items():
        own.sort(key=lambda x: x[0])
        if len(own) < 2:
            continue
        best, back = np.where(np.arange(4) == START, 0.0, np.inf), []
        for _, _, matrix in own:
            arrive = best[:, None] + matrix
            back.append(arrive.argmin(0))
            best = arrive.min(0)
        state, states = int(np.argmin(best + np.array(costs.closing))), []
        for b in reversed(back):
            states.append((int(b[state]), state))
            state = int(b[state])
        states.reverse()
        position = 0
        for k, (part, n, _) in enumerate(own):
            out[(conv, part)] = (*states[k], position, k == 0, k == len(own) - 1)
            position += n
    return out


def repair(turns: DataFrame, merge: float = 1.0, relabel: float = 2.0, insert: float = 3.0) -> DataFrame:
    """One row for each turn: its repaired role, what was done, empty turns inserted around it and its rendered piece."""
    costs = Costs(merge, relabel, insert)
    partitions = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    segments = materialize(_segments(turns, partitions, costs))
    cuts = _cuts(segments, costs)

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                entry, leave, position, first, last = cuts.get((r["conv_id"], r["part"]), (START, None, 0, True, True))
                moves, end = decode(r["roles"], entry, leave, costs)
                rows = []
                for i, (turn, role, text, (_, state, kind, extra, _)) in enumerate(zip(r["turns"], r["roles"], r["texts"], moves, strict=True)):
                    opens, closes = position + i == 0, last and i == len(moves) - 1
                    closing = CLOSERS[end] if closes else ""
                    kept = costs.price(role, state) == 0
                    action = "merge" if kept and kind == MERGE else "relabel_merge" if kind == MERGE else "keep" if kept else "relabel"
                    piece = "\n" if kind == MERGE else ("" if opens else "<|end|>\n") + (f"<|{STATES[extra]}|>\n<|end|>\n" if kind == INSERT else "") + f"<|{STATES[state]}|>\n"
                    piece += text or ""
                    if closes:
                        piece += "<|end|>\n" + "".join(f"<|{x}|>\n<|end|>\n" for x in closing.split(",") if x)
                    rows.append((r["conv_id"], turn, position + i, role, STATES[state], action, STATES[extra] if kind == INSERT else None, closing or None, piece))
                columns = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int64(), pa.int64(), *[pa.string()] * 6)
                names = [c.split()[0] for c in PIECES.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return segments.select("conv_id", "part", "turns", "roles", "texts").mapInArrow(run, PIECES)
