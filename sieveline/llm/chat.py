"""Chat formatting with minimum-cost role repair.

Legal turns: an optional system turn, then user and assistant in turn, an assistant turn last. Turns that break this are
merged into the one before, relabelled, or preceded by empty turns, at the least total cost: dynamic programming over the
automaton's states (the role of the open turn), then the repaired sequence is rendered, one row for each turn.

A conversation is one task's work only as far as its pieces are small. Rows are sorted by range of (conversation, turn),
so one of any length is cut into pieces. A piece is a 4 x 4 matrix of least costs; these compose, so the costs before
each piece follow from the matrices of those before it, then the states from the last piece to the first, and every
piece is repaired alone. The result is that of the whole conversation in one go, ties included.
"""

from __future__ import annotations

from itertools import product

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import staged

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {"system": SYSTEM, "user": USER, "assistant": ASSISTANT}
ALIASES = {"human": "user", "prompter": "user", "bot": "assistant", "ai": "assistant", "gpt": "assistant", "model": "assistant"}
NAMES = ("", "system", "user", "assistant")
FOLLOWS = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
MERGE, RELABEL, INSERT = 1, 2, 3
NEVER = 1 << 40
PIECE_TURNS, PIECE_CHARS = 1024, 4 << 20
OPEN, CLOSE, JOINT = "<|im_start|>{}\n", "<|im_end|>\n", "\n\n"

_PIECE = "conv_id long, part int, k int, turns array<struct<turn:long,role:string,text:string>>, costs array<long>"
_OUT = "conv_id long, seq long, turn long, place int, role_before string, role string, action string, rendered string"


def _chain(state: int, role: int) -> list[int] | None:
    """The fewest empty turns after which role may follow state."""
    paths: list[list[int]] = [[]]
    for _ in range(4):
        for path in paths:
            if role in FOLLOWS[path[-1] if path else state]:
                return path
        paths = [[*p, r] for p in paths for r in FOLLOWS[p[-1] if p else state] if r != SYSTEM]
    return None


def actions(merge: int = MERGE, relabel: int = RELABEL, insert: int = INSERT) -> list[list[list[tuple]]]:
    """[role][state before][state after] -> (cost, merged, empty turns before); role 0 is unknown."""
    out = [[[(NEVER, False, [])] * 4 for _ in range(4)] for _ in range(4)]
    for role, p, q in product(range(4), range(4), (SYSTEM, USER, ASSISTANT)):
        chain = _chain(p, q)
        ways = [(insert * len(chain), False, chain)] if chain is not None else []
        if p == q:
            ways.append((merge, True, []))
        if ways:
            cost, merged, chain = min(ways, key=lambda w: (w[0], w[1]))
            out[role][p][q] = (cost + (relabel if role != q else 0), merged, chain)
    return out


def _ending(insert: int) -> list[tuple[int, list[int]]]:
    """For each last state, the cost and the empty turns that complete the conversation."""
    out = []
    for state in range(4):
        chain = [] if state == ASSISTANT else [*(_chain(state, ASSISTANT) or []), ASSISTANT]
        out.append((insert * len(chain), chain))
    return out


def role_code(role: str | None) -> int:
    name = (role or "").strip().lower()
    return ROLES.get(ALIASES.get(name, name), 0)


def forward(roles: list[int], before: list[int], table) -> tuple[list[int], list[list[int]]]:
    """Least costs after the turns, given those before, and for each turn and state the state it came from."""
    back = []
    for r in roles:
        row, frm = [NEVER] * 4, [0] * 4
        for q in (SYSTEM, USER, ASSISTANT):
            row[q], frm[q] = min((before[p] + table[r][p][q][0], p) for p in range(4))
        before = [min(x, NEVER) for x in row]
        back.append(frm)
    return before, back


def states(back: list[list[int]], last: int) -> list[int]:
    """The states along the best path that ends in last, the one before the first turn included."""
    out = [last]
    for frm in reversed(back):
        out.append(frm[out[-1]])
    return out[::-1]


def _matrix(roles: list[int], table) -> list[int]:
    flat: list[int] = []
    for p in range(4):
        flat += forward(roles, [0 if s == p else NEVER for s in range(4)], table)[0]
    return flat


def _pieces(table):
    def run(batches):
        part, k = TaskContext.get().partitionId(), 0
        held: list[dict] = []
        conv, chars, out = None, 0, []

        def flush():
            nonlocal held, chars, k
            out.append({"conv_id": conv, "part": part, "k": k, "turns": held, "costs": _matrix([role_code(t["role"]) for t in held], table)})
            held, chars, k = [], 0, k + 1

        schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("k", pa.int32()), ("turns", pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]))), ("costs", pa.list_(pa.int64()))])
        for batch in batches:
            for r in batch.to_pylist():
                if held and (r["conv_id"] != conv or len(held) >= PIECE_TURNS or chars >= PIECE_CHARS):
                    flush()
                conv = r.pop("conv_id")
                held.append(r)
                chars += len(r["text"] or "")
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        if held:
            flush()
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def _costs_before(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["part", "k"])
    cost, out = [0, NEVER, NEVER, NEVER], []
    pdf["skip"] = pdf["n"].cumsum() - pdf["n"]
    for m in pdf["costs"]:
        out.append(cost)
        cost = [min(NEVER, min(cost[p] + int(m[4 * p + q]) for p in range(4))) for q in range(4)]
    pdf["before"] = out
    pdf["last"] = [False] * (len(pdf) - 1) + [True]
    return pdf[["conv_id", "part", "k", "before", "last", "skip"]]


def _entries(table):
    """For each state after a piece, the state before it."""

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                after, back = forward([role_code(t["role"]) for t in r["turns"]], r["before"], table)
                out.append({k: r[k] for k in ("conv_id", "part", "k", "last")} | {"after": after, "frm": [states(back, q)[0] for q in range(4)]})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("k", pa.int32()), ("last", pa.bool_()), ("after", pa.list_(pa.int64())), ("frm", pa.list_(pa.int32()))]))

    return run


def _best_end(after: list[int], ending) -> int:
    return min(range(4), key=lambda s: (after[s] + ending[s][0], s))


def _exits(ending):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["part", "k"], ascending=False)
        state, out = None, []
        for after, frm in zip(pdf["after"], pdf["frm"]):
            state = _best_end([int(x) for x in after], ending) if state is None else state
            out.append(state)
            state = int(frm[state])
        pdf["exit"] = out
        return pdf[["conv_id", "part", "k", "exit"]]

    return run


def render(turns: list[dict], path: list[int], table, last: bool, ending) -> list[tuple]:
    """(seq in the piece, turn, place, role before, role, action, text): place 0 is the turn, others are empty ones
    beside it."""

    def opened(role: int, state: int) -> str:
        return (CLOSE if state != START else "") + OPEN.format(NAMES[role])

    out = []
    for i, (t, p, q) in enumerate(zip(turns, path, path[1:])):
        r = role_code(t["role"])
        _, merged, chain = table[r][p][q]
        text = (t["text"] or "").replace("<|im_", "<| im_")
        state = p
        for n, empty in enumerate(chain):
            out.append((i, t["turn"], n - len(chain), None, NAMES[empty], "insert", opened(empty, state)))
            state = empty
        what = ["relabel"] * (r != q) + ["merge"] * merged
        out.append((i, t["turn"], 0, t["role"], NAMES[q], "+".join(what) or "keep", (JOINT if merged else opened(q, state)) + text))
    if last:
        state = path[-1]
        for n, empty in enumerate(ending[state][1]):
            out.append((len(turns) - 1, turns[-1]["turn"], n + 1, None, NAMES[empty], "insert", opened(empty, state)))
            state = empty
        out[-1] = (*out[-1][:6], out[-1][6] + CLOSE)
    return out


def _repair(table, ending):
    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                whole = r["exit"] is None
                before = [0, NEVER, NEVER, NEVER] if whole else r["before"]
                after, back = forward([role_code(t["role"]) for t in r["turns"]], before, table)
                end = _best_end(after, ending) if whole else r["exit"]
                skip = 0 if whole else r["skip"]
                rows += [(r["conv_id"], skip + n, *x) for n, *x in render(r["turns"], states(back, end), table, whole or r["last"], ending)]
            cols = list(zip(*rows)) or [()] * 8
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], [x.split()[0] for x in _OUT.split(", ")])

    return run


def repaired_chats(turns: DataFrame, merge: int = MERGE, relabel: int = RELABEL, insert: int = INSERT) -> DataFrame:
    """(conv_id, seq, turn, place, role_before, role, action, rendered): a row for each turn, and for each empty one
    inserted. seq numbers a conversation's turns from 0.

    A conversation's text is rendered in order of (seq, place). action: keep, merge (into the turn before), relabel,
    relabel+merge or insert. Turns are in order of turn (null last), then role, then the text's XXH64 (null: null, last),
    then text; repeated rows are turns like others (they merge). Texts of any length stay whole. Unknown and null roles are relabelled; null texts are empty. Rows with null conv_id are one
    conversation. The markers of the format are broken up inside texts. Other columns are ignored.
    """
    table, ending = actions(merge, relabel, insert), _ending(insert)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    rows = rows.withColumn("_hash", F.when(F.col("text").isNotNull(), F.xxhash64("text")))
    order = [F.col(c).asc_nulls_last() for c in ("conv_id", "turn", "role", "_hash")]
    # bounds of the ranges are sampled to the driver: hashes, not texts. Repeated rows are dealt out by place in the table
    rows = rows.withColumn("_at", F.monotonically_increasing_id()).repartitionByRange(*order, "_at").sortWithinPartitions(*order, F.col("text").asc_nulls_last()).drop("_at", "_hash")
    pieces = staged(rows.mapInArrow(_pieces(table), _PIECE), "pieces")
    key = ["conv_id", "part", "k"]
    many = pieces.groupBy("conv_id").count().where("count > 1").select(F.col("conv_id").alias("_conv"))
    cut = pieces.join(many, F.col("conv_id").eqNullSafe(F.col("_conv")), "left_semi")
    before = staged(cut.select(*key, F.size("turns").alias("n"), "costs").groupBy("conv_id").applyInPandas(_costs_before, "conv_id long, part int, k int, before array<long>, last boolean, skip long"), "before")
    place = before.select(F.col("part").alias("_part"), F.col("k").alias("_k"), "before", "last")
    at = (F.col("part") == F.col("_part")) & (F.col("k") == F.col("_k"))
    entries = pieces.join(place, at).mapInArrow(_entries(table), "conv_id long, part int, k int, last boolean, after array<long>, frm array<int>")
    exits = entries.groupBy("conv_id").applyInPandas(_exits(ending), "conv_id long, part int, k int, exit int")
    place = before.join(exits.select("part", "k", "exit"), ["part", "k"]).select(F.col("part").alias("_part"), F.col("k").alias("_k"), "before", "last", "skip", "exit")
    return pieces.join(place, at, "left").drop("_part", "_k").mapInArrow(_repair(table, ending), _OUT)
