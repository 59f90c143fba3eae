"""Chat formatting: minimum-cost repair of the roles, then rendering.

A conversation is legal if an optional system turn is followed by user and
assistant turns in alternation, from a user turn on. A turn may be kept,
relabelled, merged into the message before it, or preceded by empty messages.
Dynamic programming over the automaton's four states picks the cheapest repair.
A run of turns acts on the states as a matrix of costs, and such matrices
compose, so a conversation may be spread over any number of tasks.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import product

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codefold.llm.common import ready, shared_dir

ROLES = ("", "system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
#: Legal next messages of each state.
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
#: Other names of the roles; any other name, or none, is unknown.
NAMES = {"system": SYSTEM, "developer": SYSTEM, "user": USER, "human": USER, "prompter": USER, "assistant": ASSISTANT, "gpt": ASSISTANT, "bot": ASSISTANT, "model": ASSISTANT, "ai": ASSISTANT}
#: Costs of the edits. A turn of unknown role takes any at half the price of a relabel.
MERGE, RELABEL, GUESS, INSERT = 2, 4, 2, 6
NEVER = 1 << 60
ACCEPT = ("user", "assistant")
OPEN, CLOSE, JOIN = "<|im_start|>", "<|im_end|>\n", "\n\n"


def role_of(name: str | None) -> int:
    """The state a role's name stands for; 0 if unknown."""
    return NAMES.get((name or "").strip().lower(), START)


def _insertions() -> dict[tuple[int, int], tuple[int, ...]]:
    """The shortest empty messages that lead from one state to another."""
    found = {(s, s): () for s in range(4)}
    for _ in range(4):
        for (s, t), path in list(found.items()):
            for u in NEXT[t]:
                if (s, u) not in found or len(found[s, u]) > len(path) + 1:
                    found[s, u] = (*path, u)
    return found


INSERTIONS = _insertions()


@lru_cache(None)
def moves(role: int) -> dict[tuple[int, int], tuple[int, int, str, tuple[int, ...]]]:
    """For a turn of this role the best move between two states: ``cost, preference, action, inserted``; lower preference wins ties."""
    best: dict = {}

    def offer(s, t, cost, preference, action, inserted=()):
        if (cost, preference) < best.get((s, t), (NEVER, 0))[:2]:
            best[s, t] = cost, preference, action, inserted

    for s, u, t in product(range(4), range(4), range(1, 4)):
        if t in NEXT[u] and (s, u) in INSERTIONS:
            change = 0 if t == role else RELABEL if role else GUESS
            inserted = INSERTIONS[s, u]
            offer(s, t, change + INSERT * len(inserted), 2 * len(inserted) + bool(change), "keep" if t == role else "relabel", inserted)
    for s in range(1, 4):
        offer(s, s, MERGE + (0 if s == role else RELABEL if role else GUESS), 1, "merge" if s == role else "merge_relabel")
    return best


def closing(state: int, accept: tuple[str, ...] = ACCEPT) -> tuple[int, tuple[int, ...]]:
    """Cost and empty messages that end a conversation in a legal state."""
    ends = [INSERTIONS[state, ROLES.index(r)] for r in accept if (state, ROLES.index(r)) in INSERTIONS]
    path = min(ends, key=lambda p: (len(p), p)) if state else ()
    return INSERT * len(path), path


def forward(roles: list[int], start: list[int]) -> tuple[list[int], list[list[int]]]:
    """Costs of ending in each state, and for each turn and state the state before; smaller states win ties."""
    cost, back = start, []
    for role in roles:
        after, came = [NEVER] * 4, [0] * 4
        for (s, t), (c, *_) in moves(role).items():
            if cost[s] < NEVER and cost[s] + c < after[t]:
                after[t], came[t] = cost[s] + c, s
        cost = after
        back.append(came)
    return cost, back


def matrix(roles: list[int]) -> list[int]:
    """Costs from each state to each, row by row."""
    return [c for s in range(4) for c in forward(roles, [0 if s == t else NEVER for t in range(4)])[0]]


def repair(roles: list[int], entry: int = START, leave: int | None = None, accept: tuple[str, ...] = ACCEPT) -> list[tuple[int, str, int, tuple[int, ...], tuple[int, ...]]]:
    """``cost, action, state, inserted before, inserted after`` for each turn of a run that begins in ``entry``; ends in ``leave``, or where the conversation ends cheapest."""
    if not roles:
        return []
    cost, back = forward(roles, [0 if s == entry else NEVER for s in range(4)])
    last = leave is None
    t = min(range(4), key=lambda s: (cost[s] + closing(s, accept)[0], s)) if last else leave
    end, out = t, []
    for k in range(len(roles) - 1, -1, -1):
        s = back[k][t]
        c, _, action, inserted = moves(roles[k])[s, t]
        out.append((c, action, t, inserted, ()))
        t = s
    out.reverse()
    if last:
        c, path = closing(end, accept)
        out[-1] = (out[-1][0] + c, *out[-1][1:4], path)
    return out


def rendered(text: str, action: str, state: int, entered: int, before: tuple[int, ...], after: tuple[int, ...], last: bool) -> str:
    """This turn's part of the conversation's text. Markers inside texts are broken up."""
    text = text.replace("<|im_", "<| im_")
    if action.startswith("merge"):
        out = JOIN + text
    else:
        out = (CLOSE if entered else "") + "".join(f"{OPEN}{ROLES[r]}\n{CLOSE}" for r in before) + f"{OPEN}{ROLES[state]}\n{text}"
    return out + (CLOSE + "".join(f"{OPEN}{ROLES[r]}\n{CLOSE}" for r in after) if last else "")


_OUT = "conv_id long, turn long, role_in string, role string, action string, inserted_before string, inserted_after string, cost long, rendered string"
_ENDS = "part int, conv_id long, head boolean, tail boolean, costs array<long>"


def _runs(batches):
    """Conversations of one task's sorted rows in turn: ``conv_id, rows``."""
    key, rows, any_ = None, [], False
    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if any_ and row[0] != key:
                yield key, rows
                rows = []
            key, any_ = row[0], True
            rows.append(row)
    if any_:
        yield key, rows


def _boundaries(ends: list, accept: tuple[str, ...]) -> dict[int, dict[str, int]]:
    """For each task the state in which its first run begins and the states in which its first and last runs must end, where a conversation goes on."""
    out: dict[int, dict[str, int]] = {r.part: {} for r in ends}
    chains, parts = [], sorted({r.part for r in ends})
    first, last = ({r.part: r for r in ends if getattr(r, k)} for k in ("head", "tail"))
    k = 0
    while k < len(parts):
        chain = [last[parts[k]]]
        while k + 1 < len(parts) and first[parts[k + 1]].conv_id == chain[-1].conv_id:
            chain.append(first[parts[k + 1]])
            k += 1
            if not chain[-1].tail:
                break
        if len(chain) > 1:
            chains.append(chain)
            if chain[-1].tail:
                k += 1
        else:
            k += 1
    for chain in chains:
        cost, back = [0, NEVER, NEVER, NEVER], []
        for r in chain:
            sums = [[cost[s] + r.costs[4 * s + t] for s in range(4)] for t in range(4)]
            back.append([min(range(4), key=lambda s, t=t: (sums[t][s], s)) for t in range(4)])
            cost = [min(NEVER, *x) for x in sums]
        state = min(range(4), key=lambda s: (cost[s] + closing(s, accept)[0], s))
        for k in range(len(chain) - 1, 0, -1):
            before = back[k][state]
            out[chain[k].part]["entry"] = before
            out[chain[k - 1].part]["leave"] = before
            state = before
    return out


def format_chats(turns: DataFrame, accept: tuple[str, ...] = ACCEPT) -> DataFrame:
    """One row for each input turn with its repair and its part of the rendered conversation.

    ``turns``: ``conv_id, turn, role, text``; other columns are not read.
    Returns ``conv_id, turn, role_in, role, action`` (keep, relabel, merge,
    merge_relabel), ``inserted_before, inserted_after`` (roles of empty messages,
    comma-joined), ``cost, rendered``. A conversation's parts, joined in the order
    of ``turn``, are its text; they stay rows because a conversation may hold any
    share of the table. ``accept`` names the roles a conversation may end with.

    Turns go by ``turn`` (null first), equal ones by role and text; null ids are
    one conversation; an unknown or null role takes any at a lower price; null
    text counts as empty; an empty table gives an empty result.

    The rows are sorted by range of (conversation, turn) over all tasks and
    checkpointed. A first pass takes the cost matrices of each task's first and
    last run; the driver composes these few numbers for conversations that cross
    tasks; a second pass repairs and renders.
    """
    spark = turns.sparkSession
    ready(spark)
    shared_dir(spark)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("conv_id"), F.col("turn"), F.col("role"), F.xxhash64("text")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).checkpoint()

    def measure(batches):
        part, first, last, n = TaskContext.get().partitionId(), None, None, 0
        for conv, run in _runs(batches):
            last = conv, [role_of(r[2]) for r in run]
            first, n = first or last, n + 1
        found = [] if not n else [(part, first[0], True, True, matrix(first[1]))] if n == 1 else [(part, first[0], True, False, matrix(first[1])), (part, last[0], False, True, matrix(last[1]))]
        kinds = (pa.int32(), pa.int64(), pa.bool_(), pa.bool_(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*found)) or [[]] * 5, kinds)], [x.split()[0] for x in _ENDS.split(", ")])

    bounds = _boundaries(ordered.mapInArrow(measure, _ENDS).collect(), accept)

    def render(batches):
        own = bounds.get(TaskContext.get().partitionId(), {})
        kinds = (pa.int64(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.string())
        names = [x.split()[0] for x in _OUT.split(", ")]
        runs, out, first = _runs(batches), [], True
        run = next(runs, None)
        while run:
            following = next(runs, None)
            entry = own.get("entry", START) if first else START
            leave = own.get("leave") if following is None else None
            repaired, entered = repair([role_of(r[2]) for r in run[1]], entry, leave, accept), entry
            for k, ((conv, turn, role, text), (cost, action, state, before, after)) in enumerate(zip(run[1], repaired)):
                last = leave is None and k == len(repaired) - 1
                out.append((conv, turn, role, ROLES[state], action, ",".join(ROLES[r] for r in before), ",".join(ROLES[r] for r in after), cost, rendered(text, action, state, entered, before, after, last)))
                entered = state
                if len(out) >= 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
                    out = []
            run, first = following, False
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    return ordered.mapInArrow(render, _OUT)
