"""Repair of conversation structure: the cheapest edits that make the roles of a conversation alternate.

A conversation should be nothing, or an optional system turn and then pairs of user and assistant.  Its rows and the
four states of that form make a graph; keeping (K), renaming (R), deleting (D) a row and inserting (I) an empty one are
its arcs.  Costs to the end come from min-plus products of 4 x 4 matrices, so a conversation is worked on in blocks of
its rows, and only matrices and states of blocks meet.  Of the arcs that a cheapest repair may use, nodes are ranked by
the first 1, 2, 4, ... letters of their edits; ranks choose the arcs, and doubled pointers read the path off.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewright.llm.common import written

#: Rows of a conversation that one block holds: 2 ** BLOCK_BITS.
BLOCK_BITS = 8
#: Rows that one round of array work holds.
ROWS_AT_ONCE = 50_000
RENAME, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States: nothing yet, after system, after user, after assistant.
NEXT = np.array([2, 2, 3, 2])
#: Cost and edits that close a conversation from each state.
CLOSING_COST, CLOSING = np.array([0, 2 * INSERT, INSERT, 0], np.int64), ["", "II", "I", ""]
EDITS = "DIKR"  # ascending, as ties are settled
FAR = np.int64(1) << 60
#: Codes of a row: its initial (0 s, 1 u, 2 a, 3 other), 4 if it must go, 8 if it is truncated.
MUST_GO, CUT_OFF = 4, 8
WHITE = " \t\n\x0b\x0c\r"


def _after_kept(state: int, initial: int) -> int | None:
    return {0: 1 if state == 0 else None, 1: 2 if state != 2 else None, 2: 3 if state == 2 else None}.get(initial)


def _row_costs(code: int) -> np.ndarray:
    """cost[q, r] of one row from state q to state r, after up to two insertions before it."""
    row, inserts = np.full((4, 4), FAR), np.full((4, 4), FAR)
    late = TRUNCATED if code & CUT_OFF else 0
    for q in range(4):
        row[q, q] = DELETE
        if not code & MUST_GO:
            row[q, NEXT[q]] = min(row[q, NEXT[q]], RENAME + late)
            if (r := _after_kept(q, code & 3)) is not None:
                row[q, r] = min(row[q, r], late)
        inserts[q, q] = 0
        inserts[q, NEXT[q]] = INSERT
        inserts[q, NEXT[NEXT[q]]] = min(inserts[q, NEXT[NEXT[q]]], 2 * INSERT)
    return (inserts[:, :, None] + row[None]).min(axis=1)


STEP = np.stack([_row_costs(code) for code in range(16)])
KEPT = np.array([[-1 if code & MUST_GO or (r := _after_kept(q, code & 3)) is None else r for q in range(4)] for code in range(16)])


def _padded(codes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(matrix of codes, lengths); what follows a row's end is 0."""
    sizes = np.array([len(c) for c in codes], np.int64)
    out = np.zeros((len(codes), int(sizes.max(initial=0))), np.uint8)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.frombuffer(b"".join(codes), np.uint8)
    return out, sizes


def block_matrices(codes: list[bytes]) -> np.ndarray:
    """(blocks, 4, 4): the least cost of each block from the state before it to the state after it."""
    padded, sizes = _padded(codes)
    total = np.broadcast_to(np.where(np.eye(4, dtype=bool), 0, FAR), (len(codes), 4, 4)).copy()
    for t in range(padded.shape[1]):
        on = sizes > t
        total[on] = np.minimum((total[on][:, :, :, None] + STEP[padded[on, t]][:, None]).min(axis=2), FAR)
    return total


def least_paths(codes: list[bytes], after: np.ndarray) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
    """(edits, states at the end, costs) of each block from each of the four states before it.

    after[b] is the least cost of all that follows block b, by the state at its end.  Edits are the ASCII-least of the
    cheapest; an insertion stands before a row of its block, those after a conversation's last row are not included.
    """
    padded, sizes = _padded(codes)
    blocks = len(codes)
    first = np.concatenate([[0], np.cumsum(sizes + 1)])  # a node for each place (and one for the end) and state
    n = int(first[-1]) * 4
    cost = np.zeros((int(first[-1]), 4), np.int64)
    cost[first[1:] - 1] = after
    for t in range(padded.shape[1] - 1, -1, -1):
        on = np.flatnonzero(sizes > t)
        at = first[on] + t
        cost[at] = (STEP[padded[on, t]] + cost[at + 1][:, None, :]).min(axis=2)
    # the arcs of each node, in the order of EDITS; an arc is open when it lies on a cheapest repair
    place = np.setdiff1d(np.arange(first[-1]), first[1:] - 1)
    code = padded[np.arange(padded.shape[1]) < sizes[:, None]]
    late = np.where(code & CUT_OFF, TRUNCATED, 0)[:, None]
    state = np.arange(4)[None]
    kept = KEPT[code]
    target = np.stack([(place[:, None] + 1) * 4 + state, place[:, None] * 4 + NEXT[None] + 0 * state,
                       (place[:, None] + 1) * 4 + np.maximum(kept, 0), (place[:, None] + 1) * 4 + NEXT[None]], axis=2).reshape(-1, 4)
    flat = cost.ravel()
    price = np.broadcast_to(np.stack([np.full((len(place), 4), DELETE), np.full((len(place), 4), INSERT), np.broadcast_to(late, (len(place), 4)),
                                      np.broadcast_to(RENAME + late, (len(place), 4))], axis=2), (len(place), 4, 4)).reshape(-1, 4).copy()
    price[:, 2][kept.ravel() < 0] = FAR
    price[:, 3][np.repeat(code & MUST_GO, 4) > 0] = FAR
    node = (place[:, None] * 4 + state).ravel()
    open_arcs = price + flat[target] == flat[node][:, None]
    # rank by the first letter, then by twice as many letters each round; nodes at a block's end have none left
    rank, pointer = np.zeros(n, np.int64), np.arange(n)
    letter = open_arcs.argmax(axis=1)
    rank[node] = letter + 1
    pointer[node] = target[np.arange(len(node)), letter]
    while True:
        ranks = np.unique(rank * (n + 5) + rank[pointer], return_inverse=True)[1]
        if ranks.max(initial=0) == rank.max(initial=0) and (pointer[pointer] == pointer).all():
            break
        rank, pointer = ranks, pointer[pointer]
    choice = np.where(open_arcs, np.arange(4)[None] * (n + 5) + rank[target], 5 * (n + 5)).argmin(axis=1)
    letters, jumps = np.zeros(n, np.uint8), [np.arange(n)]
    letters[node] = np.frombuffer(EDITS.encode(), np.uint8)[choice]
    jumps[0][node] = target[np.arange(len(node)), choice]
    steps = (jumps[0] != np.arange(n)).astype(np.int64)
    while (jumps[-1][jumps[-1]] != jumps[-1]).any():
        steps = steps + steps[jumps[-1]]
        jumps.append(jumps[-1][jumps[-1]])
    start = (first[:-1][:, None] * 4 + state).ravel()
    length = steps[start]
    step = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    walk = np.repeat(start, length)
    for k, jump in enumerate(jumps):
        walk = np.where(step >> k & 1, jump[walk], walk)
    text = letters[walk].tobytes().decode()
    ends = np.cumsum(length)
    edits = [text[e - m:e] for e, m in zip(ends, length, strict=True)]
    return ([edits[4 * b:4 * b + 4] for b in range(blocks)], jumps[-1][start].reshape(-1, 4) % 4, cost[first[:-1]])


def _portions(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batch with about ROWS_AT_ONCE conversation rows, and their codes."""
    codes = batch.column(column).to_pylist()
    at = rows = 0
    for i, c in enumerate(codes):
        rows += len(c) + 1
        if rows >= ROWS_AT_ONCE or i == len(codes) - 1:
            yield batch.slice(at, i + 1 - at), codes[at:i + 1]
            at, rows = i + 1, 0


def _block_facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each block: codes, matrix, counts of faults, and what its neighbours need."""
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("codes", "blank", "duplicate", "truncated", "illegal", "ends")}
        for rows, firsts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            known = set(firsts)
            codes, blank, duplicate, truncated = bytearray(), 0, 0, 0
            for r in rows:
                again = not r["blank"] and r["pos"] not in known
                late = not r["blank"] and not again and r["late"]
                blank, duplicate, truncated = blank + r["blank"], duplicate + again, truncated + late
                codes.append(r["initial"] | (MUST_GO if r["blank"] or again else 0) | (CUT_OFF if late else 0))
            initials = [c & 3 for c in codes]
            illegal = sum(pair not in ((0, 1), (1, 2), (2, 1)) for pair in zip(initials, initials[1:], strict=False))
            for k, v in (("codes", bytes(codes)), ("blank", blank), ("duplicate", duplicate), ("truncated", truncated),
                         ("illegal", illegal), ("ends", initials[0] * 4 + initials[-1])):
                out[k].append(v)
        made = pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(out["codes"], pa.binary()), *[pa.array(out[k], pa.int64()) for k in ("blank", "duplicate", "truncated", "illegal", "ends")]],
            names=["conv", "block", "codes", "blank", "duplicate", "truncated", "illegal", "ends"])
        for part, codes in _portions(made, 2):
            matrices = block_matrices(codes).reshape(-1, 16)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(matrices), pa.list_(pa.int64()))], names=[*part.schema.names, "matrix"])


def _costs_after(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walks each conversation's blocks backwards: for each block the least cost of what follows, by state."""
    for batch in batches:
        conv, block, after, meeting = [], [], [], []
        for name, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            cost, later = CLOSING_COST, None
            for p in reversed(parts):
                ends = p["ends"]
                conv.append(name)
                block.append(p["block"])
                after.append(cost)
                meeting.append(int(later is not None and (ends % 4, later) not in ((0, 1), (1, 2), (2, 1))))
                cost = (np.array(p["matrix"], np.int64).reshape(4, 4) + cost[None]).min(axis=1) if len(parts) > 1 else cost
                later = ends // 4
        yield pa.RecordBatch.from_arrays([pa.array(conv, pa.string()), pa.array(block, pa.int64()), pa.array(after, pa.list_(pa.int64())), pa.array(meeting, pa.int64())],
                                         names=["conv", "block", "after", "meeting"])


def _block_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, codes in _portions(batch, 2):
            after = part.column(3).flatten().to_numpy().reshape(-1, 4)
            edits, ends, costs = least_paths(codes, after)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(edits, pa.list_(pa.string())), pa.array(list(ends.astype(np.int32)), pa.list_(pa.int32())), pa.array(costs[:, 0])],
                names=["conv", "block", "edits", "states", "cost"])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walks each conversation's blocks forwards: the state before each block, and the edits after the last."""
    for batch in batches:
        conv, block, entry, closing = [], [], [], []
        for name, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            state = 0
            for p in parts:
                conv.append(name)
                block.append(p["block"])
                entry.append(state)
                state = p["states"][state]
                closing.append("")
            closing[-1] = CLOSING[state]
        yield pa.RecordBatch.from_arrays([pa.array(conv, pa.string()), pa.array(block, pa.int64()), pa.array(entry, pa.int32()), pa.array(closing, pa.string())],
                                         names=["conv", "block", "entry", "closing"])


def _messages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Applies the edits of each block to its rows."""
    names = {2: "user", 3: "assistant"}
    for batch in batches:
        made = []
        for rows, edits, state in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
            out, left = [], iter(rows)
            for edit in edits:
                row = next(left) if edit != "I" else None
                if edit == "D":
                    continue
                if edit == "K":
                    state = _after_kept(state, {"s": 0, "u": 1, "a": 2}[row["role"][0]])
                    out.append({"role": row["role"], "text": row["text"]})
                else:
                    state = int(NEXT[state])
                    out.append({"role": names[state], "text": row["text"] if row else ""})
            made.append(out)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(3), pa.array(made, pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))],
            names=["conv", "block", "audit", "messages"])


def conversation_key(conv: Column) -> Column:
    """A text for each conversation id; the empty text stands for null."""
    return F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit(""))


def repair_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The repaired conversations in blocks: conv (see `conversation_key`), block, audit, messages (role, text), and counts.

    A conversation's rows go by turn (nulls first), then role, then the hash of the text; a null role or text is one
    space.  A row's first fault counts: blank (no character but white space), duplicate (role and text seen earlier),
    truncated (the last character that is not white space ends no sentence).  Blank and duplicate rows must be deleted,
    others may be kept, renamed or deleted; empty rows may be inserted.  block orders a conversation's blocks; audit has
    one letter for each edit of the block.  blank, duplicate, truncated and illegal (neighbouring initials other than
    su, ua, au) are to be summed over the blocks; cost is that of the whole conversation on its first block.

    Rows are dealt by conversation, place and a number of their own, so a conversation that holds a third of all rows
    is spread over tasks, repeated rows too; what one task gathers of a conversation is 200 bytes for each 256 of its
    rows.  An empty table gives no rows; other columns are left out, whatever their names.
    """
    # the number tells equal rows apart in the ranges, so that any number of them can be split
    narrow = rows.select(conversation_key(F.col(conv)).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"),
                         F.coalesce(F.col(text), F.lit(" ")).alias("text")).withColumn("_n", F.monotonically_increasing_id())
    order = ["conv", "turn", "role", "_hash", "_n"]
    end = F.right(F.rtrim("text", F.lit(WHITE)), F.lit(1))
    initial = F.when(F.col("role").startswith("s"), 0).when(F.col("role").startswith("u"), 1).when(F.col("role").startswith("a"), 2).otherwise(3)
    ordered = written(
        narrow.withColumn("_hash", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order)
        .select("conv", F.monotonically_increasing_id().alias("pos"), "role", "text", initial.alias("initial"), (end == "").alias("blank"),
                (~end.isin(".", "!", "?")).alias("late")).withColumn("block", F.shiftright("pos", BLOCK_BITS)))
    place = F.struct("pos", "initial", "blank", "late").alias("place")
    first = ordered.groupBy("conv", "role", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")).agg(F.min("pos").alias("first"))
    both = ordered.select("conv", "block", place, F.lit(None).cast("long").alias("first")).unionByName(
        first.select("conv", F.shiftright("first", BLOCK_BITS).alias("block"), F.lit(None).cast(ordered.select(place).schema[0].dataType).alias("place"), "first"))
    gathered = both.groupBy("conv", "block").agg(F.sort_array(F.collect_list("place")).alias("rows"), F.collect_list("first").alias("firsts"))
    facts = written(gathered.mapInArrow(_block_facts, "conv string, block long, codes binary, blank long, duplicate long, truncated long, illegal long, ends long, matrix array<long>"))
    chains = facts.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("block", "matrix", "ends"))).alias("parts"))
    after = chains.mapInArrow(_costs_after, "conv string, block long, after array<long>, meeting long")
    paths = written(facts.join(after, ["conv", "block"]).select("conv", "block", "codes", "after", "blank", "duplicate", "truncated", (F.col("illegal") + F.col("meeting")).alias("illegal"))
                    .transform(_with_paths))
    entries = paths.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("block", "states"))).alias("parts")).mapInArrow(
        _entries, "conv string, block long, entry int, closing string")
    chosen = paths.join(entries, ["conv", "block"]).withColumn("audit", F.concat(F.get("edits", F.col("entry")), "closing"))
    texts = ordered.groupBy("conv", "block").agg(F.sort_array(F.collect_list(F.struct("pos", "role", "text"))).alias("rows"))
    edited = texts.join(chosen.select("conv", "block", "audit", "entry"), ["conv", "block"]).select("conv", "block", "rows", "audit", "entry").mapInArrow(
        _messages, "conv string, block long, audit string, messages array<struct<role: string, text: string>>")
    facts_of = paths.select("conv", "block", "blank", "duplicate", "truncated", "illegal", "cost")
    return edited.join(facts_of, ["conv", "block"])


def _with_paths(blocks: DataFrame) -> DataFrame:
    counts = ("blank", "duplicate", "truncated", "illegal")

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for found in _block_paths(iter([batch.select(["conv", "block", "codes", "after"])])):
                part = batch.slice(at, found.num_rows)
                at += found.num_rows
                yield pa.RecordBatch.from_arrays([*found.columns, *[part.column(c) for c in counts]], names=[*found.schema.names, *counts])

    return blocks.mapInArrow(paths, "conv string, block long, edits array<string>, states array<int>, cost long, " + ", ".join(f"{c} long" for c in counts))


def conversation_digests(blocks: DataFrame) -> DataFrame:
    """(conv, audit, repaired_sha256) of `repair_conversations`: the blocks of a conversation pass one task in order.

    A sha256 of one text has to be taken in order; the task holds one block at a time, and the edits.
    """
    said = F.concat_ws("\n", F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"])))
    pieces = blocks.select("conv", "block", "audit", F.when(F.size("messages") > 0, said).alias("said"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, sha, any_said = None, [], hashlib.sha256(), False

        def made(names: list, audits: list, digests: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(audits, pa.string()), pa.array(digests, pa.string())], names=["conv", "audit", "repaired_sha256"])

        for batch in batches:
            names, audits, digests = [], [], []
            for c, a, s in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if c != conv:
                    if conv is not None:
                        names.append(conv)
                        audits.append("".join(audit))
                        digests.append(sha.hexdigest())
                    conv, audit, sha, any_said = c, [], hashlib.sha256(), False
                audit.append(a)
                if s.is_valid:
                    sha.update(b"\n" * any_said + s.as_py().encode())
                    any_said = True
            yield made(names, audits, digests)
        if conv is not None:
            yield made([conv], ["".join(audit)], [sha.hexdigest()])

    return pieces.repartition("conv").sortWithinPartitions("conv", "block").mapInArrow(digest, "conv string, audit string, repaired_sha256 string")


def turn_gaps(rows: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(conv, gaps): how many turns between a conversation's first and last are missing; null turns are left out."""
    turns = rows.filter(F.col(turn).isNotNull()).groupBy(conversation_key(F.col(conv)).alias("conv"), F.col(turn).cast("long").alias("turn")).agg(F.lit(1).alias("one"))
    return turns.groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
