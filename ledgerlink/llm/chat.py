"""Operator 1: chat formatting by transcript parsing.

A transcript is a sequence of lines.  Its roles are the hidden states of a
Markov model; speaker markers (the role column of a row, or a ``User:`` in
front of a line), question marks, lengths and list or code marks are what is
seen.  Viterbi's path over a whole conversation gives each line its role, also
where a marker is missing, unknown or wrong; lines of a row that share a role
make a turn, which is rendered in one canonical form.

Conversations may be of any length.  The table is sorted over all tasks into
pieces of at most ``PIECE`` rows.  Where a conversation spans several pieces,
each piece is reduced to one max-plus matrix, the matrices are scanned, and the
pieces are then decoded by themselves between the states that the scan fixed:
the path is the same as if all rows had been in one place.

Rows are ordered by turn, null turns first; rows that tie are ordered by their
text's hash, then by marker and text, and repeated rows follow each other.  Rows
with a null conversation id are one conversation.  A null or empty text is one
empty line; very long texts are read whole.  Ties between paths go to the role
named first in ``ROLES``.  An empty table gives no rows.  Other columns, whatever
their names, are not looked at.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlink.staging import stage

ROLES = ["system", "user", "assistant", "tool"]
PIECE = 2048
#: Words that mark a speaker, by role.
MARKERS = {
    "system": ["system", "instruction", "instructions"],
    "user": ["user", "human", "customer", "client", "prompter", "q", "question"],
    "assistant": ["assistant", "ai", "bot", "model", "agent", "gpt", "a", "answer"],
    "tool": ["tool", "function", "observation"],
}
TEMPLATE = "<|{role}|>\n{text}\n<|end|>\n"

_ROLE_OF = {m: r for r, role in enumerate(ROLES) for m in MARKERS[role]}
_INLINE = re.compile(r"^\s*(?:#+\s*|\*\*|<\|)?(" + "|".join(sorted(_ROLE_OF, key=len, reverse=True)) + r")(?:\*\*|\|>)?\s*(?:[:>]|(?<=\|>))\s*", re.I)
_LIST = re.compile(r"^\s*(?:[-*•]\s|\d+[.)]\s|```)")

# log probabilities; rows and columns in the order of ROLES
_START = np.log([0.20, 0.70, 0.08, 0.02])
_NEXT = np.log([[0.02, 0.90, 0.07, 0.01], [0.01, 0.05, 0.90, 0.04], [0.01, 0.84, 0.05, 0.10], [0.01, 0.04, 0.90, 0.05]])
_STAY = np.log(np.full((4, 4), 0.01) + np.eye(4) * 0.96)
_MARK = np.log(np.full((4, 4), 0.02) + np.eye(4) * 0.92)  # state, marker
_ASKS = [0.02, 0.30, 0.08, 0.02]
_LISTS = [0.05, 0.03, 0.15, 0.10]
_LENGTH = [[0.2, 0.4, 0.4], [0.5, 0.4, 0.1], [0.25, 0.4, 0.35], [0.4, 0.3, 0.3]]  # under 80 characters, under 400, more


def _bernoulli(p: list[float]) -> np.ndarray:
    return np.log([[1 - x for x in p], p])


_ASK, _LISTED, _LONG = _bernoulli(_ASKS), _bernoulli(_LISTS), np.log(np.array(_LENGTH).T)


def lines_of(marker: str | None, text: str | None) -> list[tuple[bool, int | None, str]]:
    """(begins a turn, marked role, bare text) of each line of a row."""
    out = []
    for k, line in enumerate((text or "").split("\n")):
        inline = _INLINE.match(line)
        role = _ROLE_OF[inline[1].lower()] if inline else None
        if k == 0:
            named = _ROLE_OF.get((marker or "").strip().lower())
            if named is not None:
                bare = line[inline.end() :] if role == named else line
                out.append((True, named, bare))
                continue
        out.append((k == 0 or role is not None, role, line[inline.end() :] if inline else line))
    return out


def _seen(role: int | None, line: str) -> np.ndarray:
    stripped = line.rstrip()
    score = _ASK[int(stripped.endswith("?"))] + _LISTED[int(bool(_LIST.match(line)))] + _LONG[0 if len(line) < 80 else 1 if len(line) < 400 else 2]
    return score if role is None else score + _MARK[:, role]


def _steps(rows: list[tuple]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Transition and emission of every line of a piece's rows (marker, text)."""
    return [(_NEXT if begins else _STAY, _seen(role, line)) for marker, text in rows for begins, role, line in lines_of(marker, text)]


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def matrix(rows: list[tuple], first: bool) -> np.ndarray:
    """Best scores from the state before a piece to the state at its end; the first piece has one row, the start."""
    total = None
    for move, seen in _steps(rows):
        if total is None:
            total = (_START[None, :] if first else move) + seen
        else:
            total = _times(total, move + seen[None, :])
    return total


def decode(rows: list[tuple], before: int | None, end: int | None) -> list[int]:
    """States of all lines, after the state ``before`` (None: the start) and with the last one ``end`` (None: free)."""
    best, back = None, []
    for move, seen in _steps(rows):
        if best is None:
            best = (_START if before is None else move[before]) + seen
        else:
            paths = best[:, None] + move
            back.append(paths.argmax(axis=0))
            best = paths.max(axis=0) + seen
    state = int(best.argmax()) if end is None else end
    path = [state]
    for step in reversed(back):
        state = int(step[state])
        path.append(state)
    return path[::-1]


def bounds(matrices: list[np.ndarray]) -> list[tuple[int | None, int]]:
    """The state before each of a conversation's pieces, and at its end."""
    best, back = matrices[0][0], []
    for m in matrices[1:]:
        paths = best[:, None] + m
        back.append(paths.argmax(axis=0))
        best = paths.max(axis=0)
    ends = [int(best.argmax())]
    for step in reversed(back):
        ends.append(int(step[ends[-1]]))
    ends.reverse()
    return list(zip([None, *ends[:-1]], ends, strict=True))


def _cut(batches):
    """Numbers the pieces of a sorted partition, and the rows in each."""
    from pyspark import TaskContext

    piece, n, conv, any_ = TaskContext.get().partitionId() << 40, -1, None, False
    for batch in batches:
        pieces, places = [], []
        for c in batch.column(0).to_pylist():
            if not any_ or c != conv or n + 1 >= PIECE:
                piece, n, conv, any_ = piece + any_, -1, c, True
            n += 1
            pieces.append(piece)
            places.append(n)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pieces, pa.int64()), pa.array(places, pa.int32())], names=[*batch.schema.names, "piece", "place"])


def _by_piece(batches, need: int):
    kept: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if kept and kept[0][need] != row[need]:
                yield kept
                kept = []
            kept.append(row)
    if kept:
        yield kept


def parse(transcripts: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", marker_col: str = "role", text_col: str = "text", template: str = TEMPLATE) -> DataFrame:
    """conv, turn, marker as given, part (number of the turn within its row), role, n_lines, text and rendered."""
    plain = transcripts.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(marker_col).cast("string").alias("marker"), F.col(text_col).cast("string").alias("text"))
    order = ["conv", "turn", "marker", "text"]
    schema = T.StructType([*plain.schema, T.StructField("piece", T.LongType()), T.StructField("place", T.IntegerType())])
    # the hash parts rows that tie, so that no range is one value
    spread = plain.repartitionByRange("conv", "turn", F.xxhash64("text")).sortWithinPartitions("conv", "turn", F.xxhash64("text"), *order[2:])
    rows = stage(spread.mapInArrow(_cut, schema), "pieces")

    spans = rows.groupBy("conv").agg(F.min("piece").alias("first"), F.max("piece").alias("last")).filter("first <> last")
    spans = stage(spans, "spans")
    inside = rows.join(spans, rows["conv"].eqNullSafe(spans["conv"])).select(rows["piece"], "place", "marker", "text", "first")

    def reduce(batches):
        for piece in _by_piece(batches, 0):
            m = matrix([(r[2], r[3]) for r in piece], piece[0][0] == piece[0][4])
            yield pa.RecordBatch.from_arrays([pa.array([piece[0][4]], pa.int64()), pa.array([piece[0][0]], pa.int64()), pa.array([m.ravel().tolist()], pa.list_(pa.float64()))], names=["first", "piece", "m"])

    matrices = inside.repartition("piece").sortWithinPartitions("piece", "place").mapInArrow(reduce, "first long, piece long, m array<double>")

    def scan(table: pa.Table) -> pa.Table:
        found = sorted(table.to_pylist(), key=lambda r: r["piece"])  # a conversation's rows over PIECE
        fixed = bounds([np.array(r["m"]).reshape(-1, len(ROLES)) for r in found])
        return pa.table([pa.array([r["piece"] for r in found], pa.int64()), pa.array([b for b, _ in fixed], pa.int32()), pa.array([e for _, e in fixed], pa.int32())], names=["piece", "before", "at_end"])

    fixed = stage(matrices.groupBy("first").applyInArrow(scan, "piece long, before int, at_end int"), "bounds")

    from pyspark.sql.pandas.types import to_arrow_schema

    s, i = T.StringType(), T.IntegerType()
    result = T.StructType([T.StructField(conv_col, plain.schema["conv"].dataType), T.StructField(turn_col, plain.schema["turn"].dataType), T.StructField("marker", s), T.StructField("part", i), T.StructField("role", s), T.StructField("n_lines", i), T.StructField("text", s), T.StructField("rendered", s)])
    arrow = to_arrow_schema(result)

    def render(batches):
        out: list[tuple] = []
        for piece in _by_piece(batches, 0):
            path = iter(decode([(r[4], r[5]) for r in piece], piece[0][6], piece[0][7]))
            for _, _, conv, turn, marker, text, _, _ in piece:
                parts: list[list] = []
                for begins, _, line in lines_of(marker, text):
                    state = next(path)
                    if parts and parts[-1][0] == state and not begins:
                        parts[-1][1].append(line)
                    else:
                        parts.append([state, [line]])
                for k, (state, lines) in enumerate(parts):
                    whole = "\n".join(lines)
                    out.append((conv, turn, marker, k, ROLES[state], len(lines), whole, template.format(role=ROLES[state], text=whole)))
            if len(out) >= 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    ready = rows.join(fixed, "piece", "left").select("piece", "place", "conv", "turn", "marker", "text", "before", "at_end")
    return ready.repartition("piece").sortWithinPartitions("piece", "place").mapInArrow(render, result)


def path_probability(rows: list[tuple], path: list[int]) -> float:
    """Log probability of a path, for tests."""
    total, before = 0.0, None
    for (move, seen), state in zip(_steps(rows), path, strict=True):
        total += (_START[state] if before is None else move[before, state]) + seen[state]
        before = state
    return float(total) if path else -math.inf
