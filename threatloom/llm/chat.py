"""Chat formatting by event sourcing.

A log is a table of events: conv (conversation), seq (order), kind, turn, role, text. Kinds:

- delta: appends `text` to the turn (and opens it, with its role);
- edit: replaces the turn's text;
- regenerate: empties the turn; later deltas build it anew;
- delete: removes the turn;
- message: a whole message; one more with the same turn number is a message of its own, after the first.

Events change their own turn only, so logs are partitioned by conversation and turn, sorted by
sequence, and folded as they stream by: a task holds one turn at a time, however long a conversation
is and in whatever order its turns are changed.

Template, per message: `### Role: ` + escaped text + ` </turn>` + newline. In texts and roles, `\\`,
`#` and `<` are escaped with `\\`, so no text can hold a control string, and unescaping is exact. One
output row a message: `piece` (formatted), and `loss` span (offsets in the piece) of assistant texts.

Defined results: null text is empty; null kind is delta; null or empty role is `user`; a null turn is turn 0; edits and
regenerations of an unknown turn open it, deletions don't; repeated events apply twice (a repeated message
is two); rows with a null conversation are one conversation, null; ties in seq are ordered by kind (message, delta or
unknown, edit, regenerate, delete), then by role and text; other columns of a log are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, slices

HEAD, MIDDLE, TAIL = "### ", ": ", " </turn>\n"
ESCAPED = re.compile(r"[\\#<]")
UNESCAPED = re.compile(r"\\(.)", re.S)
LEARNED = "assistant"
PIECES = "conv_id long, turn_no long, part int, role string, piece string, loss_start long, loss_end long"


def escape(text: str) -> str:
    return ESCAPED.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return UNESCAPED.sub(r"\1", text)


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """(piece, start, end): the offsets hold the turn's escaped text."""
    head = HEAD + escape(role).replace(":", "\\:") + MIDDLE
    body = escape(text)
    return head + body + TAIL, len(head), len(head) + len(body)


def parse(piece: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted string."""
    out, at = [], 0
    while at < len(piece):
        if not piece.startswith(HEAD, at):
            raise ValueError("not a formatted conversation")
        colon = _control(piece, MIDDLE, at + len(HEAD))
        end = _control(piece, TAIL, colon + len(MIDDLE))
        out.append((unescape(piece[at + len(HEAD) : colon]), unescape(piece[colon + len(MIDDLE) : end])))
        at = end + len(TAIL)
    return out


def _control(piece: str, mark: str, at: int) -> int:
    """The next `mark` that isn't inside an escape."""
    if mark == TAIL:  # its `<` is never bare inside a text
        while (k := piece.find("<", at)) >= 0:
            if _slashes(piece, k) % 2 == 0:
                return k - 1
            at = k + 1
        raise ValueError("no end of turn")
    while (k := piece.find(mark, at)) >= 0:
        if _slashes(piece, k) % 2 == 0:
            return k
        at = k + 1
    raise ValueError("no role")


def _slashes(piece: str, k: int) -> int:
    n = 0
    while k - 1 - n >= 0 and piece[k - 1 - n] == "\\":
        n += 1
    return n


class Turn:
    """The messages of one turn: nearly always one."""

    def __init__(self):
        self.messages: list[tuple[str, list[str]]] = []

    def apply(self, kind: str | None, role: str | None, text: str | None) -> None:
        if kind == "delete":
            self.messages.clear()
            return
        if kind == "message" or not self.messages:
            self.messages.append((role or "user", []))
        held, parts = self.messages[-1]
        if kind in ("edit", "regenerate"):
            parts = []
            self.messages[-1] = role or held, parts
        if kind != "regenerate":
            parts.append(text or "")

    def done(self) -> Iterator[tuple[str, str]]:
        return ((role, "".join(parts)) for role, parts in self.messages)


def render(events: DataFrame) -> DataFrame:
    """Fold a log and format it, one row a message: conv_id, turn_no (the log's number), part (0 but for repeated messages),
    role, piece, loss_start, loss_end (null if not learned from)."""
    names = ["conv_id", "turn_no", "part", "role", "piece", "loss_start", "loss_end"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, turn, rows, size = None, Turn(), [], 0

        def close():
            nonlocal size, turn
            for part, (role, text) in enumerate(turn.done()):
                piece, a, b = render_turn(role, text)
                learned = role == LEARNED
                rows.append((*now, part, role, piece, a if learned else None, b if learned else None))
                size += len(piece)
            turn = Turn()

        def flush():
            nonlocal size
            columns = list(zip(*rows))
            rows.clear()
            size = 0
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for batch in slices(batches):
            for conv, number, kind, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv", "turn", "kind", "role", "text"))):
                if (conv, number) != now:
                    close()
                    now = conv, number
                turn.apply(kind, role, text)
                if size > 1 << 22:
                    yield flush()
        close()
        if rows:
            yield flush()

    kind = F.when(F.col("kind") == "message", 0).when(F.col("kind") == "edit", 2).when(F.col("kind") == "regenerate", 3).when(F.col("kind") == "delete", 4).otherwise(1)
    ordered = events.select(F.col("conv").cast("long").alias("conv"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), F.col("seq").cast("long").alias("seq"), "kind", kind.alias("kind_order"), "role", "text")
    return bounded_batches(ordered.repartition("conv", "turn").sortWithinPartitions("conv", "turn", "seq", "kind_order", "role", "text")).mapInArrow(run, PIECES)


def read_back(pieces: DataFrame) -> DataFrame:
    """Parse rendered pieces, a conversation at a time in order: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, rows = None, None, []

        def close():
            if state is not None:
                rows.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def flush():
            columns = list(zip(*rows))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in slices(batches):
            for conv, piece, a, b in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "piece", "loss_start", "loss_end"))):
                if conv != now or state is None:
                    close()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(piece):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                if a is not None:
                    learned = unescape(piece[a:b])
                    state[2] += len(learned)
                    state[3].update(learned.encode())
                state[4] += len(piece)
            if len(rows) > 4096:
                yield flush()
        close()
        if rows:
            yield flush()

    dealt = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "turn_no", "part")
    return bounded_batches(dealt).mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
