"""Chat formatting in budgeted windows, with a loss mask.

A conversation becomes windows of whole turns. Prefix sums of the turns' token costs choose
how far a window reaches; each window repeats the system turn and a limited history, and
only assistant turns that it holds for the first time are targets.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parallelism

#: Tokens of a window, and of the history it may repeat.
BUDGET, HISTORY = 1024, 256
#: A turn of any role: how it opens and closes. Other roles name themselves.
MARKS = {"system": ("[SYS] ", " [/SYS]"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", " </s>")}
OTHER = ("[ROLE {}] ", " [/ROLE]")
#: A control string inside a text gets a backslash after its bracket, one more than it has.
_CONTROL = re.compile(r"([<\[])(\\*)(?=/?s>|/?INST\]|/?SYS\]|ROLE |/ROLE\])")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(?=/?s>|/?INST\]|/?SYS\]|ROLE |/ROLE\])")
_TURN = re.compile(r"\[SYS\] (.*?) \[/SYS\]|\[INST\] (.*?) \[/INST\]|<s> (.*?) </s>|\[ROLE ([^\]]*)\] (.*?) \[/ROLE\]", re.S)
_TOKEN = re.compile(r"\w+|[^\w\s]")


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\2\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def role_name(role: str) -> str:
    """A role as it stands in its mark: whatever could close the mark is spelled out."""
    return re.sub(r"[^A-Za-z0-9_-]", lambda m: f"%{ord(m[0]):x};", role)


def role_of(name: str) -> str:
    return re.sub(r"%([0-9a-f]+);", lambda m: chr(int(m[1], 16)), name)


def marked(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn and where its text lies in it."""
    before, after = MARKS.get(role) or (OTHER[0].format(role_name(role)), OTHER[1])
    body = escape(text)
    return before + body + after, len(before), len(before) + len(body)


def read_turns(text: str) -> list[tuple[str, str]]:
    """``(role, text)`` of every turn of a formatted window."""
    out, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if m is None:
            raise ValueError(f"no turn at character {at}")
        system, user, assistant, role, other = m.groups()
        if role is not None:
            out.append((role_of(role), unescape(other)))
        else:
            out.append(next((r, unescape(t)) for r, t in (("system", system), ("user", user), ("assistant", assistant)) if t is not None))
        at = m.end()
    return out


def token_cost(text: str) -> int:
    """Tokens of a formatted turn: words and single marks."""
    return sum(1 for _ in _TOKEN.finditer(text))


@dataclass
class Turn:
    role: str
    text: str
    start: int
    end: int
    cost: int


class Windows:
    """The windows of one conversation, turn by turn; holds one window and its history at most."""

    def __init__(self, budget: int, history: int):
        self.budget, self.history = budget, history
        self.system: Turn | None = None
        self.past: deque[Turn] = deque()
        self.past_cost = self.number = self.seen = 0
        self._open([])

    def _open(self, repeated: list[Turn]) -> None:
        self.repeated, self.fresh = repeated, []
        self.total = sum(t.cost for t in repeated)  # running prefix sum of the window's turns

    def add(self, role: str, text: str) -> tuple | None:
        """Take a turn; returns the window it closes, if any."""
        body, start, end = marked(role, text)
        turn = Turn(role, body, start, end, token_cost(body))
        out = None
        if self.fresh and self.total + turn.cost > self.budget:
            out = self.close()
            # A repeated history must leave room for the turn that asks for the window.
            keep = list(self.past)
            base = self.system.cost if self.system else 0
            cost = self.past_cost
            while keep and base + cost + turn.cost > self.budget:
                cost -= keep.pop(0).cost
            self._open(([self.system] if self.system else []) + keep)
        self.fresh.append(turn)
        self.total += turn.cost
        if self.seen == 0 and role == "system":
            self.system = turn
        else:
            self.past.append(turn)
            self.past_cost += turn.cost
            while self.past and self.past_cost > self.history:
                self.past_cost -= self.past.popleft().cost
        self.seen += 1
        return out

    def close(self) -> tuple | None:
        """``(window, repeated turns, text, loss spans, tokens)`` of the open window."""
        if not self.fresh:
            return None
        text, loss = "".join(t.text for t in self.repeated), []
        at = len(text)
        for t in self.fresh:
            if t.role == "assistant":
                loss.append((at + t.start, at + t.end))
            at += len(t.text)
        out = (self.number, len(self.repeated), text + "".join(t.text for t in self.fresh), loss, self.total)
        self.number += 1
        self.fresh = []
        return out


def _in_order(conversations: DataFrame) -> DataFrame:
    """Turns of a conversation together and in order."""
    n = max(parallelism(conversations.sparkSession), 1)
    return conversations.repartition(n, "conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "role", "text")


_WINDOWS = "conv_id long, window long, n_repeated int, text string, loss array<struct<start: int, end: int>>, n_tokens long"
_LOSS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def format_chats(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Windows ``(conv_id, window, n_repeated, text, loss, n_tokens)`` of ``(conv_id, turn, role, text)``.

    ``loss`` has the character spans of the targets, ``n_repeated`` counts the turns at the
    start that an earlier window had. A window keeps to ``budget`` tokens unless a single
    turn (with the system turn) is longer. Texts are escaped, so :func:`read_turns` gives
    them back whatever they hold. A conversation of any length is streamed: a task holds one
    window at a time, and the windows of a conversation come out together and in order.

    Null text or role: empty. Null turn: last. Turns with the same number: by role, then
    text. Null conversation: one conversation. Empty table: no windows. Other columns are
    ignored.
    """
    rows = _in_order(conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        c = list(zip(*rows))
        loss = [[{"start": a, "end": b} for a, b in x] for x in c[4]]
        arrays = [pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int32()), pa.array(c[3], pa.string()), pa.array(loss, _LOSS), pa.array(c[5], pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, ["conv_id", "window", "n_repeated", "text", "loss", "n_tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, now, out = None, None, []
        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if state is None or conv != now:
                    if state is not None and (done := state.close()):
                        out.append((now, *done))
                    state, now = Windows(budget, history), conv
                if done := state.add(role, text):
                    out.append((now, *done))
                if len(out) >= 500:
                    yield batch_of(out)
                    out = []
        if state is not None and (done := state.close()):
            out.append((now, *done))
        if out:
            yield batch_of(out)

    return rows.mapInArrow(run, _WINDOWS)


def chat_digests(windows: DataFrame) -> DataFrame:
    """What the windows of :func:`format_chats` say, read back from their text and loss spans.

    ``windows`` has those of a conversation together and in order, as they are made. Columns:
    ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, None, []

        def flush() -> None:
            if held is not None:
                out.append((now, held[0], held[1].hexdigest(), held[2], held[3].hexdigest(), held[4]))

        for batch in batches:
            for conv, repeated, text, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "n_repeated", "text", "loss"))):
                if held is None or conv != now:
                    flush()
                    now, held = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, body in read_turns(text)[repeated:]:
                    held[0] += 1
                    held[1].update(f"{role}\n{body}\n".encode())
                for span in loss:
                    target = unescape(text[span["start"] : span["end"]])
                    held[2] += len(target)
                    held[3].update(target.encode())
                held[4] += len(text)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) if k in (2, 4) else pa.array(c, pa.int64()) for k, c in enumerate(zip(*out))], names)
                out.clear()
        flush()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) if k in (2, 4) else pa.array(c, pa.int64()) for k, c in enumerate(zip(*out))], names)

    return windows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
