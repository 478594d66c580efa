"""Chat formatting with budgeted windows.

Turns are wrapped in control strings; control strings inside texts are escaped
reversibly. Prefix sums of turn tokens cut a conversation into turn-aligned spans
that fit a budget. Each window repeats the system turn and some history; repeated
turns are outside the loss mask, so each assistant text is a target once.

Rows stream in order of (conversation, turn): a conversation is never gathered,
so one of any length needs the memory of one window. A conversation's digest is
sequential by its definition, so its rows pass through one task.

Defined results: null text or role counts as empty; null conversations form one
conversation; ties of turn go by role, then text; repeated rows are turns of their
own; a turn over the budget gets a window of its own, whole; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonolith.llm.common import bounded_batches

START, END = "<|im_start|>", "<|im_end|>"
BUDGET, HISTORY = 4096, 512
WINDOWS = "conv_id string, window long, formatted string, fresh int, targets array<int>"
DIGESTS = "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"
_MARK, _ESCAPED, _WORD = re.compile(r"<(\\*)\|"), re.compile(r"<(\\*)\\\|"), re.compile(r"\w+|[^\w\s]")
_TURN = re.compile(rf"{re.escape(START)}(.*?)\n(.*?){re.escape(END)}\n", re.S)


def escape(text: str) -> str:
    """No control string is left: one backslash more stands between < and |."""
    return _MARK.sub(r"<\1\\|", text) if "<" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text) if "<" in text else text


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def tokens(text: str) -> int:
    """Words and marks; a stand-in for a tokenizer's count, which may be passed instead."""
    return len(_WORD.findall(text))


class Windower:
    """Takes turns in order; gives windows as they fill."""

    def __init__(self, budget: int, history: int, count=tokens):
        self.budget, self.history, self.count = budget, history, count
        self.conv, self.begun = None, False

    def _begin(self, conv) -> None:
        self.conv, self.begun, self.window = conv, True, 0
        self.system, self.kept, self.new, self.total, self.first = None, [], [], 0, True

    def _emit(self):
        parts, at, targets = [], 0, []
        lead = ([self.system] if self.system else []) + self.kept
        for _, _, text, _ in lead:
            parts.append(text)
            at += len(text)
        fresh = at
        for role, head, text, _ in self.new:
            parts.append(text)
            if role == "assistant":
                targets += [at + head, at + len(text) - len(END) - 1]
            at += len(text)
        out = (self.conv, self.window, "".join(parts), fresh, targets)
        # History: the last turns that fit, whole, without the system turn.
        room, kept = self.history, []
        for turn in reversed(self.kept + [t for t in self.new if t[0] != "system"]):
            if turn[3] > room:
                break
            room -= turn[3]
            kept.append(turn)
        opening = next((t for t in self.new if t[0] == "system"), None) if self.window == 0 else None
        self.system = opening if opening is not None and self.opened else self.system
        self.kept, self.new, self.window = kept[::-1], [], self.window + 1
        self.total = sum(t[3] for t in self.kept) + (self.system[3] if self.system else 0)
        return out

    def add(self, conv, role: str, text: str) -> Iterator[tuple]:
        if not self.begun or conv != self.conv and not (conv is None and self.conv is None):
            yield from self.finish()
            self._begin(conv)
            self.opened = role == "system"
        head = f"{START}{escape_role(role)}\n"
        turn = (role, len(head), f"{head}{escape(text)}{END}\n", self.count(text) + 4)
        if self.new and self.total + turn[3] > self.budget:
            yield self._emit()
            if self.total + turn[3] > self.budget:  # a large turn goes without history
                self.total -= sum(t[3] for t in self.kept)
                self.kept = []
        self.new.append(turn)
        self.total += turn[3]

    def finish(self) -> Iterator[tuple]:
        if self.begun and self.new:
            yield self._emit()
        self.begun = False


def windows(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", budget: int = BUDGET, history: int = HISTORY, count=tokens) -> DataFrame:
    """Windows in order within each conversation: formatted text, `fresh` (offset
    where new turns begin), `targets` (begin, end, begin, ... of the loss mask)."""
    bounded_batches(turns.sparkSession)
    kind = turns.select(F.col(conv).alias("conv_id")).schema["conv_id"].dataType
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    dealt = rows.repartition(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        maker = Windower(budget, history, count)
        names = ["conv_id", "window", "formatted", "fresh", "targets"]
        for batch in batches:
            out = [w for c, r, t in zip(batch["conv_id"], batch["role"], batch["text"], strict=True) for w in maker.add(None if pd.isna(c) else c, r, t)]
            if out:
                yield pd.DataFrame(out, columns=names)
        if last := list(maker.finish()):
            yield pd.DataFrame(last, columns=names)

    # Ids travel as text: a column of numbers with nulls would lose digits on its way through pandas.
    made = dealt.select(F.col("conv_id").cast("string"), "role", "text").mapInPandas(run, WINDOWS)
    return made.withColumn("conv_id", F.col("conv_id").cast(kind))


def parse(formatted: str) -> list[tuple[int, int, str, str]]:
    """(begin, end, role, text) of each turn of a formatted window."""
    return [(m.start(), m.end(), unescape_role(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def read_back(formatted: DataFrame, in_order: bool = False) -> DataFrame:
    """Digests of each conversation, from its windows alone. in_order: the rows come as
    `windows` makes them; otherwise they are dealt by conversation and sorted."""
    kind = formatted.schema["conv_id"].dataType
    if not in_order:
        parts = int(formatted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        formatted = formatted.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "window")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]
        row = lambda: (now[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5])
        for batch in batches:
            out = []
            for c, text, fresh, targets in zip(batch["conv_id"], batch["formatted"], batch["fresh"], batch["targets"], strict=True):
                c = (None if pd.isna(c) else c,)
                if c != now:
                    if now is not None:
                        out.append(row())
                    now, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for begin, _, role, said in parse(text):
                    if begin >= fresh:
                        state[0] += 1
                        state[1].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                for a, b in zip(targets[::2], targets[1::2], strict=True):
                    said = unescape(text[a:b])
                    state[2] += len(said)
                    state[3].update(said.encode("utf-8", "surrogatepass"))
                state[4] += len(text)
                state[5] += 1
            if out:
                yield pd.DataFrame(out, columns=names)
        if now is not None:
            yield pd.DataFrame([row()], columns=names)

    made = formatted.select(F.col("conv_id").cast("string"), "window", "formatted", "fresh", "targets").mapInPandas(run, DIGESTS)
    return made.withColumn("conv_id", F.col("conv_id").cast(kind))


def report(conversations: DataFrame) -> DataFrame:
    spark = conversations.sparkSession
    said = "<|im_end|><|im_start|>assistant ok"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(probe)
    return read_back(windows(rows), in_order=True)
