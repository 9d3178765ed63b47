"""Chat formatting: turns of a conversation into training windows.

A turn is written ``<s>[ROLE]`` + escaped text + ``[/ROLE]``. In texts a backslash is
put before every backslash, ``<`` and ``[``, so no text can hold a control string;
``unescape`` takes them out again.

Windows: prefix sums of the turns' tokens choose turn-aligned spans of at most
``budget`` tokens. Every window begins with the conversation's leading system turns,
repeats at most ``history`` tokens of the turns before its span, and holds new turns as
long as they fit. System turns are kept while they fit the budget together; a window
whose next turn does not fit beside them goes without them, but later windows have
them again. A turn longer than the budget has a
window of its own. Only the new assistant turns carry the loss mask, so a repeated
target is masked and every assistant text is learnt once.

Rows stream through a task in order of conversation and turn and only the current
conversation's state is kept: the leading system turns (up to the budget), the
history window and running hashes. So a conversation of any length needs bounded
memory. A conversation is one ordered unit: it stays in one task.

Null text counts as empty, null role as the empty role, null turn sorts first; ties
are broken by role and text; repeated rows are turns of their own. Rows with a null
conversation id form one conversation. Empty tables give empty results.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions

_ESCAPE = re.compile(r"[\\<\[]")
_UNESCAPE = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<s>\[((?:[^\\\]]|\\.)*)\]((?:[^\\\[<]|\\.)*)\[/TURN\]", re.S)
_encoders: dict[str, object] = {}


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def escape_role(role: str) -> str:
    return re.sub(r"[\\<\[\]]", lambda m: "\\" + m[0], role)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[1], text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """(formatted turn, offset of its escaped text, length of that)."""
    head, body = f"<s>[{escape_role(role)}]", escape(text)
    return f"{head}{body}[/TURN]", len(head), len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted window."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError("not a formatted window")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def encoder(path: str | None, pattern: str | None):
    """Counts tokens of a text: by a tiktoken vocabulary file, or by bytes / 4."""
    if not path:
        return lambda text: -(-len(text.encode()) // 4)
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    own = _encoders[path]
    return lambda text: len(own.encode_ordinary(text))


class Conversation:
    """State of the conversation whose turns are arriving."""

    def __init__(self, budget: int, history: int):
        self.budget, self.history = budget, history
        self.system: list[tuple] = []
        self.system_tokens = 0
        self.leading = True
        self.with_system = True  # whether the current window has room for them
        self.past: deque = deque()
        self.past_tokens = 0
        self.new: list[tuple] = []
        self.new_tokens = 0
        self.first = 0
        self.prefix = 0
        self.n = 0

    def add(self, role: str, text: str, tokens: int):
        """Yields the window that the turn closes, if any."""
        turn = (role, text, tokens)
        full = self.new_tokens + tokens > self.budget - self._repeated()
        if self.new and (full or not self.with_system and self.system_tokens + tokens <= self.budget):
            yield self.window()
        if not self.new:
            self.with_system = self.system_tokens + tokens <= self.budget
            while self.past and self._repeated() + tokens > self.budget:
                self.past_tokens -= self.past.popleft()[2]
        if self.leading and role == "system" and self.system_tokens + tokens <= self.budget:
            self.system.append(turn)
            self.system_tokens += tokens
        else:
            self.leading = False
        self.new.append(turn)
        self.new_tokens += tokens
        self.n += 1

    def _repeated(self) -> int:
        return 0 if self.first == 0 else self.with_system * self.system_tokens + self.past_tokens

    def window(self):
        repeated = [] if self.first == 0 else [*(self.system if self.with_system else ()), *self.past]
        out = (self.first, self.n, repeated, list(self.new), self.prefix)
        self.prefix += self.new_tokens
        for turn in self.new:
            if self.first == 0 and turn in self.system:
                continue
            self.past.append(turn)
            self.past_tokens += turn[2]
        limit = max(0, min(self.history, self.budget - self.system_tokens))
        while self.past and self.past_tokens > limit:
            self.past_tokens -= self.past.popleft()[2]
        self.first, self.new, self.new_tokens, self.with_system = self.n, [], 0, True
        return out

    def close(self):
        if self.new:
            yield self.window()


WINDOWS = "conv_id long, window int, first_turn int, end_turn int, start_token long, tokens long, formatted string, loss_from array<int>, loss_length array<int>, new_from int"


def _windows(budget: int, history: int, vocabulary: str | None, pattern: str | None):
    schema = pa.schema([("conv_id", pa.int64()), ("window", pa.int32()), ("first_turn", pa.int32()), ("end_turn", pa.int32()), ("start_token", pa.int64()), ("tokens", pa.int64()), ("formatted", pa.string()), ("loss_from", pa.list_(pa.int32())), ("loss_length", pa.list_(pa.int32())), ("new_from", pa.int32())])

    def render(conv_id, k, window):
        first, end, repeated, new, prefix = window
        parts, loss_from, loss_length, at, new_from = [], [], [], 0, 0
        for j, (role, text, _) in enumerate([*repeated, *new]):
            if j == len(repeated):
                new_from = at
            turn, start, n = format_turn(role, text)
            if j >= len(repeated) and role == "assistant":
                loss_from.append(at + start)
                loss_length.append(n)
            parts.append(turn)
            at += len(turn)
        return (conv_id, k, first, end, prefix, sum(t[2] for t in (*repeated, *new)), "".join(parts), loss_from, loss_length, new_from)

    def run(batches):
        count = encoder(vocabulary, pattern)
        now, state, k, rows, size = None, None, 0, [], 0

        def flush():
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)

        for batch in batches:
            for conv_id, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                role, text = role or "", text or ""
                if state is None or conv_id != now:
                    if state:
                        rows += [render(now, k + j, w) for j, w in enumerate(state.close())]
                    now, state, k = conv_id, Conversation(budget, history), 0
                for w in state.add(role, text, count(format_turn(role, text)[0])):
                    rows.append(render(now, k, w))
                    k += 1
                if len(rows) >= 200:
                    yield flush()
                    rows = []
        if state:
            rows += [render(now, k + j, w) for j, w in enumerate(state.close())]
        yield flush()

    return run


def windows(turns: DataFrame, budget: int = 2048, history: int = 512, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """Training windows of conversations (conv_id, turn, role, text)."""
    own = turns.select("conv_id", "turn", "role", "text").repartition(shuffle_partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return own.select("conv_id", "role", "text").mapInArrow(_windows(budget, history, vocabulary, pattern), WINDOWS)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long, max_tokens long"


def _digests():
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64()), ("max_tokens", pa.int64())])

    def run(batches):
        now, state, rows = None, None, []

        def done():
            turns, loss, n, chars, total, k, most = state
            return dict(conv_id=now, n_turns=n, turns_sha256=turns.hexdigest(), loss_chars=chars, loss_sha256=loss.hexdigest(), formatted_chars=total, n_windows=k, max_tokens=most)

        for batch in batches:
            for r in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                conv_id, formatted, loss_from, loss_length, new_from, tokens = r
                if state is None or conv_id != now:
                    if state:
                        rows.append(done())
                    now, state = conv_id, [hashlib.sha256(), hashlib.sha256(), 0, 0, 0, 0, 0]
                for role, text in parse(formatted[new_from:]):
                    state[0].update(f"{role}\n{text}\n".encode())
                    state[2] += 1
                for at, n in zip(loss_from, loss_length, strict=True):
                    text = unescape(formatted[at : at + n])
                    state[1].update(text.encode())
                    state[3] += len(text)
                state[4] += len(formatted)
                state[5] += 1
                state[6] = max(state[6], tokens)
                if len(rows) >= 2000:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows = []
        if state:
            rows.append(done())
        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from its windows: turns, loss text and lengths."""
    own = formatted.select("conv_id", "window", "formatted", "loss_from", "loss_length", "new_from", "tokens")
    own = own.repartition(shuffle_partitions(formatted.sparkSession), "conv_id").sortWithinPartitions("conv_id", "window")
    return own.select("conv_id", "formatted", "loss_from", "loss_length", "new_from", "tokens").mapInArrow(_digests(), DIGEST)
