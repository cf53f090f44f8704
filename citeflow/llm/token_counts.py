"""Token counts by a compiled finite-state transducer.

States are the blank state, the prefixes of compiled runs (letters or punctuation) and digits;
a transition that leaves a run emits the run's number of tokens. The machine is compiled on
demand: runs met again are added until the table is full, and each run's count comes from
the tokenizer itself. A character or run outside the machine leads to the trap state, which a
blank leaves; the piece around it is counted by the tokenizer, so counts are always exact.

Text is cut in lanes that numpy drives through the table together, one lookup per character.
No state maps are composed and no prefix scan is made: every lane first runs from the blank state, as a
guess; a lane entered in another state is driven again until its states
meet those already computed, which the first blank guarantees.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread_tasks
from .words import BLANKS, DIGITS, MARKS, RUN, WordIds, plain

#: Letters with a column of their own; runs with other letters are counted by the tokenizer.
OWN = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïñòóôõöøùúûüýœ"
BLANK, OTHER, DIGIT, LETTER, MARK = range(5)
#: Characters of a pass and of a lane.
PASS_CHARS, LANE = 1 << 20, 2048

TRAP, START = 0, 1


def _alphabet() -> tuple[np.ndarray, np.ndarray, dict[str, int]]:
    """(code point -> symbol, symbol -> kind, character -> symbol)."""
    symbol = {c: 2 + i for i, c in enumerate(DIGITS + OWN + MARKS)}
    kind = np.array([BLANK, OTHER] + [DIGIT] * len(DIGITS) + [LETTER] * len(OWN) + [MARK] * len(MARKS), dtype=np.uint8)
    table = np.full(0x110000, OTHER, dtype=np.uint8)
    for c in BLANKS:
        table[ord(c)] = BLANK
    for c, s in symbol.items():
        table[ord(c)] = s
        if c in OWN and len(c.upper()) == 1:
            table[ord(c.upper())] = s
    return table, kind, symbol


class Transducer:
    """The machine of one tokenizer file; grows while it runs, up to ``capacity`` states."""

    _made: dict[str, "Transducer"] = {}

    def __init__(self, path: str, capacity: int = 1 << 16, remember: int = 100_000):
        self.words = WordIds.of(path)
        self.symbol_of, self.kind, self.symbol = _alphabet()
        self.width = len(self.kind)
        self.next = np.zeros((capacity, self.width), dtype=np.int32)
        self.emit = np.full(capacity, -1, dtype=np.int32)  # tokens emitted on leaving a run here
        self.size, self.remember = 2, remember
        self.counts: dict[str, int] = {}
        self.kinds = {START: BLANK}
        heads = np.zeros(self.width, dtype=np.int32)
        for c, s in self.symbol.items():
            heads[s] = self.size * self.width
            self.kinds[self.size] = int(self.kind[s])
            self.emit[self.size] = len(self.words.run(c))
            self.size += 1
        heads[BLANK] = START * self.width
        self.heads = heads
        self.next[TRAP, BLANK] = START * self.width
        self.next[START] = heads
        for state in range(2, self.size):
            self._leave(state)
        self.flat = self.next.ravel()

    @classmethod
    def of(cls, path: str) -> "Transducer":
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _leave(self, state: int) -> None:
        """Transitions of a new state: another kind of character begins a new run, its own kind is not compiled yet."""
        row = self.heads.copy()
        if self.kinds[state] != DIGIT:
            row[self.kind == self.kinds[state]] = TRAP
        self.next[state] = row

    def compile(self, run: str, count: int) -> None:
        """Add a run of letters or marks with its token count, if there is room."""
        if self.size + len(run) > len(self.next) or any(c not in self.symbol for c in run):
            return
        state = int(self.heads[self.symbol[run[0]]]) // self.width
        for c in run[1:]:
            after = int(self.next[state, self.symbol[c]]) // self.width
            if after == TRAP:
                after, self.size = self.size, self.size + 1
                self.kinds[after] = self.kinds[state]
                self._leave(after)
                self.next[state, self.symbol[c]] = after * self.width
            state = after
        self.emit[state] = count

    def _run_count(self, run: str) -> int:
        got = self.counts.get(run)
        if got is not None:
            self.compile(run, got)  # met again
            return got
        got = len(self.words.run(run))
        if len(run) <= 64:
            if len(self.counts) >= self.remember:
                self.counts.clear()
            self.counts[run] = got
        return got

    def piece_count(self, piece: str) -> int:
        low = plain(piece)
        if low is None:
            return len(self.words.whole.encode(piece, add_special_tokens=False).ids)
        return sum(self._run_count(r) for r in RUN.findall(low))

    # -- running

    def _states(self, sym: np.ndarray) -> np.ndarray:
        """Row start of the state after every symbol."""
        lanes = -(-len(sym) // LANE)
        grid = np.zeros(lanes * LANE, dtype=np.int32)
        grid[: len(sym)] = sym
        grid = np.ascontiguousarray(grid.reshape(lanes, LANE).T)
        out = np.empty((LANE, lanes), dtype=np.int32)
        begun = np.full(lanes, START * self.width, dtype=np.int32)
        at = begun
        for t in range(LANE):
            np.take(self.flat, at + grid[t], out=out[t], mode="clip")
            at = out[t]
        while True:  # compose the lanes' maps: drive lanes that are entered in another state
            enter = np.concatenate((begun[:1], out[-1, :-1]))
            lane = np.flatnonzero(enter != begun)
            if not len(lane):
                return out.T.ravel()[: len(sym)]
            begun, at = enter, enter[lane]
            for t in range(LANE):
                at = self.flat[at + grid[t, lane]]
                differs = at != out[t, lane]
                out[t, lane[differs]] = at[differs]
                lane, at = lane[differs], at[differs]
                if not len(lane):
                    break

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of every text."""
        joined = " ".join(texts) + " "
        sym = self.symbol_of[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        states = self._states(sym) // self.width
        kind = self.kind[sym]
        ends = np.flatnonzero((kind == DIGIT) | ((kind >= LETTER) & (kind != np.concatenate((kind[1:], [BLANK])))))
        tokens = np.zeros(len(sym), dtype=np.int32)
        tokens[ends] = self.emit[states[ends]]
        filled = (kind != BLANK).view(np.int8)
        edge = np.diff(filled, prepend=np.int8(0))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        if not len(start):
            return np.zeros(len(texts), dtype=np.int64)
        unknown = (tokens < 0) | ((states == TRAP) & (kind != BLANK))
        total = np.add.reduceat(tokens, start).astype(np.int64)
        bad = np.flatnonzero(np.add.reduceat(unknown, start, dtype=np.int64))
        for i, a, b in zip(bad.tolist(), start[bad].tolist(), end[bad].tolist(), strict=True):
            total[i] = self.piece_count(joined[a:b])
        text = np.searchsorted(np.cumsum(lengths), start, side="right")
        return np.bincount(text, weights=total, minlength=len(texts)).astype(np.int64)


def parts_of(text: str, limit: int = PASS_CHARS) -> list[str]:
    """A long text cut at blanks into parts of about ``limit`` characters; their counts add up."""
    if len(text) <= limit:
        return [text]
    parts, at = [], 0
    while at < len(text):
        end = min(len(text), at + limit)
        while end < len(text) and text[end] not in BLANKS:
            end += 1
        parts.append(text[at:end])
        at = end
    return parts


def count_texts(texts: list[str | None], machine: Transducer) -> list[int]:
    """Exact token counts; null is empty."""
    totals = [0] * len(texts)
    owner, group, size = [], [], 0
    for i, t in enumerate(texts):
        for part in parts_of(t or ""):
            owner.append(i)
            group.append(part)
            size += len(part) + 1
            if size >= PASS_CHARS:
                for o, n in zip(owner, machine.count(group).tolist(), strict=True):
                    totals[o] += n
                owner, group, size = [], [], 0
    if group:
        for o, n in zip(owner, machine.count(group).tolist(), strict=True):
            totals[o] += n
    return totals


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    ``tokenizer`` is the path of the vocabulary file, which every worker has. Counts are those of the
    tokenizer on the whole text without added special tokens. Null texts count as empty (0 bytes, 0
    tokens); repeated rows get equal results; an empty table gives an empty result; other columns are ignored.
    """
    rows = spread_tasks(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))

    def run(batches):
        machine = Transducer.of(tokenizer)
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                texts = part.column(1).to_pylist()
                n = count_texts(texts, machine)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()),
                     pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_bytes bigint, n_tokens bigint, over_limit boolean")
