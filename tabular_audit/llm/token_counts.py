"""Token counts by a compiled finite-state transducer.

The byte-pair tokenizer is compiled to a deterministic transducer over the bytes of a
pre-token.  A state holds what can still matter: the longest suffix that begins a longer
token, and for each position in it from which a token may still grow the last token of
the encoding up to there and the token count relative to now.  Every transition carries the change of the token count.
The last token after a byte is the one suffix token that may follow the encoding before
it: two tokens may meet if encoding their joined bytes gives just them again.  States
and transitions are compiled when first met.

Texts are joined and cut into chunks of equal length that run in lockstep.  A chunk maps
the state it is entered with to the state it is left with and a count.  From the first
pre-token border on, both no longer depend on the entry, so this part of every chunk runs
at once.  A chunk without a border gets a map for the entries that occur: all such chunks
run at once from a guess, then from what the chunk before is left with, until no new entry
comes up.  A prefix scan composes the maps by doubling and so gives every chunk its entry,
from which the parts before the first border run, again all at once.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import text_slices
from .vocabulary import SPECIAL, Vocabulary, pretoken_starts, vocabulary, windows

CHUNK = 256
GUESSES = 16  # rounds in which entries that may not occur are followed
PART = 1 << 20  # characters of a long text counted at a time
ROOT, HELD = 0, 1
NONE, DEAD = -1, -2  # no token before; no token can begin here
SHIFT, BIAS = 5, 16  # a transition is target << SHIFT | (count change + BIAS)


class Transducer:
    """Deterministic transducer of a vocabulary, compiled on demand.

    At most ``most_states`` states are held; beyond, it is compiled afresh between two
    batches, so memory is bounded whatever the texts are.
    """

    def __init__(self, words: Vocabulary, most_states: int = 250_000):
        self.ids = words.ids
        self.bytes_of = {i: b for b, i in words.ids.items()}
        self.begins = {b[:k] for b in words.ids for k in range(len(b))}
        self.single = words.encoding._core_bpe.encode_single_piece
        self.most_states = most_states
        self.meets: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.column = np.full(256, -1, np.int64)
        self.width, self.columns = 32, 0
        root = (b"", (NONE,), (0,))
        self.states = [root, (b"", (), ())]  # the second stands for an unknown entry
        self.known = {root: ROOT}
        self.step = np.full((1024, self.width), -1, np.int32)
        self.step[HELD] = HELD << SHIFT | BIAS

    def may_meet(self, a: int, b: int) -> bool:
        pair = (a, b)
        if pair not in self.meets:
            if len(self.meets) > 2_000_000:
                self.meets.clear()
            self.meets[pair] = self.single(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return self.meets[pair]

    def compile(self, state: int, byte: int) -> int:
        """The transition of ``state`` on ``byte``."""
        window, last, counts = self.states[state]
        window += bytes([byte])
        for start in range(len(window)):
            token = self.ids.get(window[start:])
            if token is not None and last[start] != DEAD and (
                    last[start] == NONE or self.may_meet(last[start], token)):
                break
        change = counts[start] + 1
        last, counts = (*last, token), (*(c - change for c in counts), 0)
        alive = [window[i:] in self.begins for i in range(len(window) + 1)]
        start = alive.index(True)
        key = (window[start:],
               tuple(v if a else DEAD for v, a in zip(last[start:], alive[start:])),
               tuple(c if a else 0 for c, a in zip(counts[start:], alive[start:])))
        target = self.known.get(key)
        if target is None:
            target = self.known[key] = len(self.states)
            self.states.append(key)
            if target >= len(self.step):
                self.step = np.vstack([self.step, np.full_like(self.step, -1)])
        return target << SHIFT | (change + BIAS)

    def symbols(self, data: np.ndarray) -> np.ndarray:
        """Bytes as columns of the table, which has those that occur."""
        for byte in np.flatnonzero(np.bincount(data, minlength=256)):
            if self.column[byte] < 0:
                if self.columns == self.width:
                    wider = np.full((len(self.step), 2 * self.width), -1, np.int32)
                    wider[:, : self.width] = self.step
                    wider[HELD] = HELD << SHIFT | BIAS
                    self.step, self.width = wider, 2 * self.width
                self.column[byte] = self.columns
                self.columns += 1
        self.byte = np.zeros(self.width, np.int64)
        seen = np.flatnonzero(self.column >= 0)
        self.byte[self.column[seen]] = seen
        return self.column[data].astype(np.int32)

    def advance(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The transitions of all lanes; missing ones are compiled."""
        at = state * np.int32(self.width) + symbol
        moves = self.step.ravel().take(at)
        while len(moves) and moves.min() < 0:
            for where in np.unique(at[moves < 0]):
                s, c = divmod(int(where), self.width)
                move = self.compile(s, int(self.byte[c]))
                self.step[s, c] = move
            moves = self.step.ravel().take(at)
        return moves

    def scan(self, free: np.ndarray, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The states in which the border-free chunks ``free`` are left; ``state`` has those
        of the others.

        A node is a chunk with an entry; it leads to the next chunk with what it is left with.
        The nodes that the true entries lead to are found by doubling.
        """
        is_free = np.zeros(len(state) + 1, bool)
        is_free[free] = True
        begins = ~is_free[free - 1]  # the first chunk of all holds a border
        nodes = free.astype(np.int64) << 32 | np.where(begins, state[free - 1], ROOT)
        true = nodes[begins]
        keys, left = np.empty(0, np.int64), np.empty(0, np.int32)
        rounds = 0
        while len(nodes):
            chunk, now = nodes >> 32, (nodes & 0xFFFFFFFF).astype(np.int32)
            for t in range(CHUNK):
                now = self.advance(now, symbol[t, chunk]) >> SHIFT
            order = np.argsort(keys := np.concatenate([keys, nodes]))
            keys, left = keys[order], np.concatenate([left, now])[order]
            follows = (keys >> 32) + 1 << 32 | left
            goes_on = is_free[(keys >> 32) + 1]
            at = np.searchsorted(keys, follows)
            known = goes_on & (keys[np.minimum(at, len(keys) - 1)] == follows)
            rounds += 1
            reached = goes_on & ~known
            if rounds >= GUESSES or not reached.any():
                met = self.met(np.where(known, at, len(keys)), np.searchsorted(keys, true), len(free))
                reached &= met
            nodes = np.unique(follows[reached])
        return left[met]

    @staticmethod
    def met(jump: np.ndarray, starts: np.ndarray, longest: int) -> np.ndarray:
        """The nodes on the ways from ``starts``; ``jump`` is the next node or their number."""
        end = len(jump)
        jump = np.append(jump, end)
        met = np.zeros(end + 1, bool)
        met[starts] = True
        hops = 1
        while hops <= longest:
            met[jump[met]] = True
            jump = jump[jump]  # composed with itself: twice as many chunks
            hops *= 2
        return met[:end]

    def count(self, data: np.ndarray, border: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of the texts that end at ``ends`` in ``data``; ``border`` marks the
        bytes that start a pre-token."""
        if not len(data):
            return np.zeros(len(ends), np.int64)
        if len(self.states) > self.most_states:
            self.reset()
        lanes = -(-len(data) // CHUNK)
        padded = np.zeros(lanes * CHUNK, np.int32)
        padded[: len(data)] = self.symbols(data)
        marks = np.ones(lanes * CHUNK, bool)
        marks[: len(data)] = border
        symbol = np.ascontiguousarray(padded.reshape(lanes, CHUNK).T)
        goes_on = np.ascontiguousarray(~marks.reshape(lanes, CHUNK).T).astype(np.int32)
        changes = np.empty((CHUNK, lanes), np.int8)

        state = np.full(lanes, HELD, np.int32)
        for t in range(CHUNK):
            moves = self.advance(state * goes_on[t], symbol[t])
            changes[t] = (moves & (1 << SHIFT) - 1) - BIAS
            state = moves >> SHIFT

        head = np.where(goes_on.all(axis=0), CHUNK, goes_on.argmin(axis=0))
        free = np.flatnonzero(head == CHUNK)
        if len(free):
            state[free] = self.scan(free, state, symbol)
        waiting = np.flatnonzero(head)
        now = state[waiting - 1]
        for t in range(int(head.max())):
            on = head[waiting] > t
            lane = waiting[on]
            moves = self.advance(now[on], symbol[t, lane])
            changes[t, lane] = (moves & (1 << SHIFT) - 1) - BIAS
            now[on] = moves >> SHIFT

        sums = np.concatenate([[0], np.cumsum(changes.T.ravel()[: len(data)], dtype=np.int64)])
        return np.diff(sums[np.concatenate([[0], ends])])


@lru_cache(maxsize=1)
def transducer(path: str) -> Transducer:
    return Transducer(vocabulary(path))


def count_texts(texts: list[str], machine: Transducer) -> np.ndarray:
    """Tokens of each text.  The special string counts as one token and separates."""
    extra = np.array([t.count(SPECIAL) for t in texts], np.int64)
    parts, owner = list(texts), np.arange(len(texts))
    if extra.any():
        split = [t.split(SPECIAL) for t in texts]
        parts = [p for s in split for p in s]
        owner = np.repeat(owner, [len(s) for s in split])
    sizes = np.array([len(p) for p in parts], np.int64)
    full = sizes > 0
    joined = "".join(parts)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    first = np.zeros(len(points), bool)
    chars = np.cumsum(sizes)
    first[(chars - sizes)[full]] = True
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    offset = np.concatenate([[0], np.cumsum(width)])
    border = np.zeros(offset[-1], bool)
    if len(points):
        border[offset[:-1][pretoken_starts(points, first)]] = True
    counts = machine.count(np.frombuffer(joined.encode(), np.uint8), border, offset[chars])
    return np.bincount(owner, counts, minlength=len(texts)).astype(np.int64) + extra


def count_long(text: str, machine: Transducer) -> int:
    """Tokens of a text of any length, in parts that end at pre-token borders."""
    pieces = text.split(SPECIAL)
    total, held, size = len(pieces) - 1, [], 0
    for piece in pieces:
        for part, _ in windows(piece, PART):
            held.append(part)
            size += len(part)
            if size >= PART:
                total += int(count_texts(held, machine).sum())
                held, size = [], 0
    return total + int(count_texts(held, machine).sum())


def token_counts(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512
) -> DataFrame:
    """Tokens of every whole text: id, n_bytes, n_tokens, over_limit (more than ``limit``).

    ``path`` names a byte-level vocabulary file.  Null and empty texts have no bytes and
    no tokens.  Long texts are counted in parts; only a stretch without any pre-token border,
    as of letters, is held whole.  Rows stay as they are: repeated ids give repeated rows, null ids stay null,
    other columns are not read.  No shuffle.
    """
    def run(batches):
        machine = transducer(path)
        for batch, texts in text_slices(batches, "text"):
            whole = len(texts) > 1 or len(texts[0]) <= 2 * PART
            counts = pa.array(count_texts(texts, machine) if whole else [count_long(texts[0], machine)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), counts],
                                             ["id", "n_bytes", "n_tokens"])

    read = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
        F.col(text_col).alias("text"),
    )
    kind = read.schema["id"].dataType.simpleString()
    counted = read.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens",
                          (F.col("n_tokens") > limit).alias("over_limit"))
