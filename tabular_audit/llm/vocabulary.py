"""The byte-level vocabulary: pre-token borders, and ids by merge ranks.

A vocabulary file is read in every Python worker, once, from ``path``.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

SPECIAL = "<|endoftext|>"
#: The encoder's own pattern fails on runs of white space somewhat under 1,000,000 characters;
#: longer texts are cut by ``pretoken_starts``, and pre-tokens over this are encoded one by one.
LONG = 1 << 19

# Character classes.  White space is Unicode's White_Space property.
OTHER, LETTER, NUMBER, SPACE, BLANK, EDGE = range(6)
WHITE = [*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F,
         0x205F, 0x3000]


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    """Class of every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)),
                        dtype=np.uint8, count=0x110000)
    table[WHITE] = BLANK
    table[0x20] = SPACE
    return table


def pretoken_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Marks where pre-tokens start in joined texts; ``first`` marks each text's start.

    The split is that of the public byte-level pattern: contractions, then runs of
    letters, numbers or other characters with a leading space, then white space, of
    which a run gives its last character to what follows.
    """
    n = len(points)
    kind = character_classes()[points]
    before = np.empty_like(kind)
    before[1:] = kind[:-1]
    before[first] = EDGE
    after = np.empty_like(kind)
    after[:-1] = kind[1:]
    after[-1:] = EDGE
    after[:-1][first[1:]] = EDGE
    white = (kind == SPACE) | (kind == BLANK)
    white_before = (before == SPACE) | (before == BLANK)
    start = np.where(
        white,
        ~white_before | ((after != SPACE) & (after != BLANK) & (after != EDGE)),
        (before != kind) & (before != SPACE),
    )
    start |= first

    quotes = np.flatnonzero((points == 39) & start)
    if len(quotes):
        text = np.cumsum(first)

        def at(i, k):
            j = np.minimum(i + k, n - 1)
            return np.where((i + k < n) & (text[j] == text[i]), points[j], 0)

        one, two = at(quotes, 1), at(quotes, 2)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = np.zeros(len(quotes), bool)
        for pair in ("re", "ve", "ll"):
            long |= (one == ord(pair[0])) & (two == ord(pair[1]))
        for which, size in ((short, 2), (long, 3)):
            q = quotes[which]
            for k in range(1, size):
                start[q + k] = False
            end = q[q + size < n] + size
            start[end] = True
    return start


class Vocabulary:
    """Token bytes to ids of a byte-level file in which ids follow the merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        # Printable stand-ins of bytes: printable ones stand for themselves, the
        # others for code points from 256 on.
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        names = {b: b for b in plain} | {
            b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        byte = {chr(c): b for b, c in names.items()}
        self.ids = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items()
                    if token != SPECIAL}
        for i, merge in enumerate(model["merges"]):
            merged = "".join(merge.split(" ") if isinstance(merge, str) else merge)
            if model["vocab"].get(merged) != 256 + i:
                raise ValueError("the ids of this vocabulary do not follow its merges")
        self.special = model["vocab"].get(SPECIAL, 256 + len(model["merges"]))

    @property
    def encoding(self):
        """A fast encoder of ordinary text."""
        import tiktoken

        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        return tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=self.ids,
                                 special_tokens={})


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def windows(text: str, size: int = 1 << 18) -> Iterator[tuple[str, np.ndarray]]:
    """Parts of a long text with the starts of their pre-tokens.  A part ends where a pre-token ends and
    no white space stands before, so that parts can be encoded one by one; it is
    longer than ``size`` only where no such place comes earlier."""
    at, wide = 0, size
    while at < len(text):
        part = text[at:at + wide]
        points = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        first = np.zeros(len(points), bool)
        first[0] = True
        starts = np.flatnonzero(pretoken_starts(points, first))
        if at + wide < len(text):
            kind = character_classes()[points]
            white = (kind == SPACE) | (kind == BLANK)
            # What follows the part can still change the borders of its last characters.
            safe = starts[(starts > 0) & (starts < len(points) - 8)]
            safe = safe[~white[safe - 1]]
            if not len(safe):
                wide *= 2
                continue
            part, starts = part[:safe[-1]], starts[starts < safe[-1]]
        yield part, starts
        at, wide = at + len(part), size


@lru_cache(maxsize=4)
def encoder(path: str, special: bool = True):
    """text -> array of ids; with ``special`` the special string is an id of its own, else text."""
    words = vocabulary(path)
    encoding = words.encoding

    def ordinary(text: str) -> np.ndarray:
        if len(text) <= LONG:
            return encoding.encode_to_numpy(text, disallowed_special=())
        out = []
        for part, starts in windows(text):
            longest = int(np.diff(starts, append=len(part)).max())
            if longest <= LONG:
                out.append(encoding.encode_to_numpy(part, disallowed_special=()))
                continue
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(part)]):
                ids = encoding._encode_single_piece(part[a:b])
                out.append(np.array(ids, np.uint32))
        return np.concatenate(out)

    def encode(text: str) -> np.ndarray:
        if not special or SPECIAL not in text:
            return ordinary(text)
        out = []
        for part in text.split(SPECIAL):
            out += [ordinary(part), np.array([words.special], np.uint32)]
        return np.concatenate(out[:-1])

    return encode
