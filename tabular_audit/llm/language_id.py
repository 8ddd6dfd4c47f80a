"""Language identification by cross-parsing entropy.

Per language, a suffix automaton is built of a bounded sample of labelled texts.  A text
is parsed against each automaton into phrases, each the longest match with anything in the
sample (or one unmatched letter).  A phrase costs the logarithm of the sample's length, so
the bits per letter estimate the cross entropy.  To compare languages, a phrase costs the
logarithm of the longest sample in all of them, and a letter that the sample lacks also
that of the alphabet, so that a small sample is not cheap; the fewest bits win.

Texts are reduced to lower-case letters with single spaces between words.  Letters of many
texts run through an automaton in lockstep, in stretches of ``STRETCH`` letters; a phrase
ends with its stretch, which adds at most one phrase to a stretch for every language.
"""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .common import text_slices

STRETCH = 512
GAP = 0  # the symbol of anything between words
UNDETERMINED = "und"
SHARES = 12  # no text gives more than one part in so many of a sample


@lru_cache(maxsize=1)
def lower_letters() -> np.ndarray:
    """For every code point its lower-case letter, 0 for other characters."""
    table = np.zeros(0x110000, np.int32)
    for point in range(0x110000):
        char = chr(point)
        if char.isalpha():
            lower = char.lower()
            table[point] = ord(lower) if len(lower) == 1 else point
    return table


def letters_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of all texts with single gaps (0) between words, none at the ends; how many
    symbols each text has, and how many letters."""
    points = lower_letters()[np.frombuffer("\0".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes + 1) - 1  # each text is followed by one gap
    points = np.append(points, 0)
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    letter = points > 0
    after = np.append(letter[1:], False)
    after[ends] = False
    begun = np.cumsum(letter) - np.concatenate([[0], np.cumsum(letter)])[ends - sizes][owner] > 0
    use = letter | (~letter & after & begun)
    counts = np.bincount(owner[use], minlength=len(texts))
    return points[use], counts, np.bincount(owner[letter], minlength=len(texts))


class SuffixAutomaton:
    """The automaton of a text.  The moves of a state lie in one array from ``base[state]``
    on, a cell per symbol, fitted into the gaps of other states; a cell names its state.
    A symbol without a move ends the phrase and starts the next by ``start``.  So memory
    grows with the text, not with the alphabet."""

    def __init__(self, symbols: list[int], alphabet: int):
        moves: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for symbol in symbols:
            new = len(moves)
            moves.append({})
            link.append(0)
            length.append(length[last] + 1)
            at = last
            while at >= 0 and symbol not in moves[at]:
                moves[at][symbol] = new
                at = link[at]
            if at >= 0:
                target = moves[at][symbol]
                if length[at] + 1 == length[target]:
                    link[new] = target
                else:
                    copy = len(moves)
                    moves.append(dict(moves[target]))
                    link.append(link[target])
                    length.append(length[at] + 1)
                    link[target] = link[new] = copy
                    while at >= 0 and moves[at].get(symbol) == target:
                        moves[at][symbol] = copy
                        at = link[at]
            last = new
        # A symbol that the sample lacks is a phrase of its own: its state has no moves.
        self.start = np.full(alphabet, len(moves), np.int32)
        for symbol, target in moves[0].items():
            self.start[symbol] = target
        self.place(moves, alphabet)
        self.bits = float(np.log2(len(symbols) + 1))

    def place(self, moves: list[dict[int, int]], alphabet: int) -> None:
        """Cells for all moves but those of the first state, which ``start`` has."""
        size = 3 * sum(map(len, moves[1:])) + 2 * alphabet
        cells, base = [-1] * size, [0] * (len(moves) + 1)
        rng = random.Random(1)
        single = []
        for state in sorted(range(1, len(moves)), key=lambda s: -len(moves[s])):
            own = moves[state]
            if len(own) == 1:
                single.append(state)
                continue
            for _ in range(1000):
                at = rng.randrange(size - alphabet)
                if all(cells[at + symbol] < 0 for symbol in own):
                    break
            else:  # behind all others
                at = len(cells)
                cells += [-1] * alphabet
            base[state] = at
            for symbol, target in own.items():
                cells[at + symbol] = state << 32 | target
        free = (i for i in range(alphabet, len(cells)) if cells[i] < 0)
        for state, at in zip(single, free):
            (symbol, target), = moves[state].items()
            base[state] = at - symbol
            cells[at] = state << 32 | target
        self.base, self.cells = np.array(base, np.int32), np.array(cells, np.int64)

    def moved(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and whether a phrase goes on."""
        cell = self.cells.take(self.base.take(state) + symbol)
        goes_on = cell >> 32 == state
        return np.where(goes_on, cell & 0xFFFFFFFF, self.start.take(symbol)), goes_on


class Model:
    """Languages, their letters and their automata."""

    def __init__(self, samples: dict[str, list[str]], letters: int, shares: int = SHARES):
        self.languages = sorted(samples)
        parsed = []
        most = max(1, letters // shares)
        for language in self.languages:
            symbols: list[int] = []
            for text in samples[language]:
                points = letters_of([text])[0]
                symbols += points[: min(most, letters - len(symbols))].tolist() + [GAP]
                if len(symbols) >= letters:
                    break
            parsed.append(symbols)
        known = sorted({s for symbols in parsed for s in symbols} - {GAP})
        self.code = np.full(0x110000, len(known) + 1, np.uint8 if len(known) < 254 else np.int32)
        self.code[GAP] = 0
        self.code[known] = np.arange(1, len(known) + 1)
        # The alphabet is the gap, the known letters and one symbol for others.
        self.automata = [SuffixAutomaton(self.code[np.array(symbols)].tolist(), len(known) + 2)
                         for symbols in parsed]
        self.lacks = np.ones((len(parsed), len(known) + 2), bool)
        for lacks, symbols in zip(self.lacks, parsed):
            lacks[self.code[np.array(symbols)]] = False
        self.phrase_bits = max(automaton.bits for automaton in self.automata)
        self.letter_bits = float(np.log2(len(known) + 2))

    def bits_per_letter(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A row per text of estimated bits per symbol and language, and the letters."""
        phrases, _, counts, letters = self.parse(texts)
        bits = phrases * np.array([automaton.bits for automaton in self.automata])
        return bits / np.maximum(counts, 1)[:, None], letters

    def comparable_bits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same at one price for all languages, with letters that a sample lacks charged."""
        phrases, unknown, counts, letters = self.parse(texts)
        bits = phrases * self.phrase_bits + unknown * self.letter_bits
        return bits / np.maximum(counts, 1)[:, None], letters

    def parse(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per text and language the phrases and the symbols that the sample lacks; per text
        the symbols and the letters."""
        points, counts, letters = letters_of(texts)
        stretches = -(-counts // STRETCH)
        total = int(stretches.sum())
        owner = np.repeat(np.arange(len(texts)), stretches)
        nth = np.arange(total) - np.repeat(np.cumsum(stretches) - stretches, stretches)
        size = np.minimum(STRETCH, counts[owner] - nth * STRETCH)
        begin = np.repeat(np.cumsum(counts) - counts, stretches) + nth * STRETCH
        # Lanes of one array; what lies behind a lane's end is not counted.
        symbols = np.append(self.code[points], np.zeros(STRETCH, self.code.dtype))
        out = np.zeros((len(texts), len(self.languages)))
        unknown = np.zeros((len(texts), len(self.languages)))
        ends = np.cumsum(counts)
        order = np.argsort(-size, kind="stable")
        begin, size, owner = begin[order], size[order], owner[order]
        active = np.searchsorted(-size, -np.arange(STRETCH), "left")  # lanes longer than t
        for k, automaton in enumerate(self.automata):
            state, ended = automaton.start.take(symbols[begin]).astype(np.int64), np.ones(total, np.int64)
            for t in range(1, STRETCH):
                n = active[t]
                if not n:
                    break
                state[:n], goes_on = automaton.moved(state[:n], symbols[begin[:n] + t])
                ended[:n] += ~goes_on
            out[:, k] = np.bincount(owner, ended, minlength=len(texts))
            lacking = np.concatenate([[0], np.cumsum(self.lacks[k].take(symbols[:len(points)]))])
            unknown[:, k] = lacking[ends] - lacking[ends - counts]
        return out, unknown, counts, letters

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and bits per letter of the best language.  The score is the
        share of bits that the best language saves against the second best, as 2d/(1+d)
        for a share d, and 1 if only one language was learned."""
        bits, letters = self.comparable_bits(texts)
        order = np.argsort(bits, axis=1, kind="stable")
        rows = np.arange(len(texts))
        best = bits[rows, order[:, 0]]
        if len(self.languages) > 1:
            saved = 1 - best / np.maximum(bits[rows, order[:, 1]], 1e-12)
            score = np.clip(2 * saved / (1 + saved), 0, 1)
        else:
            score = np.ones(len(texts))
        found = [self.languages[k] if n else UNDETERMINED for k, n in zip(order[:, 0], letters)]
        return found, np.where(letters > 0, score, 0.0), np.where(letters > 0, best, 0.0)


def sample_texts(
    labelled: DataFrame, documents: int, letters: int, shares: int, labels: int,
    id_col: str, text_col: str, label_col: str,
) -> dict[str, list[str]]:
    """Up to ``documents`` different texts of each of the ``labels`` most frequent labels (ties:
    the first in order), chosen by a hash of id and text; of a long text a stretch from a
    place that the same hash draws, twice as many characters as letters are used of it."""
    counts = {r[label_col]: r["n"] for r in labelled.groupBy(label_col).agg(F.count("*").alias("n"))
              .orderBy(F.desc("n"), label_col).limit(labels).collect()}
    if not counts:
        return {}
    share = F.create_map(*(F.lit(v) for language, n in counts.items()
                           for v in (language, int(min(1.0, 2 * documents / n) * (1 << 30)))))
    stretch = 2 * max(1, letters // shares)
    drawn = F.xxhash64(F.col(id_col), F.col(text_col), F.lit("language"))
    begin = 1 + F.pmod(F.shiftright(drawn, 30), F.greatest(F.length(text_col) - stretch + 1, F.lit(1)))
    rows = (labelled.select(F.col(label_col).alias("label"), F.pmod(drawn, F.lit(1 << 30)).alias("draw"),
                            F.substring(F.col(text_col), begin.cast("int"), F.lit(stretch)).alias("text"))
            .where(F.col("draw") < F.element_at(share, F.col("label"))).distinct())
    order = Window.partitionBy("label").orderBy("draw", "text")
    rows = rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= documents).collect()
    samples: dict[str, list[str]] = {language: [] for language in counts}
    for row in sorted(rows, key=lambda r: (r["label"], r["nth"])):
        samples[row["label"]].append(row["text"])
    return {language: texts for language, texts in samples.items() if "".join(texts).strip()}


def language_id(
    docs: DataFrame, train: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "lang", documents: int = 120, letters: int = 24_000, shares: int = SHARES,
    labels: int = 200, carry: tuple[str, ...] = (),
) -> DataFrame:
    """Language of every whole text: id, lang_pred, score (0 to 1), bits_per_letter.

    Learned from the rows with text and label that ``train`` (all, if not given) selects:
    up to ``documents`` texts of each of the ``labels`` most frequent labels, chosen by a hash,
    of which ``letters`` letters per label are used, at most one part in ``shares`` of them from one text
    and from a drawn place in it.  All bounds are the same at every size; a model takes some
    3 MB per label with them, whatever the alphabets.
    Texts that are null or hold no letter are ``und`` with score 0, and so is every text
    if there is nothing to learn from.  Ties go to the first label in order.  Rows stay as
    they are, repeated or with null ids; of the other columns only those in ``carry`` are
    read, and returned.  No shuffle.
    """
    labelled = docs.where(F.col(text_col).isNotNull() & F.col(label_col).isNotNull())
    if train is not None:
        labelled = labelled.where(train)
    samples = sample_texts(labelled, documents, letters, shares, labels, id_col, text_col, label_col)
    model = Model(samples, letters, shares) if samples else None
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by labels x letters

    def run(batches):
        own = shared.value
        for batch, texts in text_slices(batches, "text"):
            if own is None:
                found, score, bits = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
            else:
                found, score, bits = own.predict(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(score), pa.array(bits)],
                ["id", "carried", "lang_pred", "score", "bits_per_letter"])

    read = docs.select(F.col(id_col).alias("id"), F.struct(F.lit(0).alias("_"), *carry).alias("carried"),
                       F.col(text_col).alias("text"))
    form = T.StructType([*read.schema.fields[:2], T.StructField("lang_pred", T.StringType()),
                         T.StructField("score", T.DoubleType()), T.StructField("bits_per_letter", T.DoubleType())])
    found = read.mapInArrow(run, form)
    return found.select(F.col("id").alias(id_col), "lang_pred", "score", "bits_per_letter",
                        *(F.col("carried")[c].alias(c) for c in carry))
