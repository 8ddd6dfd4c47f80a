"""Document quality by random Fourier features, ridge regression and isotonic calibration.

Statistics of a text (shares of character kinds, word lengths, repetition, lines) are
standardised and mapped to random cosine features, which approximate a Gaussian kernel.
Every partition sums its part of the normal equations of the labelled rows; the sums of
the partitions are added row by row, and only the one small system reaches the driver.
Raw scores of the labelled rows are counted in fixed steps, and the pool-adjacent-violators
algorithm turns the steps into calibrated probabilities.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import kept, text_slices

STATISTICS = [
    "letters", "capitals", "digits", "spaces", "stops", "symbols", "non_ascii", "log_characters",
    "log_words", "word_length", "word_spread", "short_words", "long_words", "distinct_words",
    "top_word", "repeated_next", "capital_words", "symbol_words", "log_lines", "distinct_lines",
    "words_per_line", "stopped_lines",
]
STEPS = 400  # of the raw score, from -0.5 to 1.5


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """Kind of each code point: lower or other letter, capital, digit, space, stop, symbol."""
    table = np.full(0x110000, 5, np.uint8)
    for point in range(0x110000):
        char = chr(point)
        if char.isalpha():
            table[point] = 1 if char.isupper() else 0
        elif char.isdigit():
            table[point] = 2
        elif char.isspace():
            table[point] = 3
    table[[ord(c) for c in ".,;:'\"?()-"]] = 4
    return table


def word_statistics(text: str) -> list[float]:
    words = text.split()
    lines = [line for line in text.split("\n") if line.strip()]
    n = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    counts = Counter(words)
    return [
        np.log1p(len(words)),
        sizes.mean() if words else 0.0, sizes.std() if words else 0.0,
        float((sizes <= 3).sum()) / n, float((sizes >= 15).sum()) / n,
        len(counts) / n, max(counts.values(), default=0) / n,
        sum(map(str.__eq__, words, words[1:])) / n,
        sum(map(str.isupper, words)) / n,
        sum(not w[-1].isalnum() and w[-1] not in ".,;:'\"?()-" for w in words) / n,
        np.log1p(len(lines)), len(set(lines)) / max(1, len(lines)),
        np.log1p(len(words) / max(1, len(lines))),
        sum(line.rstrip()[-1] in ".?!:\"" for line in lines) / max(1, len(lines)),
    ]


def statistics(texts: list[str]) -> np.ndarray:
    """A row of ``STATISTICS`` per text; all zero for an empty one."""
    sizes = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), sizes)
    counts = np.bincount(owner * 6 + kinds()[points], minlength=6 * len(texts)).reshape(-1, 6)
    wide = np.bincount(owner, points > 127, minlength=len(texts))
    size = np.maximum(sizes, 1)
    letters = counts[:, 0] + counts[:, 1]
    head = np.column_stack([
        letters / size, counts[:, 1] / np.maximum(letters, 1), counts[:, 2] / size,
        counts[:, 3] / size, counts[:, 4] / size, counts[:, 5] / size, wide / size, np.log1p(sizes)])
    return np.hstack([head, np.array([word_statistics(t) for t in texts]).reshape(len(texts), -1)])


def statistics_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and x, the statistics of every whole text."""
    def run(batches):
        for batch, texts in text_slices(batches, "text"):
            x = statistics(texts)
            rows = pa.ListArray.from_arrays(
                np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), rows], ["id", "x"])

    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return read.mapInArrow(run, f"id {read.schema['id'].dataType.simpleString()}, x array<double>")


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


class Kernel:
    """Random Fourier features of standardised statistics, with a constant in front."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, features: int, width: float, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        self.w = rng.normal(0, 1 / (width * np.sqrt(len(mean))), (len(mean), features))
        self.phase = rng.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        return np.hstack([np.ones((len(x), 1)), np.sqrt(2 / len(self.phase)) * np.cos(z @ self.w + self.phase)])


def normal_equations(labelled: DataFrame, kernel: Kernel) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all rows of the features' outer products and of features times label."""
    size, width = len(kernel.phase) + 1, len(kernel.mean)

    def part(batches):
        total, right = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            f, y = kernel(matrix(batch.column(0), width)), batch.column(1).to_numpy()
            total += f.T @ f
            right += f.T @ y
        yield pa.RecordBatch.from_pydict({
            "row": np.arange(size, dtype=np.int32), "sums": np.hstack([total, right[:, None]]).tolist()},
            schema=pa.schema([("row", pa.int32()), ("sums", pa.list_(pa.float64()))]))

    def add(frame):
        return pd.DataFrame({"row": frame["row"].iloc[:1], "sums": [np.sum(np.stack(frame["sums"]), axis=0)]})

    form = "row int, sums array<double>"
    rows = (labelled.select("x", F.col("y").cast("double")).mapInArrow(part, form)
            .groupBy("row").applyInPandas(add, form).collect())
    sums = np.array([r["sums"] for r in sorted(rows, key=lambda r: r["row"])])
    return sums[:, :-1], sums[:, -1]


def step_of(raw: np.ndarray) -> np.ndarray:
    return np.clip(np.floor((raw + 0.5) * (STEPS / 2)), 0, STEPS - 1).astype(np.int64)


def isotonic(counts: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """Probability of every step: pooled until it does not fall; steps without rows lie on
    the line between their neighbours."""
    blocks: list[list[float]] = []  # weight, positives, first step, last step
    for step in np.flatnonzero(counts):
        blocks.append([counts[step], positive[step], step, step])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            w, p, _, last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + w, blocks[-1][1] + p, blocks[-1][2], last]
    at = [s for b in blocks for s in (b[2], b[3])]
    value = [b[1] / b[0] for b in blocks for _ in range(2)]
    return np.interp(np.arange(len(counts)), at, value)


def fit(labelled: DataFrame, features: int, width: float, penalty: float, seed: int):
    """A function of statistics to calibrated scores, from rows (x, y)."""
    columns = [F.col("x")[i] for i in range(len(STATISTICS))]
    first = labelled.agg(
        F.count("*").alias("n"), F.avg("y").alias("rate"),
        F.array(*(F.avg(c) for c in columns)).alias("mean"),
        F.array(*(F.stddev_pop(c) for c in columns)).alias("spread")).first()
    if not first["n"] or first["rate"] in (0.0, 1.0):
        rate = 0.5 if not first["n"] else first["rate"]
        return lambda x: np.full(len(x), rate)
    kernel = Kernel(np.array(first["mean"]), np.array(first["spread"]), features, width, seed)
    left, right = normal_equations(labelled, kernel)
    ridge = penalty * np.eye(len(left))
    ridge[0, 0] = 1e-9
    weights = np.linalg.solve(left / first["n"] + ridge, right / first["n"])

    def count(batches):
        sums = np.zeros((2, STEPS))
        for batch in batches:
            step = step_of(kernel(matrix(batch.column(0), len(kernel.mean))) @ weights)
            sums[0] += np.bincount(step, minlength=STEPS)
            sums[1] += np.bincount(step, batch.column(1).to_numpy(), minlength=STEPS)
        yield pa.RecordBatch.from_pydict({"step": np.arange(STEPS), "n": sums[0], "positive": sums[1]})

    counted = (labelled.select("x", F.col("y").cast("double"))
               .mapInArrow(count, "step long, n double, positive double")
               .groupBy("step").agg(F.sum("n").alias("n"), F.sum("positive").alias("positive"))
               .orderBy("step").collect())
    table = isotonic(np.array([r["n"] for r in counted]), np.array([r["positive"] for r in counted]))
    return lambda x: table[step_of(kernel(x) @ weights)]


def quality_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "quality", features: int = 384, width: float = 0.7, penalty: float = 1e-5,
    seed: int = 11,
) -> DataFrame:
    """Score of every whole text: id and score (0 to 1, higher if label 1 is likelier).

    ``labels`` holds id and a 0/1 label of the rows to learn from; rows with null id or
    label teach nothing, repeated ones count as often as they come.  Null and empty texts
    are scored like any other, by statistics of zero.  Without labels of both kinds every
    score is the labels' rate (0.5 without any).  Rows of ``docs`` stay as they are; other
    columns are not read.  Texts are read once; then only their statistics.
    """
    table = kept(statistics_table(docs, id_col, text_col), "statistics")
    taught = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).dropna()
    labelled = kept(table.join(taught, "id").select("x", "y"), "labelled")
    score = fit(labelled, features, width, penalty, seed)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score(matrix(batch.column(1), len(STATISTICS))))], ["id", "score"])

    kind = table.schema["id"].dataType.simpleString()
    return table.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)
