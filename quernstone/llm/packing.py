"""Texts into containers of fixed capacity: pattern packing by non-negative least squares.

Only the histogram of lengths (at most `capacity` rows) reaches the driver. Patterns of few lengths that fill a container
are enumerated from it, their repeat counts are fitted to the histogram by non-negative least squares, rounded down where they
would use more texts than there are, and what is left is packed best fit first, again as patterns. The plan - patterns with
repeat counts, its size independent of the number of texts - says which container the r-th text of a length goes to;
r comes from a count per partition and a number within it, so no length's texts ever meet in one task.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: The vocabulary file where the session names none in TOKENIZER_KEY. Every executor must be able to read it.
TOKENIZER, TOKENIZER_KEY = "/opt/tokenizers/byte_bpe_50k.json", "spark.quernstone.tokenizer"
#: Patterns enumerated, or three a length where that is more. What they leave is packed best fit first, so that every text is placed.
PATTERNS = 6_000


def token_counts(df: DataFrame, id_col: str, text_col: str, tokenizer: str | None = None) -> DataFrame:
    """(id, tokens) of every row, by a public tokenizer whose vocabulary file all executors can read: `tokenizer`, else the
    session's TOKENIZER_KEY, else TOKENIZER. Null texts count 0."""
    tokenizer = tokenizer or df.sparkSession.conf.get(TOKENIZER_KEY, TOKENIZER)
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(tokenizer)
        model.encode_special_tokens = True
        for batch in it:
            for at in range(0, batch.num_rows, 500):
                texts = [t or "" for t in batch.column(1).slice(at, 500).to_pylist()]
                counts = [len(e.ids) for e in model.encode_batch_fast(texts, add_special_tokens=False)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 500), pa.array(counts, pa.int32())], names=["id", "tokens"])

    return source.mapInArrow(batches, f"id {kind}, tokens int")


def _fill(lengths: np.ndarray, start: int, capacity: int, rng: np.random.Generator, spread: int) -> tuple[int, ...]:
    """A pattern that begins with `start` and goes on with large lengths picked among the `spread` that fit best."""
    got, room = [start], capacity - start
    while room >= lengths[0]:
        fits = int(np.searchsorted(lengths, room, "right"))
        # the last two are chosen so that they fill the room if any two can
        if room < 2 * lengths[-1] and len(got) >= 2:
            rest = room - lengths[:fits]
            at = np.searchsorted(lengths, rest, "right") - 1
            total = lengths[:fits] + np.where(at >= 0, lengths[np.maximum(at, 0)], 0)
            best = int(total.argmax())
            if total[best] == room:
                got += [int(lengths[best]), int(lengths[at[best]])] if at[best] >= 0 else [int(lengths[best])]
                return tuple(sorted(got, reverse=True))
        pick = int(lengths[max(0, fits - 1 - int(rng.integers(0, spread)))])
        got.append(pick)
        room -= pick
    return tuple(sorted(got, reverse=True))


def patterns(histogram: dict[int, int], capacity: int, limit: int = PATTERNS) -> list[tuple[int, ...]]:
    """Distinct patterns: for each length several ways to fill a container that begins with it."""
    lengths = np.array(sorted(histogram))
    rng = np.random.default_rng(len(lengths))
    found: dict[tuple[int, ...], None] = {}
    for spread in (1, 2, 4, 8, 16, 32, 64, max(1, len(lengths) // 4), max(1, len(lengths) // 2), len(lengths)):
        for start in lengths[::-1].tolist():
            if len(found) >= limit:
                return list(found)
            found[_fill(lengths, start, capacity, rng, spread)] = None
    return list(found)


def fit_counts(rows: list[tuple[int, ...]], histogram: dict[int, int], rounds: int = 2_000, close: float = 1e-4) -> tuple[np.ndarray, float]:
    """(repeat counts >= 0 that least-squares fit the histogram, weighted by length; share of the histogram's norm left unfitted).

    Accelerated projected gradients over the patterns as lists of lengths (memory grows with the patterns' lengths alone), until
    neither the counts nor the residual move by more than `close` of themselves over 20 rounds, at most `rounds`.
    """
    lengths = np.array(sorted(histogram))
    sizes = np.array([len(r) for r in rows])
    column = np.repeat(np.arange(len(rows)), sizes)
    line = np.searchsorted(lengths, np.array([n for r in rows for n in r]))
    weight = np.sqrt(lengths.astype(float))
    want = weight * np.array([histogram[n] for n in lengths.tolist()], float)
    forward = lambda x: weight * np.bincount(line, x[column], len(lengths))
    backward = lambda r: np.add.reduceat((weight * r)[line], np.cumsum(sizes) - sizes)
    v = np.ones(len(rows))
    for _ in range(15):
        v = backward(forward(v))
        v /= np.linalg.norm(v)
    step = 1 / (np.linalg.norm(forward(v)) ** 2 * 1.05)
    x = y = np.zeros(len(rows))
    t, before, left = 1.0, x, 1.0
    for n in range(1, rounds + 1):
        new = np.maximum(0, y - step * backward(forward(y) - want))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / t2 * (new - x), new, t2
        if n % 20 == 0:
            now = float(np.linalg.norm(forward(x) - want) / np.linalg.norm(want))
            if left - now <= close and np.linalg.norm(x - before) <= close * np.linalg.norm(x):
                break
            left, before = now, x
    return x, float(np.linalg.norm(forward(x) - want) / np.linalg.norm(want))


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """[(pattern, repeats)] that uses every length of the histogram exactly as often as it occurs."""
    left = {n: c for n, c in histogram.items() if n > 0 and c > 0}
    if any(n > capacity for n in left):
        raise ValueError("lengths must not exceed the capacity")
    out: list[tuple[tuple[int, ...], int]] = []

    def use(pattern: tuple[int, ...], times: int) -> None:
        need = {n: pattern.count(n) for n in set(pattern)}
        times = min([times, *(left.get(n, 0) // c for n, c in need.items())])
        if times > 0:
            out.append((pattern, times))
            for n, c in need.items():
                left[n] -= c * times
                if not left[n]:
                    del left[n]

    if left:
        rows = patterns(left, capacity, max(PATTERNS, 3 * len(left)))
        x, _ = fit_counts(rows, left)
        for p in np.argsort(-x, kind="stable"):
            use(rows[p], int(x[p] + 1e-9))
    while left:  # best fit first over what is left; each step uses up a length
        lengths = sorted(left)
        stock, pattern, room = dict(left), [], capacity
        while True:
            at = bisect_right(lengths, room) - 1
            while at >= 0 and not stock[lengths[at]]:
                at -= 1
            if at < 0:
                break
            pattern.append(lengths[at])
            stock[lengths[at]] -= 1
            room -= lengths[at]
        use(tuple(pattern), 1 << 62)
    return out


class Slots:
    """Where the r-th text of a length goes."""

    def __init__(self, made: list[tuple[tuple[int, ...], int]], first: int) -> None:
        self.by_length: dict[int, tuple[list[int], list[int], list[int]]] = {}
        base = first
        for pattern, times in made:
            for n in set(pattern):
                ends, bases, each = self.by_length.setdefault(n, ([0], [], []))
                ends.append(ends[-1] + times * pattern.count(n))
                bases.append(base)
                each.append(pattern.count(n))
            base += times
        self.containers = base - first

    def container(self, length: int, rank: int) -> int:
        ends, bases, each = self.by_length[length]
        k = bisect_right(ends, rank) - 1
        return bases[k] + (rank - ends[k]) // each[k]


def pack(counts: DataFrame, capacity: int = 2048) -> DataFrame:
    """(id, piece, start_token, tokens, container) for every row of (id, tokens).

    A text within the capacity is one piece, never divided. A longer one gives whole containers and a rest. Container numbers
    begin at 1 and are dense over the pieces that have tokens; texts without any go to container 0. Repeated ids are separate texts.
    """
    kind = counts.schema["id"].dataType.simpleString()
    pieces = F.expr(f"sequence(0, greatest(0, (tokens - 1) div {capacity}))")
    cut = counts.select("id", "tokens", F.explode(pieces).alias("piece")).select(
        "id", F.col("piece").cast("int").alias("piece"), F.least(F.lit(capacity), F.col("tokens") - F.col("piece") * capacity).cast("int").alias("tokens"), F.spark_partition_id().alias("part")
    )
    cut = cut_lineage(cut)
    per_part = cut_lineage(cut.groupBy("part", "tokens").agg(F.count("*").alias("n")))
    histogram = {r[0]: r[1] for r in per_part.groupBy("tokens").agg(F.sum("n")).collect()}
    slots = Slots(plan({n: c for n, c in histogram.items() if n > 0}, capacity), 1)
    before = per_part.withColumn("before", F.sum("n").over(Window.partitionBy("tokens").orderBy("part")) - F.col("n")).select("part", "tokens", "before")
    within = F.row_number().over(Window.partitionBy("part", "tokens").orderBy("id", "piece")) - 1
    ranked = cut.withColumn("within", within).join(before, ["part", "tokens"]).select("id", "piece", "tokens", (F.col("within") + F.col("before")).alias("rank"))
    shared = counts.sparkSession.sparkContext.broadcast(slots)  # grows with the number of patterns, not of texts

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = shared.value
        for batch in it:
            lengths, ranks = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            where = [mine.container(n, r) if n > 0 else 0 for n, r in zip(lengths, ranks)]
            starts = [p * capacity for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(starts, pa.int32()), batch.column(2), pa.array(where, pa.int64())], names=["id", "piece", "start_token", "tokens", "container"])

    return ranked.mapInArrow(batches, f"id {kind}, piece int, start_token int, tokens int, container bigint")
