"""Most similar vectors of every vector: a robust-pruned directed graph per shard, searched by beam.

Vectors of one direction are one class (their cosines to anything else are the same, and ties go to smaller ids, so the
k + 1 smallest ids of a class stand for it exactly). A router fitted on a bounded sample sends every class to its shard and its
queries to the PROBES nearest ones. Inside a shard greedy searches propose neighbours, relaxed distance pruning (factor ALPHA)
keeps diverse edges with their reverse ones, and a beam search answers each query. A shard's graph is built once, stored, and read
by all blocks of queries. Searches and pruning walk over vectors projected to WALK principal directions of the sample, many of them a step at a time;
the cosines of what a search ends with are exact.

Nothing is exact about which neighbours a search meets: recall is measured against brute force (tests, README). BEAM and PROBES
are parameters of `nearest`; with probes and beam as large as shards and their members the search is exhaustive.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .sampling import least_hashed

SAMPLE = 8_192
SHARD = 1_500
PIVOTS = 1_024
PROBES = 2
DEGREE = 16
BEAM = 24
ALPHA = 1.2
WALK = 32
#: Part of a shard's vectors at which a search may begin: it begins at the nearest of them.
ENTERED = 0.1


def usable(df: DataFrame, id_col: str, vector_col: str, size: int) -> DataFrame:
    """(id, vector, class) of the vectors of exactly `size` finite numbers that are not all zero; each id once.

    Null ids, null vectors and vectors that hold a null count as unusable.
    """
    source = df.where(F.col(id_col).isNotNull() & (F.size(vector_col) == size)).select(F.col(id_col).cast("string").alias("id"), F.col(vector_col).cast("array<float>").alias("vector"))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            lists = batch.column(1)
            flat = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.float32).reshape(-1, size)
            norm = np.sqrt((flat.astype(np.float64) ** 2).sum(1))
            good = np.isfinite(norm) & (norm > 0)
            unit = np.round(flat[good] / norm[good, None] * 1e6).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pa.array(good)), pa.array([v.tobytes() for v in flat[good]], pa.binary()), pa.array([xxhash.xxh3_128_digest(u.tobytes()) for u in unit], pa.binary())],
                names=["id", "vector", "class"],
            )

    return source.mapInArrow(batches, "id string, vector binary, class binary").groupBy("id").agg(F.max(F.struct("class", "vector")).alias("m")).select("id", "m.class", "m.vector")


def means(sample: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """k-means by inner product over unit vectors, or by distance over others; empty centres keep their place."""
    centres = sample[:: max(1, len(sample) // count)][:count].copy()
    for _ in range(rounds):
        near = (sample @ centres.T - 0.5 * (centres**2).sum(1)).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        n = np.bincount(near, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


class Router:
    """Cells of about SHARD vectors: a pivot, and where pivots are too few for the table, one of `finer` cells of what is left
    of the vector beyond its pivot. Both are fitted on the sample, and both are of bounded size however large the table is."""

    def __init__(self, sample: np.ndarray, total: int, shard: int = SHARD, pivots: int = PIVOTS) -> None:
        wanted = max(1, -(-total // shard))
        self.pivots = means(sample, max(1, min(pivots, len(sample) // 8, wanted)))
        self.finer = min(pivots, -(-wanted // len(self.pivots)))
        left = sample - self.pivots[self.near(sample, 1)[:, 0]]
        self.rest = means(left, self.finer) if self.finer > 1 else np.zeros((1, sample.shape[1]), np.float32)
        centred = sample - sample.mean(0)
        self.axes = np.linalg.eigh(centred.T @ centred)[1][:, ::-1][:, :WALK].astype(np.float32)

    def near(self, unit: np.ndarray, probes: int) -> np.ndarray:
        return np.argsort(-(unit @ self.pivots.T - 0.5 * (self.pivots**2).sum(1)), 1, kind="stable")[:, :probes]

    def cells(self, unit: np.ndarray, probes: int) -> np.ndarray:
        """The nearest cells of each vector, its own first."""
        found = self.near(unit, probes)
        out = np.zeros(found.shape, np.int64)
        for k in range(found.shape[1]):
            left = unit - self.pivots[found[:, k]]
            out[:, k] = found[:, k] * self.finer + (left @ self.rest.T - 0.5 * (self.rest**2).sum(1)).argmax(1)
        return out


def beam_search(vectors: np.ndarray, graph: np.ndarray, entries: np.ndarray, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, distances) of the best `beam` found per query, best first; -1 where fewer. graph: neighbours, -1 padded. It ends when every kept point has been expanded."""
    n, b, r = len(vectors), len(queries), graph.shape[1]
    square = (vectors**2).sum(1)
    sims = queries @ vectors[entries].T - 0.5 * square[entries]
    order = np.argsort(-sims, 1, kind="stable")[:, :beam]
    ids = np.full((b, beam), -1, np.int64)
    val = np.full((b, beam), -np.inf, np.float32)
    ids[:, : order.shape[1]] = entries[order]
    val[:, : order.shape[1]] = np.take_along_axis(sims, order, 1)
    seen = np.zeros((b, n + 1), bool)
    seen[:, entries] = True
    seen[:, n] = True  # stands for no neighbour
    done = ids < 0
    links = np.where(graph < 0, n, graph)
    active = np.arange(b)
    while len(active):
        open_ = np.where(done[active], -np.inf, val[active])
        best = open_.argmax(1)
        live = ~done[active, best]
        active, best = active[live], best[live]
        if not len(active):
            break
        done[active, best] = True
        next_ = links[ids[active, best]]
        fresh = ~seen[active[:, None], next_]
        who, col = np.nonzero(fresh)
        to = next_[who, col]
        seen[active[who], to] = True
        got = np.full((len(active), r), -np.inf, np.float32)
        got[who, col] = np.einsum("ij,ij->i", queries[active[who]], vectors[to]) - 0.5 * square[to]
        better = (got > val[active].min(1)[:, None]).any(1)
        if not better.any():
            continue
        rows = active[better]
        all_val = np.concatenate([val[rows], got[better]], 1)
        all_ids = np.concatenate([ids[rows], next_[better]], 1)
        all_done = np.concatenate([done[rows], np.zeros((len(rows), r), bool)], 1)
        keep = np.argpartition(-all_val, beam - 1, 1)[:, :beam]
        val[rows] = np.take_along_axis(all_val, keep, 1)
        ids[rows] = np.take_along_axis(all_ids, keep, 1)
        done[rows] = np.take_along_axis(all_done, keep, 1) | ~np.isfinite(val[rows])
    order = np.argsort(-val, 1, kind="stable")
    return np.take_along_axis(np.where(np.isfinite(val), ids, -1), order, 1), np.take_along_axis(val, order, 1)


def prune(vectors: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Edges of many points at once: each one's candidates (a row, -1 padded), nearest first, without those that a kept one is
    nearer to by the factor alpha (on squared distances); at most `degree`, -1 padded."""
    c = np.sort(np.where(candidates == points[:, None], -1, candidates), 1)
    c[:, 1:][c[:, 1:] == c[:, :-1]] = -1
    there = vectors[c]
    square = (vectors**2).sum(1)
    far = square[points][:, None] + square[c] - 2 * np.einsum("bd,bcd->bc", vectors[points], there)
    far = np.where(c < 0, np.inf, np.maximum(far, 0))
    order = np.argsort(far, 1, kind="stable")[:, : 3 * degree]
    c, far = np.take_along_axis(c, order, 1), np.take_along_axis(far, order, 1)
    there = np.take_along_axis(there, order[:, :, None], 1)
    between = square[c][:, :, None] + square[c][:, None, :] - 2 * there @ there.transpose(0, 2, 1)
    alive = np.isfinite(far)
    out = np.full((len(points), degree), -1, np.int64)
    count = np.zeros(len(points), np.int64)
    for i in range(c.shape[1]):
        take = np.flatnonzero(alive[:, i] & (count < degree))
        if len(take):
            out[take, count[take]] = c[take, i]
            count[take] += 1
            alive[take] &= ~(alpha * between[take, i] <= far[take])
    return out


def build(vectors: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, block: int = 512, entered: float = ENTERED) -> tuple[np.ndarray, np.ndarray]:
    """(graph, entry points): two rounds of search and pruning from a random graph, the same for equal input."""
    n = len(vectors)
    rng = np.random.default_rng(n)
    graph = rng.integers(0, n, (n, degree)).astype(np.int64) if n > 1 else np.full((n, degree), -1, np.int64)
    entries = np.sort(rng.permutation(n)[: max(1, int(n * entered))])
    for factor in (1.0, alpha):
        for at in range(0, n, block):
            points = np.arange(at, min(n, at + block))
            found, _ = beam_search(vectors, graph, entries, vectors[points], beam)
            graph[points] = prune(vectors, points, np.concatenate([found, graph[points]], 1), degree, factor)
            # reverse edges: what points at a point joins its edges, and they are pruned again where they are too many
            to = graph[points].ravel()
            source = np.repeat(points, degree)[to >= 0]
            to = to[to >= 0]
            order = np.argsort(to, kind="stable")
            to, source = to[order], source[order]
            ends, first, counts = np.unique(to, return_index=True, return_counts=True)
            wide = np.full((len(ends), int(counts.max()) if len(counts) else 0), -1, np.int64)
            wide[np.repeat(np.arange(len(ends)), counts), np.arange(len(to)) - np.repeat(first, counts)] = source
            graph[ends] = prune(vectors, ends, np.concatenate([graph[ends], wide], 1), degree, factor)
    return graph, entries


def pack(vectors: np.ndarray, keys: list[bytes], axes: np.ndarray) -> dict[str, bytes]:
    """A shard as stored: its vectors, class keys, graph and entry points."""
    graph, entries = build(_unit(vectors)[0] @ axes)
    return {"keys": b"".join(keys), "vectors": vectors.tobytes(), "graph": graph.astype(np.int32).tobytes(), "entries": entries.astype(np.int32).tobytes()}


def _unit(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norm = np.sqrt((flat.astype(np.float64) ** 2).sum(1))
    return (flat / norm[:, None]).astype(np.float32), norm


def nearest(df: DataFrame, id_col: str, vector_col: str, size: int = 384, k: int = 5, least: float = 0.8, beam: int = BEAM, probes: int = PROBES, shard: int = SHARD, pivots: int = PIVOTS) -> DataFrame:
    """(id, neighbour, cosine): up to k others of highest cosine (rounded to 6 decimals; ties to the smaller id), at least `least`.

    An empty table gives an empty result.
    """
    spark = df.sparkSession
    rows = cut_lineage(usable(df, id_col, vector_col, size))
    ranked = Window.partitionBy("class").orderBy("id")
    first = rows.select("class", "id").withColumn("n", F.row_number().over(ranked)).where(F.col("n") <= k + 1).select("class", "id")
    reps = cut_lineage(rows.groupBy("class").agg(F.min_by("vector", "id").alias("vector")))
    total = reps.count()
    if not total:
        return first.select("id", F.col("id").alias("neighbour"), F.lit(1.0).alias("cosine")).where("false")
    drawn = least_hashed(reps.select("class", "vector"), "class", SAMPLE).select("vector").toArrow().column(0)
    sample = _unit(np.frombuffer(b"".join(drawn.to_pylist()), np.float32).reshape(-1, size))[0]
    router = spark.sparkContext.broadcast(Router(sample, total, shard, pivots))  # at most 2 x PIVOTS x size floats, 3 MB

    def route(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows:
                flat = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float32).reshape(-1, size)
                cells = router.value.cells(_unit(flat)[0], probes)
                for probe in range(cells.shape[1]):
                    yield pa.RecordBatch.from_arrays([pa.array(cells[:, probe]), pa.array(np.full(batch.num_rows, probe == 0)), batch.column(0), batch.column(1)], names=["cell", "home", "class", "vector"])

    routed = cut_lineage(reps.select("class", "vector").mapInArrow(route, "cell bigint, home boolean, class binary, vector binary"))
    # a cell that draws more than two shards' worth is split, its index and its queries alike; each part is a group of bounded size
    load = routed.groupBy("cell").agg(F.sum(F.col("home").cast("int")).alias("held"), F.count("*").alias("asking")).where("held > 0")
    parts = cut_lineage(load.select("cell", F.ceil(F.col("held") / (2 * shard)).cast("int").alias("shards"), F.ceil(F.col("asking") / (4 * shard)).cast("int").alias("blocks")))
    n_shards, n_groups = parts.agg(F.sum("shards"), F.sum(F.col("shards") * F.col("blocks"))).first()
    # a row per cell, and there are at most PIVOTS x PIVOTS of them: 20 MB
    salted = routed.join(F.broadcast(parts), "cell").withColumn("salt", F.pmod(F.xxhash64("class"), F.lit(1 << 30)).cast("int"))

    def index(table: pa.Table) -> pa.Table:
        keys = table.column("class").to_pylist()
        order = sorted(range(len(keys)), key=keys.__getitem__)
        flat = np.frombuffer(b"".join(table.column("vector").to_pylist()), np.float32).reshape(-1, size)[order]
        made = pack(flat, [keys[i] for i in order], router.value.axes)
        return pa.table({"cell": table.column("cell").slice(0, 1), "shard": table.column("shard").slice(0, 1), "blocks": table.column("blocks").slice(0, 1), **{n: pa.array([v], pa.binary()) for n, v in made.items()}})

    def answer(stored: pa.Table, asking: pa.Table) -> pa.Table:
        out: list[tuple[bytes, bytes, float]] = []
        if stored.num_rows and asking.num_rows:
            flat = np.frombuffer(stored.column("vectors")[0].as_py(), np.float32).reshape(-1, size)
            blob = stored.column("keys")[0].as_py()
            keys = [blob[i : i + 16] for i in range(0, len(blob), 16)]
            graph = np.frombuffer(stored.column("graph")[0].as_py(), np.int32).reshape(len(keys), -1).astype(np.int64)
            entries = np.frombuffer(stored.column("entries")[0].as_py(), np.int32).astype(np.int64)
            asked = np.frombuffer(b"".join(asking.column("vector").to_pylist()), np.float32).reshape(-1, size)
            names = asking.column("class").to_pylist()
            unit, norm = _unit(flat)
            mine, mine_norm = _unit(asked)
            axes = router.value.axes
            walk, start = unit @ axes, mine @ axes
            for at in range(0, len(asked), 512):
                ids, _ = beam_search(walk, graph, entries, start[at : at + 512], beam)
                sims = np.einsum("bd,bkd->bk", mine[at : at + 512], unit[ids])
                row, col = np.nonzero((ids >= 0) & (sims >= least - 1e-4))
                a, b = at + row, ids[row, col]
                exact = np.round((asked[a].astype(np.float64) * flat[b].astype(np.float64)).sum(1) / mine_norm[a] / norm[b], 6)
                out += [(names[x], keys[y], c) for x, y, c in zip(a, b, exact.tolist()) if names[x] != keys[y] and c >= least]
        cols = list(zip(*out)) if out else [[]] * 3
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.binary(), pa.float64()))], names=["class", "other", "cosine"])

    spread = lambda n, keys: (min(20_000, max(4, 3 * int(n))), *keys)  # noqa: E731  few groups a task, so that tasks are alike
    held = salted.where("home").select("cell", (F.col("salt") % F.col("shards")).alias("shard"), "blocks", "class", "vector").repartition(*spread(n_shards, ("cell", "shard")))
    graphs = cut_lineage(held.groupBy("cell", "shard").applyInArrow(index, "cell bigint, shard int, blocks int, keys binary, vectors binary, graph binary, entries binary"))
    graphs = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).repartition(*spread(n_groups, ("cell", "shard", "block")))
    asks = salted.select("cell", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), (F.col("salt") % F.col("blocks")).alias("block"), "class", "vector").repartition(*spread(n_groups, ("cell", "shard", "block")))
    near = graphs.groupBy("cell", "shard", "block").cogroup(asks.groupBy("cell", "shard", "block")).applyInArrow(answer, "class binary, other binary, cosine double")
    near = cut_lineage(near)
    # classes beyond the (k + 1)-th cosine can't reach any of the first k; those that tie with it are kept
    close = near.distinct().withColumn("n", F.rank().over(Window.partitionBy("class").orderBy(F.desc("cosine")))).where(F.col("n") <= k + 1).drop("n")
    same = first.select("class", F.col("class").alias("other"), F.lit(1.0).alias("cosine")).distinct()
    options = close.union(same).join(first.select(F.col("class").alias("other"), F.col("id").alias("neighbour")), "other").select("class", "neighbour", "cosine")
    order = Window.partitionBy("class").orderBy(F.desc("cosine"), "neighbour")
    short = options.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).select("class", "neighbour", "cosine")
    each = rows.select("id", "class").join(short, "class").where("id <> neighbour")
    top = Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour")
    return each.withColumn("n", F.row_number().over(top)).where(F.col("n") <= k).select("id", "neighbour", "cosine")


def pairs(found: DataFrame) -> DataFrame:
    """The distinct pairs (id_a, id_b), id_a < id_b, found from either side."""
    return found.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
