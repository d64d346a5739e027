"""Near-duplicate records: anchor-point covering over minimum-hash fingerprints.

A record's fingerprint is a word of symbols over GF(p), p = 2^31 - 1: symbol s names the run of words with the least s-th
hash, so two records agree in a symbol with probability equal to their similarity (shared / united runs). The symbols are
cut into TABLES blocks of length 4, and in each block the anchors are the codewords of the [4, 3] Reed-Solomon code: the values
that a polynomial of degree at most 2 takes at the points 0 to 3. That code has covering radius 1 - any three symbols determine
a codeword - and a fingerprint is replicated to every anchor within it (four, or one where the word is a codeword itself), so
two fingerprints that differ in at most one symbol of a block share an anchor. A pair of similarity 0.7 is missed by a block
with probability 0.348, by all eight with 0.0002; at 0.8 with 0.000001. Two records of similarity 0.1 meet with probability 0.03.

Pairs that meet are first thinned by parities: bit k of a record's parity says whether an odd number of its runs fall into
bucket k. Two records differ in at least as many runs as their parities differ in bits, so a pair whose parities differ in
more bits than the threshold leaves runs to differ can't reach it; no pair is lost. Folded to a few words the parity goes to the
anchors with its record, so that most chance meetings, whose number grows with the square of the records, end where they
occur and are never written. What remains is compared exactly, once. Anchors that many records come to are found on a sample of the records, and
their lists are cut into blocks of about LIST records that are joined block by block, in different tasks. Copies (equal
word sequences) are one class before any of this, so a text repeated in a third of all rows costs one row.

No broadcast grows with the tables beyond PICKED keys, as each passes through the driver; more keys are joined by a shuffle of
narrow rows, and the texts to read again are found by a bitmap of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import wordhash

P = (1 << 31) - 1
BLOCK = 4
TABLES = 8
PARITY = 192
#: Records of one anchor's list that are compared with one another in one task, about.
LIST = 4_000
#: One record in so many is looked at to find the anchors with long lists; at most HOT of them are split, the longest.
SAMPLED = 16
HOT = 20_000
#: Up to so many keys (about 8 MB as the driver holds them) are broadcast to pick rows; more are joined by a shuffle.
PICKED = 100_000
#: Bits of the bitmap by which rows of a wide table are picked (4 MB when full), and of each of its parts.
MARKS = 1 << 25
PART = 1 << 15


def parities(owner: np.ndarray, value: np.ndarray, n_texts: int, bits: int = PARITY) -> np.ndarray:
    """n_texts x bits / 64 longs: of each bucket whether it holds an odd number of the text's distinct runs."""
    held = np.bincount(owner * bits + (wordhash.mix(value) >> np.uint64(32)).astype(np.int64) % bits, minlength=n_texts * bits)
    return np.packbits((held & 1).astype(np.uint8).reshape(n_texts, bits), axis=1).view(np.int64)


def fingerprint(df: DataFrame, id_col: str, text_col: str, order_col: str | None, min_words: int, run: int = 3, bits: int = PARITY, with_runs: bool = False) -> DataFrame:
    """(rid, seen, class, size, symbols, parity), or with_runs (rid, seen, class, size, runs), of each record with at least min_words words.

    class: 16 bytes, equal for equal word sequences; size: number of distinct runs; runs: the low halves of their
    64-bit hashes; symbols: those the anchors are made of; parity: `bits` bits in longs. Null ids yield no row; records with fewer words, or null
    text, have size 0 and no symbols, as a later version of an id replaces an earlier one.
    """
    source = df.select(
        F.col(id_col).cast("string").alias("rid"),
        (F.col(order_col).cast("timestamp") if order_col else F.lit(None).cast("timestamp")).alias("seen"),
        F.col(text_col).cast("string").alias("text"),
    ).where("rid IS NOT NULL")
    n_ints = BLOCK * TABLES

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = wordhash.WordHashes()
        for batch in it:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                lists = [wordhash.words(t) for t in part.column(2).to_pylist()]
                lists = [ws if len(ws) >= min_words else [] for ws in lists]
                hashes, counts = wordhash.flat_hashes(lists, cache)
                owner, value = wordhash.distinct_runs(hashes, counts, run)
                sizes = np.bincount(owner, minlength=len(lists))
                some = sizes > 0
                keys = [xxhash.xxh3_128_digest(hashes[e - n : e].tobytes()) if n else b"" for n, e in zip(counts, np.cumsum(counts))]
                lists_of = lambda each, flat: pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(each)].astype(np.int32)), pa.array(flat))
                if with_runs:
                    more = {"runs": lists_of(sizes, value.astype(np.uint32).view(np.int32))}
                else:
                    symbols = wordhash.min_symbols(owner, value, len(lists), n_ints, P)[some].astype(np.int32)
                    odd = parities(owner, value, len(lists), bits)[some]
                    more = {"symbols": lists_of(some * n_ints, symbols.ravel()), "parity": lists_of(some * odd.shape[1], odd.ravel())}
                columns = {"rid": part.column(0), "seen": part.column(1), "class": pa.array(keys, pa.binary()), "size": pa.array(sizes.astype(np.int32))} | more
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return source.mapInArrow(batches, "rid string, seen timestamp, class binary, size int, " + ("runs array<int>" if with_runs else "symbols array<int>, parity array<bigint>"))


def codewords(block: int) -> list[str]:
    """SQL of the anchors within the covering radius of a block: for each three of its symbols the polynomial through them.

    A polynomial is named by its values at 0, 1 and 2, which Lagrange's formula gives from those at any three points.
    """
    out = []
    for points in ((0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3)):
        values = []
        for x in (0, 1, 2):
            if x in points:
                values.append(f"CAST(symbols[{BLOCK * block + x}] AS BIGINT)")
                continue
            terms = []
            for i in points:
                top, bottom = 1, 1
                for j in points:
                    if j != i:
                        top, bottom = top * (x - j), bottom * (i - j)
                terms.append(f"pmod({top * pow(bottom, -1, P) % P}L * symbols[{BLOCK * block + i}], {P}L)")
            values.append(f"pmod({' + '.join(terms)}, {P}L)")
        out.append(f"xxhash64({block}, {', '.join(values)})")
    return out


def folded(bits: int) -> list[F.Column]:
    """The parity as 1 to 3 words odd_0, ...: word k is the XOR of every such word of it, which is the parity over fewer buckets.

    A record of at most 64 runs has all in odd_0 and 0 in the others; one of so many runs that half of the bits may differ has 0 in all.
    """
    n = bits // 64
    words = max(k for k in (1, 2, 3) if n % k == 0)
    xor = lambda ks: " ^ ".join(f"parity[{k}]" for k in ks)
    return [F.expr(f"CASE WHEN size <= 64 THEN {xor(range(n)) if k == 0 else '0L'} WHEN size > {too_long(words)} THEN 0L ELSE {xor(range(k, n, words))} END").alias(f"odd_{k}") for k in range(words)]


def too_long(words: int) -> int:
    """Runs from which folded parities say little: at 0.7 about 1.4 times the bits."""
    return 90 * words


def folded_may_reach(threshold: float, words: int) -> F.Column:
    """As may_reach(), over folded parities of x and y: both in full where both have all words, else all of both folded to one word."""
    one = " ^ ".join(f"{n}.odd_{k}" for n in "xy" for k in range(words))
    full = " + ".join(f"bit_count(x.odd_{k} ^ y.odd_{k})" for k in range(words))
    differ = F.expr(f"CASE WHEN least(x.size, y.size) <= 64 THEN bit_count({one}) ELSE {full} END")
    return (F.greatest("x.size", "y.size") > too_long(words)) | (differ <= allowed(threshold, F.col("x.size"), F.col("y.size")))


def anchors(reps: DataFrame, tables: int = TABLES, keep: Sequence[F.Column] = ()) -> DataFrame:
    """(anchor, node, size, *keep): each record under every anchor within the covering radius of its blocks."""
    lines = [F.expr(x) for t in range(tables) for x in codewords(t)]
    return reps.select("node", "size", *keep, F.explode(F.array_distinct(F.array(*lines))).alias("anchor"))


def met(keyed: DataFrame, threshold: float, length: int = LIST) -> DataFrame:
    """(a, b), a < b: nodes that share an anchor and whose sizes, and folded parities where keyed has them, leave the threshold possible."""
    seen = keyed.where(F.pmod(F.xxhash64("node", F.lit("sample")), F.lit(SAMPLED)) == 0)
    counted = seen.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") >= max(2, length // SAMPLED))
    hot = cut_lineage(counted.orderBy(F.desc("n"), "anchor").limit(HOT).select("anchor", F.ceil(F.col("n") * SAMPLED / length).cast("int").alias("parts")))
    near = (F.col("x.node") < F.col("y.node")) & (F.least("x.size", "y.size") >= F.greatest("x.size", "y.size") * F.lit(threshold - 1e-9))
    odd = [c for c in keyed.columns if c.startswith("odd_")]
    if odd:
        near &= folded_may_reach(threshold, len(odd))
    take = (F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    short = keyed.join(F.broadcast(hot.select("anchor")), "anchor", "left_anti")  # at most HOT rows
    pairs = short.alias("x").join(short.alias("y"), F.col("x.anchor") == F.col("y.anchor")).where(near).select(*take)
    if not hot.isEmpty():
        long = keyed.join(F.broadcast(hot), "anchor").withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        left = long.select("anchor", "node", "size", *odd, F.col("own").alias("i"), every.alias("j"))
        right = long.select("anchor", "node", "size", *odd, F.col("own").alias("j"), every.alias("i"))
        on = (F.col("x.anchor") == F.col("y.anchor")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j"))
        pairs = pairs.union(left.alias("x").join(right.alias("y"), on).where(near).select(*take))
    return pairs.distinct()


def allowed(threshold: float, size_a: F.Column, size_b: F.Column) -> F.Column:
    """How many runs two records may differ in: reaching the threshold leaves (1 - t) / (1 + t) of both sizes."""
    return (size_a + size_b) * F.lit((1 - threshold) / (1 + threshold) + 1e-9)


def may_reach(threshold: float, bits: int = PARITY) -> F.Column:
    """False only for pairs below the threshold, as every odd bit is a difference."""
    differ = " + ".join(f"bit_count(parity_a[{k}] ^ parity_b[{k}])" for k in range(bits // 64))
    return F.expr(differ) <= allowed(threshold, F.col("size_a"), F.col("size_b"))


def pick(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """The rows of df whose `on` is among keys (distinct, materialised), with the columns of keys. df is narrow: beyond PICKED keys it is shuffled."""
    return df.join(F.broadcast(keys) if keys.count() <= PICKED else keys, on)


def may_be_among(df: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """All rows of df whose id is among ids (one string column), and a few others: those whose hash is marked in a bitmap.

    The bitmap takes the same room however many ids there are; the more of them, the more other rows stay.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(MARKS))
    marks = ids.select(place(F.col(ids.columns[0])).alias("p")).groupBy(F.expr(f"p div {PART}").alias("_part")).agg(F.bitmap_construct_agg(F.expr(f"p % {PART}")).alias("_marks"))
    placed = df.withColumn("_p", place(F.col(id_col).cast("string"))).withColumn("_part", F.expr(f"_p div {PART}"))
    byte = f"CAST(conv(hex(substring(_marks, CAST(_p % {PART} div 8 AS INT) + 1, 1)), 16, 10) AS INT)"
    return placed.join(F.broadcast(marks), "_part").where(f"shiftright({byte}, CAST(_p % 8 AS INT)) & 1 = 1").drop("_p", "_part", "_marks")


def near_pairs(df: DataFrame, id_col: str, text_col: str, order_col: str | None = None, threshold: float = 0.7, min_words: int = 30, run: int = 3, bits: int = PARITY) -> tuple[DataFrame, DataFrame]:
    """(pairs between classes with their similarity, membership of records in classes).

    Of several rows under one id the latest (then the greatest class) counts. The exact comparison is by run hashes; a class
    pair is compared once however many anchors it shares. Runs aren't kept from the first reading, as only the few
    classes that may have a partner need them: one record of each is read again.

    bits: the longer the texts, the more are needed for the parities to tell them apart; the result doesn't depend on it.
    """
    marked = cut_lineage(fingerprint(df, id_col, text_col, order_col, min_words, run, bits))
    latest = marked.groupBy("rid").agg(F.max(F.struct("seen", "class", "size")).alias("m"))
    members = cut_lineage(latest.where("m.size > 0").select("rid", F.col("m.class").alias("class")))
    # one row per class, numbered where it lies
    reps = cut_lineage(marked.where("size > 0").groupBy("class").agg(F.first("size").alias("size"), F.first("symbols").alias("symbols"), F.first("parity").alias("parity"), F.min("rid").alias("rid")))
    reps = reps.withColumn("node", F.monotonically_increasing_id())
    least = float(threshold)
    found = cut_lineage(met(anchors(reps, keep=folded(bits)), least))
    nodes = cut_lineage(found.select(F.col("a").alias("node")).union(found.select("b")).distinct())
    odd = pick(reps.select("node", "size", "parity"), nodes, "node")
    each = lambda n: odd.select(F.col("node").alias(n), F.col("size").alias(f"size_{n}"), F.col("parity").alias(f"parity_{n}"))
    found = cut_lineage(found.join(each("a"), "a").join(each("b"), "b").where(may_reach(least, bits)).select("a", "b"))
    nodes = cut_lineage(found.select(F.col("a").alias("node")).union(found.select("b")).distinct())
    involved = cut_lineage(pick(reps.select("node", "class", "rid"), nodes, "node"))
    rids = involved.select("rid")
    again = may_be_among(df, id_col, rids)
    read = fingerprint(again, id_col, text_col, order_col, min_words, run, with_runs=True).where("size > 0")
    sets = cut_lineage(pick(read.groupBy("class").agg(F.first("runs").alias("runs")), involved.select("node", "class"), "class"))
    side = lambda n: sets.select(F.col("node").alias(n), F.col("class").alias(f"class_{n}"), F.col("runs").alias(f"runs_{n}"))
    both = found.join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.array_intersect("runs_a", "runs_b"))
    pairs = (
        both.withColumn("shared", shared)
        .withColumn("similarity", F.col("shared") / (F.size("runs_a") + F.size("runs_b") - F.col("shared")))
        .where(F.col("similarity") >= least)
        .select(F.least("class_a", "class_b").alias("class_a"), F.greatest("class_a", "class_b").alias("class_b"), "similarity")
    )
    return cut_lineage(pairs), members


def expand(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(record_a, record_b), record_a < record_b: all records of linked classes, and the copies within a class.

    The members of a large class are cut into parts of about LIST, each joined in its own task.
    """
    sizes = members.groupBy("class").agg(F.count("*").alias("n"))
    copied = cut_lineage(sizes.where("n > 1"))
    spread = pairs.select("class_a", "class_b").union(copied.select("class", "class"))
    wanted = cut_lineage(spread.select(F.col("class_a").alias("class")).union(spread.select("class_b")).distinct().join(copied, "class", "left").select("class", F.ceil(F.coalesce("n", F.lit(1)) / LIST).cast("int").alias("parts")))
    kept = cut_lineage(pick(members, wanted, "class").withColumn("part", F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int")))
    a = kept.select(F.col("class").alias("class_a"), F.col("part").alias("part_a"), F.col("rid").alias("x"))
    b = kept.select(F.col("class").alias("class_b"), F.col("part").alias("part_b"), F.col("rid").alias("y"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(f"n_{n}") - 1)).alias(f"part_{n}")
    for n in "ab":
        spread = spread.join(wanted.select(F.col("class").alias(f"class_{n}"), F.col("parts").alias(f"n_{n}")), f"class_{n}")
    spread = spread.select("class_a", "class_b", every("a"), "n_b").select("class_a", "class_b", "part_a", every("b"))
    full = spread.join(a, ["class_a", "part_a"]).join(b, ["class_b", "part_b"]).where("x <> y")
    return full.select(F.least("x", "y").alias("record_a"), F.greatest("x", "y").alias("record_b")).distinct()


def groups(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(rid, group, links): connected components over class pairs by alternating label propagation and pointer jumping.

    Every round is a join and an aggregation, and is checkpointed; it goes on until no label changes. group is the least class
    id in hex, links the number of other classes within the threshold.
    """
    edges = cut_lineage(pairs.select("class_a", "class_b").union(pairs.select("class_b", "class_a")).toDF("u", "v"))
    label = edges.select(F.col("u").alias("n")).distinct().withColumn("l", F.col("n"))
    moving = True
    while moving:
        least = edges.join(label.select(F.col("n").alias("v"), "l"), "v").groupBy("u").agg(F.min("l").alias("m"))
        step = label.join(least, label.n == least.u).select("n", F.least("l", "m").alias("l"), F.col("l").alias("old"))
        jump = step.join(step.select(F.col("n").alias("l"), F.col("l").alias("ll")), "l", "left").select("n", F.coalesce("ll", "l").alias("l"), "old")
        jump = cut_lineage(jump)
        label = jump.select("n", "l")
        moving = not jump.where("l <> old").isEmpty()
    links = edges.groupBy(F.col("u").alias("class")).agg(F.count("*").alias("links"))
    return (
        members.join(label.withColumnRenamed("n", "class"), "class", "left").join(links, "class", "left")
        .select("rid", F.hex(F.coalesce("l", "class")).alias("group"), F.coalesce("links", F.lit(0)).alias("links"))
    )


def near_duplicates(df: DataFrame, id_col: str, text_col: str, order_col: str | None = None, threshold: float = 0.7, min_words: int = 30, bits: int = PARITY) -> DataFrame:
    """All pairs (record_a, record_b) of records with at least min_words words whose word-triple sets reach the threshold."""
    return expand(*near_pairs(df, id_col, text_col, order_col, threshold, min_words, 3, bits))
