"""Oversized items cut at natural boundaries: recursive separator hierarchy, greedy packing, trailing overlap.

A piece never exceeds the limit. An item is split by section, then paragraph, sentence and word; a stretch without any
boundary that is longer than the limit is cut by character. Consecutive pieces share exactly `overlap` code points, fewer
only where a single stretch would otherwise not fit, or where the piece itself is shorter. Only oversized items reach Python.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The blanks and closing marks that make a natural boundary.
BLANKS = " \t\r\n"
MARKS = "。！？；，、"

#: Patterns whose match ends are the boundaries of a level, coarsest first. Sections begin at a heading.
LEVELS = (
    ("section", re.compile(r"\n(?=#{1,6} )")),
    ("paragraph", re.compile(r"\n[ \t\r]*\n\s*")),
    ("sentence", re.compile(r"[.!?][\"')\]]*\s+|[。！？]|\n")),
    ("word", re.compile(rf"[{BLANKS}]|[{MARKS}]")),
)
CHARACTER = len(LEVELS)


def _atoms(text: str, start: int, end: int, level: int, room: int, limit: int, out: list[tuple[int, int]]) -> None:
    """Spans that cover [start, end): each at most `room` long, or at most `limit` and without a boundary, or longer than that."""
    if end - start <= room or level == CHARACTER:
        out.append((start, end))
        return
    at = start
    for m in LEVELS[level][1].finditer(text, start, end):
        # blanks stand alone at word level, so that a stretch is measured without them
        if level == CHARACTER - 1 and m.group() in BLANKS and at < m.start():
            _atoms(text, at, m.start(), level + 1, room, limit, out)
            at = m.start()
        if m.end() > at:
            _atoms(text, at, m.end(), level + 1, room, limit, out)
            at = m.end()
    if at < end:
        _atoms(text, at, end, level + 1, room, limit, out)


def cut(text: str, limit: int, overlap: int) -> list[tuple[int, int, bool]]:
    """(start, end, forced) of each piece in order; forced: the piece ends inside a stretch without a boundary.

    Text within the limit, also the empty one, is one piece. overlap must be less than the limit.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than the limit")
    if len(text) <= limit:
        return [(0, len(text), False)]
    atoms: list[tuple[int, int]] = []
    _atoms(text, 0, len(text), 0, limit - overlap, limit, atoms)
    pieces: list[tuple[int, int, bool]] = []
    start, end = 0, 0
    for a, b in atoms:
        while b - start > limit:
            if b - a <= limit:
                if end > start and end == a and end > (pieces[-1][1] if pieces else 0):
                    pieces.append((start, end, False))
                start = max(start + 1 if end <= start else start, a - min(overlap, limit - (b - a)))
            else:
                if end > start and end == a and end > (pieces[-1][1] if pieces else 0) and a - start > overlap:
                    pieces.append((start, end, False))
                    start = a - overlap
                at = start + limit
                pieces.append((start, at, True))
                start, a, end = at - overlap, at, at
                if b - a <= 0:
                    break
        end = b
    pieces.append((start, len(text), False))
    return pieces


def split_items(df: DataFrame, id_col: str, text_col: str, limit: int, overlap: int = 150, with_text: bool = True) -> DataFrame:
    """(record_id, piece_no, start_pos, end_pos, forced[, piece]) for every item longer than the limit once blanks are stripped.

    Positions count code points of the stripped item. Null ids and null, empty or short texts yield no row; equal rows yield
    equal pieces, one set each.
    """
    item = df.select(F.col(id_col).cast("string").alias("record_id"), F.regexp_replace(F.col(text_col).cast("string"), r"^[ \t\r\n]+|[ \t\r\n]+\z", "").alias("text"))
    big = item.where(F.col("record_id").isNotNull() & (F.length("text") > limit))
    schema = "record_id string, piece_no int, start_pos int, end_pos int, forced boolean" + ", piece string" * with_text

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for at in range(0, batch.num_rows, 256):
                rows = [
                    (rid, k, a, b, forced, text[a:b])
                    for rid, text in zip(batch.column(0).slice(at, 256).to_pylist(), batch.column(1).slice(at, 256).to_pylist())
                    for k, (a, b, forced) in enumerate(cut(text, limit, overlap))
                ]
                cols = list(zip(*rows)) if rows else [[]] * 6
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.string())
                n = 5 + with_text
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols[:n], kinds)], names=["record_id", "piece_no", "start_pos", "end_pos", "forced", "piece"][:n])

    return big.mapInArrow(batches, schema)
