"""Places where a user's own models and parsers join in; all are off unless given."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Entities = Iterable[dict]
EntityHook = Callable[[str], Entities]
RelationHook = Callable[[list[str], str], Iterable[dict]]

_ENTITY = pa.list_(pa.struct([("text", pa.string()), ("label", pa.string()), ("confidence", pa.float64())]))
_RELATION = pa.list_(pa.struct([("source", pa.string()), ("target", pa.string()), ("relation", pa.string()), ("confidence", pa.float64())]))


def hooked_entities(docs: DataFrame, id_col: str, text_col: str, make: Callable[[], EntityHook] | None, source: str, confidence: float, least: int = 0) -> DataFrame:
    """(document_id, text, label, confidence, source): what a user's function finds in texts of at least `least` characters.

    make runs once per task and gives the function, so that a model is loaded once. A text on which the function fails gives
    nothing; None as make gives an empty table. Entities without a text are left out; without a label they are ENTITY.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("document_id"), F.col(text_col).cast("string").alias("_text"))
    if make is None:
        rows = rows.where("false")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = make() if make else (lambda t: ())
        for batch in it:
            out = []
            for t in batch.column(1).to_pylist():
                try:
                    got = list(find(t)) if t and len(t.strip()) >= max(least, 1) else []
                    out.append([{"text": str(e["text"]), "label": str(e.get("label") or "ENTITY").upper(), "confidence": float(e.get("confidence") or confidence)} for e in got if e.get("text")])
                except Exception:  # noqa: BLE001 - a hook's failure on one text doesn't end the job
                    out.append([])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, _ENTITY)], names=["document_id", "found"])

    found = rows.mapInArrow(batches, "document_id string, found array<struct<text:string,label:string,confidence:double>>")
    return found.select("document_id", F.explode("found").alias("e")).select("document_id", "e.*", F.lit(source).alias("source"))


def hooked_relations(docs: DataFrame, id_col: str, text_col: str, names_col: str, make: Callable[[], RelationHook] | None) -> DataFrame:
    """(document_id, source, target, relation, confidence): what a user's function finds between a text's entities, of which there must be two."""
    rows = docs.select(F.col(id_col).cast("string").alias("document_id"), F.col(text_col).cast("string").alias("_text"), F.col(names_col).cast("array<string>").alias("_names"))
    rows = rows.where(F.size("_names") >= 2) if make else rows.where("false")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = make() if make else (lambda names, t: ())
        for batch in it:
            out = []
            for t, names in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                try:
                    out.append([{"source": str(r["source"]), "target": str(r["target"]), "relation": str(r.get("relation") or "RELATED_TO").upper(), "confidence": float(r.get("confidence") or 0.7)} for r in find(names, t or "")])
                except Exception:  # noqa: BLE001
                    out.append([])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, _RELATION)], names=["document_id", "found"])

    found = rows.mapInArrow(batches, "document_id string, found array<struct<source:string,target:string,relation:string,confidence:double>>")
    return found.select("document_id", F.explode("found").alias("r")).select("document_id", "r.*")


def scanned(files: DataFrame, content_col: str, make: Callable[[], Callable[[bytes], str | None]] | None, fail_open: bool = True) -> DataFrame:
    """files with `threat`: what a user's scanner names, null for clean ones and where there is no scanner. Where the scanner fails, null
    if fail_open, else "scan failed"."""
    if make is None:
        return files.withColumn("threat", F.lit(None).cast("string"))

    def check(content):
        import pandas as pd

        scan = make()
        out = []
        for c in content:
            try:
                out.append(scan(c) if c is not None else None)
            except Exception:  # noqa: BLE001
                out.append(None if fail_open else "scan failed")
        return pd.Series(out, dtype=object)

    return files.withColumn("threat", F.pandas_udf(check, "string")(content_col))


#: A user's parsers by file extension: each turns a table of files of that extension into one with `parsed`.
PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_parser(extension: str, parse: Callable[[DataFrame], DataFrame]) -> None:
    PARSERS[extension.lower().lstrip(".")] = parse
