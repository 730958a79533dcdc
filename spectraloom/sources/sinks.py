"""Sinks: JSON lines, CSV, summaries, several outputs of one table, and atomic replacement of an output folder."""

from __future__ import annotations

import json
import os
import shutil
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_json_lines(df: DataFrame, path: str, sort_keys: bool = False) -> None:
    """One JSON object per line, null fields kept; columns by name with ``sort_keys``."""
    (df.select(*sorted(df.columns)) if sort_keys else df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """CSV with a header; null is an empty field, arrays are joined by "|"."""
    wanted = columns or sorted(df.columns)
    types = dict(df.dtypes)
    df.select(*[F.array_join(F.col(c).cast("array<string>"), "|").alias(c) if types[c].startswith("array") else F.col(c) for c in wanted]).write.mode("overwrite").csv(path, header=True)


def write_summary(df: DataFrame, path: str) -> dict:
    """The single row of ``df`` as a pretty JSON object; more rows are an error, since they'd be gathered here."""
    rows = df.limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a summary is one row")
    out = rows[0].asDict(recursive=True)
    Path(path).write_text(json.dumps(out, indent=2, sort_keys=True, ensure_ascii=False, default=str) + "\n", encoding="utf-8")
    return out


def fan_out(df: DataFrame, outputs: Mapping[str, Column | None], root: str) -> None:
    """One table to several Parquet outputs by condition; the rows are computed once and spilled to disk in between."""
    kept = df.persist()
    try:
        for name, condition in outputs.items():
            (kept if condition is None else kept.where(condition)).write.mode("overwrite").parquet(f"{root}/{name}")
    finally:
        kept.unpersist()


def replace_folder(staged: str, target: str) -> None:
    """Puts a finished local folder in the place of another: the old one goes only when the new one is complete.

    Refuses roots, homes and folders that hold the staged one.
    """
    new, old = Path(staged).resolve(), Path(target).resolve()
    if not new.is_dir() or len(old.parts) < 3 or old == Path.home() or old in new.parents or new in old.parents:
        raise ValueError(f"unsafe replacement of {old} by {new}")
    aside = old.with_name(old.name + ".old")
    shutil.rmtree(aside, ignore_errors=True)
    if old.exists():
        os.replace(old, aside)
    os.replace(new, old)
    shutil.rmtree(aside, ignore_errors=True)
