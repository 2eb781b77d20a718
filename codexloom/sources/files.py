"""Whole-file sources: each file is one sequential document, so files are read in parallel and parsed by Arrow batches."""

from __future__ import annotations

import struct
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..session import importable

#: What parsers of broken files raise; a bad file is a row with its error, not the end of the job.
REFUSALS = (ValueError, LookupError, OSError, EOFError, RuntimeError, StopIteration, NotImplementedError, struct.error, zlib.error, zipfile.BadZipFile)

Parser = Callable[[bytes], Iterable[dict]]


def read_files(spark: SparkSession, path: str, parser: Parser, schema: str) -> DataFrame:
    """Rows of all files below ``path``: their path, the parser's columns, and ``error`` where a file was refused."""
    importable(spark)
    columns = [c.strip().split(" ")[0] for c in schema.split(",")]
    names = ["path", *columns, "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for place, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows, error = list(parser(bytes(content))), None
                except REFUSALS as e:
                    rows, error = [], f"{type(e).__name__}: {e}"
                out = [{"path": place, **r} for r in rows] if error is None else [{"path": place, "error": error}]
                yield pd.DataFrame(out, columns=names).astype(object).where(lambda x: x.notna(), None)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(run, f"path string, {schema}, error string")
