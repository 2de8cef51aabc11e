"""The run tree ``<root>/<engine>/<run>/results.json`` as a data source of its own.

Engine, date and version of a run stand in its path. What is asked of them goes to planning
as options, where only folder names are listed: a run that is ruled out is no partition and
its file is never opened. What is left is one partition for each run folder. (Spark keeps
what a Python source has planned with the loaded table, so a filter pushed by one query
would bind the next one on the same DataFrame; options belong to one load.) A file or an
element that cannot be read is a row too, with the reason in ``corrupt``, so that one broken
run neither ends the read nor goes unseen.

Defined cases: folders whose name does not start with a digit are no runs. A name that is
no date and version has a NULL date and version 0, as ``read_results`` has it. A missing
file gives no row. A field of the wrong type is NULL and named in ``corrupt``. A run's file
is parsed whole by its task, as a JSON array has to be.
"""

from __future__ import annotations

import datetime as dt
import json
import posixpath
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import percent_text_basis_points
from .schemas import RESULTS_DDL

FORMAT = "run_tree"
FILE = "results.json"
IDENTITY = "engine string, run_id string, run_date date, run_version int"
FIELDS = [tuple(part.split()) for part in RESULTS_DDL.replace("\n", " ").split(",")]
SCHEMA = ", ".join(
    [IDENTITY]
    + [f"{'reported_engine' if n == 'engine' else n} {kind}" for n, kind in FIELDS]
    + ["corrupt string"]
)
KINDS = {"string": pa.string(), "double": pa.float64(), "bigint": pa.int64(), "int": pa.int32()}
BATCH = 4096
NAME = re.compile(r"(\d{2})-(\d{2})-(\d{4})_v(\d+)")

@dataclass
class Run(InputPartition):
    path: str
    engine: str
    run_id: str
    run_date: dt.date | None
    run_version: int


def run_of(path: str, engine: str, name: str) -> Run:
    found = NAME.fullmatch(name)
    date, version = None, 0
    if found:
        day, month, year, version = map(int, found.groups())
        try:
            date = dt.date(year, month, day)
        except ValueError:
            date = None
    return Run(path, engine, name, date, version)


def open_tree(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", path))
    return fs.LocalFileSystem(), path


class RunTreeReader(DataSourceReader):
    def __init__(self, root: str, asked: dict) -> None:
        self.root, self.asked = root, asked

    def _fits(self, run: Run) -> bool:
        """The rules of ``select_runs``: with a bound set, a name needs a version."""
        date, low, high, runs = (self.asked.get(n) for n in ("date", "low", "high", "runs"))
        versioned = NAME.fullmatch(run.run_id) or (low is None and high is None)
        return bool(
            run.run_id[:1].isdigit()
            and (date is None or run.run_date == dt.date.fromisoformat(date))
            and versioned
            and (low is None or run.run_version >= low)
            and (high is None or run.run_version <= high)
            and (runs is None or run.run_id in runs)
        )

    def partitions(self) -> Sequence[Run]:
        files, root = open_tree(self.root)

        def folders(path: str) -> list[str]:
            found = files.get_file_info(fs.FileSelector(path))
            return sorted(x.path for x in found if x.type == fs.FileType.Directory)

        engines, runs = self.asked.get("engines"), []
        for engine in folders(root):
            name = posixpath.basename(engine)
            if engines is None or name in engines:  # others are not even listed
                runs += [run_of(p, name, posixpath.basename(p)) for p in folders(engine)]
        return [r for r in runs if self._fits(r)]

    def read(self, partition: Run | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark plans where no run is left
            return
        files, _ = open_tree(self.root)
        path = posixpath.join(partition.path, FILE)
        if files.get_file_info(path).type != fs.FileType.File:
            return
        with files.open_input_stream(path) as stream:
            text = stream.read()
        try:
            elements = json.loads(text.decode("utf-8-sig"))
            if not isinstance(elements, list):
                raise ValueError("not an array")
        except ValueError as broken:
            elements = [broken]
        for at in range(0, len(elements), BATCH):
            yield _batch(partition, elements[at : at + BATCH])


def _fitting(value, kind: str):
    """The value as the field's type, or a ValueError."""
    if value is None:
        return None
    if kind == "string":
        return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise ValueError(kind)
    if kind == "double":
        return float(value)
    bits = 63 if kind == "bigint" else 31
    if value != int(value) or not -(1 << bits) <= value < 1 << bits:
        raise ValueError(kind)
    return int(value)


def _batch(run: Run, elements: list) -> pa.RecordBatch:
    columns: list[list] = [[] for _ in FIELDS]
    reasons = []
    for element in elements:
        wrong = []
        if not isinstance(element, dict):
            wrong.append(f"file: {element}" if isinstance(element, ValueError) else "element: not an object")
            element = {}
        for column, (name, kind) in zip(columns, FIELDS):
            try:
                column.append(_fitting(element.get(name), kind))
            except (ValueError, OverflowError):
                column.append(None)
                wrong.append(f"{name}: not {kind}")
        reasons.append("; ".join(wrong) or None)
    n = len(elements)
    identity = [
        pa.array([run.engine] * n, pa.string()), pa.array([run.run_id] * n, pa.string()),
        pa.array([run.run_date] * n, pa.date32()), pa.array([run.run_version] * n, pa.int32()),
    ]
    values = [pa.array(c, KINDS[kind]) for c, (_, kind) in zip(columns, FIELDS)]
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([*identity, *values, pa.array(reasons, pa.string())], names=names)


class RunTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RunTreeReader:
        return RunTreeReader(self.options["path"], json.loads(self.options.get("asked", "{}")))


def read_run_tree(
    spark: SparkSession,
    root: str,
    *,
    engines: list[str] | None = None,
    date: str | None = None,
    low: int | None = None,
    high: int | None = None,
    runs: list[str] | None = None,
) -> DataFrame:
    """Result rows of the runs below ``root``, with the columns of ``read_results`` and
    ``corrupt``. The arguments, which are those of ``select_runs`` and a list of engines,
    choose the files that are read."""
    spark.dataSource.register(RunTree)
    given = {"engines": engines, "date": date, "low": low, "high": high, "runs": runs}
    asked = {name: value for name, value in given.items() if value is not None}
    rows = spark.read.format(FORMAT).option("path", root).option("asked", json.dumps(asked)).load()
    return rows.withColumns(
        {
            "bytes_sent": F.nullif("bytes_sent", F.lit(-1).cast("bigint")),
            "cer_bp": percent_text_basis_points(F.col("cer")),
        }
    )
