"""Writers: datasets, exports and small text reports."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, functions as F

from ..functions.text import escape_cell, fixed_text, run_key
from ..operators.checks import ExpectationFailed
from .schemas import VERDICT_COLUMNS

# The columns of the records export and where each one comes from.
RECORD_COLUMNS = {
    "engine": "engine",
    "run_id": "run_id",
    "file": "file",
    "status": "status",
    "duration": "duration",
    "rf": "rf",
    "cer": "cer",
    "inference_rtf": "inference_rtf",
    "transcript_hash": "transcript_hash",
    "transcript_length": "transcript_length",
    "llm_has_hallucination": "has_hallucination",
    "llm_primary_error": "primary_error",
    "llm_severity": "severity",
    "llm_confidence": "confidence",
    "llm_review_status": "review_status",
    "audio_avg_rms": "avg_rms",
    "audio_max_rms": "max_rms",
    "audio_avg_flatness": "avg_flatness",
    "audio_avg_centroid": "avg_centroid",
    "audio_avg_rolloff": "avg_rolloff",
    "has_timestamp": "has_timestamp",
    "has_rttm": "has_rttm",
}


def append_results(df: DataFrame, path: str) -> None:
    """Add new rows to the partitioned result dataset; old rows are never rewritten."""
    df.write.mode("append").partitionBy("engine", "run_id").parquet(path)


def write_metrics(df: DataFrame, path: str) -> None:
    """Write rows with their metrics as a new dataset version."""
    df.write.mode("errorifexists").partitionBy("engine", "run_id").parquet(path)


def changed_runs(before: DataFrame, after: DataFrame) -> DataFrame:
    """(engine, run_id) of the runs in which a row of ``after`` is not one of ``before``, or
    the other way round; the columns of ``after`` that ``before`` lacks count as NULL there.
    Repeated rows count."""
    missing = [c for c in after.columns if c not in before.columns]
    kinds = {f.name: f.dataType for f in after.schema}
    old = before.withColumns({c: F.lit(None).cast(kinds[c]) for c in missing}).select(*after.columns)
    columns = [F.hash("*").alias("h1"), F.xxhash64("*").alias("h2")]
    sides = after.select("engine", "run_id", *columns, F.lit(1).alias("n")).unionByName(
        old.select("engine", "run_id", *columns, F.lit(-1).alias("n"))
    )
    rows = sides.groupBy("engine", "run_id", "h1", "h2").agg(F.sum("n").alias("n"))
    return rows.filter("n <> 0").select("engine", "run_id").distinct()


def write_back(df: DataFrame, path: str, runs: DataFrame | None = None) -> None:
    """Replace runs of the dataset at ``path`` by their rows in ``df``; all other runs keep
    their files. With ``runs`` (engine, run_id), such as ``changed_runs``, only these are
    written. A repeated call leaves the same rows, so it may run again for a batch. ``df``
    may be read from ``path``: new files stand beside the old ones until the job commits.
    """
    rows = df if runs is None else df.join(runs, ["engine", "run_id"], "left_semi")
    # Runs come together, and one of very many rows is split again.
    rows.hint("rebalance", "engine", "run_id").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("engine", "run_id").parquet(path)


def write_checked(
    df: DataFrame, path: str, rules: Mapping[str, Column], write: Callable | None = None
) -> dict[str, int]:
    """Write ``df`` to ``path`` if no row violates a rule (NULL counts as violated).

    The violations are counted by the job that writes, beside the files, so the data is
    computed once. The version is moved into place only when all counts are 0; otherwise
    ``ExpectationFailed`` names them and ``path`` does not appear. Returns the number of
    rows under ``rows``. ``write(writer, path)`` chooses the format, Parquet by default.
    """
    target, staged = _Folder(df, path), _Folder(df, f"{path.rstrip('/')}.{uuid.uuid4().hex}.staged")
    if target.exists():
        raise FileExistsError(path)
    seen = Observation()
    counts = [
        F.count(F.when(~F.coalesce(rule, F.lit(False)), 1)).alias(f"rule_{i}")
        for i, rule in enumerate(rules.values())
    ]
    observed = df.observe(seen, F.count(F.lit(1)).alias("rows"), *counts)
    try:
        (write or (lambda writer, to: writer.parquet(to)))(observed.write, staged.path)
        found = seen.get
        failed = {n: found[f"rule_{i}"] for i, n in enumerate(rules) if found[f"rule_{i}"]}
        if failed:
            raise ExpectationFailed(", ".join(f"{n}: {k}" for n, k in failed.items()))
        if not staged.rename(target):
            raise FileExistsError(path)
    finally:
        staged.delete()
    return {"rows": found["rows"]}


class _Folder:
    """A folder in whatever file system Spark writes to."""

    def __init__(self, df: DataFrame, path: str) -> None:
        context = df.sparkSession.sparkContext
        self.path = path
        self._name = context._jvm.org.apache.hadoop.fs.Path(path)
        self._files = self._name.getFileSystem(context._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        return self._files.exists(self._name)

    def delete(self) -> None:
        self._files.delete(self._name, True)

    def rename(self, to: _Folder) -> bool:
        self._files.mkdirs(to._name.getParent())
        return self._files.rename(self._name, to._name)


def export_verdicts(verdicts: DataFrame, path: str) -> bool:
    """Verdict CSV in the fixed column order, with a byte-order mark in every file.

    Leaves nothing and returns False when there is no verdict, which the job that writes
    finds out itself.
    """
    first, *rest = VERDICT_COLUMNS
    flag = F.when(F.col("has_hallucination"), "True").otherwise("False")
    rows = verdicts.withColumn("has_hallucination", flag).select(
        F.col(first).alias("\ufeff" + first), *rest
    )
    as_csv = lambda writer, to: writer.option("header", True).option("escape", '"').csv(to)
    count = write_checked(rows, path, {}, as_csv)["rows"]
    if not count:
        _Folder(verdicts, path).delete()
    return count > 0


def record_rows(records: DataFrame) -> DataFrame:
    """The columns of the records export, NULL where the records lack one, ordered by
    engine, run and file."""
    cells = [
        (F.col(source) if source in records.columns else F.lit(None).cast("string")).alias(name)
        for name, source in RECORD_COLUMNS.items()
    ]
    return records.orderBy("engine", run_key(F.col("run_id")), "file").select(*cells)


def export_records(records: DataFrame, path: str) -> None:
    """Records CSV ordered over all part files."""
    record_rows(records).write.option("header", True).option("escape", '"').mode("errorifexists").csv(path)


def export_json(summary: DataFrame, path: str) -> None:
    summary.write.mode("errorifexists").json(path)


# ---------------------------------------------------------------- report text


def number_text(value: Column, digits: int = 2) -> Column:
    missing = value.isNull() | F.isnan(value.cast("double"))
    return F.when(missing, "N/A").otherwise(fixed_text(value.cast("double"), digits))


def percent_cell(value: Column, digits: int = 1) -> Column:
    text = number_text(value, digits)
    return F.when(text == "N/A", text).otherwise(F.concat(text, F.lit("%")))


def signed_text(value: Column, digits: int = 3) -> Column:
    return F.when(value.isNull(), "-").otherwise(
        fixed_text(value.cast("double"), digits, sign=True)
    )


def interval_text(low: Column, high: Column, digits: int = 1, percent: bool = True) -> Column:
    if percent:
        low, high = percent_cell(low * 100, digits), percent_cell(high * 100, digits)
    else:
        low, high = number_text(low, digits), number_text(high, digits)
    return F.concat(low, F.lit(" … "), high)


def table_rows(df: DataFrame, cells: Mapping[str, Column]) -> DataFrame:
    """One Markdown row per input row as the column ``row``."""
    parts = [escape_cell(F.coalesce(c.cast("string"), F.lit(""))) for c in cells.values()]
    text = F.concat(F.lit("| "), F.concat_ws(" | ", *parts), F.lit(" |"))
    return df.select("*", text.alias("row"))


def to_markdown(
    df: DataFrame, cells: Mapping[str, Column], order: Sequence[Column], limit: int
) -> str:
    """Markdown table of the first ``limit`` rows, a report being a top list."""
    rows = table_rows(df, cells).orderBy(*order).limit(limit).select("row").collect()
    head = ["| " + " | ".join(cells) + " |", "|" + " --- |" * len(cells)]
    return "\n".join(head + [r["row"] for r in rows])


@dataclass
class Section:
    """A titled table of a document: its rows, the text of their cells, and the order of the
    rows by numbers and texts, ascending."""

    title: str
    rows: DataFrame
    cells: Mapping[str, Column]
    order: Sequence[Column]


def cells(names: Sequence[str], values: Sequence[Column | str]) -> dict[str, Column]:
    return {n: F.col(v) if isinstance(v, str) else v for n, v in zip(names, values, strict=True)}


def document(sections: Sequence[Section], keys: int = 3) -> DataFrame:
    """All lines of a document of any length: (section, position, row), where sorting by the
    first two gives the document. Titles and headers are rows before those of the table;
    nothing is cut and nothing is numbered, so the one sort of ``write_document`` deals out
    ranges of lines."""
    place = ", ".join(f"n{i}:double, t{i}:string" for i in range(keys))
    kind = f"struct<head:int, {place}>"
    parts = []
    for number, section in enumerate(sections, 1):
        if len(section.order) > keys:
            raise ValueError(f"more than {keys} keys of order")
        heads = [f"## {section.title}", "", "| " + " | ".join(section.cells) + " |", "|" + " --- |" * len(section.cells)]
        spark = section.rows.sparkSession
        blank = [None, None] * keys
        parts.append(
            spark.createDataFrame(
                [(number, (i - len(heads), *blank), line) for i, line in enumerate(heads)],
                f"section int, position {kind}, row string",
            )
        )
        kinds = dict(section.rows.select(*[c.alias(f"k{i}") for i, c in enumerate(section.order)]).dtypes)
        fields = []
        for i in range(keys):
            text = kinds.get(f"k{i}") == "string"
            value = section.order[i] if i < len(section.order) else F.lit(None)
            fields.append((F.lit(None) if text else value).cast("double").alias(f"n{i}"))
            fields.append((value if text else F.lit(None)).cast("string").alias(f"t{i}"))
        position = F.struct(F.lit(0).alias("head"), *fields).cast(kind).alias("position")
        parts.append(
            table_rows(section.rows, section.cells).select(F.lit(number).alias("section"), position, "row")
        )
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def write_document(lines: DataFrame, path: str) -> None:
    """The document as text files, in order over all of them."""
    lines.orderBy("section", "position").select("row").write.mode("errorifexists").text(path)
