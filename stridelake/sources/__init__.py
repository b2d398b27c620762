"""Sources SRC-1 to SRC-10 and sinks SNK-1 to SNK-6."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import conform, schema_accepts
from .id_index import add_to_index, known_ids, unseen_ids
from .name_index import add_names, search_indexed
from .states import Conflict, append_table, clear_staging, file_system, load_or_empty, load_table, newest, parts, reserve, snapshot, tokens, versions, write_table

__all__ = ["Conflict", "add_names", "add_to_index", "append_table", "clear_staging", "known_ids", "load_or_empty", "load_table", "newest", "parts", "reserve", "search_indexed", "snapshot", "tokens", "unseen_ids", "versions", "write_table"]


#: First bytes of a file that are read for its header; twice as many again for a longer one.
_HEAD = 1 << 16


def _first_record(uri: str, length: int) -> list[str]:
    """The names in a CSV file's first record, which may span lines. Runs in the tasks."""
    from pyarrow import fs

    scheme, rest = uri.split(":", 1)
    where, path = fs.FileSystem.from_uri(f"{scheme}:{quote(rest if rest.startswith('//') else '//' + rest)}")
    take = _HEAD
    while True:
        with where.open_input_stream(path) as f:
            head = f.read(take)
        lines = io.StringIO(head.decode("utf-8-sig", "replace"), newline="")
        record = next(csv.reader(lines), [])
        if take >= length or lines.tell() < len(lines.getvalue()):
            return record
        take *= 2


def file_table(spark: SparkSession, pattern: str) -> DataFrame:
    """SRC-2, SRC-3: one row per file that fits: ``path, name, length, batch`` (``batch_of`` its name) and ``header``, the column names in its first record.
    Headers are read by tasks, of each file only its first bytes, from stores that pyarrow can open."""
    fs, where, _ = file_system(spark, pattern)
    folder, glob = pattern.rsplit("/", 1)
    found = [s for s in fs.globStatus(where) or [] if s.isFile()]
    name = F.element_at(F.split("path", "/"), -1)
    row = ["path", name.alias("name"), "length", batch_of(name).alias("batch"), "header"]
    # Spark's reader passes over empty files
    empty = spark.createDataFrame([(s.getPath().toString(), 0, []) for s in found if not s.getLen()], "path string, length long, header array<string>").select(*row)
    if not any(s.getLen() for s in found):
        return empty
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", "length")
    kinds = "path string, length long, header array<string>"

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            paths, lengths = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            found = [_first_record(p, n) for p, n in zip(paths, lengths)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.string()))], ["path", "length", "header"])

    return files.mapInArrow(read, kinds).select(*row).unionByName(empty)


def headers(spark: SparkSession, pattern: str) -> dict[str, list[str]]:
    """Column names of every file that fits the pattern. File names and headers reach the driver, which plans the reading by them; nothing else does."""
    return {r.path: r.header for r in file_table(spark, pattern).select("path", "header").collect()}


def _with_breaks(spark: SparkSession, paths: list[str]) -> set[str]:
    """Names of the files in which a quoted field goes over a line break: some line holds an odd number of quotes. One distributed pass over the lines."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    odd = spark.read.text(paths).filter(quotes % 2 == 1)
    return {r[0] for r in odd.select(F.col("_metadata.file_path")).distinct().collect()}


def read_files(spark: SparkSession, files: dict[str, list[str]], schema: T.StructType, file_name: str | None = None, multi_line: bool | None = None) -> DataFrame:
    """CSV files by the names in their headers, whatever the order of columns. Missing columns and broken fields become null. Files of equal header are
    read together; ``file_name`` adds a column with the name of each row's file.

    Where ``multi_line`` is not given, a pass over the lines finds the files in which quoted fields hold line breaks: these are read by one task each, all others in
    splits. False saves the pass for data without such fields, True takes all files for such.
    """
    broken = set(files) if multi_line else _with_breaks(spark, list(files)) if multi_line is None and files else set()
    known = {_plain_path(p) for p in broken}
    groups: dict[tuple, list[str]] = {}
    for path, names in files.items():
        groups.setdefault((_plain_path(path) in known, *names), []).append(path)

    def part(whole: bool, paths: list[str]) -> DataFrame:
        rows = spark.read.options(header=True, multiLine=whole, escape='"').csv(paths)
        if not file_name:
            return conform(rows, schema, defaults=False)
        added = T.StructType([*schema.fields, T.StructField(file_name, T.StringType())])
        return conform(rows.withColumn(file_name, F.col("_metadata.file_name")), added, defaults=False)

    parts = [part(whole, paths) for (whole, *names), paths in groups.items() if names]
    empty = T.StructType([*schema.fields, *([T.StructField(file_name, T.StringType())] if file_name else [])])
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], empty)


def _plain_path(uri: str) -> str:
    """A file's URI in one spelling."""
    return unquote(re.sub(r"^file:/+", "file:/", uri))


def read_table(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool | None = None) -> DataFrame:
    """SRC-1: CSV with a header and a contract (see ``read_files``)."""
    return read_files(spark, headers(spark, path), schema, multi_line=multi_line)


def read_dir(spark: SparkSession, folder: str, glob: str, schema: T.StructType, file_name: str | None = None, multi_line: bool | None = None) -> DataFrame:
    """SRC-2: all files of a folder whose name fits."""
    return read_files(spark, headers(spark, f"{folder}/{glob}"), schema, file_name, multi_line)


def batch_of(name: Column) -> Column:
    """SRC-3: batch number in a file name, ``Unknown`` if there is none."""
    found = F.regexp_extract(name, r"batch_(\d+)", 1)
    return F.when(found == "", "Unknown").otherwise(found)


def with_batch(df: DataFrame, file_name: str | None = None) -> DataFrame:
    """SRC-3 for rows read from files: by the column ``file_name`` of ``read_dir``, which goes away, or by the file that Spark notes for each row of a single read."""
    if file_name is None:
        return df.withColumn("batch", batch_of(F.col("_metadata.file_name")))
    return df.withColumn("batch", batch_of(F.col(file_name))).drop(file_name)


def read_by_unit(spark: SparkSession, folder: str, miles: T.StructType, km: T.StructType, glob: str = "*.csv", multi_line: bool | None = None) -> tuple[DataFrame, DataFrame, int]:
    """SRC-4, QLT-3: files in miles, files in km, and the number of files with neither header."""
    found = headers(spark, f"{folder}/{glob}")
    mi = {p: names for p, names in found.items() if "Distance (mi)" in names}
    kms = {p: names for p, names in found.items() if "Distance (km)" in names and p not in mi}
    return read_files(spark, mi, miles, multi_line=multi_line), read_files(spark, kms, km, multi_line=multi_line), len(found) - len(mi) - len(kms)


def accepted_files(spark: SparkSession, folder: str, glob: str, schema: T.StructType, file_name: str | None = None, multi_line: bool | None = None) -> tuple[DataFrame, list[str]]:
    """QLT-3: the rows of the files whose header has the contract's columns, and the names of the others."""
    found = headers(spark, f"{folder}/{glob}")
    good = {p: names for p, names in found.items() if schema_accepts(names, schema)}
    return read_files(spark, good, schema, file_name, multi_line), sorted(p.rsplit("/", 1)[1] for p in found if p not in good)


def parse_payload(df: DataFrame, column: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """SRC-5: rows with the parsed payload, and rows whose payload is no JSON."""
    full = schema if "_corrupt_record" in schema.fieldNames() else T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    parsed = df.withColumn("payload", F.from_json(column, full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    bad = F.col("payload._corrupt_record").isNotNull() | F.col("payload").isNull()
    return parsed.filter(~bad), parsed.filter(bad).drop("payload")


@dataclass(frozen=True)
class RowSpec:
    """Which cells of a result row are wanted (negative: from the end), and which row and cell tags hold them."""

    cells: dict[str, int]
    row: str = "tr"
    cell: str = "td"
    header_rows: int = 1


#: Fixed cell positions of the four kinds of result pages.
TOPLIST = RowSpec({"mark": 1, "competitor": 3, "nat": 5, "location": -3, "date": -2, "score": -1})
FINAL = RowSpec({"place": 0, "nat": 2, "competitor": 3, "mark": 4})
RANKING = RowSpec({"rank": 0, "athlete": 1, "nat": 2, "score": 3, "event_list": 4})
ROSTER = RowSpec({"athlete": 1, "nat": 3, "birthdate": 4})


def extract_rows(pages: DataFrame, spec: RowSpec, html: str = "html") -> DataFrame:
    """SRC-6 to SRC-9: one row per table row with more than one cell: the page's other columns, ``row_no`` and the cells' text."""
    inside = lambda tag: rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>"
    rows = pages.select("*", F.posexplode(F.regexp_extract_all(html, F.lit(inside(spec.row)), 1)).alias("row_no", "__row"))
    rows = rows.filter(F.col("row_no") >= spec.header_rows).withColumn("__cells", F.regexp_extract_all("__row", F.lit(inside(spec.cell)), 1)).filter(F.size("__cells") > 1)
    text = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", " "), r"\s+", " "))
    cells = [text(F.try_element_at("__cells", F.lit(i + 1 if i >= 0 else i))).alias(name) for name, i in spec.cells.items()]
    return rows.select(*[c for c in pages.columns if c != html], "row_no", *cells)


def page_manifest(events: DataFrame, url: str, start: int, end: int) -> DataFrame:
    """SRC-10: one row per event and page number."""
    pages = events.withColumn("page", F.explode(F.sequence(F.lit(start), F.lit(end))))
    return pages.withColumn("url", F.regexp_replace(url, "page=1(?![0-9])", "page={}")).withColumn("url", F.replace("url", F.lit("{}"), F.col("page").cast("string")))


# -- sinks: tables of numbered states are in .states -----------------------------------------------------------


def publish(tables: dict[str, DataFrame], root: str, mode: str = "overwrite", token: str | None = None) -> dict[str, str]:
    """SNK-4, SNK-5: all serving tables replaced, or rows added to them; the new state of each. A load of a known ``token`` that broke off
    goes on with the tables it had not reached, and one that was whole changes nothing."""
    write = write_table if mode == "overwrite" else append_table
    return {name: write(df, f"{root}/{name}", token=token) for name, df in tables.items()}


def log_load(tables: dict[str, DataFrame]) -> DataFrame:
    """SNK-6: one row of counts with the time."""
    counts = stack_counts(tables)
    return counts.agg(F.current_timestamp().alias("timestamp"), *[F.coalesce(F.sum(F.when(F.col("name") == n, F.col("n"))), F.lit(0)).alias(f"{n}_count") for n in tables])


def stack_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out
