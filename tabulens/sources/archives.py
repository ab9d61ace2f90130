"""Readers for packed files: the small part that has to run in Python inside the tasks.

Archives are opened by path in the task and streamed, so none is ever held in memory.
"""

from __future__ import annotations

import csv
import io
import os
import sys
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from urllib.parse import unquote

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulens.sources.quotes import is_open_after, record_end, split_record

# The functions below travel to the tasks with their code, so that the package need not be
# installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Rows handed to Spark at a time.
BATCH = 4096
# Longest first record that is looked for in a head.
RECORD_BYTES = 16 << 20
# Text cells may be as long as the reader allows.
CELL_BYTES = 2**31 - 1


def _filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), unquote("/" + uri[len("file:") :].lstrip("/"))
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def open_member(uri: str):
    """Binary stream of a plain or packed file; of a zip archive, its largest member."""
    filesystem, path = _filesystem(uri)
    kind = os.path.splitext(path)[1].lower()
    if kind == ".zip":
        archive = zipfile.ZipFile(filesystem.open_input_file(path))
        members = [m for m in archive.infolist() if not m.is_dir()]
        if not members:
            return io.BytesIO(b"")
        return archive.open(max(members, key=lambda m: m.file_size))
    packing = {".gz": "gzip", ".lz4": "lz4", ".bz2": "bz2"}.get(kind)
    return filesystem.open_input_stream(path, compression=packing)


def create_file(uri: str):
    """Binary stream to a new file on any file system Arrow knows."""
    filesystem, path = _filesystem(uri)
    filesystem.create_dir(os.path.dirname(path), recursive=True)
    return filesystem.open_output_stream(path, compression=None)


def list_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Path and length of every file; the contents are not read."""
    return spark.read.format("binaryFile").load(paths).select("path", "length")


def _head(stream, head_bytes: int, delimiters: Sequence[str]) -> tuple[str, bool, list[list[str]]]:
    """The first bytes, or the whole first record where that is longer; whether more follows; and the record's fields by delimiter.

    A quote that is still open at the end of the file or after ``RECORD_BYTES`` is a stray one: then the first line is the record.
    """
    raw, wanted, more = b"", head_bytes + 1, True
    while True:
        part = stream.read(wanted - len(raw))
        raw, more = raw + part, len(part) == wanted - len(raw)
        text = raw.decode("utf-8", "ignore").removeprefix("\ufeff")
        ends = [record_end(text, d) for d in delimiters]
        if min(ends) >= 0 or not more or len(raw) > RECORD_BYTES:
            break
        wanted = min(4 * wanted, RECORD_BYTES + 1)
    for i, delimiter in enumerate(delimiters):
        if ends[i] < 0:  # the file ends with its first record, or a quote stays open
            line = text.find("\n")
            ends[i] = line if line >= 0 and is_open_after(text, False, delimiter) else len(text)
    size = max(head_bytes, len(text[: max(ends, default=0) + 1].encode()))
    fields = [split_record(text[:e].removesuffix("\r"), d) for e, d in zip(ends, delimiters, strict=True)]
    return raw[:size].decode("utf-8", "ignore"), more or len(raw) > size, fields


def file_heads(spark: SparkSession, paths: str | list[str], head_bytes: int, delimiters: Sequence[str] = (",",)) -> DataFrame:
    """The first bytes of every (unpacked) file and the fields of its first record for each delimiter; read in the tasks."""

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for path in batch["path"]:
                with open_member(path) as stream:
                    found.append((path, *_head(stream, head_bytes, delimiters)))
            yield pd.DataFrame(found, columns=["path", "head", "is_cut", "fields"])

    return list_files(spark, paths).mapInPandas(heads, "path string, head string, is_cut boolean, fields array<array<string>>")


def packed_records(spark: SparkSession, paths: str | list[str], delimiter: str, header: bool) -> DataFrame:
    """The records of packed delimited files as arrays of strings; one task streams one file."""

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        csv.field_size_limit(CELL_BYTES)
        for batch in batches:
            for path in batch["path"]:
                with open_member(path) as stream:
                    lines = io.TextIOWrapper(stream, encoding="utf-8-sig", errors="replace", newline="")
                    reader = csv.reader(lines, delimiter=delimiter, skipinitialspace=True)
                    if header:
                        next(reader, None)
                    rows = []
                    for row in reader:
                        if row:
                            rows.append(row)
                        if len(rows) == BATCH:
                            yield pd.DataFrame({"fields": rows})
                            rows = []
                    if rows:
                        yield pd.DataFrame({"fields": rows})

    return list_files(spark, paths).mapInPandas(records, "fields array<string>")


def write_packed(df: DataFrame, folder: str, packing: str) -> DataFrame:
    """Write text lines (one column) as one ``zip`` or ``lz4`` file per task; gives the paths.

    Needed because the built-in writers know neither zip nor the LZ4 frame format.
    """
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        target = f"{folder.rstrip('/')}/part-{uuid.uuid4().hex}.csv.{packing}"
        lines = (line for batch in batches for line in batch.iloc[:, 0])
        first = next(lines, None)
        if first is None:
            return
        with create_file(target) as sink:
            if packing == "zip":
                with zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED) as archive:
                    archive.writestr("readme.txt", "")
                    with archive.open("data.csv", "w", force_zip64=True) as member:
                        _write_lines(member, first, lines)
            else:
                with pa.CompressedOutputStream(sink, packing) as packed:
                    _write_lines(packed, first, lines)
        yield pd.DataFrame({"path": [target]})

    return df.mapInPandas(write, "path string")


def _write_lines(sink, first: str, lines: Iterator[str]) -> None:
    sink.write((first + "\n").encode())
    for line in lines:
        sink.write((line + "\n").encode())


def as_columns(records: DataFrame, names: list[str], corrupt: str) -> DataFrame:
    """Arrays of fields as named string columns; a record of the wrong width is kept and flagged."""
    fields = F.col("fields")
    cells = [F.nullif(F.get(fields, F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)]
    wrong = F.when(F.size(fields) != len(names), F.concat_ws(",", fields)).alias(corrupt)
    return records.select(*cells, wrong)
