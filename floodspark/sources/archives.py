"""Zip archives of station files: build (fixture side) and scan.

The scan reads archives with the ``binaryFile`` source and unpacks each one inside a task
(``mapInArrow``): a zip is not splittable, so one archive is one unit of work, and its lines are
emitted as rows (archive, year folder, member, line number, line). The year folder is the first of
2020..2025 found in the archive path, else ``temp``. Members are packed and unpacked piece by piece: a task
holds a packed archive while it scans it, and never a whole member or archive unpacked."""

from __future__ import annotations

import itertools
import os
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import params as P

LINES_SCHEMA = "path string, member string, line_no long, line string"
PIECE = 1 << 20                            # unpacked bytes looked at together


def _lines(member):
    """Lists of a member's lines, as ``str.splitlines`` of the whole text gives them (the encoding has one byte a character)."""
    rest = ""
    while piece := member.read(PIECE):
        text = rest + piece.decode(P.RAW_ENCODING)
        rest = text.splitlines(keepends=True)[-1]          # may go on, or be a CR whose LF is yet to come
        yield text[:len(text) - len(rest)].splitlines()
    yield rest.splitlines()


def _unzip(batches):
    for b in batches:
        for path, content in zip(b.column("path"), b.column("content")):
            with zipfile.ZipFile(pa.BufferReader(content.as_buffer())) as z:
                for name in z.namelist():
                    n = 0
                    with z.open(name) as member:
                        for lines in _lines(member):
                            k = len(lines)
                            yield pa.RecordBatch.from_arrays([pa.array([path.as_py()] * k, pa.string()), pa.array([name] * k, pa.string()),
                                                              pa.array(range(n + 1, n + k + 1), pa.int64()), pa.array(lines, pa.string())],
                                                             names=["path", "member", "line_no", "line"])
                            n += k


def year_folder(path) -> F.Column:
    expr = None
    for y in P.ARCHIVE_YEARS:
        cond = path.contains(y)
        expr = F.when(cond, y) if expr is None else expr.when(cond, y)
    return expr.otherwise(P.ARCHIVE_FALLBACK)


def scan_archives(spark: SparkSession, folder: str, pattern: str = "*.zip") -> DataFrame:
    bins = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
            .option("pathGlobFilter", pattern).load(folder).select("path", "content"))
    lines = bins.mapInArrow(_unzip, LINES_SCHEMA)
    return lines.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("archive"), year_folder(F.col("path")).alias("year_folder"),
                        "member", "line_no", "line")


def write_archives(lines: DataFrame, folder: str) -> None:
    """(archive, member, line_no, line) -> one zip per archive under ``folder`` (a shared file
    system path), written line by line inside the task that gets the archive's lines in order. Lines without a member are in no file."""
    def build(batches):
        os.makedirs(folder, exist_ok=True)
        rows = (row for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("archive", "member", "line"))))
        for name, own in itertools.groupby(rows, lambda r: r[0]):
            path = os.path.join(folder, name)
            part = f"{path}.{uuid.uuid4().hex}"              # not seen by a scan until it is whole
            with zipfile.ZipFile(part, "w", zipfile.ZIP_DEFLATED) as z:
                for member, some in itertools.groupby(own, lambda r: r[1]):
                    if member is None:
                        continue
                    with z.open(member, "w", force_zip64=True) as f:
                        while piece := [line for _, _, line in itertools.islice(some, 10_000)]:
                            f.write(("\n".join(piece) + "\n").encode(P.RAW_ENCODING))
            os.replace(part, path)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([os.path.getsize(path)], pa.int64())], names=["archive", "bytes"])
    ordered = lines.select("archive", "member", "line_no", "line").repartition("archive").sortWithinPartitions("archive", "member", "line_no")
    ordered.mapInArrow(build, "archive string, bytes long").collect()  # one row per archive
