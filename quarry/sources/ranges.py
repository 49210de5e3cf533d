"""Byte ranges of files: packed into tasks by size, and lines and XML elements read from them.

Files are listed with their sizes before anything is read. Work is dealt out
by bytes: a running sum of sizes, with something added for opening a file,
gives every piece its bin, and a bin is a task. Pieces are whole files where
a file must be one value, ranges of a file otherwise; a line or element
belongs to the range in which it begins.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.prefix import running_sum
from ..session import cut_lineage, ship_package

#: Bytes of a task, what opening a file counts for, of a range, and of a batch handed on.
TASK_BYTES, OPEN_BYTES, RANGE_BYTES, BATCH_BYTES = 64 << 20, 64 << 10, 8 << 20, 16 << 20
#: The line boundaries of str.splitlines() in UTF-8.
_BREAK = re.compile(rb"\r\n|[\n\r\x0b\x0c\x1c-\x1e]|\xc2\x85|\xe2\x80[\xa8\xa9]")
_CLASS, _CLASS_END = re.compile(rb"<class[\s>/]"), re.compile(rb"</class\s*>")


def open_fs(uri: str):
    """The file system of ``uri`` and its path in it."""
    import os

    from pyarrow import fs as pafs
    if "://" in uri:
        return pafs.FileSystem.from_uri(uri)
    local = uri[len("file:"):] if uri.startswith("file:") else uri
    return pafs.LocalFileSystem(), os.path.abspath(local)


def packed(pieces: DataFrame, bytes_col: str, key: list[str], task_bytes: int | None = None) -> DataFrame:
    """``pieces`` dealt to tasks of about ``task_bytes`` each; ``key`` names a piece."""
    cost = F.col(bytes_col).cast("long") + F.lit(OPEN_BYTES)
    rows = pieces.withColumn("_all", F.lit(0)).withColumn("_cost", cost)
    summed = running_sum(rows, ["_all"], [F.xxhash64(*key), *[F.col(k) for k in key]], "_cost", "_sum")
    size = task_bytes or TASK_BYTES
    binned = cut_lineage(summed.withColumn("_bin", F.floor((F.col("_sum") - F.col("_cost")) / F.lit(size)).cast("int"))
                         .drop("_all", "_cost", "_sum"))
    n = (binned.agg(F.max("_bin").alias("n")).first()["n"] or 0) + 1
    return binned.repartitionByRange(n, "_bin").drop("_bin")


def byte_ranges(paths: DataFrame, range_bytes: int | None = None) -> DataFrame:
    """``(repo, path, abs, size, first, last)``: every file cut into ranges, as tasks by size."""
    size = range_bytes or RANGE_BYTES
    cut = paths.where("size > 0").select(
        "repo", "path", "abs", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(size).cast("long"))).alias("first"))
    cut = cut.withColumn("last", F.least(F.col("first") + size, "size")).withColumn("bytes", F.col("last") - F.col("first"))
    return packed(cut, "bytes", ["abs", "first"]).drop("bytes")


def read_files(root: str, paths: DataFrame) -> DataFrame:
    """``(repo, path, content)`` of ``paths (repo, path, abs, size)``; files that are not UTF-8 are left out."""
    ship_package(paths.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = open_fs(root)
        rows, held = [], 0
        for batch in batches:
            for repo, path, absolute in zip(*(c.to_pylist() for c in batch.columns)):
                with fs.open_input_stream(absolute) as f:
                    data = f.readall()
                try:
                    rows.append((repo, path, data.decode("utf-8")))
                except UnicodeDecodeError:
                    continue
                held += len(data)
                if held >= BATCH_BYTES:
                    yield _strings(rows, ["repo", "path", "content"])
                    rows, held = [], 0
        yield _strings(rows, ["repo", "path", "content"])

    to_read = packed(paths.select("repo", "path", "abs", "size"), "size", ["abs"])
    return to_read.select("repo", "path", "abs").mapInArrow(read, "repo string, path string, content string")


def _strings(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(len(names))], names)


def _line_starts(f, first: int, last: int, size: int) -> list[int]:
    """Places in ``first`` to ``last`` at which a line begins."""
    low = max(0, first - 3)
    data = f.read_at(min(last + 1, size) - low, low)
    starts = [0] if first == 0 else []
    starts += [low + m.end() for m in _BREAK.finditer(data) if first <= low + m.end() < last]
    return starts


def _is_utf8(f, first: int, last: int, size: int) -> bool:
    """Whether the characters that begin in the range are UTF-8 and nothing lies between them and the range before."""
    data = f.read_at(min(last + 3, size) - first, first)
    tail = lambda at: next((k for k in range(4) if at + k >= len(data) or data[at + k] & 0xC0 != 0x80), 4)
    begin = tail(0) if first else 0
    end = last - first + (tail(last - first) if last < size else 0)
    try:
        data[begin:end].decode("utf-8")
    except UnicodeDecodeError:
        return False
    return begin < 4


def _range_task(root: str, of_range: Callable, out: Callable):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = open_fs(root)
        rows, held = [], 0
        for batch in batches:
            for piece in batch.to_pylist():
                with fs.open_input_file(piece["abs"]) as f:
                    for row, size in of_range(f, piece):
                        rows.append(row)
                        held += size
                        if held >= BATCH_BYTES:
                            yield out(rows)
                            rows, held = [], 0
        yield out(rows)
    return run


def _count_lines(f, piece: dict):
    a, b, size = piece["first"], piece["last"], piece["size"]
    yield {**piece, "n": len(_line_starts(f, a, b, size)), "ok": _is_utf8(f, a, b, size)}, 100


def _read_until(f, at: int, size: int, found: Callable) -> bytes:
    """Bytes from ``at`` on, in growing steps until ``found`` or the end."""
    step, data = 1 << 16, b""
    while at + len(data) < size and not found(data):
        data += f.read_at(min(step, size - at - len(data)), at + len(data))
        step *= 2
    return data


def _lines(f, piece: dict):
    a, b, size = piece["first"], piece["last"], piece["size"]
    starts = _line_starts(f, a, b, size)
    if not starts:
        return
    data = f.read_at(min(b + 1, size) - starts[0], starts[0])
    for k, at in enumerate(starts):
        if k + 1 < len(starts):
            line = data[at - starts[0]:starts[k + 1] - starts[0]]
        else:
            # a break at the very end of what was read may go on
            line = _read_until(f, at, size, lambda d: (m := _BREAK.search(d)) is not None and m.end() < len(d))
        m = _BREAK.search(line)
        text = line[:m.start()] if m else line
        yield (piece["repo"], piece["path"], piece["before"] + k + 1, text.decode("utf-8")), len(text) + 50


def scan_lines(root: str, paths: DataFrame, range_bytes: int | None = None) -> DataFrame:
    """A5 from files: ``(repo, path, line_no, line)`` as ``line_table`` of the files' contents gives it.

    No file is one value: line beginnings are counted range by range, a
    running sum over a file's ranges numbers them, and the ranges are read
    again for the lines. Files with a range that is not UTF-8 are left out.
    """
    ship_package(paths.sparkSession)
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
    names = ["repo", "path", "abs", "size", "first", "last", "n", "ok"]
    counted = cut_lineage(byte_ranges(paths, range_bytes).mapInArrow(
        _range_task(root, _count_lines, lambda rows: pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], kind) for k, kind in zip(names, kinds)], names)),
        "repo string, path string, abs string, size long, first long, last long, n long, ok boolean"))
    whole = counted.join(counted.where("NOT ok").select("abs").distinct(), "abs", "left_anti")
    numbered = running_sum(whole, ["abs"], [F.col("first")], "n", "upto").where("n > 0")
    ranges = packed(numbered.select("repo", "path", "abs", "size", "first", "last", (F.col("upto") - F.col("n")).alias("before"),
                                    (F.col("last") - F.col("first")).alias("bytes")), "bytes", ["abs", "first"])

    def out(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()),
             pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.string())],
            ["repo", "path", "line_no", "line"])
    return ranges.mapInArrow(_range_task(root, _lines, out), "repo string, path string, line_no int, line string")


def _class_elements(f, piece: dict):
    import xml.etree.ElementTree as ET
    a, b, size = piece["first"], piece["last"], piece["size"]
    data = f.read_at(min(b + 8, size) - a, a)
    for m in _CLASS.finditer(data):
        at = a + m.start()
        if at >= b:
            break
        done = lambda d: (e := d.find(b">")) >= 0 and (d[e - 1:e] == b"/" or _CLASS_END.search(d) is not None)
        text = data[m.start():] if done(data[m.start():]) else _read_until(f, at, size, done)
        opening = text.find(b">")
        if opening < 0:
            continue
        ends = _CLASS_END.search(text)
        whole = text[:opening + 1] if text[opening - 1:opening] == b"/" else text[:ends.end()] if ends else None
        try:
            element = ET.fromstring(whole.decode("utf-8")) if whole else None
        except (ET.ParseError, UnicodeDecodeError):
            element = None
        if element is None:
            continue
        lines = [(ln.get("number"), ln.get("hits")) for ln in element.findall("lines/line")]
        yield (piece["repo"], element.get("filename"), element.get("line-rate"), piece["path"], at, lines), 100 + 40 * len(lines)


def scan_coverage_ranges(root: str, paths: DataFrame, range_bytes: int | None = None) -> DataFrame:
    """A6 for reports of any size: the rows of ``scan_coverage_xml``, read by byte ranges.

    ``doc_pos`` is (report file, byte at which the class element begins), so
    it orders the elements of a repo's reports whatever the ranges, and the
    last of a repeated file name wins. Elements that are no XML are left out;
    a ``<class`` inside a comment would be read as one.
    """
    ship_package(paths.sparkSession)

    def out(rows):
        line = pa.list_(pa.struct([("number", pa.string()), ("hits", pa.string())]))
        return pa.RecordBatch.from_arrays(
            [*[pa.array([r[k] for r in rows], pa.string()) for k in range(4)], pa.array([r[4] for r in rows], pa.int64()),
             pa.array([[{"number": n, "hits": h} for n, h in r[5]] for r in rows], line)],
            ["repo", "filename", "rate", "file", "at", "ls"])
    read = byte_ranges(paths, range_bytes).mapInArrow(
        _range_task(root, _class_elements, out),
        "repo string, filename string, rate string, file string, at long, ls array<struct<number:string,hits:string>>")
    hits = F.coalesce(F.col("l.hits"), F.lit("0"))
    number = lambda c, kind: F.coalesce(F.expr(f"try_cast({c} AS {kind})"), F.lit(0))
    return read.select(
        "repo", "filename", number("rate", "double").cast("double").alias("line_rate"), F.struct("file", "at").alias("doc_pos"),
        F.explode_outer("ls").alias("l")).select(
        "repo", "filename", "line_rate", F.col("l").isNotNull().alias("has_line"), number("l.number", "int").alias("line_no"),
        number("l.hits", "bigint").alias("hits"), (hits != "0").alias("covered"), "doc_pos")


def write_files(files: DataFrame, root: str) -> DataFrame:
    """Write ``files(repo, path, content)`` below ``root`` as repo/path, and return repo, path, size of each.

    A task that runs again writes the same files again. The rows are written
    to the checkpoint folder, so the files are there when it returns.
    """
    ship_package(files.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(root)
        made: set[str] = set()
        for batch in batches:
            sizes = []
            for repo, path, content in zip(*(c.to_pylist() for c in batch.columns)):
                at = f"{base}/{repo}/{path}"
                folder = at.rpartition("/")[0]
                if folder not in made:
                    fs.create_dir(folder, recursive=True)
                    made.add(folder)
                data = content.encode()
                with fs.open_output_stream(at) as f:
                    f.write(data)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], ["repo", "path", "size"])
    return cut_lineage(files.select("repo", "path", "content").where("repo IS NOT NULL AND path IS NOT NULL AND content IS NOT NULL")
                       .mapInArrow(write, "repo string, path string, size long"))


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below the shared checkpoint folder."""
    import uuid

    from ..session import scratch_path
    return f"{scratch_path(spark, name)}-{uuid.uuid4().hex}"
