"""Lines of log files by byte position, in batch and as they are appended.

A file is cut into blocks of ``BLOCK`` bytes by position alone, and a line belongs to the block in which its line break stands; the last line of a
file, if it has none, to the block of its last byte. So what a block holds depends on the file and on nothing else: not on the number of cores, nor on
any setting or the moment at which a job is planned. A task that reads a block looks back from its first byte for the start of the line that ends there.

``TailSource`` is a streaming source over growing files: its offset is a number of bytes a file, and a line is given once, in the
micro-batch in which its line break arrives. A line still being written waits for its break.

Files are read through Arrow's file systems (local, hdfs, s3, gs). Lines end at a line feed, and one carriage return before it is dropped; bytes that are no UTF-8 are replaced.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

BLOCK = 32 << 20
#: Bytes read at a time, forwards and when looking back for a line's start; lines of a batch of rows.
CHUNK, BACK, ROWS = 4 << 20, 64 << 10, 4096


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark writes it (file:/a b, s3://bucket/key), and the path there."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return fs.LocalFileSystem(), path
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"{scheme}:{quote(rest, safe='/@:')}")


def reachable(path: str) -> bool:
    """Whether tasks can read the file by position."""
    try:
        where, name = store(path)
        return where.get_file_info(name).type == fs.FileType.File
    except (OSError, ValueError, NotImplementedError):
        return False


def _before(source, begin: int) -> bytes:
    """What stands between the line break before ``begin`` and ``begin``."""
    parts: list[bytes] = []
    while begin:
        source.seek(max(0, begin - BACK))
        chunk = source.read(min(BACK, begin))
        if (at := chunk.rfind(b"\n")) >= 0:
            parts.append(chunk[at + 1 :])
            break
        parts.append(chunk)
        begin -= len(chunk)
    return b"".join(reversed(parts))


def lines_of(source, begin: int, end: int, last: bool) -> Iterator[tuple[int, bytes]]:
    """(position, line) of the lines whose break stands in [begin, end); with ``last`` also of what follows the last break."""
    held = _before(source, begin)
    at = begin - len(held)
    source.seek(begin)
    while begin < end:
        chunk = source.read(min(CHUNK, end - begin))
        if not chunk:
            break
        begin += len(chunk)
        if b"\n" not in chunk:
            held += chunk
            continue
        lines = (held + chunk).split(b"\n")
        held = lines.pop()
        for line in lines:
            yield at, line[:-1] if line.endswith(b"\r") else line
            at += len(line) + 1
    if last and held:
        yield at, held


def count_of(source, begin: int, end: int, last: bool) -> int:
    """How many lines ``lines_of`` gives."""
    n, final = 0, b"\n"
    source.seek(begin)
    while begin < end and (chunk := source.read(min(CHUNK, end - begin))):
        begin, n, final = begin + len(chunk), n + chunk.count(b"\n"), chunk[-1:]
    return n + (last and final != b"\n")


def count_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds n, the lines of each block, to rows with path, begin, end and size."""
    for batch in batches:
        n = []
        for path, begin, end, size in zip(*(batch.column(c).to_pylist() for c in ("path", "begin", "end", "size")), strict=True):
            where, name = store(path)
            with where.open_input_file(name) as source:
                n.append(count_of(source, begin, end, end == size))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], [*batch.schema.names, "n"])


def has_break(source, begin: int, end: int) -> bool:
    """Whether a line ends in [begin, end)."""
    source.seek(begin)
    while begin < end and (chunk := source.read(min(CHUNK, end - begin))):
        if b"\n" in chunk:
            return True
        begin += len(chunk)
    return False


def write_logs(lines, root: str, folder: str, suffix: str = ".txt") -> None:
    """Writes the rows (file, line_no, value) as one file a log, ``root/<folder>/<file><suffix>``, where ``folder`` is an expression; a task writes many logs. Doing a task again writes the same files again."""
    dealt = lines.selectExpr(f"CAST({folder} AS STRING) AS folder", "CAST(file AS STRING) AS file", "line_no", "value").repartition("file").sortWithinPartitions("file", "line_no")
    dealt.mapInArrow(_log_writer(root, suffix), "logs long").write.format("noop").mode("overwrite").save()


def _log_writer(root: str, suffix: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, top = store(root)
        name, out, logs = None, None, 0
        try:
            for batch in batches:
                for folder, file, value in zip(*(batch.column(c).to_pylist() for c in ("folder", "file", "value")), strict=True):
                    if (folder, file) != name:
                        if out is not None:
                            out.close()
                        where.create_dir(f"{top}/{folder}", recursive=True)
                        name, out, logs = (folder, file), where.open_output_stream(f"{top}/{folder}/{file}{suffix}"), logs + 1
                    out.write((value or "").encode("utf-8", "surrogatepass") + b"\n")
        finally:
            if out is not None:
                out.close()
        yield pa.RecordBatch.from_arrays([pa.array([logs], pa.int64())], ["logs"])

    return run


def _text(lines: list[bytes]) -> pa.Array:
    return pa.array([line.decode("utf-8", "replace") for line in lines], pa.string())


def read_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, line_no, value, modified) from rows with path, begin, end, size, file, modified and the number of lines before."""
    for batch in batches:
        for i, (path, begin, end, size, before) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("path", "begin", "end", "size", "before")), strict=True)):
            where, name = store(path)
            with where.open_input_file(name) as source:
                for lines in _grouped(lines_of(source, begin, end, end == size)):
                    same = pa.array([i] * len(lines))
                    numbers = pa.array(range(before, before + len(lines)), pa.int64())
                    before += len(lines)
                    yield pa.RecordBatch.from_arrays([batch.column("file").take(same), numbers, _text([v for _, v in lines]), batch.column("modified").take(same)], ["file", "line_no", "value", "modified"])


def _grouped(lines: Iterator[tuple[int, bytes]]) -> Iterator[list[tuple[int, bytes]]]:
    held, size = [], 0
    for at, line in lines:
        held.append((at, line))
        size += len(line)
        if len(held) == ROWS or size > CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


@dataclass
class Ranges(InputPartition):
    """(path, begin, end) of some files, for one task."""

    ranges: list[tuple[str, int, int]]


#: Tasks of a batch from which on blocks grow, up to BLOCK bytes.
TASKS = 256


def _dealt(ranges: Iterator[tuple[str, int, int]], block: int) -> list[Ranges]:
    """Small files share a task; a large one is cut at multiples of ``block``, or of as many blocks as make ``TASKS`` tasks of all bytes, as long as these are at most ``BLOCK`` bytes."""
    ranges = list(ranges)
    block = max(block, min(BLOCK, -(-sum(max(0, end - begin) for _, begin, end in ranges) // (TASKS * block)) * block))
    out, held, size = [], [], 0
    for path, begin, end in ranges:
        while begin < end:
            cut = min(end, (begin // block + 1) * block)
            held.append((path, begin, cut))
            size += cut - begin
            begin = cut
            if size >= block:
                out.append(Ranges(held))
                held, size = [], 0
    return [*out, Ranges(held)] if held else out


class TailSource(DataSource):
    """``spark.readStream.format("tracemill_tail").option("pattern", "*.jsonl").load(root)``, or ``spark.read``: (file, at, value), one row a line that has its break.

    With the option ``names`` true, one row without a value for each block of a file in which a line ends: what changed, and no text."""

    @classmethod
    def name(cls) -> str:
        return "tracemill_tail"

    def schema(self) -> str:
        return "file string, at bigint, value string"

    def reader(self, schema) -> DataSourceReader:
        return _Whole(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Tail(self.options)


class _Files:
    def __init__(self, options) -> None:
        self.root, self.pattern, self.block = options["path"], options.get("pattern", "*.jsonl"), int(options.get("block", BLOCK))
        self.names = options.get("names", "false").lower() == "true"

    def sizes(self) -> dict[str, int]:
        where, top = store(self.root)
        scheme, colon, _ = self.root.partition("://")
        shown = (lambda p: f"file:{p}") if isinstance(where, fs.LocalFileSystem) else (lambda p: f"{scheme}{colon}{p}")
        found = where.get_file_info(fs.FileSelector(top, recursive=True, allow_not_found=True))
        return {shown(f.path): f.size for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, self.pattern)}

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for path, begin, end in partition.ranges:
            where, name = store(path)
            with where.open_input_file(name) as source:
                if self.names:
                    if has_break(source, begin, end):
                        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([begin], pa.int64()), pa.nulls(1, pa.string())], ["file", "at", "value"])
                    continue
                for lines in _grouped(lines_of(source, begin, end, False)):
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(lines), pa.string()), pa.array([at for at, _ in lines], pa.int64()), _text([v for _, v in lines])], ["file", "at", "value"])


class _Whole(_Files, DataSourceReader):
    def partitions(self) -> list[Ranges]:
        return _dealt(((p, 0, n) for p, n in self.sizes().items()), self.block) or [Ranges([])]


class _Tail(_Files, DataSourceStreamReader):
    """The offset has an entry a file: the bytes that have been dealt out. A file that has become shorter is another file, and begins anew."""

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return self.sizes()

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        return _dealt(((p, start.get(p, 0) if start.get(p, 0) <= n else 0, n) for p, n in end.items()), self.block)

    def commit(self, end: dict) -> None:
        """Files stay where they are."""


def tail_lines(spark, root: str, pattern: str = "*.jsonl", streaming: bool = True, block: int = BLOCK, names: bool = False):
    """(file, at, value): the complete lines of all files of that name below ``root``; on a stream each once, as it is completed. ``at`` is the line's first byte in its file.
    With ``names`` only what blocks of which files got complete lines."""
    spark.dataSource.register(TailSource)
    return (spark.readStream if streaming else spark.read).format(TailSource.name()).option("pattern", pattern).option("block", block).option("names", names).load(root)
