"""A stream source that follows growing log files by byte offset.

Registered as format "log_tail". Option path: a file or a folder of files, on a file system that pyarrow.fs opens. Each micro-batch reads the
whole lines that were appended since the last one, a large range in blocks of `block` bytes by as many tasks; bytes after the last newline wait. A file that shrank, or whose first bytes
changed, is read from its start. Offsets are part of Spark's checkpoint, so a restart continues where it was. Format "log_replay" reads the last lines or bytes as a batch.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

HEAD = 64
#: Bytes of a file that one task reads, unless the option block says otherwise; bytes of one look backwards.
BLOCK, BACKWARDS = 64 << 20, 1 << 16


class FileRange(InputPartition):
    """The lines of a file that begin from start on and before end; they may go on up to limit. first: where the first of all lines begins."""

    def __init__(self, path: str, first: int, start: int, end: int, limit: int):
        self.path, self.first, self.start, self.end, self.limit = path, first, start, end, limit


def blocks(path: str, start: int, end: int, size: int) -> list[FileRange]:
    """A range of a file, cut into parts of `size` bytes, wherever lines end."""
    return [FileRange(path, start, at, min(end, at + size), end) for at in range(start, end, size)]


def read_range(p: FileRange) -> Iterator[tuple]:
    """path, offset and text of each line that isn't blank. A part that begins inside a line leaves it to the part before."""
    fs, _ = filesystem(p.path)
    with fs.open_input_file(p.path) as source:
        at = p.start if p.start == p.first else whole_line(source, p.start, p.limit)
        source.seek(at)
        rest: list[bytes] = []
        read = at
        while at < p.end:
            block = source.read(min(1 << 20, p.limit - read))
            read += len(block)
            parts = block.split(b"\n")
            if len(parts) > 1 or not block:
                parts[0] = b"".join(rest) + parts[0]
                rest = [] if not block else [parts.pop()]
            else:
                rest.append(block)
                continue
            for raw in parts:
                if at >= p.end:
                    return
                text = raw.decode("utf-8", "replace").rstrip("\r")
                if text.strip():
                    yield (p.path, at, text)
                at += len(raw) + 1
            if not block:
                return


class LogTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "log_path string, byte_offset long, line string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TailReader(self.options)


def filesystem(path: str):
    import pyarrow.fs

    return pyarrow.fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def listed(path: str):
    """(file system, the files at or below a path, in order)."""
    import pyarrow.fs

    fs, root = filesystem(path)
    info = fs.get_file_info(root)
    if info.type == pyarrow.fs.FileType.File:
        return fs, [info]
    if info.type == pyarrow.fs.FileType.NotFound:
        return fs, []
    return fs, sorted((f for f in fs.get_file_info(pyarrow.fs.FileSelector(root, recursive=True)) if f.is_file), key=lambda f: f.path)


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.block = options["path"], int(options.get("block", BLOCK))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """path -> place after the last newline, and a mark of the file's first bytes."""
        fs, files = listed(self.path)
        out = {}
        for f in files:
            with fs.open_input_file(f.path) as source:
                head = source.read(HEAD)
                end, at = f.size, 0
                while end > 0:  # the last newline, from the end backwards
                    begin = max(0, end - 65536)
                    source.seek(begin)
                    place = source.read(end - begin).rfind(b"\n")
                    if place >= 0:
                        at = begin + place + 1
                        break
                    end = begin
            out[f.path] = [at, zlib.crc32(head[: min(HEAD, at)]), min(HEAD, at)]
        return out

    def partitions(self, start: dict, end: dict) -> list[FileRange]:
        fs, _ = filesystem(self.path)
        out = []
        for path, (place, _, _) in end.items():
            old, mark, size = start.get(path, [0, 0, 0])
            if old:
                with fs.open_input_file(path) as source:
                    same = zlib.crc32(source.read(size)) == mark
                if place < old or not same:
                    old = 0
            if place > old:
                out += blocks(path, old, place, self.block)
        return out

    def read(self, partition: FileRange) -> Iterator[tuple]:
        fs, _ = filesystem(self.path)
        with fs.open_input_file(partition.path) as source:
            source.seek(partition.start)
            at = partition.start
            rest = b""
            while at + len(rest) < partition.end:
                block = source.read(min(1 << 20, partition.end - at - len(rest)))
                if not block:
                    break
                parts = (rest + block).split(b"\n")
                rest = parts.pop()
                for raw in parts:
                    text = raw.decode("utf-8", "replace").rstrip("\r")
                    if text.strip():
                        yield (partition.path, at, text)
                    at += len(raw) + 1

    def commit(self, end: dict) -> None:
        """Nothing to do: offsets live in Spark's checkpoint."""


class LogReplay(DataSource):
    """The last lines of files, as a batch. Options: path; lines: at most so many of each file; bytes: only lines that begin within so many
    last bytes of it; block: bytes read at once from the end backwards, and bytes of one task. With both options the later start holds.

    Work is by the bytes asked for: a start by lines is looked for from the end backwards, in blocks, and nothing before it is read. A line that
    the start cuts is left out; what stands after the last newline counts as a line."""

    @classmethod
    def name(cls) -> str:
        return "log_replay"

    def schema(self) -> str:
        return "log_path string, byte_offset long, line string"

    def reader(self, schema) -> DataSourceReader:
        return ReplayReader(self.options)


class ReplayReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.block = options["path"], int(options.get("block", BLOCK))
        self.lines, self.bytes = int(options.get("lines", 0)), int(options.get("bytes", 0))

    def partitions(self) -> list[FileRange]:
        fs, files = listed(self.path)
        out = []
        for f in files:
            with fs.open_input_file(f.path) as source:
                at = max(0, f.size - self.bytes) if self.bytes > 0 else 0
                at = whole_line(source, at, f.size)
                if self.lines > 0:
                    at = max(at, last_start(source, f.size, self.lines, min(self.block, BACKWARDS)))
            out += blocks(f.path, at, f.size, self.block)
        return out

    def read(self, partition: FileRange | None) -> Iterator[tuple]:
        if partition:  # there is one task even if there is nothing to read
            yield from read_range(partition)


def whole_line(source, at: int, end: int) -> int:
    """The first place from `at` on at which a line begins."""
    if at == 0:
        return 0
    source.seek(at - 1)
    begin = at - 1
    while begin < end:
        block = source.read(min(BACKWARDS, end - begin))
        if not block:
            break
        place = block.find(b"\n")
        if place >= 0:
            return begin + place + 1
        begin += len(block)
    return end


def last_start(source, size: int, n: int, block: int) -> int:
    """Where the last n lines begin: newlines are counted in blocks from the end backwards, the one that ends the file aside."""
    end, left = size, n
    while end > 0:
        begin = max(0, end - block)
        source.seek(begin)
        data = source.read(end - begin)
        stop = len(data) - 1 if end == size and data.endswith(b"\n") else len(data)
        found = data.count(b"\n", 0, stop)
        if found >= left:
            for _ in range(left):
                stop = data.rfind(b"\n", 0, stop)
            return begin + stop + 1
        left -= found
        end = begin
    return 0
