"""Sources of JSON lines as one Spark data source that gives failures as rows, for batches and streams."""

from __future__ import annotations

import gzip
import io
import json
import re
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

NAME = "runlake_sources"
#: Lines of sources; a row without a line tells how reading went: error is null if a source could be listed.
SCHEMA = "source string, file string, line string, error string"
#: Bytes of a file that a task reads, if the file can be split; lines and bytes of a batch.
SPLIT, BATCH, BATCH_BYTES = 64 << 20, 4096, 4 << 20


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return (fs.LocalFileSystem(), re.sub("^file:/*", "/", path)) if "://" not in path or path.startswith("file:") else fs.FileSystem.from_uri(path)


def listed(path: str) -> list[tuple[str, int, float]]:
    """(path, size, time of change) of the files of a folder, or of one file; an error where there is none."""
    system, at = _opened(path)
    found = system.get_file_info(at)
    if found.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    files = [found] if found.type == fs.FileType.File else [f for f in system.get_file_info(fs.FileSelector(at)) if f.type == fs.FileType.File and f.base_name[0] not in "._"]
    return sorted((f.path, f.size, f.mtime_ns / 1e9) for f in files)


@dataclass
class Part(InputPartition):
    """Bytes of a file of a source; without a file it tells of the source itself."""

    source: str
    path: str
    file: str | None = None
    start: int = 0
    end: int | None = None
    error: str | None = None


def parts_of(source: str, path: str, since: float = 0.0, up_to: float = float("inf")) -> list[Part]:
    try:
        files = [f for f in listed(path) if since <= f[2] <= up_to]
    except Exception as why:  # whatever the file system raises
        return [Part(source, path, error=f"{type(why).__name__}: {why}")]
    out = [Part(source, path)]
    for file, size, _ in files:
        cuts = [0, *([] if file.endswith(".gz") else range(SPLIT, size, SPLIT))]
        out += [Part(source, path, file, a, b) for a, b in zip(cuts, [*cuts[1:], None], strict=True)]
    return out


def lines_of(part: Part) -> Iterator[bytes]:
    """Lines that begin in the part; one that runs over its end belongs to it."""
    system, _ = _opened(part.path)
    with system.open_input_file(part.file) as raw:
        stream = io.BufferedReader(raw, 1 << 20)
        if part.file.endswith(".gz"):
            yield from gzip.GzipFile(fileobj=stream)
            return
        at = part.start
        if at:
            stream.seek(at - 1)
            at += len(stream.readline()) - 1
        while (part.end is None or at < part.end) and (line := stream.readline()):
            at += len(line)
            yield line


def read_part(part: Part | None) -> Iterator[pa.RecordBatch]:
    """The lines of a part in batches, and its failure, if there is one, as a row; nothing for None, which Spark asks for without any part."""
    if part is None:
        return

    def batch(lines: list[str | None], error: str | None = None) -> pa.RecordBatch:
        n = len(lines)
        columns = [pa.array([part.source] * n), pa.array([part.file] * n, pa.string()), pa.array(lines, pa.string()), pa.array([error] * n, pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["source", "file", "line", "error"])

    if part.file is None:
        yield batch([None], part.error)
        return
    held, size, why = [], 0, None
    try:
        for raw in lines_of(part):
            if line := raw.decode("utf-8", "replace").strip():
                held.append(line)
                size += len(line)
            if len(held) >= BATCH or size >= BATCH_BYTES:
                yield batch(held)
                held, size = [], 0
    except (OSError, EOFError, gzip.zlib.error) as failed:
        why = f"{type(failed).__name__}: {failed}"
    if held:
        yield batch(held)
    if why:
        yield batch([None], why)


class _Batch(DataSourceReader):
    def __init__(self, sources: dict[str, str]):
        self.sources = sources

    def partitions(self) -> list[Part]:
        return [p for name, path in sorted(self.sources.items()) for p in parts_of(name, path)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return read_part(partition)


class _Stream(DataSourceStreamReader):
    """Polls the sources: an offset holds, for each, the newest change that was seen; files of that very time are read again, as others may have come."""

    def __init__(self, sources: dict[str, str]):
        self.sources, self.seen = sources, {}

    def initialOffset(self) -> dict:
        return {"poll": 0, "seen": {}}

    def latestOffset(self) -> dict:
        for name, path in self.sources.items():
            try:
                self.seen[name] = max((f[2] for f in listed(path)), default=self.seen.get(name, 0.0))
            except Exception:  # noqa: S112  (partitions() tells of it)
                continue
        return {"poll": time.time_ns(), "seen": dict(self.seen)}  # each look is a batch, also where nothing is new

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return [p for name, path in sorted(self.sources.items()) for p in parts_of(name, path, start["seen"].get(name, 0.0), end["seen"].get(name, 0.0))]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return read_part(partition)


class RunSources(DataSource):
    """Option `sources`: a JSON object of names and paths."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(json.loads(self.options["sources"]))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(json.loads(self.options["sources"]))


def source_lines(spark: SparkSession, sources: dict[str, str], stream: bool = False) -> DataFrame:
    """SCHEMA of the sources (name and path of a folder or file of JSON lines, plain or .gz), each file read by tasks of their own."""
    spark.dataSource.register(RunSources)
    return (spark.readStream if stream else spark.read).format(NAME).option("sources", json.dumps(sources)).load()
