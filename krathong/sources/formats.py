"""Vocabulary, secondary lexicon and failure log as data source formats: ``spark.read.format("vocabulary").load(path)``.

Files are dealt in byte ranges, each a partition that reads the lines which begin in it; a row carries its file and the byte at which its line
begins, which orders the lines of a file without any task having to know how many lines others hold. Filters on the file prune partitions before anything is
read; filters on the word drop rows in the reader. A log is written by tasks under hidden names and comes to light when all have ended;
what a failed job has written goes. Paths are those that Arrow's file systems open (local, HDFS, S3, GCS), as driver and executors do it by themselves.
"""

from __future__ import annotations

import html
import io
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage

#: Bytes of a partition, if the option ``splitBytes`` does not say otherwise.
SPLIT = 32 << 20
_THAI = "ก-ฺเ-๛"
_WHITE = " \t\n\x0b\x0c\r\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Range(InputPartition):
    """Lines of a file that begin from byte ``begin`` on and before ``end``."""

    path: str
    begin: int
    end: int


def lines_of(part: Range) -> Iterator[tuple[int, str]]:
    """(byte, line) of each line that begins in the range; a line that the range before has begun is that one's."""
    system, path = _opened(part.path)
    with io.BufferedReader(system.open_input_file(path)) as f:
        at = part.begin
        if at:
            f.seek(at - 1)
            at = at - 1 + len(f.readline())  # ends where the first line of this range begins
        f.seek(at)
        while at < part.end:
            line = f.readline()
            if not line:
                return
            yield at, line.rstrip(b"\n").removesuffix(b"\r").decode("utf-8", "replace")
            at += len(line)


class LineReader(DataSourceReader):
    """Reads lines by ranges; ``parse`` gives the cells of a line behind (file, at), or None."""

    def __init__(self, options: dict, columns: list[str], parse):
        self.path, self.split = options["path"], int(options.get("splitBytes", SPLIT))
        self.columns, self.parse, self.kept = columns, parse, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes equality, membership and prefixes of single columns; the others stay with Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith)) and len(f.attribute) == 1 and f.attribute[0] in self.columns:
                self.kept.append((f.attribute[0], type(f).__name__, f.value))
            else:
                yield f

    def _passes(self, column: str, value) -> bool:
        test = {"EqualTo": lambda v: value == v, "In": lambda v: value in v, "StringStartsWith": lambda v: value.startswith(v)}
        return all(test[kind](v) for c, kind, v in self.kept if c == column)

    def partitions(self) -> list[Range]:
        system, path = _opened(self.path)
        info = system.get_file_info(path)
        found = system.get_file_info(fs.FileSelector(path)) if info.type == fs.FileType.Directory else [info] if info.type == fs.FileType.File else []
        scheme = self.path[: self.path.index("://") + 3] if "://" in self.path else ""
        files = sorted((i for i in found if i.type == fs.FileType.File and not i.base_name.startswith((".", "_"))), key=lambda i: i.base_name)
        return [Range(scheme + i.path, a, min(a + self.split, i.size)) for i in files if self._passes("file", i.base_name) for a in range(0, i.size, self.split)]

    def read(self, partition: Range | None) -> Iterator[tuple]:
        if partition is None:  # where there are no partitions, Spark reads one without a range
            return
        file = partition.path.rsplit("/", 1)[-1]
        others = [(k, c) for k, c in enumerate(self.columns) if c != "file"]
        for at, line in lines_of(partition):
            cells = self.parse(line)
            if cells is not None:
                row = (file, at, *cells)
                if all(self._passes(c, row[k]) for k, c in others):
                    yield row


def vocabulary_cells(line: str) -> tuple | None:
    """(gloss, thai, translit) of ``gloss,thai,translit,...``; the gloss may hold commas."""
    m = re.fullmatch(f"(.*),(.*[{_THAI}].*)", line)
    if not m:
        return None
    cells = m[2].split(",")
    return m[1], html.unescape(cells[0]), html.unescape(cells[1] if len(cells) > 1 else "")


def secondary_cells(line: str) -> tuple | None:
    """(thai, translit) of a line with a tab; none of blank lines, comments and rows with an empty side."""
    line = line.strip(_WHITE)
    thai, tab, translit = line.partition("\t")
    thai, translit = thai.strip(_WHITE), translit.strip(_WHITE)
    return (thai, translit) if tab and thai and translit and not line.startswith("#") else None


class _Lines(DataSource):
    columns: list[str] = []
    parse = None

    def schema(self) -> str:
        return ", ".join(f"{c} {'long' if c == 'at' else 'string'}" for c in self.columns)

    def reader(self, schema) -> LineReader:
        return LineReader(self.options, self.columns, type(self).parse)


class Vocabulary(_Lines):
    """(file, at, gloss, thai, translit)."""

    columns, parse = ["file", "at", "gloss", "thai", "translit"], staticmethod(vocabulary_cells)

    @classmethod
    def name(cls) -> str:
        return "vocabulary"


class Secondary(_Lines):
    """(file, at, thai, translit); a path that is not there is an empty lexicon."""

    columns, parse = ["file", "at", "thai", "translit"], staticmethod(secondary_cells)

    @classmethod
    def name(cls) -> str:
        return "secondary_lexicon"


@dataclass
class Written(WriterCommitMessage):
    path: str
    rows: int


class LogWriter(DataSourceWriter):
    """A file a task under a hidden name; committed files are named in order of the tasks' messages."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.job = options["path"].rstrip("/"), overwrite, uuid.uuid4().hex

    def _hidden(self) -> str:
        return f"{_opened(self.path)[1]}/_{self.job}"

    def write(self, iterator: Iterator) -> Written:
        system = _opened(self.path)[0]
        system.create_dir(self._hidden())
        path, n = f"{self._hidden()}/{uuid.uuid4().hex}", 0
        with system.open_output_stream(path) as f:
            for r in iterator:
                f.write(f"[{r.name}:{r.line_no}] {r.input}\n  Expected: {r.expected}\n  Got:      {r.got}\n\n".encode())
                n += 1
        return Written(path, n)

    def commit(self, messages: list) -> None:
        system, path = _opened(self.path)
        old = [i.path for i in system.get_file_info(fs.FileSelector(path, allow_not_found=True)) if i.type == fs.FileType.File]
        if old and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(path)
        # new files come to light before old ones go, so that a reader finds one log or the other
        kept = [m for m in messages if m is not None and m.rows]
        for k, m in enumerate(kept):
            system.move(m.path, f"{path}/part-{self.job}-{k:05d}.txt")
        for o in old:
            system.delete_file(o)
        self.abort(messages)

    def abort(self, messages: list) -> None:
        """Removes what the job has left under its hidden name, also what lost tasks have; one that still runs may leave a hidden file behind, which no reader sees."""
        system = _opened(self.path)[0]
        if system.get_file_info(self._hidden()).type == fs.FileType.Directory:
            system.delete_dir(self._hidden())


class FailureLog(DataSource):
    """Sink of failures (name, line_no, input, expected, got): three lines and an empty one each."""

    @classmethod
    def name(cls) -> str:
        return "failure_log"

    def schema(self) -> str:
        return "name string, line_no long, input string, expected string, got string"

    def writer(self, schema, overwrite: bool) -> LogWriter:
        return LogWriter(self.options, overwrite)


def register(spark: SparkSession) -> list[str]:
    """Makes the formats known to the session and lets filters reach them; returns their names."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (Vocabulary, Secondary, FailureLog):
        spark.dataSource.register(source)
    return [s.name() for s in (Vocabulary, Secondary, FailureLog)]
