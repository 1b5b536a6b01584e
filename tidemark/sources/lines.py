"""A sink of text lines whose files are in the order of the rows, and count only together."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: The folder of unfinished parts, and the file that lists the finished ones.
_PENDING, _LIST = "_pending", "_LIST"


@dataclass
class _Part(WriterCommitMessage):
    partition: int
    file: str
    rows: int
    last: str | None


class OrderedLines(DataSource):
    """df.write.format("tidemark_lines").save(folder): the text columns of each row as lines, partitions in their order.

    Tasks write parts under a name of their own, which the commit renames to part-<rows before it>, so that reading the
    files by name gives the rows in order. _LIST then names them: without it nothing has been written. A task
    or job that fails removes its parts. With the option tail (a column) the last row's line of that column follows once more.
    Null values give no line.
    """

    @classmethod
    def name(cls) -> str:
        return "tidemark_lines"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _LinesWriter(self.options["path"], [f.name for f in schema.fields], self.options.get("tail"), overwrite)


class _LinesWriter(DataSourceWriter):
    def __init__(self, folder: str, columns: list[str], tail: str | None, overwrite: bool):
        self.folder, self.columns, self.overwrite, self.job = folder.rstrip("/"), columns, overwrite, uuid.uuid4().hex
        self.tail = None if tail is None else columns.index(tail)

    def _fs(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.folder)

    def write(self, iterator: Iterator) -> _Part:
        from pyspark import TaskContext

        fs, folder = self._fs()
        task = TaskContext.get()
        pending = f"{folder}/{_PENDING}/{self.job}"
        fs.create_dir(pending, recursive=True)
        file, rows, last = f"{pending}/{task.partitionId()}-{uuid.uuid4().hex}", 0, None
        try:
            with fs.open_output_stream(file) as out:
                for row in iterator:
                    lines = [row[c] for c in self.columns]
                    out.write("".join(f"{line}\n" for line in lines if line is not None).encode())
                    rows, last = rows + 1, lines[self.tail] if self.tail is not None else None
        except BaseException:
            fs.delete_file(file)
            raise
        return _Part(task.partitionId(), file, rows, last)

    def commit(self, messages: list[_Part | None]) -> None:
        from pyarrow.fs import FileSelector, FileType

        fs, folder = self._fs()
        fs.create_dir(folder, recursive=True)
        old = [i.path for i in fs.get_file_info(FileSelector(folder)) if i.type == FileType.File]
        if old and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(f"{folder} isn't empty")
        for path in sorted(old, key=lambda p: not p.endswith(_LIST)):  # first the list, so that no half of the old files counts
            fs.delete_file(path)
        done, before, last = [], 0, None
        for part in sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.partition):
            done.append(f"part-{before:012d}")
            fs.move(part.file, f"{folder}/{done[-1]}")
            before, last = before + part.rows, part.last
        if last is not None:
            done.append(f"part-{before:012d}")
            with fs.open_output_stream(f"{folder}/{done[-1]}") as out:
                out.write(f"{last}\n".encode())
        with fs.open_output_stream(f"{folder}/{_LIST}") as out:
            out.write(json.dumps(done).encode())
        self._clean(fs, folder)

    def abort(self, messages: list[_Part | None]) -> None:
        self._clean(*self._fs())

    def _clean(self, fs, folder: str) -> None:
        from pyarrow.fs import FileType

        if fs.get_file_info(f"{folder}/{_PENDING}/{self.job}").type == FileType.Directory:
            fs.delete_dir(f"{folder}/{_PENDING}/{self.job}")


def write_ordered(df: DataFrame, folder: str, columns: dict[str, Column], order: list[str], tail: str | None = None, partitions: int | None = None, overwrite: bool = False) -> None:
    """Writes columns of df as lines in an order, by ranges of it, so that no task holds more than its range."""
    spark = df.sparkSession
    spark.dataSource.register(OrderedLines)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(n, *order).sortWithinPartitions(*order).select(*(c.cast("string").alias(name) for name, c in columns.items()))
    out = rows.write.format("tidemark_lines").mode("overwrite" if overwrite else "append")
    (out.option("tail", tail) if tail else out).save(folder)


def write_concat_list(entries: DataFrame, folder: str, path_col: str, *order: str, partitions: int | None = None, overwrite: bool = False) -> None:
    """A concat list: a file and a duration line for each entry in order; the last file is named once more, as players need."""
    quoted = F.concat(F.lit("file '"), F.replace(F.col(path_col), F.lit("'"), F.lit("'\\''")), F.lit("'"))
    write_ordered(entries, folder, {"file": quoted, "duration": F.format_string("duration %.6f", "duration")}, list(order), "file", partitions, overwrite)


def read_ordered(spark, folder: str) -> DataFrame:
    """(file, pos, line): the lines of a finished list; file and pos, from 0 in each file, give their order."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    with system.open_input_stream(f"{path}/{_LIST}") as f:
        names = json.loads(f.read())
    if not names:
        return spark.createDataFrame([], "file string, pos int, line string")
    whole = spark.read.text([f"{folder.rstrip('/')}/{n}" for n in names], wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.split(F.regexp_replace("value", r"\n\z", ""), "\n").alias("lines"))
    return whole.select("file", F.posexplode("lines").alias("pos", "line"))
