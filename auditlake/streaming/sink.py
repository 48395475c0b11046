"""A streaming sink of server-sent events: files of a batch count once, however often the batch is tried.

``writeStream.format("audit_events")`` with the option ``path`` writes one file a task, and, when a batch commits, a list
of its files that is named by the batch's number. Readers see only files on such a list. A batch that is run again finds
its list and leaves the first one's files as they are; a task or batch that fails takes its files away, and files
that a lost executor left behind are on no list.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, DataSourceStreamWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..ship import ship

FORMAT = "audit_events"
#: Events that are written at once.
TOGETHER = 1_000


def _folder(path: str):
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system, root.rstrip("/")


class EventSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:  # noqa: N802
        return BatchWriter(self.options["path"], schema.names.index("event"))


@dataclass
class Written(WriterCommitMessage):
    file: str | None


class EventWriter(DataSourceStreamWriter):
    def __init__(self, path: str, event: int):
        self.path, self.event = path, event

    def write(self, rows: Iterator) -> Written:
        """One file of this task's rows; none where it has none. A row is an event's name and its other columns as JSON."""
        return self._written((row[self.event], {k: v for i, (k, v) in enumerate(row.asDict(True).items()) if i != self.event}) for row in rows)

    def _written(self, events: Iterable[tuple[str | None, dict]]) -> Written:
        system, root = _folder(self.path)
        name, out = f"events-{uuid.uuid4().hex}.sse", None
        texts = (sse(event, {k: v for k, v in fields.items() if v is not None}) for event, fields in events)
        try:
            while some := "".join(islice(texts, TOGETHER)):
                if out is None:
                    system.create_dir(f"{root}/files", recursive=True)
                    out = system.open_output_stream(f"{root}/files/{name}")
                out.write(some.encode())
        finally:
            if out is not None:
                out.close()
        return Written(name if out is not None else None)

    def commit(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        system, root = _folder(self.path)
        files = [m.file for m in messages if m is not None and m.file]
        manifest = f"{root}/batches/{batchId:012}.json"
        if system.get_file_info(manifest).type.name == "File":
            self._remove(files)
            return
        system.create_dir(f"{root}/batches", recursive=True)
        # Written beside and moved, so that a list is there whole or not at all.
        part = f"{root}/batches/.{uuid.uuid4().hex}"
        with system.open_output_stream(part) as f:
            f.write(json.dumps(files).encode())
        system.move(part, manifest)

    def abort(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        self._remove([m.file for m in messages if m is not None and m.file])

    def _remove(self, files: list[str]) -> None:
        system, root = _folder(self.path)
        for name in files:
            if system.get_file_info(f"{root}/files/{name}").type.name == "File":
                system.delete_file(f"{root}/files/{name}")


class BatchWriter(EventWriter, DataSourceStreamArrowWriter):
    """The same from Arrow batches, as Spark sends them: no row of its own is made of each event."""

    def write(self, batches: Iterator) -> Written:
        def events() -> Iterator:
            for b in batches:
                for row in b.to_pylist(maps_as_pydicts="lossy"):
                    yield row.pop(b.schema.names[self.event]), row

        return self._written(events())


def _text(value: object) -> str:
    """Times are written in the session's zone, without naming it, as rows hold them."""
    return str(value.replace(tzinfo=None) if isinstance(value, datetime) else value)


_encode = json.JSONEncoder(default=_text, ensure_ascii=False, sort_keys=True).encode


def sse(event: str | None, data: dict) -> str:
    """One server-sent event; line ends cannot break it, for JSON writes them as escapes."""
    name = " ".join((event or "message").split())
    return f"event: {name}\ndata: {_encode(data)}\n\n"


def written(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Writes all that a stream (event, other columns) has now to a folder of events."""
    spark = stream.sparkSession
    ship(spark)
    spark.dataSource.register(EventSink)
    stream.writeStream.format(FORMAT).option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def committed(spark: SparkSession, path: str) -> DataFrame:
    """The events (value, as text) of the files on the lists of a folder of events."""
    batches = spark.read.schema("value string").text(f"{path}/batches/*.json")
    names = {n for r in batches.toLocalIterator() for n in json.loads(r["value"])}
    if not names:
        return spark.createDataFrame([], "value string")
    return spark.read.schema("value string").text([f"{path}/files/{n}" for n in sorted(names)], lineSep="\n\n")
