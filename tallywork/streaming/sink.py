"""Events of many users as a stream's sink: each user reads a stream that holds the user's own events only, each once.

Tasks write one file for each user that they meet; a batch's files are seen when its list is written, all at once. A batch
that failed leaves no list, its files are removed, and a batch that is repeated after its list was written changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage

from ..plans.files import delete, names, read_text, write_text

EVENT = "type string, user_id long, connection_id long"


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[int, str]] = field(default_factory=list)


class Writer(DataSourceStreamWriter):
    def __init__(self, place: str, columns: list[str]):
        self.place, self.columns = place.rstrip("/"), columns

    def write(self, iterator: Iterator) -> Written:
        lines: dict[int, list[str]] = {}
        for row in iterator:
            event = dict(zip(self.columns, row, strict=True))
            lines.setdefault(event["user_id"], []).append(json.dumps(event))
        out = Written()
        for user, events in lines.items():
            name = f"user={user}/{uuid.uuid4().hex}.jsonl"
            write_text(f"{self.place}/{name}", "\n".join(events) + "\n")
            out.files.append((user, name))
        return out

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        files = [f for m in messages if m is not None for f in m.files]
        listed = f"{self.place}/batches/{batchId:012d}.json"
        if read_text(listed) is None:
            write_text(listed, json.dumps(files))
        else:
            self.drop(files)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self.drop([f for m in messages if m is not None for f in m.files])

    def drop(self, files: list[tuple[int, str]]) -> None:
        for _, name in files:
            delete(f"{self.place}/{name}")


class UserEvents(DataSource):
    """The sink "user_events" for spark.dataSource.register; option path: a folder that driver and executors share."""

    @classmethod
    def name(cls) -> str:
        return "user_events"

    def schema(self) -> str:
        return EVENT

    def streamWriter(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], [f.name for f in schema.fields])


def events_of(spark: SparkSession, place: str, user_id: int, after: int = -1) -> DataFrame:
    """A user's events of the batches after one. The lists name the files, so those of unfinished batches are never read."""
    place, files = place.rstrip("/"), []
    for name in names(f"{place}/batches"):
        batch = int(name.split(".")[0])
        if batch > after:
            files += [f"{place}/{f}" for user, f in json.loads(read_text(f"{place}/batches/{name}")) if user == user_id]
    return spark.read.schema(EVENT).json(files) if files else spark.createDataFrame([], EVENT)
