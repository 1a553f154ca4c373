"""A stream source that follows growing files of JSON lines.

The built-in file source takes a file as finished; here an offset is, for every file, how
many bytes up to the last line feed have been delivered. Old lines are not replayed: the
initial offset is what is there at the start. A file that comes later is delivered from its beginning, a truncated
one from its new end on, and a line counts once its line feed is written.
"""

from __future__ import annotations

import json
import os

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType


class Span(InputPartition):
    """Bytes start..end of a file."""

    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def sizes(base: str) -> dict[str, int]:
    """Bytes up to the last line feed of every .jsonl file below base."""
    out = {}
    for folder, _, names in os.walk(base):
        for n in names:
            if n.endswith(".jsonl"):
                path = os.path.join(folder, n)
                try:
                    out[path] = _whole(path)
                except OSError:
                    continue
    return out


def _whole(path: str) -> int:
    with open(path, "rb") as f:
        end = f.seek(0, os.SEEK_END)
        while end:
            start = max(0, end - 65536)
            f.seek(start)
            at = f.read(end - start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            end = start
    return 0


class TailReader(DataSourceStreamReader):
    """Reads the bytes between two offsets."""

    def __init__(self, options: dict):
        self.base = options["path"]

    def initialOffset(self) -> dict:
        return {"files": json.dumps(sizes(self.base), sort_keys=True)}

    def latestOffset(self) -> dict:
        return {"files": json.dumps(sizes(self.base), sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        old, new = json.loads(start["files"]), json.loads(end["files"])
        return [Span(p, old.get(p, 0), n) for p, n in new.items() if n > old.get(p, 0)]

    def read(self, partition: Span):
        with open(partition.path, "rb") as f:
            f.seek(partition.start)
            for line in f.read(partition.end - partition.start).split(b"\n"):
                if line.strip():
                    yield line.decode("utf-8", "replace"), partition.path

    def commit(self, end: dict) -> None:
        """Nothing to release."""


class TailSource(DataSource):
    """spark.readStream.format('tail_jsonl').load(path): (value, path)."""

    @classmethod
    def name(cls) -> str:
        return "tail_jsonl"

    def schema(self) -> str:
        return "value string, path string"

    def streamReader(self, schema: StructType) -> TailReader:
        return TailReader(self.options)
