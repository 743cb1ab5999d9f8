"""Numbered states of a store of tables; the highest number is the one that holds."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Manifest:
    """States in ``folder``, one small JSON file each.

    A file is written beside its place and renamed into it, so a reader meets
    whole states alone, and a writer that dies leaves the state before. Writers
    take turns: a number that is there already is refused.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.folder = folder.rstrip("/")

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _fs(self):
        return self._path("").getFileSystem(self._conf)

    def numbers(self) -> list[int]:
        """The states' numbers, ascending."""
        fs = self._fs()
        if not fs.exists(self._path("")):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(self._path(""))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self, number: int) -> dict:
        stream = self._fs().open(self._path(f"{number}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def latest(self) -> tuple[int, dict]:
        """(number, state) of the highest; (-1, {}) where there is none."""
        numbers = self.numbers()
        return (numbers[-1], self.read(numbers[-1])) if numbers else (-1, {})

    def commit(self, number: int, state: dict) -> None:
        fs, goal, aside = self._fs(), self._path(f"{number}.json"), self._path(f".{number}-{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        out.write(json.dumps(state, sort_keys=True).encode())
        out.close()
        if fs.exists(goal) or not fs.rename(aside, goal):
            fs.delete(aside, False)
            raise FileExistsError(f"{goal} is there already")
