"""Numbered states of a folder: data is written aside, and one renamed manifest makes it the state that readers see."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer committed first."""


class Versions:
    """Manifests ``v-<n>.json`` below ``path`` and data folders beside them.

    Data folders are never changed once written. A writer that dies before its manifest is renamed leaves folders that no
    state names, so the former state stays what it was; ``vacuum`` removes them. Two writers from one state: the second's
    rename finds the number taken and raises ``Conflict``.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._at = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        top = self._at(f"{self.path}/manifests")
        names = [f.getPath().getName() for f in self._fs.listStatus(top)] if self._fs.exists(top) else []
        return sorted(int(n[2:-5]) for n in names if n.startswith("v-") and n.endswith(".json"))

    def latest(self) -> tuple[int, dict]:
        """Number and state; 0 and an empty state before the first commit."""
        found = self.numbers()
        return (found[-1], self.state(found[-1])) if found else (0, {})

    def state(self, number: int) -> dict:
        stream = self._fs.open(self._at(f"{self.path}/manifests/v-{number}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def folder(self, kind: str = "data") -> str:
        """A new folder to write to, named relative to ``path`` so that the whole can be moved."""
        return f"{kind}/{uuid.uuid4().hex}"

    def at(self, folder: str) -> str:
        return f"{self.path}/{folder}"

    def commit(self, state: dict, after: int) -> int:
        """Make ``state`` the one after number ``after``."""
        made = self._at(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(made, False)
        try:
            out.write(bytearray(json.dumps(state).encode()))
        finally:
            out.close()
        to = self._at(f"{self.path}/manifests/v-{after + 1}.json")
        if self._fs.exists(to) or not self._fs.rename(made, to):
            self._fs.delete(made, False)
            raise Conflict(f"state {after + 1} of {self.path} exists")
        return after + 1

    def vacuum(self, keep: int = 2, kind: str = "data") -> int:
        """Remove data folders that none of the last ``keep`` states names, and older manifests; returns how many folders went."""
        kept = self.numbers()[-keep:]
        named = json.dumps([self.state(n) for n in kept])
        top, gone = self._at(f"{self.path}/{kind}"), 0
        for f in self._fs.listStatus(top) if self._fs.exists(top) else []:
            if f"{kind}/{f.getPath().getName()}" not in named:
                self._fs.delete(f.getPath(), True)
                gone += 1
        for n in self.numbers()[:-keep]:
            self._fs.delete(self._at(f"{self.path}/manifests/v-{n}.json"), False)
        return gone
