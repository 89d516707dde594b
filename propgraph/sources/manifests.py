"""Numbered JSON manifests in a folder, published one after another, each by exactly one writer."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from ..model import GraphError


class Conflict(GraphError):
    """Another writer published that number first."""


class Manifests:
    """A manifest appears whole or not at all: it is written aside, then renamed or linked, which fails if the number exists."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def file(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def numbers(self) -> list[int]:
        fs, p = self.file("")
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self, number: int) -> dict:
        fs, p = self.file(f"{number:012d}.json")
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read_all(self) -> dict[int, dict]:
        return {n: self.read(n) for n in self.numbers()}

    def publish(self, number: int, content: dict) -> None:
        fs, aside = self.file(f".{uuid.uuid4().hex}")
        _, final = self.file(f"{number:012d}.json")
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        try:
            if fs.exists(final) or not (self._link(fs, aside, final) if fs.getScheme() == "file" else fs.rename(aside, final)):
                raise Conflict(f"version {number} was committed by another writer")
        finally:
            if fs.exists(aside):
                fs.delete(aside, False)

    def _link(self, fs, aside, final) -> bool:
        """On a mounted file system, where a rename would overwrite: a link, which only one of several writers can make. Without links it has to be a rename."""
        path = lambda p: self.spark._jvm.java.io.File(p.toUri().getPath()).toPath()
        try:
            self.spark._jvm.java.nio.file.Files.createLink(path(final), path(aside))
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" in str(e.java_exception):
                return False
            return fs.rename(aside, final)
        return True

    def delete(self, number: int) -> None:
        fs, p = self.file(f"{number:012d}.json")
        fs.delete(p, False)
