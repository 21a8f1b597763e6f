"""Generations of a graph on shared storage: written whole, then pointed to."""

from __future__ import annotations

import uuid
from collections import OrderedDict

from pyspark.sql import DataFrame, SparkSession

TABLES = ("nodes", "edges", "hyperedges", "communities", "manifest", "query_pairs", "outcomes")


class Store:
    """A folder of any file system that Spark writes. Readers see one generation, whatever is being written."""

    def __init__(self, spark: SparkSession, root: str, keep: int = 3):
        self.spark, self.root = spark, root.rstrip("/")
        self.cached: OrderedDict[str, dict[str, DataFrame]] = OrderedDict()
        self.keep = keep

    def _fs(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def current(self) -> str:
        """The generation that is pointed to; a store without one is an error, and nothing is created."""
        fs, path = self._fs()
        pointer = path(f"{self.root}/CURRENT")
        if not fs.exists(pointer):
            raise FileNotFoundError(f"no graph in {self.root}")
        return self.spark.read.text(f"{self.root}/CURRENT").first()["value"]

    def publish(self, tables: dict[str, DataFrame]) -> str:
        """Write all tables as a new generation, then turn the pointer. Tables that aren't given are carried over."""
        fs, path = self._fs()
        try:
            old = self.read()
        except FileNotFoundError:
            old = {}
        generation = uuid.uuid4().hex
        for name, df in {**old, **tables}.items():
            if name not in TABLES:
                raise ValueError(f"unknown table {name!r}")
            df.write.parquet(f"{self.root}/generation={generation}/{name}")
        fresh = path(f"{self.root}/.CURRENT.{generation}")
        out = fs.create(fresh, True)
        out.write(bytearray(generation.encode()))
        out.close()
        fs.delete(path(f"{self.root}/CURRENT"), False)
        fs.rename(fresh, path(f"{self.root}/CURRENT"))
        return generation

    def read(self, generation: str | None = None) -> dict[str, DataFrame]:
        """The tables of a generation; the last few stay open."""
        generation = generation or self.current()
        if generation not in self.cached:
            fs, path = self._fs()
            folder = f"{self.root}/generation={generation}"
            self.cached[generation] = {n: self.spark.read.parquet(f"{folder}/{n}") for n in TABLES if fs.exists(path(f"{folder}/{n}"))}
            while len(self.cached) > self.keep:
                self.cached.popitem(last=False)
        self.cached.move_to_end(generation)
        return self.cached[generation]
