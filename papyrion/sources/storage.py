"""A document store on any file system that Spark reads: assets, JSON, listings; source registry and input."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Registry:
    """Readers by source type; a later registration of a type wins."""

    def __init__(self):
        self.readers: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

    def register(self, kind: str, reader: Callable[[SparkSession, str], DataFrame]) -> None:
        self.readers[kind] = reader

    def resolve(self, kind: str) -> Callable[[SparkSession, str], DataFrame]:
        if kind not in self.readers:
            raise KeyError(f"no reader for {kind!r}; registered: {', '.join(sorted(self.readers)) or 'none'}")
        return self.readers[kind]


def parse_input(value: str) -> dict[str, str]:
    """A url if it has a scheme, else a path."""
    scheme = value.split("://", 1)[0] if "://" in value else ""
    return {"url": value} if scheme and scheme[0].isalpha() and all(c.isalnum() or c in "+.-" for c in scheme) else {"path": value}


class Store:
    """Files under root/doc_id, through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def resolve(self, ref: str) -> str:
        return f"{self.root}/{ref}"

    def put(self, doc_id: str, name: str, data: bytes) -> str:
        """Write bytes; returns the reference doc_id/name."""
        path = self.jvm.org.apache.hadoop.fs.Path(self.resolve(f"{doc_id}/{name}"))
        out = path.getFileSystem(self.conf).create(path, True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()
        return f"{doc_id}/{name}"

    def exists(self, doc_id: str, name: str) -> bool:
        path = self.jvm.org.apache.hadoop.fs.Path(self.resolve(f"{doc_id}/{name}"))
        return path.getFileSystem(self.conf).exists(path)

    def put_json(self, doc_id: str, name: str, value) -> str:
        return self.put(doc_id, name, json.dumps(value, indent=2, ensure_ascii=False).encode())

    def get_json(self, doc_id: str, name: str):
        """The value of a JSON file, None if there is no such file."""
        path = self.jvm.org.apache.hadoop.fs.Path(self.resolve(f"{doc_id}/{name}"))
        if not path.getFileSystem(self.conf).exists(path):
            return None
        row = self.spark.read.text(self.resolve(f"{doc_id}/{name}"), wholetext=True).first()
        return json.loads(row[0]) if row else None

    def list(self, doc_id: str) -> list[str]:
        """Names of all files of a document, sorted; empty without a folder."""
        folder = self.jvm.org.apache.hadoop.fs.Path(self.resolve(doc_id))
        if not folder.getFileSystem(self.conf).exists(folder):
            return []
        base = f"/{doc_id}/"
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(self.resolve(doc_id)).select("path")
        return sorted(r[0].rsplit(base, 1)[-1] for r in files.select(F.col("path")).collect())
