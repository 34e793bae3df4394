"""The catalog: a versioned JSON manifest of nested workspaces.

Version n is the file n.json, which is only ever created where there is none: of two writers one gets the version, the
other a conflict. A file that a writer left unfinished counts as absent: readers take the version before, and after STALE
seconds the next writer replaces it. Data are plain Parquet folders that Spark writes, never changed, so a reader
of one version sees one state. With no root everything stays in memory, which serves to wrap DataFrames.
"""

from __future__ import annotations

import copy
import json
import time
import uuid
from typing import Any

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

from ..schema import DimensionSpec, TensorSpec


#: Seconds after which an unreadable version is taken for a dead writer's.
STALE = 60.0


class ConflictError(RuntimeError):
    """Another writer committed first."""


class Files:
    """The few file operations that the manifest needs, through Hadoop, as the root may be any store."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark._jvm
        self.root = root.rstrip("/")
        self.path = lambda name: self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        self.fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        p = self.path(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(p)] if self.fs.exists(p) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """False if the file is there already."""
        try:
            stream = self.fs.create(self.path(name), False)
        except Exception as e:
            if "exist" in str(e).lower():
                return False
            raise
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def age(self, name: str) -> float:
        return time.time() - self.fs.getFileStatus(self.path(name)).getModificationTime() / 1000

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def empty() -> dict[str, Any]:
    return {"dims": {}, "tensors": {}, "workspaces": {}}


class Catalog:
    """State of one root: the manifest as last read or changed, and wrapped frames."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root, self.frames = spark, root, {}
        self.files = Files(spark, root) if root else None
        self.version, self.tree, self.depth, self.written = 0, empty(), 0, []
        self.refresh()

    # -- versions

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.files.names("_manifest") if n.endswith(".json")) if self.files else [self.version]

    def refresh(self) -> None:
        """Read the newest version; inside a transaction the state at its start holds."""
        if self.files and not self.depth:
            for version in reversed(self.versions()):
                if self.finished(version):
                    return self.load(version)

    def load(self, version: int) -> None:
        self.version, self.tree = version, json.loads(self.files.read(f"_manifest/{version:012d}.json"))

    def finished(self, version: int) -> bool:
        try:
            return isinstance(json.loads(self.files.read(f"_manifest/{version:012d}.json")), dict)
        except (ValueError, Py4JError):  # a writer is at it, or died
            return False

    def commit(self) -> None:
        if self.depth:
            return
        if self.files:
            new, text = self.version + 1, json.dumps(self.tree)
            name = f"_manifest/{new:012d}.json"
            if not self.files.create(name, text):
                dead = not self.finished(new) and self.files.age(name) > STALE
                if dead:
                    self.files.delete(name)
                if not dead or not self.files.create(name, text):
                    self.refresh()
                    raise ConflictError(f"version {new} is another writer's; nothing was changed")
        self.version += 1
        self.written.clear()

    def rollback(self, tree: dict[str, Any]) -> None:
        self.tree = tree
        for path in self.written:
            if self.files:
                self.files.delete(path)
        self.written.clear()

    def change(self, f: Any) -> Any:
        """Apply f to the tree and commit; an error leaves the tree, and the root, as they were."""
        before = copy.deepcopy(self.tree)
        try:
            out = f(self.tree)
            self.commit()
        except BaseException:
            if not self.depth:
                self.rollback(before)
                self.refresh()
            else:
                self.tree = before
            raise
        return out

    # -- nodes

    def node(self, path: tuple[str, ...], tree: dict[str, Any] | None = None) -> dict[str, Any]:
        at = self.tree if tree is None else tree
        for name in path:
            if name not in at["workspaces"]:
                raise AttributeError(f"no workspace {'.'.join(path)!r}")
            at = at["workspaces"][name]
        return at

    def tensor(self, path: tuple[str, ...], name: str) -> TensorSpec:
        return TensorSpec.from_json(self.node(path)["tensors"][name])

    def dimension(self, path: tuple[str, ...], name: str) -> DimensionSpec:
        return DimensionSpec(**self.node(path)["dims"][name])

    # -- data

    def frame(self, path: str) -> DataFrame:
        """Rows of a segment: idx and its columns."""
        return self.frames[path] if path in self.frames else self.spark.read.parquet(f"{self.root}/{path}")

    def write(self, rows: DataFrame) -> str:
        """New data files, sorted by idx so that row groups can be skipped; nobody sees them before a commit."""
        path = f"data/{uuid.uuid4().hex}"
        if not self.root:
            self.frames[path] = rows
            return path
        self.written.append(path)
        rows.sortWithinPartitions("idx").write.option("compression", "zstd").parquet(f"{self.root}/{path}")
        return path
