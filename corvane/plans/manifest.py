"""The manifest of a layered corpus: a small JSON file that names the base and its deltas in order."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession

from corvane.operators.layers import stacked


@dataclass(frozen=True)
class Layer:
    layer_id: str
    path: str
    digest: str


@dataclass(frozen=True)
class Manifest:
    revision: int
    base: Layer
    deltas: tuple[Layer, ...] = field(default_factory=tuple)
    next_vector_id: int = 0

    @property
    def layers(self) -> tuple[Layer, ...]:
        return (self.base, *self.deltas)

    def __post_init__(self) -> None:
        ids = [x.layer_id for x in (self.base, *self.deltas)]
        if len(set(ids)) != len(ids) or not all(ids):
            raise ValueError("layer ids must be there and differ")
        for x in (self.base, *self.deltas):
            if len(x.digest) != 64:
                raise ValueError(f"{x.layer_id}: a digest has 64 characters")
            if PurePosixPath(x.path).is_absolute() or ".." in PurePosixPath(x.path).parts:
                raise ValueError(f"{x.layer_id}: the path must stay inside the root")

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False, sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Manifest:
        d = json.loads(text)
        return Manifest(d["revision"], Layer(**d["base"]), tuple(Layer(**x) for x in d["deltas"]), d.get("next_vector_id", 0))


class ManifestConflict(RuntimeError):
    pass


class ManifestStore:
    """Manifests in a folder of Spark's file system, one file for each revision; the highest is current.

    A revision's file is created once: who finds it there has lost the race and must start again from the new revision.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self.path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        self.fs = self.path("manifest").getFileSystem(spark._jsc.hadoopConfiguration())

    def revisions(self) -> list[int]:
        if not self.fs.exists(self.path("manifest")):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self.path("manifest"))]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def at(self, revision: int) -> Manifest:
        return Manifest.from_json(self.spark.read.text(f"{self.root}/manifest/{revision:012d}.json", wholetext=True).first().value)

    def current(self) -> Manifest | None:
        """The highest revision. Without any, a folder base that is there is an implicit base, as revision 0; else None."""
        found = self.revisions()
        if found:
            return self.at(found[-1])
        return Manifest(0, Layer("base", "base", "0" * 64)) if self.fs.exists(self.path("base")) else None

    def publish(self, new: Manifest, expected: int) -> Manifest:
        current = self.current()
        if (current.revision if current else 0) != expected or new.revision != expected + 1:
            raise ManifestConflict(f"revision {expected} is not current")
        try:
            out = self.fs.create(self.path(f"manifest/{new.revision:012d}.json"), False)
        except Exception as e:
            raise ManifestConflict(f"revision {new.revision} exists") from e
        out.write(bytearray(new.to_json().encode()))
        out.close()
        return new

    def read(self, manifest: Manifest, table: str) -> DataFrame:
        return stacked([self.spark.read.parquet(f"{self.root}/{x.path}/{table}") for x in manifest.layers])
