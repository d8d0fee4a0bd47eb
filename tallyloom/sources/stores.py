"""A keyed store of Parquet folders with published snapshots.

What a store holds is said by its newest manifest: a base folder, in which each key stands once, and the folders that were added since. A writer fills a new folder,
checks it, and publishes a manifest by renaming it into place: readers see all of a write or nothing, and a writer that dies leaves a folder
that no manifest names, which vacuum() removes. Folders hold their rows by bucket of the key.
"""

from __future__ import annotations

import json
import uuid
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.storage import _path


class KeyedStore:
    """Rows keyed by `key` for each model; compute only what is missing, upsert by key.

    Another model's entries are in another folder, so they are neither read nor overwritten. Of what was added since the base was made a key keeps the last `version`; that wins over the base.
    One writer at a time for each model; any number of readers.
    """

    def __init__(self, spark: SparkSession, path: str, model: str, value_schema: str, key_schema: str = "key string", buckets: int = 16):
        self.spark, self.root, self.model, self.buckets = spark, f"{path}/model={quote(model, safe='')}", model, buckets
        self.key = key_schema.split()[0]
        self.schema = T.StructType.fromDDL(f"{key_schema}, {value_schema}, version long, bucket int")
        self.values = [f.name for f in self.schema.fields if f.name not in (self.key, "version", "bucket")]

    # manifests

    def _manifests(self) -> dict[int, str]:
        fs, at = _path(self.spark, f"{self.root}/manifest")
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return {int(n[:-5]): f"{self.root}/manifest/{n}" for n in names if n.endswith(".json") and n[:-5].isdigit()}

    def _load(self, uri: str) -> dict:
        fs, at = _path(self.spark, uri)
        size = fs.getFileStatus(at).getLen()
        stream = fs.open(at)
        try:
            return json.loads(bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, size)))
        finally:
            stream.close()

    def manifest(self) -> dict:
        """The newest snapshot: {"number", "base": a folder or null, "added": folders}."""
        there = self._manifests()
        return {"number": 0, "base": None, "added": []} if not there else self._load(there[max(there)])

    def _publish(self, before: dict, base: str | None, added: list[str]) -> None:
        number = before["number"] + 1
        fs, target = _path(self.spark, f"{self.root}/manifest/{number:012d}.json")
        half = _path(self.spark, f"{self.root}/manifest/{uuid.uuid4().hex}.part")[1]
        out = fs.create(half)
        try:
            out.write(bytearray(json.dumps({"number": number, "base": base, "added": added}).encode()))
        finally:
            out.close()
        if fs.exists(target) or not fs.rename(half, target):
            fs.delete(half, False)
            raise RuntimeError(f"another writer has published snapshot {number} of {self.root}")

    # rows

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _folders(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).option("basePath", self.root).parquet(*folders) if len(folders) == 1 else self._folders(folders[:1]).unionByName(self._folders(folders[1:]))

    def _rows(self, snapshot: dict) -> DataFrame:
        """(key, values..., version, bucket), each key once: what was added since is put in order, the base is only looked up against it."""
        base = self._folders([snapshot["base"]] if snapshot["base"] else [])
        if not snapshot["added"]:
            return base
        added = self._folders(snapshot["added"]).groupBy(self.key, "bucket").agg(F.max_by(F.struct(*self.values, "version"), "version").alias("v")).select(self.key, "v.*", "bucket")
        return base.join(added.select(self.key, "bucket"), [self.key, "bucket"], "left_anti").select(*self.schema.names).unionByName(added.select(*self.schema.names))

    def read(self) -> DataFrame:
        """(key, values...) of the newest snapshot; later writes don't change it."""
        return self._rows(self.manifest()).select(self.key, *self.values)

    def _write(self, rows: DataFrame) -> str:
        folder = f"{self.root}/rows-{uuid.uuid4().hex}"
        typed = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields])
        typed.repartition(self.buckets, "bucket").write.partitionBy("bucket").parquet(folder)
        return folder

    def add(self, rows: DataFrame, version: int) -> None:
        """Add rows (key, values...), all or none: refused (ValueError) if a key or a value is null, or a key is there twice."""
        before = self.manifest()
        folder = self._write(rows.withColumns({"version": F.lit(version).cast("long"), "bucket": self._bucket()}))
        fs, at = _path(self.spark, folder)
        if not any(s.isDirectory() for s in fs.listStatus(at)):  # no rows
            fs.delete(at, True)
            return
        seen = self._folders([folder])
        lost = seen.agg(F.count_if(F.col(self.key).isNull()).alias("key"), *[F.count_if(F.col(v).isNull()).alias(v) for v in self.values]).first().asDict()
        twice = seen.groupBy(self.key).count().where("count > 1").limit(1).collect()
        if any(lost.values()) or twice:
            fs.delete(at, True)
            raise ValueError(f"rows without {', '.join(k for k, n in lost.items() if n)}" if any(lost.values()) else f"{self.key} {twice[0][0]} is there twice")
        self._publish(before, before["base"], [*before["added"], folder])

    def compact(self) -> None:
        """Make one base folder of the snapshot, each key once. Folders of before stay for readers until vacuum()."""
        before = self.manifest()
        if before["added"]:
            self._publish(before, self._write(self._rows(before)), [])

    def vacuum(self, keep: int = 1) -> int:
        """Remove folders that none of the `keep` newest snapshots names, and older manifests; returns how many folders went."""
        there = self._manifests()
        live = [self._load(there[n]) for n in sorted(there)[-keep:]]
        named = {f.rsplit("/", 1)[1] for m in live for f in [m["base"], *m["added"]] if f}
        fs, at = _path(self.spark, self.root)
        gone = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName().startswith("rows-") and s.getPath().getName() not in named] if fs.exists(at) else []
        for path in gone:
            fs.delete(path, True)
        for n in sorted(there)[:-keep]:
            fs.delete(_path(self.spark, there[n])[1], False)
        return len(gone)

    # questions

    def missing(self, keys: DataFrame) -> DataFrame:
        """Rows of keys (a frame with the key column) that the store doesn't have."""
        return keys.join(self.read().select(self.key), self.key, "left_anti")

    def lookup(self, wanted: DataFrame, order: str) -> DataFrame:
        """wanted (with key and order) and the values, in the caller's order, one row for each of wanted's; raises KeyError if a key is absent.

        The bucket is part of the question, so that only folders of buckets that are asked for are read where few are.
        """
        rows = self._rows(self.manifest()).select(self.key, "bucket", *self.values, F.lit(True).alias("_there"))
        got = wanted.withColumn("bucket", self._bucket()).join(rows, [self.key, "bucket"], "left").drop("bucket")
        lost = got.where(F.col("_there").isNull()).agg(F.count("*").alias("n"), F.min(self.key).alias("first")).first()
        if lost.n:
            raise KeyError(f"{lost.n} keys aren't in the store, the first is {lost.first}")
        return got.drop("_there").orderBy(order)
