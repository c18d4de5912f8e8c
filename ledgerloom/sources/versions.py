"""Bucketed tables under one manifest: a version names the files of every bucket, and is there as a whole or not at all.

A folder has ``data/<id>/bucket=k`` folders, written once and never changed, and
``manifests/v<n>.json``. Writers put new data beside the old, then create the next
manifest, which fails if another writer has done so. So a reader sees the old
version until the new one is complete, a failed writer leaves only data that no
manifest names, and a change rewrites the buckets it touches and no others.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .durable import durable


def bucket_of(buckets: int, *columns: str) -> Column:
    """The bucket that rows of equal values share."""
    return F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int")


class Versions:
    """The tables at ``path``: {table: {bucket: folder}} and what else a version says of itself."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, *parts: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def numbers(self) -> list[int]:
        fs, where = self._fs("manifests")
        if not fs.exists(where):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(where)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def current(self) -> dict:
        """The newest whole manifest; one that its writer did not finish is passed over."""
        for n in reversed(self.numbers()):
            text = "".join(r[0] for r in self.spark.read.text(f"{self.path}/manifests/v{n}.json", wholetext=True).collect())
            try:
                return json.loads(text)
            except ValueError:
                continue
        return {"version": 0, "tables": {}}

    def read(self, table: str, buckets=None, manifest: dict | None = None) -> DataFrame:
        """The rows of ``table``, or of some of its buckets; at most one folder for each bucket is read."""
        known = (manifest or self.current())["tables"][table]
        wanted = known["buckets"] if buckets is None else {str(b): known["buckets"].get(str(b)) for b in buckets}
        folders = [f"{self.path}/{f}" for f in wanted.values() if f]
        if not folders:
            return self.spark.createDataFrame([], known["schema"])
        return self.spark.read.schema(known["schema"]).parquet(*folders)

    def put(self, rows: DataFrame, touched, bucket: str = "bucket") -> dict:
        """Write ``rows``, which lie in the buckets ``touched``; the change that ``commit`` takes. Nothing is visible yet."""
        folder = f"data/{uuid.uuid4().hex}"
        schema = rows.drop(bucket).schema
        # one file for each bucket and task; a bucket's rows may lie in several tasks, so that none has to hold it
        rows.withColumnRenamed(bucket, "bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        fs, where = self._fs(folder)
        made = {s.getPath().getName().removeprefix("bucket=") for s in fs.listStatus(where) if s.isDirectory()}
        buckets = {str(b): f"{folder}/bucket={b}" if str(b) in made else None for b in touched}
        return {"schema": schema_text(schema), "buckets": buckets}

    def commit(self, base: dict, changes: dict[str, dict], **said) -> dict:
        """The version after ``base`` with the changed buckets of each table; raises if another writer made it first."""
        tables = {t: dict(x) for t, x in base["tables"].items()}
        for table, change in changes.items():
            old = tables.get(table, {"buckets": {}})
            both = {**old["buckets"], **change["buckets"]}
            tables[table] = {"schema": change["schema"], "buckets": {b: f for b, f in both.items() if f}}
        told = {k: v for k, v in base.items() if k not in ("version", "tables")}
        if self.current()["version"] != base["version"]:
            raise ValueError(f"version {base['version'] + 1} of {self.path} was made by another writer")
        # the number of a manifest that its writer did not finish is not used again
        number = max([base["version"], *self.numbers()]) + 1
        made = {**told, **said, "version": number, "tables": tables}
        fs, where = self._fs("manifests", f"v{number}.json")
        stream = fs.create(where, False)  # fails where it exists
        stream.write(json.dumps(made).encode("utf-8"))
        stream.close()
        return made

    def drop(self) -> None:
        fs, where = self._fs()
        fs.delete(where, True)

    def vacuum(self, keep: int = 2) -> int:
        """Delete data that none of the last ``keep`` versions names, and older manifests; returns how many folders went."""
        numbers = self.numbers()
        kept = set()
        for n in numbers[-keep:]:
            text = "".join(r[0] for r in self.spark.read.text(f"{self.path}/manifests/v{n}.json", wholetext=True).collect())
            kept |= {f.split("/")[1] for t in json.loads(text)["tables"].values() for f in t["buckets"].values()}
        fs, where = self._fs("data")
        gone = [s.getPath() for s in fs.listStatus(where) if s.getPath().getName() not in kept]
        for p in gone:
            fs.delete(p, True)
        for n in numbers[:-keep]:
            f, p = self._fs("manifests", f"v{n}.json")
            f.delete(p, False)
        return len(gone)


def schema_text(schema) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)


class Collection:
    """Points by id, in buckets of it, with vectors of one length.

    Defined results: of points with one id in an upsert the last in payload order stays; a
    point replaces that of its id; points without an id, or with a vector of another length,
    are refused as a whole, before anything is written; deleting ids that are not there does nothing.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "point_id", vector: str = "vector"):
        self.versions, self.key, self.vector = Versions(spark, path), key, vector

    def _now(self) -> dict:
        return {"dimensions": None, "buckets": 64} | self.versions.current()

    def ensure(self, dimensions: int | None = None, buckets: int = 64) -> dict:
        """Create the collection where it is not there; raises if it is there with other dimensions."""
        now = self._now()
        if now["version"] == 0:
            return self.versions.commit(now, {}, dimensions=dimensions, buckets=buckets)
        if dimensions is not None and now["dimensions"] != dimensions:
            raise ValueError(f"the collection has {now['dimensions']} dimensions, not {dimensions}")
        return now

    def read(self) -> DataFrame:
        return self.versions.read("points")

    def _touched(self, ids: DataFrame, now: dict) -> tuple[DataFrame, list[int]]:
        rows = durable(ids.withColumn("bucket", bucket_of(now["buckets"], self.key)), "points")
        return rows, sorted(r[0] for r in rows.select("bucket").distinct().collect())  # no more than there are buckets

    def _rest(self, now: dict, ids: DataFrame, touched: list[int]) -> DataFrame | None:
        if "points" not in now["tables"]:
            return None
        old = self.versions.read("points", touched, now)
        return old.join(ids.select(self.key), self.key, "left_anti").withColumn("bucket", bucket_of(now["buckets"], self.key))

    def upsert(self, points: DataFrame) -> DataFrame:
        """Put ``points`` in, reading and writing only their buckets; the new table."""
        now = self._now()
        bad = F.col(self.key).isNull()
        if now["dimensions"] is not None:
            bad = bad | F.coalesce(F.size(self.vector) != now["dimensions"], F.lit(True))
        if not points.filter(bad).isEmpty():
            raise ValueError("points without an id or with a vector of another length")
        payload = F.max(F.struct(*[c for c in points.columns if c != self.key])).alias("p")
        last, touched = self._touched(points.groupBy(self.key).agg(payload).select(self.key, "p.*"), now)
        rest = self._rest(now, last, touched)
        both = last if rest is None else rest.select(last.columns).unionByName(last)
        made = self.versions.commit(now, {"points": self.versions.put(both, touched)})
        return self.versions.read("points", manifest=made)

    def delete(self, ids: DataFrame) -> DataFrame:
        """Take the points of ``ids`` out; the new table."""
        now = self._now()
        gone, touched = self._touched(ids.select(self.key).distinct(), now)
        rest = self._rest(now, gone, touched)
        if rest is None:
            raise ValueError("the collection has no points")
        made = self.versions.commit(now, {"points": self.versions.put(rest, touched)})
        return self.versions.read("points", manifest=made)

    def drop(self) -> None:
        self.versions.drop()
