"""A keyed table in hashed buckets that an upsert rewrites only where it must (K6).

Layout under ``path``::

    data/<version>/store_bucket=<n>/part-*.parquet    files, never changed once written
    manifest/<number>.json                      the table after so many commits

A manifest names, for each bucket, the version whose files hold it. An upsert
rewrites the buckets its keys fall into under a fresh version, then creates the next
manifest, last and in one step that fails if the number is taken. So readers see the
old table or the new one, a run that dies leaves the old table as it was (its files are
unreferenced until :meth:`BucketStore.vacuum`), and of two writers one is told to start
again. Files are reached through Hadoop's file systems only.

A key's bucket is ``pmod(xxhash64(key), buckets)``, fixed when the store is created: choose
so many that a bucket is a few files (1,000 buckets of 1 GB hold a terabyte).
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class CommitConflict(RuntimeError):
    """Another writer has committed since this one read the table."""


class BucketStore:
    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64):
        """``buckets`` counts for a new store; an existing one keeps its own."""
        self.spark, self.path, self.key, self.new_buckets = spark, path.rstrip("/"), key, buckets

    # ------------------------------------------------------------- files
    def _file(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def _system(self):
        return self._file().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _children(self, name: str) -> list[str]:
        system, folder = self._system(), self._file(name)
        return sorted(s.getPath().getName() for s in system.listStatus(folder)) if system.exists(folder) else []

    def manifest(self) -> dict:
        """The newest manifest: number, buckets, schema, marks, files (bucket -> version)."""
        names = [n for n in self._children("manifest") if n.endswith(".json")]
        if not names:
            return {"number": 0, "buckets": self.new_buckets, "schema": None, "marks": {}, "files": {}}
        stream = self._system().open(self._file("manifest", max(names)))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> None:
        """Create the next manifest; the text is complete before it gets its name, and a name is given once."""
        from py4j.protocol import Py4JJavaError

        sc, system = self.spark.sparkContext, self._system()
        draft = self._file("manifest", f".{uuid.uuid4().hex}.draft")
        stream = system.create(draft, False)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        final = self._file("manifest", f"{manifest['number']:012d}.json")
        context = sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), sc._jsc.hadoopConfiguration())
        options = sc._gateway.new_array(getattr(sc._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)  # none: never overwrite
        try:
            context.rename(system.makeQualified(draft), system.makeQualified(final), options)
        except Py4JJavaError as error:
            system.delete(draft, False)
            if "FileAlreadyExists" in str(error.java_exception.getClass().getName()):
                raise CommitConflict(f"{final} is there already: read the table again") from error
            raise

    # ------------------------------------------------------------- table
    def _bucket(self, buckets: int):
        return F.pmod(F.xxhash64(self.key), F.lit(buckets)).cast("int")

    def _load(self, manifest: dict, only: set[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(manifest["schema"])
        paths = [f"{self.path}/data/{version}/store_bucket={bucket}" for bucket, version in manifest["files"].items()
                 if only is None or int(bucket) in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        """The table as of the newest manifest."""
        manifest = self.manifest()
        if manifest["schema"] is None:
            raise FileNotFoundError(f"{self.path} holds no table yet")
        return self._load(manifest)

    def marks(self) -> dict:
        """Small notes that were committed with the table."""
        return self.manifest()["marks"]

    def upsert(self, incoming: DataFrame, deletes: DataFrame | None = None, marks: dict | None = None) -> dict:
        """Rows of ``incoming`` replace those of their keys, keys of ``deletes`` go; returns the new manifest.

        ``incoming`` has one row per key (two of one key would both stay). A column that the table lacks is added
        (null in older rows), one that ``incoming`` lacks is null in its rows.
        """
        manifest = self.manifest()
        buckets, version = manifest["buckets"], uuid.uuid4().hex
        keys = incoming.select(self.key)
        keys = keys if deletes is None else keys.unionByName(deletes.select(self.key))
        touched = {r[0] for r in keys.select(self._bucket(buckets)).distinct().collect()}  # at most ``buckets`` numbers
        if touched:
            rows = incoming
            if manifest["schema"] is not None:
                kept = self._load(manifest, touched).join(keys, self.key, "left_anti")
                rows = kept.unionByName(incoming, allowMissingColumns=True)
            schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in rows.schema.fields])
            # a bucket's rows come together in one task, in several if it is large
            (rows.withColumn("store_bucket", self._bucket(buckets)).hint("rebalance", F.col("store_bucket"))
             .write.partitionBy("store_bucket").parquet(f"{self.path}/data/{version}"))
            written = {int(n.split("=")[1]) for n in self._children(f"data/{version}") if n.startswith("store_bucket=")}
            files = {b: v for b, v in manifest["files"].items() if int(b) not in touched}
            manifest |= {"schema": json.loads(schema.json()), "files": files | {str(b): version for b in written}}
        elif manifest["schema"] is None:
            manifest |= {"schema": json.loads(incoming.schema.json())}
        manifest |= {"number": manifest["number"] + 1, "marks": manifest["marks"] | (marks or {})}
        self._commit(manifest)
        return manifest

    def vacuum(self) -> list[str]:
        """Delete versions that the newest manifest does not name (no reader or writer may be at work)."""
        kept = set(self.manifest()["files"].values())
        gone = [v for v in self._children("data") if v not in kept]
        for version in gone:
            self._system().delete(self._file("data", version), True)
        return gone
