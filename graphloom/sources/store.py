"""A graph store of Parquet files: collections by key bucket, with versions and a manifest.

A commit writes new files into a folder of its own and then a manifest with the next number; the
manifest with the highest number holds. What is being read is never overwritten, and a job that is
lost at any point leaves the old state. Changes are kept as delta files beside the buckets, and the
buckets that they touch are rewritten only when there are several, or a policy needs the state.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import merge

#: Key buckets of a collection.
BUCKETS = 64
#: So many delta files of a collection are merged when it is read; one more and they are compacted.
MAX_DELTAS = 8
#: Manifests that are kept, so that a reader of the one before is not cut off.
KEPT_MANIFESTS = 3


class GraphStore:
    """Collections under a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    # -- small files, through Hadoop's file system, so that any shared storage serves

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _numbers(self, name: str) -> dict[int, object]:
        """The numbered files of a name, with their paths."""
        fs, p = self._fs(f"{self.path}/{name}")
        if not fs.exists(p.getParent()):
            return {}
        stem = p.getName() + "."
        found = {s.getPath().getName()[len(stem) :]: s.getPath() for s in fs.listStatus(p.getParent()) if s.getPath().getName().startswith(stem)}
        return {int(n): path for n, path in found.items() if n.isdigit()}

    def _read(self, name: str) -> dict | None:
        numbers = self._numbers(name)
        if not numbers:
            return None
        fs, _ = self._fs(self.path)
        stream = fs.open(numbers[max(numbers)])
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _write(self, name: str, data: dict) -> None:
        """Write the next number of a name: under another name first, so that it appears whole; the
        number before it stays until then."""
        numbers = self._numbers(name)
        following = max(numbers, default=0) + 1
        fs, p = self._fs(f"{self.path}/{name}.{following:012d}")
        fs.mkdirs(p.getParent())
        temporary = self._fs(f"{self.path}/{name}.{uuid.uuid4().hex}-new")[1]
        stream = fs.create(temporary, True)
        stream.write(bytearray(json.dumps(data).encode()))
        stream.close()
        if fs.exists(p) or not fs.rename(temporary, p):
            fs.delete(temporary, False)
            raise RuntimeError(f"{name}: another writer has committed number {following}")
        for number in sorted(numbers)[: -(KEPT_MANIFESTS - 1)]:
            fs.delete(numbers[number], False)

    # -- collections

    def collections(self) -> list[str]:
        fs, p = self._fs(self.path)
        if not fs.exists(p):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory() and not s.getPath().getName().startswith("_"))

    def manifest(self, collection: str) -> dict:
        """version, buckets (bucket -> folder, within the collection's own), deltas (folders, in the
        order of their commits) and columns of the documents."""
        return self._read(f"{collection}/manifest") or {"version": 0, "buckets": {}, "deltas": [], "columns": None}

    def _rows(self, collection: str, folders: list[str]) -> DataFrame:
        rows = self.spark.read.option("mergeSchema", "true").parquet(*[f"{self.path}/{collection}/{f}" for f in folders]).drop("_bucket")
        if "_seq_place" not in rows.columns:
            return rows
        place = F.coalesce("_seq_place", F.lit(0)).cast("decimal(10,0)") * F.lit(merge.PLACE_UNIT)
        return rows.withColumn("_seq", (F.col("_seq").cast("decimal(20,0)") + place).cast(merge.PLACED_SEQ)).drop("_seq_place")

    def state(self, collection: str, only: list[int] | None = None) -> DataFrame | None:
        """The rows of a collection with sequences and tombstones; of the given buckets only. Its
        deltas are merged in."""
        manifest = self.manifest(collection)
        base = [f for b, f in sorted(manifest["buckets"].items()) if only is None or int(b) in only]
        deltas = manifest["deltas"]
        if not base and not deltas:
            return None
        if not deltas:
            return self._rows(collection, base)
        changes = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [self._rows(collection, [f]).withColumn("_late", F.lit(i)) for i, f in enumerate(deltas)])
        if only is not None:
            changes = changes.where(self._bucket().isin(only))
        target = self._rows(collection, base) if base else changes.drop("_late").limit(0)
        return merge.newest(target, changes, "_late")

    def documents(self, collection: str) -> DataFrame | None:
        state = self.state(collection)
        return None if state is None else merge.live(state)

    def replace(self, collection: str, documents: DataFrame) -> None:
        """Write a collection anew: sequences and tombstones of the old one are gone."""
        rows = documents.withColumn("_seq", F.lit(None).cast("bigint")).withColumn("_deleted", F.lit(False))
        self._commit(collection, rows, keep={})

    def replace_state(self, collection: str, rows: DataFrame) -> None:
        """Write a collection anew from rows with sequences and tombstones."""
        self._commit(collection, rows, keep={})

    def load(self, collection: str, rows: DataFrame, on_duplicate: str = "replace", sequence: int | None = None) -> None:
        """Bulk load by key into a collection, by merge.load_state: sequences and tombstones stay."""
        state = self.state(collection)
        if state is None:
            state = rows.limit(0).withColumn("_seq", F.lit(None).cast("bigint")).withColumn("_deleted", F.lit(False))
        for c in merge.fields_of(rows):
            if c not in state.columns:
                state = state.withColumn(c, F.lit(None).cast(rows.schema[c].dataType))
        self._commit(collection, merge.load_state(state, rows, on_duplicate, sequence), keep={})

    def drop(self, collection: str) -> None:
        fs, p = self._fs(f"{self.path}/{collection}")
        fs.delete(p, True)

    def rename(self, old: str, new: str) -> None:
        """Rename a collection with its data, sequences and tombstones; the new name must be free."""
        fs, source = self._fs(f"{self.path}/{old}")
        target = self._fs(f"{self.path}/{new}")[1]
        if not fs.exists(source):
            raise ValueError(f"no collection {old!r}")
        if fs.exists(target):
            raise ValueError(f"collection {new!r} is there already")
        if not fs.rename(source, target):
            raise RuntimeError(f"{old!r} could not be renamed")

    def vacuum(self, collection: str) -> int:
        """Delete the folders that the current manifest does not name; returns how many. To be run
        while nothing reads or writes the collection."""
        manifest = self.manifest(collection)
        used = {f.split("/")[0] for f in [*manifest["buckets"].values(), *manifest["deltas"]]}
        fs, p = self._fs(f"{self.path}/{collection}")
        old = [s.getPath() for s in fs.listStatus(p) if s.isDirectory() and s.getPath().getName() not in used] if fs.exists(p) else []
        for path in old:
            fs.delete(path, True)
        return len(old)

    def _bucket(self):
        return F.pmod(F.xxhash64("_key"), F.lit(self.buckets)).cast("int")

    def _folder(self, kind: str) -> str:
        return f"{kind}-{uuid.uuid4().hex}"

    @staticmethod
    def _split_seq(rows: DataFrame) -> DataFrame:
        """Files keep whole sequence and place apart, so that files of both kinds are read together."""
        if dict(rows.dtypes)["_seq"] == "bigint":
            return rows
        place = (F.col("_seq") % 1) * F.lit(int(1 / merge.PLACE_UNIT))
        return rows.withColumn("_seq_place", place.cast("bigint")).withColumn("_seq", F.floor("_seq").cast("bigint"))

    def _commit(self, collection: str, rows: DataFrame, keep: dict[str, str]) -> None:
        manifest = self.manifest(collection)
        folder = self._folder("v")
        at = f"{self.path}/{collection}/{folder}"
        self._split_seq(rows).withColumn("_bucket", self._bucket()).repartition(self.buckets, "_bucket").write.partitionBy("_bucket").parquet(at)
        fs, p = self._fs(at)
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        written = {n.split("=")[1]: f"{folder}/{n}" for n in names if "=" in n}
        columns = sorted(c for c in rows.columns if c not in merge.META)
        self._write(f"{collection}/manifest", {"version": manifest["version"] + 1, "buckets": {**keep, **written}, "deltas": [], "columns": columns})

    def _commit_delta(self, collection: str, rows: DataFrame) -> None:
        manifest = self.manifest(collection)
        folder = self._folder("d")
        self._split_seq(rows).write.parquet(f"{self.path}/{collection}/{folder}")
        self._write(f"{collection}/manifest", {**manifest, "version": manifest["version"] + 1, "deltas": [*manifest["deltas"], folder]})

    def compact(self, collection: str) -> None:
        """Merge the deltas of a collection into its buckets; only those that they touch are rewritten."""
        deltas = self.manifest(collection)["deltas"]
        if deltas:
            touched = [r[0] for r in self._rows(collection, deltas).select(self._bucket().alias("b")).distinct().collect()]  # at most a row per bucket
            keep = {b: f for b, f in self.manifest(collection)["buckets"].items() if int(b) not in touched}
            self._commit(collection, self.state(collection, only=touched), keep)

    def merge(self, collection: str, changes: DataFrame, policy: str = "source_wins") -> int:
        """Apply changes to a collection; returns how many there were.

        Under source_wins and last_write_wins the last change of each key is appended as a delta.
        The other policies need to know what exists, and changes with other columns what they
        leave as it is: there the touched buckets are rewritten."""
        keyed = changes.where("_key is not null").persist()
        try:
            count = keyed.count()
            if not count:
                return 0
            manifest = self.manifest(collection)
            if policy in merge.LATEST_POLICIES and manifest["columns"] in (None, sorted(merge.fields_of(keyed))):
                if manifest["columns"] is None:
                    self._commit(collection, merge.latest(keyed), keep={})
                    return count
                self._commit_delta(collection, merge.latest(keyed))
                if len(manifest["deltas"]) + 1 > MAX_DELTAS:
                    self.compact(collection)
                return count
            self.compact(collection)
            touched = [r[0] for r in keyed.select(self._bucket().alias("b")).distinct().collect()]  # at most a row per bucket
            target = self.state(collection, only=touched)
            target = merge.empty_target(keyed) if target is None else target
            for c in merge.fields_of(keyed):
                if c not in target.columns:
                    target = target.withColumn(c, F.lit(None).cast(keyed.schema[c].dataType))
            keep = {b: f for b, f in self.manifest(collection)["buckets"].items() if int(b) not in touched}
            self._commit(collection, merge.apply_changes(target, keyed, policy), keep)
            return count
        finally:
            keyed.unpersist()

    # -- batches and the named graph

    def _batches(self) -> dict:
        return self._read("_batches") or {"before": 0, "done": []}

    def has_batch(self, batch: object) -> bool:
        known = self._batches()
        return isinstance(batch, int) and 0 <= batch < known["before"] or str(batch) in known["done"]

    def note_batch(self, batch: object) -> None:
        """Note a batch as applied. Numbers that follow on each other are kept as their end alone."""
        known = self._batches()
        before, done = known["before"], {*known["done"], str(batch)}
        while str(before) in done:
            done.discard(str(before))
            before += 1
        self._write("_batches", {"before": before, "done": sorted(done)})

    def write_graph(self, name: str, definition: list[dict]) -> None:
        self._write(f"_graph_{name}", {"name": name, "edge_definitions": definition})

    def graph(self, name: str) -> dict | None:
        return self._read(f"_graph_{name}")

    def describe(self) -> dict[str, dict]:
        """Collection -> its version and the names of its properties."""
        return {c: {"version": self.manifest(c)["version"], "properties": [n for n in (self.documents(c) or self.spark.range(0)).columns if not n.startswith("_")]} for c in self.collections()}
