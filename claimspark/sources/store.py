"""A stored table of claims: point reads, scans by status, and merges that rewrite what they touch.

Rows lie in buckets by a hash of the key, below each bucket in folders by the version that wrote it and by status, ordered by
key, with a Bloom filter on the key in each Parquet file::

    data/_bucket=7/_version=00000012-3f9c2a1b/_status=Active/part-...
    log/00000012.json

A version is a small JSON file that names, for each bucket, the folder with its rows. A merge reads and writes only the
buckets that its keys fall into, beside the folders that are there, and then creates the next version's file: readers see all
of it or nothing, a crash leaves folders that no version names, and untouched buckets keep their files. Two writers at once
are told apart by that file, which is created but never overwritten: the slower one raises and can be tried again.

Keys are unique; rows without one aren't stored. The number of buckets is set when the table is made, and bounds what the
driver holds of it. ``vacuum`` removes the folders of versions that nobody reads any more.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimspark.plans.joins import keyed_upsert
from claimspark.plans.views import cut
from claimspark.sources import files

PLACES = ("_bucket", "_version", "_status")


class StoreConflictError(RuntimeError):
    """Another writer made this version first."""


@dataclass(frozen=True)
class Version:
    number: int
    key: str
    status: str
    buckets: int
    schema: T.StructType
    live: dict[int, str] = field(default_factory=dict)  # bucket: the version folder with its rows
    marks: dict[str, int] = field(default_factory=dict)  # what its writers want to remember

    def text(self) -> str:
        body = {**self.__dict__, "schema": json.loads(self.schema.json())}
        return json.dumps({**body, "complete": True})

    @staticmethod
    def of(text: str) -> Version | None:
        """The version of a file; None for one whose writer died within it."""
        try:
            body = json.loads(text)
        except ValueError:
            return None
        body.pop("complete")
        return Version(**{**body, "schema": T.StructType.fromJson(body["schema"]), "live": {int(b): v for b, v in body["live"].items()}})


class ClaimStore:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    @staticmethod
    def create(rows: DataFrame, path: str, key: str = "claim_id", status: str = "claim_status", buckets: int = 64) -> ClaimStore:
        """A new table with the rows, or the next version of the table at path with these rows alone."""
        store = ClaimStore(rows.sparkSession, path)
        before = store.current()
        made = Version(before.number if before else 0, key, status, buckets, rows.schema, {}, before.marks if before else {})
        store._write(made, rows, None)
        return store

    # versions

    def current(self) -> Version | None:
        return next(iter(self.versions()), None)

    def versions(self):  # noqa: ANN201
        """The complete versions, the last one first."""
        for name in reversed(files.names(self.spark, f"{self.path}/log")):
            version = Version.of(files.read_text(self.spark, f"{self.path}/log/{name}") or "")
            if version:
                yield version

    def _last(self) -> Version:
        version = self.current()
        if version is None:
            raise FileNotFoundError(f"no table at {self.path}")
        return version

    # reading

    def _read(self, version: Version, buckets: list[int] | None = None) -> DataFrame:
        """The rows with PLACES, of all buckets or of some; only the folders of these are listed."""
        schema = T.StructType([*version.schema.fields, *(T.StructField(c, T.StringType()) for c in PLACES)])
        wanted = version.live if buckets is None else {b: version.live[b] for b in buckets if b in version.live}
        if not wanted:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.path}/data/_bucket={b}/_version={v}" for b, v in sorted(wanted.items())]
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*paths)

    def rows(self) -> DataFrame:
        return self._read(self._last()).drop(*PLACES)

    def get(self, key: object) -> DataFrame:
        """The row of one key: one bucket's files, of which statistics and Bloom filters pass over all but those with the key."""
        version = self._last()
        bucket = self.spark.range(1).select(self._bucket(version, F.lit(key).cast(version.schema[version.key].dataType))).first()[0]
        return self._read(version, [bucket]).filter(F.col(version.key) == F.lit(key)).drop(*PLACES)

    def scan(self, status: str = "Active") -> DataFrame:
        """The rows of one status: only the folders of that status are read."""
        version = self._last()
        return self._read(version).filter((F.col("_status") == status) & (F.col(version.status) == status)).drop(*PLACES)

    @staticmethod
    def _bucket(version: Version, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(version.buckets)).cast("int")

    # writing

    def _write(self, version: Version, rows: DataFrame, touched: list[int] | None, marks: dict[str, int] | None = None) -> None:
        """The next version, in which the touched buckets (None: all) hold the rows."""
        name = f"{version.number + 1:08d}-{uuid4().hex[:8]}"
        at = version.schema[version.key].name
        placed = rows.filter(F.col(at).isNotNull()).withColumns({
            "_bucket": self._bucket(version, F.col(at)), "_version": F.lit(name), "_status": F.coalesce(F.col(version.status).cast("string"), F.lit("")),
        })
        parts = min(version.buckets if touched is None else max(1, len(touched)), 4096)
        data = placed.repartition(parts, "_bucket").sortWithinPartitions("_bucket", "_status", at)
        bloom = {f"parquet.bloom.filter.enabled#{at}": "true", f"parquet.bloom.filter.expected.ndv#{at}": "100000"}
        data.write.mode("append").options(**bloom).partitionBy(*PLACES).parquet(f"{self.path}/data")
        wrote = range(version.buckets) if touched is None else touched
        full = {b for b in wrote if f"_version={name}" in files.names(self.spark, f"{self.path}/data/_bucket={b}")}
        live = {b: v for b, v in version.live.items() if b not in set(wrote)} | {b: name for b in sorted(full)}
        schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in rows.schema.fields])
        after = replace(version, number=version.number + 1, schema=schema, live=live, marks={**version.marks, **(marks or {})})
        if not files.create_text(self.spark, f"{self.path}/log/{after.number:08d}.json", after.text()):
            raise StoreConflictError(f"version {after.number} of {self.path} was made by another writer")

    def _touched(self, version: Version, keys: DataFrame) -> list[int]:
        """The buckets of the keys; at most as many as there are buckets."""
        rows = keys.filter(F.col(version.key).isNotNull()).select(self._bucket(version, F.col(version.key)).alias("b")).distinct().collect()
        return sorted(r["b"] for r in rows)

    def upsert(self, new: DataFrame, insert: bool = True, marks: dict[str, int] | None = None, newer: str | None = None) -> None:
        """Sets the columns of new where its key is stored; with insert, other keys become rows. Columns that the table lacks are added.

        With ``newer``, a row is set only where that column of new is greater than the stored one, or the stored one is null.
        """
        version = self._last()
        new = cut(new.filter(F.col(version.key).isNotNull()))
        touched = self._touched(version, new)
        stored = self._read(version, touched).drop(*PLACES)
        if newer is not None and newer in stored.columns:
            known = stored.select(F.col(version.key).alias("_key"), F.col(newer).alias("_stored"))
            new = new.join(known, F.col(version.key) == F.col("_key"), "left").filter(F.col("_stored").isNull() | (F.col(newer) > F.col("_stored"))).drop("_key", "_stored")
        merged = keyed_upsert(stored, new, version.key, insert)
        kinds = {f.name: f.dataType for f in version.schema.fields}
        self._write(version, merged.select(*(F.col(f"`{c}`").cast(kinds[c]) if c in kinds else F.col(f"`{c}`") for c in merged.columns)), touched, marks)

    def delete(self, ids: DataFrame) -> None:
        """Removes the rows whose key is in ids."""
        version = self._last()
        gone = cut(ids.select(version.key).filter(F.col(version.key).isNotNull()).distinct())
        touched = self._touched(version, gone)
        self._write(version, self._read(version, touched).drop(*PLACES).join(gone, version.key, "left_anti").select(*version.schema.names), touched)

    def write_scores(self, scored: DataFrame) -> None:
        """Sets the scores of rows that have one; unknown claims are left out."""
        columns = [c for c in ("predicted_denial_score", "score_quality_flag", "model_version", "scoring_timestamp") if c in scored.columns]
        self.upsert(scored.filter("predicted_denial_score is not null").select(self._last().key, *columns), insert=False)

    def vacuum(self, keep: int = 2) -> int:
        """Removes the folders that none of the last ``keep`` versions names, and older versions' files; how many folders.

        No writer may be at work meanwhile: what it has written isn't named yet.
        """
        versions = list(self.versions())
        named = {(b, v) for version in versions[:keep] for b, v in version.live.items()}
        removed = 0
        for folder in files.names(self.spark, f"{self.path}/data"):
            if folder.startswith("_bucket="):
                for inner in files.names(self.spark, f"{self.path}/data/{folder}"):
                    if (int(folder.split("=")[1]), inner.split("=")[1]) not in named:
                        files.remove(self.spark, f"{self.path}/data/{folder}/{inner}")
                        removed += 1
        for version in versions[keep:]:
            files.remove(self.spark, f"{self.path}/log/{version.number:08d}.json")
        return removed
