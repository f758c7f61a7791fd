"""Durable keyed tables: merges, patches and deletions that persist.

A table is a folder. Rows lie in buckets by the hash of their key; a write rewrites the buckets it touches into a new data folder, and then commits a manifest
that says which folder holds each bucket. The manifest is renamed into place under the next version's number, which fails if another writer was
first: a write that is lost, or comes second, leaves the version before untouched, and readers see one version or the next, never a mixture.

A write may carry the name of its transaction. A name that is already in the history changes nothing, so a repeated micro-batch is not applied twice.
Manifests are bounded by the number of buckets and the names kept (KEEP_NAMES). vacuum() removes data that no kept version names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import state
from . import scratch

KEEP_NAMES = 1000


class Conflict(RuntimeError):
    """Another writer committed first."""


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: str, buckets: int = 16):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets
        self.schema = T.DataType.fromDDL(schema)

    # --- versions ---
    def _file(self, version: int) -> str:
        return f"{self.path}/versions/{version:012d}.json"

    def version(self) -> int:
        """The last committed version; 0 before any."""
        found = [n for n in scratch.names(self.spark, f"{self.path}/versions") if n.endswith(".json")]
        return int(found[-1].removesuffix(".json")) if found else 0

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"buckets": {}, "names": []}
        return json.loads(scratch.read_text(self.spark, self._file(version)))

    def _commit(self, base: int, manifest: dict) -> None:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        draft = hadoop(f"{self.path}/drafts/{uuid.uuid4().hex}")
        fs = draft.getFileSystem(self.spark._jsc.hadoopConfiguration())
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        fs.mkdirs(hadoop(f"{self.path}/versions"))
        if not scratch.rename(self.spark, draft.toString(), self._file(base + 1)):
            scratch.delete(self.spark, draft.toString())
            raise Conflict(f"version {base + 1} of {self.path} was committed by another writer")

    # --- reads ---
    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(self.manifest(version))

    def _rows(self, manifest: dict, only: set[int] | None = None) -> DataFrame:
        folders = [f"{self.path}/data/{folder}/bucket={b}" for b, folder in manifest["buckets"].items() if only is None or int(b) in only]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k).cast(self.schema[k].dataType) for k in self.keys]), F.lit(self.buckets)).cast("int")

    # --- writes ---
    def _write(self, touched: set[int], make: Callable[[DataFrame], DataFrame], name: str | None, base: int, manifest: dict) -> bool:
        if not touched:
            return False
        folder = uuid.uuid4().hex
        rows = make(self._rows(manifest, touched)).select(*[F.col(f.name).cast(f.dataType) for f in self.schema])
        # one task writes a bucket's file; buckets are to be many enough for that
        rows.withColumn("bucket", self._bucket()).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
        written = {int(n.removeprefix("bucket=")) for n in scratch.names(self.spark, f"{self.path}/data/{folder}") if n.startswith("bucket=")}
        buckets = {b: f for b, f in manifest["buckets"].items() if int(b) not in touched} | {str(b): folder for b in written}
        self._commit(base, {"buckets": buckets, "names": [*manifest["names"], *([name] if name else [])][-KEEP_NAMES:]})
        return True

    def _start(self, name: str | None) -> tuple[int, dict] | None:
        base = self.version()
        manifest = self.manifest(base)
        return None if name and name in manifest["names"] else (base, manifest)

    def upsert(self, new: DataFrame, ignore: bool = False, order: str | None = None, name: str | None = None) -> bool:
        """Merges rows by key, or with `ignore` adds the new keys alone: see state.upsert. Tells whether it wrote. Rows with a null key are refused."""
        start = self._start(name)
        if start is None:
            return False
        base, manifest = start
        new = scratch.stored(new)
        missing = F.lit(False)
        for k in self.keys:
            missing = missing | F.col(k).isNull()
        found = new.select(missing.alias("bad"), self._bucket().alias("b")).groupBy("b").agg(F.max("bad").alias("bad")).collect()  # at most `buckets` rows
        if any(r.bad for r in found):
            raise ValueError(f"a key of {self.keys} is null")
        done = self._write({r.b for r in found}, lambda old: state.upsert(old, new, self.keys, ignore, order), name, base, manifest)
        scratch.discard(new)
        return done

    def _matching(self, manifest: dict, test: Column) -> set[int]:
        rows = self._rows(manifest).where(test)
        return {r.b for r in rows.select(self._bucket().alias("b")).distinct().collect()}

    def update(self, test: Column, patch: dict[str, Column], name: str | None = None) -> bool:
        """Changes the rows for which the test is true; no keys."""
        if set(patch) & set(self.keys):
            raise ValueError("a patch can't change a key")
        start = self._start(name)
        return bool(start) and self._write(self._matching(start[1], test), lambda old: state.update(old, test, patch), name, *start)

    def delete(self, test: Column, name: str | None = None) -> bool:
        start = self._start(name)
        return bool(start) and self._write(self._matching(start[1], test), lambda old: state.delete(old, test), name, *start)

    def vacuum(self, keep: int = 2) -> int:
        """Removes versions before the last `keep`, and data that no other names; a writer at work must not run meanwhile. Returns the folders removed."""
        last = self.version()
        kept = [v for v in range(max(1, last - keep + 1), last + 1)]
        named = {f for v in kept for f in self.manifest(v)["buckets"].values()}
        for n in scratch.names(self.spark, f"{self.path}/versions"):
            if n.endswith(".json") and int(n.removesuffix(".json")) not in kept:
                scratch.delete(self.spark, f"{self.path}/versions/{n}")
        gone = [f for f in scratch.names(self.spark, f"{self.path}/data") if f not in named]
        for f in gone:
            scratch.delete(self.spark, f"{self.path}/data/{f}")
        return len(gone)


# --- the named writes ---
ENTITIES = "key string, slug string, name string, entity_type string, aliases array<string>"
EVENTS = "id string, event_key string, slug string, title string, occurred_on string, trust_tier string, penalty_inr double, outcome string, summary string"
LINKS = "event_id string, entity_key string, role string"
STORIES = "url string, source string, headline string, score int, action_taken string, processed_at timestamp"
DOCUMENTS = "id string, url string, title string, is_primary boolean"
EVIDENCE = "action_id string, official_url string, content_hash string, excerpt string, strength string"


class Store:
    """The tables a run writes, each merged by its own key."""

    def __init__(self, spark: SparkSession, place: str, buckets: int = 16):
        make = lambda name, keys, schema: KeyedTable(spark, f"{place.rstrip('/')}/{name}", keys, schema, buckets)
        self.entities = make("entities", ["key"], ENTITIES)
        self.events = make("events", ["id"], EVENTS)
        self.links = make("event_entities", ["event_id", "entity_key", "role"], LINKS)
        self.stories = make("stories", ["url"], STORIES)
        self.documents = make("documents", ["id"], DOCUMENTS)
        self.evidence = make("evidence", ["action_id", "official_url"], EVIDENCE)

    def persist_graph(self, entities: DataFrame, events: DataFrame, links: DataFrame, name: str | None = None) -> None:
        """Entities and events are merged, links added once. A repeated name changes nothing, and after a failure in between the rest is made up for."""
        self.entities.upsert(entities, name=name)
        self.events.upsert(events, name=name)
        self.links.upsert(links, ignore=True, name=name)

    def record_stories(self, stories: DataFrame, name: str | None = None) -> bool:
        """A story's first record stays."""
        return self.stories.upsert(stories, ignore=True, order="processed_at", name=name)

    def record_documents(self, documents: DataFrame, name: str | None = None) -> bool:
        return self.documents.upsert(documents, ignore=True, name=name)

    def record_evidence(self, evidence: DataFrame, name: str | None = None) -> bool:
        return self.evidence.upsert(evidence, name=name)
