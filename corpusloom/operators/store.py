"""The index: documents and chunks as versioned Parquet, written in proportion to what changes.

A version is one numbered file in the folder `_log`, made in one step and only where there is none yet: of two writers that
begin from the same version one wins, the other gets a Conflict and nothing of it goes live. The file names the segments of
documents, chunks and tombstones that make up the version; segments are folders that are written once. A change writes rows of
what it changes: a segment for new and changed documents, one for their chunks, and one with the ids whose older rows are gone.
Reads merge: a row counts unless a tombstone of its document is as new as its segment. When TIER segments of one tier have
gathered, they become one of the next tier, so a row is rewritten once a tier. vacuum() frees what no retained version names.
Paths go through Hadoop's file system interface, so the index can lie wherever Spark can read and write.
"""

from __future__ import annotations

import contextlib
import json
import os
import re
import time
import uuid
from dataclasses import dataclass, replace
from functools import reduce
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.numbering import numbered
from corpusloom.operators.tables import partitions
from corpusloom.schemas import CHUNKS, DOCUMENTS

#: Segments of one tier that become one of the next.
TIER = 8
#: Folders that a large segment of chunks is dealt to by document, and the documents of a change from which on it is.
BUCKETS = 64
BUCKETED = 1_000
#: Tombstones up to which reads send them to all tasks; beyond, they join by shuffle.
BROADCAST_GONE = 1 << 20
#: Seconds for which vacuum() keeps older versions, and folders that a writer may not have committed yet.
RETENTION = 7 * 86_400
_GONE = "doc_id long, until long"
_KINDS = {"documents": ("id", DOCUMENTS), "chunks": ("doc_id", CHUNKS)}
_FOLDER = re.compile(r"(documents|chunks|gone)-\d+-[0-9a-f]{12}")


def bucket_of(doc_id) -> F.Column:
    """The folder of a document's chunks."""
    return F.pmod(F.xxhash64(doc_id), F.lit(BUCKETS)).cast("int")


def by_bucket(chunks: DataFrame) -> DataFrame:
    """Chunks dealt out so that a task writes few folders: a segment then has a few files for each task, not one for each task
    and folder. Chunks of one document may lie in several tasks."""
    n = partitions(chunks.sparkSession)
    share = F.pmod(F.xxhash64("doc_id", "chunk_idx"), F.lit(-(-4 * n // BUCKETS)))
    return chunks.repartition(n, bucket_of(F.col("doc_id")), share)


class Conflict(RuntimeError):
    """Another writer published a version first."""


class Written(NamedTuple):
    version: int
    documents: int
    chunks: int


@dataclass
class Index:
    spark: SparkSession
    path: str
    dimension: int = 1024
    #: The version that reads see; None: the newest.
    pinned: int | None = None

    # Files

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, folder: str) -> dict[str, float]:
        """Names in a folder and when they were last changed, in seconds; none where there is no folder."""
        fs, p = self._fs(folder)
        if not fs.exists(p):
            return {}
        return {s.getPath().getName(): s.getModificationTime() / 1000 for s in fs.listStatus(p)}

    def _read_text(self, path: str) -> str:
        fs, p = self._fs(path)
        stream = fs.open(p)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _create(self, path: str, text: str) -> bool:
        """Makes a file with this text in one step; False where there is one already."""
        fs, p = self._fs(path)
        fs.mkdirs(p.getParent())
        beside = f"{path}.{uuid.uuid4().hex}.tmp"
        _, temp = self._fs(beside)
        out = fs.create(temp, True)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if fs.getUri().getScheme() == "file":  # whose rename would replace what is there
                os.link(temp.toUri().getPath(), p.toUri().getPath())
                return True
            context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.spark._jsc.hadoopConfiguration())
            how = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
            options = self.spark.sparkContext._gateway.new_array(how, 1)
            options[0] = how.NONE
            context.rename(temp, p, options)
            return True
        except FileExistsError:
            return False
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in str(e.java_exception):
                raise
            return False
        finally:
            fs.delete(temp, False)

    # Versions

    def _entry(self, version: int) -> str:
        return f"{self.path}/_log/{version:020}.json"

    def versions(self) -> list[int]:
        """The versions that can be read, oldest first."""
        return sorted(int(n.removesuffix(".json")) for n in self._names(f"{self.path}/_log") if re.fullmatch(r"\d{20}\.json", n))

    def _live(self) -> dict | None:
        newest = self.pinned or max(self.versions(), default=None)
        return None if newest is None else json.loads(self._read_text(self._entry(newest)))

    @property
    def version(self) -> int | None:
        return self.pinned or max(self.versions(), default=None)

    @property
    def stored_dimension(self) -> int | None:
        live = self._live()
        return live and live["dimension"]

    def at(self, version: int | None = None) -> Index:
        """This index as of a version, whatever is published later; None: as of now."""
        return replace(self, pinned=version or self.version)

    def high(self, kind: str) -> int:
        """The highest id that documents or chunks have had."""
        return self._live()["high"][kind]

    def open(self) -> Index:
        """Creates an empty index where there is none; refuses one of another dimension."""
        if self.version is None:
            with contextlib.suppress(Conflict):  # then another has made it
                self.publish(self.spark.createDataFrame([], DOCUMENTS), self.spark.createDataFrame([], CHUNKS))
        if self.stored_dimension != self.dimension:
            raise ValueError(f"the index has {self.stored_dimension} dimensions, not {self.dimension}; reset it first")
        return self

    def _commit(self, base: int, state: dict) -> int:
        """Makes the state the version after `base`."""
        now = base + 1
        if not self._create(self._entry(now), json.dumps(state | {"version": now, "at": time.time()})):
            raise Conflict(f"another writer published version {now} since version {base} was read")
        return now

    # Writing

    def _checked(self, chunks: DataFrame) -> DataFrame:
        wrong = F.col("embedding").isNotNull() & (F.size("embedding") != self.dimension)
        checked = F.when(wrong, F.raise_error(F.concat(F.lit("a vector has dimension "), F.size("embedding").cast("string")))).otherwise(F.col("embedding"))
        return chunks.withColumn("embedding", checked).select(*CHUNKS.names)

    def _segment(self, kind: str, version: int, rows: DataFrame, tier: int = 0, bucketed: bool = False) -> tuple[list[dict], int]:
        """Writes a segment: (its entry, or none where it has no rows; its highest id or version). bucketed: in folders by
        document, without a shuffle."""
        name = f"{kind}-{version}-{uuid.uuid4().hex[:12]}"
        if bucketed:
            rows.withColumn("bucket", bucket_of(F.col("doc_id"))).write.partitionBy("bucket").parquet(f"{self.path}/{name}")
        else:
            rows.write.parquet(f"{self.path}/{name}")
        n, high = self.spark.read.schema(rows.schema).parquet(f"{self.path}/{name}").agg(F.count("*"), F.max("until" if kind == "gone" else "id")).first()
        if not n:
            fs, p = self._fs(f"{self.path}/{name}")
            fs.delete(p, True)
            return [], 0
        entry = {"name": name, "written": version, "rows": n, "tier": tier, "bucketed": bucketed}
        if kind == "gone":
            entry["until"] = high
            entry["buckets"] = sorted(r[0] for r in self._rows(entry, _GONE).select(bucket_of(F.col("doc_id"))).distinct().collect())
        return [entry], high

    def publish(self, documents: DataFrame, chunks: DataFrame) -> Written:
        """Makes a version live that has these documents and chunks only; ids go on from theirs."""
        base = self.version or 0
        docs, high_doc = self._segment("documents", base + 1, documents.select(*DOCUMENTS.names))
        pieces, high_chunk = self._segment("chunks", base + 1, self._checked(chunks), bucketed=_many(docs))
        state = {"dimension": self.dimension, "documents": docs, "chunks": pieces, "gone": [], "high": {"documents": high_doc, "chunks": high_chunk}}
        return Written(self._commit(base, state), sum(s["rows"] for s in docs), sum(s["rows"] for s in pieces))

    def append(self, documents: DataFrame, chunks: DataFrame, replaced: DataFrame) -> Written:
        """Makes a version live that has these rows besides those of the version this index is at, but for documents and chunks
        of the ids in `replaced` (doc_id): a changed document is in both, a deleted one in `replaced` only. Only the given
        rows are written. Raises Conflict where another version came first."""
        live = self._live()
        base = live["version"]
        docs, high_doc = self._segment("documents", base + 1, documents.select(*DOCUMENTS.names))
        pieces, high_chunk = self._segment("chunks", base + 1, self._checked(chunks), bucketed=_many(docs))
        gone, _ = self._segment("gone", base + 1, replaced.select("doc_id", F.lit(base).cast("long").alias("until")).distinct())
        more = {"documents": docs, "chunks": pieces, "gone": gone}
        high = {"documents": max(high_doc, live["high"]["documents"]), "chunks": max(high_chunk, live["high"]["chunks"])}
        now = self._commit(base, live | {k: live[k] + v for k, v in more.items()} | {"high": high})
        with contextlib.suppress(Conflict):  # the other writer's next change compacts
            replace(self, pinned=None).compact()
        return Written(now, sum(s["rows"] for s in docs), sum(s["rows"] for s in pieces))

    def compact(self) -> int | None:
        """Merges tiers that have gathered TIER segments, and drops tombstones that concern no segment any more; returns the new
        version, or None where nothing was due."""
        live = self._live()
        now = live["version"] + 1
        state, due = dict(live), False
        for kind in ("documents", "chunks", "gone"):
            for tier in sorted({s["tier"] for s in live[kind]}):
                some = [s for s in state[kind] if s["tier"] == tier]
                if len(some) < TIER:
                    continue
                due = True
                rows = self._tombstones(some) if kind == "gone" else self._alive(kind, some, live["gone"])
                merged, _ = self._segment(kind, now, rows, tier + 1, kind == "chunks" and sum(s["rows"] for s in some) >= BUCKETED)
                state[kind] = [s for s in state[kind] if s not in some] + merged
        if not due:
            return None
        oldest = min((s["written"] for kind in _KINDS for s in state[kind]), default=now)
        state["gone"] = [g for g in state["gone"] if g["until"] >= oldest]
        return self._commit(live["version"], state)

    # Reading

    def _rows(self, segment: dict, schema) -> DataFrame:
        """A segment's rows, with the column `bucket` where it is in folders by document."""
        return self.spark.read.schema(schema).parquet(f"{self.path}/{segment['name']}")

    def _tombstones(self, gone: list[dict]) -> DataFrame:
        """(doc_id, until), the last of each document."""
        return reduce(DataFrame.unionByName, [self._rows(g, _GONE) for g in gone]).groupBy("doc_id").agg(F.max("until").alias("until"))

    def _alive(self, kind: str, segments: list[dict], gone: list[dict], doc_id: int | None = None) -> DataFrame:
        """The rows that no tombstone voids; of one document, if given, from its folders only. Only segments that are older than
        some tombstone meet them, and of those only the folders that tombstones are about."""
        key, schema = _KINDS[kind]
        bucket = None
        if doc_id is not None:
            bucket = self.spark.range(1).select(bucket_of(F.lit(doc_id).cast("long"))).first()[0]
            gone = [g for g in gone if bucket in g["buckets"]]
        last = max((g["until"] for g in gone), default=-1)
        touched = sorted({b for g in gone for b in g["buckets"]})
        parts, older = [], []
        for s in segments:
            rows = self._rows(s, schema)
            if doc_id is not None:
                rows = rows.filter((F.col("bucket") == bucket) & (F.col(key) == doc_id) if s["bucketed"] else F.col(key) == doc_id)
            if s["written"] > last:  # newer than any tombstone
                parts.append(rows.select(*schema.names))
                continue
            if s["bucketed"] and doc_id is None and len(touched) < BUCKETS:
                parts.append(rows.filter(~F.col("bucket").isin(touched)).select(*schema.names))
                rows = rows.filter(F.col("bucket").isin(touched))
            older.append(rows.select(*schema.names, F.lit(s["written"]).cast("long").alias("__written")))
        if older:
            dead = self._tombstones(gone).withColumnRenamed("doc_id", key)
            dead = dead if doc_id is None else dead.filter(F.col(key) == doc_id)
            dead = F.broadcast(dead) if sum(g["rows"] for g in gone) <= BROADCAST_GONE else dead
            kept = reduce(DataFrame.unionByName, older).join(dead, key, "left").filter("until IS NULL OR __written > until")
            parts.append(kept.select(*schema.names))
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema)

    def documents(self) -> DataFrame:
        live = self._live()
        return self._alive("documents", live["documents"], live["gone"])

    def chunks(self, doc_id: int | None = None) -> DataFrame:
        """All chunks, or those of one document, which are read from its folder of each large segment."""
        live = self._live()
        return self._alive("chunks", live["chunks"], live["gone"], doc_id)

    def reset(self, force: bool = False, dimension: int | None = None) -> Written:
        """Publishes an empty version, perhaps of another dimension; numbers start anew. Asks for `force`. What older versions
        hold is freed by vacuum()."""
        if not force:
            raise PermissionError("reset() drops every document; call it with force=True")
        self.dimension = dimension or self.dimension
        return self.publish(self.spark.createDataFrame([], DOCUMENTS), self.spark.createDataFrame([], CHUNKS))

    def vacuum(self, keep: float = RETENTION, now: float | None = None) -> dict[str, list]:
        """Forgets versions older than `keep` seconds, but never the newest, and deletes the folders that no version left names
        and that are older than that too. Returns the versions and folders that went. A writer that takes longer than `keep`
        from its first folder to its commit may lose it."""
        newest, since = self.version, (time.time() if now is None else now) - keep
        entries = {v: json.loads(self._read_text(self._entry(v))) for v in self.versions()}
        old = [v for v, e in entries.items() if v != newest and e["at"] < since]
        named = {s["name"] for v, e in entries.items() if v not in old for kind in ("documents", "chunks", "gone") for s in e[kind]}
        folders = [n for n, changed in self._names(self.path).items() if _FOLDER.fullmatch(n) and n not in named and changed < since]
        for gone in (*map(self._entry, old), *(f"{self.path}/{n}" for n in folders)):  # versions first: nobody opens them then
            fs, p = self._fs(gone)
            fs.delete(p, True)
        return {"versions": old, "folders": sorted(folders)}


def _many(docs: list[dict]) -> bool:
    return sum(s["rows"] for s in docs) >= BUCKETED


def changed_documents(known: DataFrame, new: DataFrame, high) -> DataFrame:
    """The document rows that merging (path, content_hash) into `known` by path writes: (id, path, content_hash, created_at,
    is_new). A hash is replaced where one is given, times and ids stay, new paths get ids after `high` in their order. Known
    paths whose hash stays are left out."""
    one = new.groupBy("path").agg(F.max("content_hash").alias("new_hash"))
    both = one.join(known.select("path", "id", "content_hash", "created_at"), "path", "left")
    changed = both.filter("id IS NOT NULL AND new_hash IS NOT NULL AND NOT new_hash <=> content_hash")
    fresh = numbered(both.filter("id IS NULL").select("path", "new_hash"), "path", "n")
    added = fresh.select((high + F.col("n")).alias("id"), "path", F.col("new_hash").alias("content_hash"), F.current_timestamp().alias("created_at"), F.lit(True).alias("is_new"))
    return changed.select("id", "path", F.col("new_hash").alias("content_hash"), "created_at", F.lit(False).alias("is_new")).unionByName(added)


def upsert_documents(known: DataFrame, new: DataFrame) -> DataFrame:
    """All documents after merging (path, content_hash) into them: the changed ones and the others as they were."""
    high = known.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    changed = changed_documents(known, new, F.lit(high)).drop("is_new")
    return known.join(changed.select("id"), "id", "left_anti").select(*changed.columns).unionByName(changed)


def delete_chunks(chunks: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """Chunks of other documents than those in column `doc_id`."""
    return chunks.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_anti").select(*chunks.columns)
