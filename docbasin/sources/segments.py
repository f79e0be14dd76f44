"""Tables in immutable segments under one manifest: several tables change together, and readers switch to the change at once.

A store is a folder. Each write adds a segment: a folder for each table, `<table>/segment=<id>`, and `dead/segment=<id>`, the
tombstones: pairs (key, segment) of rows in older segments that this write replaces or deletes. Then a manifest,
`manifest/v<n>.json`, names the segments that belong to version n. A version is claimed before its manifest is put into
place by a rename, so of two writers one fails; a write that fails before that leaves files that no version names.

A reader takes the newest manifest and reads what it names, whatever happens meanwhile. Rows of a table with the key column
are live if no tombstone names their key and segment. Tables without it hold figures that add up: a write adds rows for
what it brings and negative ones for what it kills, so the sum over all segments is the figure of the live rows.

Compaction writes the live rows of several segments as one. Vacuum removes files that the newest versions don't name.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tombstones up to which they are broadcast (a key and a number each; keys are ids).
BROADCAST_DEAD = 500_000
DEAD = "dead"


class Conflict(RuntimeError):
    """Another writer was first; read the newest version and write again."""


class Files:
    """The few calls to the store's own file system, whichever it is."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        where = self.path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(where)) if self.fs.exists(where) else []

    def text(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        out = self.fs.create(self.path(name), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def claim(self, name: str) -> bool:
        return self.fs.createNewFile(self.path(name))

    def rename(self, old: str, new: str) -> bool:
        return self.fs.rename(self.path(old), self.path(new))

    def remove(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


@dataclass(frozen=True)
class Snapshot:
    """One version of a store. `tables`: name -> schema and the column that its folders are split by, or None."""

    spark: SparkSession
    root: str
    key: str
    version: int
    segments: tuple[dict, ...]
    tables: dict[str, dict]
    notes: dict

    def rows(self, table: str, parts: list | None = None, segments: list[int] | None = None) -> DataFrame:
        """All rows of a table with their segment, dead ones too; `parts` names values of the split column to read."""
        known = self.tables.get(table)
        if known is None:
            raise KeyError(table)
        split, paths = known["split"], []
        for s in self.segments:
            if table not in s["tables"] or (segments is not None and s["id"] not in segments):
                continue
            own = f"{self.root}/{table}/segment={s['id']}"
            paths += [own] if parts is None or split is None else [f"{own}/{split}={p}" for p in sorted(set(parts) & set(s["tables"][table]["parts"]))]
        schema = f"{known['schema']}, segment long"
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{table}").parquet(*paths)

    def dead(self) -> DataFrame:
        return self.rows(DEAD)

    def n_dead(self) -> int:
        return sum(s["n_dead"] for s in self.segments)

    def table(self, table: str, parts: list | None = None) -> DataFrame:
        """The live rows of a table."""
        rows = self.rows(table, parts)
        return self.living(rows).drop("segment")

    def living(self, rows: DataFrame) -> DataFrame:
        """Those of `rows` (with key and segment) that no tombstone names."""
        if not self.n_dead() or self.key not in rows.columns:
            return rows
        gone = self.dead().select(self.key, F.col("of").alias("segment"))
        return rows.join(F.broadcast(gone) if self.n_dead() <= BROADCAST_DEAD else gone, [self.key, "segment"], "left_anti")


def _name(version: int) -> str:
    return f"manifest/v{version:09d}.json"


def latest(spark: SparkSession, root: str, key: str) -> Snapshot:
    """The newest version; version 0, without tables, of a folder that holds none."""
    root = root.rstrip("/")
    files = Files(spark, root)
    names = [n for n in files.names("manifest") if n.startswith("v") and n.endswith(".json")]
    if not names:
        return Snapshot(spark, root, key, 0, (), {}, {})
    m = json.loads(files.text(f"manifest/{names[-1]}"))
    return Snapshot(spark, root, m["key"], m["version"], tuple(m["segments"]), m["tables"], m["notes"])


def _publish(base: Snapshot, segments: list[dict], tables: dict, notes: dict) -> Snapshot:
    files, version = Files(base.spark, base.root), base.version + 1
    if not files.claim(f"manifest/claim{version:09d}"):
        raise Conflict(f"version {version} is taken")
    try:
        draft = f"manifest/draft-{uuid.uuid4().hex}"
        files.put(draft, json.dumps({"key": base.key, "version": version, "segments": segments, "tables": tables, "notes": notes}))
        if not files.rename(draft, _name(version)):
            raise Conflict(f"version {version} is there")
    except BaseException:
        files.remove(f"manifest/claim{version:09d}")
        raise
    return Snapshot(base.spark, base.root, base.key, version, tuple(segments), tables, notes)


class Write:
    """One segment in the making. Tables are written one by one, and can be read back for the next; `commit` makes them one version."""

    def __init__(self, base: Snapshot):
        self.base, self.id = base, uuid.uuid4().int >> 80
        self.held: dict[str, dict] = {}
        self.tables = dict(base.tables)
        self.n_dead = 0

    def add(self, table: str, rows: DataFrame, split: str | None = None) -> DataFrame:
        """Writes `rows` (already in the order and partitions that they shall have) and reads them back."""
        where = f"{self.base.root}/{table}/segment={self.id}"
        writer = rows.write.mode("overwrite")
        (writer.partitionBy(split) if split else writer).parquet(where)
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        parts = []
        if split:
            kind = int if rows.schema[split].dataType.simpleString() in ("int", "bigint") else str
            parts = [kind(n.split("=", 1)[1]) for n in Files(self.base.spark, self.base.root).names(f"{table}/segment={self.id}") if n.startswith(f"{split}=")]
        if table != DEAD and table in self.base.tables and self.base.tables[table]["schema"] != fields:
            raise ValueError(f"{table} has columns {self.base.tables[table]['schema']}, not {fields}")
        self.held[table] = {"parts": sorted(parts)}
        self.tables[table] = {"schema": fields, "split": split}
        return self.base.spark.read.schema(rows.schema).parquet(where)

    def kill(self, table: str, keys: DataFrame, parts: list | None = None) -> DataFrame:
        """Tombstones for the live rows of `table` (or those parts of it) with these keys -> key, of (their segment)."""
        rows = self.base.living(self.base.rows(table, parts)) if table in self.base.tables else None
        if rows is None or not self.base.segments:
            return self.base.spark.createDataFrame([], self.base.spark.createDataFrame([], keys.schema).withColumn("of", F.lit(0).cast("long")).schema)
        hit = rows.select(self.base.key, F.col("segment").alias("of")).distinct().join(keys.distinct(), self.base.key, "left_semi")
        dead = self.add(DEAD, hit)
        self.n_dead = dead.count()
        return dead

    def commit(self, notes: dict | None = None) -> Snapshot:
        """The new version; the old one itself if nothing was written or killed."""
        made = {"id": self.id, "tables": self.held, "n_dead": self.n_dead}
        return _publish(self.base, [*self.base.segments, made], self.tables, {**self.base.notes, **(notes or {})})


def compact(base: Snapshot, rewrite: dict[str, Callable[[DataFrame], DataFrame]] | None = None, keep: int = 0) -> Snapshot:
    """All segments but the first `keep` as one, without their dead rows. `rewrite` gives a table's order and partitions, by name."""
    kept, merged = base.segments[:keep], base.segments[keep:]
    if len(merged) < 2 and not (merged and base.n_dead()):
        return base
    job = Write(base)
    ids = [s["id"] for s in merged]
    for name, known in base.tables.items():
        if name == DEAD:
            continue
        rows = base.living(base.rows(name, segments=ids)).drop("segment")
        job.add(name, (rewrite or {}).get(name, lambda r: r)(rows), known["split"])
    if kept and base.n_dead():  # tombstones of rows in the segments that stay
        rest = base.dead().where(F.col("of").isin([s["id"] for s in kept])).select(base.key, "of")
        job.n_dead = job.add(DEAD, rest).count()
        kept = tuple(s | {"n_dead": 0, "tables": {t: v for t, v in s["tables"].items() if t != DEAD}} for s in kept)
    made = {"id": job.id, "tables": job.held, "n_dead": job.n_dead}
    return _publish(base, [*kept, made], job.tables, base.notes)


def vacuum(base: Snapshot, versions: int = 1) -> list[str]:
    """Removes what none of the last `versions` versions names; returns the folders. No write may be under way."""
    files = Files(base.spark, base.root)
    manifests = [n for n in files.names("manifest") if n.startswith("v")]
    used = reduce(set.union, ({(t, s["id"]) for s in json.loads(files.text(f"manifest/{n}"))["segments"] for t in s["tables"]} for n in manifests[-versions:]), set())
    gone = []
    for table in base.tables:
        for n in files.names(table):
            if n.startswith("segment=") and (table, int(n[8:])) not in used:
                files.remove(f"{table}/{n}")
                gone.append(f"{table}/{n}")
    for n in manifests[:-versions]:
        files.remove(f"manifest/{n}")
    return gone
