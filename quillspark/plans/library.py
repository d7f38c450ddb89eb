"""The library of imported packs: immutable generations and a registry that names them.

An import writes a new generation beside the old ones, checks it, and only then
replaces the registry, by writing the new one under another name and renaming it. Readers
resolve the generation once and filter on it, which prunes partitions. Generations no pack names are
deleted afterwards; that this fails cannot undo an import.

One import or clean-up runs at a time, and changes of the registry follow one another: each holds a lock
file that only one caller can create. A driver that dies leaves its lock; ``unlock`` removes it.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import UTC, datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.textnorm import explicit_inflections, fold
from quillspark.operators import integrity
from quillspark.operators.senses import flat_senses
from quillspark.plans.index import unnested, with_head_keys
from quillspark.sources import packs

#: What of an entry is typed; the recursive sense tree stays JSON text.
ENTRY = "id string, headword string, display string, kind string, homograph int, inflections array<struct<type:string,form:string>>, parent struct<id:string,headword:string,relation:string>, pos_groups string"
LOOKUP = "norm string, matches array<struct<entry_id:string,sense_id:string,match:string,headword:string,key_raw:string>>"
TABLES = ["entries", "postings", "forms"]
#: Seconds that a change of the registry waits for another to end.
REGISTRY_WAIT = 30.0


class ImportFailed(ValueError):
    """The first error of a pack that was not imported; what was active stays active."""


class LibraryBusy(RuntimeError):
    """Another caller holds the lock; nothing was changed."""


class Library:
    def __init__(self, spark: SparkSession, root: str, format_name: str = integrity.FORMAT):
        self.spark, self.root, self.format_name = spark, root.rstrip("/"), format_name
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))

    # -- locks --------------------------------------------------------------------------------
    def _lock_path(self, name: str):
        return self._path(f"{self.root}/{name}.lock")

    @contextmanager
    def _locked(self, name: str, wait: float = 0.0) -> Iterator[None]:
        at, until = self._lock_path(name), time.monotonic() + wait
        while True:
            try:
                self._fs.create(at, False).close()
                break
            except Py4JJavaError as error:
                if "AlreadyExists" not in error.java_exception.getClass().getName():
                    raise
                if time.monotonic() >= until:
                    raise LibraryBusy(f"{at.toString()} is held") from None
                time.sleep(0.05)
        try:
            yield
        finally:
            self._fs.delete(at, False)

    def unlock(self, name: str) -> bool:
        """Removes a lock ("import" or "registry") whose holder is known to be gone."""
        return self._fs.delete(self._lock_path(name), False)

    # -- registry: one small JSON object -------------------------------------------------
    def state(self) -> dict:
        """{"packs": [...], "active": id}."""
        at = f"{self.root}/registry.json"
        if not self._fs.exists(self._path(at)):
            return {"packs": [], "active": None}
        return json.loads(self.spark.read.text(at, wholetext=True).first()[0])

    def _replace(self, state: dict) -> None:
        new, old = f"{self.root}/registry-{uuid.uuid4().hex}.json", self._path(f"{self.root}/registry.json")
        out = self._fs.create(self._path(new))
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        options = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename
        renames = self.spark.sparkContext._gateway.new_array(options, 1)
        renames[0] = options.OVERWRITE
        self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri()).rename(self._path(new), old, renames)

    @contextmanager
    def _changed(self) -> Iterator[dict]:
        """The registry, to be changed in place; it is written unless the body fails."""
        with self._locked("registry", REGISTRY_WAIT):
            state = self.state()
            yield state
            self._replace(state)

    def register(self, pack: dict) -> dict:
        """Adds a pack or replaces that of the same id, which keeps the name its user gave it; it becomes active."""
        with self._changed() as state:
            known = {p["id"]: p for p in state["packs"]}
            if pack["id"] in known:
                pack = pack | {"name": known[pack["id"]]["name"]}
                state["packs"] = [pack if p["id"] == pack["id"] else p for p in state["packs"]]
            else:
                state["packs"].append(pack)
            state["active"] = pack["id"]
        return pack

    def _known(self, state: dict, id_: str) -> dict:
        found = next((p for p in state["packs"] if p["id"] == id_), None)
        if found is None:
            raise KeyError(id_)
        return found

    def select(self, id_: str) -> None:
        with self._changed() as state:
            state["active"] = self._known(state, id_)["id"]

    def rename(self, id_: str, name: str) -> None:
        name = name.strip()
        if not 1 <= len(name) <= 80:
            raise ValueError("a name has 1 to 80 characters")
        with self._changed() as state:
            self._known(state, id_)["name"] = name

    def active(self) -> dict | None:
        state = self.state()
        return next((p for p in state["packs"] if p["id"] == state["active"]), None)

    # -- generations ------------------------------------------------------------------------
    def _dir(self, table: str, generation: str) -> str:
        return f"{self.root}/{table}/generation={generation}"

    def table(self, name: str, generation: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}").where(F.col("generation") == generation)

    def generations(self) -> set[str]:
        """Generations on disk: a listing of folders, not a scan."""
        found = set()
        for name in TABLES:
            at = self._path(f"{self.root}/{name}")
            if self._fs.exists(at):
                found |= {s.getPath().getName().partition("=")[2] for s in self._fs.listStatus(at) if s.isDirectory()}
        return found

    def clean(self) -> set[str]:
        """Deletes the generations that no pack names; not while an import stages one."""
        with self._locked("import"):
            return self._clean()

    def _clean(self) -> set[str]:
        unused = self.generations() - {p["generation"] for p in self.state()["packs"]}
        for generation in unused:
            for name in TABLES:
                self._fs.delete(self._path(self._dir(name, generation)), True)
        return unused

    # -- import -------------------------------------------------------------------------------
    def import_pack(self, path: str, folder: bool = False) -> dict:
        """Stages, checks and activates a pack; the first error leaves everything as it was."""
        with self._locked("import"):
            return self._import(path, folder)

    def _import(self, path: str, folder: bool) -> dict:
        generation, activated = uuid.uuid4().hex, False
        try:
            lines = (packs.read_folder if folder else packs.read_zip)(self.spark, path)
            manifest = packs.manifest_of(lines)
            if errors := integrity.manifest_errors(manifest, format_name=self.format_name) + packs.checksum_errors(lines, manifest):
                raise ImportFailed(f"manifest: {errors[0]}")
            entries = packs.parsed(lines, "entries.jsonl", ENTRY).drop("line_no")
            lookup = packs.parsed(lines, "lookup.jsonl", LOOKUP)
            self._stage(entries, lookup, generation)
            self._check(generation, manifest, lookup)
            size = self._fs.getContentSummary(self._path(path)).getLength()
            pack = {"id": manifest["pack_id"], "name": manifest["source"]["name"], "generation": generation, "entries": manifest["counts"]["entries"], "keys": manifest["counts"]["lookup_keys"], "bytes": size, "imported_at": datetime.now(UTC).replace(microsecond=0).isoformat()}
            pack = self.register(pack)
            activated = True
        finally:
            if not activated:
                for name in TABLES:
                    self._fs.delete(self._path(self._dir(name, generation)), True)
        try:
            self._clean()
        except Exception:  # noqa: BLE001  the import is done; unused generations go with the next one
            pass
        return pack

    def _stage(self, entries: DataFrame, lookup: DataFrame, generation: str) -> None:
        head = fold(F.col("headword"))
        forms = explicit_inflections(F.transform(F.coalesce(F.col("inflections"), F.array().cast("array<struct<type:string,form:string>>")), lambda i: F.lower(i["form"])), head)
        entries = entries.withColumn("form_keys", forms).withColumn("parent_id", F.col("parent.id"))
        entries.repartition("id").sortWithinPartitions("id").write.parquet(self._dir("entries", generation))
        postings = with_head_keys(unnested(lookup))
        # sorted by key inside files: equality on norm then skips row groups by their statistics
        postings.repartition("norm").sortWithinPartitions("norm").write.parquet(self._dir("postings", generation))
        staged = self.spark.read.parquet(self._dir("entries", generation))
        rows = staged.select(F.explode("form_keys").alias("norm"), F.col("id").alias("entry_id"), "headword")
        with_head_keys(rows).repartition("norm").sortWithinPartitions("norm").write.parquet(self._dir("forms", generation))

    def _check(self, generation: str, manifest: dict, lookup: DataFrame) -> None:
        entries, postings = self.table("entries", generation), self.table("postings", generation)
        senses = flat_senses(entries).select("entry_id", "sense_id", "depth")
        lookups = self.table("postings", generation).select("norm").distinct()
        checks = [
            ("duplicate entry", integrity.duplicates(entries, "id").select(F.col("id").alias("x"))),
            ("duplicate key", integrity.duplicates(lookup, "norm").select(F.col("norm").alias("x"))),
            ("rule", integrity.flat_entry_errors(entries, senses).select(F.concat_ws(" ", "id", F.array_join("errors", ",")).alias("x"))),
            ("key without matches", lookup.where("norm IS NULL OR trim(norm) = '' OR coalesce(size(matches), 0) NOT BETWEEN 1 AND 20000").select(F.coalesce("norm", F.lit("")).alias("x"))),
            ("missing entry", integrity.missing_refs(postings, "entry_id", entries, "id").select(F.col("entry_id").alias("x"))),
            ("missing sense", integrity.missing_refs(postings.where("sense_id <> ''"), ["entry_id", "sense_id"], senses, ["entry_id", "sense_id"]).select(F.col("sense_id").alias("x"))),
            ("missing parent", integrity.missing_refs(entries, "parent_id", entries, "id").select(F.col("parent_id").alias("x"))),
        ]
        for name, found in checks:
            if row := found.first():
                raise ImportFailed(f"{name}: {row['x']}")
        for row in integrity.reconcile({"entries": entries, "lookup_keys": lookups}, manifest["counts"]).collect():
            if not row["ok"]:
                raise ImportFailed(f"count of {row['name']}: declared {row['declared']}, found {row['actual']}")

    def lookup(self, queries: DataFrame, dialect: str = "product") -> DataFrame:
        """Answers from the active pack; its generation is resolved once."""
        from quillspark.plans.lookup import lookup

        pack = self.active()
        if pack is None:
            raise LookupError("no active dictionary")
        tables = [self.table(name, pack["generation"]).drop("generation") for name in ("postings", "entries", "forms")]
        return lookup(queries, *tables, dialect=dialect)

