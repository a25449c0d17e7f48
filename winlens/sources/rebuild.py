"""Incremental rebuild of what is extracted from captures: only what changed is read again.

The output folder holds data/capture=..., and manifests. A manifest has, for each capture whose output is complete, the facts of its files
and the version (of extractor, options and rules) that made it. A run

1. compares the listing of captures with the last manifest: new, changed (other facts or another version), lost (its output is gone),
   vanished (its files are gone), unchanged;
2. writes a manifest of the unchanged ones alone, and removes the output of all others;
3. reads the files of new, changed and lost captures, and writes their output by dynamic overwrite;
4. writes the whole manifest, last.

A run that is broken off at any place leaves captures without complete output out of the manifest in force, so the next run does them again.
Listings and manifests are tables; what comes to the driver are the names of captures and files, which Spark's own readers hold there too.

Where captures are many and small, a folder for each costs more than its rows. With `shared`, the captures of a run share the folder
data/run=..., the manifest tells each one's run, and rows that it does not name are dead; no names of captures come to the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from winlens.sources.scratch import materialize
from winlens.sources.tables import manifest_diff

FACTS = ["files", "bytes", "modified", "version"]
MANIFEST = "capture string, files long, bytes long, modified timestamp, version string, n_rows long, run string"
KEPT_MANIFESTS = 3


def listing(spark: SparkSession, path: str, capture: Column | None = None) -> DataFrame:
    """(capture, path, bytes, modified) of the files of a path, contents unread; capture is told from `path`, by default the file's name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select((F.regexp_extract("path", "([^/]*)$", 1) if capture is None else capture).cast("string").alias("capture"), "path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


class Output:
    """The folder of a rebuild's data and manifests, in any store that Spark writes to."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._store = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        at = self._path(f"{self.folder}/{folder}" if folder else self.folder)
        return sorted(f.getPath().getName() for f in self._store.listStatus(at)) if self._store.exists(at) else []

    def manifests(self) -> list[str]:
        """Complete ones, the last in force."""
        return [n for n in self.names("") if n.startswith("manifest-") and "_SUCCESS" in self.names(n)]

    def manifest(self) -> DataFrame:
        found = self.manifests()
        return self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/{found[-1]}") if found else self.spark.createDataFrame([], MANIFEST)

    def write_manifest(self, rows: DataFrame) -> None:
        taken = [int(n.rpartition("-")[2]) for n in self.names("") if n.startswith("manifest-")]
        rows.select(*(f.split()[0] for f in MANIFEST.split(", "))).write.parquet(f"{self.folder}/manifest-{max(taken, default=0) + 1:08d}")
        for old in self.manifests()[:-KEPT_MANIFESTS]:
            self._store.delete(self._path(f"{self.folder}/{old}"), True)

    def folder_of(self, capture: str) -> str:
        return f"capture={self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(capture)}"

    def remove(self, capture: str) -> None:
        self._store.delete(self._path(f"{self.folder}/data/{self.folder_of(capture)}"), True)

    def data(self) -> DataFrame | None:
        """All rows of captures that the manifest in force names."""
        folders = [n for n in self.names("data") if n.startswith("capture=")]
        if not folders:
            return None
        rows = self.spark.read.option("basePath", f"{self.folder}/data").parquet(f"{self.folder}/data")
        return rows.withColumn("capture", F.col("capture").cast("string")).join(self.manifest().select("capture"), "capture", "left_semi")

    def write(self, rows: DataFrame) -> None:
        rows.write.partitionBy("capture").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{self.folder}/data")

    def counts(self) -> DataFrame | None:
        """(capture, n_rows) of all that is stored."""
        if not any(n.startswith("capture=") for n in self.names("data")):
            return None
        rows = self.spark.read.option("basePath", f"{self.folder}/data").parquet(f"{self.folder}/data")
        return rows.groupBy(F.col("capture").cast("string").alias("capture")).agg(F.count("*").alias("n_rows"))


class Shared(Output):
    """A folder whose data lie in a folder for each run that wrote any."""

    def runs(self) -> list[str]:
        return [n.removeprefix("run=") for n in self.names("data") if n.startswith("run=")]

    def rows(self, runs: list[str]) -> DataFrame:
        """All rows of runs, dead ones too, with their run; a run has the columns that its build gave."""
        out = None
        for r in runs:
            one = self.spark.read.parquet(f"{self.folder}/data/run={r}").withColumns({"capture": F.col("capture").cast("string"), "run": F.lit(r)})
            out = one if out is None else out.unionByName(one, allowMissingColumns=True)
        return out

    def named(self) -> list[str]:
        """Runs that the manifest in force names and that are there."""
        named = {r["run"] for r in self.manifest().select("run").distinct().collect()}
        return [r for r in self.runs() if r in named]

    def data(self) -> DataFrame | None:
        runs = self.named()
        return self.rows(runs).join(self.manifest().select("capture", "run"), ["capture", "run"], "left_semi").drop("run") if runs else None

    def stored(self) -> DataFrame:
        """(capture, run, stored): rows in runs that the manifest names, dead ones too."""
        runs = self.named()
        if not runs:
            return self.spark.createDataFrame([], "capture string, run string, stored long")
        return materialize(self.rows(runs).groupBy("capture", "run").agg(F.count("*").alias("stored")), "stored")

    def write_run(self, rows: DataFrame) -> str:
        name = f"r{max((int(r[1:]) for r in self.runs()), default=0) + 1:08d}"
        rows.write.mode("error").parquet(f"{self.folder}/data/run={name}")
        return name

    def remove_dead(self) -> None:
        """Folders of runs that the manifest in force does not name."""
        for r in set(self.runs()) - set(self.named()):
            self._store.delete(self._path(f"{self.folder}/data/run={r}"), True)


def facts_of(files: DataFrame, version: str) -> DataFrame:
    found = files.groupBy(F.coalesce("capture", F.raise_error(F.lit("a file without capture")).cast("string")).alias("capture")).agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.max("modified").alias("modified"))
    return found.withColumn("version", F.lit(version))


def states_of(facts: DataFrame, old: DataFrame) -> DataFrame:
    return manifest_diff(facts, old, ["capture"], FACTS).join(old.select("capture", "n_rows"), "capture", "left")


def rebuild(spark: SparkSession, files: DataFrame, folder: str, version: str, read: Callable[[list[str]], DataFrame], build: Callable[[DataFrame], DataFrame], shared: bool = False) -> DataFrame:
    """(capture, state, n_rows) after a run over files, a `listing`; read takes file names, build gives rows with capture.

    An empty listing removes everything; a capture without rows is in the manifest with 0 and is not read again; a null capture is an error.
    With shared, a file may hold several captures, also superseded rows of one that was listed elsewhere since; what read gives has capture
    and path as the listing has them, and build gets the rows of what is to be done.
    """
    if shared:
        return rebuild_shared(spark, files, folder, version, read, build)
    out = Output(spark, folder)
    facts = facts_of(files, version)
    old = materialize(out.manifest(), "manifest")
    states = states_of(facts, old)
    folders = set(out.names("data"))
    lost = [r["capture"] for r in states.filter("state = 'unchanged' and n_rows > 0").select("capture").toLocalIterator() if out.folder_of(r["capture"]) not in folders]
    states = materialize(states.withColumn("state", F.when(F.col("capture").isin(*lost), "lost").otherwise(F.col("state"))) if lost else states, "states")

    again = states.filter("state in ('new', 'changed', 'lost')")
    gone = [r["capture"] for r in states.filter("state in ('changed', 'lost', 'vanished')").select("capture").collect()]
    paths = [r["path"] for r in files.join(again.select("capture"), "capture", "left_semi").select("path").orderBy("path").collect()]
    unchanged = materialize(old.join(states.filter("state = 'unchanged'").select("capture"), "capture", "left_semi"), "unchanged")
    if not gone and not paths:
        return states
    out.write_manifest(unchanged)
    for capture in gone:
        out.remove(capture)
    if paths:
        out.write(build(read(paths)))
    made, rows = facts.join(again.select("capture"), "capture", "left_semi"), out.counts()
    made = made.withColumn("n_rows", F.lit(None).cast("long")) if rows is None else made.join(rows, "capture", "left")
    made = made.withColumn("run", F.lit(None).cast("string"))
    whole = materialize(unchanged.unionByName(made.withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))), "manifest")
    out.write_manifest(whole)
    return states.drop("n_rows").join(whole.select("capture", "n_rows"), "capture", "left")


def rebuild_shared(spark: SparkSession, files: DataFrame, folder: str, version: str, read: Callable[[list[str]], DataFrame], build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`rebuild` into folders of runs. What is alive of a run that is dead for more than half is written again with the new rows."""
    out = Shared(spark, folder)
    facts = materialize(facts_of(files, version), "facts")
    old = materialize(out.manifest(), "manifest")
    stored = out.stored()
    gone = old.filter("n_rows > 0").join(stored, ["capture", "run"], "left").filter("n_rows <> coalesce(stored, 0)").select("capture", F.lit(True).alias("gone"))
    states = states_of(facts, old).join(gone, "capture", "left")
    states = materialize(states.withColumn("state", F.when(F.col("gone") & (F.col("state") == "unchanged"), "lost").otherwise(F.col("state"))).drop("gone"), "states")
    again = states.filter("state in ('new', 'changed', 'lost')").select("capture")
    if not states.filter("state <> 'unchanged'").limit(1).count():
        return states
    unchanged = materialize(old.join(states.filter("state = 'unchanged'").select("capture"), "capture", "left_semi"), "unchanged")
    out.write_manifest(unchanged)
    wanted = materialize(files.join(again, "capture", "left_semi").select("capture", "path").distinct(), "wanted")
    paths = [r["path"] for r in wanted.select("path").distinct().orderBy("path").collect()]
    alive = unchanged.groupBy("run").agg(F.sum("n_rows").alias("alive"))
    thin = [r["run"] for r in stored.groupBy("run").agg(F.sum("stored").alias("stored")).join(alive, "run").filter("alive > 0 and 2 * alive < stored").select("run").collect()]
    moved = unchanged.filter(F.col("run").isin(thin))
    rows = None
    if paths:
        of = wanted.select(F.col("capture").alias("_capture"), F.col("path").alias("_path"))
        todo = read(paths).join(of, (F.col("capture").cast("string") == F.col("_capture")) & (F.col("path") == F.col("_path")), "left_semi")
        rows = build(todo.drop("path")).withColumn("capture", F.col("capture").cast("string"))
    if thin:
        kept = out.rows(thin).join(moved.select("capture", "run"), ["capture", "run"], "left_semi").drop("run")
        rows = kept if rows is None else rows.unionByName(kept, allowMissingColumns=True)
    made = facts.join(again, "capture", "left_semi").withColumns({"n_rows": F.lit(0).cast("long"), "run": F.lit(None).cast("string")})
    if rows is not None:
        run = out.write_run(rows)
        n = out.rows([run]).groupBy("capture").agg(F.count("*").alias("n"))
        made = made.join(n, "capture", "left").withColumns({"n_rows": F.coalesce("n", F.lit(0)), "run": F.when(F.col("n") > 0, run)}).drop("n")
        unchanged = unchanged.withColumn("run", F.when(F.col("run").isin(thin), run).otherwise(F.col("run"))) if thin else unchanged
    whole = materialize(unchanged.unionByName(made), "manifest")
    out.write_manifest(whole)
    out.remove_dead()
    return states.drop("n_rows").join(whole.select("capture", "n_rows"), "capture", "left")
