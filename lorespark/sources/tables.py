"""Reading and writing: file trees, Markdown, notes, bubbles, and the partitioned vector store."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NOTE = "title string, note_id string, bubble_id string, document string, ink string"
BUBBLE = "id string, name string, description string, domains array<string>, user_goals array<string>, created_at timestamp"


def shared_folder(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir, which a cluster must name; only a local session may go without."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not top and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir is not set")
    return f"{(top or tempfile.mkdtemp(prefix='lorespark-')).rstrip('/')}/{uuid.uuid4().hex}"


#: For the steps of a job on large tables. What a step shuffles goes as it ends; else it stays until the driver happens to collect its
#: garbage. Tables that lie by one of several join keys are joined where they lie.
STEP = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.requireAllClusterKeysForCoPartition": "false"}


@contextmanager
def settings(spark: SparkSession, values: Mapping[str, str]) -> Iterator[None]:
    """The session's settings inside; afterwards they are as they were."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored(df: DataFrame, folder: str | None = None) -> DataFrame:
    """df as a Parquet table, read back; in a new shared folder if none is given."""
    spark = df.sparkSession
    folder = shared_folder(spark) if folder is None else folder
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def packed(df: DataFrame) -> DataFrame:
    """stored() for the steps of a job on large tables: in zstd, under the settings of STEP."""
    spark, folder = df.sparkSession, shared_folder(df.sparkSession)
    with settings(spark, STEP):
        df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def path_parts(rel_path: Column, deepest: int = 4) -> dict[str, Column]:
    """Columns of a path below the root: four folder names (null where absent), name, stem, suffix, depth."""
    parts = F.split(rel_path, "/")
    depth = F.size(parts) - 1
    names = ["domain", "subject", "topic", "subtopic"][:deepest]
    name = F.element_at(parts, -1)
    out = {n: F.when(depth > i, F.get(parts, F.lit(i))) for i, n in enumerate(names)}
    return out | {"name": name, "stem": F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), "suffix": F.regexp_extract(name, r".(\.[^.]*)$", 1), "depth": depth}


def file_tree(spark: SparkSession, root: str, deepest: int = 4) -> DataFrame:
    """Files of at most ``deepest`` folders below the root, without their content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root.rstrip("/") or "/")
    resolved = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).resolvePath(top).toString().rstrip("/")
    # both forms of a path, file:/x and file:///x, name the same; what is cut off is that literal prefix
    plain = F.regexp_replace("path", "^([a-z][a-z0-9+.-]*:)//(?=/)", "$1")
    rel = F.when(plain.startswith(resolved + "/"), F.substring(plain, F.lit(len(resolved) + 2), F.length(plain)))
    return listed(files.select(rel.alias("rel_path"), "length"), deepest)


def listed(paths: DataFrame, deepest: int = 4) -> DataFrame:
    return paths.withColumns(path_parts(F.col("rel_path"), deepest)).where(F.col("depth") <= deepest)


def markdown_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("text"))


def notes(spark: SparkSession, path: str, bubble_id: str | None = None) -> DataFrame:
    """Note files of one JSON document each, of one bubble if it is given; ink defaults to an empty list. The id is the file's
    name without .json."""
    rows = spark.read.schema(NOTE).json(path, multiLine=True).select("*", F.col("_metadata.file_name").alias("file_name"))
    rows = rows.where(F.col("bubble_id") == bubble_id) if bubble_id is not None else rows
    return rows.withColumn("ink", F.coalesce("ink", F.lit("[]"))).withColumn("file_stem", F.regexp_replace("file_name", r"\.json$", ""))


def bubbles(spark: SparkSession, root: str, bubble_id: str | None = None) -> DataFrame:
    """Bubbles of all folders that have an info.json, or the one of an id."""
    rows = spark.read.schema(BUBBLE).json(f"{root}/*/info.json", multiLine=True)
    return rows.where(F.col("id") == bubble_id) if bubble_id is not None else rows


def registry_rows(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a registry of files, notes or chunks."""
    return spark.read.parquet(path)


def write_annotated(rows: DataFrame, path: str) -> None:
    """Annotated Markdown (source_id, markdown), a row for each document."""
    rows.select("source_id", "markdown").write.mode("overwrite").parquet(path)


#: Folders of the vector store, from the top; a store that is filled batch by batch has one for each batch first.
LAYOUT = ["batch", "domain", "subject"]


def add_vectors(rows: DataFrame, path: str, files_each: int = 8, batch: int | None = None) -> None:
    """Adds to the store, one folder for each domain and subject; large collections are dealt over several files.

    Without a batch rows are appended. With one they are all that the batch has: writing it again, after a failure too, puts its
    folder in the place of the former one, so no row comes twice.
    """
    rows = rows.withColumns({c: F.coalesce(c, F.lit("default")) for c in ("domain", "subject")})
    salt = F.pmod(F.xxhash64("chunk_id"), F.lit(files_each))
    writer = rows.repartition("domain", "subject", salt).write.partitionBy("domain", "subject")
    if batch is None:
        writer.mode("append").parquet(path)
    else:
        writer.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")


def delete_vectors(spark: SparkSession, path: str, condition: Column | None = None, fingerprints: DataFrame | None = None) -> int:
    """Deletes the store's rows that meet the condition, or whose file_fingerprint is one of ``fingerprints``; the number of them.

    Only the folders of collections that hold such rows are written anew, and those that have no others go; all else keeps its
    files. A condition that is null keeps a row. What comes to the driver is a row for each touched collection.
    """
    store = spark.read.parquet(path)
    folders = [c for c in LAYOUT if c in store.columns]
    rows = store.withColumn("_path", F.col("_metadata.file_path")).withColumn("_gone", F.coalesce(condition, F.lit(False)) if condition is not None else F.lit(False))
    if fingerprints is not None:
        asked = fingerprints.select(F.col("file_fingerprint").alias("_asked")).distinct()
        rows = rows.join(asked, F.col("file_fingerprint") == F.col("_asked"), "left").withColumn("_gone", F.col("_gone") | F.col("_asked").isNotNull()).drop("_asked")
    counts = rows.groupBy(*folders).agg(F.count(F.when(F.col("_gone"), 1)).alias("gone"), F.count("*").alias("whole"), F.min("_path").alias("file"))
    touched = counts.where("gone > 0").collect()
    some = [r for r in touched if r["gone"] < r["whole"]]
    if some:
        keys = spark.createDataFrame([tuple(r[c] for c in folders) for r in some], store.select(*folders).schema)
        kept = rows.where(~F.col("_gone")).join(F.broadcast(keys), folders, "left_semi").select(*store.columns)  # one row a collection
        kept.repartition(*folders, F.pmod(F.xxhash64(*[c for c in store.columns if c == "chunk_id"], F.lit(0)), F.lit(8))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*folders).parquet(path)
    for r in touched:
        if r["gone"] == r["whole"]:
            jvm = spark.sparkContext._jvm
            folder = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(r["file"])).getParent()  # Spark gives the path as a URI
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return sum(r["gone"] for r in touched)


def put_snapshot(table: DataFrame, path: str, number: int) -> None:
    """The state of a table after a numbered step; writing it again replaces it. The states before the last two are deleted."""
    table.write.mode("overwrite").parquet(f"{path.rstrip('/')}/after={number}")
    fs, there = _snapshots(table.sparkSession, path)
    for old in [n for n in there if n < number - 1]:
        fs.delete(table.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/after={old}"), True)


def snapshot(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The last complete state of a table, or the last from a step below ``before``; None if there is none."""
    there = [n for n in _snapshots(spark, path)[1] if before is None or n < before]
    return spark.read.parquet(f"{path.rstrip('/')}/after={max(there)}") if there else None


@dataclass(frozen=True)
class Registry:
    """A registry in a folder, one state for each numbered step, bucketed and sorted by keys that are never null.

    An upsert, mark or removal by these keys (with null_keys=False) shuffles what changes and not the registry: each bucket is
    read in place, joined, and written as the same bucket of the next state.
    """

    folder: str
    keys: tuple[str, ...]
    buckets: int

    def put(self, table: DataFrame, number: int) -> None:
        """The state after a numbered step, in the place of an earlier try of it; states before the last two are deleted.

        A null key fails the write, which leaves no complete state.
        """
        spark, name = table.sparkSession, f"registry_{uuid.uuid4().hex}"
        checked = [F.when(F.col(c).isNull(), F.raise_error(F.lit(f"{c} is null")).cast(t)).otherwise(F.col(c)).alias(c) if c in self.keys else F.col(c) for c, t in table.dtypes]
        where = f"{self.folder.rstrip('/')}/after={number}"
        # of a bucketed registry's own upsert rows lie in their buckets already; the others come one file a bucket this way
        writer = table.select(*checked).write.format("parquet").bucketBy(self.buckets, *self.keys).sortBy(*self.keys).option("path", where)
        try:
            writer.mode("overwrite").saveAsTable(name)
        finally:
            spark.sql(f"DROP TABLE IF EXISTS {name}")  # the folder stays, as it was named
        fs, there = _snapshots(spark, self.folder)
        for old in [n for n in there if n < number - 1]:
            fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder.rstrip('/')}/after={old}"), True)

    def get(self, spark: SparkSession, before: int | None = None) -> DataFrame | None:
        """The last complete state, or the last from a step below ``before``; None if there is none."""
        there = [n for n in _snapshots(spark, self.folder)[1] if before is None or n < before]
        if not there:
            return None
        where, name = f"{self.folder.rstrip('/')}/after={max(there)}", f"registry_{uuid.uuid4().hex}"
        quoted = {c: "`" + c.replace("`", "``") + "`" for c in spark.read.parquet(where).columns}
        schema = ", ".join(f"{quoted[f.name]} {f.dataType.simpleString()}" for f in spark.read.parquet(where).schema.fields)
        keys = ", ".join(quoted[k] for k in self.keys)
        place = where.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {self.buckets} BUCKETS LOCATION '{place}'")
        rows = spark.table(name)
        spark.sql(f"DROP TABLE {name}")  # rows has found its files and buckets
        return rows


def _snapshots(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = jvm.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(jvm.Path(path)):
        return fs, []
    names = [x.getPath().getName() for x in fs.listStatus(jvm.Path(path))]
    return fs, [int(n[6:]) for n in names if n.startswith("after=") and fs.exists(jvm.Path(f"{path.rstrip('/')}/{n}/_SUCCESS"))]


def read_vectors(spark: SparkSession, path: str, domain: str | None = None, subject: str | None = None) -> DataFrame:
    """The store, or the collections of a domain or subject: only their folders are read."""
    rows = spark.read.parquet(path)
    if domain is not None:
        rows = rows.where(F.col("domain") == domain)
    return rows.where(F.col("subject") == subject) if subject is not None else rows


def write_markdown(rows: DataFrame, path: str) -> None:
    """Artifacts (domain, subject, title, markdown) by domain and subject."""
    rows.select("domain", "subject", "title", "markdown").write.mode("overwrite").partitionBy("domain", "subject").parquet(path)
