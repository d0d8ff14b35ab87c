"""What the training-data operators share: input columns, word splitting, written tables, checked broadcasts."""

from __future__ import annotations

import string
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Runs that separate words, for words of letters, digits and everything beyond ASCII; text not yet lower-cased.
NOT_ALNUM = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Runs of ASCII white space.
SPACES = r"[\x09-\x0D\x20]+"
#: A side of a join is broadcast up to this many bytes, measured before.
BROADCAST_BYTES = 48 << 20
#: Rows of one key that go to one task of join_unique; keys with more are salted.
HOT_ROWS = 1000


def documents(df: DataFrame) -> DataFrame:
    """doc_id and text of any documents table, other columns left out; a null text becomes an empty one.

    ``key`` tells rows of one doc_id with different texts apart; rows equal in both are the same document.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("key", F.xxhash64("text"))


def join_on(a: DataFrame, b: DataFrame, columns: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which nulls are equal; the columns of a stay, b's copies of the join columns go."""
    b = b.withColumnsRenamed({c: f"_on_{c}" for c in columns})
    on = [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in columns]
    return a.join(b, on, how).drop(*[f"_on_{c}" for c in columns])


def join_unique(a: DataFrame, b: DataFrame, column: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Inner equi-join on a column unique in b and never null; values with over hot_rows rows in a are dealt to salts.

    The list of such values has at most a row for every hot_rows rows of a.
    """
    hot = a.groupBy(column).agg(F.count("*").alias("_n")).where(F.col("_n") > hot_rows)
    hot = broadcast_if_small(written(hot.select(column, F.ceil(F.col("_n") / hot_rows).cast("int").alias("_salts"))))
    salts = F.coalesce("_salts", F.lit(1))
    a = a.join(hot, column, "left").withColumn("_salt", F.pmod(F.xxhash64(*a.columns), salts).cast("int")).drop("_salts")
    b = b.join(hot, column, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return a.join(b, [column, "_salt"]).drop("_salt")


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, all else as it is (``lower`` would change letters beyond ASCII)."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(
        F.translate(c, string.ascii_uppercase, string.ascii_lowercase)
    )


def split_words(text: Column, separators: str) -> Column:
    """The words between runs of separators, in order, none of them empty."""
    return F.array_remove(F.split(text, separators), "")


def let(value: Column, body) -> Column:
    """body(value), with value computed once for the row however often body uses it."""
    return F.transform(F.array(value), body)[0]


def shared_folder(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir; a temporary folder where that is unset, in local sessions only (tests)."""
    conf = spark.sparkContext.getConf()
    top = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not top and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir is not set, and executors share no other folder")
    return f"{(top or tempfile.mkdtemp(prefix='lorespark-')).rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """df as a Parquet table in the shared folder, read back: lineage is cut, and lost executors cost nothing.

    zstd suits large tables that are read again and again: it needs no buffers beside the heap, and less disk.
    """
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dense(df: DataFrame) -> DataFrame:
    """written() with zstd: for operators of long sessions with many stages, whose executors would gather other codecs' buffers."""
    return written(df, "zstd")


def discard(table: DataFrame) -> None:
    """Deletes the folder of a table that written() made. Nothing may read it afterwards."""
    files = table.inputFiles()
    if files:
        spark = table.sparkSession
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df marked for broadcast if its rows, counted and weighed first, stay below the limit; else df as it is, for a shuffle join."""

    def weight(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StringType):
            return F.coalesce(F.octet_length(c).cast("long"), F.lit(0)) + 16
        if isinstance(kind, T.ArrayType):
            inner = weight(F.lit(None).cast(kind.elementType), kind.elementType) if not isinstance(kind.elementType, (T.StringType, T.StructType)) else None
            if inner is not None:
                return F.coalesce(F.size(c), F.lit(0)).cast("long") * 8 + 24
            return F.coalesce(F.octet_length(F.to_json(c)).cast("long"), F.lit(0)) * 2 + 24
        return F.lit(8)

    total = F.lit(16)
    for f in df.schema.fields:
        total = total + weight(F.col(f"`{f.name}`"), f.dataType)
    size = df.agg(F.sum(total)).first()[0] or 0
    return F.broadcast(df) if size <= limit else df


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it differ from all columns of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name = f"_{name}"
        out.append(name)
    return out


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs, with all its columns, without the documents (doc_id, key) of gone."""
    doc, key = unused(docs, "gone_doc", "gone_key")
    small = broadcast_if_small(gone.select(F.col("doc_id").alias(doc), F.col("key").alias(key)))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64(text) == F.col(key))
    return docs.join(small, same, "left_anti")
