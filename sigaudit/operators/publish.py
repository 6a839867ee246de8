"""Tables and notes that appear whole or not at all, and only once.

A writer writes to a side folder and then renames it to its place without overwriting. Of several writers one wins and the others raise;
one that dies before the rename leaves only its side folder, which no reader looks at.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class AlreadyPublished(FileExistsError):
    """There is something at the place already."""


def _files(spark: SparkSession, path: str):
    """Hadoop's file context, whose rename refuses to overwrite, and the path."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()) if ":" in path else jvm.org.apache.hadoop.fs.FileContext.getFileContext(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    files, target = _files(spark, path)
    return files.util().exists(target)


def _side(path: str) -> str:
    """A name beside path that Spark's readers of its folder pass over."""
    folder, _, name = path.rstrip("/").rpartition("/")
    return f"{folder}/.{name}.{uuid.uuid4().hex}"


def _place(spark: SparkSession, side: str, path: str) -> None:
    jvm = spark._jvm
    files, target = _files(spark, path)
    source = jvm.org.apache.hadoop.fs.Path(side)
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        files.rename(source, target, none)
    except Exception as error:
        files.delete(source, True)
        # the loser of a race sees a place that is taken, by whatever name the file system calls that
        if files.util().exists(target):
            raise AlreadyPublished(path) from error
        raise


def publish(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """df as a parquet table at path. Raises AlreadyPublished if there is one, before writing if it was there before."""
    spark = df.sparkSession
    if exists(spark, path):
        raise AlreadyPublished(path)
    side = _side(path)
    df.write.partitionBy(*partition_by).parquet(side)
    _place(spark, side, path)


def publish_text(spark: SparkSession, text: str, path: str, name: str) -> None:
    """A small text as the file name in a folder at path, whole and once."""
    if exists(spark, path):
        raise AlreadyPublished(path)
    side = _side(path)
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{side}/{name}")
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = files.create(target, False)
    out.write(bytearray(text.encode()))
    out.close()
    _place(spark, side, path)


def read_text(spark: SparkSession, path: str, name: str) -> str:
    return bytes(spark.read.format("binaryFile").load(f"{path}/{name}").head()["content"]).decode()


def append_missing(cells: DataFrame, path: str, keys: list[str]) -> int:
    """Publish the rows of cells whose keys no part under path has yet, as a part of its own; returns how many. A part is there whole or
    not at all. Two writers at once may both add rows of the same keys; read_parts() keeps one of each."""
    spark = cells.sparkSession
    todo = cells.dropDuplicates(keys)
    if exists(spark, path):
        todo = todo.join(spark.read.parquet(f"{path}/part=*").select(*keys).distinct(), keys, "left_anti")
    if todo.isEmpty():
        return 0
    place = f"{path}/part={uuid.uuid4().hex}"
    publish(todo, place)
    return spark.read.parquet(place).count()


def read_parts(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The rows of all parts under path, one a key."""
    return spark.read.option("basePath", path).parquet(f"{path}/part=*").drop("part").dropDuplicates(keys)
