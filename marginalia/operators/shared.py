"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder of its own in local mode where it is unset.

    On a cluster an unset folder is an error: a machine's own disk dies with it.
    """
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not given:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        given = tempfile.mkdtemp(prefix="marginalia-")
        atexit.register(shutil.rmtree, given, ignore_errors=True)
        given = f"file:{given}"
        spark.sparkContext.setCheckpointDir(given)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(given)
    return given


def _file_system(spark: SparkSession, path: str):
    """(file system, path) of the JVM."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path; the folder is deleted when the session's JVM ends."""
    folder = f"{shared_folder(spark).rstrip('/')}/marginalia/{name}-{uuid.uuid4().hex}"
    fs, at = _file_system(spark, folder)
    fs.mkdirs(at)  # only what exists can be registered
    fs.deleteOnExit(at)
    return folder


def delete_folder(spark: SparkSession, folder: str) -> None:
    fs, at = _file_system(spark, folder)
    fs.delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _file_system(spark, path)
    return fs.exists(at)


class Manifests:
    """Numbered JSON files under ``root``, the highest number being the current one.

    A file is written under another name and then renamed to its number, which fails if the number is
    taken. So readers see whole files only, a job that dies leaves the old one current, and of two
    writers that started from one state the slower one gets an error.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def numbers(self) -> list[int]:
        fs, at = _file_system(self.spark, f"{self.root}/manifests")
        names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self, number: int) -> dict:
        fs, at = _file_system(self.spark, f"{self.root}/manifests/{number:012d}.json")
        stream = fs.open(at)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def current(self) -> tuple[int, dict]:
        """(number, content); (0, {}) before the first."""
        numbers = self.numbers()
        return (numbers[-1], self.read(numbers[-1])) if numbers else (0, {})

    def publish(self, number: int, content: dict) -> None:
        """Makes ``content`` the manifest ``number``, one more than the one that the writer started from."""
        fs, draft = _file_system(self.spark, f"{self.root}/manifests/draft-{uuid.uuid4().hex}")
        _, final = _file_system(self.spark, f"{self.root}/manifests/{number:012d}.json")
        stream = fs.create(draft, False)
        try:
            stream.write(bytearray(json.dumps(content).encode()))
        finally:
            stream.close()
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        options = gateway.new_array(kind, 1)
        options[0] = kind.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(context.makeQualified(draft), context.makeQualified(final), options)


def written(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder, without its lineage; it survives the loss of executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet files in the shared folder, for loops.

    A checkpoint keeps the size that Spark estimated for its plan; joined again each round the
    estimates multiply, to numbers of so many digits that planning never ends. Files have their
    real size.
    """
    folder = f"{new_folder(df.sparkSession, name)}/rows"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
