"""What the operators share: reading tables, shared scratch tables, byte-exact words."""

from __future__ import annotations

import atexit
import logging
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space that separates words in the text contracts: space and U+0009 to U+000D.
SPACE_WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session without it gets one of its own, which goes with the session."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="shelfcast-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def _own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder. What is left of it goes when the driver's interpreter ends."""
    path = f"{shared_dir(spark)}/shelfcast/{spark.sparkContext.applicationId}"
    if path not in _OWN:
        _OWN.add(path)
        atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    """Best effort: the table is scratch, and whoever holds the file system may be gone."""
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception as e:  # noqa: BLE001
        logging.getLogger(__name__).info("%s stays: %s", path, e)


_OWN: set[str] = set()


def cut(df: DataFrame, name: str = "t") -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: lineage ends there, and a lost executor costs only its tasks."""
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shelfcast_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Removes tables that cut() wrote. Only for those that nothing will read again."""
    for t in tables:
        if path := getattr(t, "_shelfcast_path", None):
            _remove(t.sparkSession, path)


def spread_join(rows: DataFrame, lookup: DataFrame, key: str, by: Column, salts: int = 64) -> DataFrame:
    """rows with the columns of lookup, which has one row for each key at most; rows without partner go.

    Rows of a key are dealt to so many parts by the column by. The parts that there are fetch the key's row first, and
    the rows meet it part by part, so that no task has all rows of a frequent key.
    """
    (salt,) = unused(rows.join(lookup, key), "salt")
    salted = rows.withColumn(salt, F.pmod(F.xxhash64(by), F.lit(salts)))
    parts = salted.select(key, salt).distinct().join(lookup, key)
    return salted.join(parts, [key, salt]).drop(salt)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as it takes to be none of df's columns, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def ship(spark: SparkSession) -> None:
    """Sends this package to Python workers where PYTHONPATH doesn't name it, so that they import it and keep its caches between tasks."""
    root = Path(__file__).resolve().parents[2]
    known = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    sc = spark.sparkContext
    if str(root) in known or getattr(sc, "_shelfcast_shipped", False):
        return
    with tempfile.NamedTemporaryFile(prefix="shelfcast-", suffix=".zip", delete=False) as f, zipfile.ZipFile(f, "w") as z:
        for p in sorted((root / "shelfcast").rglob("*.py")):
            z.write(p, p.relative_to(root))
    sc.addPyFile(f.name)
    sc._shelfcast_shipped = True


def plus(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    """The schema of df with one more column."""
    return T.StructType([*df.schema.fields, T.StructField(name, kind)])
