"""Tables that cut lineage, in the folder that the whole cluster shares."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tessera.session import new_folder


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet below the shared folder and read again."""
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    out = df.sparkSession.read.schema(df.schema).parquet(folder)
    out.saved_in = folder
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables that ``saved`` wrote, when whatever was made from them has been written too."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.saved_in)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
