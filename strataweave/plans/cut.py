"""Cutting lineage with tables written to the shared folder.

Loops would otherwise grow their plan with every round, and a lost executor would make Spark repeat all rounds.  The folder
is `spark.checkpoint.dir`, or the checkpoint folder set on the context, which every executor shares; only a session on a
`local` master (tests on one machine) gets a temporary one, and any other session without the setting is refused.

Tables live as long as what reads them: a `Scope` drops all its tables but the kept ones when it ends, and kept ones go with
the session.  The shuffles behind a table are deleted once it is written, not whenever the driver collects its garbage.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Whether a finished statement deletes its shuffle files.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own: dict[str, str] = {}
_kept: list[Cut] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only on a local master without that setting."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named:
        given = context._jsc.sc().getCheckpointDir()
        named = given.get() if given.isDefined() else None
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = context.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="strataweave-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return "file://" + _own[app]


class Cut:
    """A written table: `df` reads it, `drop()` removes its files once nothing reads it any more."""

    def __init__(self, df: DataFrame, label: str):
        self.spark = df.sparkSession
        self.path = f"{shared_folder(self.spark)}/{label}-{uuid.uuid4().hex}"
        given = self.spark.conf.get(CLEANUP)
        self.spark.conf.set(CLEANUP, True)
        try:
            df.write.parquet(self.path)
        finally:
            self.spark.conf.set(CLEANUP, given)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def _drop_kept() -> None:
    for t in _kept:
        with contextlib.suppress(Exception):  # the session may have ended
            t.drop()


atexit.register(_drop_kept)


def cut(df: DataFrame, label: str) -> DataFrame:
    """`df` as a table in the shared folder, kept until the session ends."""
    _kept.append(Cut(df, label))
    return _kept[-1].df


class Scope:
    """`with Scope() as s`: what `s.cut` writes is dropped at the end, what `s.keep` writes is not."""

    def __enter__(self) -> Scope:
        self.tables: list[Cut] = []
        return self

    def cut(self, df: DataFrame, label: str) -> DataFrame:
        self.tables.append(Cut(df, label))
        return self.tables[-1].df

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        return cut(df, label)

    def __exit__(self, *_: object) -> None:
        for t in self.tables:
            t.drop()
