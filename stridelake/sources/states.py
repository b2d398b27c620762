"""Stored tables (SNK-1 to SNK-3): a folder of numbered states, each a folder ``s=N`` of Parquet files.

A state is either whole or holds rows added to the state before; the file ``_whole`` in it tells which. Rows are first written to a
staging folder of their own, which one rename then makes the next state. So a write that fails leaves nothing that is read, of two
writers one takes the number and the other the next, and a state is never changed. A batch that is known by a ``token`` is written once,
however often it is retried. The file system must rename folders atomically, as HDFS and local ones do.
"""

from __future__ import annotations

import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class Conflict(RuntimeError):
    """The table has moved on from the state that a change was computed from."""


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system for a path, the path, and its class."""
    kind = spark._jvm.org.apache.hadoop.fs.Path
    where = kind(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where, kind


def _names(spark: SparkSession, pattern: str) -> list[str]:
    """The states that hold a file that fits, oldest first."""
    fs, where, _ = file_system(spark, pattern)
    return sorted(s.getPath().getParent().getName() for s in fs.globStatus(where) or [])


def versions(spark: SparkSession, root: str) -> list[str]:
    """All states, oldest first."""
    fs, where, _ = file_system(spark, root)
    names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
    return sorted(n for n in names if re.fullmatch(r"s=\d+", n))


def newest(spark: SparkSession, root: str) -> str | None:
    """The newest state, None where there is none yet."""
    found = versions(spark, root)
    return found[-1] if found else None


def parts(spark: SparkSession, root: str, version: str | None = None) -> list[str]:
    """The states that make up the table as of ``version`` (by default the newest): the last whole one and those added since."""
    found = versions(spark, root)
    if version is not None and version not in found:
        raise FileNotFoundError(f"{root}/{version}")
    upto = found[: found.index(version) + 1] if version else found
    whole = [n for n in _names(spark, f"{root}/s=*/_whole") if n in upto]
    return [n for n in upto if not whole or n >= whole[-1]]


def load_table(spark: SparkSession, root: str, version: str | None = None) -> DataFrame:
    """The newest state, or that of ``version``: rows added later, or a later whole state, are not seen."""
    found = parts(spark, root, version)
    if not found:
        raise FileNotFoundError(root)
    return spark.read.parquet(*[f"{root}/{n}" for n in found])


def load_or_empty(spark: SparkSession, root: str, schema: T.StructType | str) -> DataFrame:
    """``load_table``, or no rows if nothing is stored yet."""
    return load_table(spark, root) if versions(spark, root) else spark.createDataFrame([], schema)


def tokens(spark: SparkSession, root: str) -> dict[str, str]:
    """The state that each token's batch became."""
    fs, where, _ = file_system(spark, f"{root}/s=*/_token-*")
    return {s.getPath().getName().removeprefix("_token-").replace("~", "="): s.getPath().getParent().getName() for s in fs.globStatus(where) or []}


def _mark(token: str) -> str:
    """The file that names a batch; with ``=`` in its name Spark would take it for data."""
    return "_token-" + token.replace("=", "~")


def _write(df: DataFrame, root: str, whole: bool, token: str | None, expect: str | None) -> str:
    spark = df.sparkSession
    if token is not None:
        if not re.fullmatch(r"[\w.=-]+", token):
            raise ValueError(f"a token has letters, digits and ._=- only: {token!r}")
        done = tokens(spark, root).get(token)
        if done:
            return done
    own = uuid.uuid4().hex
    fs, staged, path = file_system(spark, f"{root}/_staging-{own}")
    home = staged
    try:
        df.write.parquet(str(staged.toString()))
        for mark in [f"_id-{own}", *(["_whole"] if whole else []), *([_mark(token)] if token else [])]:
            fs.create(path(staged, mark), False).close()
        while True:
            found = versions(spark, root)
            done = tokens(spark, root).get(token) if token else None
            if done:
                fs.delete(home, True)
                return done
            last = found[-1] if found else ""
            if expect is not None and last != expect:
                raise Conflict(f"{root} is at {last or 'no state'}, not at {expect or 'no state'}")
            name = f"s={int(last[2:] or 0) + 1:012d}"
            taken = path(root, name)
            fs.rename(home, taken)
            if fs.exists(path(taken, f"_id-{own}")):
                return name
            # another writer took the number; a folder that is renamed to an existing one ends up inside it, where nobody reads it
            inside = path(taken, home.getName())
            home = inside if fs.exists(inside) else home
    except BaseException:
        fs.delete(home, True)
        raise


def write_table(df: DataFrame, root: str, token: str | None = None, expect: str | None = None) -> str:
    """SNK-1: a new whole state, and its name; those before stay. ``expect`` is the state that ``df`` was computed from ("" for none):
    if there is a newer one, nothing is written and ``Conflict`` is raised. The batch of a known ``token`` is not written again."""
    return _write(df, root, True, token, expect)


def append_table(df: DataFrame, root: str, token: str | None = None, expect: str | None = None) -> str:
    """SNK-2: a new state with rows added, as ``write_table`` otherwise. Readers of earlier states don't see the rows."""
    return _write(df, root, False, token, expect)


def snapshot(spark: SparkSession, root: str) -> str:
    """SNK-3: the name of the newest state, which nothing changes any more; no row is copied. FileNotFoundError if nothing was ever written."""
    found = newest(spark, root)
    if found is None:
        raise FileNotFoundError(f"no state of a table in {root}")
    return found


def clear_staging(spark: SparkSession, root: str, hours: float = 24) -> int:
    """Deletes what writers that died left behind ``hours`` ago or earlier, and returns the number of folders."""
    fs, where, _ = file_system(spark, f"{root}/_staging-*")
    old = [s.getPath() for s in fs.globStatus(where) or [] if s.getModificationTime() <= (time.time() - 3600 * hours) * 1000]
    for folder in old:
        fs.delete(folder, True)
    return len(old)


def reserve(spark: SparkSession, ledger: str, batches: str, token: str, n: int) -> int:
    """PRJ-7: the first of ``n`` consecutive numbers for the batch ``token``, noted in the table ``ledger`` before the batch is written.

    Numbers of batches that never became a state of ``batches`` are given again, so none is lost to a crash. A batch must be written
    with its token and the state of ``batches`` seen before this call as ``expect``: then no two batches can be written with the same numbers.
    """
    known = set(tokens(spark, batches))
    rows = load_or_empty(spark, ledger, "token string, first long, n long")
    last = max((r.first + r.n - 1 for r in rows.collect() if r.token in known), default=0)  # one row per batch ever begun
    append_table(spark.createDataFrame([(token, last + 1, n)], "token string, first long, n long").coalesce(1), ledger, token=token)
    return last + 1
