"""Session construction and shared-storage helpers.

Only two things here are policy:

* every job that needs a lineage cut writes a table (Parquet) under the
  folder the cluster names in ``spark.checkpoint.dir`` — shared, reliable
  storage; a folder of our own is chosen only when that setting is missing
  (tests, local runs);
* scratch tables that a job writes for itself live under the same root, one
  fresh sub-folder per call, so concurrent jobs never share a folder.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, app: str = "seqyield",
                  shuffle_partitions: int | None = None,
                  conf: dict | None = None) -> SparkSession:
    """Session with the settings the library assumes (UTC, AQE, no UI)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = dict(DEFAULT_CONF)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf or {})
    for k, v in settings.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def share_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver imported it.

    For local runs from any working folder; on a cluster the package is
    shipped with the job (``--py-files``) or installed.
    """
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if home not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (home, known) if x)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint root, setting one only when none is configured.

    Order: the SparkContext's current directory, then ``spark.checkpoint.dir``
    from the session; otherwise a fresh local folder in local mode, or a folder
    under the (shared) warehouse directory on a cluster.
    """
    share_package(spark)
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif _is_local(spark):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="seqyield-ckpt-"))
    else:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        sc.setCheckpointDir(warehouse.rstrip("/") + "/_seqyield_checkpoints")
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder path (not created) under the shared checkpoint root."""
    root = ensure_checkpoint_dir(spark)
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    _SCRATCH.append((spark.sparkContext.applicationId, path))
    return path


_SCRATCH: list[tuple[str, str]] = []


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of ``path``, and the path as its object."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def clean_scratch(spark: SparkSession) -> int:
    """Delete the scratch tables of this application; call it when no frame reads them any more.

    Returns how many were deleted.
    """
    app = spark.sparkContext.applicationId
    mine = [path for owner, path in _SCRATCH if owner == app]
    for path in mine:
        fs, p = file_system(spark, path)
        fs.delete(p, True)
    _SCRATCH[:] = [x for x in _SCRATCH if x[0] != app]
    for table in (_TABLES, _FOLDERS):
        for key in [k for k in table if k[0] == app]:
            del table[key]
    return len(mine)


def path_stamp(spark: SparkSession, path: str) -> tuple:
    """(number of files, bytes, latest modification) of a file or folder, through its file system.

    Works on any store Spark reads, so a changed input is noticed there too.
    """
    fs, p = file_system(spark, path)
    if not fs.exists(p):
        return (0, 0, 0)
    status = fs.getFileStatus(p)
    found = [status] if status.isFile() else list(fs.listStatus(p))
    return (len(found), sum(f.getLen() for f in found),
            max([status.getModificationTime(), *(f.getModificationTime() for f in found)]))


def materialize(df, name: str = "table"):
    """Write ``df`` once as a Parquet table under the checkpoint root and return the re-read frame.

    The lineage cut of a reliable checkpoint, in columnar form: later jobs
    read only the columns they need (pruning, pushed filters) instead of
    recomputing the plan, and a lost executor re-reads files.  The table stays
    until :func:`clean_scratch`, as the returned frame reads it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


_TABLES: dict[tuple, str] = {}


def shared_table(spark: SparkSession, key: tuple, build, name: str = "table"):
    """``materialize(build())`` once per application and key; later calls re-read the table.

    Callers include the input files' modification times in ``key`` so a
    changed input builds a new table.
    """
    k = (spark.sparkContext.applicationId, key)
    path = _TABLES.get(k)
    if path is None:
        path = scratch_path(spark, name)
        build().write.parquet(path)
        _TABLES[k] = path
    return spark.read.parquet(path)


_FOLDERS: dict[tuple, str] = {}


def shared_folder(spark: SparkSession, key: tuple, write, name: str = "folder") -> str:
    """Run ``write(path)`` once per application and key; return the folder path."""
    k = (spark.sparkContext.applicationId, key)
    path = _FOLDERS.get(k)
    if path is None:
        path = scratch_path(spark, name)
        write(path)
        _FOLDERS[k] = path
    return path


def literal_rows(spark: SparkSession, rows, schema: str):
    """A small table from driver-side values, built JVM-side (``inline`` of literal structs).

    ``createDataFrame`` on Python lists ships pickled rows to Python workers;
    for a handful of scalars (bounds, picks, p-values) that is all overhead.
    """
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    st = T._parse_datatype_string(schema)
    if not rows:
        return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in st.fields])
    structs = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r, st.fields)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))
