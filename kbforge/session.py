"""Session construction and cluster-safe helpers shared by every job."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import SparkSession

# Broadcasts are only made for data whose size is checked against this bound.
DEFAULT_BROADCAST_BYTES = 64 * 1024 * 1024
# One block of vectors in exact search; a task holds one of each side.
DEFAULT_BLOCK_BYTES = 32 * 1024 * 1024


# Set only where nobody else has: a submitted setting always wins.
_DEFAULTS = {"spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false",
             "spark.ui.showConsoleProgress": "false"}


def _submitted() -> set[str]:
    """Keys that the launcher (spark-submit and its files) has set."""
    if "PYSPARK_GATEWAY_PORT" not in os.environ:
        return set()
    from pyspark import SparkConf

    return {k for k, _ in SparkConf().getAll()}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "kbforge", driver_memory: str | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session for these jobs.

    Only what the caller passes is set.  Without a submitted value the time zone is
    UTC and the UI is off (no server is started); everything else, shuffle
    partitions and memory included, stays as submitted or as Spark's default.
    """
    known = _submitted()
    chosen = {k: v for k, v in _DEFAULTS.items() if k not in known}
    if shuffle_partitions is not None:
        chosen["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if driver_memory is not None:
        chosen["spark.driver.memory"] = driver_memory
    builder = SparkSession.builder
    if "spark.app.name" not in known:
        builder = builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in (chosen | (extra or {})).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session (tests) may go without: it gets a scratch folder of its own.
    Anywhere else a missing setting is an error, as executors do not see the
    driver's folders.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        spark.sparkContext.setCheckpointDir(configured)
        return configured
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"spark.checkpoint.dir must name a shared folder (master {master})")
    local = tempfile.mkdtemp(prefix="kbforge-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", local)
    spark.sparkContext.setCheckpointDir(local)
    return local


def block_limit(spark: SparkSession) -> int:
    """Byte bound of one block of vectors in exact search (``spark.kbforge.block.maxBytes``)."""
    return int(spark.conf.get("spark.kbforge.block.maxBytes", str(DEFAULT_BLOCK_BYTES)))


def broadcast_limit(spark: SparkSession) -> int:
    """Byte bound for explicit broadcasts (``spark.kbforge.broadcast.maxBytes``)."""
    return int(spark.conf.get("spark.kbforge.broadcast.maxBytes", str(DEFAULT_BROADCAST_BYTES)))


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop file system of ``path`` (works on any FS)."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(hpath))


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(hpath):
        fs.delete(hpath, True)


_RUN_FOLDERS: list = []


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder for intermediate tables below the shared checkpoint folder.

    It is deleted when the driver program ends; results that shall stay are written
    to a path of the caller's.
    """
    path = f"{checkpoint_dir(spark).rstrip('/')}/kbforge-runs/{name}-{uuid.uuid4().hex}"
    if not _RUN_FOLDERS:
        atexit.register(_delete_run_folders)
    sc = spark.sparkContext
    _RUN_FOLDERS.append((sc._jvm, sc._jsc.hadoopConfiguration(), path))
    return path


def _delete_run_folders() -> None:
    while _RUN_FOLDERS:
        jvm, conf, path = _RUN_FOLDERS.pop()
        try:
            hpath = jvm.org.apache.hadoop.fs.Path(path)
            hpath.getFileSystem(conf).delete(hpath, True)
        except (Py4JError, OSError):     # the JVM has ended before: the folders stay
            return


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder through its Hadoop file system; none if it does not exist."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [st.getPath().getName() for st in fs.listStatus(hpath)] if fs.exists(hpath) else []


def create_file(spark: SparkSession, path: str) -> bool:
    """Create an empty file; False if it exists already."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(hpath):
        return False
    fs.create(hpath, False).close()
    return True


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``kbforge`` importable in executor Python workers (once per app).

    Equivalent to ``--py-files kbforge.zip``: the zip is built in memory from the
    driver's copy and written into the shared folder named by
    ``spark.checkpoint.dir`` (a local scratch folder only when that is unset, as in
    tests); Spark distributes it to the executors.
    """
    import hashlib
    import io
    import zipfile

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED or spark.conf.get("spark.kbforge.shipPackage", "true").lower() == "false":
        return   # already shipped, or installed on the executors (pip install .)
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, dirnames, filenames in sorted(os.walk(pkg_dir)):
            dirnames[:] = sorted(d for d in dirnames if d != "__pycache__")
            for f in sorted(filenames):
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    data = buf.getvalue()
    digest = hashlib.sha1(data).hexdigest()[:16]
    target = f"{checkpoint_dir(spark).rstrip('/')}/kbforge-pyfiles/{digest}/kbforge.zip"
    jvm = sc._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(target)
    fs = hpath.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(hpath):
        out = fs.create(hpath, True)
        out.write(bytearray(data))
        out.close()
    sc.addPyFile(target)
    _SHIPPED.add(app)


def spread(df):
    """Round-robin over ``spark.kbforge.inputTasks`` tasks, if that is set.

    For inputs that arrive in fewer splits than there are cores (one row group) and
    need much work per byte.  Unset, the scan's own splits are used.
    """
    tasks = df.sparkSession.conf.get("spark.kbforge.inputTasks", None)
    return df.repartition(int(tasks)) if tasks else df


def code_digest() -> str:
    """Digest of this package's source files."""
    import hashlib

    h = hashlib.sha1()
    root = os.path.dirname(os.path.abspath(__file__))
    for folder, names, files in sorted(os.walk(root)):
        names.sort()
        for f in sorted(files):
            if f.endswith(".py"):
                with open(os.path.join(folder, f), "rb") as src:
                    h.update(src.read())
    return h.hexdigest()[:20]


def input_fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """Stable digest of input files (path, size, modification time) through the
    Hadoop file system: equal inputs give equal digests, any rewrite changes it."""
    import hashlib

    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    h = hashlib.sha1()
    for p in sorted(paths):
        hpath = jvm.org.apache.hadoop.fs.Path(p)
        fs = hpath.getFileSystem(conf)
        it = fs.listFiles(hpath, True)
        entries = []
        while it.hasNext():
            st = it.next()
            entries.append((st.getPath().toString(), st.getLen(), st.getModificationTime()))
        for e in sorted(entries):
            h.update(repr(e).encode())
    return h.hexdigest()[:20]
