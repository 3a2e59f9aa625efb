"""Session, table access and the few helpers that every operator shares."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: At most this many keys can each hold a share of 1/HEAVY_SHARE of all rows, so a list of them may be broadcast.
HEAVY_SHARE = 64
#: Stored steps after which the driver gives back what the finished ones held.
RELEASE_STEPS = 6
#: The JVM's diagnostic commands, and the one that returns freed memory outside the heap to the system; not every JVM has it.
COMMANDS, TRIM = "com.sun.management:type=DiagnosticCommand", "systemTrimNativeHeap"


def session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the library is tested under."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("pkgloom")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


@functools.cache
def own_folder(purpose: str) -> str:
    """A temporary folder of this process, removed at its end."""
    path = tempfile.mkdtemp(prefix=f"pkgloom-{purpose}-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per context, so that Arrow functions find it wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_pkgloom_shipped", False):
        return
    home = Path(__file__).resolve().parent
    target = Path(own_folder("package")) / "pkgloom.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for path in sorted(home.rglob("*.py")):
            archive.write(path, Path(home.name) / path.relative_to(home))
    context.addPyFile(str(target))
    context._pkgloom_shipped = True


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder. Every query reads its tables here, and so has the package on its executors."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def checkpoint_folder(master: str, named: str | None) -> str:
    """The folder for checkpoints: that which the session names. A folder of this machine is taken only where that is unset and
    the master is local, since executors elsewhere could not read it."""
    if named:
        return named
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return own_folder("checkpoints")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back, so that later stages do not recompute it
    and a lost executor does not lose it. Uses ``spark.checkpoint.dir`` of the session (see ``checkpoint_folder``). A checkpoint is
    removed once nothing refers to it, where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set, as ``session`` does.
    After every RELEASE_STEPS steps of a context what the finished ones held is given back (see ``release``)."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(checkpoint_folder(context.master, df.sparkSession.conf.get("spark.checkpoint.dir", None)))
    stored = df.checkpoint()
    context._pkgloom_steps = getattr(context, "_pkgloom_steps", 0) + 1
    if context._pkgloom_steps % RELEASE_STEPS == 0:
        release(df.sparkSession)
    return stored


def release(spark: SparkSession) -> None:
    """Give back what finished steps held: frames that are no longer used leave the driver's heap, and with them the checkpoints,
    shuffles and broadcasts that Spark removes when their frames are collected; what the driver's JVM, above all
    its compiler, has freed outside the heap goes back to the system, where the JVM has a command for that. For queries of many steps."""
    context = spark.sparkContext
    jvm, gateway = context._jvm, context._gateway
    jvm.System.gc()
    # the server's own class cannot be called from outside, only the interface
    calls = {m.getName(): m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods()}
    server, commands = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), jvm.javax.management.ObjectName(COMMANDS)

    def ask(call: str, *values):
        given = gateway.new_array(jvm.java.lang.Object, len(values))
        for k, value in enumerate(values):
            given[k] = value
        return calls[call].invoke(server, given)

    if ask("isRegistered", commands) and any(o.getName() == TRIM for o in ask("getMBeanInfo", commands).getOperations()):
        ask("invoke", commands, TRIM, None, None)


def key_spelling(column: Column) -> Column:
    """Lower case, every run of characters that are neither letters nor digits as one blank, trimmed; null gives ''."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(column, F.lit(""))), r"[^\p{L}\p{Nd}]+", " "))


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have yet, whatever the case of their letters."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def small(df: DataFrame, limit: int, what: str) -> list:
    """The rows of a dimension that must not exceed ``limit`` rows; fails instead of flooding the driver."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what} has more than {limit} rows")
    return rows


def join_skewed(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with one row per key of ``groups``, whose column ``size`` is the number of rows with that key.

    A key with at least 1/HEAVY_SHARE of all rows would land in a single task; there are at most HEAVY_SHARE such
    keys, so these are joined by broadcast and the rest by an ordinary shuffled join. ``how`` is inner or left;
    keys are compared as non-null values."""
    total, most = groups.agg(F.sum(size), F.max(size)).first()
    total = max(total or 0, HEAVY_SHARE)
    if (most or 0) * HEAVY_SHARE < total:
        return rows.join(groups, keys, how)  # no key is heavy
    heavy = F.col(size) * HEAVY_SHARE >= F.lit(total)
    few = F.broadcast(groups.where(heavy))
    hot = rows.join(few, keys, "inner")
    cold = rows.join(F.broadcast(groups.where(heavy).select(*keys)), keys, "left_anti").join(groups.where(~heavy), keys, how)
    return hot.unionByName(cold)
