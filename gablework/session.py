"""Session helpers: reading tables, cutting lineage and choosing join forms by measured size."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a measured relation may be broadcast. At under 200 bytes a row this is a few MB.
BROADCAST_ROWS = 20_000


def get_session(app: str = "gablework", master: str | None = None, **conf: object) -> SparkSession:
    """A session with the settings that the operators expect (UTC, AQE, Arrow)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in {**base, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, str(v))
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint directory: the one already set, else spark.checkpoint.dir, else (local masters only) a temporary one.

    Raises on a cluster where neither is set, because a machine-local folder would not survive a lost executor.
    """
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="gablework-checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise a DataFrame in the shared checkpoint folder; its lineage ends there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def at_most(df: DataFrame, rows: int) -> bool:
    """True if df has no more than this many rows; reads no more than needed to tell."""
    return df.limit(rows + 1).count() <= rows


def join_sized(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", *, salt: Column | None = None, salts: int = 16, max_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Join with a side that is expected to be small but isn't bounded by construction.

    The right side should be materialised (see cut). Measured at up to max_rows rows it is broadcast. Beyond that its rows are
    copied once per salt and joined on (keys, salt), so that a hot key of the left side is spread over `salts` tasks.
    salt: an integer expression over the left side's columns; without it the second form is a plain shuffled join.
    """
    if at_most(right, max_rows):
        return left.join(F.broadcast(right), list(on), how)
    if salt is None or how not in ("inner", "left", "left_semi", "left_anti"):
        return left.join(right, list(on), how)
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn("_salt", F.pmod(salt, F.lit(salts)).cast("int")).join(copies, [*on, "_salt"], how).drop("_salt")
