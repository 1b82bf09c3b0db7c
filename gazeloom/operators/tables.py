"""Changes to stored tables: replace by key, status logs, deletion with what belongs to it."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazeloom.operators.sequence import latest

STATES = ("uploaded", "processing", "anonymized", "processed", "failed")


def replace_keys(df: DataFrame, path: str, key: str) -> None:
    """Rows of the keys in df take the place of those stored; a second run changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def current_status(log: DataFrame, key: str) -> DataFrame:
    return latest(log.where(F.col("status").isin(*STATES)), key, [F.desc("at"), F.desc("seq")])


def without(recordings: DataFrame, gone: DataFrame, *dependents: tuple[DataFrame, str]) -> list[DataFrame]:
    """recordings, and each dependent (table, its key), without the ids in gone."""
    return [recordings.join(gone, "id", "left_anti"), *(d.join(gone.select(F.col("id").alias(k)), k, "left_anti") for d, k in dependents)]


def backfill_duration(recordings: DataFrame, probes: DataFrame) -> DataFrame:
    found = probes.select("id", F.col("duration_seconds").alias("__probe"))
    return recordings.join(found, "id", "left").withColumn("duration_seconds", F.coalesce(F.nullif("duration_seconds", F.lit(0.0)), "__probe")).drop("__probe")


def run_stages(spark: SparkSession, stages: list[tuple[str, object]], attempts: int = 3, wait: float = 0.0) -> dict[str, str]:
    """Runs stages in order; one that fails `attempts` times is recorded and the others go on. A stage's jobs carry its name as a tag (which has no comma), by which `cancel` ends them.

    wait: seconds before the second attempt; each further one waits twice as long.
    """
    outcome = {}
    for name, stage in stages:
        spark.sparkContext.setInterruptOnCancel(True)  # a task that waits gives its core back
        spark.sparkContext.addJobTag(name)  # a session's own tags are seen by the thread that sets them alone
        for attempt in range(1, attempts + 1):
            try:
                stage()
                outcome[name] = "ok"
                break
            except Exception as e:  # noqa: BLE001 - recorded
                outcome[name] = f"failed after {attempt}: {type(e).__name__}"
                if wait and attempt < attempts:
                    time.sleep(wait * 2 ** (attempt - 1))
        spark.sparkContext.removeJobTag(name)
        spark.sparkContext.setInterruptOnCancel(False)
    return outcome


def cancel(spark: SparkSession, name: str) -> None:
    """Ends the running jobs of a stage, from any thread; the stage fails and, if it has attempts left, begins anew."""
    spark.sparkContext.cancelJobsWithTag(name)


def delete_files(files: DataFrame, path: str) -> DataFrame:
    """files with `outcome`: deleted, gone (there was none) or kept (with `error`). Tasks delete; a task that runs again finds the file gone."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)

    def run(batches):
        from pyarrow import fs

        for b in batches:
            outcome, errors = [], []
            for uri in b[path]:
                said, error = "deleted", None
                try:
                    store, place = fs.FileSystem.from_uri(uri)
                    if store.get_file_info(place).type == fs.FileType.NotFound:
                        said = "gone"
                    else:
                        store.delete_file(place)
                except (OSError, ValueError, TypeError) as e:
                    said, error = "kept", str(e)
                outcome.append(said), errors.append(error)
            yield b.assign(outcome=outcome, error=errors)

    # read from a written listing or cache it: every reading deletes
    return files.mapInPandas(run, f"{fields}, outcome string, error string")
