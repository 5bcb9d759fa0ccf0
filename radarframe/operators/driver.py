"""A resumable driver of stacks: stages over dates, each committed once, with a log of the dates that failed.

Every stage of a run is one Spark job over all dates that still need it. Its rows go to a folder of their own, and only then
a row a date is added to the manifest, naming that folder: a date is done when the manifest says so, and what a stopped run left unfinished is never read. So a
run that is started again goes on behind the last commit. A stage may say of a date what is wrong with it (a column ``problem``); where a job fails outright, its
dates are halved until the failing ones are alone. Failed dates are logged and left out of later stages; the primary's failure stops the run.
Dates are acquisitions, some hundreds, so the driver may hold their list.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "stage string, date string, folder string, problem string"


@dataclass(frozen=True)
class Stage:
    """``make`` turns the dates' tables of the stages in ``needs`` (by name), or for a first stage nothing, and the list of dates into rows with a column ``date``."""

    name: str
    make: Callable[[Mapping[str, DataFrame], list[str]], DataFrame]
    needs: tuple[str, ...] = ()


class Run:
    """The stages' tables under a folder that all executors share, and their manifest."""

    def __init__(self, spark: SparkSession, folder: str, stages: Sequence[Stage], primary: str | None = None):
        self.spark, self.folder, self.stages, self.primary = spark, folder.rstrip("/"), list(stages), primary

    def manifest(self) -> DataFrame:
        path = f"{self.folder}/manifest"
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(at):
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(path)

    def _state(self) -> tuple[dict[str, dict[str, str]], dict[str, str]]:
        """Of each stage the folders of its dates; and what is wrong with failed dates. Of a date committed twice, the first by folder counts."""
        done: dict[str, dict[str, str]] = {}
        failed: dict[str, str] = {}
        for r in self.manifest().orderBy("stage", "date", "folder").collect():
            if r["problem"] is None:
                done.setdefault(r["stage"], {}).setdefault(r["date"], r["folder"])
            else:
                failed.setdefault(r["date"], f"{r['stage']}: {r['problem']}")
        return done, failed

    def failures(self) -> DataFrame:
        """stage, date, problem of the dates that failed."""
        return self.manifest().where("problem is not null").select("stage", "date", "problem").distinct()

    def table(self, stage: str, dates: Sequence[str] | None = None) -> DataFrame | None:
        """The committed rows of a stage, of all dates or some; None if there are none."""
        folders: dict[str, list[str]] = {}
        for date, folder in self._state()[0].get(stage, {}).items():
            if dates is None or date in dates:
                folders.setdefault(folder, []).append(date)
        found = None
        for folder, own in sorted(folders.items()):
            part = self.spark.read.parquet(folder).where(F.col("date").isin(own))
            found = part if found is None else found.unionByName(part)
        return found

    def _commit(self, rows: list[tuple]) -> None:
        if rows:
            self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")

    def _make(self, stage: Stage, dates: list[str]) -> None:
        try:
            made = stage.make({n: self.table(n, dates) for n in stage.needs}, dates)
            folder = f"{self.folder}/{stage.name}/{uuid.uuid4().hex}"
            made.write.parquet(folder)
        except Exception as error:  # noqa: BLE001  any failure of a date is that date's
            if len(dates) == 1:
                self._commit([(stage.name, dates[0], None, str(error).strip().splitlines()[0][:300] if str(error).strip() else type(error).__name__)])
                return
            half = len(dates) // 2
            self._make(stage, dates[:half])
            self._make(stage, dates[half:])
            return
        back = self.spark.read.parquet(folder)
        told = "problem" in back.columns
        seen = {r["date"]: r["p"] for r in back.groupBy("date").agg((F.max("problem") if told else F.lit(None).cast("string")).alias("p")).collect()}
        self._commit([(stage.name, d, folder, seen[d]) if d in seen else (stage.name, d, None, "the stage gave no rows") for d in dates])

    def run(self, dates: Sequence[str], until: str | None = None) -> dict[str, str]:
        """Runs what is left of the stages, to the one named ``until`` at most, and gives what is wrong with failed dates."""
        for stage in self.stages:
            done, failed = self._state()
            left = [d for d in dict.fromkeys(dates) if d not in done.get(stage.name, {}) and d not in failed]
            if left:
                self._make(stage, left)
            failed = self._state()[1]
            if self.primary in failed:
                raise RuntimeError(f"the primary date {self.primary} failed: {failed[self.primary]}")
            if stage.name == until:
                break
        return {d: p for d, p in self._state()[1].items() if d in set(dates)}


def stack_stages(pixels: DataFrame, cuts: DataFrame, matches: DataFrame, primary: str, rectangle: tuple[int, int, int, int], looks: tuple[int, int] = (2, 8)) -> list[Stage]:
    """The stages of a stack: maps from matched places (date, swath, burst, col, row, to_col, to_row), mosaics on the primary's grid, and interferograms with the primary.

    ``pixels`` and ``cuts`` are those of :func:`pipelines.time_series`."""
    from radarframe.operators import pipelines, registration

    def maps(_, dates):
        own = matches.where(F.col("date").isin(dates) & (F.col("date") != primary))
        found = registration.affines(own, ["date", "swath", "burst"]).withColumn("problem", F.when(F.col("matrix").isNull(), F.lit("places that give no map")))
        first = matches.sparkSession.createDataFrame([(primary, None, None, None, None)] if primary in dates else [], f"date string, swath {dict(matches.dtypes)['swath']}, burst {dict(matches.dtypes)['burst']}, matrix array<double>, problem string")
        return found.unionByName(first)

    def mosaics(tables, dates):
        whole = pixels.where(F.col("date").isin([*dates, primary]))
        done = pipelines.time_series(whole, cuts, tables["maps"].where("matrix is not null").drop("problem"), primary, rectangle)
        return done.where(F.col("date").isin(dates))

    def pairs(tables, dates):
        spark, images = pixels.sparkSession, tables["mosaic"]
        if primary not in dates:  # the primary's mosaic was committed with an earlier run
            images = images.unionByName(mosaics({"maps": tables["maps"]}, [primary]))
        wanted = spark.createDataFrame([(primary, d) for d in dates], "date1 string, date2 string")
        return pipelines.interferograms(images, wanted, looks=looks).withColumnRenamed("date2", "date").drop("date1")

    return [Stage("maps", maps), Stage("mosaic", mosaics, ("maps",)), Stage("interferogram", pairs, ("mosaic", "maps"))]
