"""A case table that grows quarter by quarter.

A load reads one quarter, keeps of its reports those that no quarter before it
in order has, rolls up the drugs, reactions and outcomes of these alone, and
adds them. Reports that a later quarter brought first move to the quarter loaded
now: they are listed as gone from there. So loading the quarters one by one, in
any order, gives what loading them at once does, and each load reads its own raw
files and the stored keys only.

A load writes into a folder of its own and counts once its entry is in the log
(``commits``), under the number that follows the entries it has read; if another
load took that number it fails, so no load misses another's reports.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.commits import commit, entries
from caseloom.config import QUARTERS
from caseloom.operators.cases import CASE, CaseTables, assemble, crowds, keep_first, union_quarters, usable

KEY = "primaryid"


@dataclass(frozen=True)
class Load:
    """One entry of the log."""

    quarter: str
    folder: str
    labelled: bool


class CaseStore:
    """Case table below ``root``, one folder per loaded quarter; ``quarters`` gives their order."""

    def __init__(self, spark: SparkSession, root: str, quarters: Sequence[str] = QUARTERS) -> None:
        self.spark, self.root, self.quarters = spark, root.rstrip("/"), list(quarters)

    def log(self) -> list[Load]:
        """Finished loads, by number."""
        return [Load(**entry) for _, entry in entries(self.spark, self.root)]

    def _rank(self, quarter: str) -> tuple[int, str]:
        # Quarters outside the list come last, in their own order, as in ``keep_first``.
        return (self.quarters.index(quarter) if quarter in self.quarters else len(self.quarters), quarter)

    def _kept(self, loads: Sequence[Load], columns: Sequence[str] | None = None) -> DataFrame | None:
        """Stored rows of ``loads`` that no later load has moved."""
        if not loads:
            return None
        log, parts = self.log(), []
        for load in loads:
            rows = self.spark.read.parquet(f"{self.root}/{load.folder}/cases").withColumn("quarter", F.lit(load.quarter))
            rows = rows.select(*columns) if columns else rows
            # Only loads of earlier quarters that came after this one move its reports.
            movers = [m for m in log[log.index(load) + 1:] if self._rank(m.quarter) < self._rank(load.quarter)]
            if movers:
                gone = union_quarters([self.spark.read.parquet(f"{self.root}/{m.folder}/gone") for m in movers])
                gone = gone.where(F.col("quarter") == load.quarter).select(F.col(KEY).alias("gone"))
                # A null key is one key.
                rows = rows.join(gone, F.col(KEY).eqNullSafe(F.col("gone")), "left_anti")
            parts.append(rows)
        return union_quarters(parts)

    def load(self, quarter: str, tables: CaseTables) -> int:
        """Add one quarter's raw tables; the number of its log entry.

        A quarter that is loaded already is an error: its reports may have moved others.
        """
        done = self.log()
        if quarter in {load.quarter for load in done}:
            raise ValueError(f"quarter {quarter} is loaded already")
        earlier = [load for load in done if self._rank(load.quarter) < self._rank(quarter)]
        later = [load for load in done if load not in earlier]
        demo = keep_first(tables.demo, self.quarters)
        known = self._kept(earlier, CASE)
        if known is not None:
            known = known.select(F.col(KEY).alias("known"))
            demo = demo.join(known, F.col(KEY).eqNullSafe(F.col("known")), "left_anti")
        folder = f"{quarter}-{uuid.uuid4().hex}"
        keys = demo.select(*CASE)

        def touched(table: DataFrame | None) -> DataFrame | None:
            return table.join(keys, CASE, "left_semi") if usable(table) and known is not None else table

        labelled = usable(tables.outc) and not tables.outc.isEmpty()
        # Counted before reports that are not new are left out: that can only count too many.
        crowded = crowds(tables)
        cases = assemble(CaseTables(demo, touched(tables.drug), touched(tables.reac), touched(tables.outc) if labelled else None),
                         self.quarters, one_per_case=False, crowded=crowded)
        cases.drop("quarter").write.parquet(f"{self.root}/{folder}/cases")
        moved = self._kept(later, CASE)
        if moved is not None:
            # The stored keys decide, so the raw files are read once.
            own = self.spark.read.parquet(f"{self.root}/{folder}/cases").select(F.col(KEY).alias("own"))
            moved = moved.join(own, F.col(KEY).eqNullSafe(F.col("own")), "left_semi")
        else:
            moved = keys.limit(0)
        moved.select(*CASE).write.parquet(f"{self.root}/{folder}/gone")
        if not commit(self.spark, self.root, len(done), asdict(Load(quarter, folder, labelled))):
            raise RuntimeError(f"another load finished while {quarter} was loaded; load it again")
        return len(done)

    def cases(self, quarters: Sequence[str] | None = None) -> DataFrame:
        """Case table of the loaded ``quarters`` (all by default); ``serious`` if any of the loads had outcomes."""
        loads = [load for load in self.log() if quarters is None or load.quarter in quarters]
        rows = self._kept(loads)
        if rows is None:
            return self.spark.createDataFrame([], "primaryid bigint, quarter string")
        return rows if any(load.labelled for load in loads) else rows.drop("serious")


def load_files(store: CaseStore, root: str, quarter: str) -> int:
    """Add the raw files of a quarter below ``root``."""
    from caseloom.sources.raw import read_quarter

    tables = read_quarter(store.spark, f"{root.rstrip('/')}/{quarter}", quarter)
    if "DEMO" not in tables:
        raise ValueError(f"no reports of {quarter} in {root}")
    return store.load(quarter, CaseTables(tables["DEMO"], tables.get("DRUG"), tables.get("REAC"), tables.get("OUTC")))
