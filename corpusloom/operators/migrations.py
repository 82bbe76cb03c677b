"""Changes of a table that may be run again: what is there already is left alone, and a ledger says what was done."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEDGER = "step string, outcome string, duplicates long"


@dataclass(frozen=True)
class AddColumn:
    """A column with a default for the rows that are there; a column of that name stays as it is."""

    column: str
    kind: str
    default: object = None

    @property
    def name(self) -> str:
        return f"add {self.column}"

    def apply(self, table: DataFrame) -> tuple[DataFrame, str, int]:
        if self.column.lower() in {c.lower() for c in table.columns}:
            return table, "present", 0
        return table.withColumn(self.column, F.lit(self.default).cast(self.kind)), "applied", 0


@dataclass(frozen=True)
class UniqueKey:
    """A promise that no two rows share the key. It is not made while some do; rows with a null in the last column of
    the key do not count. Keys are counted by a shuffle with partial sums, so a key of a third of all rows is no matter."""

    columns: tuple[str, ...]

    @property
    def name(self) -> str:
        return f"unique {', '.join(self.columns)}"

    def apply(self, table: DataFrame) -> tuple[DataFrame, str, int]:
        keys = table.filter(F.col(f"`{self.columns[-1]}`").isNotNull()).groupBy(*[f"`{c}`" for c in self.columns]).agg(F.count(F.lit(1)).alias("_n"))
        twice = keys.filter("_n > 1").count()
        return table, "skipped" if twice else "applied", twice


def migrated(table: DataFrame, ledger: DataFrame | None, steps: list[AddColumn | UniqueKey]) -> tuple[DataFrame, DataFrame]:
    """The table after the steps that the ledger does not say to be done, and the ledger after that: step, outcome
    (applied; present: it was there before; skipped: some keys are held twice) and duplicates, the number of such keys.
    A skipped step is tried again by the next run. The ledger has one row a step ever run; steps are few."""
    spark = table.sparkSession
    before = {r.step: r for r in ledger.collect()} if ledger is not None else {}
    for step in steps:
        done = before.get(step.name)
        if done and done.outcome != "skipped" and not (isinstance(step, AddColumn) and step.column not in table.columns):
            continue
        table, outcome, twice = step.apply(table)
        before[step.name] = (step.name, outcome, twice)
    return table, spark.createDataFrame([tuple(r) for r in before.values()], LEDGER)
