"""Pipeline state: one row (run state, clock) under a root path, replaced as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators.upsert import current, publish
from tidemark.plans.weeks import run_window

FIRST_CLOCK = "2019-12-03"


class State:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    def get(self) -> dict[str, str]:
        df = current(self.spark, self.root, "state")
        row = df.first() if df is not None else None
        return {"run_state": row.run_state, "current_date": row.current_date} if row else {"run_state": "pending", "current_date": FIRST_CLOCK}

    def put(self, run_state: str, current_date: str) -> None:
        publish(self.frame(self.spark, run_state, current_date), self.root, "state")

    @staticmethod
    def frame(spark: SparkSession, run_state: str, current_date: str) -> DataFrame:
        return spark.createDataFrame([(run_state, current_date)], "run_state string, current_date string")

    def reset(self) -> None:
        """Pending or forced runs begin at the first clock; others go on."""
        s = self.get()
        if s["run_state"] in ("pending", "force_reset"):
            self.put(s["run_state"], FIRST_CLOCK)

    def window(self) -> dict[str, str]:
        return run_window(self.get()["current_date"])

    def done(self) -> None:
        self.put("done", self.window()["next_date"])
