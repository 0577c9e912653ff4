"""Parallelism for small inputs: a table in few partitions is dealt out before costly row work."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """df, repartitioned only if it has fewer partitions than the session has cores.

    A large table has more partitions than that and is never shuffled by this.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return df  # it has shuffles of its own, and to ask for its partitions would run them
    return df.repartition(wanted) if plan.execute().getNumPartitions() < wanted else df
