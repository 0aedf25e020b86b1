"""State machines: transitions from statements, and what they say of each state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flags(transitions: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """machine, state, initial, incoming, outgoing, terminal of every state named by `transitions` (machine, from, to).

    A transition without `from` may leave any state but the one it enters, so it makes every other state outgoing.
    Terminal states have something incoming and nothing outgoing. `initial` has machine, state.
    """
    t = transitions.select("machine", "from", "to").distinct()
    states = t.select("machine", F.explode(F.array("from", "to")).alias("state")).where("state is not null").distinct()
    into = t.select("machine", F.col("to").alias("state")).distinct().withColumn("incoming", F.lit(True))
    out = t.where("`from` is not null").select("machine", F.col("from").alias("state")).distinct().withColumn("leaves", F.lit(True))
    free = t.where("`from` is null").groupBy("machine").agg(F.collect_set("to").alias("to"))
    met = states.join(into, ["machine", "state"], "left").join(out, ["machine", "state"], "left").join(free, "machine", "left")
    anywhere = F.coalesce(F.exists("to", lambda x: x != F.col("state")), F.lit(False))
    met = met.select("machine", "state", F.coalesce("incoming", F.lit(False)).alias("incoming"), (F.coalesce("leaves", F.lit(False)) | anywhere).alias("outgoing"))
    met = met.withColumn("terminal", F.col("incoming") & ~F.col("outgoing"))
    if initial is None:
        return met.withColumn("initial", F.lit(False))
    return met.join(initial.select("machine", "state", F.lit(True).alias("initial")).distinct(), ["machine", "state"], "left").fillna(False, ["initial"])
