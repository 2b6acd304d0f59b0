"""Erlang C waiting times of a queue with several servers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def erlang_c(servers: int, rho: Column) -> Column:
    """Probability that an arrival waits; 1 from full load on."""
    load = rho * servers
    # Each term follows from the one before, so no factorial overflows.
    terms = F.aggregate(
        F.sequence(F.lit(1), F.lit(servers)),
        F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("total")),
        lambda acc, k: F.struct((acc["term"] * load / k).alias("term"), (acc["total"] + acc["term"]).alias("total")),
    )
    last = terms["term"] / (F.lit(1.0) - rho)
    return F.when(rho >= 1, F.lit(1.0)).otherwise(last / (terms["total"] + last))


def queue_wait(mu: Column, arrivals: Column, servers: int, saved: Column, most_load: float = 0.9999) -> dict[str, Column]:
    """Load, waiting probability and mean wait when each service is ``saved`` shorter. Rates share one time unit."""
    faster = F.lit(1.0) / F.greatest(F.lit(1.0) / mu - saved, F.lit(1e-6))
    rho = F.least(arrivals / (F.lit(float(servers)) * faster), F.lit(most_load))
    wait = erlang_c(servers, rho)
    return {"rho": rho, "p_wait": wait, "wait": wait / (F.lit(float(servers)) * faster * (F.lit(1.0) - rho))}
