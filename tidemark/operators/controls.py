"""Row-wise controls: named reasons, state-machine audits, scope blocks, capped weights and capacity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The moves that a signal's life cycle allows.
SIGNAL_MOVES = {
    "CANDIDATE": ("VALIDATED", "BLOCKED_BY_DATA", "BLOCKED_BY_RISK"),
    "VALIDATED": ("WAITING_FOR_ENTRY", "EXPIRED", "INVALIDATED", "CANCELLED"),
    "WAITING_FOR_ENTRY": ("ACTIVE", "EXPIRED", "INVALIDATED", "CANCELLED"),
    "ACTIVE": ("PARTIALLY_FILLED", "FILLED", "EXPIRED", "INVALIDATED", "CANCELLED"),
    "PARTIALLY_FILLED": ("FILLED", "INVALIDATED", "CANCELLED"),
    "FILLED": ("CLOSED",),
}


def reasons(named: dict[str, str | Column]) -> Column:
    """The names whose condition holds, in the given order, joined by commas; a null condition does not hold."""
    return F.concat_ws(",", *(F.when(F.expr(c) if isinstance(c, str) else c, n) for n, c in named.items()))


def transition_violations(log: DataFrame, key: str, order: list[str], status: str, moves: dict[str, tuple[str, ...]]) -> DataFrame:
    """Rows whose status may not follow the one before them under ``key``; adds ``came_from``."""
    before = log.withColumn("came_from", F.lag(status).over(Window.partitionBy(key).orderBy(*order)))
    allowed = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, bs in moves.items() for b in bs]
    return before.where(F.col("came_from").isNotNull() & ~F.struct(F.col("came_from").alias("a"), F.col(status).alias("b")).isin(*allowed))


def active_blocks(assessments: DataFrame, requests: DataFrame, scopes: dict[str, str], at: Column) -> DataFrame:
    """Requests stopped by the latest assessment, evaluated by ``at``, of any of their scopes.

    ``scopes`` gives the requests' column for each scope type; one equi-join on (type, value) serves them all.
    """
    known = assessments.where(F.col("evaluated_at") <= at).groupBy("scope_type", "scope_value").agg(F.max_by("blocking", F.struct("evaluated_at", "assessment_id")).alias("blocking"))
    pairs = F.array(*(F.struct(F.lit(t).alias("scope_type"), F.col(c).cast("long").alias("scope_value")) for t, c in scopes.items()))
    asked = requests.select("request_id", F.explode(pairs).alias("s")).select("request_id", "s.scope_type", "s.scope_value")
    return asked.join(known.where("blocking"), ["scope_type", "scope_value"]).groupBy("request_id").agg(F.count(F.lit(1)).alias("blocks"))


def capped_weights(sleeves: DataFrame, portfolio: str, key: str, score: str, cap: float) -> DataFrame:
    """Weights in proportion to ``score``, none above ``cap``, what a cap frees shared among the rest.

    With scores in falling order the first c sleeves sit at the cap, where c is the least number for which the next
    sleeve's share of 1 - c * cap, among those left, is not above it: running sums give it without a loop.
    """
    down = Window.partitionBy(portfolio).orderBy(F.desc(score), key)
    whole = Window.partitionBy(portfolio)
    ranked = sleeves.withColumn("above", F.row_number().over(down) - 1).withColumn("left", F.sum(score).over(down.rowsBetween(0, Window.unboundedFollowing)))
    share = (1 - F.col("above") * cap) * F.col(score) / F.col("left")
    ranked = ranked.withColumn("capped", F.coalesce(F.min(F.when(share <= cap, F.col("above"))).over(whole), F.count(F.lit(1)).over(whole)))
    rest = F.max(F.when(F.col("above") == F.col("capped"), F.col("left"))).over(whole)
    free = F.greatest(F.lit(0.0), 1 - F.col("capped") * cap)
    return ranked.withColumn("weight", F.when(F.col("above") < F.col("capped"), F.least(F.lit(cap), F.greatest(F.lit(0.0), 1 - F.col("above") * cap))).otherwise(free * F.col(score) / rest)).drop("left")


def capacity(run: DataFrame, keys: list[str], levels: list[float], adv: str, limit: float, spread: float, impact: float) -> DataFrame:
    """Orders, participation, fill share and growth after impact at each capital level; ``run`` is a backtest with ``adv``."""
    turns = run.groupBy(*keys).agg(F.max("turnover").alias("most"), F.avg("turnover").alias("mean"), F.first(adv).alias("adv"))
    grid = turns.withColumn("capital", F.explode(F.array(*map(F.lit, levels))))
    grid = grid.withColumn("participation", F.col("capital") * F.col("most") / F.col("adv"))
    grid = grid.withColumn("fill_share", F.when(F.col("participation") <= limit, 1.0).otherwise(limit / F.col("participation")))
    grid = grid.withColumn("impact", impact * F.sqrt("participation")).withColumn("extra", F.lit(spread) + F.col("impact"))
    grid = grid.withColumn("usable", F.col("adv") * limit / F.greatest("most", F.lit(1e-8)))
    levels_of = grid.groupBy(*keys).agg(F.collect_list(F.struct("capital", "extra")).alias("at"))  # one entry a level
    costed = run.drop(adv).join(levels_of, keys).withColumn("at", F.explode("at"))
    grown = costed.groupBy(*keys, F.col("at.capital").alias("capital")).agg(F.sum(F.log1p(F.col("net") - F.col("turnover") * F.col("at.extra"))).alias("log_growth"))
    return grid.join(grown, [*keys, "capital"])
