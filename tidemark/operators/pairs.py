"""Preference pairs of traces and of boundaries: an equi self-join inside the group, a residual on rank and gap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def preference_pairs(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], carry: Sequence[str], min_gap: float = 0.2, max_pairs: int = 4, strategy: str = "multi_pair", reweight: bool = True
) -> DataFrame:
    """Pairs of a better and a worse row of each group, the widest ``max_pairs`` gaps (one for ``best_vs_worst``).

    ``order`` settles equal scores, as the input order would. Columns: keys, ``winner_``/``loser_`` of ``carry``,
    ``score_gap`` (at least ``min_gap``), ``pair_weight`` (gap over the group's spread, or 1).
    """
    whole = Window.partitionBy(*keys)
    spread = F.max("score").over(whole) - F.min("score").over(whole)
    ranked = rows.select(*keys, *carry, "score", F.row_number().over(whole.orderBy(F.desc("score"), *order)).alias("rank"), spread.alias("spread"))
    side = lambda name: ranked.select(*keys, F.col("score").alias(f"{name}_score"), F.col("rank").alias(f"{name}_rank"), *[F.col(c).alias(f"{name}_{c}") for c in carry], *(["spread"] if name == "winner" else []))
    gap = F.col("winner_score") - F.col("loser_score")
    pairs = side("winner").join(side("loser"), list(keys)).where((F.col("winner_rank") < F.col("loser_rank")) & (gap >= min_gap))
    weight = gap / F.greatest(F.lit(1e-6), F.col("spread")) if reweight else F.lit(1.0)
    top = Window.partitionBy(*keys).orderBy(F.desc("score_gap"), "winner_rank", "loser_rank")
    kept = 1 if strategy == "best_vs_worst" else max(1, max_pairs)
    shaped = pairs.select(*keys, "winner_rank", "loser_rank", *[f"winner_{c}" for c in carry], *[f"loser_{c}" for c in carry], gap.alias("score_gap"), weight.alias("pair_weight"))
    return shaped.withColumn("place", F.row_number().over(top)).where(F.col("place") <= kept)
