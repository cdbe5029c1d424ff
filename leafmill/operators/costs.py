"""Rates and paid calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Approximate USD rates (per million tokens in and out, per audio minute).
PROVIDER_RATES = {
    "openai": (0.15, 0.60, 0.006),
    "mistral": (0.20, 0.60, 0.003),
    "openrouter": (0.15, 0.60, None),
    "elevenlabs": (None, None, 0.0067),
}


def _rate(provider: str, place: int) -> Column:
    pairs = [(k, v[place]) for k, v in PROVIDER_RATES.items() if v[place] is not None]
    return F.create_map(*[F.lit(x) for pair in pairs for x in pair])[F.col(provider)]


def effective_rates(jobs: DataFrame) -> DataFrame:
    """The rates a job's estimate quotes: the visitor's own provider first, else the server's.

    ``jobs(job_id, llm_provider, stt_provider, server_llm, server_stt, server_in, server_out, server_minute)``;
    a held provider also makes its path available. The rate table is a literal of four rows.
    """
    return jobs.select(
        "job_id", (F.col("server_llm") | F.col("llm_provider").isNotNull()).alias("llm_available"),
        (F.col("server_stt") | F.col("stt_provider").isNotNull()).alias("stt_available"),
        F.coalesce(_rate("llm_provider", 0), "server_in").alias("llm_in"),
        F.coalesce(_rate("llm_provider", 1), "server_out").alias("llm_out"),
        F.coalesce(_rate("stt_provider", 2), "server_minute").alias("stt_per_minute"),
    )


def paid_spend(calls: DataFrame) -> DataFrame:
    """Spend and paid calls per provider and endpoint, with sub-totals and the total."""
    return calls.rollup("provider", "endpoint").agg(F.sum("cost").alias("cost"), F.count("*").alias("calls"))
