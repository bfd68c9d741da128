"""The queries of the training-data operators and the SQL that DuckDB can check them by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestack.llm import bpe, editcounts, gif, language, minhash, oracles, packing, quality, sharding, simhash, substrings, toxicity, turns, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": toxicity.query,
        "op2_bpe": bpe.query,
        "op3_quality": quality.query,
        "op4_gif": gif.query,
        "op5_packing": packing.query,
        "op6_editcounts": editcounts.query,
        "op7_sharding": sharding.query,
        "op8_language": language.query,
        "op9_simhash": simhash.query,
        "op10_substrings": substrings.query,
        "op11_minhash": minhash.query,
        "op12_whitening": whitening.query,
        "op13_turns": turns.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_quality": oracles.OP3, "op10_substrings": oracles.OP10}
