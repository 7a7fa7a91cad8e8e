"""The registered queries of this subpackage and their DuckDB twins."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from watchframe.llm import bpe, decision_list, language, lexical, mixing, ngram, pii, pipeline, repeats, simhash, token_counts, topk, toxicity, vafile

_MODULES = [token_counts, ngram, decision_list, language, bpe, topk, mixing, simhash, pii, toxicity, vafile, repeats, lexical]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for m in _MODULES for k, f in vars(m).items() if k.startswith("op") and k[2:3].isdigit()}
    return found | {"pipeline": pipeline.run}


def oracle_sql() -> dict[str, str]:
    found = {k: v for m in _MODULES for k, v in getattr(m, "ORACLE_SQL", {}).items()}
    return found | ({"pipeline": pipeline.ORACLE_SQL} if pipeline.ORACLE_SQL else {})
