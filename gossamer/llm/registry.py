"""Queries and DuckDB oracles of this subpackage."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules that each define QUERY, a name, and run(spark, sf_dir); ORACLE, SQL or None.
MODULES = (
    "q01_warc",
    "q02_quality",
    "q03_license",
    "q04_rules",
    "q05_toxicity",
    "q06_ann",
    "q07_partenum",
    "q08_mixing",
    "q09_unigram",
    "q10_surrogates",
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _name in MODULES:
    _module = import_module(f"{__package__}.{_name}")
    QUERIES[_module.QUERY] = _module.run
    if _module.ORACLE:
        ORACLES[_module.QUERY] = _module.ORACLE
