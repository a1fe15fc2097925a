"""Registry of the queries over the driver's tables and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from locusflow.plans import alignments, calls, extras, files_of_variants, pairing, ranges, readmodels, records, sites, whole

MODULES = (sites, ranges, alignments, calls, extras, records, whole, pairing, readmodels, files_of_variants)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: s for m in MODULES for k, s in m.ORACLE.items()}
