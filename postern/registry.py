"""All registered queries of the engine, by name, and the SQL that each must equal."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from postern.plans import catalogue, mail, relational, scalar, textual

_PLANS = (relational, catalogue, textual, scalar, mail)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in _PLANS for k, v in m.QUERIES.items()}
ORACLE: dict[str, str] = {k: v for m in _PLANS for k, v in m.ORACLE.items()}
FLAGSHIP = textual.campaign_tracing
