"""The named queries: a Spark job over a catalogue and its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliant.plans.bindings import bind, oracle_text
from foliant.sources.catalog import Catalog

Job = Callable[[Catalog], DataFrame]

JOBS: dict[str, Job] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Job], Job]:
    """Register a job; ``oracle`` may name base tables and bindings as ``{name}``."""

    def register(job: Job) -> Job:
        JOBS[name] = job
        if oracle is not None:
            ORACLES[name] = oracle
        return job

    return register


def oracles() -> dict[str, str]:
    """Complete SQL texts; composed late, when the bindings of all modules are known."""
    return {name: oracle_text(sql) for name, sql in ORACLES.items()}


def runnable(job: Job) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: job(bind(spark, sf_dir))
