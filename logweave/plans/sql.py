"""User SQL over the indexed tables: guarded SELECTs and start-up statements."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_PLAIN_VIEW = re.compile(r"(?i)^\s*CREATE\s+(?:OR\s+REPLACE\s+)?VIEW\b")
_QUOTES = "spark.sql.ansi.doubleQuotedIdentifiers"


class SetupSqlError(RuntimeError):
    """A start-up statement failed."""


@contextmanager
def _quoted_identifiers(spark: SparkSession) -> Iterator[None]:
    """Let "from" name a column while a statement is parsed."""
    before = spark.conf.get(_QUOTES)
    spark.conf.set(_QUOTES, "true")
    try:
        yield
    finally:
        spark.conf.set(_QUOTES, before)


def raw_select(spark: SparkSession, sql: str) -> DataFrame:
    """One SELECT statement; anything else is refused before it runs."""
    if not sql.lstrip().upper().startswith("SELECT"):
        raise ValueError(f"raw_select runs one SELECT, and refuses {sql.split(None, 1)[:1]}")
    with _quoted_identifiers(spark):
        return spark.sql(sql)


def run_setup_sql(spark: SparkSession, statements: Sequence[str]) -> None:
    """Run statements in order, such as CREATE VIEW; the first failure stops with its text.

    Indexed tables are views of the session, so a plain CREATE VIEW over them is one, too."""
    for statement in statements:
        try:
            with _quoted_identifiers(spark):
                spark.sql(_PLAIN_VIEW.sub("CREATE OR REPLACE TEMPORARY VIEW", statement))
        except Exception as error:
            raise SetupSqlError(f"start-up stops at this statement: {statement}\nbecause of: {error}") from error
