"""Rules for tenants and terms, as columns and as checks of single values."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import Invalid

BAD_TENANT = "(?U)[\\s\\p{Cc}/]"


def tenant_error(tenant: Column) -> Column:
    return F.when(tenant.isNull() | (tenant == ""), "tenant must not be empty").when(
        tenant.rlike(BAD_TENANT), "tenant must not hold white space, control characters or /"
    )


def term_error(term: Column) -> Column:
    return F.when(term.isNull() | (term == ""), "term must not be empty").when(
        F.contains(term, F.lit("\0")), "term must not hold NUL"
    )


def judged(ops: DataFrame) -> DataFrame:
    """An operation log with ``error``: null, or why an operation is refused."""
    kind = F.when(F.col("op").isNull() | ~F.col("op").isin("index", "set", "delete"), "no such operation")
    number = F.when(F.col("weight") < 0, "weight must not be negative")
    return ops.withColumn("error", F.coalesce(tenant_error(F.col("tenant")), term_error(F.col("term")), kind, number))


def split_valid(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected); the rejected have ``error`` and ``status`` columns."""
    error = F.coalesce(tenant_error(F.col("tenant")), term_error(F.col("term")))
    judged = rows.withColumn("error", error)
    return (
        judged.where("error is null").drop("error"),
        judged.where("error is not null").withColumn("status", F.lit(Invalid.status)),
    )


def check_tenant(tenant: str) -> None:
    if not tenant:
        raise Invalid("tenant must not be empty")
    if any(c == "/" or c.isspace() or unicodedata.category(c) == "Cc" for c in tenant):
        raise Invalid("tenant must not hold white space, control characters or /")


def check_term(term: str) -> None:
    if not term:
        raise Invalid("term must not be empty")
    if "\0" in term:
        raise Invalid("term must not hold NUL")
