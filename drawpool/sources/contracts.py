"""Table contracts: column roles, registration, checks.

A pool, test or seed-train table is any DataFrame that, after
``register_pool``, has ``idx BIGINT NOT NULL`` (unique), ``text`` and
``label_text`` plus whatever extra columns the caller keeps.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ColumnRoles:
    """Names of the id, text and label columns of a source table."""
    idx: str = "idx"
    text: str = "text"
    label: str = "label_text"


class ContractError(ValueError):
    pass


def register_pool(df: DataFrame, roles: ColumnRoles = ColumnRoles(), keep: tuple[str, ...] = (),
                  text_required: bool = True) -> DataFrame:
    """Project a source onto the canonical ``idx, text, label_text`` names.
    Only the named columns are selected, so parquet reads just those."""
    cols = [F.col(roles.idx).cast("long").alias("idx")]
    if text_required or roles.text in df.columns:
        cols.append(F.col(roles.text).alias("text"))
    cols.append(F.col(roles.label).cast("string").alias("label_text"))
    cols += [F.col(k) for k in keep if k not in (roles.idx, roles.text, roles.label)]
    return df.select(*cols)


def contract_summary(df: DataFrame, name: str) -> DataFrame:
    """One row of counts that the contract is checked against:
    rows, distinct ids, null ids, null texts, null labels."""
    has_text = "text" in df.columns
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("idx").alias("n_idx"),
        F.sum(F.col("idx").isNull().cast("long")).alias("n_null_idx"),
        (F.sum(F.col("text").isNull().cast("long")) if has_text else F.lit(0).cast("long")).alias("n_null_text"),
        F.sum(F.col("label_text").isNull().cast("long")).alias("n_null_label"),
    ).select(F.lit(name).alias("table_name"), "*")


def check_contract(df: DataFrame, name: str = "pool") -> dict:
    """Run the contract aggregate (one small action) and raise on
    duplicate or null ids."""
    row = contract_summary(df, name).first().asDict()
    if row["n_null_idx"]:
        raise ContractError(f"{name}: {row['n_null_idx']} null ids")
    if row["n_idx"] != row["n_rows"]:
        raise ContractError(f"{name}: ids are not unique ({row['n_rows']} rows, {row['n_idx']} ids)")
    return row
