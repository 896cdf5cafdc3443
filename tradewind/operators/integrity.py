"""Orphans, stuck runs and retention on keyed tables."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.operators.membership import children_of, matched
from tradewind.operators.predicates import ago, now

# Hours without progress, and the message a stuck run gets.
STUCK_HOURS = 24
STUCK_MESSAGE = "Timeout: job bloqué depuis plus de 24h"

EXPIRED_DAYS = 7
RETENTION_DAYS = 7


def orphan_rows(children: DataFrame, parents: DataFrame, fk: str, pk: str | None = None):
    """Children whose parent is gone, including those that name none."""
    return matched(children, parents.select(F.col(pk or fk).alias(fk)), fk, "left_anti")


def drop_orphans(children: DataFrame, parents: DataFrame, fk: str, pk: str | None = None):
    """Children that have a parent."""
    return children_of(children, parents, fk, pk)


def mark_stuck(
    jobs: DataFrame,
    as_of=None,
    *,
    hours: int = STUCK_HOURS,
    message: str = STUCK_MESSAGE,
) -> DataFrame:
    """Running rows without an update for ``hours`` become failed."""
    stuck = (F.col("status") == "running") & (F.col("date_upd") < ago(as_of, hours=hours))
    error = F.col("error_message") if "error_message" in jobs.columns else F.lit(None)
    return jobs.withColumns(
        {
            "status": F.when(stuck, F.lit("failed")).otherwise(F.col("status")),
            "error_message": F.when(stuck, F.lit(message)).otherwise(error),
        }
    )


class Retention(NamedTuple):
    """The two halves of a parent table and of its children."""

    kept: DataFrame
    expired: DataFrame
    kept_children: DataFrame
    expired_children: DataFrame


def retention_split(
    parents: DataFrame,
    children: DataFrame,
    *,
    key: str,
    time: str,
    as_of=None,
    days: int = RETENTION_DAYS,
    fk: str | None = None,
) -> Retention:
    """Parents older than ``days`` and their children, apart from the rest.

    A parent without a time, and a child without a parent, is kept.
    """
    fk = fk or key
    old = F.col(time) < ago(as_of, days=days)
    expired = parents.where(old)
    return Retention(
        parents.where(F.coalesce(~old, F.lit(True))),
        expired,
        orphan_rows(children, expired, fk, key),
        children_of(children, expired, fk, key),
    )


def drop_expired(rows: DataFrame, expires: str, as_of=None, days: int = EXPIRED_DAYS):
    """Rows whose expiry is not more than ``days`` past; no expiry is kept."""
    gone = F.col(expires) < ago(as_of, days=days)
    return rows.where(F.coalesce(~gone, F.lit(True)))


def valid_links(rows: DataFrame, expires: str, as_of=None) -> DataFrame:
    """Rows whose expiry lies ahead."""
    return rows.where(F.col(expires) > now(as_of))
