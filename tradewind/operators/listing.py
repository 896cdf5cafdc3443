"""Short ordered lists: runs, files, log lines and filter choices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.functions.geography import department_of


def newest(rows: DataFrame, time: str, key: str, limit: int) -> DataFrame:
    """The newest rows, equal times by higher key: a distributed top-k."""
    return rows.orderBy(F.desc(time), F.desc(key)).limit(limit)


def with_owner(jobs: DataFrame, employees: DataFrame) -> DataFrame:
    """Runs with the first and last name of the employee who started them."""
    names = employees.select("id_employee", "firstname", "lastname")
    joined = jobs.join(names, "id_employee", "left")
    return joined.select(*jobs.columns, "firstname", "lastname")


def top_recent_jobs(jobs: DataFrame, employees: DataFrame, limit: int = 50) -> DataFrame:
    """The newest runs with their owner, newest first; only the kept rows are joined.

    A join need not keep the order, so the kept rows are sorted again after it.
    """
    kept = with_owner(newest(jobs, "date_add", "id_export_job", limit), employees)
    return kept.orderBy(F.desc("date_add"), F.desc("id_export_job"))


def jobs_by_status(jobs: DataFrame, status: str | Sequence[str], limit: int = 50) -> DataFrame:
    wanted = [status] if isinstance(status, str) else list(status)
    return newest(jobs.where(F.col("status").isin(wanted)), "date_add", "id_export_job", limit)


def recent_logs(logs: DataFrame, job: int, limit: int = 100) -> DataFrame:
    """The newest log lines of one run."""
    return logs.where(F.col("id_export_job") == job).orderBy(F.desc("id_log")).limit(limit)


def job_files(files: DataFrame, job: int) -> DataFrame:
    return files.where(F.col("id_export_job") == job).orderBy("entity_name")


def facet_payments(orders: DataFrame) -> DataFrame:
    """Payment methods in use."""
    return orders.where(F.col("payment") != "").select("payment").distinct().orderBy("payment")


def _addresses_by(departments: DataFrame, postcodes: DataFrame, keys: list[str]) -> DataFrame:
    """Every row of the map with the number of postcodes that fall into it."""
    code = department_of(F.col("postcode")).alias("dept_code")
    counts = postcodes.select(code).groupBy("dept_code").agg(F.count("*").alias("n"))
    joined = departments.join(counts, "dept_code", "left")
    return joined.groupBy(*keys).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("addresses"))


def facet_regions(departments: DataFrame, addresses: DataFrame | None = None) -> DataFrame:
    """All regions by name; with ``addresses`` also how many lie in each."""
    keys = ["region_code", "region_name"]
    if addresses is None:
        return departments.select(keys).distinct().orderBy("region_name")
    return _addresses_by(departments, addresses, keys).orderBy("region_name")


def facet_departments(departments: DataFrame, addresses: DataFrame | None = None) -> DataFrame:
    """All departments by code; with ``addresses`` also how many lie in each."""
    keys = ["dept_code", "dept_name"]
    if addresses is None:
        return departments.select(keys).distinct().orderBy("dept_code")
    return _addresses_by(departments, addresses, keys).orderBy("dept_code")
