"""Corpus assembly: registry, dataset selection, unscorable-row filters and
the even per-dataset quota.

Semantics kept from the evaluated tool:
* filters run before the quota, so a quota counts kept rows;
* null references pass both filters (and later normalise to "");
* ``total // n`` samples per dataset, one more for the first ``total % n``
  datasets in registry order; short datasets are not topped up;
* with ``compat_min_one`` a zero quota still yields one sample, as the
  original loop appends before it tests the limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.fixtures import IGNORE_MARKER
from ..sources.registry import DatasetEntry
from .ranking import range_row_number

WS_TRIM = r"^[\t\n\f\r ]+|[\t\n\f\r ]+$"


def not_ignore_marker(ref: Column) -> Column:
    """False only for references whose stripped text is the marker."""
    return ~F.coalesce(F.regexp_replace(ref, WS_TRIM, "") == F.lit(IGNORE_MARKER), F.lit(False))


def not_inaudible(ref: Column) -> Column:
    return ~F.coalesce(F.lower(ref).contains("inaudible"), F.lit(False))


def scorable(df: DataFrame, ref: str = "reference") -> DataFrame:
    return df.where(not_ignore_marker(F.col(ref)) & not_inaudible(F.col(ref)))


def resolve_selection(names: list[str], dataset: str | None = None,
                      adhoc: DatasetEntry | None = None) -> list[str]:
    """Which datasets to read: override beats name, giving both is an error,
    None / "" / "all" keeps all, an unknown name lists the available ones."""
    if adhoc is not None and dataset:
        raise ValueError("an ad-hoc dataset and a dataset name are mutually exclusive")
    if adhoc is not None:
        return ["custom"]
    if not dataset or dataset == "all":
        return list(names)
    if dataset not in names:
        raise KeyError(f"Unknown dataset '{dataset}'. Available: {list(names)}")
    return [dataset]


def registry_of(samples: DataFrame, dataset_col: str = "dataset") -> DataFrame:
    """dataset, position (0-based registry order = name order), rows.

    One row per dataset: the registry is a dimension whose size is the
    number of datasets, not the number of samples."""
    reg = samples.groupBy(dataset_col).agg(F.count("*").alias("rows"))
    return reg.withColumn("position", F.row_number().over(Window.orderBy(dataset_col)) - 1)


def with_quota(registry: DataFrame, total: int, compat_min_one: bool = False) -> DataFrame:
    """Adds ``quota`` to a registry that has ``position``."""
    n = F.count("*").over(Window.partitionBy())
    base = F.floor(F.lit(total) / n)
    quota = base + F.when(F.col("position") < F.lit(total) % n, 1).otherwise(0)
    if compat_min_one:
        quota = F.greatest(quota, F.lit(1))
    return registry.withColumn("quota", quota.cast("long"))


def even_quota(samples: DataFrame, total: int, order_col: str = "sample_id", compat_min_one: bool = False,
               dataset_col: str = "dataset", registry: DataFrame | None = None) -> DataFrame:
    """win_even_quota: the first ``quota`` scorable rows of every dataset by
    ``order_col``; adds ``rn`` (long, 1-based rank within the dataset).  The
    total is divided by the datasets of ``registry`` (default: those that
    occur), whether or not they have scorable rows.  Pass only the columns
    that are needed: the ranked rows are written once."""
    reg = with_quota(registry_of(samples, dataset_col) if registry is None else registry, total, compat_min_one).select(
        dataset_col, "quota")
    ranked = range_row_number(samples, [order_col], dataset_col, out="rn")
    return ranked.join(reg, dataset_col).where(F.col("rn") <= F.col("quota")).drop("quota")


def named_dataset(samples: DataFrame, name: str, registry: DataFrame, dataset_col: str = "dataset") -> DataFrame:
    """The rows of one dataset.  Running it on an unknown name fails with the
    available names; a known dataset without rows is empty."""
    names = registry.agg(F.array_sort(F.collect_set(dataset_col)).alias("names"))
    known = names.select(F.when(F.array_contains("names", name), F.lit(True)).otherwise(F.raise_error(F.concat(
        F.lit(f"Unknown dataset '{name}'. Available: "), F.array_join("names", ", "))).cast("boolean")).alias("known"))
    return samples.where((F.col(dataset_col) == name) & known.scalar())
