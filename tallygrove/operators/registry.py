"""Row rules of the app registry as a batch check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import APP_NAME_PATTERN, PORT_RANGE, RESERVED_NAMES, RULE_MESSAGES
from ..functions.text import strip


def _rules(features: list[str]) -> list[tuple[Column, Column]]:
    """Failing condition and message, in the order in which they are reported."""

    def empty(name: str) -> Column:
        return F.coalesce(strip(F.col(name)) == "", F.lit(True))

    name = strip(F.col("app_name"))
    wanted = F.coalesce(F.col("optional_features"), F.array().cast("array<string>"))
    unknown = F.filter(wanted, lambda f: ~f.isin(*features)) if features else wanted
    low, high = PORT_RANGE
    m = RULE_MESSAGES
    return [
        (empty("app_name"), F.lit(m["name"])),
        (~name.rlike(APP_NAME_PATTERN), F.lit(m["name_form"])),
        (name.isin(*RESERVED_NAMES), F.lit(m["name_reserved"])),
        (empty("username"), F.lit(m["user"])),
        (empty("user_home_directory"), F.lit(m["home"])),
        (empty("dockerfile"), F.lit(m["dockerfile"])),
        (~F.coalesce(F.col("port").between(low, high), F.lit(False)), F.lit(m["port"])),
        (F.size(unknown) > 0, F.concat(F.lit(m["feature"]), F.get(unknown, F.lit(0)))),
    ]


def check_rows(apps: DataFrame, features: list[str]) -> DataFrame:
    """Rows with the message of the first rule they break, or NULL."""
    chain = None
    for failed, message in _rules(features):
        chain = F.when(failed, message) if chain is None else chain.when(failed, message)
    return apps.withColumn("problem", chain)


def count_problems(apps: DataFrame, features: list[str]) -> DataFrame:
    """Rows per first broken rule; rows without a problem count under NULL."""
    return check_rows(apps, features).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))
