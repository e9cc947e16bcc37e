"""A small diversified selection out of ranked rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def diversified_pick(ranked: DataFrame, group: str, size: int = 6, wanted: str | None = None) -> DataFrame:
    """Of each group's rows (item, owner, kind, bucket, rank): one for each price bucket of an unseen
    owner, an unseen kind first, then others in rank order until there are `size`. If none of them is
    `wanted` (a boolean column), the last one gives way to the first wanted row of another owner.

    Of a group only rows that can be picked reach its task: at most `size` owners are taken, so of the
    rows of a bucket and kind, and of the whole group, those of the first size + 1 owners decide.
    """
    flag = F.col(wanted) if wanted else F.lit(False)
    rows = ranked.withColumn("_wanted", F.coalesce(flag, F.lit(False)))

    def firsts(name: str, *keys: str) -> DataFrame:
        """Each owner's first row of the keys, of the first size + 1 owners."""
        own = rows.withColumn("_own", F.row_number().over(Window.partitionBy(group, *keys, "owner").orderBy("rank", "item"))).where("_own = 1")
        return own.withColumn("_nr", F.row_number().over(Window.partitionBy(group, *keys).orderBy("rank", "item"))).where(F.col("_nr") <= size + 1).drop("_own", "_nr")

    kept = firsts("bucket", "bucket", "kind").unionByName(firsts("all", "_wanted")).dropDuplicates([group, "item", "owner", "rank"])

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        options = pdf.sort_values(["rank", "item"]).to_dict("records")
        taken, owners, kinds = [], set(), set()

        def take(r: dict) -> None:
            taken.append(r)
            owners.add(r["owner"])
            kinds.add(r["kind"])

        for b in sorted({r["bucket"] for r in options}):
            unseen = [r for r in options if r["bucket"] == b and r["owner"] not in owners]
            if unseen and len(taken) < size:
                take(next((r for r in unseen if r["kind"] not in kinds), unseen[0]))
        for r in options:
            if len(taken) >= size:
                break
            if r["owner"] not in owners:
                take(r)
        others = {r["owner"] for r in taken[:-1]}
        swap = next((r for r in options if r["_wanted"] and r["owner"] not in others), None)
        if taken and swap is not None and not any(r["_wanted"] for r in taken):
            taken[-1] = swap
        return pd.DataFrame(taken, columns=pdf.columns)

    return kept.groupBy(group).applyInPandas(choose, kept.schema).drop("_wanted")
