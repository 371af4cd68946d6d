"""Section of an article, read off its link."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Sections in the order in which they win, and the rest.
SECTIONS = ("inland", "ausland", "wirtschaft")
OTHER = "other"
ALL = "all"


def infer_category(link: Column, sections: Sequence[str] = SECTIONS) -> Column:
    lowered = F.lower(F.coalesce(link, F.lit("")))
    branches = [F.when(lowered.contains(f"/{section}/"), section) for section in sections]
    return F.coalesce(*branches, F.lit(OTHER))
