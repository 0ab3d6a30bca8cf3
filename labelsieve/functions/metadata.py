"""Open metadata bags kept as JSON text."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelsieve.schema import ANALYSIS_METADATA_KEYS, ANALYSIS_METADATA_PREFIX


def _own_fields(fields: dict) -> dict:
    return {
        name: value for name, value in fields.items()
        if name not in ANALYSIS_METADATA_KEYS and not name.startswith(ANALYSIS_METADATA_PREFIX)
    }


@F.pandas_udf(T.StringType())
def identity_metadata(text: pd.Series) -> pd.Series:
    """Canonical JSON without analysis results, at any depth; NULL where the text is not JSON."""

    def canonical(value: str | None) -> str | None:
        if value is None:
            return None
        try:
            bag = json.loads(value, object_hook=_own_fields)
        except (ValueError, RecursionError):
            return None
        return json.dumps(bag, ensure_ascii=False, sort_keys=True, separators=(",", ":"))

    return text.map(canonical)


def identity_map(bag: Column) -> Column:
    """The same for a flat ``map<string,string>``: a sorted entry array, without leaving the JVM."""
    kept = F.map_filter(
        bag,
        lambda name, _: ~name.isin(*ANALYSIS_METADATA_KEYS) & ~name.startswith(ANALYSIS_METADATA_PREFIX),
    )
    return F.array_sort(F.map_entries(kept))
