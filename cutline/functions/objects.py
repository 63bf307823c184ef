"""JSON objects: typed access through VARIANT, and patches merged into them."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


def typed(raw: Column, path: str, kind: str) -> Column:
    """The value at a path as a type; null where the text is no JSON, the path leads nowhere or the value is of another type."""
    return F.try_variant_get(F.try_parse_json(raw), path, kind)


def kind_of(raw: Column, path: str = "$") -> Column:
    """What stands at a path (OBJECT, ARRAY, BIGINT, ...), without the type parameters; null where nothing does."""
    return F.regexp_extract(F.schema_of_variant(F.try_variant_get(F.try_parse_json(raw), path, "variant")), "^[A-Z]+", 0)


def _merge(base: object, patch: object) -> object:
    if not isinstance(patch, dict):
        return patch
    out = dict(base) if isinstance(base, dict) else {}
    for name, value in patch.items():
        if value is None:
            out.pop(name, None)
        else:
            out[name] = _merge(out.get(name), value)
    return out


@pandas_udf(StringType())
def merged(base: pd.Series, patch: pd.Series) -> pd.Series:
    """JSON merge patch (RFC 7396) at any depth: objects are merged, nulls take members away, all else takes the place of what was there.

    A null base is an empty object, a null patch changes nothing, text that isn't JSON counts as null.
    """

    def load(text: str | None) -> object:
        try:
            return json.loads(text) if text is not None else None
        except ValueError:
            return None

    out = []
    for b, p in zip(base, patch, strict=True):
        below = load(b)
        change = load(p)
        whole = ({} if below is None else below) if change is None else _merge(below, change)
        out.append(json.dumps(whole, separators=(",", ":"), ensure_ascii=False))
    return pd.Series(out, dtype="object")
