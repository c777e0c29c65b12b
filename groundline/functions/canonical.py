"""Canonical JSON, content-addressed ids and percent quoting."""
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def dumps(value) -> str:
    """Sorted keys, no spaces, characters as they are."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), default=str)


@F.pandas_udf(StringType())
def canonical(text: pd.Series) -> pd.Series:
    """A JSON text in canonical form, numbers as Python writes them; null for null."""
    return text.map(lambda t: None if t is None else dumps(json.loads(t)))


@F.pandas_udf(StringType())
def with_defaults(base: pd.Series, more: pd.Series) -> pd.Series:
    """The object `base` with those keys of the object `more` that it lacks, canonical. Null counts as {}."""
    return pd.Series([dumps({**json.loads(m or "{}"), **json.loads(b or "{}")}) for b, m in zip(base, more)], dtype=object)


@F.pandas_udf(StringType())
def with_overrides(base: pd.Series, more: pd.Series) -> pd.Series:
    """The object `base` with all keys of the object `more`, canonical. Null counts as {}."""
    return pd.Series([dumps({**json.loads(b or "{}"), **json.loads(m or "{}")}) for b, m in zip(base, more)], dtype=object)


def json_text(c) -> Column:
    """A text as a JSON string, or null as the word null."""
    whole = F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"})
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def stable_id(prefix: str, **payload) -> Column:
    """prefix:24 hex digits of the SHA-256 of the payload's canonical JSON. Columns are texts; ("json", column) is canonical JSON already."""
    parts = [F.concat(F.lit(f'"{k}":'), F.coalesce(v[1], F.lit("null")) if isinstance(v, tuple) else json_text(v)) for k, v in sorted(payload.items())]
    return F.concat(F.lit(prefix + ":"), F.substring(F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")), 256), 1, 24))


def quoted(c) -> Column:
    """Percent quoting in which only letters, digits and _.-~ stay."""
    return F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
