"""Small tables of fixed values as literals inside an expression."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def constant(value, schema: str) -> Column:
    """A nested literal. The optimizer folds it once, before the query runs."""
    return F.from_json(F.lit(json.dumps(value)), schema)


def lookup(table: Mapping, key: Column, value_type: str) -> Column:
    """``table[key]``; null for a key the table does not hold."""
    return F.try_element_at(constant(dict(table), f"map<string,{value_type}>"), key)
