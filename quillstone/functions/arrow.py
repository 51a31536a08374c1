"""Nested Arrow arrays from Python values, a column at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def lists(values: list[list], kind: pa.DataType) -> pa.Array:
    """Lists of values of a kind, which may be a struct (given as dicts). pa.array() takes several times as long for structs."""
    offsets = np.concatenate(([0], np.cumsum([len(v) for v in values], dtype=np.int64))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), _flat([x for v in values for x in v], kind))


def _flat(values: list, kind: pa.DataType) -> pa.Array:
    if not pa.types.is_struct(kind):
        return pa.array(values, kind)
    columns = []
    for field in kind:
        column = [v[field.name] for v in values]
        columns.append(lists(column, field.type.value_type) if pa.types.is_list(field.type) else pa.array(column, field.type))
    return pa.StructArray.from_arrays(columns, fields=list(kind))
