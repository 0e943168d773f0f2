"""Order-free comparison of a Spark result with a DuckDB result: names, types, rows."""

from __future__ import annotations

import pandas as pd

KINDS = {"bigint": "int64", "int": "int32", "string": "string", "double": "double", "boolean": "bool"}


def _tidy(table) -> pd.DataFrame:
    frame = table.to_pandas(types_mapper=pd.ArrowDtype).astype(object)
    frame = frame[sorted(frame.columns)]

    def plain(v):
        return "<null>" if v is None or v is pd.NA or v != v else repr(v.item() if hasattr(v, "item") else v)

    text = frame.apply(lambda c: c.map(plain)) if len(frame) else frame
    return text.sort_values(list(text.columns), ignore_index=True)


def compare(spark_df, relation) -> str | None:
    """None if both are the same table, else what differs."""
    want_table = relation.to_arrow_table()
    want_types = {f.name: str(f.type).replace("large_", "") for f in want_table.schema}
    got_types = {f.name: KINDS.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in spark_df.schema}
    if got_types != want_types:
        return f"schema {got_types} instead of {want_types}"
    got, want = _tidy(spark_df.toArrow()), _tidy(want_table)
    if len(got) != len(want):
        odd = got.merge(want, how="outer", indicator=True).query("_merge != 'both'").head(6)
        return f"{len(got)} rows instead of {len(want)}\n{odd.to_string()[:1500]}"
    if got.equals(want):
        return None
    differ = (got != want).any(axis=1)
    return f"{int(differ.sum())} rows differ\n{got[differ].head(3).to_string()[:900]}\n{want[differ].head(3).to_string()[:900]}"
