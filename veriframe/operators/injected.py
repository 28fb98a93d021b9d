"""Functions that a user brings along: one for rows, one for decisions over a key's history. Spark deals out the rows; the
functions are plain Python and run in its tasks, batch by batch."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _arity(fn: Callable, most: int) -> int:
    """How many of the arguments that there are the function takes; all if it takes any number."""
    kinds = [p.kind for p in inspect.signature(fn).parameters.values()]
    if inspect.Parameter.VAR_POSITIONAL in kinds:
        return most
    return min(most, sum(k in (inspect.Parameter.POSITIONAL_ONLY, inspect.Parameter.POSITIONAL_OR_KEYWORD) for k in kinds))


def _rows(f: pd.DataFrame) -> list[dict[str, Any]]:
    """Rows as dicts, with None for what is missing."""
    return f.astype(object).where(f.notna(), None).to_dict("records")


def map_rows(df: DataFrame, fn: Callable[..., dict[str, Any]], schema: str, context: dict[str, Any] | None = None) -> DataFrame:
    """df with the columns of schema, that fn gives for each row, and `error`: the text of what it raised, else null.

    fn takes the row as a dict, and the context as well if it takes two arguments. A row that fails has nulls for its new
    columns and does not stop the others. Columns that schema or `error` name are replaced.
    """
    new = T.StructType.fromDDL(schema)
    kept = [c for c in df.columns if c not in [*new.names, "error"]]
    two = _arity(fn, 2) == 2

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = []
            for row in _rows(f):
                try:
                    got = fn(row, context or {}) if two else fn(row)
                    made.append({**{n: got.get(n) for n in new.names}, "error": None})
                except Exception as e:  # the caller's function may raise anything
                    made.append({**dict.fromkeys(new.names), "error": f"{type(e).__name__}: {e}"})
            yield pd.concat([f[kept].reset_index(drop=True), pd.DataFrame(made, columns=[*new.names, "error"], dtype=object)], axis=1)

    out = T.StructType([*(df.schema[c] for c in kept), *new.fields, T.StructField("error", T.StringType())])
    return df.mapInPandas(run, out)


def decide_rows(passes: DataFrame, key: str, attempt: str, fn: Callable[..., str], most: int = 3, name: str = "decision") -> DataFrame:
    """passes with `name`: what fn(record, attempt, history, most) decides of each, in order of attempts.

    record is the pass as a dict, history the list of those of its key before it; fn may take fewer arguments, from the left. A
    key's passes are in one task, so there should be few for each.
    """
    takes = _arity(fn, 4)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(attempt, kind="stable").reset_index(drop=True)
        rows = _rows(f)
        return f.assign(**{name: [fn(*(r, r[attempt], rows[:i], most)[:takes]) for i, r in enumerate(rows)]})

    return passes.groupBy(key).applyInPandas(run, T.StructType([*passes.schema.fields, T.StructField(name, T.StringType())]))
