"""Row-wise Arrow functions over a DataFrame, and names that do not clash."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quoted(name: str) -> Column:
    """The column of exactly this name."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """Each name, with underscores added until none of ``taken`` has it in any case."""
    used = {t.lower() for t in taken}
    out = []
    for name in names:
        while name.lower() in used:
            name += "_"
        out.append(name)
    return out


def map_rows(df: DataFrame, make: Callable[[], Callable], keep: list[str], fields: list[T.StructField]) -> DataFrame:
    """``keep`` columns of ``df`` plus ``fields``; a kept column that has the name of a field, in any case, is replaced by it.

    ``make()`` runs once a task and returns a function from a RecordBatch to one
    array per field, aligned with the batch's rows.
    """
    new = {f.name.lower() for f in fields}
    keep = [k for k in keep if k.lower() not in new]
    at = [df.columns.index(k) for k in keep]
    names = [*keep, *(f.name for f in fields)]

    def run(batches):
        f = make()
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in at), *f(batch)], names=names)

    out = T.StructType([df.schema[k] for k in at] + fields)
    # mapInArrow looks columns up by name, which a dot or a backquote would mislead
    plain = [fresh(df.columns, f"_column_{k}")[0] if set(".`") & set(c) else c for k, c in enumerate(df.columns)]
    return df.toDF(*plain).mapInArrow(run, out)
