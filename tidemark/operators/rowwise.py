"""Python functions on rows that start once for each worker, outlive bad rows, and try again in order until enough succeeds."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.cluster import ship

#: Exceptions that one bad row may raise; others are faults of the function and stop the job.
BAD_ROW = (ValueError, ArithmeticError, LookupError, OSError)
#: Rows whose Python values a worker holds at once.
SLICE = 256
_STARTED: dict[str, Any] = {}


def map_rows(df: DataFrame, function: Callable[[Any, dict], dict], added: str, start: Callable[[], Any] = lambda: None, reads: tuple[str, ...] = (), error_col: str = "error", catch: tuple[type[BaseException], ...] = BAD_ROW) -> DataFrame:
    """df with the columns `added` (DDL), the values that function(state, row) returns by name, and error_col, the type of an exception that it raised.

    state is what start() returns, called once for each Python worker, not for each task or batch. row holds the columns in reads (all of them
    if none are named). A row that raises one of catch has null in the added columns and its type in error_col, else null; the
    other rows go on. A value that doesn't fit its column counts as the row's ValueError. df's own columns and rows stay, clashing ones are replaced.
    """
    ship(df.sparkSession)
    schema = df.sparkSession.createDataFrame([], added).schema
    names, new = [f.name for f in schema.fields], {*(f.name.lower() for f in schema.fields), error_col.lower()}
    kept, wanted = [f for f in df.schema.fields if f.name.lower() not in new], list(reads or df.columns)
    once = uuid.uuid4().hex
    types = _arrow_types(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _started(once, start)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in wanted]
                out: dict[str, list] = {n: [] for n in (*names, error_col)}
                for values in zip(*columns, strict=True):
                    try:
                        found = function(state, dict(zip(wanted, values, strict=True)))
                        made = [_fitting(found.get(n), t) for n, t in zip(names, types, strict=True)]
                        error = None
                    except catch as e:
                        made, error = [None] * len(names), type(e).__name__
                    for n, v in zip(names, made, strict=True):
                        out[n].append(v)
                    out[error_col].append(error)
                arrays = [pa.array(out[n], t) for n, t in zip(names, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(f.name)) for f in kept), *arrays, pa.array(out[error_col], pa.string())], [*(f.name for f in kept), *names, error_col])

    ddl = [f"`{f.name}` {f.dataType.simpleString()}" for f in (*kept, *schema.fields)]
    return df.mapInArrow(run, ", ".join([*ddl, f"`{error_col}` string"]))


def _started(once: str, start: Callable[[], Any]) -> Any:
    """What start returned in this worker, kept until another function's start is called."""
    if once not in _STARTED:
        _STARTED.clear()
        _STARTED[once] = start()
    return _STARTED[once]


def _arrow_types(schema) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(f.dataType) for f in schema.fields]


def _fitting(value: Any, kind: pa.DataType) -> Any:
    try:
        return pa.scalar(value, kind).as_py()
    except (pa.ArrowException, TypeError, OverflowError) as e:
        raise ValueError(f"{value!r} isn't a {kind}") from e


def ensemble_margins(base: Column, count: int) -> Column:
    """Crop margins: the base, then in turn below and above it, 15 % of it further each time; rounded to four decimals."""
    steps = [0.15 * ((i + 1) // 2) for i in range(max(1, count))]
    return F.array(*(F.round(base * (1 - d if i % 2 else 1 + d), 4) for i, d in enumerate(steps)))


#: One framing to try.
ATTEMPT = "struct<margin:double,rotation:double,equalize:boolean>"


def attempt_ladder(base: Column, ensemble: int, retry_margins: tuple[float, ...] = (), equalize: bool = False, rotations: tuple[float, ...] = ()) -> Column:
    """An array of ATTEMPT in the order in which they are tried: the ensemble's margins, then wider or narrower ones, an equalised one, turned ones."""
    one = lambda margin, rotation=0.0, even=False: F.struct(margin.cast("double").alias("margin"), F.lit(float(rotation)).alias("rotation"), F.lit(even).alias("equalize"))
    first = F.transform(ensemble_margins(base, ensemble), lambda m: one(m))
    rest = [one(F.lit(float(m))) for m in retry_margins] + ([one(base, 0.0, True)] if equalize else []) + [one(base, r) for r in rotations]
    return F.concat(first, F.array(*rest)) if rest else first


def gather_looks(df: DataFrame, look: Callable[[Any, dict, dict], dict | None], looked: str, attempts_col: str, wanted: int, start: Callable[[], Any] = lambda: None, reads: tuple[str, ...] = (), error_col: str = "error", catch: tuple[type[BaseException], ...] = BAD_ROW) -> DataFrame:
    """df with looks (an array of structs, `looked` being their DDL), tried (how many attempts were made) and error_col.

    Each row's attempts are made in order, and no more once `wanted` (at least one) have succeeded: look(state, row, attempt) gives a look or None.
    Rows without attempts, or with a null array, get none. start, reads, error_col and catch are those of map_rows; a row that raises has no looks.
    """
    need = max(1, wanted)

    def walk(state: Any, row: dict) -> dict:
        found, tried = [], 0
        for attempt in row[attempts_col] or ():
            tried += 1
            if (seen := look(state, row, attempt)) is not None:
                found.append(seen)
                if len(found) >= need:
                    break
        return {"looks": found, "tried": tried}

    fields = ",".join(f"{part.strip().replace(' ', ':', 1)}" for part in looked.split(","))
    return map_rows(df, walk, f"looks array<struct<{fields}>>, tried int", start, (*reads, attempts_col) if reads else (), error_col, catch)
