"""Arrow batches as plain Python columns, the one bridge that the non-native operators use."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

Columns = dict[str, list]


def release() -> None:
    """Gives back what a task's end has freed: a worker outlives its tasks, and allocators keep what they once had."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def whole(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, and ``release`` after the task's last batch."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return go


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores as keep it apart from the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def map_columns(df: DataFrame, run: Callable[[Iterator[Columns]], Iterable[Columns]], schema: T.StructType | str) -> DataFrame:
    """``run`` turns a partition's batches (name -> list of values) into batches of ``schema``'s columns."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(kind)

        def columns() -> Iterator[Columns]:
            for b in batches:
                if b.num_rows:
                    yield {n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}

        for c in run(columns()):
            yield pa.RecordBatch.from_arrays([pa.array(c[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(whole(go), kind)


def append_arrays(df: DataFrame, run: Callable[[pa.RecordBatch], tuple[list[pa.Array], pa.Array | None]], schema: T.StructType | str) -> DataFrame:
    """All columns of ``df`` plus those of ``schema``, which ``run`` makes of a batch; it may give a mask of the rows
    that stay, which its columns are cut to already. A new column takes the place of one of the same name."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    new = {f.name.lower() for f in kind}
    kept = [n for n in df.columns if n.lower() not in new]
    all_of = T.StructType([df.schema[n] for n in kept] + list(kind))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(all_of)
        for b in batches:
            made, stay = run(b)
            if stay is not None:
                b = b.filter(stay)
            cols = [b.column(b.schema.get_field_index(n)) for n in kept] + list(made)
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, out, strict=True)], schema=out)

    return df.mapInArrow(whole(go), all_of)


def append_columns(df: DataFrame, run: Callable[[list], Iterable[tuple | None]], source: str, schema: T.StructType | str) -> DataFrame:
    """As ``append_arrays``, where ``run`` makes one tuple of each value of column ``source``; rows for which it gives
    None go."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema

    def of(b: pa.RecordBatch) -> tuple[list[pa.Array], pa.Array | None]:
        made = list(run(b.column(b.schema.get_field_index(source)).to_pylist()))
        stay = None if None not in made else pa.array([m is not None for m in made], pa.bool_())
        rows = made if stay is None else [m for m in made if m is not None]
        types = to_arrow_schema(kind)
        return [pa.array([m[i] for m in rows], f.type) for i, f in enumerate(types)], stay

    return append_arrays(df, of, kind)
