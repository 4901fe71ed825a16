"""Named steps that add columns: what they need, what they add, and packages that bring more."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from importlib.metadata import entry_points

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .. import schemas
from ..functions import spans
from ..operators import detect
from ..sources.tables import InputError

#: The group of entry points in which other packages name their steps.
GROUP = "hushframe.columns"


@dataclass(frozen=True)
class Step:
    """A function from table and settings to table, with the columns that it reads and adds."""

    name: str
    needs: tuple[str, ...]
    adds: tuple[str, ...]
    run: Callable[..., DataFrame]

    def __call__(self, df: DataFrame, **settings) -> DataFrame:
        missing = [c for c in self.needs if c not in df.columns]
        if missing:
            raise InputError(f"{self.name} needs {', '.join(missing)}")
        out = self.run(df, **settings)
        lacking = [c for c in (*self.adds, *df.columns) if c not in out.columns]
        if lacking:
            raise InputError(f"{self.name} lost or didn't add {', '.join(lacking)}")
        return out


STEPS: dict[str, Step] = {}


def column_step(name: str, needs: tuple[str, ...] = (), adds: tuple[str, ...] = ()) -> Callable[[Callable[..., DataFrame]], Step]:
    """Registers a function as a step; a name is given once."""

    def add(run: Callable[..., DataFrame]) -> Step:
        if name in STEPS:
            raise InputError(f"there is a step {name!r} already")
        STEPS[name] = Step(name, needs, adds, run)
        return STEPS[name]

    return add


def row_step(name: str, needs: tuple[str, ...], adds: str) -> Callable[[Callable[..., dict]], Step]:
    """Registers a function of rows, a batch of them at a time: it gets the needed columns as Arrow arrays by name, and gives the added ones likewise.

    ``adds`` is a schema, as in ``"n int, words array<string>"``; what the function
    gives is cast to it. Other columns pass by, rows keep their order, and no row can
    be lost: a function that gives fewer or more values than rows is an error.
    """

    def add(run: Callable[..., dict]) -> Step:
        made = T._parse_datatype_string(adds)

        def table_step(df: DataFrame, **settings) -> DataFrame:
            clash = [f.name for f in made.fields if f.name in df.columns]
            if clash:
                raise InputError(f"{name} would add {', '.join(clash)}, which is there")
            names, width = [*df.columns, *made.names], len(df.columns)
            at = {c: df.columns.index(c) for c in needs}
            types = [f.type for f in to_arrow_schema(made)]

            def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for part in parts:
                    got = run(**{c: part.column(i) for c, i in at.items()}, **settings)
                    new = [pa.array(got[f], t) if not isinstance(got[f], pa.Array) else got[f].cast(t) for f, t in zip(made.names, types, strict=True)]
                    if any(len(x) != part.num_rows for x in new):
                        raise ValueError(f"{name} gave another number of values than rows")
                    yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[f"_{i}" for i in range(len(names))])

            numbered = T.StructType([T.StructField(f"_{i}", f.dataType) for i, f in enumerate([*df.schema.fields, *made.fields])])
            return df.toDF(*(f"_{i}" for i in range(width))).mapInArrow(batches, numbered).toDF(*names)

        return column_step(name, needs, tuple(made.names))(table_step)

    return add


def step(name: str) -> Step:
    """A registered step, or one that an installed package brings."""
    if name not in STEPS:
        for found in entry_points(group=GROUP):
            if found.name == name:
                found.load()
    if name not in STEPS:
        raise InputError(f"no step {name!r}; there are {', '.join(sorted(STEPS))}")
    return STEPS[name]


def apply_steps(df: DataFrame, names: list[str | tuple[str, dict]]) -> DataFrame:
    """Steps in a row; what one adds the next may need. All are columns of one plan: nothing is run in between."""
    for n in names:
        name, settings = (n, {}) if isinstance(n, str) else n
        df = step(name)(df, **settings)
    return df


@column_step("parse-raw", (schemas.TEXT, schemas.RAW), (schemas.ENTITIES,))
def _parse(df: DataFrame) -> DataFrame:
    return df.withColumn(schemas.ENTITIES, F.coalesce(spans.parse_raw(F.col(schemas.RAW), F.col(schemas.TEXT)), spans.no_spans()))


@column_step("candidates", (schemas.TEXT, schemas.ENTITIES), ("_hf_candidates",))
def _candidates(df: DataFrame, window: int = spans.CONTEXT) -> DataFrame:
    made = spans.validation_candidates(F.col(schemas.TEXT), F.col(schemas.ENTITIES), window)
    return df.withColumn("_hf_candidates", spans.order_candidates(made, F.col(schemas.ENTITIES)))


@column_step("enrich-decisions", ("_hf_candidates", "_hf_decisions"), ("_hf_decisions",))
def _enrich(df: DataFrame) -> DataFrame:
    return df.withColumn("_hf_decisions", spans.enrich_decisions(F.col("_hf_decisions"), F.col("_hf_candidates")))


@column_step("apply-decisions", (schemas.ENTITIES, "_hf_decisions"), (schemas.ENTITIES,))
def _decide(df: DataFrame) -> DataFrame:
    return detect.validate(df, "_hf_decisions")


@column_step("merge", (schemas.TEXT, schemas.ENTITIES, "_hf_suggested"), (schemas.ENTITIES,))
def _merge(df: DataFrame) -> DataFrame:
    return detect.augment(df, "_hf_suggested")


@column_step("finalize", (schemas.TEXT, schemas.ENTITIES), (schemas.FINAL, schemas.TAGGED, schemas.BY_VALUES))
def _finalize(df: DataFrame, labels: list[str] | None = None) -> DataFrame:
    return detect.finalize(df, labels=labels)
