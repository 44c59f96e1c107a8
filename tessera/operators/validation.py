"""Schema contracts, row checks and extraction quality."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T


@dataclass(frozen=True)
class Contract:
    """Column names that a table must, may and must not have."""

    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    forbidden: tuple[str, ...] = field(default=())

    def problems(self, df: DataFrame, strict: bool = False) -> list[str]:
        have = set(df.columns)
        out = [f"missing: {c}" for c in self.required if c not in have]
        out += [f"forbidden: {c}" for c in self.forbidden if c in have]
        if strict:
            known = {*self.required, *self.optional, *self.forbidden}
            out += [f"unexpected: {c}" for c in df.columns if c not in known]
        return out

    def check(self, df: DataFrame, strict: bool = False) -> DataFrame:
        """df itself, or a ValueError that lists every problem. Reads the schema only, no rows."""
        if found := self.problems(df, strict):
            raise ValueError("; ".join(found))
        return df


def fields_read(df: DataFrame) -> set[str]:
    """Names of all columns that the analysed plan of df refers to anywhere below its output."""
    out: set[str] = set()

    def walk(plan) -> None:
        refs = plan.references().toSeq()
        out.update(refs.apply(i).name() for i in range(refs.size()))
        kids = plan.children()
        for i in range(kids.size()):
            walk(kids.apply(i))

    walk(df._jdf.queryExecution().analyzed())
    return out


def guard_fields(df: DataFrame, forbidden: set[str]) -> DataFrame:
    """df itself, or a ValueError where its plan uses a forbidden column."""
    if bad := sorted(fields_read(df) & forbidden):
        raise ValueError(f"plan reads {', '.join(bad)}")
    return df


def completeness(df: DataFrame, fields: list[str]) -> Column:
    """Share of rows in which every field holds more than white space."""
    full = F.lit(True)
    for c in fields:
        full &= F.coalesce(F.trim(F.col(c).cast("string")) != "", F.lit(False))
    return F.avg(full.cast("int"))


def bool_count(x: Column, expected: bool) -> Column:
    spelled = ("true", "1", "yes") if expected else ("false", "0", "no")
    return F.count_if(F.lower(F.trim(x.cast("string"))).isin(*spelled))


def row_errors(checks: dict[str, Column]) -> Column:
    """Array of the names of the failed checks; a check that is null has failed."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in checks.items()]))


def long_cells(df: DataFrame, limit: int = 300) -> DataFrame:
    """(column, longest, n_long) of every text column, in one pass."""
    names = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    each = [F.struct(F.lit(c).alias("column"), F.max(F.length(c)).alias("longest"), F.count_if(F.length(c) > limit).alias("n_long")) for c in names]
    return df.agg(F.array(*each).alias("a")).select(F.inline("a"))


def page_quality(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n_chars, n_words, n_lines, n_short, alnum, scanned, corrupted): how well a page came through extraction."""
    x = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(x, "\n"), lambda s: F.trim(s) != "")
    alnum = F.length(F.regexp_replace(x, r"[^A-Za-z0-9]", ""))
    return df.select(
        key,
        F.length(x).alias("n_chars"),
        T.count_words(x).alias("n_words"),
        F.size(lines).alias("n_lines"),
        F.size(F.filter(lines, lambda s: F.length(F.trim(s)) < 20)).alias("n_short"),
        F.round(F.coalesce(F.try_divide(alnum, F.length(x)), F.lit(0.0)), 6).alias("alnum"),
        F.coalesce(T.looks_scanned(x), F.lit(False)).alias("scanned"),
        (F.length(T.strip_controls(x)) < F.length(x)).alias("corrupted"),
    )
