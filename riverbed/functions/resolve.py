"""Paths to typed scalars of an event: from a VARIANT, or from the typed columns of a table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.paths import Path, offset_of

#: One scalar of an event, as a column type; a missing one is a null struct.
SCALAR = "struct<tag:string,num:double,str:string,bool:boolean>"


@dataclass(frozen=True)
class Scalar:
    """Columns of one value: ``tag`` is null when the value is missing or a container. ``only`` is a tag known beforehand."""

    tag: Column
    num: Column
    text: Column
    flag: Column
    only: str | None = None

    def struct(self) -> Column:
        return F.when(self.tag.isNotNull(), F.struct(self.tag.alias("tag"), self.num.cast("double").alias("num"), self.text.alias("str"), self.flag.alias("bool")))


def _tag_of_kind(kind: Column) -> Column:
    return (
        F.when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "bool")
        .when(kind.isin("TINYINT", "SMALLINT", "INT", "BIGINT", "FLOAT", "DOUBLE") | kind.startswith("DECIMAL"), "number")
    )


def variant_tag(v: Column) -> Column:
    """null, bool, number or string; NULL for a missing value, an object or an array."""
    return F.when(v.isNull(), None).when(F.is_variant_null(v), "null").otherwise(_tag_of_kind(F.schema_of_variant(v)))


def _once(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` mentions it."""
    return F.transform(F.array(c), f)[0]


def variant_struct(v: Column) -> Column:
    """``variant_scalar(v).struct()`` with the value looked up once, and its tag too; a filter is better off without lambdas."""

    def scalar(x: Column, tag: Column) -> Column:
        guard = lambda t, kind: F.when(tag == t, F.try_variant_get(x, "$", kind))
        return F.when(tag.isNotNull(), F.struct(tag.alias("tag"), guard("number", "double").alias("num"), guard("string", "string").alias("str"), guard("bool", "boolean").alias("bool")))

    tag = lambda x: F.when(x.isNull(), None).when(F.is_variant_null(x), "null").otherwise(_once(F.schema_of_variant(x), _tag_of_kind))
    return _once(v, lambda x: _once(tag(x), lambda t: scalar(x, t)))


def variant_scalar(v: Column) -> Scalar:
    """Casts are guarded by the tag: an unguarded one would read ``"1"`` as a number."""
    tag = variant_tag(v)
    guard = lambda t, kind: F.when(tag == t, F.try_variant_get(v, "$", kind))
    return Scalar(tag, guard("number", "double"), guard("string", "string"), guard("bool", "boolean"))


class VariantEvent:
    """An event as one VARIANT column."""

    def __init__(self, event: Column | str):
        self.event = F.col(event) if isinstance(event, str) else event

    def value(self, path: Path) -> Column:
        v = self.event
        for segment in path:
            if "'" in segment and '"' in segment or "\\" in segment:  # no path literal can say it
                by_key = F.element_at(F.try_variant_get(v, "$", "map<string,variant>"), F.lit(segment))
            else:
                quote = "'" if '"' in segment else '"'
                by_key = F.try_variant_get(v, f"$[{quote}{segment}{quote}]", "variant")
            at = offset_of(segment)
            v = by_key if at is None else F.coalesce(by_key, F.try_variant_get(v, f"$[{at}]", "variant"))
        return v

    def scalar(self, path: Path) -> Scalar:
        return variant_scalar(self.value(path))

    def struct(self, path: Path) -> Column:
        return variant_struct(self.value(path))

    def elements(self, path: Path) -> Column:
        """The scalar elements of an array as SCALAR structs; NULL if there is no array."""
        items = F.try_variant_get(self.value(path), "$", "array<variant>")
        return F.filter(F.transform(items, lambda x: variant_scalar(x).struct()), lambda x: x.isNotNull())


class TypedEvent:
    """An event spread over typed columns; ``columns`` maps paths to column names. A NULL is a JSON null.

    Terms compile to plain comparisons of the columns, so they reach the Parquet scan.
    """

    def __init__(self, df: DataFrame, columns: dict[Path, str]):
        self.columns, self.types = columns, {p: df.schema[c].dataType for p, c in columns.items()}

    def scalar(self, path: Path) -> Scalar:
        none = F.lit(None)
        if len(path) > 1 and path not in self.columns and isinstance(self.types.get(path[:-1]), T.ArrayType) and (at := offset_of(path[-1])) is not None:
            return self._of(F.get(F.col(self.columns[path[:-1]]), at), self.types[path[:-1]].elementType, missing=True)
        if path not in self.columns or isinstance(self.types[path], T.ArrayType):
            return Scalar(none.cast("string"), none.cast("double"), none.cast("string"), none.cast("boolean"), "none")
        return self._of(F.col(self.columns[path]), self.types[path])

    def struct(self, path: Path) -> Column:
        return self.scalar(path).struct()

    def _of(self, c: Column, kind: T.DataType, missing: bool = False) -> Scalar:
        none = F.lit(None)
        tag = "bool" if isinstance(kind, T.BooleanType) else "number" if isinstance(kind, T.NumericType) else "string"
        shown = F.when(c.isNotNull(), tag) if missing else F.when(c.isNull(), "null").otherwise(tag)
        text = c.cast("string") if not isinstance(kind, T.StringType) else c
        return Scalar(shown, c if tag == "number" else none.cast("double"), text if tag == "string" else none.cast("string"), c if tag == "bool" else none.cast("boolean"), tag)

    def elements(self, path: Path) -> Column:
        kind = self.types.get(path)
        if not isinstance(kind, T.ArrayType):
            return F.lit(None).cast(f"array<{SCALAR}>")
        return F.transform(F.col(self.columns[path]), lambda x: self._of(x, kind.elementType).struct())
