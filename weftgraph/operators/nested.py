"""Nested records as flat tables: one pass, one tagged row per table row.

A visitor, depth first, turns each record into rows (tag, pk, parent_pk,
payload): the tag names the table, pk is the path of positions from the
record's own key down (so parent_pk is pk without its last step), payload has
the scalar fields. The rows can be written partitioned by tag; a schema is
applied to a tag's rows on reading. No step shuffles.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Payload of a visitor: from the ancestors' elements (record first as None, own element last) and positions to named scalars.
Payload = Callable[[list[Column], list[Column]], dict[str, Column]]


@dataclass
class Level:
    """A list inside its parent's element. items: the list, from the ancestors' elements."""

    tag: str
    items: Callable[[list[Column]], Column]
    payload: Payload
    children: list[Level] = field(default_factory=list)


def _row(tag: str, pk: Column, payload: dict[str, Column]) -> Column:
    flat = [x for k, v in payload.items() for x in (F.lit(k), v.cast("string"))]
    values = F.create_map(*flat) if flat else F.create_map().cast("map<string,string>")
    return F.struct(F.lit(tag).alias("tag"), pk.alias("pk"), values.alias("payload"))


def _visit(level: Level, above: list[Column], positions: list[Column], pk: Column) -> Column:
    def one(x: Column, i: Column) -> Column:
        here, at, key = [*above, x], [*positions, i], F.concat(pk, F.array(i.cast("bigint")))
        own = F.array(_row(level.tag, key, level.payload(here, at)))
        parts = [_visit(c, here, at, key) for c in level.children]
        return F.when(x.isNotNull(), F.concat(own, *parts) if parts else own)

    return F.coalesce(F.flatten(F.filter(F.transform(level.items(above), one), lambda a: a.isNotNull())), F.array().cast(ROWS))


ROWS = "array<struct<tag:string,pk:array<bigint>,payload:map<string,string>>>"
TAGGED = "pk array<bigint>, parent_pk array<bigint>, payload map<string,string>, tag string"


def emit_tagged(df: DataFrame, key: str, levels: list[Level], root: tuple[str, dict[str, Column]] | None = None) -> DataFrame:
    """(tag, pk, parent_pk, payload) of every record and element; root: tag and payload of the record's own table, if wanted.

    Null and empty lists have no rows; null elements have none but count for
    positions; repeated records are told apart by `key`, which must be unique.
    """
    pk = F.array(F.col(key).cast("bigint"))
    own = [F.array(_row(root[0], pk, root[1])).cast(ROWS)] if root else []
    rows = F.concat(*own, *[_visit(lv, [], [], pk).cast(ROWS) for lv in levels])
    out = df.select(F.explode(rows).alias("r")).select("r.tag", "r.pk", "r.payload")
    return out.select("tag", "pk", F.slice("pk", F.lit(1), F.size("pk") - 1).alias("parent_pk"), "payload")


def levels_of(schema: T.StructType, prefix: str = "") -> tuple[dict[str, T.DataType], list[Level]]:
    """Scalar fields of a struct, and a level for each of its lists: a visitor for any schema. Structs are taken into their parent under dotted names."""
    scalars: dict[str, T.DataType] = {}
    levels: list[Level] = []

    def get(path: list[str]) -> Callable[[list[Column]], Column]:
        def of(above: list[Column]) -> Column:
            c = F.col(f"`{path[0]}`") if not above else above[-1][path[0]]
            for p in path[1:]:
                c = c[p]
            return c

        return of

    def walk(s: T.StructType, path: list[str]) -> None:
        for f in s.fields:
            here = [*path, f.name]
            if isinstance(f.dataType, T.StructType):
                walk(f.dataType, here)
            elif isinstance(f.dataType, T.ArrayType):
                levels.append(_level(f.dataType.elementType, prefix + ".".join(here), get(here)))
            else:
                scalars[".".join(here)] = f.dataType

    walk(schema, [])
    return scalars, levels


def _level(element: T.DataType, tag: str, items: Callable[[list[Column]], Column]) -> Level:
    if isinstance(element, T.StructType):
        scalars, children = levels_of(element, f"{tag}.")

        def payload(above: list[Column], at: list[Column]) -> dict[str, Column]:
            out = {}
            for name in scalars:
                c = above[-1]
                for p in name.split("."):
                    c = c[p]
                out[name] = c
            return out

        return Level(tag, items, payload, children)
    if isinstance(element, T.ArrayType):
        return Level(tag, items, lambda above, at: {}, [_level(element.elementType, f"{tag}.item", lambda above: above[-1])])
    return Level(tag, items, lambda above, at: {"value": above[-1]})


def apply_schema(tagged: DataFrame, tag: str, schema: dict[str, str]) -> DataFrame:
    """The table of one tag: pk, parent_pk and the payload's fields in their types."""
    own = tagged.filter(F.col("tag") == tag)
    return own.select("pk", "parent_pk", *[F.col("payload")[k].try_cast(t).alias(k) for k, t in schema.items()])


def write_tagged(tagged: DataFrame, path: str) -> None:
    """All tables in one write, a folder for each tag."""
    tagged.write.mode("overwrite").partitionBy("tag").parquet(path)


def read_tagged(spark: SparkSession, path: str, tag: str, schema: dict[str, str]) -> DataFrame:
    """One table of what write_tagged wrote; only its folder is read."""
    return apply_schema(spark.read.schema(TAGGED).parquet(path), tag, schema)
