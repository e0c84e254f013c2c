"""A data source for paged feature services, and what is built on it: layers with constants, cached layers, point look-ups.

``spark.dataSource.register(PagedFeatures)`` and ``spark.read.format("paged_features")`` with the options

``url``    a template with ``{start}`` (and ``{size}``): ``startIndex``, ``resultOffset`` or any other name;
``size``   features a page, 2,000 by default;
``lanes``  input partitions, 1 by default: lane k reads pages k, k + lanes, ... until one is short;
``pages``  most pages to read, without end by default; ``most`` features likewise;
``fields`` properties that are columns of their own, with types: ``muni string, height double``.

Conditions on such columns go into the address where it has ``{where}``, and conditions that a feature's box (columns
``xmin``, ``xmax``, ``ymin``, ``ymax``) meets a given one where it has ``{bbox}``; the service then applies them and Spark does not.
That needs ``spark.sql.python.filterPushdown.enabled``, which :func:`layer` sets.  What has no counterpart stays with Spark.

Pages are JSON feature collections (GeoJSON ``properties`` or service ``attributes``); ``file:`` and ``http:``
addresses work alike.  A short page, or one that is not there (404, 410, no such file), ends the service; any
other failure is tried three times and then raised, so no feature is lost silently.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

SCHEMA = "start bigint, position int, properties map<string,string>, geometry string"
BOX = ("xmin", "xmax", "ymin", "ymax")
TRIES = 3
_SIGNS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
_CASTS = {"string": str, "double": float, "bigint": int, "int": int}


def _literal(v: object) -> str | None:
    """A value as the services write it; none if they have no spelling for it."""
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return repr(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else None


def _condition(f: Filter, fields: set[str]) -> str | None:
    """A filter in the services' language."""
    if len(f.attribute) != 1 or f.attribute[0] not in fields:
        return None
    name = f.attribute[0]
    if isinstance(f, IsNotNull):
        return f"{name} IS NOT NULL"
    if isinstance(f, In):
        values = [_literal(v) for v in f.value]
        return f"{name} IN ({','.join(values)})" if values and None not in values else None
    value = _literal(getattr(f, "value", None))
    return f"{name}{_SIGNS[type(f)]}{value}" if type(f) in _SIGNS and value is not None else None


def box_of(geometry: dict | None) -> tuple[float, float, float, float] | None:
    """Bounds of a GeoJSON geometry."""
    def points(c: list) -> Iterator[list]:
        if c and isinstance(c[0], (int, float)):
            yield c
        else:
            for inner in c:
                yield from points(inner)

    every = list(points((geometry or {}).get("coordinates") or []))
    return (min(p[0] for p in every), max(p[0] for p in every), min(p[1] for p in every), max(p[1] for p in every)) if every else None


class Lane(InputPartition):
    def __init__(self, number: int) -> None:
        super().__init__(number)
        self.number = number


class PagedFeatures(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_features"

    def schema(self) -> str:
        fields = self.options.get("fields", "").strip()
        return SCHEMA + (f", {fields}, " + ", ".join(f"{b} double" for b in BOX) if fields else "")

    def reader(self, schema: StructType) -> DataSourceReader:
        return (PushingReader if self.options.get("fields", "").strip() else PagedReader)(self.options, schema)


class PagedReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType | None = None) -> None:
        own = {*(x.split()[0] for x in SCHEMA.split(", ")), *BOX}
        self.fields = {f.name: f.dataType.simpleString() for f in schema or [] if f.name not in own} if options.get("fields", "").strip() else {}
        self.conditions: list[str] = []
        self.bbox: dict[str, float] = {}
        self.url, self.size, self.lanes = options["url"], int(options.get("size", 2000)), int(options.get("lanes", 1))
        most = int(options["most"]) if "most" in options else None
        pages = int(options["pages"]) if "pages" in options else None
        self.most = most
        self.pages = min((x for x in (pages, -(-most // self.size) if most is not None else None) if x is not None), default=None)

    def partitions(self) -> list[Lane]:
        return [Lane(k) for k in range(self.lanes)]

    def address(self, start: int) -> str:
        where = urllib.parse.quote(" AND ".join(self.conditions) or "1=1")
        bbox = ",".join(repr(self.bbox[s]) for s in ("left", "bottom", "right", "top")) if self.bbox else ""
        return self.url.replace("{start}", str(start)).replace("{size}", str(self.size)).replace("{where}", where).replace("{bbox}", bbox)

    def typed(self, raw: dict, geometry: dict | None) -> tuple:
        """The values of the columns of their own; what cannot be read as its type is null."""
        out = []
        for name, kind in self.fields.items():
            try:
                out.append(None if raw.get(name) is None else _CASTS.get(kind, str)(raw[name]))
            except ValueError:
                out.append(None)
        return (*out, *(map(float, box) if (box := box_of(geometry)) else (None,) * 4)) if self.fields else ()

    def page(self, start: int) -> list[dict] | None:
        """The features of one page, or None if there is no such page."""
        address = self.address(start)
        for attempt in range(TRIES):
            try:
                with urllib.request.urlopen(address, timeout=60) as page:
                    return json.load(page).get("features") or []
            except urllib.error.HTTPError as e:
                if e.code in (404, 410):
                    return None
                if attempt == TRIES - 1:
                    raise
            except urllib.error.URLError as e:
                if isinstance(e.reason, FileNotFoundError):
                    return None
                if attempt == TRIES - 1:
                    raise
            time.sleep(0.2 * 2**attempt)
        return None

    def read(self, partition: Lane) -> Iterator[tuple]:
        number = partition.number
        while self.pages is None or number < self.pages:
            start = number * self.size
            features = self.page(start) or []
            for k, f in enumerate(features):
                if self.most is not None and start + k >= self.most:
                    return
                raw = f.get("properties") or f.get("attributes") or {}
                yield start, k, {a: None if b is None else str(b) for a, b in raw.items()}, json.dumps(f.get("geometry")), *self.typed(raw, f.get("geometry"))
            if len(features) < self.size:
                return
            number += self.lanes


def layer(spark: SparkSession, url: str, fields: str, **options: str) -> DataFrame:
    """The features of a service with ``fields`` as columns; conditions on them and on the box are sent to the service."""
    spark.dataSource.register(PagedFeatures)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("paged_features").options(url=url, fields=fields, **options).load()


class PushingReader(PagedReader):
    """A reader with columns of their own, whose conditions the service applies."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Keeps what the address can say; the rest is given back.  A box is said only if all its four sides are given."""
        sides = {("xmax", GreaterThanOrEqual): "left", ("xmin", LessThanOrEqual): "right", ("ymax", GreaterThanOrEqual): "bottom", ("ymin", LessThanOrEqual): "top"}
        side = {id(f): sides.get((f.attribute[0], type(f))) for f in filters if hasattr(f, "attribute")}
        given = {s: f for f in filters if (s := side.get(id(f)))}
        boxed = "{bbox}" in self.url and bool(self.fields) and len(given) == 4
        if boxed:
            self.bbox = {s: float(f.value) for s, f in given.items()}
        for f in filters:
            if boxed and (given.get(side.get(id(f))) is f or (isinstance(f, IsNotNull) and f.attribute[0] in BOX)):
                continue
            said = _condition(f, set(self.fields)) if hasattr(f, "attribute") and "{where}" in self.url else None
            if said is None:
                yield f
            else:
                self.conditions.append(said)


@dataclass(frozen=True)
class Layer:
    """One layer of a service: its address, a condition on its properties, and constants that its rows carry."""

    url: str
    constants: dict[str, str] = field(default_factory=dict)
    where: str | None = None
    options: dict[str, str] = field(default_factory=dict)


def layers(spark: SparkSession, wanted: list[Layer]) -> DataFrame:
    """The features of several layers in one relation; a constant stands beside the properties and wins over one of its name."""
    spark.dataSource.register(PagedFeatures)
    out: DataFrame | None = None
    for layer in wanted:
        one = spark.read.format("paged_features").options(url=layer.url, **layer.options).load()
        if layer.where:
            one = one.where(layer.where)
        if layer.constants:
            added = F.create_map(*(F.lit(x) for kv in layer.constants.items() for x in kv))
            one = one.withColumn("properties", F.map_concat(F.map_filter("properties", lambda k, v: ~k.isin(list(layer.constants))), added))
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], SCHEMA)


def first_present(properties: Column, *names: str) -> Column:
    """The first of several names that a feature has with a value, whatever the case of its letters."""
    lower = F.transform_keys(properties, lambda k, v: F.lower(k))
    return F.coalesce(*(F.nullif(F.trim(F.element_at(lower, n.lower())), F.lit("")) for n in names))


def at_point(features: DataFrame, *names: str) -> DataFrame:
    """One row, ``value``: what the first feature of a point query gives under the first present name."""
    first = features.orderBy("start", "position").limit(1)
    return first.select(first_present(F.col("properties"), *names).alias("value"))


def fresh(spark: SparkSession, path: str, seconds: float, read) -> DataFrame:
    """A layer kept as Parquet at ``path``: read again from there unless it is older than ``seconds`` or not there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(place) or time.time() - files.getFileStatus(place).getModificationTime() / 1000 > seconds:
        read().write.mode("overwrite").parquet(path)
    return spark.read.schema(SCHEMA).parquet(path)
