"""Readers: plan and inventory CSV, GeoJSON, building JSON, GML, JSON lines, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PLAN_FIELDS = {
    "municipio": "string", "subzona": "string", "altura_maxima_m": "double", "retranqueo_min_m": "double", "setback_front_m": "double", "setback_side_m": "double",
    "setback_back_m": "double", "front_direction_default": "string", "ocupacion_max": "double", "edificabilidad_max_m2_m2": "double", "source_refs": "string",
}

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])


def plan_csv(spark: SparkSession, path: str) -> DataFrame:
    """Plan rules: ``municipio`` is required, known columns are typed (bad numbers read as null), unknown ones kept in a map."""
    raw = spark.read.option("header", True).option("comment", "#").option("encoding", "UTF-8").csv(path)
    names = {c: c.lstrip("﻿").strip() for c in raw.columns}
    if "municipio" not in names.values():
        raise ValueError("the header lacks municipio")
    raw = raw.toDF(*names.values())
    known = [(F.trim(c).try_cast(t) if t != "string" else F.trim(c)).alias(c) if c in raw.columns else F.lit(None).cast(t).alias(c) for c, t in PLAN_FIELDS.items()]
    extra = [x for c in raw.columns if c not in PLAN_FIELDS for x in (F.lit(c), F.trim(c))]
    return raw.select(*known, (F.create_map(*extra) if extra else F.create_map().cast("map<string,string>")).alias("extra"))


def inventory_csv(spark: SparkSession, path: str) -> DataFrame:
    """Planning inventory without header: ISO-8859-1, semicolons, quotes stripped."""
    schema = "ine string, concello string, instrumento string, data_aprobacion string, estado string"
    return spark.read.csv(path, schema=schema, sep=";", encoding="ISO-8859-1", header=False, quote='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)


def geojson(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Features of a GeoJSON file with typed properties, geometry type and rings as arrays of points."""
    schema = f"features array<struct<properties: struct<{properties}>, geometry: struct<type: string, coordinates: string>>>"
    features = spark.read.option("multiLine", True).schema(schema).json(path).select(F.explode("features").alias("f"))
    c = F.col("f.geometry.coordinates")
    polygon = F.from_json(c, "array<array<array<double>>>")
    multi = F.flatten(F.from_json(c, "array<array<array<array<double>>>>"))
    rings = F.when(F.col("f.geometry.type") == "MultiPolygon", multi).otherwise(polygon)
    points = F.transform(rings, lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    return features.select("f.properties.*", F.col("f.geometry.type").alias("geom_type"), points.alias("rings"))


def building_json(spark: SparkSession, path: str) -> DataFrame:
    """Buildings of a map extract: ways of four points or more, rings closed, tags as a map."""
    schema = "elements array<struct<id: bigint, type: string, tags: map<string,string>, geometry: array<struct<lon: double, lat: double>>>>"
    e = spark.read.option("multiLine", True).schema(schema).json(path).select(F.explode("elements").alias("e")).select("e.*")
    ring = F.transform("geometry", lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y")))
    from zonarium.functions.geometry import closed

    return e.where((F.col("type") == "way") & (F.size("geometry") >= 4)).select("id", "tags", closed(ring).alias("ring"))


def pos_list(text: F.Column, swap: F.Column) -> F.Column:
    """Points of a ``posList``; ``swap`` tells that latitude comes first."""
    n = F.transform(F.split(F.trim(text), r"\s+"), lambda x: x.try_cast("double"))
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size(n) / 2).cast("int") - 1), lambda i: F.struct(F.get(n, 2 * i).alias("x"), F.get(n, 2 * i + 1).alias("y")))
    return F.transform(pairs, lambda p: F.when(swap, F.struct(p["y"].alias("x"), p["x"].alias("y"))).otherwise(p))


def gml_features(spark: SparkSession, path: str, tag: str, fields: str) -> DataFrame:
    """Features of a GML file: one row for each ``tag`` element with the named simple fields."""
    return spark.read.format("xml").option("rowTag", tag).option("ignoreNamespace", True).schema(fields).load(path)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; broken lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def manifest(spark: SparkSession, path: str, files: DataFrame) -> DataFrame:
    """Declared documents of a manifest that exist among ``files`` (``fichero``)."""
    schema = "documentos array<struct<id: string, fichero: string, titulo: string, ambito: string, fuente: string, url: string, url_oficial: string, nota: string>>"
    docs = spark.read.option("multiLine", True).schema(schema).json(path).select(F.explode("documentos").alias("d")).select("d.*")
    return docs.join(files.select("fichero"), "fichero", "left_semi")


def newest_release(paths: list[str]) -> str | None:
    """The path with the latest date-like part."""
    import re

    dated = [(m.group(1), p) for p in paths if (m := re.search(r"(\d{4}-\d{2}-\d{2}(?:\.\d+)?)", p))]
    return max(dated)[1] if dated else None


def sniffed_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV whose delimiter (semicolon, tab or comma) is taken from its first line."""
    first = spark.read.text(path).limit(1).first()
    line = first[0] if first else ""
    sep = max(";\t,", key=line.count)
    return spark.read.option("header", True).option("sep", sep).csv(path)


def footprints(spark: SparkSession, path: str, xmin: float, ymin: float, xmax: float, ymax: float, limit: int | None = None) -> DataFrame:
    """Footprints whose ``bbox`` struct meets a box; the tests reach the Parquet scan as struct-field filters."""
    f = spark.read.parquet(path).where((F.col("bbox.xmin") <= xmax) & (F.col("bbox.xmax") >= xmin) & (F.col("bbox.ymin") <= ymax) & (F.col("bbox.ymax") >= ymin))
    return f.limit(limit) if limit else f


def merged_json(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """JSON records of a folder; of one key the record of the last file (by name) counts."""
    d = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("_file", F.col("_metadata.file_name"))
    return d.groupBy(key).agg(F.max_by(F.struct(*[c for c in d.columns if c != "_file"]), "_file").alias("r")).select("r.*")


def plan_provider(spark: SparkSession, kind: str, path: str | None = None) -> DataFrame:
    """Plan rules from a CSV, from the literal relation, or none; a CSV that is not there falls back to the literals."""
    from zonarium.sources.literals import PLAN_COLUMNS, PLANS, relation

    literal = relation(spark, PLANS, PLAN_COLUMNS)
    if kind == "csv" and path:
        try:
            return plan_csv(spark, path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    return literal if kind in ("csv", "literal") else literal.limit(0)
