"""Writers: plan CSV, slim GeoJSON, dataset CSV, volume exports."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonarium.sources import volumes

FORMATS = ("cityjson", "gltf", "glb", "ifc", "geojson")


def export_format(c: Column) -> Column:
    """A known export format in lower case, else null."""
    f = F.lower(F.trim(c))
    return F.when(f.isin(*FORMATS), f)


def write_plan_csv(plans: DataFrame, path: str) -> None:
    """Consolidated plans with a header, sorted by municipality and subzone."""
    plans.orderBy(F.lower("municipio"), F.lower("subzona")).write.mode("overwrite").option("header", True).csv(path)


def write_dataset_csv(rows: DataFrame, path: str) -> None:
    """Rows as CSV, arrays joined by a bar."""
    cols = [F.array_join(F.transform(c, lambda x: x.cast("string")), " | ").alias(c) if t.startswith("array") else F.col(c) for c, t in rows.dtypes]
    rows.select(*cols).write.mode("overwrite").option("header", True).csv(path)


def page_records(pages: DataFrame, place: str, source: str, page: str, text: str) -> DataFrame:
    """Page texts as records of one kind: place, source, the md5 of the source's whole text (pages in order, one line break between them), page number, trimmed text, time."""
    whole = pages.groupBy(source).agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(page, F.coalesce(text, F.lit("")).alias("t")))), lambda p: p["t"]), "\n")).alias("file_md5"))
    return pages.join(whole, source).select(
        F.lit("page_text").alias("kind"), F.col(place).alias("municipio"), F.col(source).alias("fuente"), "file_md5", F.col(page).alias("page_number"), F.trim(F.coalesce(text, F.lit(""))).alias("text"), F.unix_timestamp().alias("created_at")
    )


def write_page_records(records: DataFrame, path: str) -> None:
    """Page records as JSON lines, added to what is there."""
    records.write.mode("append").json(path)


def slim_feature(properties: list[str], ring: str, digits: int = 6) -> Column:
    """A GeoJSON feature with kept properties and rounded coordinates, as JSON."""
    points = F.transform(ring, lambda p: F.array(F.round(p["x"], digits), F.round(p["y"], digits)))
    return F.to_json(
        F.struct(
            F.lit("Feature").alias("type"),
            F.struct(*properties).alias("properties"),
            F.struct(F.lit("Polygon").alias("type"), F.array(points).alias("coordinates")).alias("geometry"),
        )
    )


def cityjson(bodies: DataFrame, key: str, ring: str, height: str) -> DataFrame:
    """A CityJSON document for each body: an extruded outline (one ring, or an outer ring and holes) with shared vertices, floor, roof and walls."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, points, h in zip(pdf[key], pdf[ring], pdf[height], strict=True):
                document = volumes.cityjson(k, points, h)
                shell = document["CityObjects"][str(k)]["geometry"][0]["boundaries"][0]
                out.append((k, len(document["vertices"]), len(shell), json.dumps(document)))
            yield pd.DataFrame(out, columns=[key, "n_vertices", "n_faces", "document"])

    kind = dict(bodies.dtypes)[key]
    return bodies.select(key, ring, height).mapInPandas(build, f"{key} {kind}, n_vertices int, n_faces int, document string")
