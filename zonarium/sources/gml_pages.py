"""Whole layers of services that answer in GML, page by page, without holding a page's tree.

``spark.read.format("gml_pages")`` with the options ``url`` (``{start}`` and ``{size}`` are filled in), ``layer`` (the name of a
feature element, whatever its namespace), ``size`` (features a page), ``lanes`` (input partitions) and ``pages`` (most pages).

Elements are pulled from the stream and dropped once read.  A page ends the read if it has fewer feature elements than
``size``, counted as they stand in the document: a feature whose geometry cannot be read gives no row but counts.
The first page must be there and whole; a later one that is not there ends the read, one that breaks off is an error.
"""

from __future__ import annotations

import re
import time
import urllib.error
import urllib.request
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from typing import IO

from pyspark.sql.datasource import DataSource, DataSourceReader

from zonarium.functions.gml import EAST_FIRST, LATITUDE_FIRST, LATITUDES, LONGITUDES
from zonarium.sources.paged import TRIES, Lane

SCHEMA = "start bigint, position int, properties map<string,string>, parts array<array<array<struct<x:double,y:double>>>>"

Ring = list[tuple[float, float]]


def _name(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _points(text: str) -> Ring:
    """Pairs of a list of numbers, or of pairs with commas; what is no number is left out."""
    if "," in text:
        pairs = [pair.split(",")[:2] for pair in text.split()]
    else:
        words = text.split()
        pairs = [words[k : k + 2] for k in range(0, len(words) - 1, 2)]
    out = []
    for pair in pairs:
        try:
            out.append((float(pair[0]), float(pair[1])))
        except (ValueError, IndexError):
            continue
    return out


def _polygon(e: ET.Element) -> list[Ring] | None:
    """Outer ring and holes; none if the outer ring has fewer than three points."""
    outer, holes = [], []
    for boundary in e:
        role = _name(boundary)
        text = next((x.text or "" for x in boundary.iter() if _name(x) in ("posList", "coordinates")), None)
        ring = _points(text) if text is not None else []
        if len(ring) >= 3 and role in ("exterior", "outerBoundaryIs"):
            outer = ring
        elif len(ring) >= 3 and role in ("interior", "innerBoundaryIs"):
            holes.append(ring)
    return [outer, *holes] if outer else None


def feature(e: ET.Element) -> tuple[dict[str, str], list[list[Ring]]] | None:
    """Properties and parts of a feature element, longitude or east first; none without a readable polygon."""
    parts = [p for x in e.iter() if _name(x) == "Polygon" and (p := _polygon(x))]
    if not parts:
        return None
    named = (x.get("srsName") or "" for x in e.iter())
    known = next((bool(re.search(LATITUDE_FIRST, n)) for n in named if re.search(f"{LATITUDE_FIRST}|{EAST_FIRST}", n)), None)
    x, y = parts[0][0][0]
    swap = known if known is not None else LATITUDES[0] <= x <= LATITUDES[1] and LONGITUDES[0] <= y <= LONGITUDES[1]
    if swap:
        parts = [[[(b, a) for a, b in ring] for ring in polygon] for polygon in parts]
    properties = {_name(c): c.text.strip() for c in e if not len(c) and c.text and c.text.strip()}
    return properties, parts


def pulled(stream: IO[bytes], layer: str) -> Iterator[ET.Element]:
    """The feature elements of a document one by one; what has been read is dropped."""
    path: list[ET.Element] = []
    for event, e in ET.iterparse(stream, events=("start", "end")):
        if event == "start":
            path.append(e)
            continue
        path.pop()
        if _name(e) == layer:
            yield e
        if not any(_name(p) == layer for p in path):
            e.clear()
            if path:
                path[-1].remove(e)


class GmlPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gml_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return GmlReader(self.options)


class GmlReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.url, self.layer = options["url"], options["layer"]
        self.size, self.lanes = int(options.get("size", 2000)), int(options.get("lanes", 1))
        self.pages = int(options["pages"]) if "pages" in options else None

    def partitions(self) -> list[Lane]:
        return [Lane(k) for k in range(self.lanes)]

    def opened(self, start: int) -> IO[bytes] | None:
        address = self.url.replace("{start}", str(start)).replace("{size}", str(self.size))
        for attempt in range(TRIES):
            try:
                return urllib.request.urlopen(address, timeout=60)
            except urllib.error.URLError as e:
                gone = isinstance(e, urllib.error.HTTPError) and e.code in (404, 410) or isinstance(e.reason, FileNotFoundError)
                if gone and start:
                    return None
                if gone or attempt == TRIES - 1:
                    raise
            time.sleep(0.2 * 2**attempt)
        return None

    def read(self, partition: Lane) -> Iterator[tuple]:
        number = partition.number
        while self.pages is None or number < self.pages:
            start, count = number * self.size, 0
            stream = self.opened(start)
            if stream is None:
                return
            with stream:
                for e in pulled(stream, self.layer):
                    got = feature(e)
                    if got is not None:
                        yield start, count, got[0], [[[{"x": x, "y": y} for x, y in ring] for ring in polygon] for polygon in got[1]]
                    count += 1
            if count < self.size:
                return
            number += self.lanes
