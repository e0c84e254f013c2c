"""Buildings of many places from services with mirrors: every mirror is asked at once, the first good answer counts, a failed box grows.

Places are rows, so they are spread over tasks like any others; a task has one place's answers in hand.  The address
of a mirror has ``{south}``, ``{west}``, ``{north}`` and ``{east}`` (``file:`` and ``http:`` alike); an answer is a JSON map extract.
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor, as_completed

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Half sides of the box, as shares of a place's own reach, one after another while all mirrors fail.
FACTORS = (0.15, 0.22)
ELEMENTS = "array<struct<id: bigint, type: string, tags: map<string,string>, geometry: array<struct<lon: double, lat: double>>>>"


def _asked(address: str, seconds: float) -> dict:
    with urllib.request.urlopen(address, timeout=seconds) as answer:
        found = json.load(answer)
    if not isinstance(found, dict) or "elements" not in found:
        raise ValueError(f"{address} gave no map extract")
    return found


def race(addresses: list[str], seconds: float = 30.0) -> tuple[str | None, dict | None, str | None]:
    """(address, answer, error) of the first mirror that answers well; the last error if none does."""
    pool = ThreadPoolExecutor(max_workers=max(1, len(addresses)))
    asked = {pool.submit(_asked, a, seconds): a for a in addresses}
    error = None
    try:
        for one in as_completed(asked):
            try:
                return asked[one], one.result(), None
            except (OSError, ValueError) as e:  # a refused or late connection, an answer that is none
                error = f"{type(e).__name__}: {e}"
        return None, None, error
    finally:
        pool.shutdown(wait=False, cancel_futures=True)


def raced_extracts(places: DataFrame, key: str, mirrors: list[str], reach: str = "reach", factors: tuple[float, ...] = FACTORS, seconds: float = 30.0) -> DataFrame:
    """(key, mirror, factor, error, elements) of every place (``lon``, ``lat`` and its reach in degrees).

    A place for which all mirrors fail with every box has a null mirror and the last error, so that another source can be
    asked for it: nothing is lost silently.
    """
    kind = dict(places.dtypes)[key]

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, lon, lat, far in zip(pdf[key], pdf["lon"], pdf["lat"], pdf[reach], strict=True):
                mirror = answer = error = factor = None
                for factor in factors:
                    half = far * factor
                    box = {"south": lat - half, "west": lon - half, "north": lat + half, "east": lon + half}
                    mirror, answer, error = race([m.format(**box) for m in mirrors], seconds)
                    if answer is not None:
                        break
                yield pd.DataFrame({key: [k], "mirror": [mirror], "factor": [factor], "error": [error], "answer": [json.dumps(answer["elements"]) if answer else None]})

    got = places.select(key, "lon", "lat", reach).mapInPandas(ask, f"{key} {kind}, mirror string, factor double, error string, answer string")
    return got.select(key, "mirror", "factor", "error", F.from_json("answer", ELEMENTS).alias("elements"))
