"""Place catalogues: names and the urls of their extracts; downloads with an injected transport."""

from __future__ import annotations

import os
import zipfile
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import zip_name

SCHEMA = "name string, urls array<string>, provider string"


def from_json_index(spark: SparkSession, path: str, provider: str) -> DataFrame:
    """Index with ``features[].properties.{name, urls.pbf}``."""
    schema = "features array<struct<properties: struct<name: string, urls: struct<pbf: string>>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features.properties").alias("p"))
    return rows.select(F.col("p.name").alias("name"), F.array(F.col("p.urls.pbf")).alias("urls"), F.lit(provider).alias("provider")).filter("name is not null")


def from_city_list(spark: SparkSession, path: str, provider: str, template: str, skip: int = 5, drop_last: int = 8) -> DataFrame:
    """Lines ``place:...`` without the first ``skip`` and the last ``drop_last``; ``{}`` in the template is the place."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\n$", ""), "\n")).alias("at", "line"), F.size(F.split(F.regexp_replace("value", r"\n$", ""), "\n")).alias("n"))
    kept = lines.filter((F.col("at") >= skip) & (F.col("at") < F.col("n") - drop_last))
    place = F.split(F.col("line"), ":")[0]
    return kept.select(place.alias("name"), F.array(F.regexp_replace(F.lit(template), r"\{\}", place)).alias("urls"), F.lit(provider).alias("provider")).filter("name <> ''")


def first_wins(*catalogues: DataFrame, key: str = "name") -> DataFrame:
    """Union in which a name comes from the first catalogue that has it."""
    union = catalogues[0]
    for more in catalogues[1:]:
        union = union.unionByName(more.join(union.select(key), key, "left_anti"))
    return union


class Places:
    """The union of catalogues and what is asked of it."""

    def __init__(self, *catalogues: DataFrame):
        newest = Window.partitionBy("name").orderBy(F.col("urls").desc())
        self.frame = first_wins(*[c.withColumn("__n", F.row_number().over(newest)).filter("__n = 1").drop("__n") for c in catalogues])

    def valid_names(self) -> DataFrame:
        return self.frame.select("name")

    def urls(self, place: str | Sequence[str]) -> list[str] | dict[str, list[str]]:
        """Urls of one place, or of each; unknown names are an error."""
        if not isinstance(place, str) and not isinstance(place, (list, tuple)):
            raise ValueError("place must be a string or a list")
        names = [place] if isinstance(place, str) else list(place)
        found = {r["name"]: list(r["urls"]) for r in self.frame.filter(F.col("name").isin(*names)).collect()}  # as many rows as names asked
        if missing := [n for n in names if n not in found]:
            raise ValueError(f"unknown places: {', '.join(missing)}")
        return found[place] if isinstance(place, str) else {n: found[n] for n in names}

    def download(self, path: str, place: str | Sequence[str], get: Callable[[str], bytes], rename: str | Sequence[str] | None = None, compress: bool = False, file_ext: str = ".osm.pbf") -> list[str]:
        """Save the places' files and return their paths.

        ``get`` fetches one url or raises; the next url of a place is its fallback.  A place
        whose urls all fail leaves no file and makes the call fail after the others are saved.
        """
        many = not isinstance(place, str)
        if many and rename is not None and (isinstance(rename, str) or len(rename) != len(place)):
            raise ValueError("rename must be a list as long as place")
        if not many and rename is not None and not isinstance(rename, str):
            raise ValueError("rename must be a string")
        names = list(place) if many else [place]
        titles = names if rename is None else list(rename) if many else [rename]
        urls = self.urls(names)

        def one(job: tuple[str, str]) -> str:
            name, title = job
            errors = []
            for url in urls[name]:
                try:
                    content = get(url)
                except Exception as e:  # noqa: BLE001  the transport is the caller's
                    errors.append(f"{url}: {e}")
                    continue
                target = os.path.join(path, title + file_ext)
                if compress:
                    with zipfile.ZipFile(zip_name(target), "w", zipfile.ZIP_DEFLATED) as z:
                        z.writestr(title + file_ext, content)
                    return zip_name(target)
                with open(target, "wb") as f:
                    f.write(content)
                return target
            raise OSError(f"{name} is missing ({'; '.join(errors)})")

        with ThreadPoolExecutor(8) as pool:
            jobs = [pool.submit(one, j) for j in zip(names, titles, strict=True)]
        failed = [str(j.exception()) for j in jobs if j.exception()]
        if failed:
            raise OSError("; ".join(failed))
        return [j.result() for j in jobs]
