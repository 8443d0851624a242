"""Table functions for SQL: ``LATERAL parse_locations(locations)``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


class ParseLocations:
    """One row per mention with six fields or more, numbered from 0; coordinates both or neither."""

    def eval(self, locations: str) -> Iterator[tuple]:
        position = 0
        for entry in (locations or "").split(";"):
            part = entry.split("#")
            if len(part) < 6:
                continue
            lat, lon = number(part[4]), number(part[5])
            both = lat is not None and lon is not None
            yield position, part[1], part[2].upper(), part[3].upper(), lat if both else None, lon if both else None
            position += 1


def number(field: str) -> float | None:
    try:
        return float(field)
    except ValueError:
        return None


def register(spark: SparkSession) -> None:
    """Make the table functions known to the session's SQL."""
    made = udtf(ParseLocations, returnType="position int, fullname string, country string, adm1 string, lat double, lon double")
    spark.udtf.register("parse_locations", made)
