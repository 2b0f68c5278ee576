"""Schemas of nodes, ways, relations and the union of the three."""

from __future__ import annotations

from pyspark.sql import types as T

NODE, WAY, RELATION = 0, 1, 2
NO_GEOMETRY, POINT, LINE, AREA = 0, 1, 2, 3
SRID = 4326

TAGS = T.MapType(T.StringType(), T.StringType())
META = [T.StructField("version", T.IntegerType()), T.StructField("timestamp", T.TimestampType()), T.StructField("changeset", T.LongType())]
MEMBER = T.StructType([T.StructField("ref", T.LongType()), T.StructField("type", T.IntegerType()), T.StructField("role", T.StringType())])
XY = T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())])
#: Polygons, each a list of rings or one line, each a list of points.
PARTS = T.ArrayType(T.ArrayType(T.ArrayType(XY)))

NODES = T.StructType([T.StructField("id", T.LongType()), T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType()), T.StructField("tags", TAGS), *META])
WAYS = T.StructType([T.StructField("id", T.LongType()), T.StructField("refs", T.ArrayType(T.LongType())), T.StructField("tags", TAGS), *META])
RELATIONS = T.StructType([T.StructField("id", T.LongType()), T.StructField("members", T.ArrayType(MEMBER)), T.StructField("tags", TAGS), *META])
