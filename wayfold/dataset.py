"""The dataset: nodes, ways and relations as lazy DataFrames, and the execution of a query over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.wkt import to_ewkb, to_wkb, to_wkt
from .operators.geometry import gather, node_geometry, point_lookup, way_geometry
from .operators.geotype import relation_geotype, way_geotype
from .operators.relations import member_rows, relation_geometry, without_members
from .operators.tags import tag_columns, wide_tags
from .operators.topology import segment_refs
from .plans.predicate import compile_predicate, of_ids, of_relation_type, pushable
from .plans.query import OsmQuery
from .schema import AREA, LINE, NODE, POINT, RELATION, SRID, WAY
from .sources.pbf import blob_counts, features, read_pbf
from .sources.tables import read_tables, write_tables

META = ["changeset", "timestamp", "version"]
#: Forms of the geometry column.
FORMS = ("wkb", "wkt", "ewkb", "ewkt", "parts")
CODES = {"nodes": NODE, "ways": WAY, "relations": RELATION}


class OsmDataset:
    """Holds plans, never data; every method returns a DataFrame that runs when it is used."""

    def __init__(self, nodes: DataFrame, ways: DataFrame, relations: DataFrame, path: str | None = None):
        self.nodes, self.ways, self.relations, self.path = nodes, ways, relations, path

    @classmethod
    def from_pbf(cls, spark: SparkSession, path: str) -> OsmDataset:
        return cls(*(read_pbf(spark, path, kind) for kind in ("nodes", "ways", "relations")), path=path)

    @classmethod
    def from_tables(cls, spark: SparkSession, path: str) -> OsmDataset:
        tables = read_tables(spark, path)
        return cls(tables["nodes"], tables["ways"], tables["relations"])

    def to_tables(self, path: str, **options) -> None:
        write_tables({"nodes": self.nodes, "ways": self.ways, "relations": self.relations}, path, **options)

    @property
    def features(self) -> dict[str, list[str]]:
        if self.path is None:
            raise ValueError("features belong to extracts read from files")
        return features(self.path)

    def geometry(self) -> DataFrame:
        """Coordinates of all nodes by id."""
        return point_lookup(self.nodes)

    def coords(self, ids: DataFrame) -> DataFrame:
        """Coordinates of the ids in the first column of ``ids``; null where the node is unknown."""
        wanted = ids.select(F.col(ids.columns[0]).alias("id"))
        return wanted.join(self.nodes.select("id", "lon", "lat"), "id", "left")

    def strings(self) -> DataFrame:
        """Distinct tag keys, values and member roles."""
        texts = [F.explode(f(F.col("tags"))) for f in (F.map_keys, F.map_values)]
        parts = [frame.select(t.alias("string")) for frame in (self.nodes, self.ways, self.relations) for t in texts]
        parts.append(self.relations.select(F.explode("members.role").alias("string")))
        union = parts[0]
        for p in parts[1:]:
            union = union.union(p)
        return union.filter("string is not null").distinct()

    def info(self) -> DataFrame:
        """``kind, elements, tagged`` and, for extracts, ``blocks`` that hold the kind."""
        counts = None
        for kind, frame in (("nodes", self.nodes), ("ways", self.ways), ("relations", self.relations)):
            one = frame.agg(F.count("*").alias("elements"), F.count_if(F.coalesce(F.size("tags"), F.lit(0)) > 0).alias("tagged")).select(F.lit(kind).alias("kind"), "elements", "tagged")
            counts = one if counts is None else counts.unionByName(one)
        if self.path is None:
            return counts
        return counts.join(blob_counts(self.nodes.sparkSession, self.path), "kind", "left").fillna(0, ["blocks"])

    # ------------------------------------------------------------------ selection

    def select(self, q: OsmQuery) -> dict[str, DataFrame]:
        """The element tables that the query lets through, with ``osmid`` and ``geom``."""
        out: dict[str, DataFrame] = {}
        test = compile_predicate(q)

        def rename(frame: DataFrame) -> DataFrame:
            implied = pushable(q, frame.columns)
            return (frame if implied is None else frame.filter(implied)).filter(test).withColumnRenamed("id", "osmid")

        if q.nodes:
            out["nodes"] = rename(of_ids(self.nodes, q.node_ids)).withColumn("geom", F.lit(POINT))
        if q.ways:
            ways = rename(of_ids(self.ways, q.way_ids))
            if q.geometry:
                ways = ways.filter(F.size("refs") >= 2)
            out["ways"] = ways.withColumn("geom", way_geotype(F.col("refs"), F.col("tags")))
        if q.relations:
            found = rename(of_relation_type(self.relations, q.relation_type))
            out["relations"] = found.withColumn("geom", relation_geotype(F.col("members"), F.col("tags")))
        if "ways" in out and "relations" in out and (q.geometry or q.topology):
            out["ways"] = without_members(out["ways"], out["relations"])
        return out

    def elements(self, q: OsmQuery) -> DataFrame:
        """Union of the selected elements: ``osmid, osmtype, tags, version, timestamp, changeset, geom``."""
        found = [frame.select("osmid", F.lit(CODES[kind]).alias("osmtype"), "tags", *META, "geom") for kind, frame in self.select(q).items()]
        if found:
            return reduce(DataFrame.unionByName, found)
        empty = self.ways.limit(0).select(F.col("id").alias("osmid"), F.lit(WAY).alias("osmtype"), "tags", *META)
        return empty.withColumn("geom", F.lit(0))

    def query(self, q: OsmQuery, form: str = "wkb", wide: bool = False, complex_rings: str = "drop_inner", ordered: bool = False) -> DataFrame:
        """The result of a query: one row for each element, segment (topology) or member (relations without geometry).

        The key is (osmtype, osmid); no order is implied unless ``ordered``.  A list of tags makes one column for
        each key (``tag_`` before it where the result has a column of that name), all tags stay one map column
        unless ``wide``.  ``form`` is the geometry's: WKB, WKT, the same with the reference system's
        number (EWKB, EWKT; coordinates are WGS 84, 4326), or ``parts`` with ``kind``.
        """
        if form not in FORMS:
            raise ValueError(f"form must be one of {', '.join(FORMS)}")
        chosen = self.select(q)
        carry = [*(META if q.metadata else []), *(["tags"] if q.tags is not False else [])]
        if q.topology:
            found = [self._segments(chosen["ways"], carry)]
        elif q.geometry:
            found = [self._geometry(kind, frame, carry, complex_rings).withColumn("osmtype", F.lit(CODES[kind])) for kind, frame in chosen.items()]
        else:
            found = [self._plain(kind, frame, carry) for kind, frame in chosen.items()]
        if not found:
            found = [self.elements(q).select("osmtype", "osmid", *carry)]
        base = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), found)
        base = base.select("osmtype", "osmid", *carry, *[c for c in base.columns if c not in {"osmtype", "osmid", *carry}])
        if q.geometry:
            base = _formed(base, form)
        if q.tags is True:
            base = wide_tags(base, [c for c in base.columns if c != "tags"]) if wide else base
        elif q.tags is not False:
            base = tag_columns(base, q.tags)
        return base.orderBy("osmid", "osmtype") if ordered else base

    def _plain(self, kind: str, frame: DataFrame, carry: list[str]) -> DataFrame:
        """Elements without geometry; relations as one row for each member."""
        own = frame.select("osmid", F.lit(CODES[kind]).alias("osmtype"), *carry, *(["members", "geom"] if kind == "relations" else []))
        if kind != "relations":
            return own
        return member_rows(own, carry=["osmtype", *carry, "geom"]).select("osmid", "osmtype", *carry, "pos", "memid", "type", "role", "geom")

    def _geometry(self, kind: str, frame: DataFrame, carry: list[str], complex_rings: str) -> DataFrame:
        if kind == "nodes":
            return node_geometry(frame, carry)
        if kind == "ways":
            return way_geometry(frame, self.nodes, carry)
        drawn = relation_geometry(frame.filter(F.col("geom").isin(LINE, AREA)), self.ways, self.nodes, complex_rings)
        return frame.select("osmid", *carry).join(drawn, "osmid", "left")

    def _segments(self, ways: DataFrame, carry: list[str]) -> DataFrame:
        lines = gather(segment_refs(ways, carry=carry), self.nodes, ["osmid", "seg"], carry=["source", "target", *carry])
        good = F.size("points") >= 2
        return lines.select("osmid", F.lit(WAY).alias("osmtype"), *carry, "seg", "source", "target", F.when(good, "LINESTRING").alias("kind"), F.when(good, F.array(F.array("points"))).alias("parts"), "missing_refs")


def _formed(frame: DataFrame, form: str) -> DataFrame:
    if form == "parts":
        return frame
    if form.endswith("wkt"):
        made = to_wkt() if form == "wkt" else F.concat(F.lit(f"SRID={SRID};"), to_wkt())
    else:
        made = (to_wkb if form == "wkb" else to_ewkb)(F.col("kind"), F.col("parts"))
    return frame.withColumn("geometry", made).drop("kind", "parts")
