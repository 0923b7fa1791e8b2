"""GeoJSON in and out: features with their outer rings, and one FeatureCollection a design layer."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandplan.functions.exprs import unproject
from strandplan.plans.session import written


@dataclass(frozen=True)
class Projection:
    """Flat metres around an anchor."""

    lon0: float
    lat0: float
    kx_m_per_deg: float
    ky_m_per_deg: float

    def sidecar(self) -> str:
        """The projection as JSON, keys sorted."""
        return json.dumps({"projection": "equirectangular", "crs": "EPSG:4326", **asdict(self)}, sort_keys=True)


def scan_objects(chunks: Iterable[bytes], array: bytes = b'"features"') -> Iterator[bytes]:
    """The objects of an array member of one large JSON object, from chunks of its bytes.

    Braces are counted outside strings only; escapes are respected. The scan itself holds no more than one object
    and one chunk.
    """
    depth, quoted, escaped, inside = 0, False, False, False
    held, seen = bytearray(), bytearray()
    for chunk in chunks:
        for byte in chunk:
            if not inside:
                seen.append(byte)
                if byte == 0x5B and bytes(seen[:-1]).rstrip().rstrip(b":").rstrip().endswith(array):
                    inside = True
                del seen[:-64]
                continue
            if depth:
                held.append(byte)
            if quoted:
                if escaped:
                    escaped = False
                elif byte == 0x5C:
                    escaped = True
                elif byte == 0x22:
                    quoted = False
            elif byte == 0x22:
                quoted = True
            elif byte == 0x7B:
                if depth == 0:
                    held[:] = b"{"
                depth += 1
            elif byte == 0x7D:
                depth -= 1
                if depth == 0:
                    yield bytes(held)
                    held.clear()
            elif byte == 0x5D and depth == 0:
                return


#: A piece of JSON text that starts outside strings, up to its next brace that opens outside strings.
_LEAD = r'[^"{]*+(?:"[^"\\]*+(?:\\.[^"\\]*+)*+"[^"{]*+)*+'
#: The rest of a string that a piece starts in.
_INSIDE = r'(?s)^[^"\\]*+(?:\\.[^"\\]*+)*+"'


def _braces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("{"), F.lit("")))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """The text of files cut after each closing brace, with what a piece does to the depth of braces.

    ``path, split, at`` is the order; ``quotes`` the quotation marks that count, ``quoted`` how many of them the
    split holds before the piece. ``opens0, step0`` are the braces opened and the change of depth if the piece
    starts outside a string, ``opens1, step1`` if inside one.
    """
    raw = spark.read.text(path, lineSep="}").select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("text")
    )
    plain = F.regexp_replace("text", r"(?s)\\.", "")
    outside = F.regexp_replace("plain", '"[^"]*("|$)', "")
    after = F.regexp_replace(F.regexp_replace("plain", '^[^"]*("|$)', ""), '"[^"]*("|$)', "")
    raw = raw.withColumn("plain", plain).withColumns({"quotes": F.length("plain") - F.length(F.replace("plain", F.lit('"'), F.lit(""))), "opens0": _braces(outside), "opens1": _braces(after)})
    raw = raw.withColumns({"step0": F.col("opens0") - F.when(F.col("quotes") % 2 == 0, 1).otherwise(0), "step1": F.col("opens1") - F.when(F.col("quotes") % 2 == 1, 1).otherwise(0)})
    before = Window.partitionBy("path", "split").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return raw.drop("plain").withColumn("quoted", F.coalesce(F.sum("quotes").over(before), F.lit(0)))


def _objects(spark: SparkSession, path: str) -> DataFrame:
    """``(path, number, feature)``: the texts of the objects in the top-level array ``features``, numbered by file."""
    within = Window.partitionBy("path", "split").orderBy("at")
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    base = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    pieces = written(_pieces(spark, path), "pieces")

    # A row a split: whether it starts inside a string, then how deep.
    odd = F.col("quoted") % 2 == 1
    splits = pieces.groupBy("path", "split").agg(
        F.sum("quotes").alias("quotes"), F.sum(F.when(odd, F.col("step1")).otherwise(F.col("step0"))).alias("out"), F.sum(F.when(odd, F.col("step0")).otherwise(F.col("step1"))).alias("in")
    ).withColumn("started", base("quotes") % 2)
    splits = splits.withColumn("steps", F.when(F.col("started") == 1, F.col("in")).otherwise(F.col("out"))).withColumn("deep", base("steps"))
    placed = pieces.join(splits.select("path", "split", "started", "deep"), ["path", "split"])
    inside = (F.col("started") + F.col("quoted")) % 2 == 1
    placed = placed.withColumns({"inside": inside, "opens": F.when(inside, F.col("opens1")).otherwise(F.col("opens0")), "step": F.when(inside, F.col("step1")).otherwise(F.col("step0"))})
    placed = placed.withColumn("depth", F.col("deep") + F.coalesce(F.sum("step").over(before), F.lit(0)))

    # Where an object of depth 2 starts, what stands before it says whether it is in the array, in another, or follows one.
    starts = (F.col("depth") < 2) & (F.col("depth") + F.col("opens") >= 2)
    clear = F.when(F.col("inside"), F.regexp_replace("text", _INSIDE, "")).otherwise(F.col("text"))
    body = F.when(F.col("depth") == 1, F.regexp_replace("clear", rf"(?s)^{_LEAD}(?=\{{)", "")).otherwise(F.regexp_replace("clear", rf"(?s)^{_LEAD}\{{{_LEAD}(?=\{{)", ""))
    lead = F.expr("substring(clear, 1, length(clear) - length(body))")
    kind = F.when(lead.rlike(r'"features"\s*:\s*\[\s*$'), 1).when(~lead.rlike(r"^\s*,\s*$"), 0)
    parts = placed.where(F.col("depth") + F.col("opens") >= 2).withColumn("starts", starts.cast("int"))
    parts = parts.withColumn("clear", F.when(F.col("starts") == 1, clear)).withColumn("body", F.when(F.col("starts") == 1, body))
    parts = parts.select("path", "split", "at", "starts", F.when(F.col("starts") == 1, kind).alias("kind"), F.coalesce("body", "text").alias("text"))
    parts = parts.withColumns({"nth": F.sum("starts").over(within), "kind": F.last("kind", True).over(within)})
    parts = written(parts, "parts")
    splits = parts.groupBy("path", "split").agg(F.sum("starts").alias("starts"), F.max_by("kind", "at").alias("last"))
    splits = splits.select("path", "split", base("starts").alias("first"), F.last("last", True).over(earlier).alias("going"))
    parts = parts.join(splits, ["path", "split"]).where(F.coalesce("kind", "going") == 1).withColumn("number", F.col("first") + F.col("nth"))
    # A split's parts come in order within it, and splits in order within an object.
    texts = F.array_sort(F.collect_list(F.struct("split", "at", "text")))
    return parts.groupBy("path", "number").agg(texts.alias("p")).select("path", "number", F.array_join(F.transform("p", lambda p: F.concat(p["text"], F.lit("}"))), "").alias("feature"))


FEATURE = "id string, properties string, geometry struct<type:string,coordinates:string>"


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """``(id, properties, type, coordinates)`` a row a feature, in the order of the files; nested values stay JSON text.

    Files of any size are read in splits, side by side: a split's pieces are cut at closing braces, and running sums
    of quotation marks and braces, split by split, say which of them are one feature. No more than a split or a
    feature meets in a task. A file that breaks off inside a feature gives what there is of it.
    """
    raw = _objects(spark, path).orderBy("path", "number")
    f = raw.select(F.from_json("feature", FEATURE).alias("f"))
    return f.select("f.id", "f.properties", F.col("f.geometry.type").alias("type"), F.col("f.geometry.coordinates").alias("coordinates"))


def outer_rings(kind: Column, coordinates: Column) -> Column:
    """Outer rings of polygons and multipolygons as arrays of points; holes and other kinds give none."""
    polygon = F.from_json(coordinates, "array<array<array<double>>>")
    multi = F.from_json(coordinates, "array<array<array<array<double>>>>")
    rings = F.when(kind == "Polygon", F.array(F.get(polygon, F.lit(0)))).when(kind == "MultiPolygon", F.transform(multi, lambda p: F.get(p, F.lit(0))))
    points = F.transform(rings, lambda ring: F.transform(ring, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))))
    return F.coalesce(F.filter(points, lambda r: r.isNotNull()), F.array().cast("array<array<struct<x:double,y:double>>>"))


def _feature(geometry: Column, **properties: Column) -> Column:
    named = F.struct(*[F.col(c).alias(k) if isinstance(c, str) else c.alias(k) for k, c in sorted(properties.items())])
    return F.to_json(F.struct(geometry.alias("geometry"), named.alias("properties"), F.lit("Feature").alias("type")))


def _point(x, y) -> Column:
    return F.struct(F.array(x, y).alias("coordinates"), F.lit("Point").alias("type"))


def _line(a, b) -> Column:
    return F.struct(F.array(F.array(*a), F.array(*b)).alias("coordinates"), F.lit("LineString").alias("type"))


def layers(nodes: DataFrame, edges: DataFrame, head_ends: DataFrame, areas: DataFrame, terminals: DataFrame, premises: DataFrame, edge_usage: DataFrame, projection: Projection) -> dict[str, DataFrame]:
    """``(ord, feature)`` by layer; a layer's text is its features between the collection's brackets."""
    p = (projection.lon0, projection.lat0, projection.kx_m_per_deg, projection.ky_m_per_deg)
    at = nodes.select("node_id", *(c.alias(n) for c, n in zip(unproject("x", "y", *p), ("lon", "lat"), strict=True)))
    lon, lat = unproject("x", "y", *p)
    prem = premises.withColumns({"plon": lon, "plat": lat})
    point = _point(F.col("lon"), F.col("lat"))
    out = {}
    out["central_office"] = head_ends.join(at, "node_id").select(F.col("he_idx").alias("ord"), _feature(point, node=F.col("node_id"), head_end=F.col("he_idx"), kind=F.when(F.col("he_idx") == 0, "primary").otherwise("remote")).alias("feature"))
    out["cabinets"] = areas.join(at, F.col("fdh_node") == F.col("node_id")).select(
        F.col("area_id").alias("ord"), _feature(point, serving_area=F.col("area_id"), node=F.col("fdh_node"), **{c: F.col(c) for c in ("cabinet_units", "splitters", "units", "take_units", "feeder_m")}).alias("feature")
    )
    out["terminals"] = terminals.where("used > 0").join(at, "node_id").select(
        F.col("term_id").alias("ord"), _feature(point, terminal=F.col("term_id"), node=F.col("node_id"), serving_area=F.col("area_id"), ports=F.col("ports"), ports_used=F.col("used"), path_m=F.col("path_m")).alias("feature")
    )
    out["premises"] = prem.select(
        F.col("prem_id").alias("ord"),
        _feature(_point(F.col("plon"), F.col("plat")), premises=F.col("prem_id"), units=F.col("units"), serving_area=F.col("area_id"), terminal=F.col("term_id"), drop_m=F.col("drop_m"), status=F.when(F.col("term_id").isNull(), "unserved").otherwise("served")).alias("feature"),
    )
    ends = prem.join(terminals.select("term_id", F.col("node_id").alias("tnode")), "term_id").join(at, F.col("tnode") == at["node_id"])
    out["drops"] = ends.select(F.col("prem_id").alias("ord"), _feature(_line((F.col("plon"), F.col("plat")), (F.col("lon"), F.col("lat"))), premises=F.col("prem_id"), terminal=F.col("term_id"), drop_m=F.col("drop_m")).alias("feature"))
    a = at.select(F.col("node_id").alias("src"), F.col("lon").alias("alon"), F.col("lat").alias("alat"))
    b = at.select(F.col("node_id").alias("dst"), F.col("lon").alias("blon"), F.col("lat").alias("blat"))
    lines = edge_usage.select("edge_id", "trench", "dist_fibers", "feeder_fibers").join(edges.select("edge_id", "src", "dst", "surface"), "edge_id").join(a, "src").join(b, "dst")
    line = _line((F.col("alon"), F.col("alat")), (F.col("blon"), F.col("blat")))
    for name, column, role in (("fiber_feeder", "feeder_fibers", "feeder"), ("fiber_distribution", "dist_fibers", "distribution")):
        out[name] = lines.where(F.col(column) > 0).select(F.col("edge_id").alias("ord"), _feature(line, edge=F.col("edge_id"), fibers=F.col(column), role=F.lit(role)).alias("feature"))
    shared = (F.col("dist_fibers") > 0) & (F.col("feeder_fibers") > 0)
    out["trench"] = lines.where("trench").select(F.col("edge_id").alias("ord"), _feature(line, edge=F.col("edge_id"), surface=F.when(F.col("surface") == 1, "asphalt").otherwise("soft"), shared=shared).alias("feature"))
    # Degrees keep the order of metres along each axis, so the hull of the one is the hull of the other.
    hulls = area_hulls(premises.where("area_id is not null"), "area_id", "x", "y")
    corner = F.transform("ring", lambda q: F.array(*unproject(F.get(q, F.lit(0)), F.get(q, F.lit(1)), *p)))
    ring = F.struct(F.array(corner).alias("coordinates"), F.lit("Polygon").alias("type"))
    out["serving_areas"] = hulls.select(F.col("area_id").alias("ord"), _feature(ring, serving_area=F.col("area_id"), premises=F.col("n")).alias("feature"))
    return out


#: Columns, in the unit of the points, whose hull is found first.
STRIP = 1024


def area_hulls(points: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """``(key, n, ring)``: closed convex hulls of points in whole metres; groups of fewer than three distinct hull points give none.

    What is not an extreme of its column is on no hull, and what is not on the hull of its strip of ``STRIP``
    columns is not on the whole one: a task meets two points a column of a strip, then the corners of the strips.
    """
    from strandplan.kernels.rings import hull

    n = points.groupBy(key).agg(F.count("*").alias("n"))
    column = points.select(key, F.col(x).alias("x"), F.col(y).alias("y")).groupBy(key, "x").agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    ends = column.select(key, "x", F.floor(F.col("x") / STRIP).alias("strip"), F.explode(F.array_distinct(F.array("lo", "hi"))).alias("y"))

    def corners(pdf):
        import pandas as pd

        found = list(zip(pdf["x"].tolist(), pdf["y"].tolist(), strict=True))
        kept = hull(found) or found
        return pd.DataFrame({key: [pdf[key].iloc[0]] * len(kept), "x": [float(a) for a, _ in kept], "y": [float(b) for _, b in kept]})

    def run(pdf):
        import pandas as pd

        ring = hull(list(zip(pdf["x"].tolist(), pdf["y"].tolist(), strict=True)))
        return pd.DataFrame({key: [pdf[key].iloc[0]], "ring": [[list(p) for p in [*ring, ring[0]]]]}) if ring else pd.DataFrame({key: [], "ring": []})

    outer = ends.groupBy(key, "strip").applyInPandas(corners, f"{key} long, x double, y double")
    rings = outer.groupBy(key).applyInPandas(run, f"{key} long, ring array<array<double>>")
    return rings.join(n, key)


def _collection(batches):
    """One partition's features as the lines of a whole FeatureCollection."""
    first = True
    for batch in batches:
        lines = []
        for feature in batch.column(0).to_pylist():
            lines.append(('{"features":[' if first else ",") + feature)
            first = False
        yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
    if not first:
        yield pa.RecordBatch.from_arrays([pa.array(['],"type":"FeatureCollection"}'])], names=["value"])
    elif TaskContext.get().partitionId() == 0:
        yield pa.RecordBatch.from_arrays([pa.array(['{"features":[],"type":"FeatureCollection"}'])], names=["value"])


def write_layer(layer: DataFrame, path: str) -> None:
    """A layer as text, its features in order over the part files; each part is a whole FeatureCollection."""
    layer.orderBy("ord").select("feature").mapInArrow(_collection, "value string").write.text(path)
