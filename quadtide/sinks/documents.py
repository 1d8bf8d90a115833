"""What the services store, as rows that any writer takes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys, layout

#: Records that one request to the warehouse may carry.
RECORDS_PER_REQUEST = 10_000_000 // 256


def write_summaries(summaries: DataFrame, path: str, start: int, end: int) -> None:
    """Summaries of a collection window as JSON, a bounded number of records a file."""
    stamped = summaries.withColumns({"startTime": F.lit(start), "endTime": F.lit(end)})
    stamped.write.option("maxRecordsPerFile", RECORDS_PER_REQUEST).mode("overwrite").json(path)


def catalog_documents(images: DataFrame, server: str) -> DataFrame:
    """(name, maxRLevel, metadata map) to catalogue documents: stamp, links, and the metadata but for camera coefficients."""
    link = F.concat(F.lit(server + "/"), F.replace("name", F.lit(":"), F.lit("/")))
    kept = F.map_filter("metadata", lambda k, v: k != "RPC00B")
    return images.select(
        "name", keys.iso_stamp(F.try_element_at("metadata", F.lit("IDATIM"))).alias("date"), link.alias("imageLink"),
        F.concat(link, F.lit("/"), F.col("maxRLevel").cast("string"), F.lit("/0/0/0.png")).alias("thumbnailLink"), kept.alias("metadata"),
    )


def telemetry_batches(lines: DataFrame, stream: str, order: str, line: str) -> DataFrame:
    """Encoded lines with the number of their batch of at most 500, counted within each stream."""
    at = F.row_number().over(Window.partitionBy(stream).orderBy(order)) - 1
    cut = lines.select(stream, order, keys.telemetry_line(F.col(line)).alias("data"))  # what is shuffled is cut already
    return cut.select(stream, order, F.floor(at / keys.LINES_PER_BATCH).alias("batch"), "data")


def placemarks(boxes: DataFrame, group: str, name: str) -> DataFrame:
    """Map placemarks of boxes (west, south, east, north) by group: the smallest lowest, ten metres apart from 100 up."""
    area = (F.col("east") - F.col("west")) * (F.col("north") - F.col("south"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.round(area, 9), name)) - 1
    rows = boxes.withColumn("altitude", F.lit(100) + 10 * rank)
    corner = lambda x, y: F.format_string("%.6f,%.6f,%d", F.col(x), F.col(y), F.col("altitude"))
    ring = F.concat_ws(" ", *(corner(x, y) for x, y in (("west", "south"), ("east", "south"), ("east", "north"), ("west", "north"), ("west", "south"))))
    return rows.select(group, name, "altitude", ring.alias("coordinates"))


def _escaped(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def placemark_xml(name: Column, coordinates: Column) -> Column:
    parts = ("<Placemark><name>", _escaped(name.cast("string")), "</name><Polygon><altitudeMode>relativeToGround</altitudeMode><outerBoundaryIs><LinearRing><coordinates>", coordinates, "</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>")
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def index_entries(tiles: DataFrame) -> DataFrame:
    """16 bytes a tile, big-endian offset and size, for (img, offset, size); a writer joins them in order of offset."""
    number = lambda c: F.unhex(F.lpad(F.hex(F.col(c).cast("long")), 16, "0"))
    return tiles.withColumn("entry", F.concat(number("offset"), number("size")))


def index_xml(width: Column, height: Column, bands: Column, tile: int = 512) -> Column:
    """Description of a tile index file for map readers."""
    return F.format_string(
        f'<MRF_META><Raster><Size x="%d" y="%d" c="%d" /><PageSize x="{tile}" y="{tile}" c="1" /><Compression>PNG</Compression></Raster><Rsets model="uniform" scale="2" /></MRF_META>', width, height, bands
    )


def tile_capabilities(image: Column, stamp: Column, box: tuple[Column, Column, Column, Column], width: Column, height: Column, levels: Column, tile: int = 512) -> Column:
    """What a tile service offers of an image (WMTS 1.0.0): its box and the matrix of each level, axes as in ``matrix_sizes(swapped=True)``."""
    number = lambda c: c.cast("string")
    one = lambda m: F.concat(
        F.lit("<TileMatrix><ows:Identifier>"), number(m["level"]), F.lit("</ows:Identifier><ScaleDenominator>"), number(m["scale"]),
        F.lit(f"</ScaleDenominator><TileWidth>{tile}</TileWidth><TileHeight>{tile}</TileHeight><MatrixWidth>"), number(m["cols"]),
        F.lit("</MatrixWidth><MatrixHeight>"), number(m["rows"]), F.lit("</MatrixHeight></TileMatrix>"),
    )
    matrices = F.array_join(F.transform(layout.matrix_sizes(width, height, levels, tile, swapped=True), one), "")
    west, south, east, north = box
    parts = (
        '<Capabilities xmlns="http://www.opengis.net/wmts/1.0" xmlns:ows="http://www.opengis.net/ows/1.1" version="1.0.0"><Contents><Layer>',
        '<ows:WGS84BoundingBox crs="EPSG:4326"><ows:LowerCorner>', F.concat_ws(" ", number(west), number(south)), "</ows:LowerCorner><ows:UpperCorner>",
        F.concat_ws(" ", number(east), number(north)), "</ows:UpperCorner></ows:WGS84BoundingBox><ows:Identifier>", _escaped(image),
        '</ows:Identifier><Style isDefault="true"><ows:Identifier>tile</ows:Identifier></Style><Format>image/png</Format><TileMatrixSetLink><TileMatrixSet>',
        _escaped(stamp), "</TileMatrixSet></TileMatrixSetLink></Layer><TileMatrixSet><ows:Identifier>", _escaped(stamp),
        "</ows:Identifier><ows:SupportedCRS>CRS:1</ows:SupportedCRS>", matrices, "</TileMatrixSet></Contents></Capabilities>",
    )
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def map_capabilities(layers: DataFrame, server: str) -> DataFrame:
    """What a map service offers (WMS 1.3.0), one row a layer of (name, west, south, east, north): (name, layer).

    A document is :func:`map_document` around the layers that a caller selects; a catalogue of any size is never gathered here.
    """
    number = lambda c: F.col(c).cast("string")
    sides = (("west", "westBoundLongitude"), ("east", "eastBoundLongitude"), ("south", "southBoundLatitude"), ("north", "northBoundLatitude"))
    box = F.concat(*(F.concat(F.lit(f"<{tag}>"), number(c), F.lit(f"</{tag}>")) for c, tag in sides))
    link = F.concat(F.lit(server.rstrip("/") + "/"), F.replace("name", F.lit(":"), F.lit("/")))
    parts = (
        '<Layer queryable="0"><Name>', _escaped(F.col("name")), "</Name><Title>", _escaped(F.col("name")), "</Title><CRS>CRS:84</CRS><EX_GeographicBoundingBox>",
        box, '</EX_GeographicBoundingBox><DataURL><Format>image/png</Format><OnlineResource xmlns:xlink="http://www.w3.org/1999/xlink" xlink:type="simple" xlink:href="',
        _escaped(link), '"/></DataURL></Layer>',
    )
    return layers.select("name", F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)).alias("layer"))


def map_document(layers: list[str], title: str) -> str:
    from xml.sax.saxutils import escape

    head = f'<WMS_Capabilities xmlns="http://www.opengis.net/wms" version="1.3.0"><Service><Name>WMS</Name><Title>{escape(title)}</Title></Service>'
    offer = "<Capability><Request><GetCapabilities><Format>text/xml</Format></GetCapabilities><GetMap><Format>image/png</Format></GetMap></Request>"
    return f"{head}{offer}<Layer><Title>{escape(title)}</Title>{''.join(layers)}</Layer></Capability></WMS_Capabilities>"
