"""Queries on geometry and map layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regioflux.functions.text import number_text, thousands
from regioflux.operators import flows as fl
from regioflux.operators import geometry as geo
from regioflux.operators import layers
from regioflux.operators.layout import curve_places, layout_view, write_layout
from regioflux.operators.noding import noded
from regioflux.operators.rings import dissolve_rings
from regioflux.plans import hazard_risk as plan
from regioflux.session import new_path, with_folder
from regioflux.sources.layer_files import BOX, read_layer_files, shape_vertices, write_layer_files
from regioflux.workload import fixtures as fx
from regioflux.workload.registry import query
from regioflux.workload.risk_queries import ordinal_sql, percentile_sql, rating_sql


@query(
    """SELECT geo_id, CAST(1 AS DOUBLE) AS area, min(x) + 0.5 AS lon, min(y) + 0.5 AS lat
    FROM parcels GROUP BY 1""".replace("+ 0.5", "+ CAST(0.5 AS DOUBLE)"),
    ("parcels",),
)
def geo_centroid(spark: SparkSession, sf: str) -> DataFrame:
    """Shoelace centroids. The coordinates are whole, so rounding only removes the last bits."""
    found = geo.centroids(fx.parcel_vertices(spark, sf))
    return found.select("geo_id", "area", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query(
    """, corners AS (
        SELECT geo_id, seq, cos(radians(y / 2)) * cos(radians(x * 4 - 200)) AS px, cos(radians(y / 2)) * sin(radians(x * 4 - 200)) AS py,
            sin(radians(y / 2)) AS pz
        FROM parcels
    ), edges AS (
        SELECT *, lead(px) OVER w AS qx, lead(py) OVER w AS qy, lead(pz) OVER w AS qz FROM corners
        WINDOW w AS (PARTITION BY geo_id ORDER BY seq)
    ), normals AS (
        SELECT *, py * qz - pz * qy AS cx, pz * qx - px * qz AS cy, px * qy - py * qx AS cz, px * qx + py * qy + pz * qz AS dot
        FROM edges WHERE qx IS NOT NULL
    ), moments AS (
        SELECT geo_id, sum(a * cx) AS x, sum(a * cy) AS y, sum(a * cz) AS z
        FROM (SELECT *, atan2(sqrt(cx * cx + cy * cy + cz * cz), dot) / sqrt(cx * cx + cy * cy + cz * cz) AS a FROM normals)
        GROUP BY 1
    )
    SELECT geo_id, round(degrees(atan2(y, x)), 6) AS lon, round(degrees(atan2(z, sqrt(x * x + y * y))), 6) AS lat FROM moments""",
    ("parcels",),
)
def geo_centroid_sphere(spark: SparkSession, sf: str) -> DataFrame:
    """Centroids on the sphere of cells of 4 by 1/2 degrees, some of them across the date line."""
    globe = fx.parcel_vertices(spark, sf).withColumns({"x": F.col("x") * 4 - 200, "y": F.col("y") / 2})
    return geo.sphere_centroids(globe).select("geo_id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query(
    """SELECT * FROM (SELECT geo_id, min(x) AS west, min(y) AS south, max(x) AS east, max(y) AS north
        FROM parcels GROUP BY 1)
    WHERE east >= 20.5 AND west <= 60.25 AND north >= 2.5 AND south <= 9.5""",
    ("parcels",),
)
def geo_viewport(spark: SparkSession, sf: str) -> DataFrame:
    return geo.in_view(fx.parcel_vertices(spark, sf), (20.5, 2.5, 60.25, 9.5))


VIEW = (20.5, 2.5, 60.25, 9.5)
IN_VIEW_SQL = """SELECT geo_id FROM parcels GROUP BY 1 HAVING max(x) >= 20.5 AND min(x) <= 60.25 AND max(y) >= 2.5 AND min(y) <= 9.5"""


@query(
    f"""SELECT geo_id, CAST(0 AS INTEGER) AS part, CAST(0 AS INTEGER) AS ring, CAST(seq AS INTEGER) AS seq, x, y
    FROM parcels WHERE geo_id IN ({IN_VIEW_SQL})""",
    ("parcels",),
)
def geo_viewport_layout(spark: SparkSession, sf: str) -> DataFrame:
    """Outlines in a view, read from files that follow a curve through space."""
    path = new_path(with_folder(spark), "layout")
    write_layout(fx.parcel_vertices(spark, sf), path)
    return layout_view(spark, path, VIEW)


@query(
    f"""SELECT n_name, geo_id, CAST(0 AS INTEGER) AS part, CAST(0 AS INTEGER) AS ring, CAST(seq AS INTEGER) AS seq, x, y
    FROM parcels JOIN nation ON c_nationkey = n_nationkey WHERE geo_id IN ({IN_VIEW_SQL})""",
    ("parcels",),
)
def layer_files(spark: SparkSession, sf: str) -> DataFrame:
    """Parcels written as a layer of GeoJSON files in the order of the curve, and the outlines in a view read back from it."""
    path = new_path(with_folder(spark), "layer")
    vertices = fx.parcel_vertices(spark, sf)
    parcels = curve_places(geo.boxes(vertices)).join(fx.parcel_groups(spark, sf), "geo_id")
    features = layers.features(parcels, vertices, "geo_id", ("geo_id", "n_name"), keep=(*BOX, "level", "place"))
    write_layer_files(features.repartitionByRange("level", "place").drop("level", "place"), path)
    found = read_layer_files(spark, path, "geo_id bigint, n_name string", view=VIEW)
    return shape_vertices(found, "geo_id", "n_name")


@query(
    """SELECT geo_id, CAST(seq AS INTEGER) AS seq, round(x * 100000 / 6378137.0::DOUBLE * 180 / pi(), 8) AS x,
        round((2 * atan(exp(y * 100000 / 6378137.0::DOUBLE)) - pi() / 2) * 180 / pi(), 8) AS y,
        CAST(4326 AS INTEGER) AS crs FROM parcels""",
    ("parcels",),
)
def geo_mercator(spark: SparkSession, sf: str) -> DataFrame:
    metres = fx.parcel_vertices(spark, sf).withColumns(
        {"x": F.col("x") * 100000, "y": F.col("y") * 100000, "crs": F.lit(geo.MERCATOR)}
    )
    return geo.to_degrees(metres).select(
        "geo_id", "seq", F.round("x", 8).alias("x"), F.round("y", 8).alias("y"), "crs"
    )


@query(
    """SELECT n_name, x1, y1, x2, y2 FROM (
        SELECT n_name, least(x, nx) AS x1, least(y, ny) AS y1, greatest(x, nx) AS x2,
               greatest(y, ny) AS y2
        FROM (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM parcels
              WINDOW w AS (PARTITION BY geo_id ORDER BY seq))
        JOIN nation ON c_nationkey = n_nationkey WHERE nx IS NOT NULL)
    GROUP BY ALL HAVING count(*) = 1""",
    ("parcels",),
)
def geo_dissolve(spark: SparkSession, sf: str) -> DataFrame:
    return geo.dissolve(fx.parcel_vertices(spark, sf), fx.parcel_groups(spark, sf), "n_name")


RINGS_SQL = """, sides AS (
        SELECT CAST(c_nationkey % 2 AS BIGINT) AS side, [x, y, nx, ny] AS e, x AS x1, y AS y1, nx AS x2, ny AS y2
        FROM (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM parcels WINDOW w AS (PARTITION BY geo_id ORDER BY seq))
        WHERE nx IS NOT NULL
    ), edges AS (
        SELECT * FROM sides a WHERE NOT EXISTS (FROM sides b WHERE b.side = a.side AND b.x1 = a.x2 AND b.y1 = a.y2 AND b.x2 = a.x1 AND b.y2 = a.y1)
    ), followed AS (
        SELECT a.side, a.e, arg_max(b.e, atan2((a.x2 - a.x1) * (b.y2 - b.y1) - (a.y2 - a.y1) * (b.x2 - b.x1),
            (a.x2 - a.x1) * (b.x2 - b.x1) + (a.y2 - a.y1) * (b.y2 - b.y1))) AS next
        FROM edges a JOIN edges b ON a.side = b.side AND a.x2 = b.x1 AND a.y2 = b.y1 GROUP BY 1, 2
    ), walk AS (
        SELECT side, e AS start, e AS cur, 0 AS n FROM followed
        UNION ALL
        SELECT w.side, w.start, f.next, w.n + 1 FROM walk w JOIN followed f ON f.side = w.side AND f.e = w.cur WHERE f.next > w.start
    ), closed AS (
        SELECT w.side, w.start, max(w.n) + 1 AS n FROM walk w JOIN followed f ON f.side = w.side AND f.e = w.cur
        GROUP BY 1, 2 HAVING bool_or(f.next = w.start)
    ), linked AS (
        SELECT w.side, w.start, w.cur, w.n, c.n AS size FROM walk w JOIN closed c ON c.side = w.side AND c.start = w.start
    ), rings AS (
        SELECT side, start, sum(cur[1] * cur[4] - cur[3] * cur[2]) AS area2 FROM linked GROUP BY 1, 2
    ), shells AS (
        SELECT side, start, area2, row_number() OVER (PARTITION BY side ORDER BY start) - 1 AS part FROM rings WHERE area2 > 0
    ), around AS (
        SELECT h.side, h.start, s.part, s.area2
        FROM rings h JOIN shells s ON s.side = h.side JOIN linked l ON l.side = s.side AND l.start = s.start
        WHERE h.area2 < 0 AND (l.cur[2] > (h.start[2] + h.start[4]) / 2) <> (l.cur[4] > (h.start[2] + h.start[4]) / 2)
          AND (h.start[1] + h.start[3]) / 2 < l.cur[1] + ((h.start[2] + h.start[4]) / 2 - l.cur[2]) / (l.cur[4] - l.cur[2]) * (l.cur[3] - l.cur[1])
        GROUP BY ALL HAVING count(*) % 2 = 1
    ), named AS (
        SELECT side, start, part, 0 AS ring FROM shells
        UNION ALL
        SELECT side, start, part, row_number() OVER (PARTITION BY side, part ORDER BY start)
        FROM (SELECT side, start, arg_min(part, area2) AS part FROM around GROUP BY 1, 2)
    )
    SELECT l.side, CAST(part AS INTEGER) AS part, CAST(ring AS INTEGER) AS ring, CAST(unnest(CASE WHEN n = size - 1 THEN [n, size] ELSE [n] END) AS BIGINT) AS seq,
        unnest(CASE WHEN n = size - 1 THEN [cur[1], cur[3]] ELSE [cur[1]] END) AS x, unnest(CASE WHEN n = size - 1 THEN [cur[2], cur[4]] ELSE [cur[2]] END) AS y
    FROM linked l JOIN named m ON m.side = l.side AND m.start = l.start"""


@query(RINGS_SQL.replace("walk AS (", "walk(side, start, cur, n) AS ("), ("parcels",), recursive=True)
def geo_dissolve_rings(spark: SparkSession, sf: str) -> DataFrame:
    """Parcels of even and of odd nations dissolved into polygons with holes."""
    nations = fx.table(with_folder(spark), sf, "customer").select(F.col("c_custkey").alias("geo_id"), (F.col("c_nationkey") % 2).cast("bigint").alias("side"))
    return dissolve_rings(fx.parcel_vertices(spark, sf), nations, "side")


# Sides of bricks cut at the corners on them. Half of all numbers are whole, the others end in .5, so no product rounds.
NODED_SQL = """, bricks AS (
        SELECT geo_id, seq, c_nationkey, 3 * bx + y AS x, 5 * y - bx AS y
        FROM (SELECT *, x + 0.5::DOUBLE * (geo_id // 100 % 2) AS bx FROM parcels)
    ), sides AS (
        SELECT * FROM (SELECT geo_id, seq, c_nationkey, x, y, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM bricks
            WINDOW w AS (PARTITION BY geo_id ORDER BY seq)) WHERE nx IS NOT NULL
    ), corners AS (SELECT DISTINCT x AS px, y AS py FROM bricks
    ), cuts AS (
        SELECT geo_id, seq, px, py, (px - x) * (nx - x) + (py - y) * (ny - y) AS along FROM sides JOIN corners
            ON px >= least(x, nx) AND px <= greatest(x, nx) AND py >= least(y, ny) AND py <= greatest(y, ny)
        WHERE (nx - x) * (py - y) = (ny - y) * (px - x) AND (px, py) <> (x, y) AND (px, py) <> (nx, ny)
    ), noded AS (
        SELECT geo_id, CAST(0 AS INTEGER) AS part, CAST(0 AS INTEGER) AS ring,
            CAST(row_number() OVER (PARTITION BY geo_id ORDER BY seq, along) - 1 AS INTEGER) AS seq, x, y
        FROM (SELECT geo_id, seq, 0 AS along, x, y FROM bricks UNION ALL SELECT geo_id, seq, along, px, py FROM cuts)
    )
    """


@query(NODED_SQL + "SELECT * FROM noded", ("parcels",))
def geo_noded(spark: SparkSession, sf: str) -> DataFrame:
    """Parcels laid like bricks, each with its neighbours' corners on its edges."""
    return noded(fx.staggered_parcels(spark, sf))


@query(
    NODED_SQL
    + """SELECT n_name, x1, y1, x2, y2 FROM (
        SELECT n_name, least((x, y), (nx, ny)) AS a, greatest((x, y), (nx, ny)) AS b,
            a[1] AS x1, a[2] AS y1, b[1] AS x2, b[2] AS y2
        FROM (SELECT geo_id, x, y, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM noded WINDOW w AS (PARTITION BY geo_id ORDER BY seq))
        JOIN customer ON c_custkey = geo_id JOIN nation ON c_nationkey = n_nationkey WHERE nx IS NOT NULL)
    GROUP BY n_name, x1, y1, x2, y2 HAVING count(*) = 1""",
    ("parcels",),
)
def geo_dissolve_noded(spark: SparkSession, sf: str) -> DataFrame:
    """Bricks dissolved by nation: cut at their neighbours' corners they leave no stray edges."""
    return geo.dissolve(noded(fx.staggered_parcels(spark, sf)), fx.parcel_groups(spark, sf), "n_name")


INVALID_SQL = """SELECT geo_id, CAST(0 AS INTEGER) AS part, CAST(0 AS INTEGER) AS ring, *
    EXCLUDE (geo_id) FROM (
        SELECT geo_id,
            first_x IS DISTINCT FROM last_x OR first_y IS DISTINCT FROM last_y AS open_ring,
            n < 4 AS short_ring, holes = 0 AND coalesce(area2 = 0, false) AS zero_area, holes > 0 AS null_coordinate,
            spots < n - CASE WHEN first_x IS NOT DISTINCT FROM last_x
                AND first_y IS NOT DISTINCT FROM last_y THEN 1 ELSE 0 END AS repeated_vertex
        FROM (
            SELECT geo_id, count(*) AS n, count(DISTINCT coalesce(CAST(x AS VARCHAR), '-') || ' ' || y)
                    AS spots,
                count(*) - count(x) AS holes, sum(x * ny - nx * y) AS area2,
                arg_min_null(x, seq) AS first_x, arg_min_null(y, seq) AS first_y,
                arg_max_null(x, seq) AS last_x, arg_max_null(y, seq) AS last_y
            FROM (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM damaged
                  WINDOW w AS (PARTITION BY geo_id ORDER BY seq))
            GROUP BY 1))
    WHERE open_ring OR short_ring OR zero_area OR null_coordinate OR repeated_vertex"""

DAMAGED_SQL = """, damaged AS (
    SELECT geo_id, seq,
        CASE WHEN geo_id % 13 = 4 AND seq = 1 THEN NULL
             WHEN geo_id % 19 = 5 AND seq = 2 THEN x - 1 ELSE x END AS x,
        CASE WHEN geo_id % 11 = 5 THEN 0 ELSE y END AS y
    FROM parcels
    WHERE NOT (geo_id % 7 = 3 AND seq = 4) AND NOT (geo_id % 17 = 6 AND seq >= 2))
"""


@query(DAMAGED_SQL + INVALID_SQL, ("parcels",))
def geo_invalid(spark: SparkSession, sf: str) -> DataFrame:
    return geo.invalid_rings(fx.damaged_parcels(spark, sf))


@query(DAMAGED_SQL + f"SELECT count(DISTINCT geo_id) AS invalid FROM ({INVALID_SQL})", ("parcels",))
def geo_invalid_count(spark: SparkSession, sf: str) -> DataFrame:
    return geo.invalid_count(fx.damaged_parcels(spark, sf))


@query(
    """, twisted AS (
        SELECT geo_id, CASE WHEN geo_id % 23 = 7 AND i IN (1, 2) THEN 3 - i ELSE i END AS seq,
            x + [0, 1, 1, 0.75, 0.5, 0.25, 0, 0][i + 1]::DOUBLE AS x,
            y + [0, 0, 1, 1, 1 - CASE WHEN geo_id % 13 = 4 THEN 1 WHEN geo_id % 17 = 6 THEN 1.5 ELSE 0.5 END, 1, 1, 0][i + 1]::DOUBLE AS y
        FROM parcels, (SELECT unnest(range(8)) AS i) WHERE seq = 0
    ), edges AS (
        SELECT * FROM (SELECT geo_id, seq, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM twisted WINDOW w AS (PARTITION BY geo_id ORDER BY seq))
        WHERE x2 IS NOT NULL
    )
    SELECT DISTINCT a.geo_id, 0 AS part, 0 AS ring FROM edges a JOIN edges b ON a.geo_id = b.geo_id AND a.seq + 1 < b.seq AND NOT (a.seq = 0 AND b.seq = 6)
    WHERE sign((a.x2 - a.x1) * (b.y1 - a.y1) - (a.y2 - a.y1) * (b.x1 - a.x1)) * sign((a.x2 - a.x1) * (b.y2 - a.y1) - (a.y2 - a.y1) * (b.x2 - a.x1)) <= 0
      AND sign((b.x2 - b.x1) * (a.y1 - b.y1) - (b.y2 - b.y1) * (a.x1 - b.x1)) * sign((b.x2 - b.x1) * (a.y2 - b.y1) - (b.y2 - b.y1) * (a.x2 - b.x1)) <= 0
      AND least(a.x1, a.x2) <= greatest(b.x1, b.x2) AND least(b.x1, b.x2) <= greatest(a.x1, a.x2)
      AND least(a.y1, a.y2) <= greatest(b.y1, b.y2) AND least(b.y1, b.y2) <= greatest(a.y1, a.y2)""",
    ("parcels",),
)
def geo_self_intersections(spark: SparkSession, sf: str) -> DataFrame:
    """Parcels whose outline crosses or touches itself."""
    return geo.crossing_rings(fx.twisted_parcels(spark, sf))


def _rated(spark: SparkSession, sf: str) -> DataFrame:
    table = fx.indicators(spark, sf).select("Name", "Storms")
    return plan.rated(table, "Storms", "Storms_percentile", "Storms_rating")


RATED_SQL = f"""SELECT s."Name", "Storms", p AS "Storms_percentile", {rating_sql("p")} AS "Storms_rating"
    FROM indicators s LEFT JOIN ({percentile_sql("indicators", '"Name"', "Storms")}) r
        ON r."Name" = s."Name" """


@query(
    f"""SELECT "Name" AS region, "Name" AS label, "Storms" AS value, "Storms_rating" AS class,
        {ordinal_sql('"Storms_rating"')} AS class_index, west, south, east, north
    FROM ({RATED_SQL}) LEFT JOIN state_squares ON n_name = "Name" """,
    ("indicators", "state_squares"),
)
def indicator_layer(spark: SparkSession, sf: str) -> DataFrame:
    """Rated indicator with class index and the box of the region's shape."""
    boxes = geo.boxes(fx.state_vertices(spark, sf)).join(
        fx.nation_names(spark, sf, "geo_id", "region"), "geo_id"
    )
    layer = layers.choropleth(_rated(spark, sf), "Name", "Name", "Storms", "Storms_rating")
    return layers.indicator_geometry(layer, boxes.drop("geo_id"), "region")


@query(
    f"""SELECT "Name" AS region, 'Name: ' || "Name" || '<br>Storm Rating: '
            || coalesce("Storms_rating", 'NA') || '<br>Storms: '
            || coalesce(CAST("Storms" AS VARCHAR), 'NA') AS popup,
        format('{{:,}}', "Storms") AS comma_label
    FROM ({RATED_SQL})""",
    ("indicators",),
)
def layer_popup(spark: SparkSession, sf: str) -> DataFrame:
    rated = _rated(spark, sf)
    text = layers.popup(
        ("Name", rated["Name"]),
        ("Storm Rating", rated["Storms_rating"]),
        ("Storms", number_text(rated["Storms"])),
    )
    return rated.select(
        rated["Name"].alias("region"), text.alias("popup"), thousands(rated["Storms"]).alias("comma_label")
    )


@query(
    f"""SELECT CAST(position AS INTEGER) AS position, level, count("Name") AS regions
    FROM (VALUES (1, 'Very Low'), (2, 'Low'), (3, 'Moderate'), (4, 'High'), (5, 'Very High'))
        AS l(position, level)
    LEFT JOIN ({RATED_SQL}) ON "Storms_rating" = level GROUP BY 1, 2""",
    ("indicators",),
)
def layer_legend(spark: SparkSession, sf: str) -> DataFrame:
    return layers.legend(_rated(spark, sf), "Storms_rating")


@query(
    """SELECT *, net_migration / (2 * max(abs(net_migration)) OVER ()) + 0.5 AS fill,
        (net_migration - min(net_migration) OVER ())
            / (max(net_migration) OVER () - min(net_migration) OVER ())
            * (CAST(3.0 AS DOUBLE) - CAST(0.8 AS DOUBLE)) + CAST(0.8 AS DOUBLE) AS width
    FROM (SELECT state, net_migration FROM net)""",
    ("net",),
)
def layer_scales(spark: SparkSession, sf: str) -> DataFrame:
    net = fl.balance(fx.flow_long(spark, sf)).select("state", "net_migration")
    return layers.rescaled(layers.diverging(net, "net_migration", "fill"), "net_migration", "width", 0.8, 3.0)


@query(
    f"""SELECT '{{"type":"Feature","properties":{{"region":"' || region || '","value":'
        || coalesce(CAST(value AS VARCHAR), 'null') || ',"class":'
        || coalesce('"' || class || '"', 'null') || '}},"geometry":{{"type":"MultiPolygon",'
        || '"coordinates":[[[[' || west || ',' || south || '],[' || east || ',' || south || '],['
        || east || ',' || north || '],[' || west || ',' || north || '],[' || west || ',' || south
        || ']]]]}}}}' AS feature
    FROM (SELECT "Name" AS region, "Storms" AS value, "Storms_rating" AS class, west, south, east, north
          FROM ({RATED_SQL}) JOIN state_squares ON n_name = "Name")""",
    ("indicators", "state_squares"),
)
def layer_geojson(spark: SparkSession, sf: str) -> DataFrame:
    layer = layers.choropleth(_rated(spark, sf), "Name", "Name", "Storms", "Storms_rating")
    keyed = layer.join(fx.nation_names(spark, sf, "geo_id", "region"), "region")
    return layers.features(keyed, fx.state_vertices(spark, sf), "geo_id", ("region", "value", "class"))
