"""Queries over sidecar texts, and over the small expressions that metadata passes through."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr, formats, sidecar
from .frames import table
from .registry import query


def _element(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, xmp: sidecars of every shape: flags, stars as attribute and element, marks and creators, a user's own content."""
    e = F.col("event_id")
    pick = F.when(e % 5 == 0, "-1").when(e % 5 == 1, "1").when(e % 5 == 2, "0").when(e % 5 == 3, " x ")
    stars = F.element_at(F.array(*[F.lit(x) for x in ("-1", "0", "1", "3", "5", " 2 ", "n/a")]), (e % 7 + 1).cast("int"))
    attribute = lambda name, value: F.concat(F.lit(f' {name}="'), value, F.lit('"'))
    parts = [
        F.lit("<x:xmpmeta"), F.when(e % 11 == 0, attribute("x:xmptk", F.concat(F.lit("Shutterloom "), (e % 3).cast("string")))), F.lit("><rdf:Description"),
        F.when(e % 3 == 0, attribute("xmlns:loom", F.lit("u"))), F.when(e % 13 == 0, attribute("xmp:CreatorTool", F.lit("Other tool"))), attribute("xmpDM:pick", pick),
        F.when(e % 2 == 0, attribute("xmp:Rating", stars)), F.when(e % 17 < 3, attribute("loom:fav", F.when(e % 17 < 2, "star").otherwise("flag"))), F.lit(">"),
        F.when(e % 4 == 1, _element("xmp:Rating", stars)), F.when(e % 19 == 0, _element("dc:title", F.col("event_type"))), F.when(e % 23 == 0, F.lit("\n<Shutterloom/>")), F.lit("</rdf:Description></x:xmpmeta>"),
    ]
    return table(spark, sf_dir, "events").select("event_id", F.concat(*[F.coalesce(p, F.lit("")) for p in parts]).alias("xmp"))


_TEXTS = """
x0 AS (SELECT event_id AS e, event_type, CASE event_id % 5 WHEN 0 THEN '-1' WHEN 1 THEN '1' WHEN 2 THEN '0' WHEN 3 THEN ' x ' END AS pick, ['-1', '0', '1', '3', '5', ' 2 ', 'n/a'][event_id % 7 + 1] AS stars FROM events),
x1 AS (SELECT e AS event_id, '<x:xmpmeta' || CASE WHEN e % 11 = 0 THEN ' x:xmptk="Shutterloom ' || (e % 3) || '"' ELSE '' END || '><rdf:Description' || CASE WHEN e % 3 = 0 THEN ' xmlns:loom="u"' ELSE '' END
  || CASE WHEN e % 13 = 0 THEN ' xmp:CreatorTool="Other tool"' ELSE '' END || coalesce(' xmpDM:pick="' || pick || '"', '') || CASE WHEN e % 2 = 0 THEN ' xmp:Rating="' || stars || '"' ELSE '' END
  || CASE WHEN e % 17 < 2 THEN ' loom:fav="star"' WHEN e % 17 = 2 THEN ' loom:fav="flag"' ELSE '' END || '>' || CASE WHEN e % 4 = 1 THEN '<xmp:Rating>' || stars || '</xmp:Rating>' ELSE '' END
  || CASE WHEN e % 19 = 0 THEN '<dc:title>' || event_type || '</dc:title>' ELSE '' END || CASE WHEN e % 23 = 0 THEN chr(10) || '<Shutterloom/>' ELSE '' END || '</rdf:Description></x:xmpmeta>' AS x FROM x0),
x2 AS (SELECT *, TRY_CAST(nullif(trim(regexp_extract(x, 'xmpDM:pick="([^"]*)"', 1)), '') AS INTEGER) AS pick,
  TRY_CAST(nullif(trim(CASE WHEN contains(x, '<xmp:Rating>') THEN regexp_extract(x, '<xmp:Rating>(.*?)</xmp:Rating>', 1, 's') ELSE regexp_extract(x, 'xmp:Rating="([^"]*)"', 1) END), '') AS INTEGER) AS star,
  CASE WHEN contains(x, 'loom:fav="') THEN regexp_extract(x, 'loom:fav="([^"]*)"', 1) END AS mark, contains(x, 'xmlns:loom=') OR contains(x, 'CreatorTool="Shutterloom') OR contains(x, 'x:xmptk="Shutterloom') AS ours FROM x1),
x3 AS (SELECT *, CASE WHEN mark IS NOT NULL THEN mark = 'star' ELSE ours AND coalesce(star = 1, false) END AS owns FROM x2)"""


@query(f"""WITH {_TEXTS} SELECT event_id, sha256(x) AS text, pick, star, mark, ours, owns,
  CASE WHEN pick < 0 THEN 'reject' WHEN pick > 0 THEN CASE WHEN mark IS NOT NULL OR star = 1 THEN 'favorite' ELSE 'keep' END WHEN pick IS NULL AND ours THEN CASE star WHEN -1 THEN 'reject' WHEN 5 THEN 'favorite' WHEN 0 THEN 'keep' END END AS rating,
  CASE WHEN NOT owns AND star BETWEEN 1 AND 5 THEN star END AS user_star FROM x3""")
def sidecar_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a sidecar says: flag, stars, whose they are, and the rating."""
    x = F.col("xmp")
    return texts(spark, sf_dir).select(
        "event_id", F.sha2(x, 256).alias("text"), sidecar.attribute(x, "xmpDM:pick").alias("pick"), sidecar.star(x).alias("star"), sidecar.favourite_mark(x).alias("mark"),
        sidecar.is_ours(x).alias("ours"), sidecar.owns_star(x).alias("owns"), sidecar.rating(x).alias("rating"), sidecar.user_star(x).alias("user_star"),
    )


_K = "l_orderkey * 8 + l_linenumber"


@query(f"""WITH l AS (SELECT *, {_K} AS k, l_linenumber % 4 AS o, l_quantity / 50 AS x, l_discount AS y, CAST(l_quantity AS INTEGER) * 131 AS w, CAST(l_partkey % 97 + 1 AS INTEGER) * 67 AS h FROM lineitem),
m AS (SELECT *, [3, 6, 8, 1][o + 1] AS turn, sqrt(l_quantity * l_quantity + l_tax * l_tax) AS norm, greatest(0.0, least(l_quantity + 10, 35.0) - greatest(l_quantity, 25.0)) * greatest(0.0, least(l_tax * 100 + 4, 8.0) - greatest(l_tax * 100, 2.0)) AS shared FROM l)
SELECT k, round(l_quantity / norm, 6) AS unit, CASE l_linenumber % 3 WHEN 0 THEN CAST(left(rpad(CAST(l_partkey AS VARCHAR), 3, '0'), 3) AS INTEGER) WHEN 1 THEN CAST(left(rpad(CAST(l_suppkey AS VARCHAR), 3, '0'), 3) AS INTEGER) END AS sub_sec,
  CASE WHEN l_linenumber % 2 = 0 THEN strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') ELSE strftime(l_shipdate, '%Y:%m:%d %H.%M') END AS taken,
  round((l_linenumber + l_quantity / 60 + l_discount * 100 / 3600) * CASE WHEN l_returnflag IN ('A', 'N') THEN 1 ELSE -1 END, 6) AS gps,
  round(CASE turn WHEN 3 THEN 1 - x WHEN 6 THEN 1 - y WHEN 8 THEN y ELSE x END, 6) AS turned_x, round(CASE turn WHEN 3 THEN 1 - y WHEN 6 THEN x WHEN 8 THEN 1 - x ELSE y END, 6) AS turned_y,
  CASE WHEN turn IN (6, 8) THEN h ELSE w END AS shown_width, CASE WHEN greatest(w, h) > 2560 THEN CAST(greatest(1, (h * 2560 * 2 + greatest(w, h)) // (greatest(w, h) * 2)) AS INTEGER) END AS middle_height, CAST(ceil(w / 32) * 32 AS INTEGER) AS padded,
  round(shared / (40 + 60 - shared), 6) AS overlap,
  'suggested ' || CASE l_returnflag WHEN 'R' THEN 'reject' WHEN 'A' THEN 'favorite' ELSE 'keep' END || ' · ' || CAST(floor(l_discount * 100 + 0.5) AS BIGINT) || '%' || CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE ' · ' || l_shipmode END AS title
FROM (SELECT *, CASE l_linestatus WHEN 'O' THEN 'soft focus' ELSE 'heavy blur, closed eyes' END AS l_shipmode FROM m)""")
def metadata_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What single values of metadata and geometry become."""
    n, q, c = F.col("l_linenumber"), F.col("l_quantity"), F.col
    turn = F.element_at(F.array(*[F.lit(x) for x in (3, 6, 8, 1)]), (n % 4 + 1).cast("int"))
    width, height = q.cast("int") * 131, (c("l_partkey") % 97 + 1).cast("int") * 67
    digits = F.when(n % 3 == 0, F.concat(c("l_partkey").cast("string"), F.lit(" "))).when(n % 3 == 1, c("l_suppkey").cast("string")).otherwise("1a")
    stamp = F.when(n % 2 == 0, F.date_format("l_shipdate", "yyyy:MM:dd HH:mm:ss")).otherwise(F.date_format("l_shipdate", "yyyy:MM:dd HH.mm"))
    ref = F.when(c("l_returnflag") == "A", "N").when(c("l_returnflag") == "N", "east").otherwise("south")
    point = expr.oriented_point(turn, q / 50, c("l_discount"))
    box = lambda x, y, w, h: F.struct(x.alias("x"), y.alias("y"), F.lit(w).alias("w"), F.lit(h).alias("h"))
    verdict = F.when(c("l_returnflag") == "R", "reject").when(c("l_returnflag") == "A", "favorite").otherwise("keep")
    why = F.when(n % 3 == 0, F.array().cast("array<string>")).when(c("l_linestatus") == "O", F.array(F.lit("soft focus"))).otherwise(F.array(F.lit("heavy blur"), F.lit("closed eyes")))
    return table(spark, sf_dir, "lineitem").select(
        (c("l_orderkey") * 8 + n).alias("k"), F.round(expr.l2_normalised(F.array(q, c("l_tax")))[0], 6).alias("unit"), expr.sub_sec_ms(digits).alias("sub_sec"), expr.normalised_datetime(stamp).alias("taken"),
        F.round(expr.gps_degrees(n.cast("double"), q, c("l_discount") * 100, ref), 6).alias("gps"), F.round(point["x"], 6).alias("turned_x"), F.round(point["y"], 6).alias("turned_y"),
        expr.display_dims(turn, width, height)["width"].alias("shown_width"), expr.mid_dims(width, height)["height"].alias("middle_height"), expr.padded(width).alias("padded"),
        F.round(expr.iou(box(q, c("l_tax") * 100, 10.0, 4.0), box(F.lit(25.0), F.lit(2.0), 10.0, 6.0)), 6).alias("overlap"), formats.suggestion_title(verdict, c("l_discount"), why).alias("title"),
    )
