"""What the grouping works on: frames with their scores, or where there are none, with their metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import captured_ms, primary_face


def burst_inputs(images: DataFrame, scores: DataFrame, metadata: DataFrame) -> DataFrame:
    """id, src_folder, has_input and the columns that bursts() and winners() need, one row for each image (id, path, src_folder).

    ``scores`` (id, decode_ok, af, global_sharpness, blown_pct, crushed_pct, faces, drive_mode, focal_mm, captured_ms,
    sub_sec_ms, mtime_ms) go first, as far as the frame decoded. Else ``metadata`` (path, drive_mode, focal_mm,
    captured_at, sub_sec_ms) counts, which knows no time of writing and no sharpness. A frame with neither has
    has_input false: a wall between runs. Unknown eyes (negative) are null. scored says that the score counts.
    """
    shot = ("drive_mode", "focal_mm", "captured_ms", "sub_sec_ms", "mtime_ms")
    face = primary_face(F.col("faces"))
    scored = scores.where("decode_ok").select(
        F.col("id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in shot], "af", "global_sharpness", (F.col("blown_pct") + F.col("crushed_pct")).alias("clip_sum"),
        face["face_sharpness"].alias("face_sharpness"), F.when(face["eyes_open"] >= 0, face["eyes_open"]).alias("eyes_open"),
    )
    known = metadata.select(F.col("path").alias("_path"), "drive_mode", "focal_mm", captured_ms(F.col("captured_at"), F.col("sub_sec_ms")).alias("captured_ms"), "sub_sec_ms", F.lit(None).cast("long").alias("mtime_ms"))
    rows = images.select("id", "path", "src_folder").join(scored, F.col("id") == F.col("_id"), "left").join(known, F.col("path") == F.col("_path"), "left")
    has = F.col("_id").isNotNull()
    return rows.select(
        "id", "path", "src_folder", (has | F.col("_path").isNotNull()).alias("has_input"), has.alias("scored"), *[F.when(has, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in shot],
        "af", "global_sharpness", "clip_sum", "eyes_open", "face_sharpness",
    )


def similar_inputs(images: DataFrame, scores: DataFrame, metadata: DataFrame) -> DataFrame:
    """id, has_input, captured_ms, mtime_ms, phash, embedding, one row for each image (id, path).

    Times go by the score, else by the metadata, as for bursts. The hash is only ever the metadata's, which is that of
    the thumbnail: hashes of other sizes do not compare. The embedding is the score's.
    """
    scored = scores.where("decode_ok").select(F.col("id").alias("_id"), F.col("captured_ms").alias("_captured"), "mtime_ms", "embedding")
    known = metadata.select(F.col("path").alias("_path"), captured_ms(F.col("captured_at"), F.col("sub_sec_ms")).alias("captured_ms"), "phash")
    rows = images.select("id", "path").join(scored, F.col("id") == F.col("_id"), "left").join(known, F.col("path") == F.col("_path"), "left")
    has = F.col("_id").isNotNull()
    return rows.select("id", (has | F.col("_path").isNotNull()).alias("has_input"), F.when(has, F.col("_captured")).otherwise(F.col("captured_ms")).alias("captured_ms"), "mtime_ms", "phash", "embedding")


def image_metadata(parsed: DataFrame, thumbnails: DataFrame | None = None) -> DataFrame:
    """The metadata record of each parsed file: its fields but the orientation, sub-seconds as milliseconds; file_size, lrc_rating and phash null until known.

    ``thumbnails`` (path, file_size, phash) bring the size and the thumbnail's hash.
    """
    from ..functions.expr import normalised_datetime, sub_sec_ms

    same = ("camera", "lens", "focal_mm", "aperture", "shutter_seconds", "iso", "gps_lat", "gps_lon", "af_x_pct", "af_y_pct", "exposure_bias", "white_balance", "drive_mode", "pixel_width", "pixel_height")
    rows = parsed.select("path", normalised_datetime(F.col("captured_at")).alias("captured_at"), sub_sec_ms(F.col("sub_sec")).alias("sub_sec_ms"), *same)
    if thumbnails is None:
        rows = rows.withColumns({"file_size": F.lit(None).cast("long"), "phash": F.lit(None).cast("string")})
    else:
        rows = rows.join(thumbnails.select("path", "file_size", "phash"), "path", "left")
    return rows.withColumn("lrc_rating", F.lit(None).cast("int"))


def selected(visible: DataFrame, selection: DataFrame) -> DataFrame:
    """The visible frames among the selected ones (id): a rating never hits what a filter hides."""
    return visible.join(selection.select("id").distinct(), "id", "left_semi")


def compare_candidates(frames: DataFrame, champion: int | None) -> DataFrame:
    """Unrated frames other than the champion, with those that the strip shows: the champion too, as in_strip only."""
    own = F.coalesce(F.col("id") == F.lit(champion), F.lit(False))
    shown = frames.where(own | F.col("rating").isNull())
    return shown.withColumn("candidate", ~own)
