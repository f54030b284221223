"""Stored settings and session catalogs as JSON text: fields of the wrong kind fall back, one by one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.formats import rejected_folder

#: Names and defaults of the settings.
SWITCHES = {
    "defaultThumbsVisible": True, "defaultExifVisible": False, "defaultClippingVisible": False, "defaultPeakingVisible": False, "defaultCompositionVisible": False,
    "openLastFolderOnLaunch": False, "smartCulling": True, "smartCullingOnOpen": True, "deepAnalysis": True,
}
CHOICES = {
    "storageMode": ("local", "network"), "defaultFilter": ("all", "unrated", "keeps", "keepsFavs", "suggested", "suggestedRejects", "suggestedKeeps", "suggestedFavs"),
    "thumbsPosition": ("bottom", "top"), "smartCullingConfidence": ("medium", "low", "high"),
}
RECENTS = 5


def _value(json: Column, name: str) -> Column:
    """A field of any kind; null if it is absent or the JSON is broken."""
    return F.try_variant_get(F.try_parse_json(json), f"$.{name}", "variant")


def _of(json: Column, name: str, kind: str, schema: str) -> Column:
    v = _value(json, name)
    return F.when(F.schema_of_variant(v) == schema, F.try_variant_get(v, "$", kind))


def settings(json: Column) -> Column:
    """struct of all settings, the first of each choice its default. Anything but an object gives the defaults."""
    fields = [F.coalesce(_of(json, n, "boolean", "BOOLEAN"), F.lit(d)).alias(n) for n, d in SWITCHES.items()]
    for name, allowed in CHOICES.items():
        v = _of(json, name, "string", "STRING")
        if name == "defaultFilter":
            v = F.when(v == "favorites", F.lit("keepsFavs")).otherwise(v)  # its name before
        fields.append(F.when(v.isin(*allowed), v).otherwise(F.lit(allowed[0])).alias(name))
    folder = _of(json, "rejectedSubfolder", "string", "STRING")
    fields.append(F.when(folder.isNotNull(), rejected_folder(folder)).otherwise(F.lit("_rejected")).alias("rejectedSubfolder"))
    mode, path = _of(json, "exportFolder.mode", "string", "STRING"), _of(json, "exportFolder.path", "string", "STRING")
    fields.append(F.when((mode == "pinned") & path.isNotNull(), path).alias("exportFolderPinned"))  # null: the last one is remembered
    return F.struct(*fields)


def recents(stored: DataFrame) -> DataFrame:
    """paths, count, rated, last_opened, done with the keys of ``stored``, from its JSON columns v2 and v1; five at most of each row.

    v1, whose entries have one path each, counts only where there is no v2. Entries without paths or a last opening
    are dropped, repeated paths are one, and counts are brought to 0 <= rated <= count.
    """
    keys = [c for c in stored.columns if c not in ("v1", "v2")]
    entries = lambda c: F.try_variant_get(F.try_parse_json(c), "$", "array<variant>")
    text = lambda v, at: F.when(F.schema_of_variant(F.try_variant_get(v, at, "variant")) == "STRING", F.try_variant_get(v, at, "string"))
    number = lambda v, at: F.when(F.schema_of_variant(F.try_variant_get(v, at, "variant")).rlike("^(BIGINT|DECIMAL|DOUBLE)"), F.try_variant_get(v, at, "double"))
    many = F.try_variant_get(F.col("e"), "$.paths", "array<variant>")
    strings = F.transform(many, lambda x: text(x, "$"))
    good = F.when(F.forall(strings, lambda x: F.coalesce(x != "", F.lit(False))), strings)
    one = text(F.col("e"), "$.path")
    rows = stored.select(*keys, F.col("v2").isNotNull().alias("_new"), F.posexplode(F.coalesce(F.when(F.col("v2").isNotNull(), entries(F.col("v2"))).otherwise(entries(F.col("v1"))), F.array().cast("array<variant>"))).alias("_i", "e"))
    paths = F.when(F.col("_new"), good).otherwise(F.when(one != "", F.array(one)))
    rows = rows.select(*keys, "_i", paths.alias("paths"), number(F.col("e"), "$.count").alias("count"), number(F.col("e"), "$.rated").alias("rated"), text(F.col("e"), "$.lastOpened").alias("last_opened"), F.coalesce(F.try_variant_get(F.col("e"), "$.done", "boolean"), F.lit(False)).alias("done"))
    rows = rows.where((F.size("paths") > 0) & F.col("last_opened").isNotNull())
    kept = rows.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_list(F.struct("_i", "paths", "count", "rated", "last_opened", "done"))), 1, RECENTS).alias("all")).select(*keys, F.explode("all").alias("r"))
    count = F.greatest(F.lit(0.0), F.coalesce("r.count", F.lit(0.0)))
    rated = F.least(F.greatest(F.lit(0.0), F.coalesce("r.rated", F.lit(0.0))), count)
    whole = kept.select(*keys, F.array_distinct("r.paths").alias("paths"), count.cast("long").alias("count"), rated.cast("long").alias("rated"), F.col("r.last_opened").alias("last_opened"), (F.col("r.done") & (count > 0) & (rated == count)).alias("done"))
    return whole
