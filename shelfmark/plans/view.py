"""Rendering a library and previewing the result."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.template import referenced_fields, template_column
from shelfmark.operators import tree
from shelfmark.operators.catalog import field_columns


def render(tracks: DataFrame, tags: DataFrame, template: str, fallbacks=None, default: str = "", skip_missing: bool = False) -> DataFrame:
    """id, content_version, format, path (null where a track is skipped).

    Only the tag keys the template names are loaded, all fields come out of one
    aggregation, and only the narrow track columns meet them in the join.
    """
    fields = referenced_fields(template)
    narrow = tracks.select("id", "content_version", "format")
    if fields:
        cols = field_columns(tags, fields).withColumnRenamed("track_id", "id")
        narrow = narrow.join(cols, "id", "left")
    lookup = lambda name: F.col(f"f_{fields.index(name)}")
    path = template_column(template, lookup, fallbacks, default, F.col("format"), skip_missing)
    return narrow.select("id", "content_version", "format", path.alias("path"))


def view(tracks: DataFrame, tags: DataFrame, template: str, case_insensitive: bool = False, **options) -> DataFrame:
    """Final collision-free path per track."""
    return tree.place(render(tracks, tags, template, **options).select("id", "path"), case_insensitive)


def preview(tracks: DataFrame, tags: DataFrame, template: str, limit: int = 30, case_insensitive: bool = False, **options) -> DataFrame:
    """The first paths in walk order with the counts of files and directories and how many more there are."""
    placed = tree.place(render(tracks, tags, template, **options).select("id", "path"), case_insensitive)
    counts = tree.entry_counts(tree.tree_nodes(placed)).select(F.struct("files", "dirs")).scalar()
    first = tree.preview_paths(placed, limit).withColumn("counts", counts)
    return first.select("final_path", "counts.files", "counts.dirs", F.greatest(F.col("counts.files") - limit, F.lit(0)).alias("more"))
