"""Search of transcripts: lines that contain a text, with the lines around them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def search(lines: DataFrame, query: str, *, library: DataFrame | None = None, video_id: str | None = None, limit: int | None = 10, context: int = 0) -> DataFrame:
    """(video_id, title, line_no, timestamp, line, before, after): lines (video_id, line_no, line) that contain query, case aside, its time
    stamp included. In order of the library (id, title, and place, or updated_at with the last first), or of video_id without one, and of line_no; the
    first `limit`, or all for None. The lines around come from all lines of the video."""
    if video_id:
        lines = lines.where(F.col("video_id") == video_id)
    first = F.col("place")
    if library is not None:
        if "place" not in library.columns:
            library, first = library.withColumn("place", F.coalesce("updated_at", F.lit(""))), F.desc("place")
        names = library.select(F.col("id").alias("video_id"), F.coalesce("title", "id").alias("title"), "place")
    w = W.partitionBy("video_id").orderBy("line_no")
    if context > 0:
        lines = lines.withColumn("before", F.collect_list("line").over(w.rowsBetween(-context, -1))).withColumn("after", F.collect_list("line").over(w.rowsBetween(1, context)))
    else:
        lines = lines.withColumn("before", F.array().cast("array<string>")).withColumn("after", F.array().cast("array<string>"))
    hits = lines.where(F.contains(F.lower("line"), F.lit(query.lower())))
    hits = hits.join(names, "video_id") if library is not None else hits.withColumn("title", F.col("video_id")).withColumn("place", F.lit(0))
    line = F.trim("line")
    stamped = r"^\[([^\]]+)\]\s*(.*)$"
    out = hits.withColumn("timestamp", F.regexp_extract(line, stamped, 1)).withColumn("line", F.when(line.rlike(stamped), F.regexp_extract(line, stamped, 2)).otherwise(line))
    cols = ["video_id", "title", "line_no", "timestamp", "line", "before", "after"]
    return out.select(*cols) if limit is None else out.orderBy(first, "video_id", "line_no").limit(limit).select(*cols)
