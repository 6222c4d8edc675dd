"""The production plan: translated lines to finished cues with flags and confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.layout import wrapped
from ..functions.text import language_fix
from ..operators.checks import check_cues, confidence_category
from ..operators.timing import fix_overlaps, polish_timing, snap_frames


def finalize_episode(lines: DataFrame, fps: float | None = 25.0, language: str = "en") -> DataFrame:
    """(episode_id, unit_id, start_ms, end_ms, text, qa_flags, confidence) of every line, merged ones with their cue's result.

    One exchange by episode feeds all passes: overlaps, timing, frames and checks share the key.
    """
    ready = lines.withColumn("text", wrapped(language_fix(F.col("text")), F.lit(language))).where("text <> ''")
    cues = polish_timing(fix_overlaps(ready))
    if fps:
        cues = snap_frames(cues, fps)
    checked = check_cues(cues, order="start_ms")
    each = checked.withColumn("unit_id", F.explode(F.concat(F.array("unit_id"), "absorbed")))
    return each.select("episode_id", "unit_id", "start_ms", "end_ms", "text", "qa_flags", confidence_category(F.col("qa_flags"), F.lit(None).cast("double")).alias("confidence"))
