"""Passes per episode over voices and speech: linking, window planning, text diffs, and the batch translation hook."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.matching import differences
from .folds import ordered_fold


def link_speakers(voices: DataFrame, threshold: float = 0.55) -> DataFrame:
    """(episode_id, window, local, speaker): window-local voices joined to running centroids by cosine, one-to-one in a window.

    Centroids depend on the windows before, so an episode is one pass; it holds one small
    vector a voice.  A null vector is a speaker of its own.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["window", "local"])
        sums: list[np.ndarray | None] = []
        out = []
        for window, part in pdf.groupby("window", sort=True):
            taken: set[int] = set()
            for local, v in zip(part["local"], part["vector"]):
                best, who = threshold, None
                if v is not None:
                    v = np.asarray(v, float)
                    v = v / max(np.linalg.norm(v), 1e-12)
                    for i, c in enumerate(sums):
                        if i not in taken and c is not None:
                            score = float(v @ c) / max(np.linalg.norm(c), 1e-12)
                            if score >= best and (who is None or score > best):
                                best, who = score, i
                if who is None:
                    sums.append(v)
                    who = len(sums) - 1
                else:
                    sums[who] = sums[who] + v
                taken.add(who)
                out.append((pdf["episode_id"].iloc[0], window, local, who))
        return pd.DataFrame(out, columns=["episode_id", "window", "local", "speaker"])

    return voices.groupBy("episode_id").applyInPandas(run, "episode_id long, window int, local int, speaker int")


def embedding_speech(turns: DataFrame, need_ms: int = 20_000, least_ms: int | None = 1000) -> DataFrame:
    """The turns that a voice is known by: its longest ones until they reach ``need_ms``; none of a voice with less than ``least_ms``, where given."""
    length = F.col("end_ms") - F.col("start_ms")
    order = Window.partitionBy("episode_id", "speaker").orderBy(F.desc(length), "turn_id").rowsBetween(Window.unboundedPreceding, -1)
    picked = turns.withColumn("_before", F.coalesce(F.sum(length).over(order), F.lit(0))).where(F.col("_before") < need_ms).drop("_before")
    if least_ms is None:
        return picked
    return picked.withColumn("_all", F.sum(length).over(Window.partitionBy("episode_id", "speaker"))).where(F.col("_all") >= least_ms).drop("_all")


def plan_windows(speech: DataFrame, length_ms: int = 600_000, slack_ms: int = 45_000, tail_ms: int = 60_000, min_pause_ms: int = 200) -> DataFrame:
    """(episode_id, window, start_ms, end_ms): windows cut in the longest pause near each ideal border."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("start_ms")
        begin, end = int(pdf["start_ms"].iloc[0]), int(pdf["end_ms"].max())
        reach, pauses = begin, []
        for s, e in zip(pdf["start_ms"], pdf["end_ms"]):
            if s - reach >= min_pause_ms:
                pauses.append((reach, s))
            reach = max(reach, e)
        cuts, at = [begin], begin
        starts = [p[0] for p in pauses]
        while end - at > length_ms + tail_ms:
            ideal = at + length_ms
            near = []
            for i in range(max(0, int(np.searchsorted(starts, ideal - slack_ms)) - 1), len(pauses)):
                lo, hi = max(pauses[i][0], ideal - slack_ms), min(pauses[i][1], ideal + slack_ms)
                if pauses[i][0] > ideal + slack_ms:
                    break
                if hi - lo >= min_pause_ms:
                    near.append((hi - lo, -(lo + hi) // 2))
            at = -max(near)[1] if near else ideal
            cuts.append(int(at))
        cuts.append(end)
        ep = pdf["episode_id"].iloc[0]
        return pd.DataFrame([(ep, i, a, b) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))], columns=["episode_id", "window", "start_ms", "end_ms"])

    return speech.groupBy("episode_id").applyInPandas(run, "episode_id long, window int, start_ms long, end_ms long")


def diff_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(episode_id, kind, a_from, a_to, b_from, b_to): blocks that differ between two ordered line lists."""

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        ep = (x if len(x) else y)["episode_id"].iloc[0]
        left, right = (d.sort_values("unit_id")["text"].fillna("").tolist() for d in (x, y))
        return pd.DataFrame([(ep, *op) for op in differences(left, right)], columns=["episode_id", "kind", "a_from", "a_to", "b_from", "b_to"])

    cut = lambda d: d.select("episode_id", "unit_id", "text").groupBy("episode_id")
    return cut(a).cogroup(cut(b)).applyInPandas(run, "episode_id long, kind string, a_from int, a_to int, b_from int, b_to int")


def translate_in_batches(lines: DataFrame, fn: Callable[[list[str], list[tuple[str, str]]], list[str]], batch: int = 8, context: int = 3) -> DataFrame:
    """The lines with ``translation``: ``fn(texts, last pairs)`` per batch of an episode; a batch of wrong length is asked line by line.

    A pass in order of the lines that holds one batch and the last ``context`` pairs.
    """
    others = [c for c in lines.columns if c not in ("episode_id", "text", "translation")]

    def translated(rows: Iterator[tuple]) -> Iterator[tuple]:
        last: deque[tuple[str, str]] = deque(maxlen=context)
        while part := list(islice(rows, batch)):
            texts = [r[0] or "" for r in part]
            got = fn(texts, list(last))
            if len(got) != len(texts):
                got = [(fn([t], list(last)) or [""])[0] for t in texts]
            last.extend(zip(texts, got))
            yield from ((t, *r) for t, r in zip(got, part))

    values = "translation string, " + ", ".join(f"`{c}` {lines.schema[c].dataType.simpleString()}" for c in ("text", *others))
    out = ordered_fold(lines, ["episode_id"], [F.col("unit_id")], ["text", *others], translated, values)
    return out.select(*[c for c in lines.columns if c != "translation"], "translation")
