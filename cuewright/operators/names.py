"""Names in source and target: glossary learning, missing names, near spellings and swaps."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from ..functions.matching import ratio
from ..functions.text import latin_skeleton


def learn_glossary(candidates: DataFrame) -> DataFrame:
    """(series, name, spelling): pinned spellings first, else the first one met by (episode, unit)."""
    order = F.struct((~F.col("pinned")).cast("int"), "episode_id", "unit_id", "spelling")
    return candidates.groupBy("series", "name").agg(F.min_by("spelling", order).alias("spelling"))


def source_names(lines: DataFrame, glossary: DataFrame) -> DataFrame:
    """(series, episode_id, unit_id, name, spelling): glossary names that stand as words in a line's source.

    The join is on (series, word): lines are exploded to words, so a name's cost is its occurrences.
    """
    words = lines.select("series", "episode_id", "unit_id", F.explode(F.array_distinct(F.regexp_extract_all("source", F.lit(r"(?U)(\w+)"), F.lit(1)))).alias("name"))
    return words.join(glossary, ["series", "name"])


def name_issues(lines: DataFrame, glossary: DataFrame) -> DataFrame:
    """(episode_id, unit_id, name, spelling): names of the source for which no target word sounds alike."""
    hits = source_names(lines, glossary).join(lines.select("episode_id", "unit_id", "target"), ["episode_id", "unit_id"])
    sounds = F.transform(F.regexp_extract_all("target", F.lit(r"(?U)(\w+)"), F.lit(1)), latin_skeleton)
    return hits.where(~F.array_contains(sounds, latin_skeleton(F.col("spelling")))).select("episode_id", "unit_id", "name", "spelling")


def near_spelling(target: str, spellings: list[str]) -> str:
    """Words of the target that are one edit (two from seven letters on) from exactly one known spelling become it."""
    import re

    present = set(re.findall(r"\w+", target))

    def distance(a: str, b: str, limit: int) -> int:
        if abs(len(a) - len(b)) > limit:
            return limit + 1
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    def fix(m) -> str:
        w = m[0]
        if len(w) < 4 or not w[0].isupper() or w in spellings:
            return w
        limit = 2 if len(w) >= 7 else 1
        near = [s for s in spellings if s not in present and distance(w.casefold(), s.casefold(), limit) <= limit]
        return near[0] if len(near) == 1 else w

    return re.sub(r"\w+", fix, target)


@F.pandas_udf(StringType())
def _normalized(target: pd.Series, spellings: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else near_spelling(t, list(s) if s is not None else []) for t, s in zip(target, spellings)])


def normalize_names(lines: DataFrame, glossary: DataFrame) -> DataFrame:
    """The lines' targets with near spellings of the names that their source has, and what was replaced."""
    own = source_names(lines, glossary).groupBy("episode_id", "unit_id").agg(F.array_sort(F.collect_set("spelling")).alias("spellings"))
    rows = lines.join(own, ["episode_id", "unit_id"], "left")
    return rows.withColumn("fixed", F.when(F.col("spellings").isNotNull(), _normalized("target", "spellings")).otherwise(F.col("target")))


def repair_swapped(lines: DataFrame, glossary: DataFrame) -> DataFrame:
    """(episode_id, unit_id, wrong, right): lines that miss exactly one of their names and hold exactly one foreign spelling."""
    names = source_names(lines, glossary).join(lines.select("episode_id", "unit_id", "target"), ["episode_id", "unit_id"])
    missing = names.where(~F.array_contains(F.split("target", r"\W+"), F.col("spelling"))).groupBy("episode_id", "unit_id").agg(F.min("spelling").alias("right"), F.count("*").alias("n")).where("n = 1")
    words = lines.select("series", "episode_id", "unit_id", F.explode(F.array_distinct(F.split("target", r"\W+"))).alias("spelling"))
    foreign = words.join(glossary.select("series", "spelling").distinct(), ["series", "spelling"]).join(names.select("episode_id", "unit_id", "spelling"), ["episode_id", "unit_id", "spelling"], "left_anti")
    foreign = foreign.groupBy("episode_id", "unit_id").agg(F.min("spelling").alias("wrong"), F.count("*").alias("n")).where("n = 1")
    return missing.drop("n").join(foreign.drop("n"), ["episode_id", "unit_id"])


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) for x, y in zip(a, b)])


def skeleton_matches(sources: DataFrame, targets: DataFrame, least: float = 0.75) -> DataFrame:
    """(episode_id, unit_id, name, word): words of a line's target that sound like a name of its source.

    Both skeletons begin with one class (F counts as B, G as K), the word's is no shorter,
    and they are alike by ``least``.  The join is on the line and the first class, and each
    distinct pair of skeletons is compared once.
    """
    sound = lambda c: F.translate(latin_skeleton(F.col(c)), "FG", "BK")
    a = sources.withColumn("_a", sound("name")).where("_a <> ''").withColumn("_c", F.substring("_a", 1, 1))
    b = targets.withColumn("_b", sound("word")).where("_b <> ''").withColumn("_c", F.substring("_b", 1, 1))
    pairs = a.join(b, ["episode_id", "unit_id", "_c"]).where("length(_b) >= length(_a)")
    alike = pairs.select("_a", "_b").distinct().withColumn("_r", _ratio("_a", "_b")).where(F.col("_r") >= least)
    return pairs.join(alike, ["_a", "_b"]).select("episode_id", "unit_id", "name", "word")


def trim_brief(blocks: DataFrame, items: DataFrame, relations: DataFrame) -> DataFrame:
    """(episode_id, block, names, relations): what of a brief a block of lines needs.

    An item stays where the first word of its name or an alias stands among the block's
    words; a relation stays where it touches an item that stays.  The join is on words.
    """
    words = blocks.select("episode_id", "block", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)(\w+)"), F.lit(1)))).alias("word"))
    keys = items.select("episode_id", "name", F.explode(F.concat(F.array(F.split(F.lower("name"), " ")[0]), F.transform("aliases", lambda x: F.lower(x)))).alias("word"))
    kept = words.join(keys, ["episode_id", "word"]).select("episode_id", "block", "name").distinct()
    ends = relations.withColumn("_r", F.struct("a", "b")).select("episode_id", "_r", F.explode(F.array("a", "b")).alias("name"))
    touched = kept.join(ends, ["episode_id", "name"]).groupBy("episode_id", "block").agg(F.countDistinct("_r").alias("relations"))
    named = kept.groupBy("episode_id", "block").agg(F.array_join(F.sort_array(F.collect_list("name")), ",").alias("names"))
    return named.join(touched, ["episode_id", "block"], "left").select("episode_id", "block", "names", F.coalesce("relations", F.lit(0)).alias("relations"))


#: Bounds of a brief (characters of a field; entries of a list; aliases of a name) and its closed sets.
NAME_CHARS, ALIAS_CHARS, MEANING_CHARS, SUMMARY_CHARS = 60, 80, 120, 1500
MOST_CHARACTERS, MOST_RELATIONS, MOST_TERMS, MOST_ALIASES = 40, 60, 40, 5
GENDERS = ("male", "female")
RELATIONS = ("family", "friends", "couple", "colleagues", "enemies")
_SCHEMA = "characters array<struct<name:string,gender:string,aliases:array<string>>>, relations array<struct<from:string,to:string,type:string>>, terms array<struct<term:string,meaning:string>>, summary string"


def validated_brief(json: Column) -> Column:
    """A model's brief with well-formed entries only, closed sets filled in and fields and lists cut to their bounds."""
    from ..functions.text import let

    text = lambda c, n: F.substring(F.trim(F.coalesce(c, F.lit(""))), 1, n)
    one_of = lambda c, values: F.when(F.lower(c).isin(*values), F.lower(c)).otherwise("unknown")

    def bounded(entries: Column, entry, needed: tuple[str, ...], most: int) -> Column:
        made = F.transform(F.coalesce(entries, F.array()), entry)
        return F.slice(F.filter(made, lambda x: F.greatest(F.lit(False), *[x[n] == "" for n in needed]) == F.lit(False)), 1, most)

    def clean(b: Column) -> Column:
        characters = lambda x: F.struct(text(x["name"], NAME_CHARS).alias("name"), one_of(x["gender"], GENDERS).alias("gender"), F.slice(F.transform(F.coalesce(x["aliases"], F.array()), lambda v: text(v, ALIAS_CHARS)), 1, MOST_ALIASES).alias("aliases"))
        relations = lambda x: F.struct(text(x["from"], NAME_CHARS).alias("from"), text(x["to"], NAME_CHARS).alias("to"), one_of(x["type"], RELATIONS).alias("type"))
        terms = lambda x: F.struct(text(x["term"], NAME_CHARS).alias("term"), text(x["meaning"], MEANING_CHARS).alias("meaning"))
        return F.struct(bounded(b["characters"], characters, ("name",), MOST_CHARACTERS).alias("characters"), bounded(b["relations"], relations, ("from", "to"), MOST_RELATIONS).alias("relations"), bounded(b["terms"], terms, ("term",), MOST_TERMS).alias("terms"), text(b["summary"], SUMMARY_CHARS).alias("summary"))

    return let(F.from_json(json, _SCHEMA), clean)


def validated_speakers(replies: DataFrame, known: DataFrame) -> DataFrame:
    """(episode_id, voice, name, gender) of replies (episode_id, json): known voices only, an unknown name empty, gender from its closed set."""
    each = replies.select("episode_id", F.explode(F.from_json("json", "speakers array<struct<voice:bigint,name:string,gender:string>>")["speakers"]).alias("x"))
    name = F.trim(F.coalesce("x.name", F.lit("")))
    rows = each.select("episode_id", "x.voice", F.when(F.lower(name) == "unknown", "").otherwise(F.substring(name, 1, NAME_CHARS)).alias("name"), F.when(F.lower("x.gender").isin(*GENDERS), F.lower("x.gender")).otherwise("unknown").alias("gender"))
    return rows.join(known.select("episode_id", "voice").distinct(), ["episode_id", "voice"], "left_semi")
