"""Queries over page layouts: which verses a page shows, where a verse is shown, what its words are."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scansio.functions import text as tx
from scansio.operators import nested


def placed_words(pages: DataFrame) -> DataFrame:
    """`page_id, edition, page, outer_pos, inner_pos, surah, ayah, w, word` of words with a full location."""
    page = nested.one_per_id(pages, "page_id", "edition", "page")
    at = nested.words_table(pages).withColumns({n: tx.key_part(F.col("location"), i) for i, n in enumerate(("surah", "ayah", "w"))})
    return at.where("surah IS NOT NULL AND ayah IS NOT NULL AND w IS NOT NULL").join(page, "page_id").select("page_id", "edition", "page", "outer_pos", "inner_pos", "surah", "ayah", "w", "word")


def page_verses(pages: DataFrame) -> DataFrame:
    """`page_id, edition, page, surah, ayah, place`: the distinct verses of a page in order of appearance, from 0."""
    first = placed_words(pages).groupBy("page_id", "edition", "page", "surah", "ayah").agg(F.min(F.struct("outer_pos", "inner_pos")).alias("at"))
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("at")) - 1
    return first.select("page_id", "edition", "page", "surah", "ayah", place.alias("place"))


def verse_pages(pages: DataFrame) -> DataFrame:
    """`edition, surah, ayah, page`: the first page that shows a verse."""
    return placed_words(pages).groupBy("edition", "surah", "ayah").agg(F.min("page").alias("page"))


def prior_verses(pages: DataFrame, matched: DataFrame, revealed: DataFrame) -> DataFrame:
    """Verses of a page before the matched one (page_id, surah, ayah) that are not revealed yet."""
    v = page_verses(pages)
    at = v.join(matched, ["page_id", "surah", "ayah"]).groupBy("page_id").agg(F.max("place").alias("upto"))
    return v.join(at, "page_id").where("place < upto").join(revealed, ["page_id", "surah", "ayah"], "left_anti").select("page_id", "surah", "ayah", "place")


def verse_words(pages: DataFrame) -> DataFrame:
    """`edition, surah, ayah, w, word`: a verse's words by their number from 1; where pages repeat one, the least."""
    return placed_words(pages).groupBy("edition", "surah", "ayah", "w").agg(F.min("word").alias("word"))
