"""The corpus of ordered passages, its derived columns, its index, and lookups by reference.

A corpus holds any number of books (editions); a verse is (book, surah, ayah), and `idx` counts the verses of a book from
0 in the order of surahs and ayahs. Redelivered rows are one verse.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scansio.functions import text as tx
from scansio.session import written

CONTEXT = 2
#: Bonuses of the three verses that follow a hint.
BONUSES = (0.22, 0.12, 0.06)


def base(verses: DataFrame) -> DataFrame:
    """`verse_id, book, surah, ayah, text_uthmani, text_clean, surah_name, surah_name_en, idx` of every referenced verse.

    Of redelivered rows the one that `one_per_id` takes. Texts are shuffled once, by book, where idx is counted: which
    ids came in several books is found from ids and books alone, and their rows but in the greatest are marked as lost."""
    own = ["surah", "ayah", "text_uthmani", "text_clean", "surah_name", "surah_name_en"]
    rows = verses.select("verse_id", "edition", *own).where("verse_id IS NOT NULL")
    refs, h = rows.select("verse_id", "edition"), F.xxhash64("edition")
    several = refs.groupBy("verse_id").agg(F.min(h).alias("a"), F.max(h).alias("b")).where("a <> b").select("verse_id")
    there = refs.join(several, "verse_id").withColumn("most", F.max("edition").over(Window.partitionBy("verse_id")))
    lost = there.where("edition < most").select("verse_id", "edition", F.lit(True).alias("lost"))
    both = rows.withColumn("lost", F.lit(False)).unionByName(lost, allowMissingColumns=True).where("edition IS NOT NULL").repartition("edition")
    one = both.groupBy("edition", "verse_id").agg(F.max(F.struct(*own)).alias("_r"), F.max("lost").alias("lost")).where("NOT lost").select("edition", "verse_id", "_r.*")
    idx = F.row_number().over(Window.partitionBy("edition").orderBy("surah", "ayah")) - 1
    return one.where("surah IS NOT NULL AND ayah IS NOT NULL").withColumn("idx", idx).select("verse_id", F.col("edition").alias("book"), *own, "idx")


def build(verses: DataFrame) -> DataFrame:
    """`base` with `norm, ns, no_bsm, no_bsm_ns, words`, computed from text_clean, or text_uthmani where that is missing
    or empty. Verses without any text are left out of matching: their derived columns are empty."""
    source = F.coalesce(F.nullif(F.col("text_clean"), F.lit("")), F.col("text_uthmani"), F.lit(""))
    derived = base(verses).withColumn("norm", tx.normalize(source))
    derived = derived.withColumn("no_bsm", tx.without_opening(F.col("norm"), F.col("surah"), F.col("ayah")))
    return derived.withColumns({"ns": tx.no_spaces(F.col("norm")), "no_bsm_ns": tx.no_spaces(F.col("no_bsm")), "words": tx.words(F.col("norm"))})


def stored(corpus: DataFrame) -> DataFrame:
    """What matching reads of a corpus in several places, as a written table of no more than that: `at`, a number in the order
    of books and their verses, `book, idx, surah, ayah, norm, no_bsm`, and `ns, no_bsm_ns, words`, which follow from these."""
    if "at" in corpus.columns:
        return corpus
    own = written(corpus.select("book", "idx", "surah", "ayah", "norm", "no_bsm"))
    # A row a book, of hundreds of verses each.
    books = own.select("book").distinct().withColumn("nth", F.row_number().over(Window.orderBy("book")).cast("long"))
    numbered = own.join(F.broadcast(books), "book").withColumn("at", F.shiftleft("nth", 32) + F.col("idx")).drop("nth")
    return numbered.withColumns({"ns": tx.no_spaces(F.col("norm")), "no_bsm_ns": tx.no_spaces(F.col("no_bsm")), "words": tx.words(F.col("norm"))})


def trigram_index(corpus: DataFrame) -> DataFrame:
    """`tri, book, idx`: the distinct trigrams of every verse without spaces."""
    return corpus.select("book", "idx", F.explode(tx.trigrams(F.col("ns"))).alias("tri"))


def with_verse(refs: DataFrame, corpus: DataFrame, *columns: str) -> DataFrame:
    """`refs` (book, surah, ayah, ...) with columns of the verse they name, null where there is none."""
    return refs.join(corpus.select("book", "surah", "ayah", *columns), ["book", "surah", "ayah"], "left")


def surah_view(corpus: DataFrame) -> DataFrame:
    """`book, surah, surah_name, surah_name_en, n_verses, verses`: verses as an array in order. A surah is at most a few
    hundred verses of one book."""
    verses = F.array_sort(F.collect_list(F.struct("ayah", "text_uthmani")))
    return corpus.groupBy("book", "surah").agg(F.min("surah_name").alias("surah_name"), F.min("surah_name_en").alias("surah_name_en"), F.count(F.lit(1)).alias("n_verses"), verses.alias("verses"))


def successors(corpus: DataFrame) -> DataFrame:
    """`book, surah, ayah, next_surah, next_ayah`: the next ayah, or the first verse of the next surah; null where the
    book has neither."""
    v = corpus.select("book", "surah", "ayah")
    first = v.groupBy("book", "surah").agg(F.min("ayah").alias("f")).select("book", (F.col("surah") - 1).alias("surah"), "f")
    follows = v.select("book", "surah", (F.col("ayah") - 1).alias("ayah"), F.lit(True).alias("has"))
    met = v.join(follows, ["book", "surah", "ayah"], "left").join(first, ["book", "surah"], "left")
    here = F.col("has").isNotNull()
    nxt = F.when(here, F.col("surah")).when(F.col("f").isNotNull(), F.col("surah") + 1)
    return met.select("book", "surah", "ayah", nxt.alias("next_surah"), F.when(here, F.col("ayah") + 1).otherwise(F.col("f")).alias("next_ayah"))


def surrounding(refs: DataFrame, corpus: DataFrame, reach: int = CONTEXT) -> DataFrame:
    """Rows `book, surah, ayah, near_ayah, text, is_current` of verses of the surah at most `reach` away. Each ref is
    expanded to the ayahs it may meet, so that the join is one on equal keys."""
    wanted = refs.select("book", "surah", "ayah").distinct().select("*", F.explode(F.sequence(F.col("ayah") - reach, F.col("ayah") + reach)).alias("near_ayah"))
    near = corpus.select("book", "surah", F.col("ayah").alias("near_ayah"), F.col("text_uthmani").alias("text"))
    return wanted.join(near, ["book", "surah", "near_ayah"]).select("book", "surah", "ayah", "near_ayah", "text", (F.col("near_ayah") == F.col("ayah")).alias("is_current"))


def continuation_bonuses(hints: DataFrame, corpus: DataFrame) -> DataFrame:
    """`qid, book, surah, ayah, bonus` of hints (qid, hint_surah, hint_ayah), in every book: the three verses after the
    hint as far as the first of them is in the surah; else the first three of the next surah."""
    v = corpus.select("book", "surah", "ayah")
    # A hint is looked up in every book: by surah and ayah alone, with an equal join.
    step = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(b).alias("bonus")) for i, b in enumerate(BONUSES)]))
    ahead = hints.where("hint_surah IS NOT NULL AND hint_ayah IS NOT NULL").select("qid", "hint_surah", "hint_ayah", step.alias("s")).select("qid", "hint_surah", "hint_ayah", "s.*")
    within = ahead.select("qid", F.col("hint_surah").alias("surah"), (F.col("hint_ayah") + 1 + F.col("i")).alias("ayah"), "i", "bonus").join(v, ["surah", "ayah"])
    firsts = within.where("i = 0").select("qid", "book")
    same = within.join(firsts, ["qid", "book"], "left_semi").select("qid", "book", "surah", "ayah", "bonus")
    books = v.where("book IS NOT NULL").withColumn("i", F.row_number().over(Window.partitionBy("book", "surah").orderBy("ayah")) - 1).where(F.col("i") < len(BONUSES))
    rolled = ahead.select("qid", (F.col("hint_surah") + 1).alias("surah"), "i", "bonus").join(books, ["surah", "i"]).join(firsts, ["qid", "book"], "left_anti")
    return same.unionByName(rolled.select("qid", "book", "surah", "ayah", "bonus"))


def equivalence_members(corpus: DataFrame) -> DataFrame:
    """`form, book, idx`: which verses have each text that more than one verse has, by norm or by text without the opening. A
    verse is equal to all others of its texts; they aren't paired, as a common text has very many."""
    forms = corpus.select("book", "idx", F.explode(F.array_distinct(F.array_compact(F.array("norm", "no_bsm")))).alias("form")).where("form <> ''")
    return forms.join(equivalence_groups(corpus).select("form"), "form").select("form", "book", "idx")


def equivalent_refs(corpus: DataFrame) -> DataFrame:
    """`surah, ayah, other_surah, other_ayah` of references within one surah whose verses have equal text in some book: by
    norm, by text without the opening, or one against the other. References of a text meet in their own surah of a book
    only, so however common a text is, no more meet than a surah has verses."""
    form = F.explode(F.array_distinct(F.array_compact(F.array("norm", "no_bsm")))).alias("form")
    forms = corpus.select("book", "surah", "ayah", form).where("form <> ''")
    other = forms.withColumnRenamed("ayah", "other_ayah")
    return forms.join(other, ["book", "surah", "form"]).where("ayah <> other_ayah").select("surah", "ayah", F.col("surah").alias("other_surah"), "other_ayah").distinct()


def surah_list(corpus: DataFrame) -> DataFrame:
    """`book, surah, surah_name, place`: the surahs of a book in the order in which they first occur, from 0."""
    first = corpus.groupBy("book", "surah").agg(F.min(F.struct("idx", "surah_name")).alias("f"))
    place = F.row_number().over(Window.partitionBy("book").orderBy("f.idx")) - 1
    return first.select("book", "surah", "f.surah_name", place.alias("place"))


def equivalence_groups(corpus: DataFrame) -> DataFrame:
    """`form, verses` of every text that more than one verse has, with or without its opening: each verse counted once a
    text. One row a text: nothing is paired."""
    forms = corpus.select("book", "idx", F.explode(F.array_distinct(F.array_compact(F.array("norm", "no_bsm")))).alias("form")).where("form <> ''")
    return forms.groupBy("form").agg(F.count(F.lit(1)).alias("verses")).where("verses > 1")


def equivalence_stats(corpus: DataFrame) -> DataFrame:
    """`groups, duplicate_verses, largest` over `equivalence_groups`."""
    return equivalence_groups(corpus).agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("verses"), F.lit(0)).alias("duplicate_verses"), F.coalesce(F.max("verses"), F.lit(0)).alias("largest"))
