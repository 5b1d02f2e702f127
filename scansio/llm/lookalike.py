"""One form for texts that read the same but are stored in different characters.

Values are mapped first: width and positional forms to their letters, kinds of space to a space, invisible characters to
nothing, look-alike letters to the letter whose place they take, marks in canonical order. The mapped forms are grouped
in SQL under the accent-sensitive Unicode collation, which decides what is the same letter with the same accents:
composed or split, and whatever else it holds to be equal. Each class gets its least member as canonical form, and that
is joined back to every record.

The collation gives no weight to pause marks and some other characters that do change the reading. Which ones they are
is asked of the collation itself (`weightless`); a value's sequence of them, each with its place among the letters,
stands beside the collation in the grouping. It holds nothing that the collation weighs.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scansio.session import written

# Letters that look alike, each with the letter it stands for in Latin text (Cyrillic, then Greek).
LATIN_LOOKALIKES = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y",
    "ο": "o", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
}
# Arabic letters that look like another one where a letter follows, and where none does.
BEFORE_LETTER = {"ی": "ي", "ک": "ك"}
AT_END = {"ی": "ى", "ە": "ه"}
# Format characters that are seen, unlike all others of their category.
SEEN_FORMAT = "؀؁؂؃؄؅۝܏࢐࢑࣢"
# Other characters that leave no trace of their own (joiner, variation selectors' first and last).
UNSEEN = {0x034F, *range(0x180B, 0x180F), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
#: The collation under which mapped forms are grouped: accents and case count.
COLLATION = "UNICODE"
#: Records of one side of a class that are paired in one task.
PAIR_ROWS = 2000
#: Kinds of compatibility forms that are one letter's shapes or widths.
FORMS = ("<wide>", "<narrow>", "<initial>", "<medial>", "<final>", "<isolated>")


@cache
def character_map() -> dict[int, str]:
    """What every width form, positional form, space and invisible character becomes."""
    out: dict[int, str] = dict.fromkeys(UNSEEN, "")
    for c in range(0x80, sys.maxunicode + 1):
        ch = chr(c)
        kind = unicodedata.category(ch)
        if kind == "Cf" and ch not in SEEN_FORMAT:
            out[c] = ""
        elif kind in ("Zs", "Zl", "Zp"):
            out[c] = " "
        elif (forms := unicodedata.decomposition(ch)).startswith(FORMS):
            plain = unicodedata.normalize("NFKC", ch)
            if not forms.split(" ", 1)[1].startswith("0020"):
                out[c] = plain
    return out


_spaces = re.compile(r"\s+")
_foreign = re.compile("[" + "".join(LATIN_LOOKALIKES) + "]")
_other_script = re.compile(r"[Ͱ-ϿЀ-ԯ]")
_placed = re.compile("[" + "".join(dict.fromkeys([*BEFORE_LETTER, *AT_END])) + "]")
_latin = str.maketrans(LATIN_LOOKALIKES)


def _placed_letter(m: re.Match) -> str:
    text, at = m.string, m.end()
    while at < len(text) and unicodedata.combining(text[at]):
        at += 1
    follows = at < len(text) and unicodedata.category(text[at]) == "Lo"
    return (BEFORE_LETTER if follows else AT_END).get(m.group(), m.group())


def _latin_words(text: str) -> str:
    own = any(c not in LATIN_LOOKALIKES for c in _other_script.findall(text))  # the text is in that script itself

    def word(m: re.Match) -> str:
        w = m.group()
        if not _foreign.search(w) or any(c not in LATIN_LOOKALIKES for c in _other_script.findall(w)):
            return w
        mixed = any("LATIN" in unicodedata.name(c, "") for c in w)
        return w.translate(_latin) if mixed or not own else w

    return re.sub(r"[^\W\d_]+", word, text)


@cache
def _in_map() -> re.Pattern:
    """Any character of the map, or any beyond the first plane, which would make a slow pattern one by one."""
    return re.compile("[" + "".join(re.escape(chr(c)) for c in sorted(character_map()) if c < 0x10000) + "\U00010000-\U0010ffff]")


def _by_character(text: str) -> str:
    return text.translate(character_map()) if not text.isascii() and _in_map().search(text) else text


def mapped(text: str | None) -> str | None:
    """The look-alike-mapped form of a text, composed or split as it was as long as its marks stand in canonical order;
    null stays null."""
    if text is None:
        return None
    text = _by_character(text)
    split = unicodedata.is_normalized("NFD", text)
    if not split:
        text = unicodedata.normalize("NFC", text)
    if _foreign.search(text) or _placed.search(text):
        whole = unicodedata.normalize("NFC", text)
        if _foreign.search(whole):
            whole = unicodedata.normalize("NFC", _latin_words(whole))
        text = _placed.sub(_placed_letter, whole)
        if split:
            text = unicodedata.normalize("NFD", text)
    return _spaces.sub(" ", text).strip()


def alike(text: str) -> str:
    """A text with its width and positional forms, spaces, invisible characters and look-alike letters mapped, composed, with
    its spaces and line ends as they are."""
    text = unicodedata.normalize("NFC", _by_character(text))
    if _foreign.search(text):
        text = unicodedata.normalize("NFC", _latin_words(text))
    return _placed.sub(_placed_letter, text)


_weightless: dict[str, tuple[str, str]] = {}


def weightless(spark: SparkSession) -> tuple[str, str]:
    """The characters to which the collation gives no weight: those that are seen, and those that aren't."""
    app = spark.sparkContext.applicationId
    if app not in _weightless:
        every = "decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')"
        found = spark.sql(f"SELECT id FROM range({sys.maxunicode + 1}) WHERE collate(concat('a', {every}), '{COLLATION}') = collate('a', '{COLLATION}')")
        chars = [chr(r.id) for r in found.orderBy("id").collect()]  # a thousand characters, whatever the data
        seen = [c for c in chars if ord(c) not in UNSEEN and (unicodedata.category(c) not in ("Cf", "Cc", "Cn") or c in SEEN_FORMAT)]
        _weightless[app] = "".join(seen), "".join(c for c in chars if c not in seen)
    return _weightless[app]


class Marks:
    """The sequence of seen characters without weight in a text, each with the number of letters and signs before it."""

    def __init__(self, seen: str, unseen: str):
        own = lambda chars: "".join(map(re.escape, chars))
        weighed = "".join(c for c in map(chr, range(0x300, sys.maxunicode + 1)) if unicodedata.combining(c) and c not in seen)
        self.any = re.compile(f"[{own(seen)}]")
        self.parts = re.compile(f"([{own(seen)}])")
        self.passed = re.compile(f"[{own(unseen)}{own(weighed)}]+")

    def __call__(self, text: str) -> str:
        if not self.any.search(text):
            return ""
        pieces = self.parts.split(unicodedata.normalize("NFD", text))
        out, at = [], 0
        for i in range(0, len(pieces) - 1, 2):
            at += len(self.passed.sub("", pieces[i]))
            out.append(f"{at}{pieces[i + 1]}")
        return "".join(out)


_marks: dict[tuple[str, str], Marks] = {}


def _marks_of(chars: tuple[str, str]) -> Marks:
    if chars not in _marks:
        _marks[chars] = Marks(*chars)
    return _marks[chars]


def mapped_column(chars: tuple[str, str]):
    """A column function to `mapped` and `marks` of a text."""

    @F.pandas_udf("mapped string, marks string")
    def of(values: pd.Series) -> pd.DataFrame:
        marks, forms = _marks_of(chars), [mapped(v) for v in values]
        return pd.DataFrame({"mapped": forms, "marks": [None if f is None else marks(f) for f in forms]})

    return of


def _key(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def field_values(df: DataFrame, key: str, *fields: str) -> DataFrame:
    """`field, key, stored, mapped, marks` of every value that is not null and not empty (redelivered rows included)."""
    of = mapped_column(weightless(df.sparkSession))
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("stored"), F.col(f"_m{i}").alias("m")) for i, f in enumerate(fields)])
    read = df.where(F.col(key).isNotNull()).select(key, *fields, *[of(f).alias(f"_m{i}") for i, f in enumerate(fields)])
    return read.select(F.col(key), F.explode(each).alias("v")).where(F.col("v.stored") != "").select("v.field", key, "v.stored", "v.m.mapped", "v.m.marks")


def classes(values: DataFrame) -> DataFrame:
    """`field, form, canonical` of every distinct mapped form (`form` is its hash), grouped in SQL.

    Binary equal forms are combined before anything is compared under the collation. The canonical member of a class is
    its least form by code points.
    """
    return values.sparkSession.sql(
        f"""
        SELECT field, unhex(sha2(mapped, 256)) AS form, min(mapped) OVER (PARTITION BY field, marks, collate(mapped, '{COLLATION}')) AS canonical
        FROM (SELECT DISTINCT field, mapped, marks FROM {{values}})
        """,
        values=values.select("field", "mapped", "marks"),
    )


def canonical(df: DataFrame, key: str, *fields: str) -> DataFrame:
    """`field, key, stored, canonical` of every record and field: one row per key and field, redelivered rows counted
    once. A null or empty value is its own canonical form."""
    values = written(field_values(df, key, *fields).withColumn("form", _key(F.col("mapped"))))
    rows = values.select("field", key, "stored", "form").dropDuplicates(["field", key])
    joined = rows.join(classes(values), ["field", "form"]).select("field", key, "stored", "canonical")
    for f in fields:
        blank = df.where(F.col(key).isNotNull() & (F.col(f).isNull() | (F.col(f) == ""))).select(F.lit(f).alias("field"), key, F.col(f).alias("stored"), F.col(f).alias("canonical"))
        joined = joined.unionByName(blank.dropDuplicates([key]))
    return joined


def _read_alike(df: DataFrame, key: str, *fields: str) -> DataFrame:
    """`field, form, key, s1, s2, reading, canonical, size` of the records of classes whose stored values aren't all the same
    code points: hashes of what is stored, the class, and how many records it has. Records and classes are both read from a
    table of values that is written once, as mapping them is most of the work."""
    hashes = {"form": _key(F.col("mapped")), "s1": F.xxhash64("stored"), "s2": F.xxhash64(F.lit("scansio"), F.col("stored"))}
    values = written(field_values(df, key, *fields).withColumns(hashes).drop("stored"))
    rows = values.groupBy("field", key).agg(F.max(F.struct("form", "s1", "s2")).alias("r")).select("field", key, "r.*")
    rows = rows.where(F.col("form") != _key(F.lit("")))
    mixed = rows.groupBy("field", "form").agg(F.min("s1").alias("a1"), F.max("s1").alias("b1"), F.min("s2").alias("a2"), F.max("s2").alias("b2"), F.count(F.lit(1)).alias("n"))
    # One row a form, where its records are counted: texts are shuffled once more only, to meet under the collation.
    forms = values.groupBy("field", "form").agg(F.first("mapped").alias("mapped"), F.first("marks").alias("marks")).join(mixed, ["field", "form"], "left")
    # Exact copies of one value are no case, and most forms have one value only.
    of_class = values.sparkSession.sql(
        f"""
        SELECT field, form, n, canonical, size FROM (
            SELECT field, form, n, min(mapped) OVER w AS canonical, sum(n) OVER w AS size, min(a1) OVER w <> max(b1) OVER w OR min(a2) OVER w <> max(b2) OVER w AS several
            FROM {{forms}} WINDOW w AS (PARTITION BY field, marks, collate(mapped, '{COLLATION}')))
        WHERE several AND n IS NOT NULL
        """,
        forms=forms,
    )
    return rows.join(of_class.withColumn("reading", _key(F.col("canonical"))).drop("n"), ["field", "form"])


def same_reading_pairs(df: DataFrame, key: str, *fields: str) -> DataFrame:
    """`field, a, b` (a < b): pairs of records whose values of a field have one canonical form but differ in code points.

    Only hashes of values are shuffled with the records. Classes of which all records hold the same code points are left
    out before records are paired. The pairs are what is asked for; those of a class of many records are the work of many
    tasks: its one side is spread by hash, the other goes to each of the parts.
    """
    parts = F.ceil(F.col("size") / F.lit(PAIR_ROWS)).cast("int")
    members = _read_alike(df, key, *fields).select("field", "reading", key, "s1", "s2", parts.alias("parts"))
    a = members.withColumn("part", F.pmod(F.xxhash64(key), F.col("parts")).cast("int")).alias("a")
    b = members.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("b")
    same = F.lit(True)
    for name in ("field", "reading", "part"):
        same = same & (F.col(f"a.{name}") == F.col(f"b.{name}"))
    differ = (F.col("a.s1") != F.col("b.s1")) | (F.col("a.s2") != F.col("b.s2"))
    return a.join(b, same & (F.col(f"a.{key}") < F.col(f"b.{key}")) & differ).select(F.col("a.field").alias("field"), F.col(f"a.{key}").alias("a"), F.col(f"b.{key}").alias("b"))


def reading_classes(df: DataFrame, key: str, *fields: str) -> DataFrame:
    """`field, canonical, records, spellings, links` of every class of values that read the same in different code points:
    `links` is the number of its pairs, without any pair being made."""
    spelled = _read_alike(df, key, *fields).groupBy("field", "reading", "s1", "s2").agg(F.count(F.lit(1)).alias("n"), F.first("canonical").alias("c"))
    counted = spelled.groupBy("field", "reading").agg(F.first("c").alias("canonical"), F.sum("n").alias("records"), F.count(F.lit(1)).alias("spellings"), F.sum(F.col("n") * F.col("n")).alias("_own"))
    return counted.select("field", "canonical", "records", "spellings", ((F.col("records") * F.col("records") - F.col("_own")) / 2).cast("long").alias("links"))
