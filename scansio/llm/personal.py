"""Personal information inside free text: detection, placeholders and keyed surrogates.

Detection reads each text once for every kind, in the order of `KINDS`; what an earlier kind has taken is closed to the
later ones. Numbers are told apart by shape, and by the words before them where the shape isn't enough; names by a model
that learns from the texts themselves (`names`). Every item gets a surrogate of its kind, script, format and gender by
a permutation under a secret key (`surrogates`): distinct by construction, the same wherever the item stands.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scansio.llm import names as nm
from scansio.llm import surrogates as sg
from scansio.llm.names import NameModel
from scansio.operators.dedup import one_per_id
from scansio.session import cut, spread, written

KINDS = ("email", "address", "phone", "id_number", "name")

# Words before a number that make it a phone number, an id, or none of both.
PHONE_BEFORE = r"tel\.?|telephone|telefon|teléfono|téléphone|phone|mobile|móvil|cell|call(?: me(?: on| at)?)?|text|whatsapp|fax|line|msisdn|my number is|هاتف|جوال|رقمي"
ID_BEFORE = (
    r"ssn|passport(?: no\.?| number)?|national id|identity(?: card)?(?: no\.?| number)?|id card|idcard|insurance(?: number| no\.?)?|registered with|registration(?: no\.?| number)?|my id(?: is)?|pupil id|student id|tax id|id(?: no\.?| number)?|"
    r"licen[cs]e(?: no\.?| number)?|nhs(?: no\.?| number)?|رقم الهوية|الهوية|جواز(?: السفر)?|carte d'identité|passeport|ausweis(?:nummer)?|reisepass|steuer-?id|dni|nie|pasaporte|cédula"
)
NUMBER_OF_SOMETHING = r"order(?: no\.?| number)?|timestamp|build|version|checksum|session|score|page|verse|sample|clip\d*|file|minute|word"

_STREET = r"(?:street|st\.?|road|rd\.?|avenue|ave\.?|lane|ln\.?|terrace|close|court|drive|way|square|place|row|crescent|gardens)"
_TOWN = r"\p{Lu}[\p{L}'’-]+"
_POSTCODE = r"(?:\s\p{Lu}{1,2}\d{1,2}[A-Z]?\s?\d\p{Lu}{2}\b)?"

EMAIL = regex.compile(
    rf"""(?<![\p{{L}}\p{{N}}._%+-])
    [\p{{L}}\p{{N}}](?:[\p{{L}}\p{{N}}._%+-]*[\p{{L}}\p{{N}}_])?
    (?: \s?[@＠]\s? [\p{{L}}\p{{N}}](?:[\p{{L}}\p{{N}}-]*[\p{{L}}\p{{N}}])?(?:[.．][\p{{L}}\p{{N}}][\p{{L}}\p{{N}}-]*)*[.．]\p{{L}}{{2,}}
      | \s?(?:\(at\)|\[at\]|\{{at\}}|<at>)\s? [\p{{L}}\p{{N}}-]+(?:\s?(?:\.|\(dot\)|\[dot\]|\{{dot\}})\s?[\p{{L}}\p{{N}}-]+)*\s?(?:\.|\(dot\)|\[dot\]|\{{dot\}})\s?\p{{L}}{{2,}}
      | \s at \s [\p{{L}}\p{{N}}-]+(?:\sdot\s[\p{{L}}\p{{N}}-]+)*\s dot \s\p{{L}}{{2,}} )
    (?![\p{{L}}\p{{N}}])""",
    regex.X | regex.I,
)
ADDRESS = regex.compile(
    rf"""(?<![\p{{L}}\p{{N}}])(?:
      (?:(?i:flat|apartment|apt\.?|unit|suite)\s\d+[a-z]?,\s)? \d{{1,5}}[A-Za-z]?\s \p{{L}}[\p{{L}}'’-]+(?:\s\p{{L}}[\p{{L}}'’-]+)?\s (?i:{_STREET})(?![\p{{L}}])
        (?: \s(?i:apt|apartment|flat|unit)\.?\s\d+[a-z]?)? (?:,\s{_TOWN}{_POSTCODE})?
    | \d{{1,4}}(?:\s?(?:bis|ter))?,?\s (?i:rue|avenue|boulevard|place|chemin|allée|impasse|quai)\s (?:(?i:du|des|de\sla|de\sl['’]|de|le|la|les)\s?)? [\p{{L}}'’-]+(?:\s\p{{Lu}}[\p{{L}}'’-]+)* (?:,\s\d{{5}}\s{_TOWN})?
    | (?i:calle|avenida|plaza|paseo|camino)\s (?:(?i:de\sla|del|de\slos|de)\s)? \p{{L}}[\p{{L}}'’-]+(?:\s\p{{Lu}}[\p{{L}}'’-]+)*,?\s \d{{1,4}} (?:,\s\d{{1,2}}\s?[ºª°](?:\s\p{{Lu}}\b)?)? (?:,\s(?:\d{{5}}\s)?{_TOWN})?
    | \p{{L}}[\p{{L}}-]*(?:stra(?:ß|ss)e|str\.|weg|platz|allee|gasse)\s \d{{1,4}}[a-z]? (?:,\s\d{{5}}\s{_TOWN})?
    | (?i:p\.?\s?o\.?\sbox|postfach|apartado|boîte\spostale|ص\.?\s?ب\.?)\s\d{{1,6}} (?:,\s{_TOWN}{_POSTCODE})?
    | (?:شارع|طريق|حي)\s[\p{{L}}\p{{M}}]+(?:\s(?!رقم)[\p{{L}}\p{{M}}]+)?\s(?:رقم\s)?\d{{1,5}} (?:،\s[\p{{L}}\p{{M}}]+)?
    )""",
    regex.X,
)
#: Phone numbers by shape; of those in the second pattern their number of digits decides as well.
PHONE = re.compile(
    r"""(?:
      \+\d{1,3}[\s.-]?(?:\(\d{1,4}\)[\s.-]?)?\d(?:[\s.-]?\d){5,12}
    | 00[1-9]\d{0,2}(?:[\s.-]\d{2,8}){1,4}
    | [0٠۰]\d{9,10}
    | \(\d{3}\)\s?\d{3}[\s.-]?\d{4}
    | (?:1[\s.-])?\d{3}([.\s-])\d{3}\1\d{4}
    )(?:\s?(?:ext|x|extension)\.?\s?\d{1,5})?(?![^\W_]|[-:/]\d|\.\d)""",
    re.X | re.I,
)
PHONE_GROUPED = re.compile(r"[0٠۰]\d{1,4}(?:[\s./-]\d{2,8}){1,4}(?:\s?(?:ext|x|extension)\.?\s?\d{1,5})?(?![^\W_]|[-:/]\d|\.\d)", re.I)
PHONE_CUED = re.compile(r"[+(]?\d(?:[\s().-]{0,2}\d){6,13}(?![^\W_]|[-:/]\d|\.\d)")
ID_NUMBER = re.compile(
    r"""(?:
      \d{3}-\d{2}-\d{4}
    | \d{5}-\d{7}-\d
    | [A-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D]
    | \d{8}-?[A-HJ-NP-TV-Z]
    | [A-Z]{1,2}\d{7,8}[A-Z]?
    | (?P<plain>\d{9,12})
    )(?![^\W_]|[-:/.]\d)""",
    re.X,
)
_phone_before = re.compile(rf"(?:^|[^\w])(?:{PHONE_BEFORE})\s?[:#=]?\s?$", re.I)
_id_before = re.compile(rf"(?:^|[^\w])(?:{ID_BEFORE})\s?[:#=]?\s?(?:is\s)?$", re.I)
_no_number = re.compile(rf"(?:^|[^\w])(?:{NUMBER_OF_SOMETHING})\s?[:#=]?\s?$", re.I)

# What a text must hold for a pattern to be tried on it: nothing that a pattern finds is without it.
_has_at = re.compile(r"[@＠]|[(\[{<]at[)\]}>]|\sat\s.*\sdot\s", re.I | re.S)
_has_street = re.compile(rf"\b(?:{_STREET}|rue|boulevard|chemin|allée|impasse|quai|calle|avenida|plaza|paseo|camino|box|postfach|apartado|postale)(?!\w)|stra(?:ß|ss)e|str\.|weg\b|platz\b|allee\b|gasse\b|ص|شارع|طريق|حي", re.I)
#: Runs of digits, signs between them and letters at their ends, in which any phone or id number lies.
_run = re.compile(r"(?:[^\W\d_]{1,2}\s?)?[+(]?\d[\d\s().-]*")
_start = re.compile(r"(?<![\w:.#/-])(?:[^\W\d_]{1,2}\s?)?[+(]?\d|(?<![\w:.#/-])[+(]?\d")


def _numbers(text: str) -> list[tuple[str, int, int]]:
    """`kind, start, end` of phone and id numbers. Every run of at least six digits is tried from each of its starts."""
    out: list[tuple[str, int, int]] = []
    for run in _run.finditer(text):
        if sum(c.isdecimal() for c in run.group()) < 6:
            continue
        at = run.start()
        while (m := _start.search(text, at, run.end())) is not None:
            begin = m.start()
            got = _number(text, begin) or (_number(text, inner) if (inner := _digit_from(text, begin)) != begin else None)
            if got:
                out.append(got)
                at = max(got[2], begin + 1)
            else:
                at = begin + 1
    return out


_digit = re.compile(r"[+(]?\d")


def _digit_from(text: str, at: int) -> int:
    """The first sign or digit of a number from `at`, where letters may stand before it."""
    m = _digit.search(text, at)
    return m.start() if m else at


def _number(text: str, begin: int) -> tuple[str, int, int] | None:
    if begin and (text[begin - 1].isalnum() or text[begin - 1] in "_:.#/-"):
        return None
    before = text[max(0, begin - 40) : begin]
    if _no_number.search(before):
        return None
    of_id = bool(_id_before.search(before))
    m = ID_NUMBER.match(text, begin)
    if m and (of_id or not m.group("plain")):
        return "id_number", begin, m.end()
    if of_id:
        return None
    if m := PHONE.match(text, begin):
        return "phone", begin, m.end()
    if (m := PHONE_GROUPED.match(text, begin)) and 9 <= len(sg._ascii(sg._extension.sub("", m.group()))) <= 12:
        return "phone", begin, m.end()
    if _phone_before.search(before) and (m := PHONE_CUED.match(text, begin)):
        return "phone", begin, m.end()
    return None


GENERAL = NameModel()


def find(text: str | None, names: NameModel = GENERAL) -> list[tuple[str, int, int]]:
    """`kind, start, end` of the items of a text, in order; none of them overlap. Null and empty texts have none."""
    if not text:
        return []
    out: list[tuple[str, int, int]] = []

    def take(kind: str, start: int, end: int) -> None:
        if all(end <= s or start >= e for _, s, e in out):
            out.append((kind, start, end))

    if _has_at.search(text):
        for m in EMAIL.finditer(text):
            take("email", m.start(), m.end())
    if _has_street.search(text):
        for m in ADDRESS.finditer(text):
            take("address", m.start(), m.end())
    for kind, start, end in _numbers(text):
        take(kind, start, end)
    for start, end in names.find(text):
        take("name", start, end)
    return sorted(out, key=lambda x: x[1])


# --- operators ------------------------------------------------------------------------------------------------------

ITEMS = "array<struct<kind:string,start_pos:int,end_pos:int,item:string,plain:string,surrogate:string>>"


def fit(df: DataFrame, *fields: str) -> NameModel:
    """The name model of all distinct texts of the fields (`names.learnt`): what they teach is counted in each batch and
    summed by key, and only what is frequent enough for the model comes to the driver."""
    texts = spread(written(df.select(F.explode(F.array(*fields)).alias("t")).where("t <> ''").distinct()))

    def taught(of: Callable[[pd.Series], nm.Taught]) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pd.DataFrame([(*k, *[None] * (5 - len(k)), n) for k, n in of(pdf["t"]).items()], columns=list(nm.TAUGHT))

        got = texts.mapInPandas(run, "kind string, a string, b string, c string, d string, n long")
        return got.groupBy(*nm.TAUGHT[:-1]).agg(F.sum("n").alias("n"))

    def given(families: DataFrame) -> frozenset[str]:
        several = families.where("kind = 'family'").groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= nm.LEAST_FAMILIES)
        return frozenset(r.a for r in several.collect()) - common

    least = nm.least_often(texts.count())
    often = F.col("n") >= F.when(F.col("kind") == "any", least["any"]).otherwise(least["lower"])
    common = frozenset(r.a for r in taught(nm.words_taught).where(often).collect())
    general = NameModel(common)
    model = NameModel(common, given(taught(lambda t: nm.names_taught(general, t, False))))
    names = cut(taught(lambda t: nm.names_taught(model, t, True)))
    people = names.where("kind <> 'family'").groupBy("kind", "a", "b", "c").agg(F.count(F.lit(1)).alias("names"), F.sum("n").alias("hits")).where(F.col("names") >= nm.LEAST_NAMES)
    hits = {(r.kind, r.a, r.b, r.c): r.hits for r in people.collect()}
    total = {(r.kind, r.a, r.b, r.c): r.n for r in taught(lambda t: nm.places_taught(hits, t)).collect()} if hits else {}
    return NameModel(common, given(names), nm.weights(hits, total))


def entities(df: DataFrame, key: str, *fields: str, secret: bytes, names: NameModel | None = None) -> DataFrame:
    """`key, field, kind, start_pos, end_pos, item, plain, surrogate` of every item: one pass over the texts, one record per
    key. Without `names` a model is fitted to the texts (`fit`).

    Positions are code points from 0. `plain` is the same for two ways of writing an item, and so is the plain form of
    their surrogates. Null and empty texts have no items; rows with a null key are no records.
    """
    if not secret:
        raise ValueError("surrogates need a key")
    model = names if names is not None else fit(df, *fields)
    shared = df.sparkSession.sparkContext.broadcast(model)  # grows with frequent words and names, not with texts

    @F.pandas_udf(ITEMS)
    def found(texts: pd.Series) -> pd.Series:
        names, by = shared.value, sg.keyed(secret)
        return texts.map(lambda t: [(k, a, b, t[a:b], sg.plain(k, t[a:b]), by.of(k, t[a:b])) for k, a, b in find(t, names)])

    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_f{i}").alias("items")) for i, f in enumerate(fields)])
    read = one_per_id(df, key, *fields).select(key, *[found(f).alias(f"_f{i}") for i, f in enumerate(fields)])
    by_field = read.select(key, F.explode(each).alias("x"))
    return by_field.select(key, "x.field", F.explode("x.items").alias("i")).select(key, "field", "i.*")


def distinctness(found: DataFrame) -> DataFrame:
    """`kind, items, plains, surrogates` of `entities`: occurrences, and how many there are of different plain forms and of
    different plain forms of surrogates. A kind of which the two differ would have lost an item in another."""

    @F.pandas_udf(T.StringType())
    def plain_of(kind: pd.Series, made: pd.Series) -> pd.Series:
        return pd.Series([sg.plain(k, m) for k, m in zip(kind, made)])

    # One row a plain form first: repeated items meet in each task.
    own = found.groupBy("kind", "plain").agg(F.count(F.lit(1)).alias("n"), F.min("surrogate").alias("s"))
    pairs = own.select("kind", "n", "plain", plain_of("kind", "s").alias("other"))
    return pairs.groupBy("kind").agg(F.sum("n").alias("items"), F.count(F.lit(1)).alias("plains"), F.countDistinct("other").alias("surrogates"))


@F.pandas_udf(T.StructType([T.StructField("placeholders", T.StringType()), T.StructField("surrogates", T.StringType())]))
def _spliced(texts: pd.Series, items: pd.Series) -> pd.DataFrame:
    out = []
    for text, parts in zip(texts, items):
        marked = made = text
        if text is not None and parts is not None:
            for p in sorted(parts, key=lambda p: -p["start_pos"]):
                a, b = p["start_pos"], p["end_pos"]
                marked, made = f"{marked[:a]}[{p['kind'].upper()}]{marked[b:]}", made[:a] + p["surrogate"] + made[b:]
        out.append((marked, made))
    return pd.DataFrame(out, columns=["placeholders", "surrogates"])


def redacted(df: DataFrame, key: str, *fields: str, secret: bytes, names: NameModel | None = None) -> DataFrame:
    """`key, field, placeholders, surrogates`: every text of every record with its items replaced by a placeholder of
    their kind, and by their surrogates; all else stays as it is. Null texts stay null."""
    items = entities(df, key, *fields, secret=secret, names=names).groupBy(key, "field").agg(F.collect_list(F.struct("kind", "start_pos", "end_pos", "surrogate")).alias("_p"))
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])
    texts = one_per_id(df, key, *fields).select(key, F.explode(each).alias("x")).select(key, "x.*")
    return texts.join(items, [key, "field"], "left").select(key, "field", _spliced("text", "_p").alias("r")).select(key, "field", "r.*")
