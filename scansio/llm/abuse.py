"""Abusive, hateful or sexual content by compression distance.

Two separate zstandard dictionaries are made of windows of reviewed documents: one of ordinary text, one of abusive text.
A window of a document is compressed with either; what the abusive dictionary saves over the ordinary one, a byte of the
window, is its score, and a document's score is that of its worst window. Ordinary sentences are shorter with the
ordinary dictionary; new words, names and verses are long with either; what writes as abusive documents do is shorter
with the abusive one. The threshold is calibrated on documents that the dictionaries of the other folds haven't seen.

Windows are read as a reader would: look-alike letters, signs and spaces within words, digits for letters and stretched
letters are undone. Quoted text isn't the writer's own and is masked. Training looks at no more than `max_docs` reviewed
documents a class, picked by hash; scoring reads every window of every document. All rules are the same at every size.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field
from statistics import median

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scansio.functions.text import UNITED, VARIANTS
from scansio.llm.lookalike import alike

#: Verdicts of reviewers that say a document is a case, and that it is none; others say nothing.
CASES, FINE = ("abuse", "hate", "sexual"), ("ok",)
#: Bounds of the sample that the dictionaries are made of: documents a class, and code points of one.
MAX_DOCS, MAX_CHARS = 6000, 20_000
#: Most bytes of a dictionary: content beyond is trained down to this. Both are sent to every executor.
ORDINARY_BYTES, ABUSIVE_BYTES = 4_000_000, 500_000
#: Threshold where the sample holds no case to set it by.
DEFAULT_THRESHOLD = 0.2
#: Savings below which no window is flagged: lengths are whole bytes.
LEAST_THRESHOLD = 0.1
#: Letters of a window at least; code points from which a window is read in parts, and of a part.
LEAST_LETTERS, LONG, PART = 8, 50, 40
#: Bytes beyond which a window's savings are not spread any thinner.
SHORT = 64
LEVEL = 15
FOLDS = 3
#: Share of a window's bytes from which text doesn't explain it, by which other text explains it far better, and from
#: which abusive text hardly explains it.
UNEXPLAINED, FAR_BETTER, CLEARLY = 0.4, 0.25, 0.8
#: Words tell cases if at most this share of words like them would by chance.
BY_CHANCE = 0.2

_quoted = re.compile(r"“[^“”\r\n]+”|«[^«»\r\n]+»|„[^„“”\r\n]+[“”]|\"[^\"\r\n]+\"")
_sentence = re.compile(r"(?<=[.!?؟;])\s+|[\r\n]+|\s{2,}")
_spaced = re.compile(r"(?<!\w)(?:[^\W\d_] ){2,}[^\W\d_](?!\w)")
_mixed = re.compile(r"(?<![\w@$])[^\W\d]*[\d@$][\w@$]*")
_inside = re.compile(r"(?<=[^\W\d_])[.·•_\-*]+(?=[^\W\d_])")
_stretched = re.compile(r"([^\W\d_])\1+")
_number = re.compile(r"\d+")
_word = re.compile(r"[^\W\d_]{2,}")
_variant = re.compile(f"[{VARIANTS}ـ]")
_accents = re.compile("[" + "".join(c for c in map(chr, range(0x300, 0x10000)) if unicodedata.combining(c)) + "]+")
# Signs that stand for letters within words, and the letters.
SIGNS, SIGNED = "0134578@$", "oieastbas"
_signs = str.maketrans(SIGNS, SIGNED)
_arabic = str.maketrans(VARIANTS, UNITED, "ـ")


def plain(text: str) -> str:
    """A text as a reader would read it, line ends as they are."""
    text = text.lower()
    if not text.isascii():
        text = _accents.sub("", unicodedata.normalize("NFD", alike(text).lower()))
        if _variant.search(text):
            text = text.translate(_arabic)
    text = _spaced.sub(lambda m: m.group().replace(" ", ""), text)
    text = _mixed.sub(lambda m: t.translate(_signs) if any(map(str.isalpha, t := m.group())) else t, text)
    return _stretched.sub(r"\1", _inside.sub("", _number.sub("0", text)))


def windows(text: str | None) -> list[str]:
    """The distinct windows of a text: its sentences and lines, and the overlapping parts of long ones. What has but a few
    letters is read together with what follows, at the end with what stands before; a text of nothing else is a window."""
    out: dict[str, None] = {}
    whole: list[str] = []
    begun = ""
    for sentence in _sentence.split(plain(_quoted.sub("“”", text or ""))):
        begun = f"{begun} {' '.join(sentence.split())}".strip()
        if sum(map(str.isalpha, begun)) >= LEAST_LETTERS:
            whole.append(begun)
            begun = ""
    if begun and whole:
        whole[-1] += " " + begun
    elif any(map(str.isalpha, begun)):
        whole.append(begun)
    for w in whole:
        for p in [w] if len(w) <= LONG else [w[i : i + PART] for i in range(0, len(w) - PART // 2, PART // 2)]:
            out[p] = None
    return list(out)


def dictionary(texts: Iterable[str], most: int) -> bytes:
    """Content of a dictionary of at most about `most` bytes: the texts, or what zstandard's training keeps of them."""
    texts = list(texts)
    content = "\n".join(texts).encode()
    return content if len(content) <= most else zstandard.train_dictionary(most, [t.encode() for t in texts], level=LEVEL).as_bytes()


class Measure:
    """Compressed length of windows with a dictionary."""

    def __init__(self, content: bytes):
        made = zstandard.ZstdCompressionDict(content) if len(content) >= 8 else None  # trained, or else raw content
        params = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.compress = zstandard.ZstdCompressor(dict_data=made, compression_params=params).compress

    def __call__(self, window: str) -> int:
        return len(self.compress(window.encode()))


def _share(window: str, length: float) -> float:
    return length / (len(window.encode()) + 8)


@dataclass
class Model:
    ordinary: bytes
    abusive: bytes
    threshold: float = DEFAULT_THRESHOLD
    _known: dict[str, float] = field(default_factory=dict, repr=False)
    _measures: tuple[Measure, Measure] | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return {"ordinary": self.ordinary, "abusive": self.abusive, "threshold": self.threshold, "_known": {}, "_measures": None}

    def window(self, w: str) -> float:
        got = self._known.get(w)
        if got is None:
            if self._measures is None:
                self._measures = Measure(self.ordinary), Measure(self.abusive)
            if len(self._known) > 200_000:
                self._known.clear()
            a, b = self._measures
            got = self._known[w] = (a(w) - b(w)) / (min(len(w.encode()), SHORT) + 8)
        return got

    def worst(self, some: list[str]) -> float:
        return max([0.0, *map(self.window, some)]) if self.abusive else 0.0

    def score(self, text: str | None) -> float:
        """0 for texts without windows, such as null and empty ones."""
        return self.worst(windows(text))


def telling(cases: list[list[str]], fine: list[list[str]]) -> set[str]:
    """Words that more cases than fine documents hold, and that so many cases hold as words by chance would not: of words
    with as many documents, so many would stand in cases only by their share of all documents."""
    in_cases, in_fine = (Counter(x for d in docs for x in {x for w in d for x in _word.findall(w)}) for docs in (cases, fine))
    share = len(cases) / max(1, len(cases) + len(fine))
    held = Counter(in_cases[x] + in_fine[x] for x in {*in_cases, *in_fine})
    alone = Counter(n for x, n in in_cases.items() if not in_fine[x])
    enough = min((n for n in alone if n > 1 and held[n] * share**n <= BY_CHANCE * alone[n]), default=None)

    def tells(x: str, n: int) -> bool:
        expected = (n + in_fine[x]) * share
        return n >= enough and n > in_fine[x] and (not in_fine[x] or n > expected + 2 * expected**0.5)

    return set() if enough is None else {x for x, n in in_cases.items() if tells(x, n)}


def _trained(fine: list[list[str]], cases: list[list[str]]) -> tuple[bytes, bytes]:
    """The ordinary and the abusive dictionary, of the windows of documents judged fine and of cases.

    Reviewers err, and most windows of a case are ordinary. A window is abusive if ordinary text doesn't explain it, it has
    a telling word, and no fine document holds it or several cases and hardly any fine document do; rare verses that
    happen to stand in cases have no telling word. Ordinary text is what fine documents hold, without what abusive
    windows explain far better than the fine documents of the other folds: that are cases which a reviewer passed.
    """
    held, passed = Counter(w for d in cases for w in d), Counter(w for d in fine for w in d)
    known = {w for w, n in held.items() if n >= 2 and n > 3 * passed[w]}
    folds = [list(dict.fromkeys(w for d in fine[k::FOLDS] for w in d if w not in known)) for k in range(FOLDS)]
    ordinary = [Measure(dictionary(f, ORDINARY_BYTES)) for f in folds]
    words = telling(cases, fine)
    asked = [w for w in held if (w in known or not passed[w]) and any(x in words for x in _word.findall(w))]
    seeds = [w for w in asked if _share(w, median(m(w) for m in ordinary)) > UNEXPLAINED]
    content = dictionary(seeds, ABUSIVE_BYTES)
    abusive = Measure(content)
    clean: dict[str, None] = {}
    for k, f in enumerate(folds):
        rest = [m for j, m in enumerate(ordinary) if j != k]
        for w in f:
            if not seeds or abusive(w) >= len(w.encode()) * CLEARLY:
                clean[w] = None
                continue
            best = min(m(w) for m in rest)
            if not (_share(w, best) > UNEXPLAINED and _share(w, best - abusive(w)) > FAR_BETTER):
                clean[w] = None
    return dictionary(clean, ORDINARY_BYTES), content


def _best_threshold(scored: list[tuple[float, bool]]) -> float:
    """The score from which on flagging agrees best with the reviewers (F1): the middle one of those thresholds that come
    within a hundredth of the best, as reviewers' slips decide between them."""
    cases = sum(c for _, c in scored)
    ordered, hits, found = sorted(scored, reverse=True), 0, []
    for n, (score, case) in enumerate(ordered, 1):
        hits += case
        below = ordered[n][0] if n < len(ordered) else 0.0
        if score > below:
            found.append((2 * hits / (n + cases), (score + below) / 2))
    best = max(found)[0] if found else 0.0
    return max(median([t for f, t in found if f >= 0.99 * best] or [DEFAULT_THRESHOLD]), LEAST_THRESHOLD)


def train(labelled: list[tuple[str, bool]]) -> Model:
    """A model of texts and whether each is a case. Each fold of them, in their order, is scored by the dictionaries of the
    others; that sets the threshold. Then the dictionaries are made of all. Without a case there is nothing to know one
    by, and every score is 0."""
    docs = [(windows(t), case) for t, case in labelled]
    pick = lambda some, case: [w for w, c in some if c == case]
    judged: list[tuple[float, bool]] = []
    for k in range(FOLDS):
        kept = [d for i, d in enumerate(docs) if i % FOLDS != k]
        judge = Model(*_trained(pick(kept, False), pick(kept, True)))
        judged += [(judge.worst(w), c) for w, c in docs[k::FOLDS]]
    return Model(*_trained(pick(docs, False), pick(docs, True)), _best_threshold(judged))


def verdicts(reviews: DataFrame) -> DataFrame:
    """`doc_id, case` of the documents on which more reviews agree than disagree, in any spelling of case."""
    v = F.lower(F.trim("verdict"))
    counted = reviews.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count_if(v.isin(*CASES)).alias("a"), F.count_if(v.isin(*FINE)).alias("b"))
    return counted.where(F.col("a") != F.col("b")).select("doc_id", (F.col("a") > F.col("b")).alias("case"))


def fit(docs: DataFrame, reviews: DataFrame, max_docs: int = MAX_DOCS) -> Model:
    """A model of at most `max_docs` reviewed documents of either class, of at most MAX_CHARS each. Of documents with
    one text only one counts."""
    texts = docs.where(F.length("text").between(1, MAX_CHARS)).select("doc_id", "text")
    labelled = texts.join(verdicts(reviews), "doc_id").groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.avg(F.col("case").cast("int")).alias("a")).where("a <> 0.5")
    labelled = labelled.select("text", (F.col("a") > 0.5).alias("case"), F.xxhash64("doc_id").alias("h"))
    sample = [r for case in (False, True) for r in labelled.where(F.col("case") == case).orderBy("h", "text").limit(max_docs).collect()]
    return train([(r["text"], r["case"]) for r in sorted(sample, key=lambda r: (r["h"], r["text"]))])


def scored(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """`doc_id, *keep, score, flagged` of every document; a null or empty text has score 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most ORDINARY_BYTES and ABUSIVE_BYTES

    @F.pandas_udf(T.DoubleType())
    def of(texts: pd.Series) -> pd.Series:
        m = shared.value
        return texts.map(m.score)

    return docs.select("doc_id", *keep, of("text").alias("score")).withColumn("flagged", F.col("score") >= model.threshold)


def rates(judged: DataFrame) -> DataFrame:
    """`source, documents, flagged, rate` of a scored table with `source`; a null source is one of its own."""
    return judged.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count_if("flagged").alias("flagged"), F.avg(F.col("flagged").cast("int")).alias("rate"))
