"""Names of persons in free text, by their shape, general cues and contexts learnt from the texts themselves.

A candidate is a run of words that could be a given name or initial and a family name, in either order and any case or
script. It is judged by a sum of weights: how it is written, whether words that introduce a person lead up to it, whether
a part is known as a given name, and how often what stands before and after it in the texts goes with names. The last
two are learnt: candidates that are certain without them tell which contexts and given names go with persons, and these
tell further candidates. Words that texts use all the time are no part of a name.

Learning counts over all texts; a model without it knows the general cues only. A model holds what is found often or of
several persons, so it grows far less than the texts.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Container, Iterable
from dataclasses import dataclass, field
from math import log

# Some given names of many languages, by gender, of which surrogates are drawn as well.
GIVEN = {
    "f": "Aisha Amina Ana Anna Camila Chloe Elena Elif Emma Fatima Greta Hana Ines Ingrid Julia Khadija Laura Leila Lena Lucia Maria Mariam Maya Mei Nadia Noor Olga Priya Salma Sara Sofia Yasmin Zahra Zainab",
    "m": "Adam Ahmed Ali Bilal Carlos Daniel David Hans Hassan Ibrahim Idris Ivan James Jonas José Karim Khalid Kofi Luis Marco Mohammed Musa Omar Paul Pavel Pedro Rajesh Tariq Thomas Umar Wei Yusuf Zaid",
}
GIVEN_ARABIC = {
    "f": "أمينة آمنة خديجة زينب سارة سلمى عائشة فاطمة ليلى مايا مريم نادية نور هناء هنا ياسمين",
    "m": "آدم أحمد إبراهيم إدريس بلال حسن خالد زيد طارق علي عمر كريم محمد موسى ياسين يوسف",
}
# Words that introduce a person, those that nearly always do, and those that often do.
STRONG = (
    r"my (?:full )?name(?: is|'s|:)|(?:the )?name(?: is)?:|names? (?:of|is)|mi nombre es|me llamo|mein name ist|ich hei(?:ß|ss)e|je m['’]appelle|mon nom est|mi chiamo|meu nome é|اسمي(?: هو)?|الاسم:?|"
    r"signed(?: by)?[,:]?|sincerely,?|(?:kind |best |warm )?regards,?|(?:viele |liebe )?grüße,?|saludos,?|cordialement,?|mr\.?|mrs\.?|ms\.?|dr\.?|prof\.?|herrn?|frau|madame|monsieur|señora?|sheikh|imam|ustadh|السيدة?|الشيخ|الأستاذة?|الدكتورة?"
)
WEAK = (
    r"i am|i['’]m|this is|here is|it['’]s|je suis|soy|ich bin|sono|أنا|هذا|هذه|contact(?: person)?|ask(?:ed)? for|spoke (?:to|with)|call(?:ed)?|thanks to|by|from|reciter|reader|teacher|student|pupil|parent|owner|user|username|author|"
    r"lehrer(?:in)?|schüler(?:in)?|enseignante?|élève|profesora?|alumn[oa]|القارئ|القارئة|الطالب|الطالبة|المعلم|المعلمة"
)
OWNED = r"(?:['’]s)?\s(?:iphone|ipad|macbook|galaxy|pixel|phone|tablet|laptop)\b"
# Words that are written with a capital, or stand beside names, without being a part of one.
NOT_A_NAME = frozenset(
    "a about after again all already also always am an and any app are as at be been before but by can could day did do does done email every for from full further had has have he hello her here hi him his how i if in is it its just last less like line lost me mine more most much my name names new next no none not now of off often ok old on once one only or other our out over page per please quite same says see she shown so some soon still than thank thanks that the their them then there these they this those to too under until up us user very was we were what when where which while who whose why will wish with without wrong yes yet you your "
    "der die das den dem des ein eine einen einem und oder ist sind war nicht kein keine ich du er sie es wir ihr mein meine dein sein auf aus bei bin bis für im in mit nach siehe von vor zu zum zur "
    "le la les un une des du de et ou est sont était ne pas je tu il elle nous vous mon ma mes ce cette dans avec pour sur sous "
    "el los las una unos y o es son era no yo tú él ella nosotros mi mis su sus este esta en con por para sin "
    "في من على إلى عن هذا هذه هو هي أن لا ما مع كان التطبيق الآية السورة الصفحة "
    "street st road rd avenue ave lane ln drive court square terrace close crescent gardens way place box flat apartment unit suite rue boulevard calle avenida plaza paseo camino straße strasse weg platz allee gasse "
    "mr mrs ms dr prof sir madam sheikh imam ustadh herr frau madame monsieur señor señora signed regards sincerely contact order version build session score sample timestamp device owner lang site kiosk reciter reader teacher student pupil parent author dear call ask "
    "android apple chrome edge firefox gecko google intel ios ipad ipados iphone khtml linux mac macbook macintosh microsoft mobile mozilla nt opera os phone play safari samsung store tablet watch webkit win windows x "
    "monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december ramadan quran koran surah sura ayah islam allah eid hadith tajweed "
    "new york london paris berlin madrid cairo makkah mecca madinah medina saudi arabia united kingdom states north south east west street".split()
)
#: Scores: that a candidate must reach, and from which it teaches; least number of names that make a context or a given name.
ENOUGH, CERTAIN, LEAST_NAMES, LEAST_FAMILIES = 2.0, 3.0, 3, 2
#: A word is common if more than this share of texts hold it, or hold it in lower case; at least so many texts.
COMMON, COMMON_LOWER, LEAST_TEXTS = 0.02, 0.004, 3
#: Weight of a learnt context at most.
MOST = 3.0

_MARKS = "̀-ͯؐ-ًؚ-ٰٟ"
_word = re.compile(rf"[^\W\d_][\w{_MARKS}'’-]*")
_strong = re.compile(rf"(?:^|[^\w])(?:{STRONG})[\s(\"'“=/]*$", re.I)
_weak = re.compile(rf"(?:^|[^\w])(?:(?:{WEAK})(?:[\s:(\"'“=/]+)|(?:on|in|of) the \w+:\s)$|(?:^|[\n.!?;/]|\s\s)\s*[-–—]\s*$", re.I)
_owned = re.compile(OWNED, re.I)
_surah = re.compile(r"(?:surahs?|suras?|sourate|sure|سورة)\s$", re.I)
_ends = re.compile(r"[.!?؟;\n\r/|]|\s\s")

STOP, IS_GIVEN, TITLE, CAPS, LOWER, CASELESS, INITIAL, BAD = (1 << i for i in range(8))

GENDER = {n.casefold(): g for table in (GIVEN, GIVEN_ARABIC) for g, names in table.items() for n in names.split()}


def _written(word: str) -> int:
    letters = word.replace("-", "").replace("'", "").replace("’", "")
    if len(word) == 1:
        return INITIAL if word.isupper() or not word.islower() else BAD
    if not letters or any(c.isdigit() or c == "_" for c in letters):
        return BAD
    if letters.islower():
        return LOWER
    if letters.isupper():
        return CAPS
    if not any(c.isupper() or c.islower() for c in letters):
        return CASELESS
    return TITLE if letters[0].isupper() and letters[1:2].islower() or word[1:2] in "'’" else BAD


#: By how both words are written: the weight of a given and a family name in either order.
_SHAPES = {(TITLE, TITLE): 2.0, (CAPS, CAPS): 0.5, (CAPS, TITLE): 1.5, (TITLE, CAPS): 1.5, (LOWER, LOWER): -0.5, (CASELESS, CASELESS): 0.0}
_WRITTEN = TITLE | CAPS | LOWER | CASELESS


@dataclass
class NameModel:
    """What was learnt: words of no name, given names, and weights of contexts (side, and the words there)."""

    common: frozenset[str] = frozenset()
    given: frozenset[str] = frozenset()
    contexts: dict[tuple, float] = field(default_factory=dict)
    _flags: dict[str, int] = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return {"common": self.common, "given": self.given, "contexts": self.contexts, "_flags": {}}

    def flags(self, word: str) -> int:
        got = self._flags.get(word)
        if got is None:
            if len(self._flags) > 200_000:
                self._flags.clear()
            own = word.casefold()
            got = _written(word)
            known = own in GENDER or own in self.given
            if not got & INITIAL and (own in NOT_A_NAME or (own in self.common and not known)):
                got |= STOP
            self._flags[word] = got = got | (IS_GIVEN if known else 0)
        return got

    def candidates(self, text: str) -> list[tuple]:
        """`score, start, end, given, family, first, last, words` of all candidates: the score without learnt contexts, and
        the places of the first and last word in the text's words."""
        words = [(m.start(), m.end(), m.group().rstrip("-'’")) for m in _word.finditer(text)]
        flags = [self.flags(w) for _, _, w in words]
        out = []
        for i in range(len(words) - 1):
            a = flags[i]
            if a & (STOP | BAD):
                continue
            b = flags[i + 1]
            if b & (STOP | BAD):
                continue
            start, end, w = words[i]
            end = start + len(w)
            gap = text[end : words[i + 1][0]]
            last = i + 1
            if a & INITIAL:
                if gap != ". " or not b & _WRITTEN:
                    continue
                score, given, family = (3.0 if b & (TITLE | CASELESS) else 1.5), w, words[i + 1][2]
            elif b & INITIAL:
                if gap != " " or i + 2 >= len(words):
                    continue
                c = flags[i + 2]
                if not c & _WRITTEN or c & (STOP | BAD) or text[words[i + 1][1] : words[i + 2][0]] != ". ":
                    continue
                score, given, family, last = _SHAPES.get((a & _WRITTEN, c & _WRITTEN), -1.0) + 1.5, w, words[i + 2][2], i + 2
                score += 1.5 * bool(a & IS_GIVEN)
            elif gap in (" ", " "):
                score, given, family = _SHAPES.get((a & _WRITTEN, b & _WRITTEN), -1.0), w, words[i + 1][2]
                if b & IS_GIVEN and not a & IS_GIVEN:
                    given, family = family, given
                if (a | b) & IS_GIVEN:
                    score += 1.5 if a & LOWER else 2.0
                if a & TITLE and b & TITLE:  # further family names
                    while last + 1 < len(words) and flags[last + 1] & TITLE and not flags[last + 1] & STOP and text[words[last][1] : words[last + 1][0]] == " " and last - i < 3:
                        last += 1
            elif gap in (", ", "، "):
                score, given, family = min(0.5, _SHAPES.get((a & _WRITTEN, b & _WRITTEN), -1.0)), words[i + 1][2], w
                score += 2.0 * bool(b & IS_GIVEN)
            else:
                continue
            stop = words[last][0] + len(words[last][2])
            before = text[max(0, start - 40) : start]
            if _strong.search(before):
                score += 3.0
            elif _weak.search(before):
                score += 1.5
            elif _surah.search(before):
                continue
            if _owned.match(text, stop):
                score += 2.5
            out.append((score, start, stop, given, family, i, last, words))
        return out

    def scored(self, text: str) -> list[tuple[float, int, int]]:
        """`score, start, end` of all candidates, the contexts included."""
        out = []
        for score, start, stop, _, _, i, last, words in self.candidates(text):
            for side, key in _contexts(text, words, i, last):
                score += self.contexts.get((side, *key), 0.0)
            out.append((score, start, stop))
        return out

    def find(self, text: str) -> list[tuple[int, int]]:
        """`start, end` of the names of a text; of those that overlap the one with the best score, then the longest."""
        out: list[tuple[int, int]] = []
        for score, start, stop in sorted(self.scored(text), key=lambda c: (-c[0], c[1] - c[2], c[1])):
            if score >= ENOUGH and all(stop <= s or start >= e for s, e in out):
                out.append((start, stop))
        return sorted(out)


def _gap(text: str, start: int, end: int) -> str | None:
    """What stands between two words beside spaces; None where a sentence ends."""
    gap = text[start:end]
    return None if _ends.search(gap) else gap.strip()


def _contexts(text: str, words: list, first: int, last: int) -> list[tuple[str, tuple]]:
    """The two words before and after a run of words, with the signs between, as far as the sentence goes."""
    out = []
    if first > 0:
        near = _gap(text, words[first - 1][1], words[first][0])
        if near is not None:
            far = words[first - 2][2].casefold() if first > 1 and _gap(text, words[first - 2][1], words[first - 1][0]) is not None else ""
            out.append(("before", (far, words[first - 1][2].casefold(), near)))
    if last + 1 < len(words):
        near = _gap(text, words[last][1], words[last + 1][0])
        if near is not None:
            far = words[last + 2][2].casefold() if last + 2 < len(words) and _gap(text, words[last + 1][1], words[last + 2][0]) is not None else ""
            out.append(("after", (near, words[last + 1][2].casefold(), far)))
    return out


#: A row of what texts teach: of a kind, a key of up to four words (null where it has fewer), and how often.
TAUGHT = ("kind", "a", "b", "c", "d", "n")
#: What a batch of texts may hold of them in memory.
Taught = Counter[tuple]


def words_taught(texts: Iterable[str]) -> Taught:
    """`any, word` and `lower, word`: in how many texts each word stands, in any case and in lower case."""
    out: Taught = Counter()
    for t in texts:
        found = {m.group().rstrip("-'’") for m in _word.finditer(t)}
        out.update(("any", w) for w in {w.casefold() for w in found})
        out.update(("lower", w) for w in found if w.islower())
    return out


def names_taught(model: NameModel, texts: Iterable[str], contexts: bool) -> Taught:
    """`family, given, family` of certain names; with `contexts` also `before` or `after`, the context and the name."""
    out: Taught = Counter()
    for t in texts:
        for score, _, _, given, family, i, last, words in model.candidates(t):
            if score < CERTAIN:
                continue
            if len(given) > 1:
                out["family", given.casefold(), family.casefold()] += 1
            if contexts:
                out.update((side, *key, f"{given} {family}".casefold()) for side, key in _contexts(t, words, i, last))
    return out


def places_taught(wanted: Container[tuple], texts: Iterable[str]) -> Taught:
    """How many places the `wanted` contexts lead to or follow, whatever stands there."""
    out: Taught = Counter()
    for t in texts:
        words = [(m.start(), m.end(), m.group().rstrip("-'’")) for m in _word.finditer(t)]
        out.update(k for i in range(len(words)) for side, key in _contexts(t, words, i, i) if (k := (side, *key)) in wanted)
    return out


def least_often(n: int) -> dict[str, float]:
    """In how many of `n` texts a word must stand to be common, by kind."""
    return {"any": max(LEAST_TEXTS, COMMON * n), "lower": max(LEAST_TEXTS, COMMON_LOWER * n)}


def weights(hits: dict[tuple, int], total: dict[tuple, int]) -> dict[tuple, float]:
    """Of contexts by how often a certain name stands there, and how many places they have."""
    w = {k: log((h + 0.5) / (max(0, total.get(k, 0) - h) + 0.5)) for k, h in hits.items()}
    return {k: min(MOST, 1.0 + x) for k, x in w.items() if x > 0}


def learnt(texts: Iterable[str]) -> NameModel:
    """A model of texts in memory, each counted once; `personal.fit` is the same over a table. Of few texts little is learnt;
    none give the model of general cues."""
    texts = [t for t in dict.fromkeys(texts) if t]
    least = least_often(len(texts))
    common = frozenset(w for (kind, w), n in words_taught(texts).items() if n >= least[kind])

    def given(model: NameModel) -> frozenset[str]:
        families = Counter(k[1] for k in names_taught(model, texts, False))
        return frozenset(g for g, n in families.items() if n >= LEAST_FAMILIES and g not in common)

    model = NameModel(common, given(NameModel(common)))
    people: dict[tuple, list[int]] = defaultdict(list)
    for k, n in names_taught(model, texts, True).items():
        if k[0] != "family":
            people[k[:4]].append(n)
    hits = {k: sum(n) for k, n in people.items() if len(n) >= LEAST_NAMES}
    return NameModel(common, given(model), weights(hits, places_taught(hits, texts)))
