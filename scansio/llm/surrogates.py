"""Keyed surrogates: every item is replaced by one of its kind, script, format and gender, under a secret key.

All of it is permutation. The characters of a run of digits or letters that may change span a domain (ten digits, the
consonants or vowels of an alphabet at each place), and a keyed permutation of that domain gives the surrogate. So items
that differ have surrogates that differ, by construction and in any number, however small their format; and the same
part has the same surrogate wherever it stands: in a name, in the name written the other way round, in a mail address.
A permutation here has no fixed point: nothing is its own surrogate, unless its format allows nothing else.

What gives an item its format stays: signs and spaces, trunk zeros and country codes, closing letters and check digits,
words that say what a part of an address is, top-level domains, the case of letters, the script of digits.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Sequence

from scansio.llm.names import GENDER, GIVEN, GIVEN_ARABIC, NOT_A_NAME

ROUNDS = 8
# Letters that take each other's place, by alphabet.
ALPHABETS = ("aeiou", "bcdfghjklmnpqrstvwxyz", "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ", "اوي", "بتثجحخدذرزسشصضطظعغفقكلمنه")
# Words of an address that say what a part is, and stay.
ADDRESS_WORDS = frozenset(
    "flat apartment apt unit suite street st road rd avenue ave lane ln terrace close court drive way square place row crescent gardens rue boulevard chemin allée impasse quai du des de la le les calle avenida plaza paseo camino del los po p o box postfach apartado boîte postale bis ter str strasse straße weg platz allee gasse شارع طريق حي رقم ص ب".split()
)
# Country codes of one and of two digits; all others have three.
ONE_DIGIT, TWO_DIGITS = "17", "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
#: Letters of Spanish identity numbers by the number modulo 23: a fixed value.
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
STREET_ENDS = re.compile(r"(stra(?:ß|ss)e|str|weg|platz|allee|gasse)$", re.I)

_place = {c: (a, i) for a in ALPHABETS for i, c in enumerate(a)}
_at_sign = re.compile(r"\s?(?:[@＠]|\(at\)|\[at\]|\{at\}|<at>)\s?|\sat\s", re.I)
_dot_sign = re.compile(r"\s?(?:\(dot\)|\[dot\]|\{dot\})\s?|\sdot\s|．", re.I)
_extension = re.compile(r"\s?(?:ext|x|extension)\.?\s?\d+$", re.I)


def _alphabet(c: str) -> tuple[str, int] | None:
    """The letters among which `c` may change, and its place there; null for what stays."""
    if c in _place:
        return _place[c]
    if not c.isalpha() or c.isascii() or unicodedata.combining(c):
        return None
    kind, base = unicodedata.category(c), ord(c) & ~63
    letters = "".join(x for x in map(chr, range(base, base + 64)) if unicodedata.category(x) == kind and x.casefold() == x and len(unicodedata.normalize("NFD", x)) == 1 and x not in _place)
    return (letters, letters.index(c)) if c in letters else None


class Permuter:
    """Keyed permutations of 0..n-1, one for every n and name, without fixed points for n > 1."""

    def __init__(self, key: bytes):
        if not key:
            raise ValueError("surrogates need a key")
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, name: bytes, i: int, half: int, bits: int) -> int:
        size = (bits + 7) // 8
        made = hashlib.blake2b(half.to_bytes(size, "big"), digest_size=min(64, size + 8), key=self.key, salt=bytes([i]) + bytes(15), person=hashlib.blake2b(name, digest_size=16).digest()).digest()
        return int.from_bytes(made, "big") & ((1 << bits) - 1)

    def _feistel(self, name: bytes, x: int, bits: int, back: bool) -> int:
        mask = (1 << bits) - 1
        left, right = x >> bits, x & mask
        for i in range(ROUNDS):
            if back:
                left, right = right ^ self._round(name, ROUNDS - 1 - i, left, bits), left
            else:
                left, right = right, left ^ self._round(name, i, right, bits)
        return left << bits | right

    def _walk(self, name: bytes, x: int, n: int, back: bool) -> int:
        bits = max(1, ((n - 1).bit_length() + 1) // 2)
        x = self._feistel(name, x, bits, back)
        while x >= n:  # out of the domain: on along the cycle, which comes back into it
            x = self._feistel(name, x, bits, back)
        return x

    def __call__(self, name: str, x: int, n: int) -> int:
        if n < 2:
            return x
        own = f"{n}:{name}".encode()
        step = 1 + int.from_bytes(hashlib.blake2b(own, digest_size=8, key=self.key).digest(), "big") % (n - 1)
        return self._walk(own, (self._walk(own, x, n, False) + step) % n, n, True)


def _like(pattern: str, made: str) -> str:
    """`made` in the case of `pattern`, letter by letter where they are as long, else by its first letters."""
    if len(pattern) == len(made):
        return "".join(m.upper() if p.isupper() and len(m.upper()) == 1 else m for p, m in zip(pattern, made))
    if pattern.isupper() and len(pattern) > 1:
        return made.upper()
    return made[:1].upper() + made[1:] if pattern[:1].isupper() else made


class Surrogates:
    """Surrogates under one key."""

    def __init__(self, key: bytes):
        self.permute = Permuter(key)
        self.given: dict[str, str] = {}
        for names in (*GIVEN.values(), *GIVEN_ARABIC.values()):
            own = [n.casefold() for n in names.split()]
            for i, n in enumerate(own):
                self.given[n] = own[self.permute("given " + own[0], i, len(own))]
        self.known: dict[str, str] = {}

    # --- runs of characters ---

    def digits(self, name: str, digits: str, fits: Callable[[str], bool] | None = None) -> str:
        """Digits of the same number; with `fits`, within those numbers that it holds for, of which this is one."""
        n, made = 10 ** len(digits), digits
        while digits:
            made = f"{self.permute('digits ' + name, int(made), n):0{len(digits)}d}"
            if fits is None or fits(made):
                break
        return made

    def letters(self, text: str) -> str:
        """Other letters of the same alphabets, in small; accents and signs stay."""
        split = unicodedata.normalize("NFD", text.casefold())
        out = list(split)
        places = [(i, a) for i, c in enumerate(split) if (a := _alphabet(c)) and len(a[0]) > 1]
        for at in range(0, len(places), 64):
            some = places[at : at + 64]
            x, n = 0, 1
            for _, (letters, place) in some:
                x, n = x * len(letters) + place, n * len(letters)
            shape = "".join(letters[0] for _, (letters, _) in some)
            x = self.permute(f"letters {at} {shape}", x, n)
            for i, (letters, _) in reversed(some):
                x, place = divmod(x, len(letters))
                out[i] = letters[place]
        return unicodedata.normalize("NFC", "".join(out))

    def _apart(self, word: str) -> bool:
        """Whether a word belongs to those that are no part of an item: only such words take each other's place."""
        return len(word) > 1 and (word in self.given or word in NOT_A_NAME or word in ADDRESS_WORDS)

    def word(self, word: str) -> str:
        """A word by a word: a known given name by one of its gender, others by their letters."""
        own = unicodedata.normalize("NFC", word.casefold())
        got = self.known.get(own)
        if got is None:
            got = self.given.get(own)
            if got is None:
                got, apart = self.letters(own), self._apart(own)
                while got != own and self._apart(got) != apart:  # along the cycle, which comes back to `own`
                    got = self.letters(got)
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[own] = got
        return _like(word, got)

    # --- kinds ---

    def email(self, item: str) -> str:
        """Words as in names, digits by digits; the signs, in any writing, and the top-level domain stay."""
        at = _at_sign.search(item)
        if at is None:
            return self._tokens(item)
        dots = list(_dot_sign.finditer(item, at.end()))
        last = dots[-1].end() if dots else max(item.rfind("."), at.end() - 1) + 1
        host, signs = item[at.end() : last], re.compile(_dot_sign.pattern + r"|\.", re.I)
        made, end = [], 0
        for m in signs.finditer(host):
            made += [self._tokens(host[end : m.start()]), m.group()]
            end = m.end()
        return self._tokens(item[: at.start()]) + at.group() + "".join(made) + self._tokens(host[end:]) + item[last:]

    def _tokens(self, text: str, keep: Callable[[str], bool] = lambda _: False) -> str:
        def other(m: re.Match) -> str:
            t = m.group()
            if keep(t):
                return t
            if t[0].isdecimal():
                return _in_script(t, self.digits("run", _ascii(t)))
            return self.word(t)

        return re.sub(r"\d+|[^\W\d_](?:[^\W\d_]|[\u0300-\u036f\u064b-\u065f\u0670])*", other, text)

    def phone(self, item: str) -> str:
        """The subscriber's digits; trunk zero, country code and extension stay."""
        tail = _extension.search(item)
        body, rest = (item[: tail.start()], tail.group()) if tail else (item, "")
        digits, lead = _ascii(body), 0
        if body.lstrip().startswith("+"):
            lead = _country(digits)
        elif digits.startswith("00"):
            lead = 2 + _country(digits[2:])
        elif digits.startswith("0") or re.match(r"1[\s.-]", body):
            lead = 1
        kind = f"national {digits[:lead]}" if lead <= 1 else "+" + digits[:lead].lstrip("0")
        # What begins with a zero is another way of writing: none comes to be or is lost.
        fits = (lambda made: made[:1] != "0") if digits[lead : lead + 1] != "0" else None
        return _in_script(body, digits[:lead] + self.digits("phone " + kind, digits[lead:], fits)) + rest

    def id_number(self, item: str) -> str:
        """The digits, and leading letters by letters; a closing letter or a single closing digit after a sign stays. Where
        the closing letter checks the digits it still does."""
        digits = _ascii(item)
        close = re.search(r"(?<=[\s-])\d$", item)
        kept = digits[-1:] if close else ""
        letters = "".join(c for c in item if c.isalpha())
        fits = None
        if re.fullmatch(r"\d{8}[\s-]?[A-Za-z]", item) and DNI_LETTERS[int(digits) % 23] == item[-1].upper():
            fits = lambda made: DNI_LETTERS[int(made) % 23] == item[-1].upper()
        shape = f"{len(letters)} {kept}{letters[-1:].upper() if item[-1:].isalpha() else ''}"
        made = _in_script(item, self.digits("id " + shape, digits[: len(digits) - len(kept)], fits) + kept)
        head = re.match(r"[^\W\d_]+", made)
        if not head or head.end() == len(made):
            return made
        front = head.group()
        x = self.permute("id letters", sum((ord(c) - 65) * 26**i for i, c in enumerate(front.upper())), 26 ** len(front)) if front.isascii() else 0
        return "".join(_like(c, chr(97 + x // 26**i % 26)) for i, c in enumerate(front)) + made[head.end() :] if front.isascii() else made

    def name(self, item: str) -> str:
        """Each part by its own: a family keeps one surrogate, whoever bears it."""

        def other(m: re.Match) -> str:
            t = m.group()
            return _like(t, self.letters(t)) if len(t) == 1 else self.word(t)

        return re.sub(r"[^\W\d_](?:[^\W\d_]|[\u0300-\u036f\u064b-\u065f\u0670])*", other, item)

    def address(self, item: str) -> str:
        def other(m: re.Match) -> str:
            t = m.group()
            if any(c.isdecimal() for c in t):
                own = _ascii(t)
                made = iter(self.digits("house", own, (lambda x: (x[0] == "0") == (own[0] == "0")) if len(own) > 1 else None))
                if len(t) - len(_ascii(t)) > 1 or not t[0].isdecimal():  # of a postcode the letters as well
                    return "".join(_in_script(c, next(made)) if c.isdecimal() else _like(c, self.letters(c)) for c in t)
                return "".join(_in_script(c, next(made)) if c.isdecimal() else c for c in t)
            if t.casefold() in ADDRESS_WORDS or len(t) == 1:
                return t
            end = STREET_ENDS.search(t)
            if end and end.start() > 1:
                return _like(t[: end.start()], self.letters(t[: end.start()])) + end.group()
            return self.word(t)

        return re.sub(r"(?:\w|[\u0300-\u036f\u064b-\u065f\u0670])+", other, item)

    def of(self, kind: str, item: str) -> str:
        return getattr(self, kind)(item)


def _ascii(text: str) -> str:
    """The digits of a text, of any script, as ASCII ones."""
    return "".join(str(int(c)) for c in text if c.isdecimal())


def _in_script(text: str, digits: str) -> str:
    """`text` with its digits in their order replaced, each in its script."""
    left = iter(digits)
    return "".join(chr(ord(c) - int(c) + int(next(left))) if c.isdecimal() else c for c in text)


def _country(digits: str) -> int:
    """The number of digits of the country code that a number begins with."""
    return 1 if digits[:1] in ONE_DIGIT else 2 if digits[:2] in TWO_DIGITS else 3


def plain(kind: str, item: str) -> str:
    """The form by which two ways of writing an item are one."""
    if kind == "email":
        return _dot_sign.sub(".", _at_sign.sub("@", item.casefold(), count=1))
    if kind == "phone":
        body = _extension.sub("", item)
        digits = _ascii(body)
        return "+" + digits if body.lstrip().startswith("+") else "+" + digits[2:] if digits.startswith("00") else digits
    if kind == "id_number":
        return "".join(str(int(c)) if c.isdecimal() else c.upper() for c in item if c.isalnum())
    if kind == "name" and (m := re.split(r"[,،]\s", item, maxsplit=1))[1:]:
        item = f"{m[1].strip()} {m[0].strip()}"
    return unicodedata.normalize("NFC", " ".join(item.casefold().split()))


_made: dict[bytes, Surrogates] = {}


def keyed(key: bytes) -> Surrogates:
    """The worker's only `Surrogates` for a key."""
    if key not in _made:
        _made[key] = Surrogates(key)
    return _made[key]


def clashes(pairs: Sequence[tuple[str, str, str]]) -> list[tuple[str, str]]:
    """Of `kind, item, surrogate` the kinds and plain surrogates that stand for more than one plain item: there are none."""
    seen: dict[tuple[str, str], set[str]] = {}
    for kind, item, made in pairs:
        seen.setdefault((kind, plain(kind, made)), set()).add(plain(kind, item))
    return [k for k, v in seen.items() if len(v) > 1]
