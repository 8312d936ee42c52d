"""Keyed, format-preserving surrogates for private strings.

Everything is a function of (key, kind, entity, attempt). Strings with a numeric or character format go
through a keyed permutation of exactly the strings of that format (a Feistel network with cycle walking),
so two entities of one format never share a surrogate; check digits are computed anew. Latin, Cyrillic and Greek names
draw a given name of their gender and script and a composed family name; names in any other script go through a
permutation of the words of their length in letters of that script. What is left (names, strings that differ in
check digits only, a surrogate that is someone's real value) is found by the collision check in
:mod:`gridloom.llm.pii`, which raises ``attempt``.
"""

from __future__ import annotations

import hashlib
import unicodedata
from functools import cache

# Given names by script and gender, syllables of family names by script.
GIVEN = {
    ("latin", "f"): "Anna Clara Elena Emma Eva Helen Ida Julia Laura Lena Lucia Maria Mia Nina Nora Olga Paula Rosa Sara Vera".split(),
    ("latin", "m"): "Adam Alex Anton Bruno Carl David Eric Felix Hugo Ivan Jan Karl Leo Luis Marco Max Noah Oscar Paul Victor".split(),
    ("cyrillic", "f"): "Анна Вера Дарья Елена Ирина Мария Нина Ольга София Юлия".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Иван Максим Олег Павел Роман Сергей Юрий".split(),
    ("greek", "f"): "Άννα Ελένη Ειρήνη Μαρία Σοφία".split(),
    ("greek", "m"): "Γιώργος Κώστας Νίκος Πέτρος Σπύρος".split(),
}
SYLLABLES = {
    "latin": "al ban cor del fen gar hol kin lor mar nel os pen ran sel tor ul ven wal zan".split(),
    "cyrillic": "ал бан кор дел фен гар хол кин лор мар нел пен ран сел тор вен зан".split(),
    "greek": "αλ βαν κορ δελ φεν γαρ κιν λορ μαρ νελ πεν ραν σελ τορ ζαν".split(),
}
FAMILY_END = {("latin", "f"): "", ("latin", "m"): "", ("cyrillic", "f"): "ова", ("cyrillic", "m"): "ов", ("greek", "f"): "ου", ("greek", "m"): "ης"}
GIVEN_END = {("latin", "f"): "a", ("latin", "m"): "o", ("cyrillic", "f"): "а", ("cyrillic", "m"): "ий", ("greek", "f"): "α", ("greek", "m"): "ος"}
#: calling codes of two digits (those of one are 1 and 7, all others have three)
CODES = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
DIGITS, LOWER, UPPER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"


class Keyed:
    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def number(self, *what: str) -> int:
        return int.from_bytes(hashlib.blake2b("\x1f".join(what).encode(), key=self.key, digest_size=16).digest(), "big")

    def permute(self, x: int, n: int, *label: str) -> int:
        """A permutation of range(n) given by key and label."""
        if n < 2:
            return x
        half = (max(2, (n - 1).bit_length()) + 1) // 2
        mask = (1 << half) - 1
        while True:
            left, right = x >> half, x & mask
            for r in range(6):
                left, right = right, left ^ (self._round(right, r, half, label) & mask)
            x = left << half | right
            if x < n:
                return x

    def _round(self, x: int, r: int, bits: int, label: tuple[str, ...]) -> int:
        size = min(64, max(1, -(-bits // 8)))
        return int.from_bytes(hashlib.blake2b(f"{r}\x1f{x}\x1f{chr(31).join(label)}".encode(), key=self.key, digest_size=size).digest(), "big")

    def characters(self, text: str, *label: str, hexadecimal: bool = False) -> str:
        """Digits become digits, letters letters of their case (or hex digits), all else stays where it is."""
        sets = [(HEX if hexadecimal and c in HEX else HEX.upper() if hexadecimal and c in HEX.upper() else DIGITS if c in DIGITS else LOWER if c in LOWER else UPPER if c in UPPER else "") for c in text]
        x, n = 0, 1
        for c, s in zip(text, sets, strict=True):
            if s:
                x, n = x * len(s) + s.index(c), n * len(s)
        form = "".join("h" if len(s) == 16 else s[0] if s else c for c, s in zip(text, sets, strict=True))
        x = self.permute(x, n, *label, form)
        out = []
        for c, s in zip(reversed(text), reversed(sets), strict=True):
            out.append(s[x % len(s)] if s else c)
            x = x // len(s) if s else x
        return "".join(reversed(out))


def luhn(digits: str) -> int:
    """The check digit that follows ``digits``."""
    total = sum((d if i % 2 else sum(divmod(2 * d, 10))) for i, d in enumerate(map(int, reversed(digits))))
    return -total % 10


def script_of(word: str) -> str:
    """latin, cyrillic or greek, for which there are names; else the script as Unicode names its letters."""
    c = next((x for x in word if x.isalpha()), "a")
    return {"LATIN": "latin", "CYRILLIC": "cyrillic", "GREEK": "greek"}.get(found := unicodedata.name(c, "LATIN").split()[0], found)


@cache
def letters_like(c: str) -> str:
    """The letters of the script and kind of ``c`` near it: its Unicode block, or 128 code points about it."""
    n = ord(c)
    low, high = (0x4E00, 0x9FA5) if 0x4E00 <= n <= 0x9FA5 else (0xAC00, 0xD7A3) if 0xAC00 <= n <= 0xD7A3 else (n & ~0x7F, n | 0x7F)
    kind, script = unicodedata.category(c), unicodedata.name(c, "").split()[:1]
    if high - low > 128:
        return "".join(map(chr, range(low, high + 1)))
    return "".join(x for x in map(chr, range(low, high + 1)) if unicodedata.category(x) == kind and unicodedata.name(x, "").split()[:1] == script)


def letters(k: Keyed, word: str, *label: str) -> str:
    """Letters become letters of their script; marks and hyphens stay."""
    sets = [letters_like(c) if c.isalpha() else "" for c in word]
    x, n = 0, 1
    for c, s in zip(word, sets, strict=True):
        if s:
            x, n = x * len(s) + s.index(c), n * len(s)
    x = k.permute(x, n, *label, "".join(s[0] if s else c for c, s in zip(word, sets, strict=True)))
    out = []
    for c, s in zip(reversed(word), reversed(sets), strict=True):
        out.append(s[x % len(s)] if s else c)
        x = x // len(s) if s else x
    return "".join(reversed(out))


def calling_code(digits: str) -> str:
    return digits[:1] if digits[:1] in ("1", "7") else digits[:2] if digits[:2] in CODES else digits[:3]


def refill(form: str, digits: str) -> str:
    """``form`` with its digits replaced in order, in the digits of their script."""
    it = iter(digits)
    return "".join(chr(ord(c) - unicodedata.decimal(c) + int(next(it))) if c.isdecimal() else c for c in form)


def _ip(k: Keyed, norm: str, attempt: str) -> str:
    a = [int(x) for x in norm.split(".")]
    x = int.from_bytes(bytes(a), "big")
    for first, bits in ((10 << 24, 24), ((172 << 24) | (16 << 16), 20), ((192 << 24) | (168 << 16), 16), (127 << 24, 24)):
        if x >> bits == first >> bits:
            return ".".join(map(str, (first | k.permute(x - first, 1 << bits, "ip", attempt, str(first))).to_bytes(4, "big")))
    while True:
        x = k.permute(x, 1 << 32, "ip", attempt)
        b = x.to_bytes(4, "big")
        if 1 <= b[0] < 224 and b[0] not in (10, 127) and b[:2] != bytes([192, 168]) and not (b[0] == 172 and 16 <= b[1] < 32) and b[:2] != bytes([169, 254]):
            return ".".join(map(str, b))


def surrogate(k: Keyed, kind: str, norm: str, attempt: int) -> str:
    """The normal form of the surrogate for an entity's normal form."""
    a = str(attempt)
    if kind == "phone":  # country code ":" national digits
        code, _, rest = norm.partition(":")
        if rest[0] in "01":
            return f"{code}:{rest[0]}{k.characters(rest[1:], 'phone', a, code, rest[0])}"
        n = 8 * 10 ** (len(rest) - 1)
        return f"{code}:{k.permute(int(rest) - 2 * 10 ** (len(rest) - 1), n, 'phone', a, code) + 2 * 10 ** (len(rest) - 1)}"
    if kind == "card":
        body = norm[0] + k.characters(norm[1:-1], "card", a, norm[0])
        return body + str(luhn(body))
    if kind == "ssn":
        x = int(norm)
        while True:
            x = k.permute(x, 10**9, "ssn", a)
            s = f"{x:09d}"
            if s[:3] not in ("000", "666") and s[0] != "9" and s[3:5] != "00" and s[5:] != "0000":
                return s
    if kind == "ip":
        return _ip(k, norm, a)
    if kind == "ip6":
        return k.characters(norm, "ip6", a, hexadecimal=True)
    if kind == "iban":
        body = k.characters(norm[4:], "iban", a, norm[:2])
        number = int("".join(str(int(c, 36)) for c in body + norm[:2] + "00"))
        return f"{norm[:2]}{98 - number % 97:02d}{body}"
    if kind == "email":
        local, _, host = norm.partition("@")
        labels = host.split(".")
        return k.characters(local, "local", a, host) + "@" + ".".join([k.characters(x, "host", a) for x in labels[:-1]] + labels[-1:])
    if kind == "secret":
        if norm.startswith("AKIA"):
            return "AKIA" + k.characters(norm[4:], "aws", a)
        return k.characters(norm, "secret", a, hexadecimal=all(c in HEX for c in norm.lower()))
    gender, _, word = norm.partition(":")  # given names and family names
    return f"{gender}:" + "-".join(_name(k, kind, gender, part, n, attempt) for n, part in enumerate(word.split("-")))


def _name(k: Keyed, kind: str, gender: str, word: str, place: int, attempt: int) -> str:
    script, a = script_of(word), str(attempt)
    if script not in SYLLABLES:
        return letters(k, word, "name", a)
    h = k.number(kind, gender, word, str(place), a)
    if kind == "given" and not attempt:
        names = GIVEN[script, gender]
        return names[h % len(names)].lower()
    parts = SYLLABLES[script]  # longer with every attempt, so that any number of names finds room in a few
    made = "".join(parts[(h >> 8 * i) % len(parts)] for i in range(2 + min(9, attempt) + h % 2))
    return made + (FAMILY_END if kind == "family" else GIVEN_END)[script, gender]
