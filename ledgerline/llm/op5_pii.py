"""Personal data and secrets replaced by keyed surrogates of the same type and format.

An entity is brought to a canonical form (letters in lower case, digits without separators, phone numbers with their
country code), which is the same wherever and however it is written: that gives coreference within and across documents
without any shared state. The canonical form is a number in the space of all strings of its shape, in mixed radix by
position. The surrogate is that number moved by ``P^-1(P(x) + 1)``, where P is a keyed Feistel permutation of the space:
a permutation again, so that different entities of a shape keep different surrogates, and one without fixed points, so
that none stays as it is. Entities of different shapes differ by shape. Letters keep their case, their script, and are
vowels where vowels were; digits keep their separators, cards their first digit and the validity of their check digit,
addresses of hosts their kind, and given names the gender and the script of their pool.

Names are what follows a title, or a given name of a pool with a family name after it. Words of such a name are replaced
at each place of the document where they stand, with or without a title, by one surrogate a word.

Collisions are checked in each document: an entity whose surrogate is another entity of the text, or another one's
surrogate, moves on in its space (``P^-1(P(x) + 2)`` and so on) until it is neither, in the order of first mention. So
entities that differ stay different and one entity has one surrogate in the document; only such an entity has another
surrogate there than in other documents. ``collisions`` is their number. Where a pool of given names is used up by the
text itself, names are spelt letter by letter, and where a whole space is, entities change places with each other.

Secrets are told by a word before them (password, pwd, secret, token, key ...): eight characters and more, or four and more
with a digit or symbol. Limits: names without a title whose given name is in no pool, numbers of ten digits without
separators and without a word for phones before them, postal addresses, and dates of birth are not looked for.

A row is masked by itself: no shuffle, memory bounded by a batch of 12 MB of text or one text. Results: a null text stays
null with no entities and an empty text stays empty; a very long text is searched once, by patterns whose steps are
bounded; repeated rows are masked alike; all other columns are kept as they are by ``mask``, but for those named as the
ones that ``report`` adds, which are replaced; no rows give none.
"""

from __future__ import annotations

import functools
import hashlib
import hmac
import ipaddress
import re
import secrets
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, quoted, table

#: The session setting that holds the key; where it is unset, a random key of this process, so that none can undo the result.
KEY_SETTING, PROCESS_KEY = "spark.ledgerline.surrogate.key", secrets.token_bytes(32)

LOWER, DIGITS, HEX, UPPER = "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Fixed pools of given names by script and gender, and of family names by script.
GIVEN = {
    ("latin", "f"): "anna maria laura julia sarah emma sofia elena clara lucia nora alice marta irene carla diana eva paula rosa helen".split(),
    ("latin", "m"): "john peter thomas david daniel martin paul simon robert lukas marco pablo carlos felix jonas hugo louis oscar adam victor".split(),
    ("cyrillic", "f"): "анна мария елена ольга ирина наталья татьяна светлана юлия вера".split(),
    ("cyrillic", "m"): "иван пётр алексей дмитрий сергей андрей николай павел михаил олег".split(),
    ("greek", "f"): "μαρία ελένη άννα σοφία κατερίνα ειρήνη δήμητρα χριστίνα".split(),
    ("greek", "m"): "γιώργος νίκος δημήτρης κώστας γιάννης παύλος ανδρέας πέτρος".split(),
}
#: Titles by the gender that they tell.
TITLES = {"mrs": "f", "ms": "f", "miss": "f", "frau": "f", "mme": "f", "madame": "f", "sra": "f", "señora": "f", "mr": "m", "herr": "m", "monsieur": "m", "sr": "m", "señor": "m", "г-жа": "f", "г-н": "m", "κα": "f", "κ": "m"}
#: Classes of letters: one is replaced by one of its class. Letters with marks take the class of the letter without.
CLASSES = ["aeiou", "bcdfghjklmnpqrstvwxyz", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "ъь", "αεηιουω", "άέήίόύώ", "βγδζθκλμνξπρστφχψ"]
#: Words in lower case that stand inside family names.
PARTICLES = {"van", "von", "der", "den", "de", "del", "della", "di", "da", "dos", "la", "le", "ter", "bin", "al"}
#: Country codes of telephone numbers that have one or two digits; others have three.
SHORT_CODES = {"1", "7", *"20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()}

#: Private blocks of addresses in ascending order: first address and size.
BLOCKS = [(10 << 24, 1 << 24), (127 << 24, 1 << 24), (172 << 24 | 16 << 16, 1 << 20), (192 << 24 | 168 << 16, 1 << 16)]

#: Kinds in the order in which they claim text; of secrets and tel a group is what is replaced: a secret goes up to the closing quote, or the next white space.
PATTERNS: list[tuple[str, str]] = [
    ("email", r"(?<![\w.%+-])[\w.%+-]{1,64}@(?:[^\W_][\w-]{0,62}\.){1,8}[^\W\d_]{2,24}(?![\w-])"),
    ("aws_key", r"(?<![A-Za-z0-9])A(?:KIA|SIA)[A-Z0-9]{16}(?![A-Za-z0-9])"),
    ("secret", r"(?i:(?:password|passwd|pwd|secret|token|api[_-]?key)[\"']?\s{0,3}[=:]\s{0,3})(?:\"([^\"\n]{4,200})\"|'([^'\n]{4,200})'|[\"'`]?([^\s\"'`<>]{8,}(?<![.,;:!?)\]}])|(?=[^\s\"'`<>]{0,6}[\d$&!#%*@^~+=/])[^\s\"'`<>]{4,7}(?<![.,;:!?)\]}])))"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("ipv6", r"(?<![\w:.])(?=[0-9A-Fa-f:]{0,39}\d)(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:])"),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("card", r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d-])"),
    ("phone", r"(?<![\w+(])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]?\d{3,4}(?![\w-])|(?<![\w+(/.])0\d{1,4}/\d{5,8}(?![\w/-])|(?<![\w+])\+\d{1,3}(?:[ .-]?\d){7,12}(?![\w-])"),
    ("tel", r"(?i:(?<!\w)(?:phone|tel|telephone|mobile|cell|fax|whatsapp|call)(?: no| number| me at| at| is)?[.:]? {0,2})(\d{10,11})(?!\w)"),
    ("ip", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d)"),
]
ALL = re.compile("|".join(f"(?P<{kind}>{pattern})" for kind, pattern in PATTERNS))
INNER = {kind: re.compile(pattern) for kind, pattern in PATTERNS if kind in ("secret", "tel")}
#: A word of a name: letters with apostrophes inside, less the s of a genitive; a mention is up to six.
WORD = r"[^\W\d_]+(?:['\u2019](?!s(?!\w))[^\W\d_]+)*"
NAME_WORD = re.compile(WORD)
TITLED_NAME = re.compile(rf"(?<!\w)(?:Mrs|Ms|Miss|Mr|Dr|Prof|Professor|Frau|Herr|Mme|Madame|Monsieur|Sra|Sr|Señora|Señor|[гГ]-жа|[гГ]-н|[κΚ]α|[κΚ])\.? (?:(?:Dr|Prof)\.? )?(?=({WORD}(?:[ -]{WORD}){{0,5}}))")
PAIR = re.compile(rf"(?<!\w)(?=[A-ZÀ-ÖØ-ÞΆ-ΫЀ-Я])(?=({WORD}(?: {WORD}){{1,5}})){WORD}")
GIVEN_NAMES = {x for pool in GIVEN.values() for x in pool}
#: A text with none of these has no entity but names; one with none of TITLES_IN has no titled name. Every pattern needs one
#: of them: addresses of mail '@', keys their prefix, secrets a word (in folded case, as "(?i:s)" also matches long s), all
#: others a digit.
NUMBERS, SECRETS = re.compile(r"\d|@|AKIA|ASIA"), ("password", "passwd", "pwd", "secret", "token", "key")
TITLES_IN = ("Mr", "Ms", "Miss", "Dr", "Prof", "Frau", "Herr", "Mme", "Madame", "Monsieur", "Sr", "Señor", "г-", "Г-", "κ", "Κ")


@functools.cache
def alphabet(c: str) -> str:
    """The letters by which a lower-case letter may be replaced, itself among them: its class, or letters of its kind near it."""
    for own in CLASSES:
        if c in own:
            return own
    base, marks = unicodedata.normalize("NFD", c)[0], unicodedata.normalize("NFD", c)[1:]
    if marks and base != c:
        like = [x for x in (unicodedata.normalize("NFC", b + marks) for b in alphabet(base)) if len(x) == 1]
        if c in like and len(like) > 1:
            return "".join(like)
    wide = 64 if ord(c) < 0x3000 else 256
    first = ord(c) // wide * wide
    near = [x for x in map(chr, range(first, first + wide)) if unicodedata.category(x) == unicodedata.category(c) and not any(x in own for own in CLASSES)]
    return "".join(near)


def lower(c: str) -> str:
    """The lower-case letter, where that is one character."""
    return c.lower() if len(c.lower()) == 1 else c


class Surrogates:
    """The keyed maps. ``of`` gives the surrogate of an entity as it is written."""

    ROUNDS = 6

    def __init__(self, key: bytes) -> None:
        self.key = key
        self.memo: dict[tuple[str, str], str] = {}

    def _round(self, tweak: bytes, r: int, half: int, bits: int) -> int:
        out, size = b"", (bits + 7) // 8
        while len(out) < size:
            out += hmac.digest(self.key, tweak + b"|%d|%d|%d" % (r, len(out), half), hashlib.sha256)
        return int.from_bytes(out[:size]) & ((1 << bits) - 1)

    def _permute(self, x: int, n: int, tweak: bytes, back: bool = False) -> int:
        """A Feistel permutation of 0 ... n - 1, walked along its cycle until the number is below n."""
        half = max(1, ((n - 1).bit_length() + 1) // 2)
        low = (1 << half) - 1
        while True:
            a, b = x >> half, x & low
            for r in range(self.ROUNDS - 1, -1, -1) if back else range(self.ROUNDS):
                a, b = (b ^ self._round(tweak, r, a, half), a) if back else (b, a ^ self._round(tweak, r, b, half))
            x = a << half | b
            if x < n:
                return x

    def shift(self, x: int, n: int, tweak: bytes, by: int = 1) -> int:
        return x if n < 2 else self._permute((self._permute(x, n, tweak) + by) % n, n, tweak, back=True)

    def spell(self, text: str, alphabets: list[str], tweak: str, by: int = 1) -> str:
        """A string of the same shape: character k is one of alphabets[k]."""
        n, x = 1, 0
        for c, a in zip(text, alphabets, strict=True):
            n, x = n * len(a), x * len(a) + a.index(c)
        x = self.shift(x, n, f"{tweak}|{'|'.join(alphabets)}".encode(), by)
        out = []
        for a in reversed(alphabets):
            x, k = divmod(x, len(a))
            out.append(a[k])
        return "".join(reversed(out))

    @staticmethod
    def _free(text: str) -> list[str]:
        """Alphabets that keep lower case, upper case and digits in place, other letters among those like them, and all else as it is."""
        return [LOWER if c in LOWER else UPPER if c in UPPER else DIGITS if c in DIGITS else alphabet(c) if c.isalnum() else c for c in text]

    def of(self, kind: str, text: str, by: int = 1) -> str:
        if by == 1 and (kind, text) in self.memo:
            return self.memo[kind, text]
        out = getattr(self, kind)(text, by)
        if by == 1:
            if len(self.memo) > 100_000:
                self.memo.clear()
            self.memo[kind, text] = out
        return out

    def email(self, text: str, by: int) -> str:
        local, _, domain = text.rpartition("@")
        labels, top = domain.rsplit(".", 1)
        whole = "".join(map(lower, f"{local}@{labels}"))
        new = self.spell(whole, self._letters(whole), "email", by) + f".{top}"
        return self._cased(text, new)

    @staticmethod
    def _letters(text: str) -> list[str]:
        """Alphabets that keep the class of a letter and digits in place, and all else as it is."""
        return [DIGITS if c in DIGITS else alphabet(c) if c.isalpha() else c for c in text]

    @staticmethod
    def _cased(text: str, new: str) -> str:
        return "".join(n.upper() if lower(c) != c and len(n.upper()) == 1 else n for c, n in zip(text, new, strict=True))

    def aws_key(self, text: str, by: int) -> str:
        # letters and digits stay apart so that the shape is the original's
        return text[:4] + self.spell(text[4:], self._free(text[4:]), "aws_key", by)

    def secret(self, text: str, by: int) -> str:
        alphabets = [HEX] * len(text) if re.fullmatch("[0-9a-f]+", text) else self._free(text)
        return self.spell(text, alphabets, "secret", by)

    def iban(self, text: str, by: int) -> str:
        """The account moves; the two check digits are computed anew, valid if they were, else as far off as before."""
        bare = text.replace(" ", "")
        check = lambda country, account: 98 - int("".join(str(int(c, 36)) for c in account + country + "00")) % 97
        account = self.spell(bare[4:], self._free(bare[4:]), "iban" + bare[:2], by)
        off = (int(bare[2:4]) - check(bare[:2], bare[4:])) % 100
        return self._put(text, f"{bare[:2]}{(check(bare[:2], account) + off) % 100:02d}{account}")

    def ssn(self, text: str, by: int) -> str:
        return self._digits(text, "ssn", by)

    def card(self, text: str, by: int) -> str:
        """All but the first and the last digit move; the last keeps its distance from the right check digit."""
        bare = self._bare(text)

        def check(d: str) -> int:
            return -sum(x if k % 2 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(map(int, reversed(d)))) % 10

        new = bare[0] + self.spell(bare[1:-1], [DIGITS] * (len(bare) - 2), "card" + bare[0], by)
        return self._put(text, new + str((check(new) + int(bare[-1]) - check(bare[:-1])) % 10))

    def phone(self, text: str, by: int) -> str:
        """The country code stays, and digits that cannot start a number stay so; a number without a code is one of code 1."""
        digits = self._bare(text)
        code = country_code(text, digits)
        own = digits[len(code) :]
        new = self.spell(own, ["23456789" if k in (0, 3) and d > "1" else "01" if k in (0, 3) else DIGITS for k, d in enumerate(own)], f"phone{code or '1'}", by)
        return self._put(text, code + new)

    def ipv6(self, text: str, by: int) -> str:
        """The first 16 bits, which tell the kind of address, stay; the rest moves. Written in full or short as it comes."""
        x = int(ipaddress.IPv6Address(text))
        y = x >> 112 << 112 | self.shift(x & ((1 << 112) - 1), 1 << 112, b"ipv6", by)
        new = str(ipaddress.IPv6Address(y)) if "::" in text else ipaddress.IPv6Address(y).exploded
        return new.upper() if text.upper() == text else new

    def ip(self, text: str, by: int) -> str:
        """An address of a private block stays in the block, others stay outside of all and in the ordinary or the special range."""
        x = int.from_bytes(bytes(map(int, text.split("."))))
        for base, n in BLOCKS:
            if base <= x < base + n:
                y = base + self.shift(x - base, n, b"ip%d" % base, by)
                break
        else:
            low, high = next((a, z) for a, z in ((0, 1 << 24), (1 << 24, 224 << 24), (224 << 24, 1 << 32)) if a <= x < z)
            inside = [(base, n) for base, n in BLOCKS if low <= base < high]
            y = x - low - sum(n for base, n in inside if base < x)
            y = low + self.shift(y, high - low - sum(n for _, n in inside), b"ip-%d" % low, by)
            for base, n in inside:
                y += n if y >= base else 0
        return ".".join(map(str, y.to_bytes(4)))

    def name(self, text: str, by: int) -> str:
        """One word. A given name of a pool moves in its pool, which has one gender; others move letter by letter."""
        low = "".join(map(lower, text)).replace("\u2019", "'")
        script = "cyrillic" if "Ѐ" <= low[0] <= "ӿ" else "greek" if "Ͱ" <= low[0] <= "Ͽ" else "latin"
        for g in "fm":
            pool = GIVEN[script, g]
            if low in pool and by < len(pool):  # beyond, the pool is used up
                new = pool[self.shift(pool.index(low), len(pool), f"name{script}{g}".encode(), by)]
                return new.upper() if text.isupper() and len(text) > 1 else new.capitalize() if text[0].isupper() else new
        new = low
        while new == low or new in GIVEN_NAMES:  # a given name stands for given names only
            new = self.spell(new, self._letters(new), f"name{script}", by)
        return self._cased(text, new if "\u2019" not in text else new.replace("'", "\u2019"))

    def _digits(self, text: str, tweak: str, by: int) -> str:
        bare = self._bare(text)
        return self._put(text, self.spell(bare, [DIGITS] * len(bare), tweak, by))

    @staticmethod
    def _bare(text: str) -> str:
        """The digits of any script, as those of ASCII."""
        return "".join(str(int(c)) for c in text if c.isdecimal())

    @staticmethod
    def _put(text: str, new: str) -> str:
        """The new letters and digits in the places of the old, digits in the script of the old."""
        it = iter(new)
        put = lambda c, n: n if c.isascii() or not c.isdecimal() else chr(ord(c) - int(c) + int(n))
        return "".join(put(c, next(it)) if c.isalnum() else c for c in text)


@functools.lru_cache(maxsize=4)
def surrogates(key: bytes) -> Surrogates:
    return Surrogates(key)


def country_code(text: str, digits: str) -> str:
    """The country code at the start of a phone number's digits, or nothing if it has none."""
    if text.startswith("+"):
        return next((digits[:n] for n in (1, 2) if digits[:n] in SHORT_CODES), digits[:3])
    return "1" if len(digits) == 11 and digits[0] == "1" else ""


def canonical(kind: str, text: str) -> str:
    """What is one entity however it is written."""
    if kind == "phone":
        digits = Surrogates._bare(text)
        code = country_code(text, digits)
        return f"{code or '1'} {digits[len(code):]}"
    if kind == "ipv6":
        return ipaddress.IPv6Address(text).exploded
    if kind in ("card", "ssn", "iban"):
        return re.sub(r"\W", "", text).lower()
    return text if kind in ("secret", "aws_key") else "".join(map(lower, text)).replace("\u2019", "'")


def find(text: str) -> list[tuple[int, int, str]]:
    """Start, end and kind of each entity, in order, without overlaps; a name is a run of words of it."""
    out = []
    folded = text.casefold()
    if NUMBERS.search(text) or any(x in folded for x in SECRETS):
        for m in ALL.finditer(text):
            kind = m.lastgroup or ""
            a, z = m.span()
            if kind in INNER:  # the group that is there
                inner = INNER[kind].match(text, m.start())
                a, z = inner.span(inner.lastindex)
            if kind == "ipv6" and not _is_ipv6(m[0]):
                continue
            out.append((a, z, "phone" if kind == "tel" else kind))
    names = [(m.start(1), m[1]) for m in TITLED_NAME.finditer(text)] if any(x in text for x in TITLES_IN) else []
    spans = [(at, at + n) for at, words in names if (n := _name_length(words))]
    spans += [(m.start(1), m.start(1) + n) for m in PAIR.finditer(text) if lower_word(m[1]) in GIVEN_NAMES and (n := _name_length(m[1])) > len(m[0])]
    if spans:
        own = {w[0] for a, z in spans for w in NAME_WORD.finditer(text, a, z) if len(w[0]) > 2 and w[0][0] != lower(w[0][0])}
        if own:  # the same words elsewhere
            again = re.compile(rf"(?<![\w'\u2019-])(?:{'|'.join(map(re.escape, sorted(own, key=len, reverse=True)))})(?!\w)")
            spans += [m.span() for m in again.finditer(text)]
        taken = sorted(out)
        last = 0
        for a, z in sorted(spans, key=lambda s: (s[0], -s[1])):
            if a >= last and not any(a < t and s < z for s, t, _ in taken):
                out.append((a, z, "name"))
                last = z
    return sorted(out)


def lower_word(words: str) -> str:
    return "".join(map(lower, words.split(" ", 1)[0]))


def _is_ipv6(text: str) -> bool:
    try:
        ipaddress.IPv6Address(text)
    except ValueError:
        return False
    return len(text) > 3


def _name_length(words: str) -> int:
    """How much of what follows a title is the name: its first word, and words with a capital or particles before such."""
    end = 0
    for k, m in enumerate(NAME_WORD.finditer(words)):
        capital = m[0][0] != lower(m[0][0])
        if not k and not capital and m[0][0].upper() != m[0][0]:
            return 0  # a title that is a word of the sentence
        if not k or capital:
            end = m.end()
        elif m[0] not in PARTICLES:
            break
    return end


def _parts(text: str, found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The entities, names by their words (particles stay)."""
    out = []
    for a, z, kind in found:
        out += [(m.start(), m.end(), kind) for m in NAME_WORD.finditer(text, a, z) if m[0] not in PARTICLES] if kind == "name" else [(a, z, kind)]
    return out


def _step(kind: str, text: str, own: Surrogates, originals: set, used: set) -> int:
    """The least step to a surrogate that is free; where the whole space is in the text, to one that no other entity has."""
    apart = 0
    for k in range(1, len(originals) + len(used) + 2):  # one of so many different strings is free, if the space has them
        new = (kind, canonical(kind, own.of(kind, text, k)))
        if new not in used:
            if new not in originals:
                return k
            apart = apart or k
    return apart or 1


def masked(text: str, own: Surrogates) -> tuple[str, list[str], int]:
    """The text with surrogates, the kinds of its entities in order, and the entities that moved on for a collision."""
    found = find(text)
    if not found:
        return text, [], 0
    parts = [(a, z, kind, (kind, canonical(kind, text[a:z]))) for a, z, kind in _parts(text, found)]
    originals, used, steps, collisions = {key for *_, key in parts}, set(), {}, 0
    for a, z, kind, key in parts:
        if key not in steps:
            steps[key] = _step(kind, text[a:z], own, originals, used)
            used.add((kind, canonical(kind, own.of(kind, text[a:z], steps[key]))))
            collisions += steps[key] > 1
    out, at = [], 0
    for a, z, kind, key in parts:
        out += [text[at:a], own.of(kind, text[a:z], steps[key])]
        at = z
    return "".join([*out, text[at:]]), [kind for *_, kind in found], collisions


def session_key(spark: SparkSession) -> bytes:
    given = spark.conf.get(KEY_SETTING, None)
    return given.encode() if given else PROCESS_KEY


def mask(docs: DataFrame, key: bytes | None = None, report: bool = True) -> DataFrame:
    """The same rows and columns with surrogates in ``text``; with ``report`` also n_entities, kinds and collisions.

    Without a key that of the session is taken (``KEY_SETTING``), or one that lasts as long as the driver.
    """
    key = key or session_key(docs.sparkSession)
    added = [] if not report else [T.StructField("n_entities", T.LongType()), T.StructField("kinds", T.ArrayType(T.StringType())), T.StructField("collisions", T.LongType())]
    names = {f.name.lower() for f in added}
    kept = [c for c in docs.columns if c.lower() not in names]
    # the caller's columns travel under numbers, so that their names may be any
    docs = docs.select(*[F.col(quoted(c)).alias("text" if c == "text" else f"c{k}") for k, c in enumerate(kept)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = surrogates(key)
        for b in bounded(batches):
            rows = [(None, [], 0) if t is None else masked(t, own) for t in b.column("text").to_pylist()]
            columns = [pa.array([r[0] for r in rows], b.column(k).type) if name == "text" else b.column(k) for k, name in enumerate(b.schema.names)]
            if report:
                columns += [pa.array([len(r[1]) for r in rows], pa.int64()), pa.array([sorted({*r[1]}) for r in rows], pa.list_(pa.string())), pa.array([r[2] for r in rows], pa.int64())]
            yield pa.record_batch(columns, [*b.schema.names, *(f.name for f in added)])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added])).toDF(*kept, *(f.name for f in added))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask(table(spark, sf_dir, "documents").select("doc_id", "text"))
