"""Surrogates for personal data.

Every detected entity is replaced by one of its own kind: the same key, entity
and kind give the same surrogate everywhere, so mentions that corefer still do,
and different entities get different surrogates.  This needs no table of
entities: a surrogate is a keyed permutation of the entity within its format,
the sequence of its character classes (digit, vowel or consonant of a script).
The permutation is one cycle through the format, so nothing maps to itself.
Names keep gender and script: listed given names are permuted within the list of
their gender and script, listed surnames within that of their script, and of
others the letters, whether they are given names or surnames.  Parts after a hyphen, an apostrophe, Mc and Mac are
permuted by themselves; particles stay.  Collision checks: a permuted name that hits a listed one, or takes or loses
an ending that tells the gender, is walked on until it does not, so that the three
kinds never meet; octets stay octets, phone numbers keep their country code and
trunk zero.  A plain run of digits is a card only if its check digit is right, and
the surrogate's is right too.

Names are found by titles, by listed given names, by what introduces a name
("my name is", "Dear"), by what joins two people of whom one is known ("met",
"and"), beside a name that is known, and then wherever else in the text they are
mentioned; in capitals too.  In scripts without capitals titles, introductions and
listed names tell where one is.

Whoever has the key can undo the permutations.  So the operator has no key of
its own: it takes one as an argument, which ``key_of`` reads from the setting
KEY_SETTING, or where that is unset makes at random for this application, so
that nobody has it afterwards.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import secrets
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kalibra.llm.shared import fresh, table, worker_cache

KEY_SETTING, KEY_BYTES = "spark.kalibra.pii.key", 16
ROUNDS = 8
#: Rows whose new texts a task holds at a time.
SLICE = 256

def extended(base: str) -> str:
    """Small Latin letters with marks beyond those listed, whose letter without them is one of base."""
    found = (chr(c) for lo, hi in ((0xE0, 0x250), (0x1E00, 0x1F00)) for c in range(lo, hi))
    return "".join(c for c in found if c.islower() and len(c.upper()) == 1 and unicodedata.normalize("NFD", c)[0] in base and unicodedata.normalize("NFD", c) != c and c not in MARKED)


#: Accented letters that are classes by themselves.
MARKED = "àáâäèéêëìíîïòóôöùúûüçñšžčřł"
#: Chinese surnames.
HAN = "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧程曹袁邓许傅沈曾彭吕"
#: Character classes: each is permuted within itself.
CLASSES = [
    "0123456789",
    "aeiou",
    "bcdfghjklmnpqrstvwxyz",
    "àáâäèéêëìíîïòóôöùúûü",
    "çñšžčřł",
    "аеиоуыэюяё",
    "бвгджзйклмнпрстфхцчшщ",
    "αεηιουω",
    "βγδζθκλμνξπρσστφχψ",
    "άέήίόύώ",
    extended("aeiouy"),
    extended("bcdfghjklmnpqrstvwxz") + "đħŧø",
    "ابتثجحخدذرزسشصضطظعغفقكلمنهوي",
    "אבגדהוזחטיכלמנסעפצקרשת",
    "ךםןףץ",
    "".join(map(chr, range(0x915, 0x93A))),
    "".join(map(chr, range(0x93E, 0x94D))),
    "".join(map(chr, range(0x4E00, 0x9FA6))),
    "".join(map(chr, range(0xAC00, 0xD7A4))),
]
#: Common given names by script and gender, and titles by gender.
GIVEN = {
    "latin m": "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Steven Peter Hans Klaus Jürgen Pierre Jacques Antoine Carlos Javier Miguel".split(),
    "latin f": "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Margaret Sandra Emily Laura Ursula Sabine Greta Camille Sophie Élodie Carmen Lucía Isabel".split(),
    "cyrillic m": "Александр Дмитрий Сергей Андрей Алексей Михаил Николай Иван".split(),
    "cyrillic f": "Анна Мария Елена Ольга Наталья Екатерина Татьяна Ирина".split(),
    "greek m": "Γιώργος Νίκος Κώστας Δημήτρης".split(),
    "greek f": "Μαρία Ελένη Κατερίνα Σοφία".split(),
    "arabic m": "محمد أحمد علي حسن حسين محمود إبراهيم خالد عمر يوسف".split(),
    "arabic f": "فاطمة مريم عائشة زينب خديجة ليلى سارة".split(),
}
TITLES = {
    "m": "Mr Sir Herr Monsieur Señor Sr Господин Κύριος".split(),
    "f": "Mrs Ms Miss Madam Frau Madame Mme Mademoiselle Mlle Señora Señorita Sra Госпожа Κυρία".split(),
    "": "Dr Prof Doctor Professor Dra Доктор".split(),
}
#: Common surnames by script.
SURNAMES = {
    "latin": "Smith Johnson Williams Brown Jones Garcia Miller Davis Wilson Anderson Taylor Moore Jackson Martin Thompson White Harris Clark Lewis Walker Müller Schmidt Schneider Fischer Weber Wagner Becker Hoffmann Dubois Durand Lefebvre Moreau Laurent Bernard García Martínez López Sánchez Pérez Gómez".split(),
    "cyrillic": "Мельник Шевченко Бондаренко Коваленко Ткаченко Кравченко".split(),
    "greek": "Παπαδόπουλος Νικολάου Γεωργίου Δημητρίου Ιωάννου Κωνσταντίνου".split(),
}
#: What introduces a name, and what joins two people.
INTRODUCING = ["my name is", "name is", "name:", "named", "called", "dear", "signed", "signed by", "sincerely,", "regards,", "attn:", "contact:", "mein name ist", "ich heiße", "je m'appelle", "me llamo", "mi nombre es", "меня зовут", "με λένε"]
JOINING = ["and", "met", "with", "called", "married", "told", "asked", "saw", "knows", "und", "traf", "mit", "et", "avec", "y", "con", "и", "και"]
LISTED = {n.lower(): g for g, names in GIVEN.items() for n in names}
SURNAMED = {n.lower(): g for g, names in SURNAMES.items() for n in names}
#: Endings of surnames that tell the gender.
ENDINGS = ("ова", "ева", "ина", "ская", "ов", "ев", "ин", "ский", "opoulou", "opoulos", "ίδης", "ίδου")
#: What stands before a surname, and capitalised words that are none after a known name.
PARTICLES = "de|da|di|del|della|der|den|van|von|vom|zu|zur|la|le|las|los|du|dos|das|ter|ten|bin|ibn|al|el|y|e|af|av"
NO_NAMES = {"street", "road", "avenue", "lane", "square", "company", "university", "inc", "ltd", "corp", "the", "and", "church", "hospital", "school", "county", "park", "river", "house", "hall", "college", "bank", "says", "said"}
NO_NAMES |= {t.lower() for ts in TITLES.values() for t in ts}
LETTERS = [chr(c) for lo, hi in ((0x41, 0x5B), (0x61, 0x7B), (0xC0, 0x250), (0x370, 0x530), (0x1E00, 0x2000)) for c in range(lo, hi)]
UPPER, LOW = "".join(filter(str.isupper, LETTERS)), "".join(filter(str.islower, LETTERS))
#: A name with its parts: Anna-Maria, O'Brien, McDonald.
CAPITAL = f"[{UPPER}](?:[{LOW}]++|['’](?=[{UPPER}]))(?:-[{UPPER}]?[{LOW}]++|['’]?[{UPPER}][{LOW}]++)*+"

DOMAIN = re.compile(r"(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,62})\.)+[A-Za-z]{2,24}(?![A-Za-z0-9-])", re.A)
IP = re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\d]|\.\d)", re.A)
IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)", re.A)
SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", re.A)
CARD = re.compile(r"(?<![\w+-])(?!00)\d(?:[ -]?\d){12,18}(?![\w-])", re.A)
PHONE = re.compile(r"(?<![\w+])(?:\+|00)?(?:\(\d{1,4}\)|\d{1,4}+)(?:[ .()/-]{0,3}\d{1,10}+){1,5}+(?!\w)", re.A)
VERSION = re.compile(r"(?:\b(?:version|ver\.?|v|release|build|section)[ \t:=]*|§ ?)\Z", re.I | re.A)
DATE = re.compile(r"\d{4}[-./]\d{1,2}[-./]\d{1,2}|\d{1,2}[-./]\d{1,2}[-./]\d{2,4}", re.A)
IPV6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:|:){2,8}(?:[0-9A-Fa-f]{1,4})?(?![\w:])", re.A)
GIVENS = "|".join(n for ns in GIVEN.values() for n in ns)
TITLE = "|".join(t for ts in TITLES.values() for t in ts)
LAST = f"(?:(?:{PARTICLES}) )*+({CAPITAL})"
FULL = f"({CAPITAL}) (?:[{UPPER}]\\. )?{LAST}"
CAPITALS = f"(?:[{UPPER}]['’])?[{UPPER}]{{2,}}+(?:-[{UPPER}]{{2,}}+)*+"
TITLED = re.compile(rf"(?<!\w)(?:(?:{TITLE})\.?|M\.) {LAST}(?: (?:[{UPPER}]\. )?{LAST})?")
NAMED = re.compile(rf"(?<!\w)((?:{GIVENS})(?:-{CAPITAL})?) (?:[{UPPER}]\. )?{LAST}")
ALONE = re.compile(rf"(?<!\w)((?:{GIVENS})(?:-{CAPITAL})?)(?!\w)")
SHOUTED = re.compile(rf"(?<!\w)(?:(?:{TITLE.upper()})\.? ({CAPITALS})(?: ({CAPITALS}))?|({GIVENS.upper()}) ({CAPITALS}))(?!\w)")
INTRODUCED = re.compile(rf"(?<!\w)(?i:{'|'.join(map(re.escape, INTRODUCING))})[ \n]{FULL}")
#: Two people joined, of whom the first or the second is to be known.
START = f"(?<![\\w-])(?<![{UPPER}{LOW}]['’])"  # so that no name begins within another
JOINED = re.compile(rf"{START}{FULL} (?:{'|'.join(JOINING)}) (?={FULL})")
BESIDE = re.compile(rf"{START}(?={FULL})")
CAPITALISED = re.compile(rf"(?<!\w)(?:{CAPITAL}|{CAPITALS})(?!\w)")
#: Names in scripts without capitals, by titles, introductions and listed names.
UNCASED = re.compile("[\u0590-\u0963\u4e00-\u9fa5\uac00-\ud7a3]")
ARABIC, HEBREW, HINDI, HANGUL, IDEOGRAPH = "[\u0621-\u064a]{2,}+", "[\u05d0-\u05ea]{2,}+", "[\u0904-\u094d]{2,}+", "[\uac00-\ud7a3]", "[\u4e00-\u9fa5]"
OTHERS = [
    re.compile(rf"(?<!\w)(?:السيدة|السيد|الدكتورة|الدكتور|الأستاذة|الأستاذ|اسمي) ({ARABIC})(?: ({ARABIC}))?"),
    re.compile(rf"(?<!\w)({'|'.join(n for g in ('arabic m', 'arabic f') for n in GIVEN[g])}) ({ARABIC})"),
    re.compile(rf"(?<!\w)(?:מר|גברת|גב'|ד\"ר|פרופ'|שמי|קוראים לי) ({HEBREW})(?: ({HEBREW}))?"),
    re.compile(rf"(?<!\w)(?:श्रीमती|श्री|डॉ\.|मेरा नाम) ({HINDI})(?: ({HINDI}))?"),
    re.compile(rf"(?:我叫|我的名字是|姓名[:：] ?|名字[:：] ?)([{HAN}]{IDEOGRAPH}{{1,2}})"),
    re.compile(rf"([{HAN}]{IDEOGRAPH}{{1,2}})(?=先生|女士|小姐|老师|博士|教授)"),
    re.compile(rf"(?<!{IDEOGRAPH})([{HAN}]{IDEOGRAPH}{{1,2}})(?!{IDEOGRAPH})"),
    re.compile(rf"(?<!\w)({HANGUL}{{2,4}})(?= ?씨| ?님| ?선생님)"),
    re.compile(rf"(?:제 이름은|저는) ({HANGUL}{{2,4}}?)(?=입니다|이고|\W|$)"),
]


def halves(n: int) -> tuple[int, int]:
    bits = max(2, (n - 1).bit_length())
    return bits - bits // 2, bits // 2


def permuted(x: int, n: int, key: bytes, back: bool = False) -> int:
    """A keyed permutation of 0 to n - 1: Feistel rounds over bits, walked on until below n."""
    high, low = halves(n)
    while True:
        left, right = x >> low, x & (1 << low) - 1
        a, b = high, low  # bits of left and right
        order = range(ROUNDS)
        for i in reversed(order) if back else order:
            if i % 2 == 0:
                left ^= keyed(key, i, right) & (1 << a) - 1
            else:
                right ^= keyed(key, i, left) & (1 << b) - 1
        x = left << low | right
        if x < n:
            return x


def keyed(key: bytes, i: int, x: int) -> int:
    size = max(1, (x.bit_length() + 7) // 8)
    return int.from_bytes(hashlib.blake2b(x.to_bytes(size, "big"), key=hashlib.sha256(key).digest(), salt=bytes([i])).digest(), "big")


def turned(x: int, n: int, key: bytes) -> int:
    """The next on a keyed cycle through 0 to n - 1."""
    return permuted((permuted(x, n, key) + 1) % n, n, key, True) if n > 1 else x


MEMBERS = [list(dict.fromkeys(cs)) for cs in CLASSES]
PLACE = {c: (k, i) for k, cs in enumerate(MEMBERS) for i, c in enumerate(cs)}
SIZE = [len(cs) for cs in MEMBERS]
#: Longer texts are permuted in parts of so many characters.
WIDE = 64


def letters(text: str, key: bytes) -> str:
    """A permutation of texts of one format; case and all other characters stay."""
    if len(text) > WIDE:
        return "".join(letters(text[i : i + WIDE], key + b"|%d" % i) for i in range(0, len(text), WIDE))
    lowered = [c.lower() if len(c.lower()) == 1 else c for c in text]
    places = [PLACE.get(c) for c in lowered]
    n, x = 1, 0
    for p in places:
        if p:
            n, x = n * SIZE[p[0]], x * SIZE[p[0]] + p[1]
    form = ",".join(c if p is None else str(p[0]) for c, p in zip(lowered, places))
    x = turned(x, n, key + b"|" + form.encode())
    out = []
    for c, low, p in zip(reversed(text), reversed(lowered), reversed(places)):
        if p:
            x, i = divmod(x, SIZE[p[0]])
            new = MEMBERS[p[0]][i]
            out.append(new.upper() if c != low and len(new.upper()) == 1 else new)
        else:
            out.append(c)
    return "".join(reversed(out))


def digits(text: str, key: bytes, fixed: int = 0) -> str:
    """The digits of a text permuted, but for the first fixed ones; all else stays."""
    own = [c for c in text if c.isdigit()]
    new = iter(own[:fixed] + list(letters("".join(own[fixed:]), key)))
    return "".join(next(new) if c.isdigit() else c for c in text)


def luhn(number: str) -> int:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (2 - i % 2)
        total += d - 9 * (d > 9)
    return -total % 10


def card(text: str, key: bytes) -> str:
    own = "".join(c for c in text if c.isdigit())
    first = letters(own[:-1], key)
    last = (luhn(first) + int(own[-1]) - luhn(own[:-1])) % 10
    new = iter(first + str(last))
    return "".join(next(new) if c.isdigit() else c for c in text)


#: Country codes of two digits; those that begin with 1 or 7 have one, all others three.
TWO = {"20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98"}


def prefixed(text: str, own: str) -> int:
    """The digits before the national number: the country code, how it is dialled, and a trunk zero."""
    n = 0
    if text.startswith("+") or own.startswith("00"):
        n = 0 if text.startswith("+") else 2
        n += 1 if own[n : n + 1] in ("1", "7") else 2 if own[n : n + 2] in TWO else 3
    elif len(own) == 11 and own[0] == "1":
        n = 1
    return n + (own[n : n + 1] == "0")


def phone(text: str, key: bytes) -> str:
    """The national number is permuted alike in every notation, its first digit not to a zero; what is before it stays."""
    own = "".join(c for c in text if c.isdigit())
    n = prefixed(text, own)
    rest = own[n:]
    if rest[:1] in ("", "0"):
        return digits(text, key, min(n, len(own) - 1))
    least = 10 ** (len(rest) - 1)
    new = iter(own[:n] + str(least + turned(int(rest) - least, 9 * least, key + b"|%d" % len(rest))))
    return "".join(next(new) if c.isdigit() else c for c in text)


def ipv6(text: str, key: bytes) -> str:
    return str(ipaddress.IPv6Address(turned(int(ipaddress.IPv6Address(text)), 1 << 128, key)))


def ip(text: str, key: bytes) -> str:
    x = int.from_bytes(bytes(map(int, text.split("."))), "big")
    return ".".join(map(str, turned(x, 1 << 32, key).to_bytes(4, "big")))


def email(text: str, key: bytes) -> str:
    local, _, domain = text.rpartition("@")
    name, _, top = domain.rpartition(".")
    return f"{letters(local, key + b' local')}@{letters(name, key + b' domain')}.{top}"


@lru_cache(None)
def listed(names: tuple[str, ...], key: bytes) -> dict[str, str]:
    order = sorted(names, key=lambda x: keyed(key, 0, int.from_bytes(x.encode(), "big")))
    return {a.lower(): b for a, b in zip(order, order[1:] + order[:1])}


def ending(low: str) -> str:
    return next((e for e in ENDINGS if low.endswith(e) and len(low) > len(e) + 1), "")


def word(low: str, key: bytes) -> str:
    """A part of a name that isn't listed, in small letters; an ending that tells the gender stays, and no other gets one."""
    end = ending(low)
    stem = low[: len(low) - len(end)]
    while True:
        if stem[:1] in HAN and stem:
            i = HAN.index(stem[0])
            stem = HAN[turned(i, len(HAN), key)] + letters(stem[1:], key)
        else:
            stem = letters(stem, key)
        new = stem + end
        if ending(new) == end and new not in LISTED and new not in SURNAMED:
            return new


@lru_cache(1 << 14)
def part(text: str, key: bytes) -> str:
    """A name without hyphens and apostrophes; capitals stay where they are."""
    low = text.lower()
    for groups, names in ((LISTED, GIVEN), (SURNAMED, SURNAMES)):
        if low in groups:
            new = listed(tuple(names[groups[low]]), key)[low]
            return new.upper() if text.isupper() and len(text) > 1 else new
    new = word(low, key)
    if len(new) != len(text):
        return new.upper() if text.isupper() else new.capitalize()
    return "".join(n.upper() if c != c.lower() and len(n.upper()) == 1 else n for c, n in zip(text, new))


def named(text: str, key: bytes) -> str:
    """A given name or surname, part by part; single letters, Mc and Mac stay."""
    out = []
    for x in re.split("([-'’])", text):
        m = re.match(r"(?:Mc|Mac)(?=[A-Z])|MC(?=[A-Z]{3})", x)
        head = m[0] if m else ""
        rest = x[len(head) :]
        out.append(head + (part(rest, key) if len(rest) > 1 else rest))
    return "".join(out)


MAKE = {"email": email, "ip": ip, "ipv6": ipv6, "iban": lambda t, k: t[:2] + letters(t[2:], k), "ssn": digits, "card": card, "phone": phone, "given": named, "surname": named}


def emails(text: str) -> Iterator[tuple[int, int]]:
    at = text.find("@")
    while at >= 0:
        a = at
        while a > 0 and (text[a - 1].isalnum() or text[a - 1] in "._%+-"):
            a -= 1
        while a < at and text[a] in ".%-":
            a += 1
        if a < at and text[at - 1] != "." and (m := DOMAIN.match(text, at + 1)):
            yield a, m.end()
        at = text.find("@", at + 1)


class Spans:
    """Spans in order, none over another; the first to come stays."""

    def __init__(self) -> None:
        self.rows: list[tuple[int, int, str]] = []

    def add(self, a: int, b: int, kind: str) -> None:
        i = bisect_left(self.rows, (a,))
        if (i == 0 or self.rows[i - 1][1] <= a) and (i == len(self.rows) or b <= self.rows[i][0]):
            self.rows.insert(i, (a, b, kind))


def entities(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the entities, in order, none over another."""
    found = Spans()
    for a, b in emails(text):
        found.add(a, b, "email")
    if any(map(text.__contains__, "0123456789")):
        for kind, form in (("ip", IP), ("iban", IBAN), ("ssn", SSN), ("card", CARD)):
            for m in form.finditer(text):
                if sound(kind, text, m):
                    found.add(*m.span(), kind)
        for m in PHONE.finditer(text):
            own = m.group()
            n = sum(c.isdigit() for c in own)
            if 9 <= n <= 15 and not DATE.match(own) and not (own.isdigit() and n not in (10, 11)):
                found.add(*m.span(), "phone")
    if "::" in text or text.count(":") > 6:
        for m in IPV6.finditer(text):
            if valid_ipv6(m.group()):
                found.add(*m.span(), "ipv6")
    people(text, found)
    return found.rows


def sound(kind: str, text: str, m: re.Match) -> bool:
    """Not a plain number without a card's check digit, nor a version of four numbers."""
    if kind == "card" and m[0].isdigit():
        return luhn(m[0][:-1]) == int(m[0][-1])
    return kind != "ip" or not VERSION.search(text, max(0, m.start() - 12), m.start())


def valid_ipv6(text: str) -> bool:
    try:
        return any(c.isdigit() for c in text) and len(text) > 3 and bool(ipaddress.IPv6Address(text))
    except ValueError:
        return False


def triggers() -> tuple:
    """What a text must hold for a name to be found: titles or given names, and in lower case what introduces one."""
    cache = worker_cache("pii")
    if "pii triggers" not in cache:
        import ahocorasick

        titles = ["M. ", *(t + end for ts in TITLES.values() for t in ts for end in (" ", "."))]
        found = []
        for words in ([*titles, *(t.upper() for t in titles), *(n for ns in GIVEN.values() for n in ns), *(n.upper() for n in LISTED)], INTRODUCING):
            one = ahocorasick.Automaton()
            for w in words:
                one.add_word(w, True)
            one.make_automaton()
            found.append(one)
        cache["pii triggers"] = tuple(found)
    return cache["pii triggers"]


def people(text: str, found: Spans) -> None:
    known: dict[str, str] = {}  # lower-cased

    def name(m: re.Match, groups: tuple[int, ...]) -> None:
        parts = [g for g in groups if m.group(g)]
        for i, g in enumerate(parts):
            low = m.group(g).lower()
            kind = "given" if i < len(parts) - 1 or low in LISTED else "surname"
            found.add(*m.span(g), kind)
            known.setdefault(low, kind)

    cased, cues = (next(x.iter(t), None) is not None for x, t in zip(triggers(), (text, text.lower())))
    for form in (TITLED, NAMED) * cased + (INTRODUCED,) * cues:
        for m in form.finditer(text):
            if m[1] != m[2]:
                name(m, (1, 2))
    for m in SHOUTED.finditer(text) if cased else ():
        name(m, (1, 2) if m[1] else (3, 4))
    for _ in range(2):  # to those before a known one, and after
        for m in JOINED.finditer(text) if known else ():
            for one, two in (((1, 2), (3, 4)), ((3, 4), (1, 2))):
                if all(m[g].lower() in known for g in one) and m[two[0]] != m[two[1]]:
                    name(m, two)
    for m in ALONE.finditer(text) if cased else ():
        name(m, (1,))
    for m in BESIDE.finditer(text) if known else ():
        if m[1].lower() in known and m[2].lower() not in NO_NAMES and m[1] != m[2] and text[m.end(1) : m.start(2)].count(" ") < 4:
            name(m, (1, 2))
    for m in CAPITALISED.finditer(text) if known else ():  # later mentions of a name alone
        if m.group().lower() in known:
            found.add(*m.span(), known[m.group().lower()])
    if not text.isascii() and UNCASED.search(text):
        for form in OTHERS:
            for m in form.finditer(text):
                name(m, (1, 2) if form.groups > 1 else (1,))


def key_of(spark: SparkSession) -> bytes:
    """The key that KEY_SETTING has, or a random one of this application."""
    own = spark.conf.get(KEY_SETTING, None)
    return own.encode() if own else random_key(spark.sparkContext.applicationId)


@lru_cache(None)
def random_key(application: str) -> bytes:
    return secrets.token_bytes(32)


def surrogate(text: str | None, key: bytes) -> tuple[str | None, list[tuple[int, int, str]]]:
    """The text with surrogates, and what was found in the given one."""
    if not text:
        return text, []
    found = entities(text)
    if not found:
        return text, found
    out, at = [], 0
    for a, b, kind in found:
        out += [text[at:a], MAKE[kind](text[a:b], key + (b"name" if kind in ("given", "surname") else kind.encode()))]
        at = b
    return "".join(out) + text[at:], found


def anonymised(docs: DataFrame, key: bytes, text: str = "text", spans: str | None = None) -> DataFrame:
    """docs with surrogates in its texts, and if named so a column spans: kind:start:end of each entity in the old text, comma-joined.

    Null and empty texts stay as they are, and texts of any length are treated
    whole; every row is treated alike, whatever else its table has, repeated ones
    too; an empty table stays empty.  All columns stay, and a column n_chars is
    set to the new text's length.  A key of less than KEY_BYTES is refused.
    """
    if len(key) < KEY_BYTES:
        raise ValueError(f"the key has less than {KEY_BYTES} bytes; set {KEY_SETTING}")
    names = docs.columns
    schema = docs.select(*[F.col(f"`{c}`").cast("string").alias(c) if c == text else F.col(f"`{c}`") for c in names])
    name = spans or fresh(docs, "spans_")[0]
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            made = [surrogate(x.as_py(), key) for x in b.column(at)]
            cols = b.columns
            cols[at] = pa.array([t for t, _ in made], pa.string())
            cols.append(pa.array([",".join(f"{k}:{a}:{e}" for a, e, k in f) for _, f in made], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=[*names, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.schema)
    out = schema.mapInArrow(run, f"{fields}, `{name}` string")
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.coalesce(F.length(text).cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return out if spans else out.drop(name)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = anonymised(docs, key_of(spark), spans="entities")
    return out.withColumn("n_entities", F.when(F.col("entities") == "", 0).otherwise(F.size(F.split("entities", ","))).cast("long"))
