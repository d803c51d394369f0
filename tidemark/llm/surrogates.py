"""Personal data replaced by keyed surrogates of the same type and format.

An entity is brought to one form (digits of a number, lower case of an address), which a keyed permutation of
all strings of its format maps to another: the same entity gets the same surrogate wherever and however it is
written, and different entities of a format get different ones. Card numbers and IBANs keep valid check
digits, addresses stay in their space, capitals, script and separators stay where the mention has them.
Persons get names of the same gender and script, each of their names one of its own, so that who shares a name
still does; a limited stock can make names collide, so the surrogates of all distinct entities and names of the
corpus are compared with each other and with the entities themselves, and whatever shares one gets the next.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import FILE, ROW

# Titles and stocks of given names by gender, and syllables of family names, by script.
TITLES = {
    "f": ("Mrs", "Ms", "Miss", "Madam", "Frau", "Mme", "Mlle", "Madame", "Sra", "Señora", "Srta", "Signora", "госпожа", "Госпожа"),
    "m": ("Mr", "Sir", "Herr", "Herrn", "Monsieur", "Sr", "Señor", "Signor", "господин", "Господин"),
    "n": ("Dr", "Prof", "Mx"),
}
GIVEN = {
    ("latin", "f"): ("Alma", "Bella", "Carla", "Delia", "Edda", "Flora", "Gemma", "Hilda", "Irma", "Juna", "Kara", "Lena", "Mona", "Nora", "Olga", "Petra", "Rhea", "Selma", "Tilda", "Vera"),
    ("latin", "m"): ("Aldo", "Bruno", "Carlo", "Dario", "Egon", "Felix", "Gino", "Hugo", "Ivo", "Jonas", "Kurt", "Leo", "Marco", "Nils", "Otto", "Paolo", "Remo", "Sven", "Timo", "Viktor"),
    ("latin", "n"): ("Alexis", "Andrea", "Casey", "Dana", "Eden", "Jody", "Kim", "Luca", "Noa", "Robin", "Sascha", "Toni"),
    ("cyrillic", "f"): ("Алла", "Вера", "Галина", "Дарья", "Елена", "Зоя", "Инна", "Лидия", "Нина", "Ольга", "Раиса", "Тамара"),
    ("cyrillic", "m"): ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Лев", "Матвей", "Олег", "Роман"),
    ("cyrillic", "n"): ("Саша", "Женя", "Валя", "Слава"),
}
SYLLABLES = {
    "latin": ("ba", "be", "bo", "da", "del", "dor", "fa", "fen", "ga", "gar", "hal", "hol", "ka", "kel", "kor", "la", "lin", "lor", "ma", "mer", "mon", "na", "nel", "nor", "pa", "pel", "ra", "ren", "ros", "sa", "sel", "sor", "ta", "ten", "tor", "va", "vel", "vor", "wal", "win"),
    "cyrillic": ("ба", "бе", "бо", "ва", "вел", "га", "гор", "да", "ден", "дор", "за", "ка", "кел", "кор", "ла", "лен", "лор", "ма", "мер", "на", "нел", "нор", "па", "рен", "рос", "са", "сел", "та", "тор", "ян"),
}
#: Bytes of the key that names may come from: neither digits nor letters of other scripts are changed into them.
LOWER, DIGITS, HEX, BASE32 = "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_NAME = r"[^\W\d_a-zа-я]\w*[^\W\d_]"
PATTERNS: list[tuple[str, re.Pattern]] = [
    ("email", re.compile(r"@")),  # the address is read from here to both sides, see _address
    ("token", re.compile(r"(?<![A-Za-z0-9])(gh[pousr]_|github_pat_|sk-|xox[abprs]-|AIza)([A-Za-z0-9_-]{16,})")),
    ("key", re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])")),
    ("secret", re.compile(r"""(?i)(?<!\w)(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key)\s{0,3}[:=]\s{0,3}["']?([A-Za-z0-9+/_.-]{12,}[A-Za-z0-9+/_-])""")),
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")),
    ("ip", re.compile(rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.\d)")),
    ("ip6", re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])")),
    ("card", re.compile(r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w-])")),
    ("birth", re.compile(r"(?i)(?<!\w)(?:born(?: on)?|date of birth|birth ?date|dob|geboren(?: am)?|née? le|naissance)\s{0,3}[:=]?\s{0,3}(\d{4}-\d{2}-\d{2}|\d{2}[./]\d{2}[./]\d{4})(?!\w)")),
    ("street", re.compile(r"(?<![\w.,])(\d{1,5} [A-Z][a-z]{2,20})(?= (?:Street|St\.|Avenue|Ave\.|Road|Rd\.|Lane|Drive|Boulevard|Blvd\.|Court)(?!\w))")),
    ("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")),
    ("phone", re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w)")),
    ("person", re.compile(rf"(?<!\w)(?P<title>{'|'.join(t for g in TITLES.values() for t in sorted(g, key=len, reverse=True))})\.?[ ](?P<name>{_NAME}(?:[ -]{_NAME}){{0,2}})")),
]
#: Characters of an IBAN by country, from the public registry.
IBAN_LENGTHS = {c: n for n, codes in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}.items() for c in codes.split()}
_DIGIT = re.compile(r"[0-9]")
_TITLE = re.compile("|".join(sorted({t[:2] for g in TITLES.values() for t in g})))
#: Whether a text can hold what a pattern finds: cheap tests that most texts fail.
_HINTS: dict[str, Callable[[str, bool], object]] = {
    "email": lambda t, digit: "@" in t,
    "key": lambda t, digit: "AKIA" in t or "ASIA" in t,
    "token": lambda t, digit: "gh" in t or "sk-" in t or "xox" in t or "AIza" in t,
    "secret": lambda t, digit: "=" in t or ":" in t,
    "ip6": lambda t, digit: ":" in t,
    "person": lambda t, digit: _TITLE.search(t),
}
_ANY_DIGIT = re.compile(r"\d")
#: Characters of at most 36 values each that fit into two draws of 128 bits.
PIECE = 48


def _digits(text: str, digit: bool) -> bool:
    return digit


_CAPITALS = re.compile(rf"(?<!\w){_NAME}(?!\w)(?:[ -]{_NAME}(?!\w))*")
_TITLE_GENDER = {t: g for g, titles in TITLES.items() for t in titles}


_LOCAL = re.compile(r"[\w.+%-]{0,63}\w\Z")
_DOMAIN = re.compile(r"(?:[^\W_](?:[\w-]{0,61}[^\W_])?\.)+[^\W\d_]{2,24}(?![\w@])")


def _address(text: str, at: int) -> tuple[str, int, int] | None:
    """The address around the sign at a place: at most 64 characters before it and 255 behind, as the standards have it."""
    before = _LOCAL.search(text[max(0, at - 64) : at])
    behind = _DOMAIN.match(text[at + 1 : at + 258])
    if not before or not behind:
        return None
    local = before.group().lstrip("._%+-")
    return f"{local}@{behind.group()}".lower(), at - len(local), at + 1 + behind.end()


def luhn(digits: str) -> int:
    """The check digit that makes digits plus it valid."""
    total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits))))
    return -total % 10


def mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def _draw(key: bytes, *parts: object) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(map(str, parts)).encode(), key=key, digest_size=16).digest(), "big")


def permuted(key: bytes, tweak: str, value: int, size: int) -> int:
    """A keyed permutation of range(size) that leaves no value in its place: a step in a keyed order."""
    if size < 2:
        return value
    step = 1 + _draw(key, tweak, "step") % (size - 1)
    return _feistel(key, tweak, (_feistel(key, tweak, value, size) + step) % size, size, back=True)


def _feistel(key: bytes, tweak: str, value: int, size: int, back: bool = False) -> int:
    """A Feistel network over enough bits, walked until it is in range, or its inverse."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        a, b = value >> half, value & mask
        for i in reversed(range(8)) if back else range(8):
            if back:
                a, b = b ^ (_draw(key, tweak, i, a) & mask), a
            else:
                a, b = b, a ^ (_draw(key, tweak, i, b) & mask)
        value = a << half | b
        if value < size:
            return value


def permuted_text(key: bytes, tweak: str, text: str, alphabets: list[str]) -> str:
    """A keyed permutation of the strings whose characters come from these alphabets, place by place.

    A draw covers half of a piece of PIECE characters, so longer strings are permuted in pieces: each piece under all
    that come before it, then each under all that come after it.
    """
    if len(text) > PIECE:
        cuts = range(0, len(text), PIECE)
        pieces = [text[i : i + PIECE] for i in cuts]
        for turn, order in enumerate((range(len(pieces)), reversed(range(len(pieces))))):
            seen = hashlib.blake2b(f"{tweak}:{turn}".encode(), key=key, digest_size=16)
            for i in order:
                said, under = pieces[i], f"{tweak}:{turn}:{i}:{seen.hexdigest()}"
                pieces[i] = permuted_text(key, under, said, alphabets[cuts[i] : cuts[i] + PIECE])
                seen.update(said.encode())
        return "".join(pieces)
    value, size = 0, 1
    for c, a in zip(text, alphabets, strict=True):
        value, size = value * len(a) + a.index(c), size * len(a)
    value = permuted(key, tweak, value, size)
    out = []
    for a in reversed(alphabets):
        value, i = divmod(value, len(a))
        out.append(a[i])
    return "".join(reversed(out))


def _kept(key: bytes, tweak: str, text: str) -> str:
    """text with its letters a to z and digits permuted, everything else kept; other scripts' letters move within their block."""
    places, alphabets = [], []
    for i, c in enumerate(text):
        if c in LOWER:
            alphabet = LOWER
        elif c in DIGITS:
            alphabet = DIGITS
        elif c.isalpha():
            block = ord(c) & ~0x1F
            alphabet = "".join(x for x in map(chr, range(block, block + 32)) if x.isalpha() and x == x.lower())
            if c not in alphabet:
                continue
        else:
            continue
        places.append(i)
        alphabets.append(alphabet)
    moved = permuted_text(key, tweak, "".join(text[i] for i in places), alphabets)
    out = list(text)
    for i, c in zip(places, moved, strict=True):
        out[i] = c
    return "".join(out)


def _ip(key: bytes, tweak: str, text: str) -> str:
    """A public address for a public one, and one of the same private range for a private one."""
    number = int.from_bytes(bytes(map(int, text.split("."))), "big")
    home = lambda n: next((k for k, (lo, hi) in enumerate(_RANGES) if lo <= n <= hi), -1)
    mine = home(number)
    if mine >= 0:
        lo, hi = _RANGES[mine]
        number = lo + permuted(key, tweak, number - lo, hi - lo + 1)
    else:
        number = permuted(key, tweak, number, 1 << 32)
        while home(number) >= 0:
            number = permuted(key, tweak, number, 1 << 32)
    return ".".join(map(str, number.to_bytes(4, "big")))


_RANGES = [(0x00000000, 0x00FFFFFF), (0x0A000000, 0x0AFFFFFF), (0x7F000000, 0x7FFFFFFF), (0xA9FE0000, 0xA9FEFFFF), (0xAC100000, 0xAC1FFFFF), (0xC0A80000, 0xC0A8FFFF), (0xE0000000, 0xFFFFFFFF)]


def script(name: str) -> str:
    return "cyrillic" if any("Ѐ" <= c <= "ӿ" for c in name) else "latin"


def _family(key: bytes, tweak: str, name: str) -> str:
    n = _draw(key, tweak, name)
    stock = SYLLABLES[script(name)]
    parts = []
    for k in range(3 + n % 2 + int(tweak.split(":")[1])):  # longer with each attempt, so that the stock grows
        if k and k % 12 == 0:
            n = _draw(key, tweak, name, k)
        n, i = divmod(n >> 3, len(stock))
        parts.append(stock[i])
    return "".join(parts).capitalize()


def _given(key: bytes, tweak: str, gender: str, name: str) -> str:
    """A given name of the gender and script: of the stock at the first attempt, then made of syllables, longer each time."""
    stock, attempt = GIVEN[script(name), gender], int(tweak.split(":")[1])
    if not attempt:
        return stock[_draw(key, tweak, gender, name) % len(stock)]
    ends = {"latin": {"f": "a", "m": "o", "n": "i"}, "cyrillic": {"f": "а", "m": "", "n": "и"}}
    return _family(key, tweak, f"{gender} {name}").removesuffix("a").removesuffix("а") + ends[script(name)][gender]


def _birth(key: bytes, tweak: str, iso: str) -> str:
    """Another day within the same twenty years."""
    year, month, day = map(int, iso.split("-"))
    first = year - year % 20
    n = permuted(key, f"{tweak}:{first}", ((year - first) * 12 + month - 1) * 31 + day - 1, 20 * 12 * 31)
    while n % 31 > 27:  # days that all months have
        n = permuted(key, f"{tweak}:{first}", n, 20 * 12 * 31)
    return f"{first + n // 372:04d}-{n % 372 // 31 + 1:02d}-{n % 31 + 1:02d}"


def names_of(entity: str) -> list[tuple[str, str]]:
    """(kind, entity) of each name of a person: given names with the gender, and the family name."""
    gender, *names = entity.split(" ")
    return [*(("given", f"{gender} {n}") for n in names[:-1]), ("family", names[-1])]


def person(entity: str, of: Callable[[str, str], str]) -> str:
    """A person named by the surrogates of their names, so all who share a name still do."""
    return " ".join([entity[0], *(of(k, e) for k, e in names_of(entity))])


def surrogate(key: bytes, kind: str, entity: str, attempt: int = 0) -> str:
    """What stands for entity, never entity itself; attempt 0 unless others share its surrogate.

    A person is named by the surrogates of their names; of a text without a letter or digit nothing can be changed.
    """
    extra = 0
    while True:
        out = _surrogate(key, kind, entity, f"{kind}:{attempt}:{extra}")
        if out != entity or not any(c.isalnum() for c in entity):
            return out
        extra += 1


def _surrogate(key: bytes, kind: str, entity: str, tweak: str) -> str:
    if kind == "email":
        local, domain = entity.rsplit("@", 1)
        host, _, top = domain.rpartition(".")
        return f"{_kept(key, tweak + 'local', local)}@{_kept(key, tweak.split(':')[0] + 'host', host)}.{top}"
    if kind == "key":
        return entity[:4] + permuted_text(key, tweak, entity[4:], [BASE32 + "0189"] * (len(entity) - 4))
    if kind == "secret":
        plain = set(entity) <= set(HEX)
        return permuted_text(key, tweak, entity, [HEX] * len(entity)) if plain else _kept(key, tweak, entity)
    if kind == "card":
        body = entity[0] + permuted_text(key, tweak, entity[1:-1], [DIGITS] * (len(entity) - 2))
        return body + str(luhn(body))
    if kind == "iban":
        body = permuted_text(key, tweak, entity[4:], [DIGITS if c.isdigit() else BASE32[:26] for c in entity[4:]])
        return f"{entity[:2]}{98 - mod97(body + entity[:2] + '00'):02d}{body}"
    if kind == "ip":
        return _ip(key, tweak, entity)
    if kind == "ip6":
        return permuted_text(key, tweak, entity.replace(":", ""), [HEX] * (len(entity) - 7))
    if kind == "phone":  # country code and, in its plan, the group after the area stay
        head, body = entity.split(":")
        return f"{head}:{permuted_text(key, tweak, body, [DIGITS] * len(body))}"
    if kind == "person":  # "gender name name ..." by the names' own surrogates
        return person(entity, lambda k, e: surrogate(key, k, e))
    if kind == "family":
        return _family(key, tweak, entity)
    if kind == "given":
        return _given(key, tweak, *entity.split(" "))
    if kind == "birth":
        return _birth(key, tweak, entity)
    if kind == "street":
        number, name = entity.split(" ")
        return f"{permuted_text(key, tweak, number, ['123456789', *[DIGITS] * (len(number) - 1)] if number[0] != '0' else [DIGITS] * len(number))} {_family(key, tweak, name)}"
    if kind == "token":
        head = next(h for h in ("github_pat_", "aiza", "sk-", entity[:5] if entity.startswith("xox") else entity[:4]) if entity.startswith(h))
        return head + _kept(key, tweak, entity[len(head) :])
    return permuted_text(key, tweak, entity, [DIGITS] * len(entity))


def _card(said: str, start: int) -> tuple[str, int, int] | None:
    """The longest run of whole groups of said that has 13 to 19 digits with a valid check digit."""
    digits, end = "", 0
    plain, twice = [0, 0], [0, 0]  # sums of the digits at even and odd places, as they are and doubled
    for i, c in enumerate(said):
        if c in " -":
            continue
        d, odd = int(c), len(digits) % 2
        plain[odd] += d
        twice[odd] += 2 * d - 9 if d > 4 else 2 * d
        digits += c
        odd = len(digits) % 2
        if 13 <= len(digits) <= 19 and (i + 1 == len(said) or said[i + 1] in " -") and (twice[odd] + plain[1 - odd]) % 10 == 0:
            end = i + 1
    entity = re.sub("[ -]", "", said[:end])
    return (entity, start, start + end) if len(set(entity)) > 1 else None


def _found(kind: str, pattern: re.Pattern, text: str) -> Iterator[tuple[str, int, int]]:
    """The mentions of a kind. Checked numbers can end before their match does, or start behind its first group."""
    at = 0
    while m := pattern.search(text, at):
        got = _entity(kind, m)
        if got:
            yield got
        gap = re.search("[ -]", m.group()) if kind in ("card", "iban") and not got else None
        at = m.start() + gap.end() if gap else got[2] if got and kind in ("card", "iban") else m.end()


def _entity(kind: str, m: re.Match) -> tuple[str, int, int] | None:
    """The one form of a mention and the part of the text that it is, or None if it is none after all."""
    start, end = (m.span(1) if kind == "secret" else m.span("name") if kind == "person" else m.span())
    said = m.string[start:end]
    if kind == "email":
        return _address(m.string, m.start())
    if kind == "birth":
        parts = re.split("[-./]", m.group(1))
        year, month, day = parts if len(parts[0]) == 4 else (parts[2], parts[1], parts[0])
        if int(month) > 12:  # month first
            month, day = day, month
        fine = 1 <= int(month) <= 12 and 1 <= int(day) <= 31
        return (f"{year}-{month}-{day}", *m.span(1)) if fine else None
    if kind == "street":
        return m.group(1), *m.span(1)
    if kind == "token":
        return m.group().lower(), start, end
    if kind == "card":
        return _card(said, start)
    if kind == "iban":
        ends = [len(said), *(i for i in range(len(said) - 1, 0, -1) if said[i] in " -")]
        parts = [(re.sub("[ -]", "", said[:i]), start, start + i) for i in ends]
        parts.sort(key=lambda x: len(x[0]) != IBAN_LENGTHS.get(said[:2]))  # the length of the country first
        return next((x for x in parts if 15 <= len(x[0]) <= 34 and mod97(x[0][4:] + x[0][:4]) == 1), None)
    if kind == "secret":
        return (said.lower(), start, end) if any(c.isdigit() for c in said) or len(said) >= 16 else None
    if kind == "phone":
        digits = re.sub(r"\D", "", said)
        head = re.match(r"\+\d{1,3}(?=\D)|\+\d", said)
        head = head.group()[1:] if head else ""
        return (f"{head}:{digits[len(head):]}", start, end) if 7 <= len(digits) <= 15 else None
    if kind == "ssn":
        return said.replace("-", ""), start, end
    if kind == "person":
        return f"{_TITLE_GENDER[m.group('title')]} {' '.join(_names(said))}", start, end
    return (said.lower() if kind == "ip6" else said), start, end


def _names(said: str) -> list[str]:
    """The names of a person in one case."""
    return [n.casefold().capitalize() for n in re.split("[ -]", said)]


def _as_said(kind: str, new: str, said: str, entity: str) -> str:
    """A surrogate in the spelling of a mention: its separators, its capitals and, of a person, the names that it has."""
    if kind in ("card", "ssn", "phone", "iban", "ip6"):
        symbols = iter(new.replace(":", ""))
        new = "".join(next(symbols) if c.isalnum() else c for c in said)
    elif kind == "person":
        seps = re.findall("[ -]", said)
        part, whole = _names(said), entity.split(" ")[1:]
        at = next((i for i in range(len(whole)) if whole[i : i + len(part)] == part), 0)
        names = new.split(" ")[1:][at : at + len(part)]
        new = "".join(n + s for n, s in zip(names, [*seps, ""], strict=True))
        return new.upper() if said.isupper() and len(said) > 1 else new
    elif kind == "birth":
        year, month, day = new.split("-")
        if "-" not in said:
            sep = said[2]
            new = sep.join((month, day, year) if said[:2] == entity[5:7] and said[:2] != said[3:5] else (day, month, year))
    if kind in ("email", "secret", "token", "ip6") and len(new) == len(said):
        new = "".join(n.upper() if c.isupper() else n for n, c in zip(new, said, strict=True))
    return new


def mentions(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, entity) of what stands for a person or their property, in order, without overlaps."""
    found: list[tuple[int, int, str, str]] = []
    starts: list[int] = []
    digit = bool(_DIGIT.search(text)) or not text.isascii() and bool(_ANY_DIGIT.search(text))
    for kind, pattern in PATTERNS:
        if not _HINTS.get(kind, _digits)(text, digit):
            continue
        more: list[tuple[int, int, str, str]] = []
        for entity, start, end in _found(kind, pattern, text):
            i = bisect_left(starts, end)  # the last one found before that starts ahead of its end
            if not (i and found[i - 1][1] > start or more and more[-1][1] > start):
                more.append((start, end, kind, entity))
        if more:
            found = sorted(found + more)
            starts = [f[0] for f in found]
    return _with_untitled(text, found) if any(f[2] == "person" for f in found) else found


def _gender(genders: set[str]) -> str:
    """The gender that titles tell, neutral where they tell none or both."""
    told = genders - {"n"}
    return told.pop() if len(told) == 1 else "n"


def _with_untitled(text: str, found: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """found, each person with one gender, and the other mentions of these persons by all or some of their names.

    Names that several persons have mean one who is called just so, or else the last one named before.
    """
    genders: dict[str, set[str]] = {}
    for _, _, kind, entity in found:
        if kind == "person":
            genders.setdefault(entity[2:], set()).add(entity[0])
    one = {name: f"{_gender(g)} {name}" for name, g in genders.items()}
    found = [(a, b, k, one[e[2:]] if k == "person" else e) for a, b, k, e in found]
    of: dict[tuple[str, ...], str] = {}

    def name(entity: str) -> None:
        names = entity[2:].split(" ")
        for i in range(len(names)):
            for j in range(i + 1, len(names) + 1):
                of[tuple(names[i:j])] = one.get(" ".join(names[i:j]), entity)

    for f in reversed(found):  # before a person is named, the first one counts
        if f[2] == "person":
            name(f[3])
    out, k = [], 0
    for run in _CAPITALS.finditer(text):
        words = [(m.start() + run.start(), m.end() + run.start()) for m in re.finditer(r"[^ -]+", run.group())]
        i = 0
        while i < len(words):
            while k < len(found) and found[k][1] <= words[i][0]:
                if found[k][2] == "person":
                    name(found[k][3])
                k += 1
            for j in range(min(i + 3, len(words)), i, -1):
                start, end = words[i][0], words[j - 1][1]
                entity = of.get(tuple(_names(text[start:end])))
                if entity and (k == len(found) or end <= found[k][0]):
                    out.append((start, end, "person", entity))
                    i = j - 1
                    break
            i += 1
    return sorted(found + out)


def replaced(text: str, of: Callable[[str, str], str]) -> tuple[str, int]:
    """The text with each mention replaced by of(kind, entity), and the number of mentions."""
    found = mentions(text)
    if not found:
        return text, 0
    out, at = [], 0
    for start, end, kind, entity in found:
        out += [text[at:start], _as_said(kind, of(kind, entity), text[start:end], entity)]
        at = end
    return "".join([*out, text[at:]]), len(found)


@lru_cache(maxsize=50_000)
def _cached(key: bytes, kind: str, entity: str, attempt: int) -> str:
    return surrogate(key, kind, entity, attempt)


#: Attempts in which a surrogate that is an entity of the texts itself is passed over; formats may be used up.
AVOID = 16


def attempts(entities: DataFrame, key: bytes) -> DataFrame:
    """kind, entity, attempt of those entities (kind, entity) whose first surrogates others share or the texts hold.

    Of the entities that share a surrogate, the least keeps it and the others take their next, until all
    surrogates differ as they are written; those that stand in the texts as entities are passed over AVOID
    times. Permutations share none, and the stock of names grows with the attempts, so this ends. Only the entities
    are compared, in a table of one row each.
    """

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [_cached(key, k, e, a) for k, e, a in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=["kind", "entity", "attempt", "new"])

    written_as = F.when(F.col("kind") == "given", F.expr("substr(entity, 3)")).otherwise(F.col("entity"))
    real = common.written(entities.select("kind", written_as.alias("new"), F.lit(True).alias("real")).distinct(), "pii-real")
    table = common.written(entities.withColumn("attempt", F.lit(0)), "pii-entities")
    while True:
        new = common.written(table.select("kind", "entity", "attempt").mapInArrow(named, "kind string, entity string, attempt int, new string"), "pii-surrogates")
        first = new.groupBy("kind", "new").agg(F.min(F.struct("attempt", "entity")).alias("first"), F.count(F.lit(1)).alias("n"))
        first = first.join(real, ["kind", "new"], "left").filter("n > 1 OR real AND first.attempt < " + str(AVOID))
        late = new.join(first, ["kind", "new"]).filter(f"entity <> first.entity OR real AND attempt < {AVOID}").select("kind", "entity", F.lit(1).alias("late"))
        late = common.written(late, "pii-late")
        if late.isEmpty():
            break
        before, table = table, common.written(new.drop("new").join(late, ["kind", "entity"], "left").select("kind", "entity", (F.col("attempt") + F.coalesce("late", F.lit(0))).alias("attempt")), "pii-entities")
        common.discard(table.sparkSession, before, new, late)
    common.discard(table.sparkSession, real, new, late)
    return table.filter("attempt > 0")


def _otherwise(entities: DataFrame, key: bytes) -> DataFrame:
    """kind, entity, of, meant, attempt: what the texts' entities need that are not replaced by their own first surrogates.

    Where of is the kind, meant is a person with the gender that the titles of all texts tell, and attempt that of any
    other entity; else they are a name of the person and its attempt.
    """
    person = F.col("kind") == "person"
    entities = common.written(entities.withColumn("name", F.when(person, F.expr("substr(entity, 3)")).otherwise(F.col("entity"))), "pii-named")
    told = lambda g: F.max(F.when(person, F.col("entity").startswith(f"{g} ")).otherwise(False))
    by = entities.groupBy("kind", "name").agg(told("m").alias("m"), told("f").alias("f"))
    gender = F.when(F.col("m") & ~F.col("f"), "m").when(F.col("f") & ~F.col("m"), "f").otherwise("n")
    by = common.written(by.select("kind", "name", F.when(person, F.concat_ws(" ", gender, "name")).otherwise(F.col("name")).alias("meant")), "pii-meant")
    # persons are told apart by their names, each of which has a surrogate of its own
    names = F.split(F.expr("substr(meant, 3)"), " ")
    given = by.filter(person).select(F.lit("given").alias("kind"), F.explode(F.transform(F.slice(names, 1, F.size(names) - 1), lambda n: F.concat_ws(" ", F.substring("meant", 1, 1), n))).alias("entity"))
    family = by.filter(person).select(F.lit("family").alias("kind"), F.element_at(names, -1).alias("entity"))
    parts = by.filter(~person).select("kind", F.col("meant").alias("entity")).unionByName(given).unionByName(family).distinct()
    late = common.written(attempts(parts, key), "pii-attempts")
    every = entities.join(by, ["kind", "name"]).join(late.withColumnRenamed("entity", "meant"), ["kind", "meant"], "left")
    own = every.select("kind", "entity", "meant", F.coalesce("attempt", F.lit(0)).alias("attempt")).filter("entity <> meant OR attempt > 0")
    # what the names of a person need comes with the person
    persons = by.filter(person).select("meant", F.explode(F.array_union(F.transform(F.slice(names, 1, F.size(names) - 1), lambda n: F.struct(F.lit("given").alias("kind"), F.concat_ws(" ", F.substring("meant", 1, 1), n).alias("entity"))), F.array(F.struct(F.lit("family").alias("kind"), F.element_at(names, -1).alias("entity"))))).alias("part")).select("meant", "part.*")
    needed = persons.join(late, ["kind", "entity"]).select("meant", F.col("kind").alias("part_kind"), F.col("entity").alias("part"), "attempt")
    said = every.filter(person).select("entity", "meant")
    more = said.join(needed, "meant").select(F.lit("person").alias("kind"), "entity", F.col("part_kind").alias("of"), F.col("part").alias("meant"), "attempt")
    return own.withColumn("of", F.col("kind")).unionByName(more)


def _needs(rows: list[dict]) -> tuple[dict, dict]:
    """What _otherwise tells for one text: (kind, entity) to (meant, attempt), and names to their attempts."""
    own = {(x["kind"], x["entity"]): (x["meant"], x["attempt"]) for x in rows if x["of"] == x["kind"]}
    return own, {(x["of"], x["meant"]): x["attempt"] for x in rows if x["of"] != x["kind"]}


def _meant(key: bytes, kind: str, entity: str, own: dict, names: dict) -> str:
    """The surrogate of an entity of a text."""
    entity, attempt = own.get((kind, entity), (entity, 0))
    if kind == "person":
        return person(entity, lambda k, e: _cached(key, k, e, names.get((k, e), 0)))
    return _cached(key, kind, entity, attempt)


def surrogate_texts(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id column, n_entities and text (with surrogates; unchanged where nothing is found) for each row of docs.

    key is the secret of the data's owner: who has it can tell what stands for what. A null text stays null and has
    no entities. Repeated rows are treated alike; an empty table gives no rows; other columns, whatever their names,
    are ignored. Addresses, phone, card, account, social security and IP numbers, keys, access tokens and passwords
    behind their names, dates of birth and numbers of streets behind or before the words for them, and persons behind
    a title are found, with all other mentions in the same text of their names or parts of them; numbers of card length
    without a valid check digit are left alone. Long texts are taken whole: each pattern reads a text once, and what
    an address is has the lengths of the standards.
    """
    kind_of = docs.schema[id_col].dataType.simpleString()
    rows = common.located(docs).select(common.of_input(id_col).alias("id"), common.of_input(text_col).alias("text"), FILE, ROW)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(f, r, k, e) for t, f, r in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True) for k, e in {(m[2], m[3]) for m in mentions(t.as_py() or "")}]
            columns = list(zip(*found, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], names=[FILE, ROW, "kind", "entity"])

    held = rows.select("text", FILE, ROW).mapInArrow(listed, f"{FILE} string, {ROW} long, kind string, entity string")
    held = common.written(held, "pii-held")
    others = common.written(_otherwise(held.select("kind", "entity").distinct(), key), "pii-others")
    plain = others.isEmpty()

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 64):
                part = b.slice(at, 64)
                more = [_needs(r or ()) for r in part.column(2).to_pylist()] if part.num_columns > 2 else [({}, {})] * len(part)
                out = [(None, 0) if t.as_py() is None else replaced(t.as_py(), lambda k, e, m=m: _meant(key, k, e, *m)) for t, m in zip(part.column(1), more, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for _, n in out], pa.int64()), pa.array([t for t, _ in out], pa.string())], names=["id", "n_entities", "text"])

    schema = f"id {kind_of}, n_entities long, text string"
    if plain:
        out = rows.select("id", "text").mapInArrow(renamed, schema)
    else:
        per_row = held.join(others, ["kind", "entity"]).groupBy(FILE, ROW).agg(F.collect_set(F.struct("kind", "entity", "of", "meant", "attempt")).alias("more"))
        out = rows.join(per_row, [FILE, ROW], "left").select("id", "text", "more").mapInArrow(renamed, schema)
    return out.withColumnsRenamed({"id": id_col, "text": text_col})
