"""Personal data and secrets replaced by surrogates of the same kind.

Surrogates come from keyed permutations of all strings of an entity's own format (its letters, digits and signs, place
by place), so the same entity gets the same surrogate in every document, and two entities never get one: what would be a
collision check over all documents holds by construction, without a shuffle. That goes for names word by word: those of
lists by gender and script are exchanged within their list, all others are permuted past what the lists give.
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

from barquill.llm.names import others, unused

# Given names by script and gender; none is in two lists.
GIVEN = {
    ("latin", "f"): "Agnes Alice Alma Anna Anne Barbara Carmen Clara Edith Elena Elizabeth Emma Erika Eva Greta Hannah Helen Irene Jane Jennifer Julia Karen Laura Linda Lucía Margaret María Marie Marta Mary Nora Patricia Paula Rosa Sarah Sofia Susan Teresa Ursula".split(),
    ("latin", "m"): "Adam Alan Antonio Brian Bruno Carlos Charles Daniel David Emil Felix Francisco George Hans Henry Hugo Jack James John Jonas José Juan Karl Leon Luis Mark Martin Michael Miguel Oscar Paul Pedro Peter Pierre Robert Thomas Walter William".split(),
    ("latin", "n"): "Alex Andrea Chris Eden Jean Kim Noel Robin Sam Sasha Toni Yael".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Ирина Лидия Мария Нина Ольга Раиса Софья".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Иван Леонид Макар Никита Олег Павел Пётр Сергей".split(),
    ("greek", "f"): "Άννα Δήμητρα Ειρήνη Ελένη Ζωή Θάλεια Ιωάννα Κλειώ Λυδία Μαρία Σοφία Χλόη".split(),
    ("greek", "m"): "Άρης Γιώργος Δημήτρης Ηλίας Θωμάς Κώστας Λεωνίδας Μάρκος Νίκος Πέτρος Σταύρος Φίλιππος".split(),
}
# Titles before a name.
TITLES = (
    "Mrs Ms Miss Mme Madame Mademoiselle Frau Señora Señorita Sra Srta Signora Lady г-жа госпожа κυρία "
    "Mr Mister Monsieur Herr Señor Sr Signor Sir г-н господин κύριος Dr Prof Professor Doctor доктор профессор"
).split()
_TITLES = "|".join(sorted(TITLES, key=len, reverse=True))
# What stands in lower case between or before the words of a name, and what follows it.
PARTICLES = "van von vom der den de del della delle dei degli di da das dos do du des la le las los lo al el bin ibn bint ben abu zu zum zur ter ten te tot af av y e".split()
SUFFIXES = "Jr Jnr Sr II III IV PhD MD Esq".split()
_SMALL = "".join(c for c in map(chr, range(0x80, 0x3000)) if c.islower())
_SPACE, _LETTER, _CAPITAL = "[  ]", r"[^\W\d_]", rf"[^\W\d_a-z{_SMALL}]"
_JOINED = rf"(?:[-'’](?![sS](?!\w)){_LETTER}+)"
_WORD = rf"(?:[dl]['’]|[ae]l-)?{_CAPITAL}(?:{_LETTER}+{_JOINED}*|{_JOINED}+)"
_BEFORE = rf"(?:(?:{'|'.join(PARTICLES)}){_SPACE})*"
_INITIALS = rf"{_CAPITAL}\.(?:-?{_CAPITAL}\.)*(?:{_WORD})?|{_CAPITAL}(?={_SPACE}{_BEFORE}{_CAPITAL})"
_END = rf"(?:(?i:{_TITLES})\.?{_SPACE}{_BEFORE}{_CAPITAL}|(?:{'|'.join(SUFFIXES)})(?!\w))"
_UNIT = rf"{_BEFORE}(?!{_END})(?:{_WORD}|{_INITIALS})"
#: Words of a name, as they are exchanged.
_PARTS = re.compile(rf"{_LETTER}+{_JOINED}*")

#: Kinds by name, the one that counts first: a pattern whose group "x", or the whole, is the entity.
PATTERNS = {
    "email": r"(?<![\w.%+-])[A-Za-z0-9_%+-][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,24}(?![\w-])",
    "access_key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)(?P<x>[A-Z0-9]{16})(?![A-Za-z0-9])",
    "api_token": r"(?<![A-Za-z0-9])(?:gh[pousr]_|sk-|pk_live_|sk_live_|xox[abprs]-|AIza|glpat-)(?P<x>[A-Za-z0-9_-]{16,})",
    "secret": r"""(?i)(?<![a-z0-9])(?:password|passwd|pwd|passphrase|secret|client_secret|api[_-]?key|access[_-]?token|auth[_-]?token|token|bearer)["']?\s*[=:]\s*["']?(?P<x>[^\s"',;<>]{6,})""",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![\w.-])[3-6]\d{3}(?:(?P<s>[ -]?)\d{4}(?P=s)\d{4}(?P=s)\d{1,7}|(?P<t>[ -]?)\d{6}(?P=t)\d{5})(?![\w-])",
    "ssn": r"(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "ipv6": r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)",
    "phone": r"(?<![\w.])(?:\+(?P<c>\d{1,3})[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]?\d{3,4}(?![\w-])|(?<![\w.])\+\d{9,14}(?!\w)",
    "name": rf"(?<!\w)(?P<t>(?i:{_TITLES}))\.?{_SPACE}(?P<x>{_UNIT}(?:{_SPACE}{_UNIT})*)",
}
_COMPILED = {k: re.compile(p) for k, p in PATTERNS.items()}
_PREFIXES = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "pk_live_", "sk_live_", "xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-", "AIza", "glpat-")
_DIGIT = re.compile(r"\d").search


def _needed(text: str) -> list[str]:
    """The kinds whose patterns can match in a text: each is left out only if something that its pattern cannot do without is missing."""
    can = dict.fromkeys(("iban", "card", "ssn", "ip", "phone"), _DIGIT(text) is not None)
    can["email"] = "@" in text
    can["access_key"] = "AKIA" in text or "ASIA" in text
    can["api_token"] = any(x in text for x in _PREFIXES)
    can["ipv6"] = text.count(":") >= 7
    can["secret"] = "=" in text or ":" in text
    if can["secret"]:
        folded = text.casefold()  # every character that (?i) takes for one of these letters is folded to it
        can["secret"] = any(x in folded for x in ("pass", "pwd", "secret", "key", "token", "bearer"))
    return [kind for kind in _COMPILED if can.get(kind, True)]


_VOWELS, _CONSONANTS = "aeiouy", "bcdfghjklmnpqrstvwxz"
_CLASSES = [
    "0123456789", "abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω",
    "àáâãäåæçèéêëìíîïñòóôõöøùúûüý",
]


def _low(text: str) -> str:
    """In lower case, character for character."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _classes(text: str, hexadecimal: bool, spoken: bool) -> list[str]:
    """For each character the ones that may stand in its place; an empty string where it stays."""
    out = []
    for c in _low(text):
        if hexadecimal and c in "0123456789abcdef":
            out.append("0123456789abcdef")
        elif spoken and c in _VOWELS + _CONSONANTS:
            out.append(_VOWELS if c in _VOWELS else _CONSONANTS)
        elif c.isdecimal():
            out.append("".join(chr(ord(c) - int(c) + i) for i in range(10)))  # of its own script
        else:
            out.append(next((x for x in _CLASSES if c in x), ""))
    return out


@lru_cache(1 << 16)
def _permuted(value: int, size: int, tweak: str, key: bytes) -> int:
    """A keyed permutation of 0 .. size - 1: a Feistel network on the next even number of bits, walked until in range."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    width = (half + 7) // 8
    while True:
        left, right = value >> half, value & mask
        for i in range(8):
            told = hashlib.blake2b(right.to_bytes(width, "big"), digest_size=max(8, width + 8), key=key, person=b"%d" % i, salt=hashlib.blake2b(f"{tweak} {size}".encode(), digest_size=16).digest())
            left, right = right, left ^ (int.from_bytes(told.digest(), "big") & mask)
        value = left << half | right
        if value < size:
            return value


def permute(text: str, kind: str, key: bytes, ok: Callable[[str], bool] | None = None, hexadecimal: bool = False, spoken: bool = False) -> str:
    """``text`` with letters and digits exchanged, place by place in the same class; capitals stay capitals.

    One to one among texts of one format (and, with ``ok``, among those that agree with ``text`` in it).
    """
    classes = _classes(text, hexadecimal, spoken)
    size, value = 1, 0
    for c, chars in zip(_low(text), classes, strict=True):
        if chars:
            size, value = size * len(chars), value * len(chars) + chars.index(c)
    if size == 1:
        return text
    form = "".join(c if not chars else chr(0x2460 + len(chars)) for c, chars in zip(_low(text), classes, strict=True))
    wanted = ok(text) if ok else True
    while True:
        value = _permuted(value, size, f"{kind} {form}", key)
        rest, out = value, []
        for c, chars in zip(reversed(text), reversed(classes), strict=True):
            if chars:
                rest, place = divmod(rest, len(chars))
                c = chars[place].upper() if c.isupper() else chars[place]
            out.append(c)
        found = "".join(reversed(out))
        if not ok or ok(found) == wanted:
            return found


def luhn(number: str) -> bool:
    digits = [int(c) for c in number if c.isdigit()][::-1]
    return (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0


def _iban_ok(text: str) -> bool:
    bare = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


def _outside(ip: str) -> bool:
    a, b, *_ = map(int, ip.split("."))
    return 0 < a < 224 and a not in (10, 127) and (a, b) not in ((192, 168), (169, 254)) and not (a == 172 and 16 <= b < 32)


def _ip(text: str, key: bytes) -> str:
    value, outside = int.from_bytes(bytes(map(int, text.split("."))), "big"), _outside(text)
    while True:
        value = _permuted(value, 1 << 32, "ip", key)
        found = ".".join(map(str, value.to_bytes(4, "big")))
        if _outside(found) == outside:
            return found


def _iban(text: str, key: bytes) -> str:
    body, valid = text[4:], _iban_ok(text)
    if not valid:
        return text[:2] + permute(text[2:], "iban", key, ok=lambda x: _iban_ok(text[:2] + x))
    body = permute(body, "iban " + text[:2], key)
    rest = int("".join(str(int(c, 36)) for c in body.replace(" ", "") + text[:2] + "00")) % 97
    return f"{text[:2]}{98 - rest:02d}{body}"


def surrogate(kind: str, text: str, key: bytes) -> str:
    """The replacement of an entity; of the same kind and format, and, but for names and e-mail, length."""
    if kind == "name":
        return _name(text, key)
    if kind == "email":
        local, _, domain = text.partition("@")
        return f"{permute(local, 'local', key)}@{permute(domain.lower(), 'domain', key)}.example"
    if kind == "ip":
        return _ip(str(text), key)
    if kind == "iban":
        return _iban(text, key)
    if kind == "card":  # the first digit tells the issuer; valid numbers become valid ones
        if luhn(text):
            body = text[:1] + permute(text[1:-1], "card", key)
            return body + next(d for d in "0123456789" if luhn(body + d))
        return text[:1] + permute(text[1:], "card", key, ok=lambda x: luhn(text[:1] + x))
    if kind == "phone":  # a country code stays; area codes and exchanges stay possible
        head = re.match(r"\+\d{1,3}(?=[ .(-])|\+1(?=\d{10}$)|", text)[0]

        def dialled(x: str) -> bool:
            digits = re.sub(r"\D", "", x)
            return len(digits) != 10 or (digits[0] in "23456789" and digits[3] in "23456789")

        return head + permute(text[len(head) :], "phone", key, ok=dialled)
    lower_hex = bool(re.fullmatch(r"[0-9a-f]{8,}|[0-9A-F:]{8,}|[0-9a-f:]{8,}", text))
    return permute(text, kind, key, hexadecimal=kind == "ipv6" or (kind == "secret" and lower_hex))


@lru_cache(8)
def _exchanged(key: bytes) -> tuple[dict[str, str], dict[str, str]]:
    """Each listed name, in lower case, by the one that it is exchanged for, and back: a keyed circle through each list."""
    to = {}
    for names in GIVEN.values():
        circle = sorted(names, key=lambda x: hashlib.blake2b(_low(x).encode(), digest_size=16, key=key).digest())
        to |= {_low(a): b for a, b in zip(circle, [*circle[1:], circle[0]])}
    return to, {_low(b): a for a, b in to.items()}


def named(word: str, key: bytes) -> str:
    """The surrogate of one word of a name, the same wherever it stands; no two words share one, capitals apart.

    A word that is not listed is permuted; if that gives a listed name, which is another's surrogate, the permutation
    goes on from the name exchanged for it. This is one to one, and ends, since no step leads to a word not listed.
    """
    to, back = _exchanged(key)
    if _low(word) in to:
        found = to[_low(word)]
        return found.upper() if word.isupper() else found
    found = permute(word, "name", key, spoken=len(word) > 1)
    while _low(found) in back:
        found = permute(back[_low(found)].title(), "name", key, spoken=True)
        found = found.upper() if word.isupper() else found
    return found


def _name(text: str, key: bytes) -> str:
    return _PARTS.sub(lambda m: m[0] if m[0] in PARTICLES else named(m[0], key), text)


def _families(name: str) -> list[str]:
    """Family names in a name, in lower case: its last word, those after a particle, and those that y or e joins to another."""
    words = [w for w in _PARTS.findall(name) if len(w) > 1 or w in PARTICLES]
    after = [w for v, w in zip(words, words[1:]) if v in PARTICLES]
    before = [v for v, w in zip(words, words[1:]) if w in ("y", "e")]
    return list(dict.fromkeys(_low(w) for w in [*words[-1:], *after, *before] if w not in PARTICLES))


def _again(text: str, names: list[str]) -> Iterator[tuple[int, int]]:
    """(from, to) wherever a full name or a family name of one stands in a text, in any case but without capitals."""
    plain = lambda x: _low(x).replace("\u00a0", " ")
    family = {word for name in names for word in _families(name)}
    full: dict[str, dict[int, set[str]]] = {}
    for name in names:
        full.setdefault(_low(_PARTS.search(name)[0]), {}).setdefault(len(name), set()).add(plain(name))
    whole = lambda at, to: not re.match(r"\w", text[at - 1 : at]) and not re.match(r"\w", text[to : to + 1])
    end = 0
    for m in _PARTS.finditer(text):
        at, word = m.start(), m[0]
        if at < end:
            continue
        known = full.get(_low(word), {})
        to = next((at + n for n in sorted(known, reverse=True) if plain(text[at : at + n]) in known[n] and not text[at : at + n].islower() and whole(at, at + n)), None)
        if to and any(len(w) > 1 for w in _PARTS.findall(text[at:to])):
            end = to
            yield at, to
            continue
        for start, part in [(at, word)] if _low(word) in family else [(at + x.start(), x[0]) for x in re.finditer(rf"{_LETTER}+", word)]:
            if _low(part) in family and not part[0].islower() and whole(start, start + len(part)):
                yield start, start + len(part)


def find(text: str) -> list[tuple[int, int, str]]:
    """(from, to, kind) of the entities of a text, in order, none inside another.

    Names are found after titles; then their full and family names wherever else they stand.
    """
    found: list[tuple[int, int, str]] = []

    def take(at: int, to: int, kind: str) -> bool:
        i = bisect_left(found, (at,))
        if (i < len(found) and found[i][0] < to) or (i and found[i - 1][1] > at):
            return False
        found.insert(i, (at, to, kind))
        return True

    names = []
    for kind in _needed(text):
        for m in _COMPILED[kind].finditer(text):
            at, to = m.span("x" if "x" in m.re.groupindex else 0)
            if kind == "phone" and not 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                continue
            if take(at, to, kind) and kind == "name":
                names.append(text[at:to])
    for at, to in _again(text, names) if names else ():
        take(at, to, "name")
    return found


def replace(text: str, key: bytes) -> tuple[str, list[dict]]:
    """The text with surrogates, and kind, from, to (in the text given) and surrogate of each entity."""
    out, entities, at = [], [], 0
    for start, end, kind in find(text):
        new = surrogate(kind, text[start:end], key)
        out += [text[at:start], new]
        entities.append({"kind": kind, "start": start, "end": end, "surrogate": new})
        at = end
    return ("".join([*out, text[at:]]), entities) if entities else (text, [])


def replace_pii(docs: DataFrame, key: bytes) -> DataFrame:
    """``docs`` with pii_text and pii_entities (kind, start, end, surrogate); rows and other columns stay.

    A text without entities comes back unchanged, null as null. Each text is handled on its own, so there is no shuffle;
    texts of any length are read whole; an empty table stays empty. Columns named pii_text or pii_entities are replaced,
    all others stay, whatever their names. Who has the ``key`` (1 to 64 bytes) can undo the surrogates of all kinds; who
    has not cannot tell them from others of their format.
    """
    kind = pa.struct([("pii_text", pa.string()), ("pii_entities", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("surrogate", pa.string())])))])

    @F.arrow_udf("struct<pii_text:string,pii_entities:array<struct<kind:string,start:int,end:int,surrogate:string>>>")
    def run(text: pa.Array) -> pa.Array:
        done = [(None, []) if x is None else replace(x, key) for x in text.to_pylist()]
        return pa.array([{"pii_text": t, "pii_entities": e} for t, e in done], kind)

    if not 1 <= len(key) <= 64:
        raise ValueError("a key of 1 to 64 bytes is needed")
    (name,) = unused(docs.columns, "pii_done")
    kept = others(docs.columns, "pii_text", "pii_entities")
    return docs.withColumn(name, run(F.col("text"))).select(*kept, f"{name}.pii_text", f"{name}.pii_entities")
