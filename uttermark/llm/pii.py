"""Personal data replaced by surrogates that stay consistent over the whole corpus.

Entities are found in whole texts. Each distinct one gets a surrogate that depends on a
secret key and on the entity alone, so it is the same in every document, run and task, and
each mention is rendered in its own format: separators, letter case, country code and
check digits stay. Numbers, addresses and keys go through a keyed permutation of all
strings of their format, so different entities cannot meet; names come from lists by
gender and script. A check joins all surrogates with each other and with all entities:
where two entities would share one, or one names a real entity, the later is drawn anew.

Names are found behind one or more titles, with initials, particles and capitals of any
script, and then, in the same document, without them or shortened (see ``linked``). A name is one entity in all documents, whatever its titles say. Limits: a
person without any title in a document is not found there; 'Mr. Smith' alone is another
entity than the 'John Smith' of other documents; a word of a person's name that begins
with a capital for another reason is taken for the person.

Only mentions are shuffled, and combined where equal before that; a document's text moves
once, and only if the table of documents with mentions is too large to broadcast.

Letters and digits of any script change within their own; a phone or card number in other
digits is the entity of its value and keeps them.

Defined cases: a null text stays null, one without mentions stays as it is. A null id is
an id like any other. Repeated rows are treated alike. Texts of any length are read whole.
An empty table gives none. Extra columns stay.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import broadcast_if_small, table, written
from .registry import query

# Fixed word lists: titles with the gender they tell, and names by script and gender.
TITLES = {
    "mr": "m", "mister": "m", "herr": "m", "monsieur": "m", "señor": "m", "sr": "m", "г-н": "m",
    "mrs": "f", "ms": "f", "miss": "f", "frau": "f", "madame": "f", "mme": "f", "mlle": "f",
    "señora": "f", "sra": "f", "г-жа": "f",
    "dr": "", "prof": "",
}
GIVEN = {
    ("latin", "m"): "Adam Albert Bruno Carl Daniel Edgar Emil Felix Gabriel Hugo Jonas Leon Martin Oscar Paul Robert Simon Thomas Victor Walter".split(),
    ("latin", "f"): "Ada Alice Bella Clara Diana Elena Emma Flora Helena Ida Julia Laura Maria Nora Olivia Paula Rosa Sara Sofia Vera".split(),
    ("cyrillic", "m"): "Алексей Борис Виктор Григорий Дмитрий Иван Максим Николай Олег Павел".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Ирина Мария Наталья Ольга София".split(),
}
FAMILY = {
    "latin": "Abel Baker Berger Bishop Brandt Carter Castro Collin Dumont Ellis Fischer Fontaine Garcia Gruber Harper Hofer Jansen Keller Lambert Lopez Marsh Mercer Moreau Navarro Olsen Parker Perez Reyes Richter Rivera Rossi Santos Sauter Serra Turner Vega Wagner Weaver Winter Ziegler".split(),
    "cyrillic": "Белых Долгих Коваленко Кравченко Мельник Седых Ткаченко Черных Шевченко Юрченко".split(),
}

_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
#: Words that are part of a name without being one, each with what may follow it.
PARTICLES = (
    "van der|van den|van de|van|von der|von dem|von den|von|de la|de las|de los|de|del|della|di|"
    "da|dos|du|ter|ten|bin|ibn|al"
)
PARTICLE_WORDS = frozenset(re.split(r"[| ]", PARTICLES))


def _capitals() -> str:
    """The capital letters of all scripts, as ranges of a character class."""
    kinds = ("Lu", "Lt")
    points = [i for i in range(sys.maxunicode + 1) if unicodedata.category(chr(i)) in kinds]
    starts = [i for i in points if unicodedata.category(chr(i - 1)) not in kinds]
    ends = [i for i in points if i == sys.maxunicode or unicodedata.category(chr(i + 1)) not in kinds]
    return "".join(f"{chr(i)}-{chr(j)}" for i, j in zip(starts, ends))


_UPPER = _capitals()
_LONG = "herr|frau|miss|mister|monsieur|madame|señora|señor|г-н|г-жа"
_SHORT = "|".join(t for t in TITLES if t not in _LONG.split("|"))
# Without its dot, a short title is one only if it is written like a name.
_BARE = "|".join(t.title() for t in _SHORT.split("|"))
_TITLE = rf"(?:(?i:{_SHORT})\.|(?:{_BARE})(?= )|(?i:{_LONG}))"
_TITLES = rf"{_TITLE} (?:{_TITLE} )*"
_INITIAL = rf"[{_UPPER}]\."
_WITHIN = rf"(?:{_INITIAL} ?){{0,3}}(?:(?i:{PARTICLES}) ){{0,2}}"
_OTHER = rf"(?i:{_SHORT})\.|(?:{_BARE})(?!\w)|(?i:{_LONG}) [{_UPPER}]"
_NAME = rf"{_WITHIN}(?!{_OTHER})[{_UPPER}](?:\w|['’\-](?=\w)(?![sS](?!\w)))+"
FOUND = re.compile(
    "|".join(
        [
            r"(?P<email>(?<![\w.+%\-])[\w.+%\-]+@[\w\-]+(?:\.[\w\-]+)+)",
            r"(?P<key>(?<!\w)(?=[0-9a-f]*[a-f])(?=[0-9a-f]*\d)(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?!\w))",
            r"(?P<keyup>(?<!\w)(?=[0-9A-F]*[A-F])(?=[0-9A-F]*\d)[0-9A-F]{32,}(?!\w))",
            rf"(?P<ip>(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.\d))",
            r"(?P<iban>(?<!\w)[A-Z]{2}\d\d(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w))",
            r"(?P<phone>(?<![\w.])(?:\+1[ .\-]?\(?\d{3}\)?[ .\-]?\d{3}[ .\-]?\d{4}(?!\w)"
            r"|\+(?!1\D)\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}"
            r"(?:[ .\-]?(?!\d{1,3}(?:\.\d{1,3}){3})\d{2,4}){1,4}(?!\w)"
            r"|\(\d{3}\) ?\d{3}-\d{4}(?!\w)|\d{3}([.\-])\d{3}\7\d{4}(?!\w)))",
            r"(?P<ssn>(?<![\w\-])\d{3}-\d\d-\d{4}(?![\w\-]))",
            r"(?P<number>(?<![\w.])(?:\d{12,19}|\d{4}([ \-])\d{4}\10\d{4}\10\d{1,7})(?!\w|\.\d))",
            rf"(?P<name>(?<!\w){_TITLES}{_NAME}(?: {_NAME}){{0,2}})",
        ]
    )
)
#: What every match holds; a text without it has none.
HINT = re.compile(rf"[@\d]|(?<!\w){_TITLE} ")
INITIALS = re.compile(r"(?:\w\.)+")


def _luhn(digits: str) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 - i % 2)  # the check digit would stand behind
        total += d - 9 if d > 9 else d
    return -total % 10


def _iban_check(country: str, rest: str) -> str:
    number = "".join(str(int(c, 36)) for c in rest + country) + "00"
    return f"{98 - int(number) % 97:02d}"


def _digits(raw: str) -> str:
    """The digits of ``raw``, of any script, as ASCII."""
    return "".join(str(unicodedata.decimal(c)) for c in raw if c.isdecimal())


def entity(match: re.Match) -> tuple[str, str] | None:
    """(kind, canonical form) of a match, or None if it is not what it looks like."""
    kind, raw = match.lastgroup, match.group()
    kind = next(k for k, v in match.groupdict().items() if v is not None)
    if kind in ("key", "keyup"):
        return "key", raw.lower()
    if kind == "email":
        return kind, raw.lower()
    if kind == "ip":
        return kind, ".".join(str(int(x)) for x in raw.split("."))
    if kind == "iban":
        packed = raw.replace(" ", "")
        fits = _iban_check(packed[:2], packed[4:]) == packed[2:4]
        return (kind, packed) if fits else None
    if kind == "phone":
        digits = _digits(raw)
        if not 8 <= len(digits) <= 15:
            return None
        return kind, ("+" if raw[0] == "+" else "") + digits
    if kind in ("ssn", "number"):
        return kind, _digits(raw)
    titles = re.match(_TITLES, raw).group()
    told = [TITLES[title.strip(".").lower()] for title in titles.split()]
    names = " ".join(raw[len(titles) :].title().split())
    return "name:" + next(filter(None, told), ""), names


# Surrogates.


def _prf(key: bytes, *parts: object) -> int:
    text = "\x1f".join(map(str, parts)).encode()
    return int.from_bytes(hmac.new(key, text, hashlib.sha256).digest(), "big")


def permute(key: bytes, tweak: str, value: int, size: int) -> int:
    """A keyed permutation of range(size): a Feistel network, walked until in range."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        a, b = value >> half, value & mask
        for i in range(8):
            mixed = 0
            for j in range(half // 256 + 1):
                mixed = mixed << 256 | _prf(key, tweak, i, j, size, b)
            a, b = b, a ^ (mixed & mask)
        value = a << half | b
        if value < size:
            return value


ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
             "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ", "абвгдежзийклмнопрстуфхцчшщъыьэюя"]
#: Letters of these ranges make one alphabet, all others those of their kind within 256.
WIDE = [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0x20000, 0x323AF)]


def _sort(c: str) -> tuple:
    """Letters of one kind change into each other: equal category, and equal behaviour
    when case changes, so that a surrogate is found again as itself."""
    return unicodedata.category(c), c.lower() == c, c.upper().lower() == c


@lru_cache(None)
def _lone() -> list[str]:
    """The letters that are the only ones of their kind within 256."""
    found: dict[tuple, list[str]] = {}
    for c in map(chr, range(0x110000)):
        if c.isalnum() and not c.isdecimal() and not any(c in a for a in ALPHABETS):
            if not any(low <= ord(c) <= high for low, high in WIDE):
                found.setdefault((ord(c) >> 8, *_sort(c)), []).append(c)
    return [cs[0] for cs in found.values() if len(cs) == 1]


@lru_cache(65536)
def alphabet(c: str) -> str:
    """The letters or digits, ``c`` among them, that stand for each other in surrogates;
    none for signs. Covers every letter, digit and numeral that a pattern's \\w accepts."""
    for letters in ALPHABETS:
        if c in letters:
            return letters
    if c.isdecimal():  # the ten digits of a script follow each other
        zero = ord(c) - unicodedata.decimal(c)
        return "".join(map(chr, range(zero, zero + 10)))
    if not c.isalnum():
        return ""
    low = ord(c) & ~0xFF
    low, high = next((w for w in WIDE if w[0] <= ord(c) <= w[1]), (low, low + 0xFF))
    return _alphabet_within(low, high, _sort(c)) or "".join(_lone())


@lru_cache(None)
def _alphabet_within(low: int, high: int, sort: tuple) -> str:
    found = [
        c
        for c in map(chr, range(low, high + 1))
        if c.isalnum() and not c.isdecimal() and _sort(c) == sort
        and not any(c in a for a in ALPHABETS)
        and not any(w[0] <= ord(c) <= w[1] and w[0] != low for w in WIDE)
    ]
    return "".join(found) if len(found) > 1 else ""


def permute_text(key: bytes, tweak: str, text: str, alphabets=None) -> str:
    """Each letter or digit becomes one of its own alphabet; everything else stays."""
    listed = alphabets or ALPHABETS
    place = {c: a for a in listed for c in a}
    spots = []
    for n, c in enumerate(text):
        letters = place.get(c) or ("" if alphabets else alphabet(c))
        if letters:
            spots.append((n, letters, letters.index(c)))
    value, size = 0, 1
    for _, letters, j in spots:
        value = value * len(letters) + j
        size *= len(letters)
    form = list(text)
    for n, letters, _ in spots:
        form[n] = str(listed.index(letters)) if letters in listed else letters[0]
    value = permute(key, f"{tweak}/{''.join(form)}", value, size)
    out = list(text)
    for n, letters, _ in reversed(spots):
        value, j = divmod(value, len(letters))
        out[n] = letters[j]
    return "".join(out)


def _reach(address: str) -> str:
    a, b, *_ = map(int, address.split("."))
    if a in (0, 127) or a >= 224:
        return f"special {a}"
    if a == 10 or (a, b) == (192, 168) or a == 172 and 16 <= b < 32 or (a, b) == (169, 254):
        return f"private {a}"
    return "public"


def surrogate(key: bytes, kind: str, value: str, turn: int) -> str:
    """The canonical surrogate of a canonical entity; ``turn`` counts earlier refusals."""
    tweak = f"{kind}/{turn}"
    if kind == "ip":
        number = int.from_bytes(bytes(map(int, value.split("."))), "big")
        while True:  # walks the permutation to the next address of the same reach
            number = permute(key, tweak, number, 1 << 32)
            found = ".".join(map(str, number.to_bytes(4, "big")))
            if _reach(found) == _reach(value):
                return found
    if kind == "key":
        return permute_text(key, tweak, value, ["0123456789abcdef"])
    if kind == "iban":
        rest = permute_text(key, f"{tweak}/{value[:2]}", value[4:])
        return value[:2] + _iban_check(value[:2], rest) + rest
    if kind == "number" and _luhn(value[:-1]) == int(value[-1]):
        body = permute_text(key, tweak + "/luhn", value[:-1])
        return body + str(_luhn(body))
    if kind == "phone":
        cut = 2 if value.startswith("+1") else 3 if value[0] == "+" else 0
        return value[:cut] + permute_text(key, f"{tweak}/{value[:cut]}", value[cut:])
    if kind == "email":
        local, _, domain = value.rpartition("@")
        site, _, end = domain.rpartition(".")
        # A site keeps one surrogate, whoever writes from it; only those that were refused
        # twice get another one. They grow too, as all strings of their form may be taken,
        # or have no letter to change.
        longer, number = "", _prf(key, tweak, value)
        for _ in range(turn - 1):
            number, j = divmod(number, 26)
            longer += ALPHABETS[1][j]
        where = "site" if turn < 2 else f"site/{turn}"
        return "@".join(
            [permute_text(key, f"{tweak}/{domain}", local) + longer, permute_text(key, where, site) + "." + end]
        )
    if kind.startswith("name:"):
        script = "cyrillic" if re.search("[А-яЁё]", value) else "latin"
        gender = kind[5:] or "mf"[_prf(key, "gender", value) % 2]
        words, number = value.split(" "), _prf(key, tweak, script, value)
        out = []
        for i, word in enumerate(words):
            last = i == len(words) - 1
            if not last and word.lower() in PARTICLE_WORDS:
                out.append(word)
                continue
            pool = FAMILY[script] if last else GIVEN[script, gender]
            drawn = ""
            for _ in range(word.count(".") if INITIALS.fullmatch(word) else 1):
                number, j = divmod(number, len(pool))
                drawn += pool[j][0] + "." if INITIALS.fullmatch(word) else pool[j]
            out.append(drawn)
        for _ in range(turn // 4):  # the lists are used up: double names
            number, j = divmod(number, len(FAMILY[script]))
            out[-1] += "-" + FAMILY[script][j]
        return " ".join(out)
    return permute_text(key, tweak, value)


def render(raw: str, kind: str, found: str, part: str | None = None) -> str:
    """The surrogate in the format of the mention ``raw``, of names the words ``part``."""
    if kind.startswith("name:"):
        title = re.match(_TITLES, raw)
        cut = title.end() if title else 0
        names = raw[cut:]
        if part:
            words = found.split(" ")
            found = " ".join(words[int(i)] for i in part.split(","))
        if names.isupper():
            return raw[:cut] + found.upper()
        # Particles keep their case, and initials stay initials.
        out = [
            old if old.lower() == new.lower()
            else new[0] + "." if INITIALS.fullmatch(old) and not INITIALS.fullmatch(new)
            else new
            for old, new in zip(names.split(), found.split(" "))
        ]
        return raw[:cut] + " ".join(out)
    if kind in ("email", "key"):
        return found.upper() if raw.isupper() else found
    if kind == "ip":
        return found
    rest = iter(re.sub(r"[^0-9A-Z]", "", found))
    out = []
    for c in raw:
        if re.match(r"[0-9A-Z]", c):
            c = next(rest)
        elif c.isdecimal():  # keeps its script
            c = chr(ord(c) - unicodedata.decimal(c) + int(next(rest)))
        out.append(c)
    return "".join(out)


# Spark.


def mentions(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical) in code points, not overlapping."""
    if not text or not HINT.search(text):
        return []
    found = ((m.start(), m.end(), entity(m)) for m in FOUND.finditer(text))
    return [(a, b, *e) for a, b, e in found if e]


_WORD = re.compile(r"[\w'’\-]+")


def linked(text: str | None) -> list[tuple[int, int, str, str, str]]:
    """``mentions`` with those of persons linked: (start, end, kind, canonical, part).

    A titled name of fewer words, as in 'Mr. Smith', is the one person of the text whose
    longer name holds these words or words with these initials in order, ends like it or begins like it, and whose
    gender agrees; if there are several, it stays a name of its own. Then every untitled
    mention of a full name or of its last or first word, in the case of the name or in
    capitals, is one of that person too, or a name of its own if several persons have it. ``part`` lists which
    words of the name are mentioned, and is empty for other kinds."""
    found = mentions(text)
    named = [(i, k[5:], v.split(" ")) for i, (_, _, k, v) in enumerate(found) if k.startswith("name:")]
    if not named:
        return [(*f, "") for f in found]
    genders: dict[tuple, set[str]] = {}
    for _, gender, words in named:
        genders.setdefault(tuple(words), set()).add(gender)

    def places(short: tuple, full: tuple) -> list[int] | None:
        out, at = [], 0
        for w in short:
            initial = w[0] if w.endswith(".") else None
            here = [i for i in range(at, len(full)) if full[i] == w or initial == full[i][0]]
            if not here:
                return None
            out.append(here[0])
            at = here[0] + 1
        return out if out[-1] == len(full) - 1 or out[0] == 0 else None

    def told_of(name: tuple) -> tuple[int, int]:
        return len(name), sum(not w.endswith(".") for w in name)

    def agree(a: set[str], b: set[str]) -> bool:
        a, b = a - {""}, b - {""}
        return not a or not b or a == b

    # A longer name ends or begins like the shorter one.
    alike: dict[tuple, list] = {}
    for full in genders:
        alike.setdefault((-1, full[-1]), []).append(full)
        alike.setdefault((0, full[0]), []).append(full)
    persons = {}
    for short, told in genders.items():
        near = dict.fromkeys([*alike[-1, short[-1]], *alike[0, short[0]]])
        longer = [
            full for full in near
            if told_of(full) > told_of(short) and places(short, full) and agree(told, genders[full])
        ]
        # 'John Smith' and 'John Paul Smith' may be one person; the longest name holds the rest.
        top = [a for a in longer if all(a == b or places(b, a) for b in longer)]
        full = top[0] if top else short
        persons[short] = (full, places(short, full))
    out = []
    for i, (start, stop, kind, value) in enumerate(found):
        part = ""
        if kind.startswith("name:"):
            full, at = persons[tuple(value.split(" "))]
            value, part = " ".join(full), ",".join(map(str, at))
        out.append((start, stop, kind, value, part))
    forms: dict[tuple, set] = {}
    for full in {f for f, _ in persons.values()}:
        everything = tuple(range(len(full)))
        parts = {everything, everything[-1:], everything[:1], (0, len(full) - 1) if len(full) > 1 else everything}
        for at in parts:
            forms.setdefault(tuple(full[i] for i in at), set()).add((full, at))
    for short, (full, at) in persons.items():
        forms.setdefault(short, set()).add((full, tuple(at)))
    longest = max(map(len, forms))
    free, last = [], 0
    for start, stop, *_ in found:
        free.append((last, start))
        last = stop
    free.append((last, len(text)))
    for low, high in free:
        tokens = [m for m in _WORD.finditer(text, low, high)]
        i = 0
        while i < len(tokens):
            step = 1
            for n in range(min(longest, len(tokens) - i), 0, -1):
                part = tokens[i : i + n]
                if any(text[a.end() : b.start()] not in (" ", "\n") for a, b in zip(part, part[1:])):
                    continue
                raw = [m.group() for m in part]
                # A possessive is no part of the name.
                tail = re.search(r"['’](?:s|S)?$", raw[-1])
                stop = part[-1].end() - (len(tail.group()) if tail else 0)
                raw[-1] = raw[-1][: len(raw[-1]) - len(tail.group())] if tail else raw[-1]
                if not all(w[:1].isupper() or w in PARTICLE_WORDS for w in raw) or raw[-1].islower():
                    continue
                short = tuple(w.title() for w in raw)
                who = forms.get(short, ())
                if who:
                    # Of several persons it can be any: a name of its own, not left in clear.
                    (full, at), = who if len(who) == 1 else [(short, tuple(range(n)))]
                    told = set().union(*(g for s, g in genders.items() if persons[s][0] == full)) - {""}
                    gender = told.pop() if len(told) == 1 else ""
                    out.append((part[0].start(), stop, f"name:{gender}", " ".join(full), ",".join(map(str, at))))
                    step = n
                    break
            i += step
    return sorted(out)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    for whole in batches:
        for at in range(0, whole.num_rows, 1024):
            batch = whole.slice(at, 1024)
            rows = []
            for i, text in enumerate(batch.column(2)):
                for found in linked(text.as_py()):
                    rows.append((batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), *found))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), types)],
                    names=["k1", "k2", "start", "stop", "kind", "value", "part"],
                )


def _draw(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, values, turns = (c.to_pylist() for c in batch.columns)
            made = [surrogate(key, *row) for row in zip(kinds, values, turns)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(made, pa.string())],
                names=["kind", "value", "turn", "made"],
            )

    return run


def _family(kind):
    """Names of all genders share one space of surrogates."""
    return F.substring_index(kind, ":", 1)


def surrogates(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, turn, made) for distinct ``entities`` (kind, value): no two of a kind
    share a surrogate, and none is itself an entity of the corpus."""
    schema = "kind string, value string, turn int, made string"
    names = entities.select(_family("kind").alias("family"), F.col("value").alias("made")).distinct()
    settled, waiting = None, entities.select("kind", "value", F.lit(0).alias("turn"))
    while True:
        drawn = written(waiting.mapInArrow(_draw(key), schema), "drawn").withColumn(
            "family", _family("kind")
        )
        # Of those that draw the same, the first by value stays.
        first = drawn.groupBy("family", "made").agg(F.min(F.struct("value", "kind")).alias("first"))
        fresh = first.join(names, ["family", "made"], "left_anti")
        if settled is not None:
            used = settled.select(_family("kind").alias("family"), "made")
            fresh = fresh.join(used, ["family", "made"], "left_anti")
        marked = written(
            drawn.join(fresh, ["family", "made"], "left").select(
                "kind", "value", "turn", "made",
                F.coalesce(F.struct("value", "kind") == F.col("first"), F.lit(False)).alias("good"),
            ),
            "marked",
        )
        good = marked.filter("good").drop("good")
        settled = good if settled is None else settled.unionByName(good)
        waiting = marked.filter("NOT good").select("kind", "value", (F.col("turn") + 1).alias("turn"))
        if waiting.isEmpty():
            return settled


def _replace(at: int, spans_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                batch = whole.slice(i, 1024)
                texts = []
                for text, spans in zip(batch.column(at), batch.column(spans_at)):
                    text, spans = text.as_py(), spans.as_py()
                    if spans:
                        out, last = [], 0
                        for s in sorted(spans, key=lambda s: s["start"]):
                            out += [text[last : s["start"]]]
                            out += [render(text[s["start"] : s["stop"]], s["kind"], s["made"], s["part"])]
                            last = s["stop"]
                        text = "".join([*out, text[last:]])
                    texts.append(text)
                columns = list(batch.columns[:spans_at])
                columns[at] = pa.array(texts, pa.string())
                count = [len(s.as_py() or ()) for s in batch.column(spans_at)]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(count, pa.int64())],
                    names=[*batch.schema.names[:spans_at], "n_entities"],
                )

    return run


def with_surrogates(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` (doc_id, text and any other columns) with surrogates in the texts, and
    n_entities, the number of mentions replaced (a column of that name is replaced)."""
    rows = docs.drop("n_entities")
    keys = {
        "_k1": F.xxhash64(F.lit(1), "doc_id", "text"),
        "_k2": F.xxhash64(F.lit(2), "text", "doc_id"),
    }
    found = written(
        rows.select(*[c.alias(k) for k, c in keys.items()], "text").mapInArrow(
            _find,
            "k1 bigint, k2 bigint, start bigint, stop bigint, kind string, value string, part string",
        ),
        "mentions",
    ).distinct()
    # A name is one entity, whichever titles it has. Its gender is the one they tell; if
    # they tell both or none, it is open.
    named = F.col("kind").startswith("name:")
    told = F.when(F.length("kind") > 5, F.col("kind"))
    genders = written(
        found.filter(named)
        .groupBy("value")
        .agg(F.min(told).alias("low"), F.max(told).alias("high"))
        .select(
            F.lit("name:").alias("family"),
            "value",
            F.when(F.col("low") == F.col("high"), F.col("low")).otherwise("name:").alias("whole"),
        ),
        "genders",
    )
    found = (
        found.withColumn("family", F.when(named, "name:"))
        .join(broadcast_if_small(genders), ["family", "value"], "left")
        .withColumn("kind", F.coalesce("whole", "kind"))
        .drop("family", "whole")
    )
    made = surrogates(found.select("kind", "value").distinct(), key.encode())
    spans = written(
        found.join(made.drop("turn"), ["kind", "value"])
        .groupBy("k1", "k2")
        .agg(F.collect_list(F.struct("start", "stop", "kind", "made", "part")).alias("_spans"))
        .select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), "_spans"),
        "spans",
    )
    held = F.aggregate(
        "_spans",
        F.lit(64).cast("bigint"),
        lambda n, s: n + 96 + F.octet_length(s["kind"]) + F.octet_length(s["made"]) + F.octet_length(s["part"]),
    )
    joined = rows.withColumns(keys).join(
        broadcast_if_small(spans, 100_000, held), ["_k1", "_k2"], "left"
    )
    names = rows.columns
    schema = T.StructType([*rows.schema.fields, T.StructField("n_entities", T.LongType())])
    return joined.select(*names, "_spans").mapInArrow(
        _replace(names.index("text"), len(names)), schema
    )


@query("op7_pii_surrogates")
def op7(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_surrogates(docs, key="a secret of the data owner")
