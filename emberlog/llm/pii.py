"""Personal data and secrets, replaced by keyed surrogates of the same kind and shape.

Detection is a list of patterns. Where matches overlap, the one around the other wins, and
matches that only touch each other's part become one secret, so nothing of a value stays in clear. Each value is
rewritten by a keyed permutation of all values of its own shape, so that one value has one surrogate in
every document (coreference) and two values of a shape never share one (distinctness), without a
table of what was seen:

* every character that carries content is a digit in the alphabet of its class: ASCII digits, letters by script
  and case, and for all other scripts the characters of the same block of 256 code points and
  the same Unicode category. A Feistel network over the sequence of these digits, whatever its length, permutes it: in each
  round one half is shifted, digit by digit, by a keyed stream that the other half seeds. Separators, case, script and length stay.
* which permutation is used depends on the value alone, not on the pattern that found it.
* card numbers keep their issuer digit and pass the Luhn test, as the original does.
* IPv4 addresses stay addresses and in their private range, if they lie in one; e-mail addresses keep domain
  structure, reserved example domains stay; phone numbers keep country code and layout.
* names after a title get a given name of their gender and script and a drawn surname. A given name of
  the lists tells the gender; else the title does.

Collision checks: no surrogate of a permutation equals its value, because the permutations have no fixed
points, and none is shared, because they are bijections. Names are drawn by key and can
collide: `pseudonymise_distinct` first gathers the distinct names of the whole table, draws again
those whose surrogate another name has or that kept their own, until none is left, and only then rewrites
the texts. Names and draws are table rows at any number of them.

Names are found by a first pass with their one pattern; the second pass is a map over rows without
a shuffle, unless names were drawn again: then the documents that hold those meet them by doc_id.
Time and memory are linear in a text and in a value, however long.

Cases: null stays null, with no entities; empty stays empty. Repeated rows are treated each for
itself. A null doc_id is a value like others. Other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from emberlog.llm.common import Scratch, sized

KEY = "emberlog-surrogates-1"
#: Syllables of a drawn surname: 6e9 surnames in Latin script.
SYLLABLES_OF_NAME = 5

# Given names by script and gender, and titles with the gender they tell.
NAMES = {
    ("latin", "f"): "Anna Clara Elena Emma Eva Helen Ida Irene Julia Laura Lena Lucia Maria Marta Nina Nora Olivia Paula Rosa Sara Sofia Teresa Vera Zoe".split(),
    ("latin", "m"): "Adam Alan Andre Anton Bruno Carl David Erik Felix Hugo Ivan Jonas Karl Leo Lucas Marco Martin Oscar Paul Peter Samuel Simon Thomas Victor".split(),
    ("cyrillic", "f"): "Анна Вера Дарья Елена Ирина Лидия Мария Нина Ольга Софья".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Иван Лев Максим Олег Павел Роман Юрий".split(),
}
SYLLABLES = {
    "latin": [c + v for c in "bcdfghjklmnprstvwz" for v in "aeiou"],
    "cyrillic": [c + v for c in "бвгджзклмнпрстфхч" for v in "аеиоу"],
}
TITLES = {
    "Mr": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "господин": "m",
    "Mrs": "f", "Ms": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Señora": "f", "Sra": "f", "госпожа": "f",
    "Dr": "", "Prof": "",
}

_B, _E = r"(?<![\w])", r"(?![\w])"
_WORD = r"[^\W\d_]+(?:[-'’][^\W\d_]+)*"

#: type -> (what a text must hold, pattern; group `v` is the value). Earlier types win.
PATTERNS: dict[str, tuple[str, str]] = {
    "private_key": ("-----BEGIN", r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?P<v>[A-Za-z0-9+/=\s]+?)-----END"),
    "jwt": ("eyJ", _B + r"(?P<v>eyJ[\w-]{6,}\.[\w-]{6,}\.[\w-]{6,})"),
    "aws_key": ("A", _B + r"(?P<v>(?:AKIA|ASIA)[A-Z0-9]{16})" + _E),
    "api_key": ("sk-", _B + r"(?P<v>sk-[A-Za-z0-9_-]{16,})"),
    "secret": (
        "secret",
        r"(?i:(?:pass(?:word|wd)|secret|token|api[_-]?key|access[_-]?key)[\"']?\s*[:=]\s*[\"']?|\bbearer\s+)(?P<v>[^\s\"',;]{6,})",
    ),
    "email": ("@", r"(?<![\w.+-])(?P<v>[\w.+-]++@(?:[\w-]+\.)+[^\W\d_]{2,})" + _E),
    "iban": ("", _B + r"(?P<v>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?)" + _E),
    "ipv4": ("", r"(?<![\w.])(?P<v>(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d))(?!\.?\d|\w)"),
    "ipv6": (
        ":",
        r"(?<![\w:.])(?P<v>(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|(?:[0-9a-fA-F]{1,4}:){1,6}(?::[0-9a-fA-F]{1,4}){1,6}"
        r"|::(?:[0-9a-fA-F]{1,4}:){0,6}[0-9a-fA-F]{1,4}|(?:[0-9a-fA-F]{1,4}:){2,7}:)(?![\w:])",
    ),
    "card": ("", _B + r"(?P<v>\d(?:[ -]?\d){12,18})" + _E),
    "ssn": ("", _B + r"(?P<v>\d{3}-\d{2}-\d{4})" + _E),
    "phone": (
        "",
        r"(?<![\w.+])(?P<v>\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}"
        r"|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w)",
    ),
    "hex_key": ("", _B + r"(?P<v>(?=[0-9a-f]*\d)(?=[0-9a-f]*[a-f])(?:[0-9a-f]{40}|[0-9a-f]{64}|[0-9a-f]{32}))" + _E),
    "person": ("title", _B + r"(?:" + "|".join(TITLES) + r")\.? (?P<v>[^\W\d_a-zа-я]" + _WORD + r"(?: [^\W\d_a-zа-я]" + _WORD + ")?)"),
}
_SECRET_MARK = re.compile(r"(?i)pass(?:word|wd)|secret|token|api[_-]?key|access[_-]?key|bearer\s")
_TITLE_MARK = re.compile(_B + "(?:" + "|".join(TITLES) + r")\.? ")
_DIGITS = re.compile(r"\d")

# ---- keyed permutations

ROUNDS = 10


def _stream(key: str, tweak: str, turn: int, half: np.ndarray, n: int) -> np.ndarray:
    """n keyed 64-bit numbers that depend on all of `half`."""
    seed = hashlib.shake_256(f"{key}|{tweak}|{turn}|{n}|".encode() + half.astype("<u4").tobytes())
    return np.frombuffer(seed.digest(8 * n), "<u8")


def permute(digits: np.ndarray, radix: np.ndarray, key: str, tweak: str, back: bool = False) -> np.ndarray:
    """A keyed bijection on the sequences of digits below `radix`, or its inverse."""
    out, size = digits.astype(np.uint64), radix.astype(np.uint64)
    middle = len(out) // 2
    parts = (slice(0, middle), slice(middle, None))
    for turn in reversed(range(ROUNDS)) if back else range(ROUNDS):
        own, other = parts[(turn + 1) % 2], parts[turn % 2]
        moved, r = out[own], size[own]
        if len(moved):
            by = _stream(key, tweak, turn, out[other], len(moved)) % r
            out[own] = (moved + (r - by if back else by)) % r
    return out


def other(digits: np.ndarray, radix: np.ndarray, key: str, tweak: str) -> np.ndarray:
    """A keyed bijection without fixed points: a shift of one digit seen through a permutation."""
    if not len(digits):
        return digits
    place = int(np.argmax(radix))
    most = int(radix[place])
    shift = 1 + int(_stream(key, tweak, ROUNDS, radix, 1)[0] % np.uint64(most - 1))
    out = permute(digits, radix, key, tweak)
    out[place] = (int(out[place]) + shift) % most
    return permute(out, radix, key, tweak, back=True)


def _other(number: int, size: int, key: str, tweak: str) -> int:
    """other() of one digit."""
    return int(other(np.array([number]), np.array([size]), key, tweak)[0]) if size > 1 else number


# Alphabets whose letters stay among themselves, and marks that a password may hold.
_CLASSES = (
    "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ",
    "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
)
_MARKS = "!#$%&()*+/<=>?@[]^`{|}~"
_ALPHABET_OF = {c: alphabet for alphabet in _CLASSES for c in alphabet}
_HEX = "0123456789abcdef"


@functools.lru_cache(maxsize=4096)
def _block(start: int, width: int, category: str) -> str:
    """The characters of a category among `width` code points that no class of _CLASSES has."""
    found = (chr(k) for k in range(start, start + width) if not 0xD800 <= k < 0xE000)
    return "".join(c for c in found if unicodedata.category(c) == category and c not in _ALPHABET_OF)


def alphabet(c: str) -> str | None:
    """The alphabet in which a character is a digit; None for separators."""
    known = _ALPHABET_OF.get(c)
    if known or c.isascii():
        return known
    category = unicodedata.category(c)
    if category[0] not in "LMNS" and category != "Co":
        return None
    for width in (256, 4096, 65_536):
        found = _block(ord(c) // width * width, width, category)
        if len(found) > 1:
            return found
    return None


@functools.lru_cache(maxsize=4096)
def _index(letters: str) -> dict[str, int]:
    return {c: k for k, c in enumerate(letters)}


def reshape(value: str, key: str, tweak: str = "", alphabets: Callable[[int, str], str | None] | None = None) -> str:
    """Permute the characters of `value` within their classes; others stay in place.

    The shape (the class of every place, and what stays) is part of the tweak, so the values
    of a shape are permuted among themselves. A value of separators only is permuted among those.
    """
    of = alphabets or (lambda i, c: alphabet(c))
    places = [(i, a) for i, c in enumerate(value) if (a := of(i, c)) and len(a) > 1]
    if not places and alphabets is None:
        marks = lambda c: "._-" if c in "._-" else _MARKS if c in _MARKS else None
        places = [(i, a) for i, c in enumerate(value) if (a := marks(c))]
    if not places:
        return value
    shape = list(value)
    for i, a in places:
        shape[i] = a[0]
    shown = hashlib.blake2b("".join(shape).encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
    digits = np.fromiter((_index(a)[value[i]] for i, a in places), np.uint64, len(places))
    radix = np.fromiter((len(a) for _, a in places), np.uint64, len(places))
    for (i, a), d in zip(places, other(digits, radix, key, f"{tweak}|{shown}").tolist()):
        shape[i] = a[d]
    return "".join(shape)


def _luhn(digits: str) -> int:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10


def _card(value: str, key: str) -> str:
    places = [i for i, c in enumerate(value) if c.isdigit()]
    digits = "".join(value[i] for i in places)
    if _luhn(digits):
        return reshape(value, key)
    body = digits[0] + reshape(digits[1:-1], key, f"card{digits[0]}")
    body += str(next(d for d in range(10) if not _luhn(body + str(d))))
    out = list(value)
    for i, c in zip(places, body):
        out[i] = c
    return "".join(out)


def _ipv4(value: str, key: str) -> str:
    texts = value.split(".")
    parts = [int(p) for p in texts]
    fixed = 1 if parts[0] in (10, 127) else 2 if parts[:2] == [192, 168] or parts[0] == 172 and 16 <= parts[1] < 32 else 0
    if any(len(str(x)) != len(p) for x, p in zip(parts, texts)):
        return reshape(value, key, "octets", lambda i, c: "01" if c in "01" else None)
    # Octets keep their number of digits, so the text keeps its length.
    lows = [{1: 0, 2: 10, 3: 100}[len(p)] for p in texts[fixed:]]
    radix = [{1: 10, 2: 90, 3: 156}[len(p)] for p in texts[fixed:]]
    digits = np.array(parts[fixed:], np.uint64) - np.array(lows, np.uint64)
    made = other(digits, np.array(radix, np.uint64), key, f"ip|{parts[:fixed]}|{lows}")
    return ".".join(map(str, [*parts[:fixed], *(d + lo for d, lo in zip(made.tolist(), lows))]))


def _email(value: str, key: str) -> str:
    local, _, domain = value.partition("@")
    labels = domain.split(".")
    keep = 2 if len(labels) > 1 and labels[-2] in ("example",) else 1
    names = [reshape(x, key, "domain") for x in labels[:-keep]] + labels[-keep:]
    return reshape(local, key, "local") + "@" + ".".join(names)


def _phone(value: str, key: str) -> str:
    country = re.match(r"\+\d{1,3}(?=[ .(-])|", value)[0]
    return country + reshape(value[len(country) :], key, f"phone{country}")


def gender_of(value: str, title: str) -> str:
    """'f', 'm' or '': what the given name tells, else the title."""
    given = value.split()[0]
    for (_, gender), names in NAMES.items():
        if given in names:
            return gender
    return title


def _person(value: str, key: str, gender: str, turn: int, syllables: int) -> str:
    """A given name of the gender and script, and a surname of drawn syllables."""
    script = "cyrillic" if "\u0400" <= value[0] <= "\u04ff" else "latin"
    seed = hashlib.blake2b(f"{key}|person{turn}|{value}".encode("utf-8", "surrogatepass"), digest_size=32)
    draw = int.from_bytes(seed.digest(), "big")
    surname = ""
    for _ in range(syllables):
        draw, k = divmod(draw, len(SYLLABLES[script]))
        surname += SYLLABLES[script][k]
    surname = surname.capitalize()
    if " " not in value:
        return surname
    draw, k = divmod(draw, 2)
    names = NAMES[script, gender or "fm"[k]]
    return names[draw % len(names)] + " " + surname


def _hexes(value: str) -> Callable[[int, str], str | None] | None:
    """One alphabet for all hex digits of a value that has nothing else."""
    bare = value.replace(":", "").replace("-", "")
    for letters in (_HEX, _HEX.upper()):
        if bare and set(bare) <= set(letters) and not bare.isdigit():
            return lambda i, c: letters if c in letters else None
    return None


def kind_of(value: str, kind: str) -> str:
    """The kind whose rules rewrite a value: the first whose pattern matches it as a whole.

    So a value has one surrogate, whichever pattern found it.
    """
    if kind == "person" or len(value) > LONG:
        return kind
    for name in ("email", "aws_key", "iban", "ipv4", "ipv6", "card", "ssn", "phone"):
        if _COMPILED[name].fullmatch(value):
            return name
    return "secret"


#: Longer values are no address, card or phone number.
LONG = 400


def surrogate(kind: str, value: str, key: str = KEY, gender: str = "", turn: int = 0, syllables: int = SYLLABLES_OF_NAME) -> str:
    """The keyed replacement of one detected value."""
    kind = kind_of(value, kind)
    if kind == "card":
        return _card(value, key)
    if kind == "ipv4":
        return _ipv4(value, key)
    if kind == "email":
        return _email(value, key)
    if kind == "phone":
        return _phone(value, key)
    if kind == "person":
        return _person(value, key, gender, turn, syllables)
    if kind == "aws_key":
        return value[:4] + reshape(value[4:], key, "aws")
    if kind == "iban":
        return value[:2] + reshape(value[2:], key, "iban")
    if kind == "ssn":
        return reshape(value, key)
    if kind == "ipv6":
        return reshape(value, key, "hex", _hexes(value) or (lambda i, c: _HEX if c in _HEX else "ABCDEF" if c in "ABCDEF" else None))
    if hexes := _hexes(value):
        return reshape(value, key, "hex", hexes)
    if value.startswith("sk-"):
        return value[:3] + reshape(value[3:], key, "sk")
    return reshape(value, key, "secret", lambda i, c: _MARKS if c in _MARKS else alphabet(c))


_COMPILED = {kind: re.compile(pattern) for kind, (_, pattern) in PATTERNS.items()}


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, gender) of the entities, in text order, without overlaps."""
    digits = bool(_DIGITS.search(text))
    found: list[tuple[int, int, int, str, str]] = []
    for order, (kind, pattern) in enumerate(_COMPILED.items()):
        mark = PATTERNS[kind][0]
        if mark == "secret":
            if not _SECRET_MARK.search(text):
                continue
        elif mark == "title":
            if not _TITLE_MARK.search(text):
                continue
        elif mark and mark not in text or not mark and not digits:
            continue
        for m in pattern.finditer(text):
            a, b = m.span("v")
            if kind == "card" and _luhn("".join(c for c in m["v"] if c.isdigit())) and len(m["v"]) != 16:
                continue
            title = TITLES.get(m[0].split()[0].rstrip("."), "") if kind == "person" else ""
            found.append((a, -b, order, kind, gender_of(m["v"], title) if kind == "person" else ""))
    found.sort()
    taken: list[tuple[int, int, str, str]] = []
    for a, b, _, kind, gender in found:
        if taken and a < taken[-1][1]:
            if -b > taken[-1][1]:
                taken[-1] = (taken[-1][0], -b, "secret", "")
            continue
        taken.append((a, -b, kind, gender))
    return taken


def persons(text: str) -> list[tuple[str, str]]:
    """(name, gender) after titles; a superset of those that find() gives."""
    if not _TITLE_MARK.search(text):
        return []
    return [
        (m["v"], gender_of(m["v"], TITLES.get(m[0].split()[0].rstrip("."), ""))) for m in _COMPILED["person"].finditer(text)
    ]


def replace(
    text: str, key: str = KEY, turns: dict[str, int] | None = None, syllables: int = SYLLABLES_OF_NAME
) -> tuple[str, list[tuple[int, int, str, str, str]]]:
    """The text with surrogates, and (start, end, type, value, surrogate) of each entity.

    turns: how often names were drawn again, by gender and name joined with a line feed.
    """
    out, at, entities = [], 0, []
    for a, b, kind, gender in find(text):
        value = text[a:b]
        new = surrogate(kind, value, key, gender, turns.get(f"{gender}\n{value}", 0) if turns else 0, syllables)
        out += [text[at:a], new]
        entities.append((a, b, kind, value, new))
        at = b
    return "".join(out) + text[at:], entities


_ENTITY = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("type", pa.string()), ("value", pa.string()), ("surrogate", pa.string())])


def _replaced(batches: Iterator[pa.RecordBatch], key: str, syllables: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.slice(at, 256)
            texts, found = [], []
            for t, turns in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                new, entities = replace(t, key, dict(turns or ()), syllables) if t else (t, [])
                texts.append(new)
                found.append([dict(zip(("start", "end", "type", "value", "surrogate"), e)) for e in entities])
            yield pa.RecordBatch.from_arrays(
                [part.column(0).cast(pa.int64()), pa.array(texts, pa.string()), pa.array(found, pa.list_(_ENTITY))],
                ["doc_id", "text", "entities"],
            )


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def _pass(rows: DataFrame, key: str, syllables: int = SYLLABLES_OF_NAME) -> DataFrame:
    return rows.select("doc_id", "text", "turns").mapInArrow(
        lambda it: _replaced(it, key, syllables),
        "doc_id long, text string, entities array<struct<start:int,end:int,type:string,value:string,surrogate:string>>",
    )


_NO_TURNS = "cast(null as map<string, int>)"


def pseudonymise(docs: DataFrame, key: str = KEY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, entities) for every row: the text with surrogates and what was replaced.

    entities holds the values found; drop its field `value` before passing the rows on.
    """
    return _pass(_rows(docs, id_col, text_col).withColumn("turns", F.expr(_NO_TURNS)), key)


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.slice(at, 256)
            rows = [
                (doc, value, gender) for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist())
                for value, gender in set(persons(text or ""))
            ]
            columns = list(zip(*rows)) or [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())],
                ["doc_id", "value", "gender"],
            )


def distinct_names(names: DataFrame, scratch: Scratch, key: str = KEY, syllables: int = SYLLABLES_OF_NAME) -> DataFrame:
    """(value, gender, turn, surrogate): draws of all names of the table (value, gender), of which
    no two share a surrogate and none keeps its own value."""

    @F.pandas_udf("string")
    def draw(value: pd.Series, gender: pd.Series, turn: pd.Series) -> pd.Series:
        return pd.Series([_person(v, key, g, int(t), syllables) for v, g, t in zip(value, gender, turn)])

    drawn = names.select("value", "gender").distinct().withColumn("turn", F.lit(0))
    drawn = scratch.put(drawn.withColumn("surrogate", draw("value", "gender", "turn")), "drawn")
    same = Window.partitionBy("surrogate").orderBy("value", "gender")
    while True:
        ranked = drawn.withColumn("again", (F.row_number().over(same) > 1) | (F.col("surrogate") == F.col("value")))
        ranked = scratch.put(ranked, "ranked")
        if not ranked.where("again").limit(1).count():
            return drawn
        anew = ranked.where("again").select("value", "gender", (F.col("turn") + 1).alias("turn"))
        anew = anew.withColumn("surrogate", draw("value", "gender", "turn"))
        drawn = scratch.put(ranked.where("not again").drop("again").unionByName(anew), "drawn")


def pseudonymise_distinct(
    docs: DataFrame, key: str = KEY, id_col: str = "doc_id", text_col: str = "text", syllables: int = SYLLABLES_OF_NAME
) -> DataFrame:
    """As pseudonymise(), after a check of the whole table: names whose draws collide are drawn again.

    The surnames of `syllables` syllables must outnumber the names, or no draw can tell them apart.
    """
    scratch = Scratch(docs.sparkSession, "names")
    rows = _rows(docs, id_col, text_col)
    held = scratch.put(
        rows.where("text is not null").mapInArrow(_named, "doc_id long, value string, gender string"), "held"
    )
    changed = scratch.put(distinct_names(held, scratch, key, syllables).where("turn > 0").drop("surrogate"), "changed")
    n = changed.count()
    if not n:
        return _pass(rows.withColumn("turns", F.expr(_NO_TURNS)), key, syllables)
    entry = F.struct(F.concat("gender", F.lit("\n"), "value"), "turn")
    turns = (
        held.join(sized(changed, n, 64), ["value", "gender"]).groupBy(F.col("doc_id").alias("_doc"))
        .agg(F.map_from_entries(F.collect_set(entry)).alias("turns"))
    )
    turns = scratch.put(turns, "turns")
    return _pass(rows.join(sized(turns, turns.count(), 256), F.col("doc_id").eqNullSafe(F.col("_doc")), "left"), key, syllables)


def collisions(replaced: DataFrame) -> DataFrame:
    """(type, surrogate, n): surrogates that stand for several values; none are expected."""
    e = replaced.select(F.explode("entities").alias("e")).select("e.type", "e.value", "e.surrogate")
    return e.distinct().groupBy("type", "surrogate").agg(F.count("*").alias("n")).where("n > 1")
