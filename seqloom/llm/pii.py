"""Surrogates for personal data.

Detected entities (mail addresses, phone numbers, IPv4 addresses, payment cards, account numbers, access
keys, passwords and tokens, titled person names) are replaced by keyed surrogates of the same type and format.

Values made of letters and digits go through a keyed permutation of all values of the same shape (a Feistel
network with cycle walking), so distinct values stay distinct, and equal ones stay equal, in every
document and every run with the same key. Names are drawn from syllables by keyed hash, in the gender
of their title and the script of the name. In a text that names somebody in full after a title, later mentions of the full name without one,
and of the family name alone after the same title's gender, are that person, where no other full name of the text ends so; the family name
alone gets the end of the full surrogate. A collision check over the distinct entities of the corpus
moves all but one of those that met to another draw, which has more syllables.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import small_batches, stage

KEY = b"seqloom surrogate key"

DIGITS, LOWER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"
UPPER, BASE32 = LOWER.upper(), "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Herr": "m", "Frau": "f", "Señor": "m", "Señora": "f", "Monsieur": "m", "Madame": "f", "Mme": "f", "г-н": "m", "г-жа": "f"}
GIVEN = {
    ("latin", "m"): ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Hugo", "Jonas", "Leo", "Martin", "Oscar", "Paul", "Robert", "Simon", "Thomas", "Victor"],
    ("latin", "f"): ["Alice", "Berta", "Clara", "Diana", "Emma", "Flora", "Helena", "Julia", "Laura", "Maria", "Olivia", "Paula", "Rosa", "Sonia", "Teresa", "Vera"],
    ("cyrillic", "m"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Олег"],
    ("cyrillic", "f"): ["Анна", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Мария", "Ольга"],
}
SYLLABLES = {"latin": ["ba", "cor", "del", "fen", "gra", "hol", "jan", "kel", "lor", "men", "nor", "pel", "ran", "sol", "tam", "vir"], "cyrillic": ["бо", "ва", "гор", "дел", "жу", "зор", "ка", "лем", "мир", "нов", "пет", "рад", "сол", "тар", "фе", "хол"]}
ENDING = {("cyrillic", "f"): "ова", ("cyrillic", "m"): "ов"}

_NAME = r"[A-ZÀ-ÖØ-ÞА-Я][\w’'-]*[a-zß-ÿа-я]"
PATTERNS = [
    ("email", r"(?<![A-Za-z0-9_%+-])[A-Za-z0-9_%+-](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_%+-])?@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    ("key", r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])"),
    ("secret", r"(?i:(?:password|passwd|pwd|secret|token|api[_-]?key)\s*[=:]\s*[\"']?)[A-Za-z0-9+/_.-]*[A-Za-z0-9+/_-]"),
    ("ip", r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)"),
    ("account", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    ("card", r"(?<![\w.])\d(?:[ -]?\d){12,18}(?![\w]|\.\d)"),
    ("phone", r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]?\d{3,4}(?![\w]|\.\d)|(?<![\w.])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?![\w]|\.\d)"),
]


@cache
def _finder(at: bool, equals: bool) -> re.Pattern:
    """The patterns that a text can match, given whether it holds @, and = or a colon."""
    own = [(k, p) for k, p in PATTERNS if (k != "email" or at) and (k != "secret" or equals)]
    return re.compile(("" if at or equals else "(?=[0-9A-Z+(])(?:") + "|".join(f"(?P<{k}>{p})" for k, p in own) + ("" if at or equals else ")"))


NAMES = re.compile(rf"(?<!\w)({'|'.join(TITLES)})(\.? )({_NAME}(?: {_NAME}){{0,2}})(?!\w)")
HINT = re.compile(r"[@0-9=:]")


def _prf(key: bytes, tag: str, value: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{tag}:{value}".encode(), key=key, digest_size=16).digest(), "big")


def permute(value: int, size: int, key: bytes, tag: str) -> int:
    """Keyed permutation of 0..size-1: eight Feistel rounds, walked along the cycle until within size."""
    if size <= 1:
        return value
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = value >> half, value & mask
        for r in range(8):
            left, right = right, left ^ (_prf(key, f"{tag}/{size}/{r}", right) & mask)
        value = left << half | right
        if value < size:
            return value


def permute_shape(text: str, key: bytes, tag: str, alphabets: tuple[str, ...] = (DIGITS, LOWER, UPPER)) -> str:
    """Permute text among all texts whose characters have the same alphabets, place by place; others stay."""
    own = [next((a for a in alphabets if c in a), None) for c in text]
    value, size = 0, 1
    for c, a in zip(text, own, strict=True):
        if a:
            value, size = value * len(a) + a.index(c), size * len(a)
    if size > 1:
        value = permute(value, size, key, tag)
    out = []
    for c, a in zip(reversed(text), reversed(own), strict=True):
        if a:
            value, at = divmod(value, len(a))
            c = a[at]
        out.append(c)
    return "".join(reversed(out))


def _put_digits(text: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c in DIGITS else c for c in text)


def luhn(digits: str) -> int:
    """Sum modulo 10; 0 for a valid number."""
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10


def _card(digits: str, key: bytes) -> str:
    body = digits[0] + permute_shape(digits[1:-1], key, f"card{digits[0]}")
    return body + str(-luhn(body + "0") % 10)


RANGES = [(10 << 24, 24), (172 << 24 | 16 << 16, 20), (192 << 24 | 168 << 16, 16), (127 << 24, 24), (0, 24)]


def _ip(text: str, key: bytes) -> str:
    value = 0
    for x in text.split("."):
        value = value << 8 | int(x)
    for base, bits in RANGES:
        if value >> bits == base >> bits:
            value = base | permute(value - base, 1 << bits, key, f"ip{base}")
            break
    else:
        top = value >= 224 << 24
        while True:
            value = permute(value, 1 << 32, key, "ip")
            if (value >= 224 << 24) == top and not any(value >> b == a >> b for a, b in RANGES):
                break
    return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))


#: Country codes of two digits; 1 and 7 are whole codes, all others have three.
CODES = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def _phone(canon: str, key: bytes) -> str:
    """Digits of the surrogate: the country code stays, and numbers reserved for fiction (555) stay among themselves."""
    digits = canon.removeprefix("+")
    country = 0 if digits == canon else 1 if digits[0] in "17" else 2 if digits[:2] in CODES else 3
    code, rest = digits[:country], digits[country:]
    fiction = lambda x: len(x) == 10 and x[3:6] == "555"
    fixed = "555" if fiction(rest) else ""
    own = rest[:3] + rest[6:] if fixed else rest
    first = lambda x: (x[0] > "0") + (x[0] > "1")
    kind, out = first(own), own
    while True:
        out = permute_shape(out, key, f"phone{code}{fixed}")
        if first(out) == kind and not fiction(out):
            break
    return code + (out[:3] + fixed + out[3:] if fixed else out)


def _email(text: str, key: bytes) -> str:
    local, _, domain = text.lower().partition("@")
    *labels, top = domain.split(".")
    if not (labels and labels[-1] == "example") and top not in ("example", "test", "invalid"):
        labels = [permute_shape(x, key, f"label.{top}") for x in labels]
        while labels[-1] == "example":  # such domains stay as they are
            labels[-1] = permute_shape(labels[-1], key, f"label.{top}")
    out = f"{permute_shape(local, key, 'local@' + domain)}@{'.'.join([*labels, top])}"
    return "".join(n.upper() if o.isupper() else n for o, n in zip(text, out, strict=True))


def _checked(country: str, body: str) -> str:
    """The account number with its two check digits for modulo 97."""
    check = 98 - int("".join(str(int(c, 36)) for c in f"{body}{country}00")) % 97
    return f"{country}{check:02d}{body}"


def _account(chars: str, key: bytes) -> str:
    """Keep the country; permute the rest; set the check digits."""
    return _checked(chars[:2], permute_shape(chars[4:], key, f"account{chars[:2]}"))


def _secret(text: str, key: bytes, tag: str, narrow: str, wide: tuple[str, ...]) -> str:
    """Permute text among those of the narrow alphabet alone, if it is one, else among the others of its shape."""
    if all(c in narrow for c in text):
        return permute_shape(text, key, tag, (narrow,))
    out = text
    while True:
        out = permute_shape(out, key, tag, wide)
        if any(c not in narrow for c in out):
            return out


def script(name: str) -> str:
    return "cyrillic" if re.search("[А-Яа-яё]", name) else "latin"


def name_surrogate(canon: str, attempt: int, key: bytes) -> str:
    """canon: gender, |, name. As many words as the name has; given name of the gender, family name of four syllables and one more for each attempt."""
    gender, _, name = canon.partition("|")
    kind, words = script(name), name.split(" ")
    seed, n = int.from_bytes(canon.encode(), "big"), 4 + attempt
    draw = _prf(key, f"name{attempt}/{kind}", seed)
    if attempt:
        draw |= _prf(key, f"more{attempt}/{kind}", seed) << 128
    out = []
    for i in range(len(words)):
        if i == 0 and len(words) > 1:
            draw, at = divmod(draw, len(GIVEN[kind, gender]))
            out.append(GIVEN[kind, gender][at])
        else:
            draw, at = divmod(draw, 16**n)
            out.append("".join(SYLLABLES[kind][at >> 4 * s & 15] for s in range(n)).capitalize() + ENDING.get((kind, gender), ""))
    return " ".join(out)


def _valid(kind: str, text: str) -> bool:
    if kind == "card":
        return luhn(re.sub(r"\D", "", text)) == 0
    if kind == "account":
        chars = text.replace(" ", "")
        return int("".join(str(int(c, 36)) for c in chars[4:] + chars[:4])) % 97 == 1
    if kind == "phone":
        return 7 <= sum(c in DIGITS for c in text) <= 15
    return True


def _canon(kind: str, value: str) -> str:
    """What all ways to write an entity have in common. A phone number keeps its plus."""
    if kind == "email":
        return value.lower()
    if kind in ("card", "ssn", "phone"):
        return ("+" if kind == "phone" and value[0] == "+" else "") + re.sub(r"\D", "", value)
    if kind == "account":
        chars = value.replace(" ", "")
        return _checked(chars[:2], chars[4:])
    if kind == "ip":
        return ".".join(str(int(x)) for x in value.split("."))
    return value


def find(text: str) -> list[tuple[int, int, str, str]]:
    """start, end, type, canonical value of every entity, in order, without overlaps."""
    found = []
    if HINT.search(text):
        for m in _finder("@" in text, "=" in text or ":" in text).finditer(text):
            kind, start, value = m.lastgroup, m.start(), m[0]
            if kind == "secret":
                start += re.match(r"(?i)[\w-]+?\s*[=:]\s*[\"']?", value).end()
                value = text[start : m.end()]
            if _valid(kind, value):
                found.append((start, m.end(), kind, _canon(kind, value)))
            elif kind == "card" and _valid("phone", value):
                found.append((start, m.end(), "phone", _canon("phone", value)))
    if any(t in text for t in TITLES):
        found += _names(text, found)
    return sorted(found)


def _names(text: str, taken: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """Mentions of people outside what is taken: after a title, and of their full names without one."""
    ends = sorted((a, b) for a, b, _, _ in taken)
    starts = [a for a, _ in ends]

    def free(a: int, b: int) -> bool:
        at = bisect_left(starts, b)  # entities do not overlap: the last that starts before b is the only one to look at
        return at == 0 or ends[at - 1][1] <= a

    titled = [(m.start(3), m.end(3), TITLES[m[1]], m[3]) for m in NAMES.finditer(text) if free(m.start(), m.end())]
    full = {(gender, name) for _, _, gender, name in titled if " " in name}
    families: dict[tuple[str, str], set[str]] = {}
    for gender, name in full:
        families.setdefault((gender, name.rpartition(" ")[2]), set()).add(name)
    out = []
    for a, b, gender, name in titled:
        own = families.get((gender, name), ())
        out.append((a, b, "name", f"{gender}|{next(iter(own)) if len(own) == 1 else name}"))
    genders: dict[str, set[str]] = {}
    for gender, name in full:
        genders.setdefault(name, set()).add(gender)
    bare = sorted((n for n, g in genders.items() if len(g) == 1), key=lambda n: (-len(n), n))
    if bare:
        ends = sorted([*ends, *[(a, b) for a, b, _, _ in titled]])
        starts = [a for a, _ in ends]
        for m in re.finditer(rf"(?<!\w)(?:{'|'.join(map(re.escape, bare))})(?!\w)", text):
            if free(m.start(), m.end()):
                out.append((m.start(), m.end(), "name", f"{next(iter(genders[m[0]]))}|{m[0]}"))
    return out


def surrogate(kind: str, canon: str, text: str, key: bytes, attempt: int = 0) -> str:
    """The replacement of text, which is how one mention writes the entity."""
    if kind == "name":
        return " ".join(name_surrogate(canon, attempt, key).split(" ")[-len(text.split(" ")) :])
    if kind == "email":
        return _email(text, key)
    if kind == "ip":
        return _ip(text, key)
    if kind == "card":
        return _put_digits(text, _card(canon, key))
    if kind == "ssn":
        return _put_digits(text, permute_shape(canon, key, "ssn"))
    if kind == "phone":
        return _put_digits(text, _phone(canon, key))
    if kind == "account":
        it = iter(_account(canon, key))
        return "".join(c if c == " " else next(it) for c in text)
    if kind == "key":
        return "AKIA" + _secret(text[4:], key, "key", BASE32, (DIGITS + UPPER,))
    return _secret(text, key, "secret", HEX, (DIGITS, LOWER, UPPER))


def replace(text: str | None, key: bytes = KEY, attempts: dict[str, int] | None = None) -> tuple[str | None, list[str]]:
    """The text with surrogates, and the types of the entities replaced."""
    if not text:
        return text, []
    out, at, kinds = [], 0, []
    for start, end, kind, canon in find(text):
        new = surrogate(kind, canon, text[start:end], key, (attempts or {}).get(canon, 0) if kind == "name" else 0)
        out += [text[at:start], new]
        at = end
        kinds.append(kind)
    return "".join([*out, text[at:]]), kinds


def entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The distinct entities of the corpus: kind, canon, text (one of the ways it is written)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen = {}
            for t in b["text"]:
                for start, end, kind, canon in find(t or ""):
                    seen.setdefault((kind, canon), canon.partition("|")[2] if kind == "name" else t[start:end])
            yield pd.DataFrame([(*k, v) for k, v in seen.items()], columns=["kind", "canon", "text"])

    return docs.select(F.col(text_col).alias("text")).mapInPandas(run, "kind string, canon string, text string").groupBy("kind", "canon").agg(F.min("text").alias("text"))


def collision_check(found: DataFrame, key: bytes = KEY, most: int = 100_000, rounds: int = 20) -> dict[str, int] | DataFrame:
    """Draws of the names whose first draw met another entity's surrogate. Raises if other types collide.

    Each round draws anew, with one more syllable, for all but the smallest entity of a surrogate. A dict of at
    most `most` names (they go to every task); more of them are a table of canon and attempt, to be joined.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, c, t, a in zip(b["kind"], b["canon"], b["text"], b["attempt"], strict=True):
                new = _normal(k, surrogate(k, c, t, key, a))
                out.append((k, c, t, a, new))
                if k == "name" and " " in new:  # its end stands for the family name alone
                    out.append((k, c, None, a, new.rpartition(" ")[2]))
            yield pd.DataFrame(out, columns=["kind", "canon", "text", "attempt", "new"])

    rows = found.select("kind", "canon", "text", F.lit(0).alias("attempt"))
    for _ in range(rounds):
        drawn = stage(rows.mapInPandas(run, "kind string, canon string, text string, attempt int, new string"), "draws")
        first = drawn.groupBy("kind", "new").agg(F.min("canon").alias("first"), F.count("*").alias("n")).where("n > 1")
        met = stage(drawn.join(first, ["kind", "new"]).where("canon <> first").select("kind", "canon").distinct(), "met")
        drawn = drawn.where("text is not null")
        kinds = sorted(r["kind"] for r in met.select("kind").distinct().collect())
        if set(kinds) - {"name"}:
            raise ValueError(f"surrogates of different entities are equal: {', '.join(kinds)}")
        if not kinds:
            redrawn = drawn.where("attempt > 0").select("canon", "attempt")
            return redrawn if redrawn.count() > most else {r["canon"]: r["attempt"] for r in redrawn.collect()}
        again = met.select("kind", "canon", F.lit(1).alias("again"))
        rows = drawn.where("kind = 'name'").join(again, ["kind", "canon"], "left").select("kind", "canon", "text", (F.col("attempt") + F.coalesce("again", F.lit(0))).alias("attempt"))
    raise ValueError("names still meet after all rounds")


def _normal(kind: str, new: str) -> str:
    """A surrogate without what the way of writing adds."""
    return new if kind == "name" else _canon(kind, new)


def _with_redraws(docs: DataFrame, text_col: str, redrawn: DataFrame) -> DataFrame:
    """docs with column _redraws: the attempts of the redrawn names in each text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(h, c) for h, t in zip(b["h"], b["text"]) for c in {c for _, _, kind, c in find(t or "") if kind == "name"}]
            yield pd.DataFrame(rows, columns=["h", "canon"])

    named = docs.select(F.sha2(F.col(text_col), 256).alias("h"), F.col(text_col).alias("text")).where("text is not null").mapInPandas(run, "h string, canon string").distinct()
    own = named.join(redrawn, "canon").groupBy("h").agg(F.map_from_entries(F.collect_list(F.struct("canon", "attempt"))).alias("_redraws"))
    return docs.withColumn("_h", F.sha2(F.col(text_col), 256)).join(own, F.col("_h") == F.col("h"), "left").select(*docs.columns, "_redraws")


def pseudonymise(docs: DataFrame, text_col: str = "text", key: bytes = KEY, found_col: str | None = "entities") -> DataFrame:
    """docs with surrogates in text_col, and the types found in each text in found_col (array; None: no such column).

    All rows and columns stay. Null and empty texts stay as they are; whole texts are read; equal texts
    become equal texts; an empty table stays empty. An existing column named found_col is replaced.
    """
    attempts = collision_check(stage(entities(docs, text_col), "entities"), key)
    small_batches(docs.sparkSession)
    docs = docs.drop(found_col) if found_col in docs.columns else docs
    fields = docs.select("*", *([F.array(F.lit("")).alias(found_col)] if found_col else [])).schema
    joined = not isinstance(attempts, dict)
    if joined:
        docs, attempts = _with_redraws(docs, text_col, attempts), None

    def run(batches):
        import pyarrow as pa

        for b in batches:
            at = b.schema.get_field_index(text_col)
            drawn = [dict(d or ()) for d in b.column("_redraws").to_pylist()] if joined else [attempts] * len(b)
            done = [replace(t, key, d) for t, d in zip(b.column(at).to_pylist(), drawn, strict=True)]
            b = b.drop_columns(["_redraws"]) if joined else b
            b = b.set_column(at, b.schema.field(at), pa.array([t for t, _ in done], b.schema.field(at).type))
            yield b.append_column(found_col, pa.array([k for _, k in done], pa.list_(pa.string()))) if found_col else b

    return docs.mapInArrow(run, fields)
