"""Personal data replaced by keyed surrogates of the same type and format.

A surrogate is a keyed permutation of the entity within its own format: digits stay
digits, letters stay letters of their case, card numbers keep their check, IBANs get
a fitting one, addresses stay in their class of network, names keep script and gender.
A permutation never maps two entities of one format to one surrogate. What is left -
an entity mapped to itself or to another entity of the corpus, or drawn names that
meet - is found by a check over all distinct entities in Spark, and those entities
move to another permutation until no collision is left. The same entity becomes the
same surrogate everywhere, however it is punctuated or capitalised.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seamline.storage import store

#: Entities on another than their first permutation that are handed to every task; more are joined.
_HANDED_OUT = 10_000
#: Rounds of the collision check before it gives up.
_ROUNDS = 32

# What entities look like, by kind.
_DIGITAL = re.compile(
    r"(?P<email>[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})"
    r"|(?P<aws>(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9]))"
    r"|(?P<secret>(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key)\b\s*[=:]\s*[\"']?))(?P<value>[^\s\"',;]{6,})"
    r"|(?P<iban>\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b)"
    r"|(?P<ip>(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<card>(?<![\w.-])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\w-]))"
    r"|(?P<phone>(?<![\w.-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]?\d{3,4}(?![\w-]))"
    r"|(?P<intl>(?<!\w)\+\d{8,15}(?!\w))"
)
#: Every match but a name has one of these in it.
_ANCHOR = re.compile(r"[\d@=:]|AKIA")
#: The rest of a word, and the next word.
_ONWARD = re.compile(r"(\S*)(?:\s+\S+)?")
_TITLES = {
    "m": ("Mr", "Mister", "Herr", "Herrn", "Monsieur", "Señor", "Господин"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mademoiselle", "Señora", "Señorita", "Госпожа"),
}
_GIVEN = {
    ("latin", "m"): "Adam Anton Bruno Carl Daniel Emil Felix Georg Hugo Ivan Jonas Karl Leo Martin Noel Oscar Paul "
    "Robert Simon Thomas Victor Walter".split(),
    ("latin", "f"): "Alice Anna Bella Clara Diana Elena Emma Flora Greta Helena Ida Julia Karla Laura Maria Nora Olga "
    "Paula Rosa Sara Teresa Vera".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Олег Павел".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Ирина Ксения Лидия Мария Нина Ольга Софья".split(),
}
_SYLLABLES = {
    "latin": "ba be bo da de do fa ga go ka ke ko la le lo ma me mo na ne no pa po ra re ro sa se so ta te to va ve vo "
    "wa we zo".split(),
    "cyrillic": "ба бе бо ва ве во га го да де до за зо ка ке ко ла ле ло ма ме мо на не но па по ра ре ро са се со "
    "та те то".split(),
}
_FAMILY_END = {("latin", "m"): "n", ("latin", "f"): "n", ("cyrillic", "m"): "в", ("cyrillic", "f"): "ва"}

_NAME = r"[A-ZÀ-ÖØ-ÞА-ЯЁ][a-zß-öø-ÿа-яё]+(?:[-'’][A-ZÀ-ÖØ-ÞА-ЯЁ][a-zß-öø-ÿа-яё]+)?"
_PERSON = re.compile(
    rf"\b(?P<title>{'|'.join(sorted(sum(_TITLES.values(), ()), key=len, reverse=True))})\.?[ \t]+"
    rf"(?P<one>{_NAME})(?:[ \t]+(?P<two>{_NAME}))?"
)
_GENDER = {title: gender for gender, titles in _TITLES.items() for title in titles}

# -------------------------------------------------------------------- detection

#: start, end, kind, key. The key is what coreferent mentions share.
Entity = tuple[int, int, str, str]


def entities(text: str) -> list[Entity]:
    """Entities of a whole text in their order, without overlaps."""
    found = [e for start, end in _windows(text) for e in _digital(text, start, end)]
    for match in _PERSON.finditer(text):
        found.extend(_person(match))
    found.sort()
    apart: list[Entity] = []
    for entity in found:
        if not apart or entity[0] >= apart[-1][1]:
            apart.append(entity)
    return apart


def _windows(text: str) -> Iterator[tuple[int, int]]:
    """Stretches of whole words that hold every match but names, and all of each match.

    A match is of words with an anchor each, or of a keyword, a sign and a value, where
    the sign is an anchor. So a word with an anchor brings the words next to it, and
    stretches that meet are one. Between stretches is white space, as at the end of a text.
    """
    start = end = 0
    found = _ANCHOR.search(text)
    while found:
        left = found.start()
        if left >= end:
            left = _word_start(text, _word_start(text, left, end), end)
            if left > end:
                if end:
                    yield start, end
                start = left
        onward = _ONWARD.match(text, found.end())
        end = onward.end()
        found = _ANCHOR.search(text, onward.end(1))
    if end:
        yield start, end


def _word_start(text: str, at: int, least: int) -> int:
    """Start of the word before ``at``, past the white space next to it."""
    while at > least and text[at - 1].isspace():
        at -= 1
    while at > least and not text[at - 1].isspace():
        at -= 1
    return at


def _digital(text: str, start: int, end: int) -> Iterator[Entity]:
    for match in _DIGITAL.finditer(text, start, end):
        kind, value = match.lastgroup, match.group()
        first, last = match.span()
        digits = "".join(str(int(c)) for c in re.findall(r"\d", value))
        if kind == "value":
            kind, value, first = "secret", match["value"].rstrip(".)]}"), match.start("value")
            last, key = first + len(value), value
        elif kind == "aws":
            kind, key = "secret", value
        elif kind == "email":
            key = value.lower()
        elif kind == "ip":
            if any(int(part) > 255 or part != str(int(part)) for part in value.split(".")):
                continue
            key = value
        elif kind == "iban":
            if _mod97(value) != 1:
                continue
            key = value
        elif kind in ("phone", "intl"):
            country = re.match(r"\+(\d{1,3})(?=[ .(-])", value)
            kind, lead = "phone", digits[: len(country[1])] if country else ""
            key = f"{lead}:{digits[len(lead):]}"
            if not 7 <= len(digits) <= 15:
                continue
        else:
            if kind == "card" and not 13 <= len(digits) <= 19:
                continue
            key = digits
        yield first, last, kind, key


def _person(match: re.Match) -> Iterator[Entity]:
    gender = _GENDER[match["title"]]
    names = [("one", "family")] if match["two"] is None else [("one", "given"), ("two", "family")]
    for group, role in names:
        script = "cyrillic" if match[group][0] >= "Ѐ" else "latin"
        # The family name of a couple or of its mentions without a given name is one
        # entity in scripts whose names have no gender.
        sort = gender if role == "given" or script == "cyrillic" else "m"
        yield *match.span(group), f"{role}/{script}/{sort}", match[group].lower()


# ------------------------------------------------------------------- surrogates


class Keyed:
    """Keyed permutations of ranges of numbers."""

    def __init__(self, key: bytes) -> None:
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def number(self, tweak: str, value: int | str, below: int) -> int:
        digest = hashlib.blake2b(f"{tweak}|{value}".encode(), key=self.key).digest()
        return int.from_bytes(digest, "big") % below

    def permuted(self, tweak: str, value: int, size: int) -> int:
        """A bijection of 0..size-1: Feistel rounds on a grid, walking on while outside."""
        rows = isqrt(size - 1) + 1
        columns = -(-size // rows)
        while True:
            left, right = divmod(value, columns)
            for round_ in range(0, 8, 2):
                left = (left + self.number(f"{tweak}|{round_}", right, rows)) % rows
                right = (right + self.number(f"{tweak}|{round_ + 1}", left, columns)) % columns
            value = left * columns + right
            if value < size:
                return value

    def characters(self, tweak: str, text: str, alphabets: list[str | None], same: Callable[[str], object]) -> str:
        """``text`` permuted among the strings over its alphabets for which ``same`` is equal.

        A character without an alphabet stays.
        """
        free = [i for i, a in enumerate(alphabets) if a]
        size, kind, out = 1, same(text), list(text)
        for i in free:
            size *= len(alphabets[i])
        if size < 2:
            return text
        value = 0
        for i in free:
            value = value * len(alphabets[i]) + alphabets[i].index(text[i])
        while True:
            value = self.permuted(f"{tweak}|{size}", value, size)
            rest = value
            for i in reversed(free):
                rest, digit = divmod(rest, len(alphabets[i]))
                out[i] = alphabets[i][digit]
            if same("".join(out)) == kind:
                return "".join(out)


_DIGITS, _LOWER, _UPPER, _HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"


def _classes(text: str) -> list[str | None]:
    """The alphabet of each character's class."""
    return [next((a for a in (_DIGITS, _LOWER, _UPPER) if c in a), None) for c in text]


def surrogate(keyed: Keyed, kind: str, key: str, attempt: int = 0) -> str:
    """The key of the surrogate of an entity; another one for each ``attempt``."""
    tweak = f"{kind}|{attempt}"
    extra = "".join(_DIGITS[keyed.number(f"{tweak}|{i}", key, 10)] for i in range(attempt // 2))
    if kind == "email":
        local, _, domain = key.rpartition("@")
        if not re.fullmatch(r"(?:.*\.)?example\.(?:com|net|org)", domain):
            # Real domains become names below one that is reserved for examples.
            label = keyed.number(f"{tweak}|domain", domain, 32**10)
            domain = "".join(f"{_LOWER}234567"[label >> 5 * i & 31] for i in range(10)) + ".example.com"
        return f"{keyed.characters(tweak + key.rpartition('@')[2], local, _classes(local), len)}{extra}@{domain}"
    if kind == "ip":
        value = 0
        for part in key.split("."):
            value = value << 8 | int(part)
        network = _network(value)
        if network:
            # Within a range set apart its own bits are permuted, however small it is.
            prefix, bits = _RANGES[network - 1]
            low = (1 << 32 - bits) - 1
            value = prefix << 32 - bits | keyed.permuted(f"{tweak}|{prefix}/{bits}", value & low, low + 1)
        else:
            # Most addresses are public, so the walk is short.
            value = keyed.permuted(tweak, value, 1 << 32)
            while _network(value):
                value = keyed.permuted(tweak, value, 1 << 32)
        return ".".join(str(value >> shift & 255) for shift in (24, 16, 8, 0))
    if kind == "card":
        body = keyed.characters(tweak, key[1:-1], [_DIGITS] * (len(key) - 2), len)
        offset = (int(key[-1]) - _luhn(key[:-1])) % 10
        return key[0] + body + str((_luhn(key[0] + body) + offset) % 10)
    if kind == "phone":
        lead, _, number = key.partition(":")
        alphabets: list[str | None] = [_DIGITS] * len(number)
        if number[0] in "23456789":
            alphabets[0] = "23456789"
        fictional = len(number) == 10 and number[3:6] == "555"
        if fictional and not attempt:
            alphabets[3:6] = [None] * 3
        fixed = (lambda n: n[3:6] == "555") if len(number) == 10 and not attempt else len
        return f"{lead}:{keyed.characters(tweak + lead, number, alphabets, fixed)}"
    if kind == "iban":
        body = keyed.characters(tweak + key[:2], key[4:], _classes(key[4:]), len)
        return f"{key[:2]}{98 - _mod97(f'{key[:2]}00{body}'):02d}{body}"
    if kind == "ssn":
        return keyed.characters(tweak, key, [_DIGITS] * 9, len)
    if kind == "secret":
        head = "AKIA" if key.startswith("AKIA") else ""
        rest = key[len(head) :]
        hexadecimal = re.fullmatch(r"[0-9a-f]*[a-f][0-9a-f]*", rest)
        alphabets = [_HEX] * len(rest) if hexadecimal else _classes(rest)
        same = (lambda t: bool(re.search("[a-f]", t))) if hexadecimal else len
        return head + keyed.characters(tweak + str(bool(hexadecimal)), rest, alphabets, same) + ("" if head else extra)
    role, script, gender = kind.split("/")
    if role == "given":
        names = _GIVEN[script, gender]
        drawn = names[keyed.number(tweak, key, len(names))].lower()
        return drawn + _syllables(keyed, tweak, key, script, attempt)
    return _syllables(keyed, tweak, key, script, 4 + attempt // 2) + _FAMILY_END[script, gender]


def _syllables(keyed: Keyed, tweak: str, key: str, script: str, count: int) -> str:
    of = _SYLLABLES[script]
    return "".join(of[keyed.number(f"{tweak}|s{i}", key, len(of))] for i in range(count))


#: Prefixes of IPv4 ranges set apart, and their numbers of bits.
_RANGES = ((0, 8), (10, 8), (127, 8), (0xA9FE, 16), (0xAC1, 12), (0xC0A8, 16), (0xE, 4), (0xF, 4))


def _network(address: int) -> int:
    """Class of an IPv4 address: public, or one of the ranges set apart."""
    return next((i for i, (prefix, bits) in enumerate(_RANGES, 1) if address >> 32 - bits == prefix), 0)


def _luhn(digits: str) -> int:
    """The check digit that follows ``digits``."""
    doubled = (int(d) * (2 - i % 2) for i, d in enumerate(reversed(digits)))
    return -sum(d - 9 * (d > 9) for d in doubled) % 10


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def rendered(kind: str, mention: str, key: str) -> str:
    """The surrogate ``key`` with the punctuation and capitals of ``mention``."""
    if kind == "ip":
        return key
    if "/" in kind:
        return key.upper() if mention.isupper() else key[:1].upper() + key[1:]
    if kind == "email":
        local, _, domain = key.rpartition("@")
        upper = [c.isupper() for c in mention.rpartition("@")[0]]
        local = "".join(c.upper() if i < len(upper) and upper[i] else c for i, c in enumerate(local))
        return f"{local}@{domain.upper() if mention.isupper() else domain}"
    if kind == "secret":
        return key
    characters = iter(re.sub(r"[^0-9A-Za-z]", "", key))
    return "".join(next(characters, "") if c.isalnum() else c for c in mention)


# ------------------------------------------------------------------------ Spark


def replace_entities(
    docs: DataFrame, key: bytes, text_column: str = "text", count_column: str | None = None
) -> DataFrame:
    """``docs`` with every detected entity of ``text_column`` replaced by its surrogate.

    Detected are e-mail addresses, phone, card and social security numbers, IBANs, IPv4
    addresses, secrets after a keyword and names after a title. A null text stays null,
    texts without entities stay as they are; repeated rows are treated alike; other
    columns are passed through. ``count_column`` names a column, added or replaced, with
    the number of replacements (0 for a null text). An empty table gives an empty result.
    Whoever holds ``key`` can tell surrogates; keep it secret and per corpus.
    """
    if count_column:
        docs = docs.drop(count_column)
    moved = _moved(docs.select(F.col(f"`{text_column}`").cast("string").alias("text")), key)
    if moved.count() <= _HANDED_OUT:
        attempts = {(r["kind"], r["key"]): r["attempt"] for r in moved.collect()}
        return _rewritten(docs, text_column, count_column, key, attempts, None)
    # Too many to hand out: each row gets those of its own entities.
    rows = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    numbered = store(docs.select(rows).withColumn("at", F.monotonically_increasing_id()), "rows")
    text = F.col("row")[text_column].cast("string").alias("text")
    own = numbered.select(text, "at").mapInArrow(_finder(True), "kind string, key string, at bigint").distinct()
    own = own.join(moved, ["kind", "key"]).groupBy("at").agg(
        F.to_json(F.collect_list(F.struct("kind", "key", "attempt"))).alias("_moved")
    )
    joined = numbered.join(own, "at", "left").select("row.*", "_moved")
    return _rewritten(joined, text_column, count_column, key, {}, "_moved")


def surrogates(docs: DataFrame, key: bytes, text_column: str = "text") -> DataFrame:
    """``(kind, key, attempt, surrogate)`` of all distinct entities, free of collisions."""
    texts = docs.select(F.col(f"`{text_column}`").cast("string").alias("text"))
    found = texts.mapInArrow(_finder(False), "kind string, key string").distinct()
    current = store(_drawn(found.withColumn("attempt", F.lit(0)), key), "surrogates")
    for _ in range(_ROUNDS):
        # Of entities that meet in one surrogate the first keeps it.
        first = current.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "key")).alias("first"))
        entities_ = current.select("kind", F.col("key").alias("surrogate"), F.lit(True).alias("real"))
        judged = current.join(first, ["kind", "surrogate"]).join(entities_, ["kind", "surrogate"], "left")
        bad = F.col("real").isNotNull() | (F.col("first.key") != F.col("key"))
        judged = store(judged.select("kind", "key", "attempt", "surrogate", bad.alias("bad")), "judged")
        if judged.where("bad").isEmpty():
            return judged.drop("bad")
        again = judged.where("bad").select("kind", "key", (F.col("attempt") + 1).alias("attempt"))
        current = store(judged.where("NOT bad").drop("bad").union(_drawn(again, key)), "surrogates")
    raise ValueError("the entities of a format leave no room for surrogates")


def _moved(texts: DataFrame, key: bytes) -> DataFrame:
    return surrogates(texts, key).where("attempt > 0").select("kind", "key", "attempt")


def _finder(numbered: bool):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = set()
            for i, text in enumerate(batch.column(0)):
                at = (batch.column(1)[i].as_py(),) if numbered else ()
                rows.update((kind, key, *at) for _, _, kind, key in entities(text.as_py() or ""))
            columns = list(zip(*rows)) or [()] * (3 if numbered else 2)
            kinds = [pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["kind", "key", "at"][: len(columns)]
            )

    return find


def _drawn(found: DataFrame, key: bytes) -> DataFrame:
    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keyed = Keyed(key)
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(3)))
            yield batch.append_column("surrogate", pa.array([surrogate(keyed, *row) for row in rows], pa.string()))

    return found.select("kind", "key", "attempt").mapInArrow(
        draw, "kind string, key string, attempt int, surrogate string"
    )


def _rewritten(
    docs: DataFrame, text_column: str, count_column: str | None, key: bytes, attempts: dict, moved: str | None
) -> DataFrame:
    fields = [f for f in docs.schema if f.name != moved]
    if count_column:
        fields.append(T.StructField(count_column, T.LongType()))

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        keyed = Keyed(key)
        for batch in batches:
            own = attempts
            # Mentions of one entity share its surrogate.
            drawn: dict[tuple[str, str, int], str] = {}
            at = batch.schema.names.index(text_column)
            texts, counts = [], []
            for i, text in enumerate(batch.column(at)):
                text = text.as_py()
                if moved and (held := batch.column(moved)[i].as_py()):
                    own = {(m["kind"], m["key"]): m["attempt"] for m in json.loads(held)}
                spans = entities(text) if text else []
                for start, end, kind, name in reversed(spans):
                    which = (kind, name, own.get((kind, name), 0))
                    if which not in drawn:
                        drawn[which] = surrogate(keyed, *which)
                    new = drawn[which]
                    text = text[:start] + rendered(kind, text[start:end], new) + text[end:]
                texts.append(text)
                counts.append(len(spans))
            field = batch.schema.field(at)
            batch = batch.set_column(at, field, pa.array(texts, field.type))
            if moved:
                batch = batch.drop_columns([moved])
            if count_column:
                batch = batch.append_column(count_column, pa.array(counts, pa.int64()))
            yield batch

    return docs.mapInArrow(rewrite, T.StructType(fields))
