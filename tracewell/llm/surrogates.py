"""Surrogates for personal data.

Detected entities get keyed replacements of their own type and format: a card number stays a card number of the same
length, issuer digit and checksum state, an address stays in its range, a secret keeps its alphabet, case and length.
Names are replaced part by part: a given name by one of the same gender and script, a family name by one of the same
script, so that "Dr. Jane Doe", "Mrs. Doe" and "Jane Doe" stay one person, in one document and across documents. The
replacement depends on the key, the type and the normalised entity only (a given name's also on the gender that most of
its titles in the table give it). Numbers, addresses and secrets are permuted within their format (a Feistel network with
cycle walking), which keeps different entities different; names are drawn.

Names are found behind titles, behind phrases that give a name, and as a known first name before a capital; a name that
was found once in a text is found there without its title as well.

All different entities of the table are gathered (grouped, distributed) and checked: no replacement may be one of the
table's real entities, and no two entities may share one. Those that fail try again with the next attempt number, up to
ATTEMPTS of them; then the format has no room left, and a keyed mark in brackets, "[address 0f3c...]", takes the
entity's place. Only exceptions are handed to the replacing pass, by broadcast up to BROADCAST_ROWS of them, else by a
join on the id. What is written on the way holds keyed digests and entities enciphered with the key, none in clear.

Defined results: a null text stays null, an empty one empty; a very long text is searched as a whole, in time by its
length; rows with the same id are treated alike; an empty table gives an empty table; other columns stay, and any named
n_entities or kinds gives way.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.shipping import map_arrow

from .common import written

BROADCAST_ROWS = 20_000
#: Replacements that an entity tries before a mark takes its place.
ATTEMPTS = 12
#: Words of a name at most.
NAME_WORDS = 3

# Titles by gender, phrases that give a name, first names by script and gender, and name syllables.
TITLES = {"m": ("Mr", "Mister", "Monsieur", "Herr", "Señor", "Sr", "господин", "κύριος"), "f": ("Mrs", "Ms", "Miss", "Mme", "Madame", "Mlle", "Frau", "Señora", "Sra", "госпожа", "κυρία"), "n": ("Dr", "Prof")}
FIRST = {
    ("latin", "m"): ("Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Gavin", "Hugo", "Ivan", "Jonas", "Karl", "Leon", "Marco", "Noel", "Oscar", "Paul"),
    ("latin", "f"): ("Anna", "Bella", "Clara", "Diana", "Emma", "Flora", "Greta", "Helen", "Irene", "Julia", "Karin", "Laura", "Marta", "Nora", "Olga", "Petra"),
    ("latin", "n"): ("Alex", "Billie", "Charlie", "Dana", "Eden", "Francis", "Jamie", "Kim", "Lee", "Morgan", "Noa", "Robin", "Sam", "Terry"),
    ("cyrillic", "m"): ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл"),
    ("cyrillic", "f"): ("Анна", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Ирина", "Кира"),
    ("cyrillic", "n"): ("Саша", "Женя", "Валя", "Слава"),
    ("greek", "m"): ("Αλέξης", "Γιώργος", "Νίκος", "Πέτρος"),
    ("greek", "f"): ("Άννα", "Ελένη", "Μαρία", "Σοφία"),
    ("greek", "n"): ("Άρτεμις", "Χρύσα"),
}
INTRODUCTIONS = ("my name is", "je m'appelle", "mein Name ist", "ich heiße", "me llamo", "mi nombre es", "меня зовут", "με λένε")
SYLLABLES = {
    "latin": ("bar", "del", "fen", "gor", "hal", "kin", "lor", "mar", "nel", "por", "ras", "sel", "tor", "ven", "wil", "zan"), 
    "cyrillic": ("бар", "вел", "гор", "дан", "кор", "лин", "мар", "тов"), 
    "greek": ("βαρ", "γελ", "δαν", "κορ", "λιν", "μαρ", "νελ", "τορ"),
    "cjk": ("安", "北", "川", "东", "方", "高", "和", "金", "林", "明", "南", "平", "青", "山", "石", "田", "文", "西", "小", "原"),
    "hiragana": ("あ", "い", "か", "き", "さ", "た", "な", "の", "ま", "み", "や", "ら"),
    "katakana": ("ア", "イ", "カ", "キ", "サ", "タ", "ナ", "ノ", "マ", "ミ", "ヤ", "ラ"),
    "hangul": ("가", "나", "다", "라", "마", "민", "서", "수", "아", "영", "지", "하"),
}
RESERVED = ("example.com", "example.net", "example.org")

GENDER = {t.casefold(): g for g, ts in TITLES.items() for t in ts}
EMAIL = re.compile(r"[A-Za-z0-9_%+-][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}")
SECRET = re.compile(r"(?<![0-9A-Za-z])(?:(?=[0-9a-f]*\d)(?=\d*[a-f])[0-9a-f]{24,128}|(?=[0-9A-F]*\d)(?=\d*[A-F])[0-9A-F]{24,128}|(?:sk|pk|ghp|xoxb|AKIA)[-_]?[0-9A-Za-z]{16,64})(?![0-9A-Za-z])")
IBAN = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])")
PHONE = re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){3,5}(?!\d)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])")
ADDRESS = re.compile(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d)")
SOCIAL = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")
CARD = re.compile(r"(?<![0-9A-Za-z])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{5})(?![0-9A-Za-z])")
PART = r"[^\W\d_](?:[\w'’]|-(?=\w))*"
TITLED = re.compile(r"(?<!\w)(?P<title>" + "|".join(sorted((re.escape(t) for ts in TITLES.values() for t in ts), key=len, reverse=True)) + rf")\.? (?P<name>{PART}(?: {PART}){{0,{NAME_WORDS - 1}}})")
SAID = re.compile(r"(?<!\w)(?i:" + "|".join(map(re.escape, INTRODUCTIONS)) + rf") (?P<name>{PART}(?: {PART}){{0,{NAME_WORDS - 1}}})")
GIVEN = {n.casefold(): g for (_, g), names in FIRST.items() for n in names}
KNOWN = re.compile(r"(?<!\w)(?P<name>(?:" + "|".join(sorted((n for names in FIRST.values() for n in names), key=len, reverse=True)) + rf") {PART})")
DIGIT = re.compile(r"\d")


def luhn(digits: str) -> int:
    """The check digit that the digits ask for."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + (k % 2 == 0))
        total += x - 9 * (x > 9)
    return -total % 10


def _iban_ok(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def proper(word: str) -> bool:
    """Whether a word may be part of a name: a capital or a letter of a script without capitals at its front."""
    return word[0].upper() == word[0]


def script(text: str) -> str:
    """The script of the first letter, by its name in the character table."""
    for c in text:
        if c.isalpha():
            return unicodedata.name(c, "UNKNOWN").split(" ")[0].lower().removesuffix("-unified")
    return "latin"


def named(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, part with its gender in front) of the parts of names: given:f:jane, family:n:doe."""
    spans: dict[tuple[int, int], str] = {}
    for pattern in (TITLED, SAID, KNOWN):
        at = 0
        while m := pattern.search(text, at):
            start, words = m.start("name"), m["name"].split(" ")
            some, at = 0, m.start("name")
            while some < len(words) and proper(words[some]) and (some == 0 or words[0][0].lower() != words[0][0]):
                some += 1
            if not some or (pattern is KNOWN and some < 2):
                at += pattern is KNOWN  # which begins with its name
                continue
            at = start + len(" ".join(words[:some]))
            title = m.groupdict().get("title")
            gender = GENDER.get((title or "").casefold(), "n")
            if gender == "n" and some > 1:
                gender = GIVEN.get(words[0].casefold(), "n")
            spans.setdefault((start, start + len(" ".join(words[:some]))), gender)
    if not spans:
        return []
    out: dict[tuple[int, int], tuple[str, str]] = {}

    def parts(start: int, end: int, gender: str) -> None:
        at = start
        words = text[start:end].split(" ")
        for k, word in enumerate(words):
            kind = "family" if k == len(words) - 1 else "given"
            out.setdefault((at, at + len(word)), (kind, f"{gender if kind == 'given' else 'n'}:{unicodedata.normalize('NFC', word).casefold()}"))
            at += len(word) + 1

    for (start, end), gender in sorted(spans.items()):
        parts(start, end, gender)
    # The same names elsewhere in the text: whole ones, given and family name, and family names alone.
    known = {text[a:b]: g for (a, b), g in spans.items()}
    again = set(known)
    for name in known:
        words = name.split(" ")
        again |= {" ".join([words[0], words[-1]]), words[-1]}
    mentions = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, sorted((n for n in again if len(n) > 1), key=len, reverse=True))) + r")(?!\w)")
    if any(len(n) > 1 for n in again):
        for m in mentions.finditer(text):
            if not any((a, b) in out for a, b in [(m.start(), m.start() + len(m[0].split(" ")[0])), (m.end() - len(m[0].split(" ")[-1]), m.end())]):
                parts(m.start(), m.end(), known.get(m[0], "n"))
    return [(a, b, kind, part) for (a, b), (kind, part) in out.items()]


def found(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, normalised entity), in order and without overlaps; earlier kinds win. The entity of a given or
    family name has the gender that its mention gives in front, and a colon."""
    out: list[tuple[int, int, str, str]] = []
    taken = bytearray()

    def add(a: int, b: int, kind: str, entity: str) -> None:
        if not taken:
            taken.extend(bytes(len(text)))
        if entity and not any(taken[a:b]):
            taken[a:b] = b"\1" * (b - a)
            out.append((a, b, kind, entity))

    def take(kind: str, pattern: re.Pattern, normal) -> None:
        for m in pattern.finditer(text):
            add(*m.span(), kind, normal(m))

    numbers = lambda m: re.sub(r"\D", "", m[0])
    if "@" in text:
        take("email", EMAIL, lambda m: m[0].lower())
    if DIGIT.search(text):
        take("secret", SECRET, lambda m: m[0])
        take("iban", IBAN, lambda m: m[0].replace(" ", "") if _iban_ok(m[0].replace(" ", "")) else "")
        take("phone", PHONE, numbers)
        take("address", ADDRESS, lambda m: m[0] if all(int(x) < 256 for x in m[0].split(".")) else "")
        take("social", SOCIAL, numbers)
        take("card", CARD, numbers)
    for mention in named(text):
        add(*mention)
    return sorted(out)


class Surrogates:
    """The keyed replacements; attempt numbers give others."""

    def __init__(self, key: str):
        if not key:
            raise ValueError("surrogates need a key")
        self.key = key.encode()
        self.mark = lru_cache(100_000)(self._mark)
        self.of = lru_cache(100_000)(self._of)

    def _number(self, what: str, size: int) -> int:
        return int.from_bytes(hmac.new(self.key, what.encode("utf-8", "surrogatepass"), hashlib.sha512).digest(), "big") % size

    def permuted(self, value: int, size: int, what: str) -> int:
        """A keyed permutation of the numbers below size: a Feistel network over the next even number of bits, walked
        until it comes back below size."""
        half = max(1, ((size - 1).bit_length() + 1) // 2)
        if size < 2:
            return value
        while True:
            left, right = value >> half, value & ((1 << half) - 1)
            for k in range(8):
                left, right = right, left ^ self._number(f"{what}|{k}|{right}", 1 << half)
            value = left << half | right
            if value < size:
                return value

    def characters(self, text: str, what: str, hexadecimal: bool = False) -> str:
        """Digits, small and capital letters each permuted within their kind, all places together."""
        kinds = ["0123456789abcdef", "0123456789ABCDEF"] if hexadecimal else ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
        if hexadecimal:
            kinds = [kinds[text.upper() == text]]
        sets = [next((k for k in kinds if c in k), c) for c in text]
        value, size = 0, 1
        for c, k in zip(text, sets, strict=True):
            value, size = value * len(k) + k.index(c), size * len(k)
        value = self.permuted(value, size, f"{what}|{''.join(k[0] for k in sets)}")
        out = []
        for k in reversed(sets):
            value, at = divmod(value, len(k))
            out.append(k[at])
        return "".join(reversed(out))

    def _mark(self, kind: str, entity: str) -> str:
        """A keyed digest of an entity."""
        return hmac.new(self.key, f"mark|{kind}|{entity}".encode("utf-8", "surrogatepass"), hashlib.sha256).hexdigest()

    def enciphered(self, kind: str, entity: str) -> bytes:
        return self._mixed(self.mark(kind, entity), entity.encode("utf-8", "surrogatepass"))

    def deciphered(self, mark: str, data: bytes) -> str:
        return self._mixed(mark, data).decode("utf-8", "surrogatepass")

    def _mixed(self, mark: str, data: bytes) -> bytes:
        stream = b"".join(hmac.new(self.key, f"cipher|{mark}|{k}".encode(), hashlib.sha512).digest() for k in range(-(-len(data) // 64)))
        return bytes(x ^ y for x, y in zip(data, stream, strict=False))

    def _of(self, kind: str, entity: str, attempt: int = 0, gender: str = "n") -> str:
        """The replacement of a normalised entity (of names: of the part), itself normalised."""
        what = f"{kind}|{attempt}"
        if attempt >= ATTEMPTS:
            return f"[{kind} {self.mark(kind, entity)[:32]}]"
        if kind == "email":
            local, domain = entity.rsplit("@", 1)
            own, _, top = domain.rpartition(".")
            local += "x" * max(0, attempt - ATTEMPTS // 2)  # mailbox names may grow
            if domain.endswith(RESERVED):
                return f"{self.characters(local, what + domain)}@{domain}"
            return self.characters(f"{local}@{own}", what) + "." + top
        if kind == "address":
            a, b, c, d = map(int, entity.split("."))
            value = a << 24 | b << 16 | c << 8 | d
            for bits, net in ((24, 10), (16, 0xC0A8), (20, 0xAC1), (24, 127)):  # private and loopback ranges stay
                if value >> bits == net:
                    value = net << bits | self.permuted(value & ((1 << bits) - 1), 1 << bits, f"{what}|{net}")
                    break
            else:
                value = self.permuted(value, 1 << 32, what)
                while value >> 24 in (10, 127) or value >> 16 == 0xC0A8 or value >> 20 == 0xAC1:
                    value = self.permuted(value, 1 << 32, what)
            return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))
        if kind == "card":
            body = entity[0] + self.characters(entity[1:-1], f"{what}|{entity[0]}")
            return body + str((luhn(body) + int(entity[-1]) - luhn(entity[:-1])) % 10)
        if kind == "iban":
            body = self.characters(entity[4:], what + entity[:2])
            check = 98 - int("".join(str(int(c, 36)) for c in body + entity[:2] + "00")) % 97
            return f"{entity[:2]}{check:02d}{body}"
        if kind == "phone":
            keep = max(0, len(entity) - 10)
            return entity[:keep] + self.characters(entity[keep:], f"{what}|{entity[:keep]}")
        if kind == "social":
            return self.characters(entity, what)
        if kind == "secret":
            if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", entity):
                return self.characters(entity, what, hexadecimal=True)
            keep = re.match(r"(?:sk|pk|ghp|xoxb|AKIA)[-_]?", entity)[0]
            return keep + self.characters(entity[len(keep) :], what)
        style = script(entity)
        if kind == "given" and (style, gender) in FIRST and attempt < 2:
            first = FIRST[style, gender]
            return first[self._number(f"{what}|{entity}", len(first))].casefold()
        sounds = SYLLABLES.get(style) or self._letters(entity)
        count = (2 if kind == "given" else 3) + attempt // 2 if len(sounds[0]) > 1 else max(2, min(len(entity), 4)) + attempt // 2
        return "".join(sounds[self._number(f"{what}|{gender}|{entity}|{k}", len(sounds))] for k in range(count))

    @staticmethod
    def _letters(entity: str) -> list[str]:
        """The letters around those of a name, for scripts without syllables here."""
        base = ord(next(c for c in entity if c.isalpha())) & ~0x7F
        return [chr(c) for c in range(base, base + 0x80) if unicodedata.category(chr(c)) in ("Ll", "Lo") and script(chr(c)) == script(entity)]

    def shown(self, kind: str, surface: str, entity: str, attempt: int = 0, gender: str = "n") -> str:
        """The replacement in the form in which the entity stood."""
        new = self.of(kind, entity, attempt, gender)
        if attempt >= ATTEMPTS:
            return new
        if kind in ("phone", "card", "social", "iban"):
            signs = iter(new)
            return "".join(next(signs) if c.isalnum() else c for c in surface)
        if kind == "email":
            return new.upper() if surface.isupper() else new
        if kind in ("given", "family"):
            return new.upper() if surface.isupper() and len(surface) > 1 else new.title()
        return new


def split(kind: str, entity: str) -> tuple[str, str]:
    """(entity, gender of the mention)."""
    return (entity[2:], entity[0]) if kind in ("given", "family") else (entity, "n")


def replaced(text: str, surrogates: Surrogates, others: dict[tuple[str, str], tuple[int, str]] | None = None) -> tuple[str, list[str]]:
    """The text with every entity replaced, and the entities' kinds. others has attempt and gender of those that are not
    at their first attempt and of no gender, by kind and keyed digest; without it, mentions give the gender."""
    entities = found(text)
    out, at = [], 0
    for a, b, kind, mention in entities:
        entity, gender = split(kind, mention)
        attempt, gender = (0, gender) if others is None else others.get((kind, surrogates.mark(kind, entity)), (0, "n"))
        out += [text[at:a], surrogates.shown(kind, text[a:b], entity, attempt, gender)]
        at = b
    return "".join([*out, text[at:]]) if entities else text, [e[2] for e in entities]


#: kind, keyed digest, enciphered entity, keyed digest of the replacement, attempt, gender.
ENTITY = "kind string, mark string, entity binary, other string, attempt int, gender string"
ENTITY_ARROW = pa.schema([("kind", pa.string()), ("mark", pa.string()), ("entity", pa.binary()), ("other", pa.string()), ("attempt", pa.int32()), ("gender", pa.string())])


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def _trying(table: DataFrame, key: str, more: int) -> DataFrame:
    """The entities (kind, mark, entity, attempt, gender) with their replacements, `more` attempts on."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surrogates = Surrogates(key)
        for batch in batches:
            rows = []
            for kind, mark, data, n, gender in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                other = surrogates.of(kind, surrogates.deciphered(mark, data), n + more, gender)
                rows.append((kind, mark, data, surrogates.mark(kind, other), n + more, gender))
            yield _rows(rows, ENTITY_ARROW)

    return map_arrow(table.select("kind", "mark", "entity", "attempt", "gender"), step, ENTITY)


def entities(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """All different entities, each with its first replacement; a given name has the gender that most mentions give."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surrogates = Surrogates(key)
        for batch in batches:
            seen: dict[tuple[str, str], list[int]] = {}
            for t in batch.column(0).to_pylist():
                for _, _, kind, mention in found(t) if t else ():
                    entity, gender = split(kind, mention)
                    votes = seen.setdefault((kind, entity), [0, 0])
                    votes[0] += gender == "m"
                    votes[1] += gender == "f"
            yield _rows([(kind, surrogates.mark(kind, entity), surrogates.enciphered(kind, entity), m, f) for (kind, entity), (m, f) in seen.items()], schema)

    schema = pa.schema([("kind", pa.string()), ("mark", pa.string()), ("entity", pa.binary()), ("m", pa.int64()), ("f", pa.int64())])
    every = map_arrow(docs.select(text), step, "kind string, mark string, entity binary, m long, f long")
    one = every.groupBy("kind", "mark").agg(F.first("entity").alias("entity"), F.sum("m").alias("m"), F.sum("f").alias("f"))
    gender = F.when(F.col("m") > F.col("f"), "m").when(F.col("f") > F.col("m"), "f").otherwise("n")
    return _trying(one.select("kind", "mark", "entity", F.lit(0).alias("attempt"), gender.alias("gender")), key, 0)


def exceptions(table: DataFrame, key: str) -> DataFrame:
    """(kind, mark, attempt, gender) of the entities (written before) whose first replacement meets a real entity or
    another's, or that have a gender. Each round looks at the whole table; it ends when nothing meets, after ATTEMPTS
    rounds at the latest, as the marks that come then are all different and no entities."""
    real = table.select("kind", F.col("mark").alias("other"))
    now = table
    for _ in range(ATTEMPTS):
        # Of those that share a replacement the one with the fewest attempts keeps it, so that what fails in a round has
        # failed in every one; a replacement that is real fails for all.
        keeps = now.groupBy("kind", "other").agg(F.min(F.struct("attempt", "mark")).alias("keeper"), F.count(F.lit(1)).alias("n"))
        shared = now.join(keeps.filter("n > 1"), ["kind", "other"]).filter("mark <> keeper.mark").select("kind", "mark")
        met = now.join(real, ["kind", "other"], "left_semi").select("kind", "mark")
        bad = written(shared.union(met).distinct(), "entities")
        if bad.isEmpty():
            break
        fixed = _trying(now.join(bad, ["kind", "mark"], "left_semi"), key, 1)
        now = written(now.join(bad, ["kind", "mark"], "left_anti").select(*fixed.columns).union(fixed), "entities")
    return now.filter("attempt > 0 or gender <> 'n'").select("kind", "mark", "attempt", "gender")


def pseudonymised(docs: DataFrame, key: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the text's entities replaced, n_entities and kinds (how many of each kind)."""
    docs = docs.select(*[c for c in docs.columns if c.lower() not in ("n_entities", "kinds")])
    others = written(exceptions(written(entities(docs, key, text), "entities"), key), "exceptions")
    n = others.count()
    few = {(r["kind"], r["mark"]): (r["attempt"], r["gender"]) for r in others.collect()} if n <= BROADCAST_ROWS else None
    names = docs.columns
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    at = names.index(text)
    kind = "array<struct<kind:string,mark:string,attempt:int,gender:string>>"
    if few is None:
        # Too many to broadcast: each id gets those of its own texts.
        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            surrogates = Surrogates(key)
            schema = pa.schema([("id", pa.string()), ("kind", pa.string()), ("mark", pa.string())])
            for batch in batches:
                seen = dict.fromkeys((doc, kind, surrogates.mark(kind, split(kind, mention)[0])) for doc, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) if t for _, _, kind, mention in found(t))
                yield _rows(list(seen), schema)

        mark = F.coalesce(F.col(f"c{names.index(id_col)}").cast("string"), F.lit(""))
        theirs = map_arrow(rows.select(mark.alias("id"), f"c{at}"), own, "id string, kind string, mark string").join(others, ["kind", "mark"])
        theirs = theirs.groupBy("id").agg(F.collect_set(F.struct("kind", "mark", "attempt", "gender")).alias("others"))
        rows = rows.withColumn("own", mark).join(theirs, F.col("own") == F.col("id"), "left").drop("own", "id")
    else:
        rows = rows.withColumn("others", F.lit(None).cast(kind))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surrogates = Surrogates(key)
        for batch in batches:
            texts, kinds, counts = [], [], []
            for old, own in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                theirs = few if few is not None else {(x["kind"], x["mark"]): (x["attempt"], x["gender"]) for x in own or []}
                new, met = (None, []) if old is None else replaced(old, surrogates, theirs)
                texts.append(new)
                counts.append(len(met))
                kinds.append(" ".join(f"{k}={met.count(k)}" for k in sorted(set(met))))
            columns = list(batch.columns[: len(names)])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(kinds, pa.string())], names=[*(f"c{i}" for i in range(len(names))), "n_entities", "kinds"])

    schema = ", ".join([f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema)] + ["n_entities long", "kinds string"])
    done = map_arrow(rows, step, schema)
    return done.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "n_entities", "kinds")
