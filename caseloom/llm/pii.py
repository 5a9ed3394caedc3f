"""Personal data replaced by surrogates.

Found are e-mail addresses, telephone, card (with a valid check digit), bank
account and social security numbers, IP addresses of both versions, and names after a title or a
known given name. Every distinct entity of the corpus gets one surrogate, drawn
from a keyed hash: the same entity is the same surrogate wherever and however it
is written, so mentions stay linked. A surrogate has the type of its original:
number of digits, country, card network and check digits, private or public
address, script and gender of a name; each mention keeps its own punctuation and
case.

Collision checks work on the table of distinct entities: a surrogate must be no
entity of the corpus, and no two entities may have the same one. Who loses draws
again, until nothing clashes. Draws widen with their number: every ``WIDER``
attempts a number gets one more digit, a name or an address one more syllable or
letter, and an IP address first leaves its block, then its scope, then gets one
more octet. So the space of a draw grows without bound, outgrows any number of
entities after a logarithmic number of attempts, and from then on half of the
entities still open or more find a free surrogate in each.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.llm.common import free_name
from caseloom.session import materialize, remove_table

KEY = b"caseloom surrogates"
# Attempts after which the space of draws grows.
WIDER = 8

EMAIL = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
# A row of number groups; ``cards_in`` says which of them are a card.
DIGITS = re.compile(r"(?<![\w.+-])\d++(?:[ -]\d++)*+")
IP = re.compile(r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)")
SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")
IP6 = re.compile(r"(?<![\w:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:]|\.\d)")
# With a country code or brackets a number is a phone beside any other; without, not as a part of a row of number groups.
PHONE = re.compile(
    r"(?<![\w.+-])(?:"
    r"(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?(?:\d{3,4}[ .-]?\d{3,4}|\d{2}(?:[ .-]\d{2}){3})(?![\w-])"
    r"|\+\d{1,3}[ .-]?\(0\)[ .-]?\d{2,4}[ .-]\d{3,4}[ .-]\d{3,4}(?![\w-])"
    r"|\+\d{1,3}[ .-](?:\d{2,4}[ .-]\d{3,4}[ .-]\d{3,4}|\d{1,3}(?:[ .-]\d{2}){3,4}|\d{2,5}[ .-]\d{4,9}|\d{6,12})(?![\w-])"
    r"|\+\d{7,15}(?!\w)"
    r"|(?<!\d )(?:\d{2,4}[ .-]\d{3,4}[ .-]\d{3,4}|0\d(?:[ .-]\d{2}){4})(?![\w-]| \d))")
# Country codes of one and two digits; all others have three.
_SHORT_CODES = {"1", "7", *"20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 "
                "90 91 92 93 94 95 98".split()}

# Titles by the gender they tell.
TITLES = {"m": ["Mr", "Herr", "Señor", "Monsieur", "Господин"], "f": ["Mrs", "Ms", "Miss", "Frau", "Señora", "Madame", "Госпожа"],
          "n": ["Dr", "Prof"]}
GIVEN = {
    "m": ["James", "John", "Robert", "Michael", "William", "David", "Richard", "Thomas", "Charles", "Daniel", "George",
          "Peter", "Hans", "Klaus", "Stefan", "Jürgen", "Wolfgang", "Pierre", "Michel", "Antoine", "Carlos", "Miguel",
          "Javier", "Pablo", "Manuel", "Иван", "Сергей", "Дмитрий", "Алексей", "Γιώργος"],
    "f": ["Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Barbara", "Susan", "Jessica", "Sarah", "Karen", "Emily",
          "Maria", "Sabine", "Ursula", "Monika", "Ingrid", "Claire", "Camille", "Nathalie", "Carmen", "Elena", "Lucía",
          "Анна", "Ольга", "Елена", "Наталья", "Ελένη"],
}
_GENDER = {name: gender for gender, names in GIVEN.items() for name in names}
_TITLE = {title: gender for gender, titles in TITLES.items() for title in titles}
_CAP = r"[A-ZÀ-ÖØ-ÞА-ЯΆ-Ω][^\W\d_]+(?:-[A-ZÀ-ÖØ-ÞА-ЯΆ-Ω][^\W\d_]+)?"
NAME = re.compile(
    rf"\b(?P<title>{'|'.join(_TITLE)})\b\.?\ (?P<one>{_CAP})(?:\ (?P<two>{_CAP}))?"
    rf"|\b(?P<given>{'|'.join(_GENDER)})\ (?P<surname>{_CAP})")

# Parts that surrogate names are built of, by script; endings by gender.
_ONSETS = {"latin": "b d f g h k l m n p r s t v br dr gr kl st tr".split(),
           "cyrillic": "б в г д ж з к л м н п р с т ф ст бр др".split(),
           "greek": "β γ δ ζ κ λ μ ν π ρ σ τ φ στ".split()}
_VOWELS = {"latin": "a e i o u ai ei".split(), "cyrillic": "а е и о у я".split(), "greek": "α ε ι ο η".split()}
_ENDINGS = {
    ("latin", "given", "f"): ["a", "ia", "ina", "elle"], ("latin", "given", "m"): ["o", "us", "ert", "an"],
    ("latin", "given", "n"): ["y", "is", "en"], ("latin", "surname", "n"): ["er", "son", "man", "ez", "ier"],
    ("cyrillic", "given", "f"): ["а", "ия"], ("cyrillic", "given", "m"): ["ей", "ан", "ил"],
    ("cyrillic", "given", "n"): ["я"], ("cyrillic", "surname", "f"): ["ова", "ина"],
    ("cyrillic", "surname", "n"): ["ов", "ин", "енко"],
    ("greek", "given", "f"): ["α", "η"], ("greek", "given", "m"): ["ος", "ης"], ("greek", "given", "n"): ["ις"],
    ("greek", "surname", "n"): ["ου", "ακης"],
}

# start, end (code points, end exclusive), kind, and what makes mentions one entity.
Found = tuple[int, int, str, str]


def luhn_digit(digits: str) -> str:
    """Check digit that belongs after ``digits``."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        doubled = int(d) * (2 if i % 2 == 0 else 1)
        total += doubled if doubled < 10 else doubled - 9
    return str(-total % 10)


def iban_check(country: str, account: str) -> str:
    number = "".join(str(int(c, 36)) for c in account + country + "00")
    return f"{98 - int(number) % 97:02d}"


def cards_in(text: str) -> Iterator[tuple[int, int]]:
    """Places of whole number groups of 13 to 19 digits with a valid check digit, the longest first."""
    for row in DIGITS.finditer(text):
        groups = [(row.start() + m.start(), row.start() + m.end()) for m in re.finditer(r"\d+", row[0])]
        if row.end() < len(text) and (text[row.end()].isalnum() or text[row.end()] == "_"):
            groups.pop()
        first = 0
        while first < len(groups):
            start, after = groups[first][0], first + 1
            # A group after a hyphen goes on with what is before it.
            if first == 0 or text[start - 1] == " ":
                for last in range(min(len(groups), first + 19), first, -1):
                    digits = re.sub(r"\D", "", text[start:groups[last - 1][1]])
                    if 13 <= len(digits) <= 19 and luhn_digit(digits[:-1]) == digits[-1]:
                        yield start, groups[last - 1][1]
                        after = last
                        break
            first = after


def script_of(word: str) -> str:
    first = ord(word[0])
    return "cyrillic" if 0x400 <= first < 0x530 else "greek" if 0x370 <= first < 0x400 else "latin"


def _name_kind(part: str, word: str, gender: str) -> str:
    script = script_of(word)
    if part == "surname":
        gender = "f" if script == "cyrillic" and word.lower().endswith(("а", "ая")) else "n"
    return f"name {part} {script} {gender}"


def find(text: str) -> list[Found]:
    """Entities of a text by place, none overlapping another."""
    found: list[Found] = []

    def add(start: int, end: int, kind: str, entity: str) -> None:
        at = bisect_left(found, (start,))
        if (at == 0 or found[at - 1][1] <= start) and (at == len(found) or end <= found[at][0]):
            found.insert(at, (start, end, kind, entity))

    if "@" in text:
        for m in EMAIL.finditer(text):
            add(*m.span(), "email", m[0].lower())
    if re.search("[0-9]", text):
        for m in IBAN.finditer(text):
            plain = m[0].replace(" ", "")
            if plain[2:4] == iban_check(plain[:2], plain[4:]):
                add(*m.span(), "iban", plain)
        for start, end in cards_in(text):
            add(start, end, "card", re.sub(r"\D", "", text[start:end]))
        if text.count(":") > 1:
            for m in IP6.finditer(text):
                # Short ones, as in a::b, and those without digits are rather code.
                if sum(c != ":" for c in m[0]) >= 5 and re.search("[0-9]", m[0]):
                    try:
                        add(*m.span(), "ip6", str(ipaddress.IPv6Address(m[0])))
                    except ValueError:
                        pass
        for m in IP.finditer(text):
            if all(int(octet) < 256 for octet in m[0].split(".")):
                add(*m.span(), "ip", ".".join(str(int(octet)) for octet in m[0].split(".")))
        for m in SSN.finditer(text):
            add(*m.span(), "ssn", m[0].replace("-", ""))
        for m in PHONE.finditer(text):
            add(*m.span(), "phone", ("+" if m[0][0] == "+" else "") + re.sub(r"\D", "", m[0]))
    parts: dict[str, str] = {}
    for m in NAME.finditer(text):
        if m["given"]:
            names = [("given", "given"), ("surname", "surname")]
            gender = _GENDER[m["given"]]
        else:
            names = [("one", "given" if m["two"] else "surname"), ("two", "surname")]
            gender = _TITLE[m["title"]]
        for group, part in names:
            if m[group]:
                own = _GENDER.get(m[group], gender) if part == "given" else gender
                kind = parts.setdefault(m[group], _name_kind(part, m[group], own))
                add(*m.span(group), kind, m[group].lower())
    if parts:
        # Mentions by one part of a name found before, also in capitals.
        parts |= {name.upper(): kind for name, kind in parts.items()}
        for m in re.finditer(rf"(?<!\w)(?:{'|'.join(map(re.escape, sorted(parts, key=len, reverse=True)))})(?!\w)", text):
            add(*m.span(), parts[m[0]], m[0].lower())
    return found


def surrogate(kind: str, entity: str, attempt: int, key: bytes = KEY) -> str:
    """The entity's draw number ``attempt``, in the form ``find`` gives entities."""
    seed = hashlib.blake2b(f"{kind}\0{entity}\0{attempt}".encode(), key=key[:64], digest_size=64).digest()
    stream = int.from_bytes(seed, "big")

    def draw(n: int) -> int:
        nonlocal stream
        stream, value = divmod(stream, n)
        return value

    # Signs beyond those of the original.
    more = attempt // WIDER

    def alike(text: str) -> str:
        return "".join(str(draw(10)) if c.isdigit() else chr(97 + draw(26)) if c.isascii() and c.isalpha() else c for c in text)

    if kind == "email":
        # The domain is drawn from the domain alone, so addresses of one stay together.
        local, domain = entity.rsplit("@", 1)
        host, dot, top = domain.rpartition(".")
        if attempt < 0:
            return alike(host) + dot + top
        return alike(local + "x" * more) + "@" + surrogate("email", "@" + domain, -1, key) if local else alike(host) + dot + top
    if kind == "phone":
        plus, digits = ("+" if entity[0] == "+" else ""), entity.lstrip("+")
        # The code by its length and by the table of codes, whichever is longer, so that it stays.
        code = next((n for n in (1, 2) if digits[:n] in _SHORT_CODES), 3)
        country = max(len(digits) - 10, code) if plus else 0
        return plus + digits[:country] + str(2 + draw(8)) + alike(digits[country + 1:] + "0" * more)
    if kind == "card":
        body = entity[0] + alike(entity[1:-1] + "0" * more)
        return body + luhn_digit(body)
    if kind == "ssn":
        return f"{1 + draw(665):03d}{1 + draw(99):02d}{1 + draw(9999):04d}" + alike("0" * more)
    if kind == "iban":
        account = "".join(str(draw(10)) if c.isdigit() else chr(65 + draw(26)) for c in entity[4:] + "0" * more)
        return entity[:2] + iban_check(entity[:2], account) + account
    if kind == "ip":
        octets = entity.split(".")
        kept = 1 if octets[0] in ("10", "127") else 2 if octets[:2] == ["192", "168"] or (
            octets[0] == "172" and 16 <= int(octets[1]) < 32) else 0
        if more >= 3:
            return ".".join(str(draw(256)) for _ in range(more + 2))
        if more == 2:
            return ".".join(str(draw(256)) for _ in range(4))
        if more == 1 and kept:
            # The widest private block.
            octets, kept = ["10"], 1
        while True:
            drawn = ".".join(octets[:kept] + [str(1 + draw(223) if i == 0 else draw(256)) for i in range(kept, 4)])
            if ipaddress.ip_address(drawn).is_private == ipaddress.ip_address(entity).is_private:
                return drawn
            stream = int.from_bytes(hashlib.blake2b(drawn.encode(), key=key[:64]).digest(), "big")
    if kind == "ip6":
        # The first group tells the scope; groups of zeros stay until many addresses have clashed.
        groups = ipaddress.IPv6Address(entity).exploded.split(":")
        kept = [g if i == 0 or (int(g, 16) == 0 and attempt < 8) else f"{1 + draw(65535):x}" for i, g in enumerate(groups)]
        return str(ipaddress.IPv6Address(":".join(kept)))
    _, part, script, gender = kind.split()
    syllables = 2 + attempt // 4 if part == "surname" else 1 + attempt // 4
    body = "".join(_ONSETS[script][draw(len(_ONSETS[script]))] + _VOWELS[script][draw(len(_VOWELS[script]))]
                   for _ in range(syllables))
    endings = _ENDINGS[script, part, gender] if (script, part, gender) in _ENDINGS else _ENDINGS[script, part, "n"]
    return body + _ONSETS[script][draw(len(_ONSETS[script]))] + endings[draw(len(endings))]


def rendered(drawn: str, mention: str, kind: str) -> str:
    """The surrogate the way the mention is written."""
    if kind in ("phone", "card", "ssn", "iban"):
        signs = iter(drawn.lstrip("+"))
        # A widened draw has more signs than the mention.
        return "".join(next(signs) if c.isalnum() else c for c in mention) + "".join(signs)
    if mention.isupper() and len(mention) > 1 and any(c.isalpha() for c in mention):
        return drawn.upper()
    return drawn.title() if mention[0].isupper() and kind not in ("email", "ip6") else drawn


def replaced(text: str, entities: list[dict]) -> str:
    """``text`` with each entity (start, end, kind, drawn) replaced."""
    out, at = [], 0
    for e in sorted(entities, key=lambda e: e["start"]):
        out += [text[at:e["start"]], rendered(e["drawn"], text[e["start"]:e["end"]], e["kind"])]
        at = e["end"]
    return "".join(out) + text[at:]


_FOUND = "array<struct<start: int, end: int, kind: string, entity: string>>"


def entities_in(text: Column) -> Column:
    """Entities of a text column; an empty list for null."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("entity", pa.string())]))

    @F.arrow_udf(_FOUND)
    def found(texts: pa.Array) -> pa.Array:
        names = ("start", "end", "kind", "entity")
        return pa.array([[dict(zip(names, e)) for e in find(t.as_py() or "")] for t in texts], kind)

    return found(text)


def assign(entities: DataFrame, key: bytes = KEY) -> DataFrame:
    """``kind``, ``entity`` and ``drawn`` for distinct entities: no two alike, none an entity itself.

    A round draws for all that have none yet. A draw is kept if no entity of its
    type and no kept draw is the same, by the smallest entity if several drew it.
    """
    def draw(attempt: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kinds, names = batch.column("kind"), batch.column("entity")
                drawn = [surrogate(k, e, attempt, key) for k, e in zip(kinds.to_pylist(), names.to_pylist())]
                yield pa.RecordBatch.from_arrays([kinds, names, pa.array(drawn, pa.string())], ["kind", "entity", "drawn"])
        return run

    schema = "kind string, entity string, drawn string"
    # Names of any kind must not meet; other types never look alike.
    family = F.substring_index("kind", " ", 1)
    taken = entities.select(family.alias("family"), F.col("entity").alias("drawn")).distinct()
    first = Window.partitionBy("family", "drawn").orderBy("entity", "kind")
    open_, kept, attempt = entities, None, 0
    while True:
        drawn = open_.mapInArrow(draw(attempt), schema).withColumn("family", family)
        drawn = materialize(drawn, "draws")
        free = drawn.join(taken, ["family", "drawn"], "left_anti")
        if kept is not None:
            free = free.join(kept.select("family", "drawn"), ["family", "drawn"], "left_anti")
        won = free.withColumn("place", F.row_number().over(first)).where("place = 1").drop("place")
        won = materialize(won if kept is None else won.select(*kept.columns).unionByName(kept), "surrogates")
        left = materialize(drawn.join(won, ["kind", "entity"], "left_anti").select("kind", "entity"), "open")
        for table in (drawn, kept, open_ if attempt else None):
            if table is not None:
                remove_table(table)
        kept, open_, attempt = won, left, attempt + 1
        if open_.isEmpty():
            return kept.select("kind", "entity", "drawn")


def with_surrogates(docs: DataFrame, key: bytes = KEY, found_as: str | None = None,
                    length: str | None = None) -> DataFrame:
    """``docs`` with surrogates in ``text``; all rows and other columns stay as they are.

    Texts without entities are not touched, null stays null. Repeated rows get
    the same text. ``found_as`` names an added column with the entities (start,
    end, kind, entity; places in the original). An empty table stays empty.
    """
    row, found, own = free_name(docs, "_row"), found_as or free_name(docs, "_found"), free_name(docs, "_own_row")
    drawn_as = free_name(docs, "_drawn")
    # Detection runs once; rows are numbered in the written table, so that a text can be met again.
    marked = materialize(docs.withColumn(found, entities_in(F.col("text").cast("string")))
                         .withColumn(row, F.monotonically_increasing_id()), "marked")
    mentions = marked.where(F.size(found) > 0).select(F.col(row).alias("row"), F.explode(found).alias("e")).select("row", "e.*")
    drawn = assign(materialize(mentions.select("kind", "entity").distinct(), "entities"), key)
    # A mention of a hot entity is one small row; the join lets Spark split them.
    lists = (mentions.join(drawn, ["kind", "entity"])
             .groupBy("row").agg(F.collect_list(F.struct("start", "end", "kind", "drawn")).alias("drawn"))
             .select(F.col("row").alias(own), F.col("drawn").alias(drawn_as)))

    @F.arrow_udf("string")
    def put(texts: pa.Array, entities: pa.Array) -> pa.Array:
        return pa.array([replaced(t, e) for t, e in zip(texts.to_pylist(), entities.to_pylist())], pa.string())

    columns = [*docs.columns, *([found] if found_as else [])]
    changed = marked.where(F.size(found) > 0).join(lists, F.col(row) == F.col(own))
    changed = changed.select(*[put(F.col("text"), F.col(drawn_as)).alias("text") if c == "text" else F.col(f"`{c}`") for c in columns])
    if length is not None and length in columns:
        changed = changed.withColumn(length, F.length("text").cast(docs.schema[length].dataType))
    return marked.where(F.size(found) == 0).select(*[F.col(f"`{c}`") for c in columns]).unionByName(changed)
