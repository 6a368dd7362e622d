"""Personal data: every detected entity gets a keyed surrogate of its own type.

A surrogate comes from a keyed permutation of the set of all values of the same type and format, so equal entities get
equal surrogates in the whole corpus (coreference) and different ones get different surrogates (distinctness) without
any exchange between tasks. Variable characters are symbols of an alphabet (digits, small or capital letters of their
script, hexadecimal digits, octets); a Feistel network adds to one half, symbol by symbol, a keyed digest of the other.
A keyed step between the network and its inverse makes the permutation one cycle, so that no value keeps itself.
Collision checks: a result that falls into another format's or pool's values is permuted again until it does not
(cycle walking keeps the permutation), so formats cannot run into each other.

Formats kept: separators, letter case, country codes, first card digit and whether the check digit is right, octet
ranges, top-level domains. First names known by gender are permuted within the names of their gender and script; other
name parts keep script, vowels and consonants, and their last letter, and never become a listed name. Parts of
names are replaced each on their own, so a full name and a surname alone still agree. Names are found by context as well
as by the list: after a cue ("my name is", "regards"), beside or inside an e-mail address, and again wherever the same full
name stands in the text.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, to_table

ROUNDS = 8
# Frequent first names by script and gender, and titles by gender.
NAMES = {
    ("latin", "f"): "Mary Patricia Jennifer Elizabeth Barbara Margaret Dorothy Kimberly Michelle Katharina Brigitte Ursula Monika Sabine Françoise Nathalie Isabelle Sylvie Carmen Josefa Dolores Pilar".split(),
    ("latin", "m"): "James Robert Michael William David Richard Joseph Thomas Charles Christopher Wolfgang Jürgen Klaus Günter Philippe Jacques François Thierry Francisco Manuel Javier Miguel".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Людмила".split(),
    ("cyrillic", "m"): "Александр Сергей Владимир Андрей Алексей Дмитрий Николай Михаил Евгений Павел".split(),
    ("greek", "f"): "Μαρία Ελένη Αικατερίνη Βασιλική Σοφία Αγγελική".split(),
    ("greek", "m"): "Γεώργιος Κωνσταντίνος Δημήτριος Ιωάννης Νικόλαος Παναγιώτης".split(),
}
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Monsieur Madame Mademoiselle Señor Señora Señorita Sr Sra Г-н Г-жа".split()
POOL = {n: k for k, names in NAMES.items() for n in names}
# Letters by script, vowels and consonants.
LETTERS = ["aeiou", "bcdfghjklmnpqrstvwxyz", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ"]
LETTER_OF = {c: group for group in LETTERS for c in group}
WORD = r"[^\W\d_][^\W\d_'’-]*"
PATTERN = re.compile(
    r"""
    (?P<email>(?<![\w.%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})
  | (?P<secret>(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\b["']?\s*[=:]\s*["']?)(?P<value>[A-Za-z0-9+/_~-]{6,}))
  | (?P<accesskey>(?<!\w)A(?:KIA|SIA)[0-9A-Z]{16}(?!\w))
  | (?P<hexkey>(?<!\w)(?=[0-9a-f]*[a-f])(?=[0-9a-f]*[0-9])[0-9a-f]{32,}(?!\w))
  | (?P<iban>(?<!\w)[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){3,7}(?:[ ]?[A-Z0-9]{1,3})?(?!\w))
  | (?P<ip>(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\w|\.[0-9]))
  | (?P<phone>(?<![\w+])\+[0-9]{1,3}[ .-]?\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}(?!\w)|(?<![\w(])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?!\w))
  | (?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))
  | (?P<card>(?<![\w.-])[3-6][0-9]{3}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?!\w))
    """,
    re.VERBOSE,
)
MAYBE = re.compile(r"[0-9@]|(?i:passw|pwd|secret|token|key)")
TITLED = re.compile(rf"\b(?:{'|'.join(TITLES)})\b\.?[ ]+(?P<names>{WORD}(?:[ ]+{WORD})?)")
CAPITAL = r"[^\W\d_a-zß-öø-ÿа-яёα-ω][^\W\d_]*(?:['’-][^\W\d_]+)*"
FULL = rf"{CAPITAL}(?:[ ]+{CAPITAL}){{1,2}}"
# Words before a name, in English, German, French and Spanish; the second ones with a colon only.
CUES = "my name is|mein Name ist|je m['’]appelle|me llamo|signed by|sincerely|regards|mit freundlichen Grüßen|cordialement|atentamente|c/o".split("|")
LABELS = "name|contact|attn|author|patient|customer|employee".split("|")
CUED = re.compile(rf"\b(?i:(?:{'|'.join(CUES)})[,:]?|(?:{'|'.join(LABELS)}):)\s+(?P<names>{FULL})")
# Capitalised words that are no part of a name.
NO_NAMES = set("The A An Our Us We Your My His Her Their This That All And Or Of In On At For To By From With Today Team Department".split())
BESIDE = re.compile(rf"(?P<names>{FULL})[ ]*[<(][ ]*(?:mailto:)?$")
HINTS = [*(c.split("[")[0].lower() for c in CUES), *(f"{c}:" for c in LABELS)]  # a text without any of these has no cue
IP6 = re.compile(r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])")
NAMED = re.compile(rf"\b(?P<names>(?:{'|'.join(sorted(POOL, key=len, reverse=True))})[ ]+{WORD})\b")
SEPARATORS = re.compile(r"[\s()\[\]./-]+")
ENTITIES = "array<struct<type:string,start:int,end:int,surrogate:string>>"


class Surrogates:
    """Keyed surrogates of entity values."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key).digest()
        self.memo: dict[tuple[str, str], str] = {}

    def stream(self, tweak: str, data: list[int], n: int) -> list[int]:
        out, block = [], 0
        while len(out) < n:
            d = hashlib.blake2b(f"{tweak}|{block}|{data}".encode(), key=self.key).digest()
            out += [int.from_bytes(d[i : i + 8], "big") for i in range(0, 64, 8)]
            block += 1
        return out[:n]

    def permute(self, values: list[int], sizes: list[int], tweak: str) -> list[int]:
        """A keyed permutation of all lists of numbers below `sizes`."""
        values, half = list(values), len(values) // 2
        for r in range(ROUNDS):
            source, target = (slice(0, half), slice(half, None)) if r % 2 == 0 else (slice(half, None), slice(0, half))
            add = self.stream(f"{tweak}|{sizes}|{r}", values[source], len(values[target]))
            values[target] = [(v + a) % s for v, a, s in zip(values[target], add, sizes[target], strict=True)]
        return values

    def invert(self, values: list[int], sizes: list[int], tweak: str) -> list[int]:
        values, half = list(values), len(values) // 2
        for r in reversed(range(ROUNDS)):
            source, target = (slice(0, half), slice(half, None)) if r % 2 == 0 else (slice(half, None), slice(0, half))
            add = self.stream(f"{tweak}|{sizes}|{r}", values[source], len(values[target]))
            values[target] = [(v - a) % s for v, a, s in zip(values[target], add, sizes[target], strict=True)]
        return values

    def move(self, values: list[int], sizes: list[int], tweak: str) -> list[int]:
        """A keyed permutation that is one cycle of all lists of numbers below `sizes`, so none stays (if there are two or more)."""
        most = min(math.prod(sizes) - 1, 1 << 32)
        if most < 1:
            return values
        step = 1 + self.stream(f"{tweak}|{sizes}|step", [], 1)[0] % most
        while any(math.gcd(step, s) > 1 for s in sizes):
            step = step % most + 1
        values = self.permute(values, sizes, tweak)
        for i, s in enumerate(sizes):
            step, values[i] = divmod(values[i] + step, s)
        return self.invert(values, sizes, tweak)

    def walk(self, text: str, alphabets: list[str], tweak: str, fits: Callable[[str], bool]) -> str:
        """Permute the characters that have an alphabet, again until `fits`; only a text that nothing else fits stays as it is."""
        at = [i for i, a in enumerate(alphabets) if a]
        if not at:
            return text
        out, sizes = text, [len(alphabets[i]) for i in at]
        while True:
            values = self.move([alphabets[i].index(out[i]) for i in at], sizes, tweak)
            chars = list(out)
            for i, v in zip(at, values, strict=True):
                chars[i] = alphabets[i][v]
            out = "".join(chars)
            if fits(out) or out == text:
                return out

    def plain(self, text: str, tweak: str) -> str:
        """Digits, capital and small letters a-z, each for its like; hexadecimal keys stay so."""
        if kind(text) == "hex":
            return self.walk(text, ["0123456789abcdef"] * len(text), tweak + "hex", lambda s: kind(s) == "hex")
        alphabets = [alphabet(c) for c in text]
        return self.walk(text, alphabets if any(alphabets) else ["+/_~-"] * len(text), tweak, lambda s: kind(s) == "plain")

    def digits(self, text: str, tweak: str, keep: int = 0) -> str:
        """Digits after the first `keep`, whatever separates them; 0-1 and 2-9 each for their like."""
        only = [c for c in text if c.isdigit()]
        names = ["" if i < keep else "01" if c in "01" else "23456789" for i, c in enumerate(only)]
        new = iter(self.walk("".join(only), names, f"{tweak}{keep}", lambda s: True))
        return "".join(next(new) if c.isdigit() else c for c in text)

    def card(self, text: str) -> str:
        only = [int(c) for c in text if c.isdigit()]
        body = self.move(only[1:-1], [10] * (len(only) - 2), f"card{only[0]}")
        check = (luhn([only[0], *body]) + only[-1] - luhn(only[:-1])) % 10
        new = iter([only[0], *body, check])
        return "".join(str(next(new)) if c.isdigit() else c for c in text)

    def iban(self, text: str) -> str:
        only = [c for c in text if c != " "]
        new = iter(only[:4] + list(self.walk("".join(only[4:]), [alphabet(c) for c in only[4:]], "iban", lambda s: True)))
        return "".join(c if c == " " else next(new) for c in text)

    def ip(self, text: str) -> str:
        return ".".join(map(str, self.move([int(x) for x in text.split(".")], [256] * 4, "ip")))

    def ip6(self, text: str) -> str:
        """Hexadecimal digits for their like; leading zeros and the places of the colons stay."""
        low = text.lower()
        lead = [(i == 0 or low[i - 1] == ":") and low[i + 1 : i + 2] not in ("", ":") for i in range(len(low))]
        names = ["" if c == ":" or (first and c == "0") else "123456789abcdef" if first else "0123456789abcdef" for c, first in zip(low, lead, strict=True)]
        out = self.walk(low, names, "ip6", lambda s: any(c.isdigit() for c in s))
        return "".join(o.upper() if c.isupper() and o.isalpha() else o for c, o in zip(text, out, strict=True))

    def email(self, text: str) -> str:
        low = text.lower()
        name, _, domain = low.rpartition("@")
        labels, _, top = domain.rpartition(".")
        alphabets = [alphabet(c) for c in f"{name}@{labels}"]
        if not any(alphabets):
            alphabets = ["._%+-"] * len(name) + [""] * (1 + len(labels))
        new = self.walk(f"{name}@{labels}", alphabets, "email", lambda s: True)
        out = f"{new}.{top}"
        return "".join(o.upper() if c.isupper() else o for c, o in zip(text, out, strict=True))

    def name(self, word: str) -> str:
        """One part of a name; pools by gender and script, other words by letters, never becoming a listed name."""
        title = word[:1].upper() + word[1:].lower()
        if title in POOL:
            names = NAMES[POOL[title]]
            out = names[self.move([names.index(title)], [len(names)], f"name{POOL[title]}")[0]]
        else:
            low = word.lower()
            groups = [LETTER_OF.get(c, "") for c in low[:-1]] + [""]
            if not any(groups):  # one letter, or another script
                groups[-1] = LETTER_OF.get(low[-1:], "")
            if not any(groups):
                groups = [letters_like(c) for c in low]
            out = self.walk(low, groups, "name", lambda s: s.title() not in POOL)
            out = self.placeholder(low) if out == low else out
            if len(out) == len(word):  # each letter keeps its case
                return "".join(o.upper() if c.isupper() and len(o.upper()) == 1 else o for c, o in zip(word, out, strict=True))
            out = out.title()
        return out.upper() if word.isupper() and len(word) > 1 else out if word[:1].isupper() else out.lower()

    def placeholder(self, word: str) -> str:
        return "x" + "".join(chr(97 + x % 26) for x in self.stream("placeholder", [ord(c) for c in word], 11))

    def names(self, text: str) -> str:
        return re.sub(WORD, lambda m: self.name(m[0]), text)

    def of(self, type_: str, text: str) -> str:
        known = self.memo.get((type_, text))
        if known is None:
            if len(self.memo) > 1 << 16:
                self.memo.clear()
            known = self.memo[type_, text] = self.make(type_, text)
        return known

    def make(self, type_: str, text: str) -> str:
        if type_ == "person":
            return self.names(text)
        if type_ in ("email", "card", "ip", "ip6", "iban"):
            return getattr(self, type_)(text)
        if type_ == "phone":
            code = re.match(r"\+([0-9]{1,3})(?=[ .(-])", text)
            return self.digits(text, "phone", len(code[1]) if code else 1 if text[0] == "+" else 0)
        if type_ == "ssn":
            return self.digits(text, "ssn")
        if type_ == "accesskey":
            return text[:4] + self.walk(text[4:], ["ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"] * 16, "accesskey", lambda s: True)
        return self.plain(text, "key")


def alphabet(c: str) -> str:
    for name in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"):
        if c in name:
            return name
    return ""


@functools.cache
def letters_like(c: str) -> str:
    """Small letters of c's block of 256 code points that have no group in LETTERS and come back from capitals."""
    first = ord(c) & ~0xFF
    found = "".join(x for x in map(chr, range(first, first + 256)) if x.isalpha() and x not in LETTER_OF and x.upper().lower() == x and len(x.upper()) == 1 and x.upper() != x)
    return found if c in found else ""


def kind(text: str) -> str:
    return "hex" if re.fullmatch(r"(?=[0-9a-f]*[a-f])(?=[0-9a-f]*[0-9])[0-9a-f]{8,}", text) else "plain"


def luhn(body: list[int]) -> int:
    """The check digit of a card number's other digits."""
    total = sum(d if i % 2 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(body)))
    return -total % 10


def upper_words(names: str, at: int) -> tuple[int, int] | None:
    """Span of the leading capitalised words of a run of words that starts at `at`."""
    end = 0
    for m in re.finditer(WORD, names):
        if not m[0][:1].isupper():
            break
        end = m.end()
    return (at, at + end) if end else None


def persons(text: str, emails: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Names: after a title or a first name of the list; full names after a cue, before an address in brackets, or
    whose two parts make up an address of the text; and every other place of a full name found in these ways."""
    tokens = set(text.split())
    found: list[tuple[int, int]] = []
    if not tokens.isdisjoint(TITLES) or any(t[-1] == "." and t[:-1] in TITLES for t in tokens) or not tokens.isdisjoint(POOL):
        for pattern in (TITLED, NAMED):
            for m in pattern.finditer(text):
                span = upper_words(m["names"], m.start("names"))
                if span and (pattern is TITLED or " " in text[span[0] : span[1]]):
                    found.append(span)
    low = text.lower()
    if any(h in low for h in HINTS):
        found += [m.span("names") for m in CUED.finditer(text) if NO_NAMES.isdisjoint(m["names"].split())]
    for a, b in emails:
        if (m := BESIDE.search(text, max(0, a - 120), a)) and NO_NAMES.isdisjoint(m["names"].split()):
            found.append(m.span("names"))
        parts = [p for p in re.split(r"[._+-]", text[a:b].partition("@")[0].lower()) if len(p) > 1 and p.isalpha()]
        if len(parts) == 2:
            x, y = (p[0].upper() + p[1:] for p in parts)
            found += [m.span() for m in re.finditer(rf"\b(?:{x}[ ]+{y}|{y}[ ]+{x})\b", text)]
    for name in {text[a:b] for a, b in found if " " in text[a:b]}:
        found += [m.span() for m in re.finditer(rf"\b{re.escape(name)}\b", text)]
    return found


def detect(text: str) -> list[tuple[int, int, str]]:
    """(start, end, type) of the entities of a text, in order, without overlaps."""
    found = []
    if MAYBE.search(text):
        for m in PATTERN.finditer(text):
            type_ = m.lastgroup if m.lastgroup != "value" else "secret"
            if m["secret"]:
                found.append((*m.span("value"), "secret"))
            elif type_ != "ip" or all(int(x) < 256 for x in m[0].split(".")):
                found.append((*m.span(), type_))
        if text.count(":") > 1:
            found += [(*m.span(), "ip6") for m in IP6.finditer(text) if any(c.isdigit() for c in m[0])]
    found += [(a, b, "person") for a, b in persons(text, [(a, b) for a, b, t in found if t == "email"])]
    out: list[tuple[int, int, str]] = []
    for a, b, t in sorted(found, key=lambda x: (x[0], -x[1])):
        if not out or a >= out[-1][1]:
            out.append((a, b, t))
    return out


def replace(text: str | None, surrogates: Surrogates) -> tuple[str | None, list[dict]]:
    """The text with surrogates, and its entities by their place in the original."""
    if not text:
        return text, []
    parts, entities, at = [], [], 0
    for a, b, t in detect(text):
        s = surrogates.of(t, text[a:b])
        parts += [text[at:a], s]
        entities.append({"type": t, "start": a, "end": b, "surrogate": s})
        at = b
    return "".join([*parts, text[at:]]) if parts else text, entities


def identity(type_: str, original: str) -> bytes:
    """Digest of what an entity is: its type and value, runs of separators counting as one, names and addresses whatever the case."""
    value = " ".join(SEPARATORS.sub(" ", original).split())
    return hashlib.blake2b(f"{type_}|{value.lower() if type_ in ('person', 'email') else value}".encode(), digest_size=16).digest()


def pseudonymise(docs: DataFrame, key: str, *, text: str = "text", entities: str = "entities", identities: str | None = None) -> DataFrame:
    """docs with surrogates in `text` and the column `entities` (type, start and end in the original text, surrogate).

    Null stays null; texts without entities stay as they are; repeated rows get equal results; very long texts are read
    whole, one at a time; an empty table stays empty. A column of docs that has the name of `entities` is replaced, all others
    pass through. Rows need no exchange: the key alone decides every surrogate. `identities` names one more column, the
    digests of the entities' originals, for a collision check.
    """

    def make():
        surrogates = Surrogates(key.encode())

        def f(texts):
            got = [replace(t, surrogates) for t in texts]
            kind_ = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("surrogate", pa.string())]))
            out = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], kind_)]
            if identities:
                out.append(pa.array([[identity(e["type"], t[e["start"] : e["end"]]) for e in g[1]] for t, g in zip(texts, got, strict=True)], pa.list_(pa.binary())))
            return out

        return f

    fields = T.StructType([T.StructField(text, T.StringType()), T.StructField(entities, T._parse_datatype_string(ENTITIES))])
    last = [entities, *([identities] if identities else [])]
    if identities:
        fields = fields.add(identities, T.ArrayType(T.BinaryType()))
    out = annotate(docs, text, fields, make)
    return out.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in [x.lower() for x in last]), *(F.col(f"`{c}`") for c in last))


def collisions(annotated: DataFrame, *, entities: str = "entities", identities: str = "identities") -> DataFrame:
    """type, surrogate: surrogates that stand for different originals (identity); none expected. Surrogates are compared as they
    are, runs of blanks collapsed: formats are kept, so one that differs from another in its separators stands for another entity.
    Only entities are shuffled, summed up in each task first."""
    e = annotated.select(F.explode(F.arrays_zip(F.col(f"`{entities}`").alias("e"), F.col(f"`{identities}`").alias("i"))).alias("z")).select("z.e.type", F.regexp_replace("z.e.surrogate", r"\s+", " ").alias("surrogate"), "z.i")
    return e.groupBy("type", "surrogate").agg(F.min("i").alias("a"), F.max("i").alias("b")).where("a <> b").select("type", "surrogate")


def pseudonymise_checked(docs: DataFrame, key: str, *, text: str = "text", entities: str = "entities") -> DataFrame:
    """pseudonymise, written once as a table in the shared folder and searched for collisions; ValueError if there is one."""
    identities = "identities"
    while identities in [c.lower() for c in docs.columns]:
        identities += "_"
    rows = to_table(pseudonymise(docs, key, text=text, entities=entities, identities=identities), "pseudonyms")
    if clash := collisions(rows, entities=entities, identities=identities).first():
        raise ValueError(f"one surrogate for different entities: {clash.type} {clash.surrogate}")
    return rows.drop(identities)
