"""The grammar of labels: what opens a provision, and how people write where one stands.

Texts are cut into words, numbers and signs; small tables over these say what a
sequence of them means.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.schema import BY_NAME, BY_SHORT, CATALOGUE, COMPONENT, STRUCTURAL, VERSION

#: Numerals by value.
NUMERALS = ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i"))
#: Words in place of numbers of headings.
WORD_NUMBERS = {"unica": 1, "unico": 1, "preliminar": 1, "geral": 1, "especial": 2, "complementar": 99}
#: Signs that mark an ordinal, that join a letter or end a label.
ORDINAL_SIGNS, DASHES = frozenset("º°ª"), frozenset("-–—")
ENDS = DASHES | ORDINAL_SIGNS | {"."}
IGNORED = frozenset(" ,.;:-)(\"'–—")


def plain(text: str) -> str:
    """Lower case, without accents, single spaces."""
    bare = "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")
    return " ".join(bare.lower().split())


def numeral(n: int) -> str:
    out = ""
    for value, letters in NUMERALS:
        out += letters * (n // value)
        n %= value
    return out


def roman(text: str) -> int | None:
    """The value of a well-formed numeral below 5000, else None: one that is written the same way when it is written anew."""
    s, digits = plain(text).replace(".", ""), {letters: value for value, letters in NUMERALS if len(letters) == 1}
    if not s or not set(s) <= set(digits):
        return None
    total = largest = 0
    for letter in reversed(s):
        value = digits[letter]
        total += value if value >= largest else -value
        largest = max(largest, value)
    return total if 0 < total < 5000 and numeral(total) == s else None


@dataclass(frozen=True)
class Token:
    """kind: word, number (a run of digits and dots that begins with a digit) or sign (one character)."""

    kind: str
    raw: str
    begin: int
    end: int

    @property
    def plain(self) -> str:
        return plain(self.raw)

    @property
    def number(self) -> int:
        return int(self.raw.replace(".", ""))


def scan(text: str, at: int = 0) -> Iterator[Token]:
    """The tokens of a text from ``at`` on; white space only parts them."""
    n = len(text)
    while at < n:
        c, end = text[at], at + 1
        if c.isspace():
            at = end
            continue
        if "0" <= c <= "9":
            while end < n and (text[end] == "." or "0" <= text[end] <= "9"):
                end += 1
            kind = "number"
        elif c.isalpha() and c not in ORDINAL_SIGNS:
            while end < n and text[end].isalpha() and text[end] not in ORDINAL_SIGNS:
                end += 1
            kind = "word"
        else:
            kind = "sign"
        yield Token(kind, text[at:end], at, end)
        at = end


class Reader:
    """Tokens with a place in them."""

    def __init__(self, tokens: list[Token]):
        self.tokens, self.at = tokens, 0

    def peek(self, ahead: int = 0) -> Token | None:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else None

    def take(self, kind: str, *values: str) -> Token | None:
        """The next token, if it is of a kind and (in plain letters, if a word) one of the values."""
        token = self.peek()
        if token is None or token.kind != kind or values and (token.plain if kind == "word" else token.raw) not in values:
            return None
        self.at += 1
        return token

    def skip(self, signs: frozenset[str]) -> None:
        while (token := self.peek()) and token.kind == "sign" and token.raw in signs:
            self.at += 1

    def end(self) -> int:
        return self.tokens[self.at - 1].end if self.at else 0

    def counted(self) -> tuple[int, str] | None:
        """A number, its ordinal sign if it has one, and the letter joined to it by a dash ('' if none)."""
        token = self.take("number")
        if token is None:
            return None
        letter, after = "", self.peek()
        if after and (after.raw in ORDINAL_SIGNS or after.raw == "o" and after.begin == token.end):
            self.at += 1
        dash, joined = self.peek(), self.peek(1)
        if dash and joined and dash.raw in DASHES and joined.kind == "word" and len(joined.raw) == 1 and dash.begin == self.end() and joined.begin == dash.end:
            letter = joined.plain
            self.at += 2
        return token.number, letter


@dataclass(frozen=True)
class Label:
    type: str
    segment: str
    label: str
    text: str


def numbered(sign: str, number: int, letter: str) -> str:
    """As drafting rules write it: ordinals up to nine, dots from 1000 on."""
    return f"{sign} {number:,}".replace(",", ".") + ("º" if number < 10 else "") + (f"-{letter.upper()}" if letter else "")


def classify(text: str) -> Label | None:
    """The provision that a block opens; None for prose and continuations."""
    reader = Reader(list(islice(scan(text), 8)))
    first, second = reader.peek(), reader.peek(1)
    if first is None or first.begin:
        return None
    found = None  # type, segment, label
    if first.kind == "word" and second is not None:
        word = first.plain
        if word in STRUCTURAL and second.kind in ("word", "number") and second.begin > first.end:
            number = second.number if second.raw.isdigit() else WORD_NUMBERS.get(second.plain, roman(second.raw))
            if number is not None:
                reader.at = 2
                found = word, f"{BY_NAME[word].short}{number}", f"{first.raw} {second.raw}"
        elif first.raw == "Art":
            reader.at = 1
            reader.skip(frozenset("."))
            if counted := reader.counted():
                found = "artigo", "art{}{}".format(*counted), numbered("Art.", *counted)
        elif first.raw[0] == "P" and (word, second.plain) == ("paragrafo", "unico") and second.raw[0].islower():
            reader.at = 2
            found = "paragrafo", "parunico", "Parágrafo único"
        elif second.raw in DASHES and first.raw.isupper() and (number := roman(first.raw)) is not None:
            reader.at = 1
            found = "inciso", f"inc{number}", first.raw
        elif second.raw == ")" and len(first.raw) == 1 and "a" <= first.raw <= "z":
            reader.at = 2
            found = "alinea", f"ali{ord(first.raw) - 96}", f"{first.raw})"
    elif first.raw == "§":
        reader.at = 1
        if counted := reader.counted():
            found = "paragrafo", "par{}{}".format(*counted), numbered("§", *counted)
    elif first.kind == "number":
        digits, closed = first.raw.rstrip("."), first.raw.endswith(".")
        end = first.end if closed else second.end if second is not None and second.raw in DASHES | {")"} else 0
        if digits.isdigit() and len(digits) < 3 and first.raw in (digits, digits + ".") and end and text[end : end + 1].isspace():
            reader.at = 1 if closed else 2
            found = "item", f"ite{int(digits)}", f"{int(digits)}."
    if found is None:
        return None
    if found[0] in ("artigo", "paragrafo", "inciso") and (token := reader.peek()) and token.raw in ENDS:
        reader.at += 1
    return Label(*found, " ".join(text[reader.end() :].split()))


#: Words that may stand before the number of a label, by type: its name and its abbreviation.
NAMES = {name: kind for k in BY_NAME.values() for name, kind in ((k.name, k.name), (k.short, k.name))}


def segment(type_: str, label: str) -> str:
    """A label as the source writes it to the segment of an id; ValueError for what is not understood."""
    if type_ == "caput":
        return BY_NAME["caput"].short
    short, words = BY_NAME[type_].short, list(scan(plain(label)))
    if type_ == "paragrafo" and any(w.raw == "unico" for w in words):
        return "parunico"
    reader = Reader(words[1:] if words and words[0].raw in NAMES else words)
    reader.skip(IGNORED | {"§"})
    token = reader.peek()
    if token is not None and token.kind == "word":
        reader.at += 1
        reader.skip(IGNORED)
        if reader.peek() is None and (type_ in STRUCTURAL or type_ == "inciso") and (value := roman(token.raw)) is not None:
            return f"{short}{value}"
        if reader.peek() is None and type_ in ("alinea", "item") and len(token.raw) == 1 and "a" <= token.raw <= "z":
            return f"{short}{ord(token.raw) - 96}"
    elif counted := reader.counted():
        reader.skip(IGNORED)
        if reader.peek() is None:
            return f"{short}{counted[0]}{counted[1]}"
    raise ValueError(f"label not understood for {type_}: {label!r}")


def parse_segment(value: str) -> tuple[str, int | None, str, int | None]:
    """(type, number, letter, version) of a segment; ValueError if it is none."""
    own, mark, version = value.partition(VERSION)
    if not mark or version.isdecimal():
        number = int(version) if mark else None
        if own in ("parunico", "cpt"):
            return BY_SHORT[own[:3]].name, None, "", number
        digits = own[3:].rstrip("abcdefghijklmnopqrstuvwxyz")
        if own[:3] in BY_SHORT and own[:3] != "cpt" and digits.isdecimal() and len(own) - 3 - len(digits) < 2:
            return BY_SHORT[own[:3]].name, int(digits), own[3 + len(digits) :], number
    raise ValueError(f"malformed segment {value!r}")


def with_version(value: str, version: int) -> str:
    if version < 1 or parse_segment(value)[3] is not None:
        raise ValueError(f"no version {version} for {value!r}")
    return f"{value}{VERSION}{version}"


def fragment(path: str) -> str:
    """Fragment of a path: what stands above the last article goes, the component stays first."""
    parts = [s for s in path.split("/") if s]
    component, rest = [s for s in parts if s == COMPONENT], [s for s in parts if s != COMPONENT]
    last = max((i for i, s in enumerate(rest) if s.startswith("art")), default=0)
    return "_".join(component + rest[last:])


def _written(tokens: list[Token]) -> list[str]:
    """What a sequence says, whatever its dots: words, numbers, and signs but for stops."""
    return [str(t.number) if t.kind == "number" else t.raw for t in tokens if t.raw != "."]


def known_norms() -> list[tuple[list[str], str]]:
    """(tokens of a name, urn) of the catalogue, the longest name first."""
    names = [(_written(list(scan(plain(name)))), urn) for urn, *_, others in CATALOGUE for name in others]
    return sorted(names, key=lambda x: (-sum(map(len, x[0])), x[0]))


def resolve_alias(text: str) -> str | None:
    """The norm that a name stands for, as it is; None if none."""
    own = _written(list(scan(plain(text))))
    return next((urn for name, urn in known_norms() if name == own), None)


#: Below an article: words that may open a level, the type, and what its mark must be.
LEVELS = (
    (("§", "par", "paragrafo"), "paragrafo", "count"),
    (("item", "ite"), "item", "count"),
    (("inciso", "inc"), "inciso", "numeral"),
    (("alinea", "al"), "alinea", "letter"),
    ((), "inciso", "numeral"),
    ((), "alinea", "letter"),
)


def _level(reader: Reader, seen: set[str]) -> str | None:
    """The segment of the next level, the reader moved past it; None if it is none."""
    start = reader.at
    for openers, type_, mark in LEVELS:
        reader.at = start
        opened = False
        while openers and (token := reader.peek()) and token.raw in openers:
            reader.at += 1
            reader.skip(IGNORED)
            opened = True
        if openers and not opened:
            continue
        if type_ == "paragrafo" and reader.take("word", "unico"):
            return "parunico"
        if mark == "count":
            if counted := reader.counted():
                return f"{BY_NAME[type_].short}{counted[0]}{counted[1] if type_ == 'paragrafo' else ''}"
            continue
        token = reader.take("word")
        if token is None:
            continue
        if mark == "numeral" and "inciso" not in seen and "alinea" not in seen and (value := roman(token.raw)) is not None:
            seen.add("inciso")
            return f"inc{value}"
        if mark == "letter" and len(token.raw) == 1 and "a" <= token.raw <= "z":
            seen.add("alinea")
            return f"ali{ord(token.raw) - 96}"
    reader.at = start
    return "parunico" if reader.take("word", "unico") else None


def resolve_label(text: str) -> str:
    """"CC art. 206 § 3º V" to the id of the provision; ValueError, never a guess, for what is not understood."""
    tokens = [t for t in scan(plain(text)) if t.raw != "."]
    said = _written(tokens)
    name, urn = next(((n, u) for n, u in known_norms() if said[: len(n)] == n), (None, None))
    if name is None:
        raise ValueError(f"no known norm in {text!r}")
    reader, out = Reader(tokens[len(name) :]), []
    reader.skip(IGNORED)
    if reader.take("word", COMPONENT):
        out.append(COMPONENT)
        reader.skip(IGNORED)
    if not reader.take("word", "art", "artigo") or not (counted := reader.counted()):
        raise ValueError(f"no article in {text!r}")
    out.append("art{}{}".format(*counted))
    seen: set[str] = set()
    reader.skip(IGNORED)
    while (token := reader.peek()) is not None:
        if (found := _level(reader, seen)) is None:
            raise ValueError(f"{token.raw!r} in {text!r} not understood")
        out.append(found)
        reader.skip(IGNORED)
    return f"{urn}!{fragment('/'.join(out))}"


@lru_cache(maxsize=2)
def _mention(most: int) -> re.Pattern:
    """A mention of an article, in letters up to ``most``: word, number, ordinal sign, paragraph; the word behind is looked at, not taken."""
    letters = [c for c in map(chr, range(most + 1)) if c.isalpha() and c not in ORDINAL_SIGNS]
    begins = [c for before, c in zip([0, *map(ord, letters)], letters) if ord(c) - before > 1]
    ends = [c for c, after in zip(letters, [*map(ord, letters[1:]), most + 2]) if after - ord(c) > 1]
    letter = f"[{''.join(f'{b}-{e}' for b, e in zip(begins, ends, strict=True))}]"
    spelt = {c: "".join([c, c.upper()]) for c in "artigos"}
    for c in letters:
        if unicodedata.decomposition(c) and (bare := plain(c)) in spelt and c not in spelt[bare]:
            spelt[bare] += c
    a, r, t, i, g, o, s = (f"[{spelt[c]}]" for c in "artigos")
    number, signs = "[0-9][0-9.]*+", "".join(ORDINAL_SIGNS)
    return re.compile(
        rf"{a}(?<!{letter}.){r}{t}(?:{s}|{i}{g}{o}{s}?)?(?!{letter})"
        rf"(?:\s*\.)*+\s*+(?P<article>{number})(?P<sign>\s*(?:[{signs}]|o(?!{letter})))?"
        rf"(?:(?:\s*,)?\s*§\s*(?P<paragraph>{number}))?(?=(?:\s*,)?\s*(?P<item>{letter}++))?"
    )


#: Words in the place of an item, as texts repeat them.
_numeral = lru_cache(maxsize=1 << 14)(roman)


def references(text: str) -> list[tuple[str, str]]:
    """(fragment, wording) of every mention of an article in a text, with its paragraph and item if they follow."""
    try:
        text.encode("latin-1")
        most = 0xFF  # few letters are told faster
    except UnicodeEncodeError:
        most = sys.maxunicode
    out = []
    for found in _mention(most).finditer(text):
        article, paragraph, item = found.group("article", "paragraph", "item")
        target, end = f"art{int(article.replace('.', ''))}", found.end("sign") if found["sign"] else found.end("article")
        if paragraph:
            target += f"_par{int(paragraph.replace('.', ''))}"
            # the number alone, without the stop behind it
            end = found.start("paragraph") + len(paragraph.rstrip("."))
        if item and len(item) <= 8 and (value := _numeral(item)) is not None:
            target += f"_inc{value}"
            end = found.end("item")
        out.append((target, " ".join(text[found.start() : end].split())))
    return out


#: How an amendment note begins, in plain letters.
AMENDMENTS = ("incluido", "incluida", "redacao dada", "revogado", "revogada", "renumerado", "renumerada")


def amendment(text: str) -> tuple[int, int, str, int] | None:
    """(begin, end, action, year) of the first note in brackets that says how and when a wording came about."""
    at = text.find("(")
    while at >= 0:
        end = text.find(")", at)
        if end < 0:
            return None
        inner = text[at + 1 : end]
        said = plain(inner)
        action = next((a for a in AMENDMENTS if said.startswith(a)), None)
        years = [t.number for t in scan(inner) if t.kind == "number" and t.raw.rstrip(".").isdigit() and 1800 <= t.number < 2100]
        if action and years:
            return at, end + 1, " ".join(inner.lower().split()[: len(action.split())]), years[0]
        at = text.find("(", at + 1)
    return None


def classified(text: Column) -> Column:
    """``classify`` on a column: struct<type, segment, label, text>, null for prose."""

    @F.pandas_udf("struct<type: string, segment: string, label: string, text: string>")
    def run(values: pd.Series) -> pd.DataFrame:
        rows = [classify(v) if v else None for v in values]
        return pd.DataFrame({k: [getattr(r, k) if r else None for r in rows] for k in ("type", "segment", "label", "text")})

    return run(text)
