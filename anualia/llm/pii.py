"""Personal data by offset-preserving deobfuscation.

A text is read twice. The base patterns run on the text as it is. Then a chain of
transducers rewrites disguises into plain characters: look-alike letters, full
width forms and invisible characters; spelled digits; "at" and "dot" in brackets
or as words. Every transducer gives its edits as (start, end, replacement), and
the edits of the chain compose into one map from places in the rewritten text to
places in the source. The same patterns run on the rewritten text, and what they
find there is mapped back. A span found that way is added when it holds an edit;
base spans always stay. Offsets are code points, the end exclusive.

Defined results: null and empty texts have no spans; a span that the rewritten
text shares with a base span of its kind is not repeated; equal rows get equal
spans; an empty table gives no rows. Extra columns are ignored, whatever their
names are.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")


class Span(NamedTuple):
    kind: int
    start: int
    end: int


# ---- detectors -----------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match starts at the first digit of a run or fails for the whole run, so later starts are not tried.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Around each "@": the run of local characters before it, the domain after it."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            yield start, free
        at = text.find("@", max(free, at + 1))


def _luhn(digits: str) -> bool:
    doubled = (int(d) * 2 for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(d // 10 + d % 10 for d in doubled)) % 10 == 0


def detect(text: str) -> list[Span]:
    """Base spans by kind, then start."""
    found = [Span(0, a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            found.append(Span(1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and _luhn(digits):
                found.append(Span(2, *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            found.append(Span(3, *m.span()))
    return found


# ---- transducers ---------------------------------------------------------------

Edit = tuple[int, int, str]

# Letters of other scripts that look like Latin ones.
_LOOKALIKES = dict(zip("авеіјкмнорсԁтухѕһԛԝАВЕЅІЈКМНОРСТУХαεικνορτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
                       "abeijkmhopcdtyxshqwABESIJKMHOPCTYXaeiknoptuxABEZHIKMNOPTYX"))
_INVISIBLE = "­​‌‍⁠﻿"
_DOTS = "。｡․"
_SPACES = "   "
_DASHES = "‐‑‒–−"


def _plain_characters() -> dict[str, str]:
    """Look-alikes by rule: characters whose compatibility form or digit value is one ASCII character."""
    table = {}
    for code in (*range(0x80, 0x3100), *range(0xFE00, 0x10000), *range(0x1D400, 0x1D800)):
        char = chr(code)
        digit = unicodedata.digit(char, None) if unicodedata.category(char) == "Nd" else None
        folded = str(digit) if digit is not None else unicodedata.normalize("NFKC", char)
        if len(folded) == 1 and folded.isascii() and folded.isprintable():
            table[char] = folded
    table |= _LOOKALIKES
    for chars, plain in ((_INVISIBLE, ""), (_DOTS, "."), (_SPACES, " "), (_DASHES, "-")):
        table |= dict.fromkeys(chars, plain)
    return table


_PLAIN = _plain_characters()
# Characters above the basic plane are searched as one range: a listed class is slow there.
_ODD = [
    re.compile("[" + "".join(re.escape(c) for c in sorted(_PLAIN) if c < "\U00010000") + "]"),
    re.compile("[\U0001D400-\U0001D7FF]"),
]


def look_alikes(text: str) -> list[Edit]:
    """Characters that stand for one ASCII character, and invisible ones."""
    if text.isascii():
        return []
    return sorted((m.start(), m.end(), _PLAIN[m[0]]) for pattern in _ODD for m in pattern.finditer(text) if m[0] in _PLAIN)


# Digits as words in English, German, French and Spanish.
_DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7",
    "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6",
    "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7",
    "ocho": "8", "nueve": "9",
}
_WORD = "(?:" + "|".join(sorted(_DIGIT_WORDS, key=len, reverse=True)) + ")"
_ITEM = rf"(?:{_WORD}(?!\w)|[0-9]+)"
_SPELLED = re.compile(rf"(?i)(?<!\w)(?:plus[ -]+)?(?:{_WORD}(?!\w)(?:[ ,.()-]{{1,3}}{_ITEM}){{3,}}|[0-9]+(?:[ ,.()-]{{1,3}}{_ITEM}){{3,}})|\+[ ]?{_ITEM}(?:[ ,.()-]{{0,3}}{_ITEM}){{3,}}")


def _by_first(words: list[str]) -> str:
    """Alternatives grouped by their first letter, which fail faster."""
    first = sorted({w[0] for w in words})
    return "(?:" + "|".join(f"{c}(?:{'|'.join(w[1:] for w in words if w[0] == c)})" for c in first) + ")"


# Every run with a digit word has one beside a digit or another digit word; in lower-case text.
_MAYBE_SPELLED = (
    re.compile(rf"\b{_by_first(list(_DIGIT_WORDS))}[ ,.()-]{{1,3}}(?:[0-9]|{_by_first(list(_DIGIT_WORDS))}(?!\w))"),
    re.compile(rf"[0-9][ ,.()-]{{1,3}}{_by_first(list(_DIGIT_WORDS))}(?!\w)"),
)
_ONE_WORD = re.compile(rf"(?i)(?:(?<!\w)plus[ -]+)|(?<!\w){_WORD}(?!\w)|,")


def spelled_digits(text: str) -> list[Edit]:
    """Digit words in runs of at least four digits or digit words; a "plus" before them is the sign."""
    edits = []
    lower = text.lower()
    if not any(pattern.search(lower) for pattern in _MAYBE_SPELLED):
        return edits
    for run in _SPELLED.finditer(text):
        words = [(m.start(), m.end(), m[0]) for m in _ONE_WORD.finditer(text, run.start(), run.end())]
        if not any(w.lower() in _DIGIT_WORDS for *_, w in words):
            continue
        for start, end, word in words:
            plain = "+" if word.lower().startswith("plus") else "" if word == "," else _DIGIT_WORDS[word.lower()]
            edits.append((start, end, plain))
    return edits


_AT_WORDS = "at|arroba|arobase|klammeraffe|@|&#64;|&commat;|%40"
_DOT_WORDS = r"dot|punkt|punto|point|\.|&#46;|&period;"
_BRACKET = re.compile(rf"(?i)[ \t\r\n]{{0,2}}[\[({{<][ ]{{0,2}}(?:(?P<at>{_AT_WORDS})|(?P<dot>{_DOT_WORDS}))[ ]{{0,2}}[\])}}>][ \t\r\n]{{0,2}}")
# Gaps around the signs of an address: "jane @ example . com".
_GAPPED = re.compile(r"(?<=[A-Za-z0-9_%+-]) @ (?=[A-Za-z0-9-]+(?: \. [A-Za-z0-9-]+)* ?\. ?[A-Za-z]{2})")
_GAPPED_DOT = re.compile(r"[A-Za-z0-9-]+(?P<dot> \. )(?=[A-Za-z0-9])")
_CODED = re.compile(r"(?P<at>&#64;|&commat;|%40)|(?P<dot>&#46;|&period;)")
_NAMED_DOT = re.compile(r"(?i) (?:dot|punkt|punto|point) ")
# After a plain dot two letters are asked for, which numbers ("at 10.30") do not have.
_IN_WORDS = re.compile(
    r"(?i)(?P<at> (?<=[A-Za-z0-9_%+-] )(?:at|arroba|arobase) )"
    r"(?=[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*(?:(?P<named> (?:dot|punkt|punto|point) [A-Za-z0-9])|\.[A-Za-z]{2}))"
)
_DOT_AFTER = re.compile(r"(?i)(?:(?P<dot> (?:dot|punkt|punto|point) )|[A-Za-z0-9-]+|\.)")
_NUMBER_DOTS = re.compile(r"(?i)(?<![\w.])[0-9]{1,3}(?:(?: (?:dot|punkt|punto|point) |\.)[0-9]{1,3}){3}(?![\w])")


def marked_signs(text: str) -> list[Edit]:
    """"at" and "dot" in brackets or as character references."""
    edits = [(m.start(), m.end(), "@" if m["at"] else ".") for m in _BRACKET.finditer(text)]
    if "&" in text or "%40" in text:
        edits += [(m.start(), m.end(), "@" if m["at"] else ".") for m in _CODED.finditer(text)]
    for at in _GAPPED.finditer(text) if " @ " in text else ():
        if _word_before(text, at.start()) in _NO_NAMES:
            continue
        edits.append((at.start(), at.end(), "@"))
        dot = _GAPPED_DOT.match(text, at.end())
        while dot:
            edits.append((dot.start("dot"), dot.end("dot"), "."))
            dot = _GAPPED_DOT.match(text, dot.end())
    return _apart(edits)


# Words before "at" that name nobody ("look at example.com").
_NO_NAMES = frozenset(
    "a about all am an and any anything are arrive arrived available be been best book bought build built buy call called "
    "check checked click come comes cost deal discount documentation down download downloads due everything find first found "
    "free from get give given glance go good guess has have he held help here hit home hosted i information install is it "
    "items join just knocked laugh laughed launch learn list listed listen live located look looked looking looks made me meet meeting met "
    "more new news now off offer on one online open or order orders our out over page pages people play point pointing "
    "post posted prices published quality rates read reading register registered rest run runs sale sales see seen sell "
    "shop shopping shops sign site sits shouted smile smiled sold stared someone something stand start stay stop store stored stores stuff "
    "subscribe support team than that the them then there these they thing things this those time today tool trade up us "
    "use used visit was watch we website were what when where which while who work worked working works written you".split()
)
_BEFORE = re.compile(r"[A-Za-z0-9._%+-]+\Z")


def _word_before(text: str, end: int) -> str:
    found = _BEFORE.search(text, max(0, end - 64), end)
    return found[0].lower() if found else ""


def named_signs(text: str) -> list[Edit]:
    """"at" and "dot" as words of an address."""
    # Before a plain dot, "at" is a sign only after a word that can be a name.
    edits = [
        (*m.span("at"), "@") for m in _IN_WORDS.finditer(text)
        if m["at"].lower() != " at " or m["named"] is not None or _word_before(text, m.start()) not in _NO_NAMES
    ]
    if _NAMED_DOT.search(text):
        # A named dot counts after a sign for "at" or inside four numbers.
        for start in [b for _, b, _ in edits] + _plain_ats(text):
            piece = _DOT_AFTER.match(text, start)
            while piece:
                if piece["dot"]:
                    edits.append((piece.start(), piece.end(), "."))
                    if not _DOT_AFTER.match(text, piece.end()):
                        break
                piece = _DOT_AFTER.match(text, piece.end())
        for m in _NUMBER_DOTS.finditer(text):
            edits += [(d.start(), d.end(), ".") for d in _NAMED_DOT.finditer(text, m.start(), m.end())]
    return _apart(edits)


def _plain_ats(text: str) -> list[int]:
    return [m.end() for m in re.finditer("@", text)]


def _apart(edits: list[Edit]) -> list[Edit]:
    """Edits in order; of overlapping ones the first, longest stays."""
    kept, free = [], 0
    for start, end, plain in sorted(set(edits), key=lambda e: (e[0], -e[1])):
        if start >= free:
            kept.append((start, end, plain))
            free = end
    return kept


TRANSDUCERS: tuple[Callable[[str], list[Edit]], ...] = (look_alikes, marked_signs, named_signs, spelled_digits)


class Rewritten:
    """A text after the chain, with the map back to the source.

    The map is a list of pieces: place in the rewritten text, its length there,
    place in the source and length there. Pieces between edits keep their length.
    """

    def __init__(self, text: str):
        self.text = text
        self._pieces: list[tuple[int, int, int, int, bool]] = [(0, len(text), 0, len(text), False)]
        self._starts = [0]
        self.edited = False
        for transducer in TRANSDUCERS:
            edits = transducer(self.text)
            if edits:
                self._apply(edits)

    def _source(self, start: int, end: int) -> tuple[int, int]:
        """Source span of a non-empty span."""
        first = self._pieces[bisect_right(self._starts, start) - 1]
        last = self._pieces[bisect_right(self._starts, end - 1) - 1]
        begin = first[2] if first[4] else first[2] + start - first[0]
        stop = last[2] + last[3] if last[4] else last[2] + end - last[0]
        return begin, stop

    def _apply(self, edits: list[Edit]) -> None:
        out, pieces, place, done = [], [], 0, 0

        def keep(start: int, end: int) -> None:
            nonlocal place
            for at, size, src, src_size, edited in self._covering(start, end):
                a, b = max(start, at), min(end, at + size)
                if edited:
                    pieces.append((place, size, src, src_size, True))
                    place += size
                else:
                    pieces.append((place, b - a, src + a - at, b - a, False))
                    place += b - a

        for start, end, plain in edits:
            keep(done, start)
            out.append(self.text[done:start])
            begin, stop = self._source(start, end)
            if plain:
                pieces.append((place, len(plain), begin, stop - begin, True))
                place += len(plain)
            out.append(plain)
            done = end
        keep(done, len(self.text))
        out.append(self.text[done:])
        self.text, self._pieces, self.edited = "".join(out), pieces, True
        self._starts = [p[0] for p in pieces]

    def _covering(self, start: int, end: int) -> list[tuple[int, int, int, int, bool]]:
        if start >= end:
            return []
        first = max(bisect_right(self._starts, start) - 1, 0)
        last = bisect_right(self._starts, end - 1)
        return self._pieces[first:last]

    def source(self, start: int, end: int) -> tuple[int, int, bool]:
        """Source span, and whether an edit lies in it."""
        begin, stop = self._source(start, end)
        return begin, stop, stop - begin != end - start or any(p[4] for p in self._covering(start, end))


def find(text: str | None) -> list[tuple[Span, bool]]:
    """All spans of a text by kind, start and end, each with whether it is a base span."""
    if not text:
        return []
    base = detect(text)
    spans = dict.fromkeys(base, True)
    rewritten = Rewritten(text)
    if rewritten.edited:
        for kind, start, end in detect(rewritten.text):
            begin, stop, edited = rewritten.source(start, end)
            if edited and not any(b.kind == kind and b.start <= begin and stop <= b.end for b in base):
                spans.setdefault(Span(kind, begin, stop), False)
    return sorted(spans.items())


# ---- on tables -----------------------------------------------------------------

_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (kind, start, end, base) of every document."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [
                [{"kind": KINDS[s.kind], "start": s.start, "end": s.end, "base": base} for s, base in find(text)]
                for text in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _SPANS)], names=["doc_id", "spans"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(found, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint,base:boolean>>")


def _of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def digests(found: DataFrame) -> DataFrame:
    """Counts of base spans by kind, a hash over the base spans, and all spans as text."""
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(F.filter(base, _of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(
        "doc_id", *counts,
        F.sha2(F.array_join(F.transform(base, text), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", text), ",").alias("spans"),
    )
