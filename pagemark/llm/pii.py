"""Personal data with offsets: plain patterns, and disguised forms found after normalisation.

The base patterns run on the text itself. For disguises, a chain of transducers rewrites the
text (homoglyphs, full-width forms and invisible characters; spelled digits; at and dot
disguises) and keeps, for every output character, the source characters that it came from. The
same detectors run on the output, and their spans are mapped back to the source.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_place, docs_of, fields, map_texts, pick

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, number of the kind, end

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def _emails(text: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def _ips(text: str) -> list[tuple[int, int]]:
    # The value is compared by its length first: a run of digits may be very long.
    ok = lambda p: len(p := p.lstrip("0")) <= 3 and int(p or "0") <= 255
    out, at = [], 0
    while m := _DOTTED.search(text, at):
        # A match takes whole runs of digits, so a dotted chain falls into groups of four runs.
        runs, start = m[0].split("."), m.start()
        for k in range(0, len(runs) - 3, 4):
            end = start + sum(map(len, runs[k : k + 4])) + 3
            if all(map(ok, runs[k : k + 4])):
                out.append((start, end))
            start = end + 1
        at = m.end()
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            d = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(d) <= 19 and luhn(d):
                out.append(m.span())
    return out


def _phones(text: str) -> list[tuple[int, int]]:
    if "+" not in text:
        return []
    return [m.span() for m in _PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15]


_DETECTORS: tuple[Callable[[str], list[tuple[int, int]]], ...] = (_emails, _ips, _cards, _phones)


def base_spans(text: str) -> list[Span]:
    """All matches of the plain patterns, by start and then kind."""
    found = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        found += [(s, k, e) for k in (1, 2, 3) for s, e in _DETECTORS[k](text)]
    return sorted(found)


# -- transducers ------------------------------------------------------------------------------

# Letters of other scripts that look like ASCII letters.
_LOOKALIKES = (
    ("абвгеёкмнорстухусіјѕԁһԛԝАВЕЅІЈКМНОРСТУХ", "a6breekmhopctyxycijsdhqwABESIJKMHOPCTYX"),
    ("αεικνορτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeikvoptuxABEZHIKMNOPTYX"),
    ("ıɡɑℓ", "igal"),
    ("․。．｡", "...."),
    ("＠﹫", "@@"),
    ("‐‑‒–−－", "------"),
    ("    　", "     "),
    ("＋﹢", "++"),
    ("（）［］｛｝＜＞", "()[]{}<>"),
)
#: Characters without a shape, dropped.
_INVISIBLE = "­​‌‍⁠﻿"


def _glyphs() -> dict[str, str]:
    for odd, plain in _LOOKALIKES:
        if len(odd) != len(plain) or not plain.isascii() or any(map(str.isascii, odd)):
            raise ValueError(f"lookalikes and their letters do not match: {odd} {plain}")
    table = {a: b for odd, plain in _LOOKALIKES for a, b in zip(odd, plain)}
    for base, first, n in ((0xFF10, "0", 10), (0xFF21, "A", 26), (0xFF41, "a", 26)):
        table |= {chr(base + k): chr(ord(first) + k) for k in range(n)}
    # Mathematical letters come in thirteen styles of 52, digits in five of 10.
    for style in range(13):
        table |= {chr(0x1D400 + 52 * style + k): chr((65 if k < 26 else 71) + k) for k in range(52)}
    for style in range(5):
        table |= {chr(0x1D7CE + 10 * style + k): chr(48 + k) for k in range(10)}
    for base in (0x0660, 0x06F0, 0x0966):  # Arabic-Indic, Persian and Devanagari digits
        table |= {chr(base + k): chr(48 + k) for k in range(10)}
    return table | dict.fromkeys(_INVISIBLE, "")


GLYPHS = _glyphs()
_GLYPH = re.compile("[" + "".join(map(re.escape, GLYPHS)) + "]")

# Names of the digits in English, German, French and Spanish.
_DIGIT_WORDS = (
    "zero one two three four five six seven eight nine",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
)
DIGIT_WORDS = {w: str(d) for names in _DIGIT_WORDS for d, w in enumerate(names.split())} | {"oh": "0"}
_NAMES = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
#: Names of digits and groups of figures in a row, with "plus" before them perhaps.
_ITEM = rf"(?:{_NAMES}|[0-9]++)(?![^\W_])"
_SPELLED = re.compile(rf"(?<![^\W_])(?:plus[\s-]++)?{_ITEM}(?:[\s,.-]++{_ITEM})*+", re.IGNORECASE)
_SPELLED_PART = re.compile(rf"(?<![^\W_])(plus|{_NAMES}|[0-9]+)(?![^\W_])([\s,.-]*)", re.IGNORECASE)
_WORD = re.compile(r"[^\W_]+")
_LETTERS = re.compile("[a-z]+")
_FEW_NAMES = re.compile(rf"(?<![^\W_])(?:{_NAMES})(?![^\W_])", re.IGNORECASE)

# Words for "at" and "dot" that disguises use.
_AT = "at|arroba|arobase"
_DOT = "dot|punkt|point|punto"
_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
_DOT_SIGN = rf"\s*+{_OPEN}\s*+(?:{_DOT}|\.)\s*+{_CLOSE}\s*+"
_CONNECT = rf"\.|{_DOT_SIGN}|\s++(?:{_DOT})\s++"
#: Where an address may have its at: in brackets, as a word between spaces, or plainly.
_SIGN = re.compile(rf"{_OPEN}\s*+(?:{_AT}|@)\s*+{_CLOSE}|(?<=\s)(?:{_AT})(?=\s)|@", re.IGNORECASE)
_DOT_HERE = re.compile(_CONNECT, re.IGNORECASE)
_HOST = re.compile(r"[A-Za-z0-9-]++")
_ATOM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_%+-")
_SPREAD_IP = re.compile(rf"(?<![0-9])[0-9]{{1,3}}+({_CONNECT})[0-9]{{1,3}}+({_CONNECT})[0-9]{{1,3}}+({_CONNECT})[0-9]{{1,3}}+(?![0-9])", re.IGNORECASE)
_DOT_WORDS = frozenset(_DOT.split("|"))


class Traced:
    """A text with, for each character, the range of source characters that it stands for."""

    def __init__(self, text: str, starts: list[int] | None = None, ends: list[int] | None = None):
        self.text = text
        self.starts = starts if starts is not None else list(range(len(text)))
        self.ends = ends if ends is not None else list(range(1, len(text) + 1))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Traced:
        """Replace ranges (ascending, apart); a replacement's characters share its source range."""
        if not edits:
            return self
        text, starts, ends, at = [], [], [], 0
        for a, b, new in edits:
            text += [self.text[at:a], new]
            starts += self.starts[at:a]
            ends += self.ends[at:a]
            if new:
                starts += [self.starts[a]] * len(new)
                ends += [self.ends[b - 1]] * len(new)
            at = b
        text.append(self.text[at:])
        starts += self.starts[at:]
        ends += self.ends[at:]
        return Traced("".join(text), starts, ends)

    def source(self, a: int, b: int) -> tuple[int, int]:
        return self.starts[a], self.ends[b - 1]


def plain_glyphs(t: Traced) -> Traced:
    return t.rewrite([(m.start(), m.end(), GLYPHS[m[0]]) for m in _GLYPH.finditer(t.text)])


def written_digits(t: Traced) -> Traced:
    edits = []
    for run in _SPELLED.finditer(t.text):
        if not _FEW_NAMES.search(run[0]):
            continue
        parts = list(_SPELLED_PART.finditer(t.text, run.start(), run.end()))
        for k, p in enumerate(parts):
            word = p[1].lower()
            edits.append((p.start(1), p.end(1), "+" if word == "plus" else DIGIT_WORDS.get(word, word)))
            # Only the gap after "plus" and gaps of several characters would break a number.
            if p[2] and k + 1 < len(parts) and (word == "plus" or len(p[2]) > 1 or p[2] not in " -"):
                edits.append((p.start(2), p.end(2), "" if word == "plus" else " "))
    return t.rewrite(edits)


def _back(text: str, at: int, least: int, good: Callable[[str], bool]) -> int:
    """The start of the run of characters that are ``good`` and end at ``at``."""
    while at > least and good(text[at - 1]):
        at -= 1
    return at


def _dot_before(text: str, at: int, least: int) -> int | None:
    """The start of a dot, plain or disguised, that ends at ``at``."""
    if at > least and text[at - 1] == ".":
        return at - 1
    end = _back(text, at, least, str.isspace)
    if end > least and text[end - 1] in "])}>":
        inner = _back(text, end - 1, least, str.isspace)
        start = _back(text, inner, least, lambda c: c.isalpha() or c == ".")
        if text[start:inner].lower() not in _DOT_WORDS and text[start:inner] != ".":
            return None
        start = _back(text, start, least, str.isspace)
        return _back(text, start - 1, least, str.isspace) if start > least and text[start - 1] in "[({<" else None
    start = _back(text, end, least, str.isalpha)
    if end < at and text[start:end].lower() in _DOT_WORDS and start > least and text[start - 1].isspace():
        return _back(text, start, least, str.isspace)
    return None


def _addresses(text: str) -> list[tuple[int, int, list[tuple[int, int, str]]]]:
    """(start, end, edits) of disguised addresses.

    Each at is the start of a walk to both sides: a bracketed one needs some dot behind it, a
    word or a plain one a disguised dot. Every part of the text is walked a bounded number of
    times.
    """
    out, done = [], 0
    for m in _SIGN.finditer(text):
        if m.start() < done:
            continue
        bracketed = len(m[0]) > 1 and m[0][0] in "[({<"
        left = _back(text, m.start(), done, str.isspace)
        start = _back(text, left, done, _ATOM.__contains__)
        if start == left:
            continue
        right = m.end()
        while right < len(text) and text[right].isspace():
            right += 1
        host = _HOST.match(text, right)
        edits, dots, spelled, end = [(left, right, "@")], 0, bracketed, right
        while host:
            end = host.end()
            dot = _DOT_HERE.match(text, end)
            host = _HOST.match(text, dot.end()) if dot else None
            if host:
                dots += 1
                if len(dot[0]) > 1:
                    spelled = True
                    edits.append((dot.start(), dot.end(), "."))
        if not dots or not spelled:
            continue
        while (dot_at := _dot_before(text, start, done)) is not None:
            further = _back(text, dot_at, done, _ATOM.__contains__)
            if further == dot_at:
                break
            if start - dot_at > 1:
                edits.append((dot_at, start, "."))
            start = further
        out.append((start, end, sorted(edits)))
        done = end
    return out


def signs(t: Traced) -> Traced:
    found = _addresses(t.text)
    starts, ends = [x[0] for x in found], [x[1] for x in found]
    edits = [e for x in found for e in x[2]]
    for m in _SPREAD_IP.finditer(t.text):
        k = bisect_right(ends, m.start())
        if k == len(starts) or starts[k] >= m.end():
            edits += [(a, b, ".") for a, b in map(m.span, (1, 2, 3)) if b - a > 1]
    return t.rewrite(sorted(edits))


def _beyond_latin(text: str) -> bool:
    """Whether the text has a character that a glyph table could hold."""
    if text.isascii():
        return False
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return True
    return "\xad" in text


def disguised_spans(text: str) -> list[Span]:
    """Spans that only the normalised text shows, in source offsets."""
    t = plain_glyphs(Traced(text)) if _beyond_latin(text) else None
    plain = t.text if t else text
    named = not DIGIT_WORDS.keys().isdisjoint(_WORD.findall(plain.lower()))
    words = _LETTERS.findall(plain.lower())
    signed = not _DOT_WORDS.isdisjoint(words) or any(c in plain for c in "[({<")
    if not (t or named or signed):
        return []
    t = t or Traced(text)
    # Written digits make a form of their own: their names may as well be parts of an address.
    forms = [t, written_digits(t)] if named else [t]
    if signed:
        forms = [signs(form) for form in forms]
    found = set()
    for form in forms:
        if form.text == text:
            continue
        for k, detect in enumerate(_DETECTORS):
            for a, b in detect(form.text):
                s, e = form.source(a, b)
                if text[s:e] != form.text[a:b]:  # plain ones are the base's
                    found.add((k, s, -e))
    # Of one kind, a span within another form's span is a part of it.
    out: list[Span] = []
    for k, s, e in sorted(found):
        if not out or out[-1][1] != k or out[-1][2] < -e:
            out.append((s, k, -e))
    return out


def find_spans(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), each by start and then kind.

    A disguised span is added only where it meets no base span of its kind.
    """
    base = base_spans(text)
    starts, ends = ([[x[i] for x in base if x[1] == kind] for kind in range(len(KINDS))] for i in (0, 2))
    more = []
    for s, k, e in disguised_spans(text):
        first = bisect_right(ends[k], s)  # the first base span that ends behind the start
        if first == len(ends[k]) or starts[k][first] >= e:
            more.append((s, k, e))
    return base, sorted(base + more)


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def pii_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, n_disguised, base_sha256, spans), a row per row.

    The four counts are those of the base patterns; n_disguised counts what normalisation adds.
    Null and empty texts have no spans. Null doc_ids and repeated rows pass through; other
    columns are ignored. Offsets are code points, ends exclusive.
    """

    def kernel(texts: list[str]) -> dict[str, list]:
        out: dict[str, list] = {c: [] for c in ("n_email", "n_ip", "n_card", "n_phone", "n_disguised", "base_sha256", "spans")}
        for text in texts:
            base, every = find_spans(text)
            for k, kind in enumerate(KINDS):
                out[f"n_{kind}"].append(sum(x[1] == k for x in base))
            out["n_disguised"].append(len(every) - len(base))
            out["base_sha256"].append(hashlib.sha256(written(base).encode()).hexdigest())
            out["spans"].append(written(every))
        return out

    return map_texts(pick(docs, doc_id="long", text="string"), kernel, fields(n_email="long", n_ip="long", n_card="long", n_phone="long", n_disguised="long", base_sha256="string", spans="string"))


def redact(text: str) -> str:
    """``text`` with every span replaced by its kind in brackets; overlapping spans as one."""
    spans = find_spans(text)[1]
    if not spans:
        return text
    out, at = [], 0
    for s, k, e in spans:
        if s < at:
            if e > at:
                at = e
            continue
        out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = e
    return "".join([*out, text[at:]])


def redact_texts(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` masked and ``n_chars``, if there, brought up to date.

    Null texts stay null, and so does an absent column absent. All rows, repeated ones too, and
    all other columns, of any name, stay as they are; an empty table stays empty.
    """
    placed, at = by_place(docs)
    if "text" not in at:
        return docs
    text, size = at["text"], at.get("n_chars")
    masked = map_texts(placed.withColumn("__pm_null", F.col(text).isNull()), lambda texts: {"__pm_text": [redact(t) for t in texts]}, fields(__pm_text="string"), column=text)
    out = {c: F.col(c) for c in placed.columns}
    out[text] = F.when(~F.col("__pm_null"), F.col("__pm_text"))
    if size:
        out[size] = F.when(F.col("__pm_null"), F.col(size)).otherwise(F.length("__pm_text")).cast(placed.schema[size].dataType)
    return masked.select(*[c.alias(k) for k, c in out.items()]).toDF(*docs.columns)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_spans(docs_of(spark, sf_dir))
