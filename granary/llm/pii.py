"""Personal data: detection over the text as written, and over a normalised copy whose spans map back to it.

A first pass finds emails, IP addresses, card and phone numbers in the text. Three transducers then rewrite disguises, one after
the other: look-alike letters and invisible characters; "at" and "dot" in words or brackets, and signs set off by white space; digits
spelled as words. Each remembers where its rewritten pieces came from; what is detected only in the last one's output is mapped back
through all of them to source characters and added. All take time in proportion to the text, whatever is in it.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
#: A run of digits that fails from its start fails from every later digit, so only starts of runs are tried.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(t: str) -> list[Span]:
    """Leftmost non-overlapping matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, found from each @ in
    linear time: the local part is all of the run before it that no earlier match holds."""
    out, free, k = [], 0, t.find("@")
    while k >= 0:
        start = k
        while start > free and t[start - 1] in LOCAL:
            start -= 1
        if start < k and (m := DOMAIN.match(t, k + 1)):
            out.append((start, m.end()))
            free = m.end()
        else:
            free = k + 1
        k = t.find("@", free)
    return out


def detect(t: str) -> dict[str, list[Span]]:
    """Spans of each kind in t, by start."""
    found: dict[str, list[Span]] = {"email": emails(t) if "@" in t else [], "ip": [], "card": [], "phone": []}
    if DIGIT.search(t):
        if "." in t:
            found["ip"] = [m.span() for m in IP.finditer(t) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(t):
            if m.end() - m.start() >= 13:
                d = NOT_DIGIT.sub("", m[0])
                if 13 <= len(d) <= 19 and luhn(d):
                    found["card"].append(m.span())
        if "+" in t:
            found["phone"] = [m.span() for m in PHONE.finditer(t) if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return found


#: Look-alikes of ASCII characters. Cyrillic and Greek letters, then ranges of digits and full-width forms.
ALIKE = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "г": "r", "п": "n",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "τ": "t", "υ": "u", "χ": "x", "ε": "e", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X",
    "․": ".", "。": ".", "｡": ".", "﹒": ".", "﹫": "@", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "﹢": "+", " ": " ", " ": " ", " ": " ", "　": " ",
}
#: Zeros of the decimal digits of other scripts, and of styled digits.
ZEROS = (0x660, 0x6F0, 0x966, 0x9E6, 0xFF10, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6)
TABLE = {ord(k): v for k, v in ALIKE.items()} | {z + d: str(d) for z in ZEROS for d in range(10)} | {0xFF01 + k: chr(0x21 + k) for k in range(94)}
FOLDED = re.compile("[" + "".join(re.escape(chr(c)) for c in sorted(TABLE)) + "]")
INVISIBLE = "​‌‍⁠﻿­"
#: Spelled digits in the corpus's languages, and words for the signs.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_digit = "(?:" + "|".join(sorted(SPELLED, key=len, reverse=True)) + ")"
_dot = "(?:dot|punkt|point|punto)"
GONE = re.compile(f"[{INVISIBLE}]+")
#: Signs in brackets, words for them between white space, and the sign @. White space before is looked for from the match.
SIGN = re.compile(rf"[\[({{<]\s*(?:(?P<at>at|ät|arroba|arobase|@)|(?P<dot>{_dot}|\.))\s*[\])}}>]|(?<=\s)(?:(?P<wat>at|arroba|arobase)|(?P<wdot>{_dot}))(?=\s)|(?P<bare>@)", re.I)
#: What follows a word for @: a name, and a sign for its dot.
DOTTED = re.compile(rf"\s+[A-Za-z0-9-]++(?:\s*[\[({{<]\s*(?:{_dot}|\.)\s*[\])}}>]\s*|\s+{_dot}\s+|\.)[A-Za-z0-9-]", re.I)
DIGITS = re.compile(rf"(?<!\w)(?:plus[\s-]++)?(?:{_digit}[\s,-]++){{3,}}{_digit}(?!\w)", re.I)
BLANKS = re.compile(r"\s*")
NAME = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
#: Texts without any of these have nothing to rewrite.
HINT = re.compile(rf"[{INVISIBLE}]|[\[({{<]\s*(?:at|ät|arroba|arobase|@|{_dot}|\.)\s*[\])}}>]|@\s|\s(?:{_dot}|at|arroba|arobase)\s|(?<!\w)(?:{_digit}[\s,-]++){{3}}", re.I)
WORD = re.compile(r"\w+")


class Rewritten:
    """A text with pieces replaced: for each piece the start here, the start in the source, and the end there of one that was
    replaced (-1: copied, character for character)."""

    def __init__(self, source: str, edits: list[tuple[int, int, str]]):
        """edits: start, end and replacement, ascending."""
        out, self.here, self.there, self.ends = [], [0], [0], [-1]
        n = at = 0
        for s, e, new in edits:
            out += [source[at:s], new]
            n += s - at
            self.here += [n, n + len(new)]
            self.there += [s, e]
            self.ends += [e, -1]
            n += len(new)
            at = e
        self.text = "".join([*out, source[at:]])

    def _place(self, k: int) -> tuple[int, int]:
        """Where the character at k stands in the source: first and end."""
        i = bisect_right(self.here, k) - 1
        if self.ends[i] >= 0:
            return self.there[i], self.ends[i]
        at = self.there[i] + k - self.here[i]
        return at, at + 1

    def back(self, s: int, e: int) -> Span:
        return self._place(s)[0], self._place(e - 1)[1]


def _before(t: str, k: int, stop: int) -> int:
    """Where the white space that ends at k begins, not before stop."""
    while k > stop and t[k - 1].isspace():
        k -= 1
    return k


def signs(t: str) -> list[tuple[int, int, str]]:
    """Rewrite signs written as words or in brackets, and @ followed by white space, with the white space around them."""
    out, free = [], 0
    for m in SIGN.finditer(t):
        s, e = m.span()
        if s < free:
            continue
        left, right = _before(t, s, free), BLANKS.match(t, e).end()
        named = left > 0 and t[left - 1] in NAME and right < len(t)
        if m["at"] is not None:
            out.append((left, right, "@"))
        elif m["dot"] is not None:
            out.append((left, right, "."))
        elif m["wat"] is not None:
            if not named or not DOTTED.match(t, e):
                continue
            out.append((left, right, "@"))
        elif m["wdot"] is not None:
            if not named or t[right] not in NAME:
                continue
            out.append((left, right, "."))
        else:
            # A name before it and white space after; white space before it alone may be a mention of someone.
            if right == e or not named or t[right] not in NAME:
                continue
            out.append((left, right, "@"))
        free = right
    return out


def digits(t: str) -> list[tuple[int, int, str]]:
    """Rewrite four and more spelled digits in a row."""
    return [(*m.span(), "".join("+" if w == "plus" else SPELLED[w] for w in WORD.findall(m[0].lower()))) for m in DIGITS.finditer(t)]


def normalise(t: str) -> list[Rewritten]:
    """The transducers' outputs, the last the normalised text; none if nothing changes."""
    folded = t if t.isascii() or not FOLDED.search(t) else t.translate(TABLE)
    if folded is t and not HINT.search(t):
        return []
    chain = [Rewritten(folded, [(*m.span(), "") for m in GONE.finditer(folded)])]
    for rule in (signs, digits):
        if edits := rule(chain[-1].text):
            chain.append(Rewritten(chain[-1].text, edits))
    return chain


def added(t: str, base: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """Spans that only the normalised text shows, in source characters: those that reach beyond the base spans of their kind. One
    may hold a base span, of which only a part was written plainly."""
    chain = normalise(t)
    if not chain:
        return {}
    more: dict[str, list[Span]] = {}
    for kind, spans in detect(chain[-1].text).items():
        plain = base[kind]  # ascending, without overlap
        for a, b in spans:
            for r in reversed(chain):
                a, b = r.back(a, b)
            k = bisect_right(plain, (a, len(t) + 1)) - 1
            if k < 0 or b > plain[k][1]:
                more.setdefault(kind, []).append((a, b))
    return more


def joined(found: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in KINDS for s, e in sorted(found.get(k, ())))


def scan(docs: DataFrame) -> DataFrame:
    """One row a document: how many spans of each kind the text as written has, the SHA-256 of their list, the list of
    all spans with those of the normalised text, and how many those are.

    Null texts are empty; repeated rows give repeated rows; an empty table an empty result; very long texts are read whole, in
    linear time; of matches that begin together the longest counts; columns beside doc_id and text are not read. Each row is read
    alone, so there is no shuffle.
    """

    def run(batches):
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                t = t or ""
                base = detect(t)
                more = added(t, base)
                both = {k: base[k] + more.get(k, []) for k in KINDS} if more else base
                said = joined(base)
                rows.append((*(len(base[k]) for k in KINDS), hashlib.sha256(said.encode()).hexdigest(), joined(both) if more else said, sum(map(len, more.values()))))
            cols = list(zip(*rows)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string()), pa.array(cols[5], pa.string()), pa.array(cols[6], pa.int64())],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"],
            )

    src = docs.select("doc_id", "text")
    return src.mapInArrow(run, f"doc_id {dict(src.dtypes)['doc_id']}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
