"""Sentence units of texts in many scripts, by semi-Markov dynamic programming.

A text falls into stretches at blank lines. In a stretch, every place where a sentence might end is a candidate; the
best way to cut the stretch into whole spans is found by dynamic programming. A span's score joins its length, the word it
opens with, the word and mark it closes with, and whether quotations and brackets in it are balanced. Texts whose bytes
were read in a wrong encoding are cut where the text they came from would be.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encodings import UTF8_READERS, bytes_of, undo_utf8

# --- Fixed values: words and marks ----------------------------------------------------------------------------------

#: Abbreviations that something always follows: titles, references, units before a number, conjunctions.
NEVER_LAST = frozenset(
    """mr mrs ms dr prof capt st gen col sgt lt rev hon sen gov pres no nos fig figs p pp ch sec vol ed eds vs cf ca approx incl esp viz
    ver hr fr frl nr abb abs bd bzw inkl exkl vgl evtl ggf bspw mio mrd tel str kap aufl env févr janv avr juil sept oct nov déc mme mmes mlle
    mm chap art éd sr sra srta sres dra dña ee pág págs aprox núm cap ej ex av jan feb mar apr jun jul aug dec стр рис ул напр проф см гл тыс млн млрд им г-н г-жа
    акад доц табл пер обл тов гр κα σελ αρ κεφ π.χ δηλ кн डॉ श्री रु पं प्रो""".split()
)
#: Abbreviations that may also close a sentence; then a capital follows.
MAYBE_LAST = frozenset("etc usw co ltd inc corp bros jr uu al др пр проч κ.λπ κλπ κτλ".split())
#: Names of months, before which a number with a point is a day.
MONTHS = frozenset("januar februar märz april mai juni juli august september oktober november dezember jänner".split())

STRONG = set("!?。！？｡।॥።፧։؟۔՜՞;;‼⁇⁈⁉")
OPENERS = {"“": "”", "„": "“”", "«": "»", "‹": "›", "「": "」", "『": "』", "《": "》", "〈": "〉", "（": "）", "(": ")", "[": "]", "{": "}", "【": "】", "‘": "’", "‚": "‘’"}
CLOSERS = set("”»›」』》〉）)]}】’")
QUOTES = set("”»›」』》〉’\"'“‘")
TERM = regex.compile(r"[.!?…。！？｡．।॥።፧։؟۔‼⁇⁈⁉]+|[;;]")
#: Where there is Thai, a space between its letters may end a sentence too.
THAI = regex.compile(r"[\u0e00-\u0e7f]")
TERM_THAI = regex.compile(TERM.pattern + r"|(?<=\p{Thai})\s+(?=\p{Thai})")
BLANK = regex.compile(r"\n[^\S\n]*\n\s*|\r[^\S\r\n]*\r\s*")
CASED = regex.compile(r"[\p{Lu}\p{Lt}\p{Ll}]")
SYLLABIC = regex.compile(r"[\p{Hangul}\p{Han}\p{Hiragana}\p{Katakana}]")
DANDA = regex.compile(r"[\p{Devanagari}\p{Ethiopic}\p{Armenian}]")
DOTTED = regex.compile(r"(?:\p{L}{1,3}\.)+\p{L}{1,3}")
GREEK = regex.compile(r"\p{Greek}")
WORD = regex.compile(r"[^\s\"'“”„«»()\[\]]{1,64}")
LIST_NO = regex.compile(r"\(?\d{1,3}[.)]\s")
#: Words that open a sentence though they begin small: names of files, and an article before a title.
FILE_NAME = regex.compile(r"[\p{Ll}\d_-]+(?:\.[\p{Ll}\d_-]+)*\.\p{Ll}{2,5}\b(?!\.)")
ARTICLE_TITLE = regex.compile(r"(?:le|la|el|die|der|the) (?:Dr|Pr|Prof|Sr|Sra|Mme|Hr|Fr)\b")
NEXT_WORD = regex.compile(r"\p{Lu}\p{L}*(?=[\s,;:!?…’']|\.{2,}|\.(?:\s|$)|$)")

# --- Weights ----------------------------------------------------------------------------------------------------------

NEVER = -9.0
#: Places with so low a score are no candidates.
HOPELESS = -4.5
CLOSE_STRONG, CLOSE_POINT, CLOSE_MAYBE, CLOSE_PAUSE = 3.0, 2.0, -0.5, 0.0
OPEN_CAPITAL, OPEN_UNCASED, OPEN_DIGIT, OPEN_LIST, OPEN_SMALL, OPEN_DASH = 2.0, 1.0, 0.5, 2.5, -5.5, -5.0
AFTER_QUOTE_UNCASED = -5.0
UNBALANCED, NO_WORD, LONG, LONG_AT = -8.0, -9.0, -1 / 150, 350
#: An abbreviation, initial or number has at most so many characters before its point; what is longer is no such word.
WORD_MOST = 64
#: Spans shorter than this are charged if they hold no letter.
WORD_AT = 12


class _Open:
    """Marks that are open, innermost last, with the places of each kind: every step costs the same at any depth."""

    def __init__(self):
        self.marks: list[tuple[str, int]] = []
        self.levels: dict[str, list[int]] = {}

    def push(self, c: str, at: int) -> None:
        self.levels.setdefault(c, []).append(len(self.marks))
        self.marks.append((c, at))

    def has(self, c: str) -> bool:
        return bool(self.levels.get(c))

    def has_other(self, c: str) -> bool:
        return len(self.marks) > len(self.levels.get(c, ()))

    def close(self, c: str) -> int | None:
        """Place of the innermost mark that ``c`` closes; it and all marks within it are taken off."""
        level = max((own[-1] for o in CLOSED_BY[c] if (own := self.levels.get(o))), default=None)
        if level is None:
            return None
        at = self.marks[level][1]
        while len(self.marks) > level:
            self.levels[self.marks.pop()[0]].pop()
        return at


def _pairs(s: str) -> list[tuple[int, int]]:
    """(open, close) places of matched quotations and brackets of any length; marks without a partner bind nothing."""
    open_ = _Open()
    out = []
    for m in _MARKED.finditer(s):
        i, c = m.start(), m.group()
        before, after = s[i - 1 : i], s[i + 1 : i + 2]
        if c == '"' or c == "'":
            opening = (not before or before.isspace() or before in "([{—–-«„“¿¡" or c == '"' and after.isalnum() and not open_.has(c)) and bool(after) and not after.isspace()
            if c == "'" and before.isalnum() and after.isalnum():
                continue
        elif c == "’" and before.isalnum() and after.isalnum():
            continue
        else:
            opening = c in OPENERS and not (c == "“" and open_.has("„")) and not (c == "‘" and open_.has("‚"))
        if opening:
            open_.push(c, i)
        elif (at := open_.close(c)) is not None:
            out.append((at, i))
    return sorted(out)


_MARKED = regex.compile("[" + regex.escape("".join(OPENERS)) + "”»›」』》〉）)\\]}】’\"']")
#: Each mark with those it closes.
CLOSED_BY = {c: tuple(o for o in [*OPENERS, '"', "'"] if c == o or c in OPENERS.get(o, "")) for c in {*OPENERS, *"".join(OPENERS.values()), '"', "'"}}


def _candidates(s: str) -> list[tuple[int, int, float]]:
    """(end of the span, start of the next, score of a cut there) for every place where a sentence may end."""
    pairs = _pairs(s) if _MARKED.search(s) else []
    closing = {b for _, b in pairs}
    opens, closes = [a for a, _ in pairs], sorted(closing)

    def depth(at: int) -> float:
        """Charge for the quotations and brackets that a cut at ``at`` would leave open."""
        return UNBALANCED * (bisect_left(opens, at) - bisect_left(closes, at)) if pairs else 0.0

    n, out, done = len(s), [], 0
    for m in (TERM_THAI if THAI.search(s) else TERM).finditer(s):
        e, mark = m.end(), m.group()
        if m.start() < done:
            continue
        if mark.isspace():
            out.append((m.start(), e, CLOSE_POINT + OPEN_UNCASED + depth(m.start())))
            continue
        if mark in ";;" and not (m.start() and GREEK.match(s[m.start() - 1])):
            continue
        quoted = False
        while e < n:  # a sentence owns its closing marks, quotes and brackets
            c = s[e]
            if c in CLOSERS or e in closing or c in ".!?…。！？" and s[e - 1] in QUOTES:
                quoted = quoted or c in QUOTES
                e += 1
            elif c in "   \n" and e + 1 < n and s[e + 1] in "»›" and (e + 1) in closing:
                quoted = True
                e += 2
            else:
                break
        done = e
        nxt = e
        while nxt < n and s[nxt].isspace():
            nxt += 1
        if nxt >= n:
            continue
        if nxt > e and not quoted and s[nxt].isupper():  # by far the most usual case, without detours
            if mark in "!?":
                out.append((e, nxt, CLOSE_STRONG + OPEN_CAPITAL + depth(e)))
                continue
            at = m.start()
            low = max(0, at - WORD_MOST - 1)
            b = max(s.rfind(" ", low, at), s.rfind("\n", low, at), low - 1) + 1
            token = s[b:at]
            if mark == "." and at - b > 2 and token.isalpha() and token.islower() and token not in NEVER_LAST and token not in MAYBE_LAST and not DANDA.match(token):
                out.append((e, nxt, CLOSE_POINT + OPEN_CAPITAL + depth(e)))
                continue
        out.append((e, nxt, _closing(s, m.start(), mark, nxt, nxt > e, quoted) + depth(e)))
    return [x for x in out if x[2] > HOPELESS]


def _opening(s: str, at: int) -> tuple[str, str, int]:
    """Kind of the word that opens at ``at``: capital, small, uncased, digit, list, dash or other; the word; its place."""
    n = len(s)
    if s[at] in "—–-" and at + 1 < n and s[at + 1].isspace():
        return "dash", s[at], at
    i = at
    while i < n and (s[i] in OPENERS or s[i] in "\"'“«¿¡*•·" or i > at and s[i] in " \u00a0\u202f"):
        i += 1
    if i >= n:
        return "other", "", at
    c = s[i]
    m = WORD.match(s, i)
    word = m.group() if m else c
    if c.isdigit():
        return ("list" if LIST_NO.match(s, i) and (at == 0 or "\n" in s[max(0, at - 3) : at]) else "digit"), word, i
    if c.isalpha():
        if c.isupper() or c.istitle():
            return "capital", word, i
        if c.islower():
            if any(x.isupper() for x in word[1:3]):
                return "capital", word, i
            return ("file" if FILE_NAME.match(s, i) or ARTICLE_TITLE.match(s, i) else "small"), word, i
        return "uncased", word, i
    return "other", word, i


def _closing(s: str, at: int, mark: str, nxt: int, gap: bool, quoted: bool) -> float:
    kind, word, _ = _opening(s, nxt)
    b = at
    while b > 0 and at - b <= WORD_MOST and not s[b - 1].isspace():
        b -= 1
    token = s[b:at].lstrip("\"'“„«‹‘(（[{「『《¿¡")
    last = token[-1:] if token else ""
    strong = any(c in STRONG for c in mark)
    uncased_before = bool(last) and last.isalpha() and not CASED.match(last)
    if not gap:
        if strong and mark[-1] not in "!?":
            pass
        elif strong and uncased_before and kind in ("uncased", "digit"):
            pass
        elif kind == "capital" and len(token) > 1 and token.isalpha() and token[1:].islower() and NEXT_WORD.match(s, nxt):
            return (CLOSE_STRONG if strong else CLOSE_POINT) + OPEN_CAPITAL - 1.0 if token.casefold() not in NEVER_LAST else NEVER
        elif mark[0] in "…。" and uncased_before:
            pass
        else:
            return NEVER
    if s[nxt] in ",;:)]}»”、，；：" and kind == "other":
        return NEVER
    opening = {"capital": OPEN_CAPITAL, "uncased": OPEN_UNCASED, "digit": OPEN_DIGIT, "list": OPEN_LIST, "dash": OPEN_DASH, "file": OPEN_UNCASED, "other": 0.0}.get(kind)
    if kind == "small":
        opening = OPEN_UNCASED if mark[-1] in "։።।。！？" or (uncased_before and not quoted) else OPEN_SMALL
    if quoted and kind in ("uncased", "digit") and (uncased_before or kind == "uncased"):
        opening = AFTER_QUOTE_UNCASED
    if strong:
        return CLOSE_STRONG + opening
    if mark not in (".", "．"):  # a pause, unless something new clearly begins
        return CLOSE_PAUSE + (opening if kind in ("capital", "list") and gap else AFTER_QUOTE_UNCASED)
    return _point(s, b, token, last, kind, word) + opening


def _word_before(s: str, b: int) -> str:
    """The word that ends before ``b``; of a longer one, its last characters."""
    while b > 0 and s[b - 1].isspace():
        b -= 1
    a = b
    while a > 0 and b - a <= WORD_MOST and not s[a - 1].isspace():
        a -= 1
    return s[a:b]


def _point(s: str, b: int, token: str, last: str, kind: str, word: str) -> float:
    """How far a single point after ``token`` closes a sentence."""
    low = token.casefold()
    if not token:
        return CLOSE_POINT
    if low in NEVER_LAST or low.rsplit("-", 1)[-1] in NEVER_LAST and "-" in low and len(low) < 6:
        return NEVER
    if low in MAYBE_LAST:
        return CLOSE_MAYBE
    if DANDA.match(last):
        return NEVER
    if len(token) > WORD_MOST:
        return CLOSE_POINT
    if "." in token and not any(c.isdigit() for c in token):
        if "-" in token:
            return NEVER if all(len(p) <= 2 for p in regex.split(r"[.-]+", token)) else CLOSE_POINT
        if DOTTED.fullmatch(token):
            return CLOSE_MAYBE if kind in ("capital", "file") else NEVER
        return CLOSE_POINT
    if len(token) == 1 and token.isalpha():
        if SYLLABIC.match(token):
            return CLOSE_POINT
        if token.isupper():
            return NEVER
        before = _word_before(s, b)
        if before[-1:].isdigit() or regex.fullmatch(r"\p{L}\.", before):
            return CLOSE_MAYBE if kind in ("capital", "list") else NEVER
        return NEVER
    if token.isdigit():
        if word.casefold().strip(".,") in MONTHS:
            return NEVER
        before = _word_before(s, b)
        # A short number after a finished sentence is a list number; after "Jan." or "No." it is not.
        stem = before[:-1].casefold().lstrip("(")
        if len(token) <= 2 and before[-1:] in (".", "!", "?", "…") and len(stem) > 1 and stem not in NEVER_LAST:
            return NEVER
    if len(token) == 2 and token.isupper() and regex.fullmatch(r"\p{Lu}{1,3}\..*", word):
        return NEVER
    return CLOSE_POINT


def _cut(s: str) -> tuple[tuple[int, int], ...]:
    """Spans (start, end) of one stretch, which begins and ends with a character that is not white space.

    Every beginning is weighed against every end. The charge for length is flat up to LONG_AT and linear beyond, so the
    best of all far beginnings is a running maximum and the best of the others a maximum over a sliding window; only
    beginnings so near that the span may hold no letter are tried one by one.
    """
    cands = _candidates(s)
    if not cands:
        return ((0, len(s)),)
    starts = [0, *[c[1] for c in cands]]
    ends = [*[c[0] for c in cands], len(s)]
    gains = [*[c[2] for c in cands], 0.0]
    best, back = [0.0], [0]
    window: deque[int] = deque()  # beginnings neither near nor far, of falling score
    far, far_at = float("-inf"), 0  # best score of a far beginning, as if its span were of no length
    flat = long = 0  # beginnings from here on are near, or not far
    for j, e in enumerate(ends, 1):
        while flat < j and e - starts[flat] >= WORD_AT:
            while window and best[window[-1]] <= best[flat]:
                window.pop()
            window.append(flat)
            flat += 1
        while long < flat and e - starts[long] > LONG_AT:
            if best[long] - starts[long] * LONG >= far:
                far, far_at = best[long] - starts[long] * LONG, long
            if window and window[0] == long:
                window.popleft()
            long += 1
        top, at = float("-inf"), 0
        for i in range(j - 1, flat - 1, -1):
            score = best[i] if any(c.isalpha() for c in s[starts[i] : e]) else best[i] + NO_WORD
            if score > top:
                top, at = score, i
        if window and best[window[0]] > top:
            top, at = best[window[0]], window[0]
        if far + (e - LONG_AT) * LONG > top:
            top, at = far + (e - LONG_AT) * LONG, far_at
        best.append(top + gains[j - 1])
        back.append(at)
    out = []
    j = len(ends)
    while j:
        i = back[j]
        out.append((starts[i], ends[j - 1]))
        j = i
    return tuple(reversed(out))


_remembered = lru_cache(maxsize=20_000)(_cut)


# --- Texts read in a wrong encoding -----------------------------------------------------------------------------------


@lru_cache(maxsize=None)
def _traces(reader: str) -> regex.Pattern:
    """A UTF-8 sequence as ``reader`` shows it."""
    own = bytes_of(reader)
    cls = lambda lo, hi: "[" + regex.escape("".join(c for c, b in own.items() if lo <= b <= hi)) + "]"
    cont = cls(0x80, 0xBF)
    return regex.compile(f"{cls(0xC2, 0xDF)}{cont}|{cls(0xE0, 0xEF)}{cont}{{2}}|{cls(0xF0, 0xF4)}{cont}{{3}}")


@lru_cache(maxsize=None)
def _sides(reader: str) -> tuple[frozenset[str], frozenset[str], frozenset[str]]:
    """Characters that ``reader`` shows for leads, for continuations, and for any byte beyond ASCII."""
    own = bytes_of(reader)
    return frozenset(c for c, b in own.items() if 0xC2 <= b <= 0xF4), frozenset(c for c, b in own.items() if 0x80 <= b <= 0xBF), frozenset(own)


#: One-byte encodings of other alphabets that are often shown in Western letters, with each alphabet's commonest letters.
ALPHABETS = (("cp1251", "оеаинтсрвлк"), ("koi8_r", "оеаинтсрвлк"), ("cp1253", "αοιετσνηυρκ"), ("iso8859_7", "αοιετσνηυρκ"))
WESTERN_WORD = regex.compile(r"[À-ÿ¸¨³¢´ºª]{3,}")


@lru_cache(maxsize=None)
def _western(written: str) -> dict[int, str]:
    own = bytes_of("cp1252")
    out = {}
    for c, b in own.items():
        try:
            out[ord(c)] = bytes([b]).decode(written)
        except UnicodeDecodeError:
            pass
    return out


def _other_alphabet(text: str) -> str | None:
    """A text in Western letters that stand for another alphabet, letter for letter."""
    words = WESTERN_WORD.findall(text)
    if sum(map(len, words)) * 3 < len(text):
        return None
    best: tuple[float, str] | None = None
    for written, common in ALPHABETS:
        shown = " ".join(words).translate(_western(written)).casefold()
        share = sum(shown.count(c) for c in common) / max(1, len(shown) - len(words) + 1)
        if share > 0.45 and (best is None or share > best[0]):
            best = (share, written)
    return text.translate(_western(best[1])) if best else None


def readable(text: str) -> tuple[str, list[tuple[int, int]] | None]:
    """The text before a wrong decoding, with the given places of each character; as it is, with None, if there was none."""
    if text.isascii():
        return text, None
    best: tuple[float, str] | None = None
    chars = {c for c in set(text) if c > "\x7f"}
    wide = 0
    for r in UTF8_READERS:
        leads, conts, own = _sides(r)
        if chars.isdisjoint(leads) or chars.isdisjoint(conts) or 2 * len(chars & own) < len(chars):
            continue
        hits = sum(m.end() - m.start() for m in _traces(r).finditer(text))
        if hits:
            wide = wide or sum(map("\x7f".__lt__, text))
            # Chance sequences are few among the text's other characters; a wrong decoding leaves hardly any others.
            if hits / wide >= 0.7 and (best is None or hits / wide > best[0]):
                best = (hits / wide, r)
    if best is None:
        other = _other_alphabet(text)
        return (text, None) if other is None else (other, [(i, i + 1) for i in range(len(text))])
    got = undo_utf8(text, best[1])
    if got is None:
        return text, None
    inner, spans = readable(got[0])
    if spans is None:
        return got
    return inner, [(got[1][a][0], got[1][b - 1][1]) for a, b in spans]


def units(text: str) -> list[tuple[int, int]]:
    """(start, end) of every sentence unit of a text, in code points; none for a blank text."""
    view, spans = readable(text)
    out = []
    at = 0
    for m in [*BLANK.finditer(view), None]:
        a, b = at, m.start() if m else len(view)
        at = m.end() if m else b
        s = view[a:b]
        left = len(s) - len(s.lstrip())
        s = s.strip()
        if s:
            out += [(a + left + x, a + left + y) for x, y in (_remembered(s) if len(s) < 2000 else _cut(s))]
    if spans is None:
        return out
    return [(spans[a][0], spans[b - 1][1]) for a, b in out]


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys, starts, ends = [], [], []
        for i, text in enumerate(b.column(1).to_pylist()):
            for a, e in units(text):
                keys.append(i)
                starts.append(a)
                ends.append(e)
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.array(keys, np.int64))), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["key", "start_at", "end_at"])


def sentence_units(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, start_at, end_at) of every sentence unit of every text that is not null or blank.

    Offsets count code points from 0, end exclusive, and never include white space at either end. Texts of any length
    are taken whole, and quotations bind at any length; the work grows in proportion to the text. Repeated rows come out each; null keys stay null. An empty
    table gives an empty result. Other columns are not read.
    """
    docs = documents.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.col("text").rlike(r"(?U)\S"))
    kind = docs.schema["key"].dataType.simpleString()
    return docs.mapInArrow(_units, f"key {kind}, start_at int, end_at int").withColumnRenamed("key", key)
