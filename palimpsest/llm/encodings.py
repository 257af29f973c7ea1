"""Encoding chains: ways in which text written in one encoding came to be read in another, and their undoing."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

import regex

#: Encodings in which garbled UTF-8 shows up, each with the single bytes its characters stand for.
UTF8_READERS = ("cp1252", "cp437", "cp850", "mac_roman", "cp1250", "cp1251", "cp866", "koi8_r", "cp1253", "cp1254", "cp852", "cp1257")
#: Encodings of more than one byte that readers may have assumed for UTF-8.
WIDE_READERS = ("gbk", "shift_jis", "cp949")
#: (written, read) where neither is UTF-8.
LEGACY = (
    ("cp1251", "cp1252"), ("koi8_r", "cp1252"), ("cp866", "cp1252"), ("cp1253", "cp1252"), ("cp1250", "cp1252"), ("cp1254", "cp1252"), ("cp1257", "cp1252"), ("cp852", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("mac_roman", "cp1252"),
    ("koi8_r", "cp1251"), ("cp866", "cp1251"), ("cp1253", "cp1251"), ("cp1252", "cp1251"), ("cp1251", "koi8_r"), ("cp1251", "cp866"), ("cp1251", "cp1253"), ("cp1252", "cp1253"), ("cp1251", "mac_roman"),
    ("cp852", "cp1250"), ("cp1252", "cp1250"), ("cp1250", "cp852"), ("cp1251", "cp1250"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "mac_roman"), ("cp1251", "cp437"), ("cp1250", "cp437"), ("cp437", "cp850"),
    ("gbk", "cp1252"), ("big5", "cp1252"), ("euc_kr", "cp1252"), ("euc_jp", "cp1252"), ("shift_jis", "cp1252"), ("gbk", "cp1251"), ("shift_jis", "cp437"), ("euc_jp", "shift_jis"), ("shift_jis", "gbk"), ("gbk", "shift_jis"), ("euc_kr", "gbk"), ("big5", "gbk"), ("gbk", "big5"),
)
WIDE = {"gbk", "big5", "euc_kr", "euc_jp", "shift_jis", "cp949"}

LOST = "�"

#: Names of all chains; their place is their number. 0 is no damage at all.
CHAINS = (
    "none",
    *[f"utf-8>{r}" for r in UTF8_READERS],
    *[f"utf-8>{a}>utf-8>{b}" for a in UTF8_READERS for b in UTF8_READERS],
    *[f"utf-8>{r}" for r in WIDE_READERS],
    *[f"{w}>{r}" for w, r in LEGACY],
    "?>utf-8",  # bytes of any encoding, of which those that are no UTF-8 were replaced and are lost
)
NUMBER = {c: i for i, c in enumerate(CHAINS)}
REPLACED = NUMBER["?>utf-8"]


@lru_cache(maxsize=None)
def bytes_of(encoding: str) -> dict[str, int]:
    """The byte of each character of a one-byte encoding. Bytes it leaves free are read as C1 controls, as is usual."""
    out = {}
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    for b in range(128, 160):  # a reader of ISO 8859-1 shows these bytes as controls
        out.setdefault(chr(b), b)
    return out


@lru_cache(maxsize=None)
def _chars_of(encoding: str) -> dict[int, str]:
    out = {}
    for b in range(128, 256):
        try:
            out[b] = bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            pass
    return out


@lru_cache(maxsize=None)
def _options(encoding: str, case: str) -> dict[str, tuple[int, ...]]:
    """Bytes a character may stand for if the garbled text was lower- or upper-cased afterwards."""
    own = bytes_of(encoding)
    if case == "as is":
        return {c: (b,) for c, b in own.items()}
    out: dict[str, list[int]] = {}
    for c, b in own.items():
        out.setdefault(c, []).append(b)
        other = c.lower() if case == "lower" else c.upper()
        if other != c and len(other) == 1:
            out.setdefault(other, []).append(b)
    return {c: tuple(v) for c, v in out.items()}


@lru_cache(maxsize=None)
def _shown(reader: str, case: str) -> regex.Pattern:
    """Where a UTF-8 sequence may begin as ``reader`` shows it: a lead and, right after it, a continuation."""
    own = _options(reader, case)
    cls = lambda lo, hi: "[" + regex.escape("".join(c for c, b in own.items() if any(lo <= x <= hi for x in b))) + "]"
    return regex.compile(cls(0xC2, 0xF4) + cls(0x80, 0xBF))


def _length(lead: int) -> int:
    return 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 0


def undo_utf8(text: str, reader: str, case: str = "as is") -> tuple[str, list[tuple[int, int]]] | None:
    """Replace every run of characters that stands for one UTF-8 sequence; also the (start, end) of each result character.

    None if there is no such run. Characters that are part of no sequence stay as they are.
    """
    if not _shown(reader, case).search(text):
        return None
    opts = _options(reader, case)
    out, spans, i, n, hit = [], [], 0, len(text), False
    while i < n:
        best = None  # (character, length); a control is what nobody writes, so any other reading goes before it
        for lead in opts.get(text[i], ()):
            k = _length(lead)
            if not k or i + k > n:
                continue
            seq = [lead]
            for j in range(1, k):
                cont = next((b for b in opts.get(text[i + j], ()) if 0x80 <= b <= 0xBF), None)
                if cont is None:
                    break
                seq.append(cont)
            if len(seq) < k:
                continue
            try:
                c = bytes(seq).decode("utf-8")
            except UnicodeDecodeError:
                continue
            if best is None or best[0] < "\xa0":
                best = (c, k)
            if c >= "\xa0":
                break
        if best is None:
            best = (text[i], 1)
        else:
            hit = True
        out.append(best[0])
        spans.append((i, i + best[1]))
        i += best[1]
    return ("".join(out), spans) if hit else None


@lru_cache(maxsize=None)
def _to_written(written: str, read: str) -> dict[int, str]:
    """What each character of one one-byte encoding was in another."""
    own, theirs = bytes_of(read), _chars_of(written)
    return {ord(c): theirs[b] for c, b in own.items() if b in theirs}


@lru_cache(maxsize=None)
def _to_bytes(read: str) -> dict[int, int]:
    return {ord(c): b for c, b in bytes_of(read).items()}


@lru_cache(maxsize=100_000)
def _undo_word(word: str, written: str, read: str) -> str | None:
    """A word before it was written in one encoding and read in another; None if it cannot be. It may stay the same."""
    if written in WIDE or read in WIDE:
        try:
            if read in WIDE:
                back = word.encode(read).decode(written)
            else:
                table = _to_bytes(read)
                back = bytes(ord(c) if c < "\x80" else table[ord(c)] for c in word).decode(written)
        except (UnicodeError, KeyError):
            return None
    else:
        table = _to_written(written, read)
        if any(c > "\x7f" and ord(c) not in table for c in word):
            return None
        back = word.translate(table)
    return back if _wordlike(back, word) else None


def _damaged_runs(parts: list[str], fixed: list[str | None], gain: Callable[[str, str], float] | None) -> list[tuple[int, int]]:
    """(first, last) of runs of words that may be damaged: no word within that cannot be undone, both ends undone.

    Words that stay the same show no damage and may lie within a run. With ``gain``, which tells how much better a word fits
    when it is undone, a two-state dynamic programme over the words (outside, within) gives the best run and, if all
    words can be undone, that of all of them; without it every run is listed.
    """
    at = [i for i, (p, f) in enumerate(zip(parts, fixed)) if f != p]
    if gain is None:
        return [(at[i], at[j]) for i in range(len(at)) for j in range(i, len(at)) if all(fixed[k] is not None for k in at[i : j + 1])]
    out = []
    if at and all(fixed[k] is not None for k in at):
        out.append((at[0], at[-1]))
    top, run, begin, best = float("-inf"), float("-inf"), 0, None
    for k in at:
        if fixed[k] is None:
            run = float("-inf")
            continue
        g = gain(parts[k], fixed[k])
        if run > 0:
            run += g
        else:
            run, begin = g, k
        if run > top:
            top, best = run, (begin, k)
    if best and best not in out:
        out.append(best)
    return out


def _by_part(text: str, written: str, read: str, gain: Callable[[str, str], float] | None) -> list[str]:
    """Undo the damage of runs of neighbouring words."""
    parts = text.split(" ")
    fixed = [p if p.isascii() else _undo_word(p, written, read) for p in parts]
    return [" ".join([*parts[:i], *fixed[i : j + 1], *parts[j + 1 :]]) for i, j in _damaged_runs(parts, fixed, gain)]


#: Characters besides letters and digits that names hold.
MARKS = set("–—…’‘“”„•™«»·×&†‡€£§©®°±¡¿！？：、。「」『』・ー〜～★☆♥♪№º")


@lru_cache(maxsize=None)
def _script(c: str) -> str:
    return unicodedata.name(c, "?").split(" ")[0] if unicodedata.category(c)[0] == "L" else ""


def _wordlike(text: str, given: str) -> bool:
    """Whether the words that were changed look written: letters, digits and usual marks, and one alphabet to a word."""
    was = set(given.split())
    for w in text.split():
        if w in was or w.isascii():
            continue
        if any(not (c < "\x80" or c in MARKS or unicodedata.category(c)[0] in "LMN") for c in w):
            return False
        if len({s for c in w if (s := _script(c)) in ("LATIN", "CYRILLIC", "GREEK")}) > 1:
            return False
    return True


def _plausible(text: str) -> bool:
    """No unassigned or private characters and no controls, which no writer of a name puts there."""
    return not any(unicodedata.category(c) in ("Cc", "Cn", "Co", "Cs") and c not in "\t\n\r" for c in text)


def repairs(text: str, gain: Callable[[str, str], float] | None = None) -> list[tuple[int, str]]:
    """(chain number, text before the damage) for every chain that can be undone; the first way to a result counts.

    ``gain`` (given word, undone word) chooses the damaged run of a partly damaged text; see ``_damaged_runs``.
    """
    if text.isascii():
        return []
    seen: dict[str, int] = {}

    def note(chain: str, back: str | None) -> None:
        if back is not None and back != text and _plausible(back):
            seen.setdefault(back, NUMBER[chain])

    cases = ["as is"] + ["lower"] * (text == text.lower()) + ["upper"] * (text == text.upper())
    for case in cases:
        for a in UTF8_READERS:
            once = undo_utf8(text, a, case)
            if once is None:
                continue
            for b in (a, *UTF8_READERS) if not once[0].isascii() else ():
                twice = undo_utf8(once[0], b)
                if twice is not None:
                    note(f"utf-8>{b}>utf-8>{a}", twice[0])
            note(f"utf-8>{a}", once[0])
    for w, r in (*(("utf-8", r) for r in WIDE_READERS), *LEGACY):
        for back in _by_part(text, w, r, gain):
            note(f"{w}>{r}", back)
    return [(c, t) for t, c in seen.items()]
