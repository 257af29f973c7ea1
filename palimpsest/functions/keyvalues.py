"""KeyValues text (nested ``"key" "value"`` and ``"key" { ... }``), flattened to leaves. No recursion, no exceptions."""

from __future__ import annotations

import re

_TOKEN = re.compile(r'"([^"]*)"|([{}])|([^\s"{}]+)')
_COMMENT = ("//", "#", ";")


def leaves(text: str | None) -> list[tuple[tuple[str, ...], str]]:
    """(path of lower-cased keys, value) of every leaf, in order; repeated keys come out each. Unclosed blocks end with
    the text, stray closing braces are skipped."""
    out: list[tuple[tuple[str, ...], str]] = []
    path: list[str] = []
    key: str | None = None
    for line in (text or "").splitlines():
        line = line.strip()
        if not line or line.startswith(_COMMENT):
            continue
        for m in _TOKEN.finditer(line):
            brace = m.group(2)
            if brace == "{":
                path.append(key or "")
                key = None
            elif brace == "}":
                if path:
                    path.pop()
                key = None
            else:
                token = m.group(1) if m.group(1) is not None else m.group(3)
                if key is None:
                    key = token.lower()
                else:
                    out.append(((*path, key), token))
                    key = None
    return out


def lookup(text: str | None, *keys: str) -> list[str]:
    """Values of the leaves at exactly this path."""
    want = tuple(k.lower() for k in keys)
    return [v for p, v in leaves(text) if p == want]
