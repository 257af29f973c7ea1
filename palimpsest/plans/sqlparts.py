"""Pieces of oracle SQL shared by several queries."""

WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
NARROW = "".join(chr(c) for c in range(0x21, 0x7F)).replace("'", "''")


def sql_key(col: str) -> str:
    """The path key in DuckDB; null for null and blank paths."""
    wide = f"translate({col}, '{WIDE}', '{NARROW}')"
    kept = rf"regexp_replace({wide}, '[^\p{{L}}\p{{N}}\p{{M}}]', '', 'g')"
    key = rf"regexp_replace(lower(nfc_normalize({kept})), '[^\p{{L}}\p{{N}}]', '', 'g')"
    return f"CASE WHEN {sql_nonblank(col)} THEN {key} END"


def sql_nonblank(col: str) -> str:
    return rf"regexp_matches({col}, '[^\s\x{{00A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}\x{{0085}}\x0B]')"
