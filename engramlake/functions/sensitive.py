"""Sensitive-content detection as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from engramlake.functions.expr import bind

# Detection patterns. (?U) makes \b, \w and \s Unicode-aware.
CONFIRMED_PATTERNS = {
    "private-key": r"(?iU)-----BEGIN(?: [A-Z0-9]+)? PRIVATE KEY-----",
    "aws-access-key": r"(?U)\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    "github-token": r"(?U)\bgh[pousr]_[A-Za-z0-9]{20,}\b",
    "api-token": r"(?iU)\bsk[-\s_]+[A-Za-z0-9_-]{20,}\b",
    "bearer-token": r"(?iU)\bBearer\s+[A-Za-z0-9._~+/=-]{20,}\b",
}
COMPACT_PATTERNS = {
    "api-token": r"(?iU)\bsk-[A-Za-z0-9_-]{20,}\b",
    "github-token": r"(?U)\bgh[pousr]_[A-Za-z0-9]{20,}\b",
    "aws-access-key": r"(?U)\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
}
SECRET_WORDS = (
    r"(?:api[\s_-]*key|access[\s_-]*token|client[\s_-]*secret|secret[\s_-]*access[\s_-]*key|password|passwd|pass|secret|token)"
)
ASSIGNED_KEY = SECRET_WORDS + r"\b[\"']?\s*(?::|=)\s*"
# Words before the key are taken one by one and never given back: a repeated group that can be given
# back would recurse once per word. Each stops where the key itself stands.
SECRET_KEY_PATTERN = r"(?<![a-z0-9_-])[\"']?(?:(?!" + ASSIGNED_KEY + r")[a-z0-9]++[_-])*+" + ASSIGNED_KEY
# The value is captured in a lookahead so that the next key may start inside it.
SECRET_VALUE_PATTERN = (
    r"(?=(\"[^\"\\\r\n]*+(?:\\[\s\S][^\"\\\r\n]*+)*+|'[^'\\\r\n]*+(?:\\[\s\S][^'\\\r\n]*+)*+|[^\"';\n][^;\n]*+|))"
)
UNCERTAIN_PATTERN = (
    r"(?iU)\b(?:credential|api[\s_-]*key|access[\s_-]*token|password|passwd|private[\s_-]*key|secret|token)\b"
    r"(?:\s+\w+){0,3}\s+(?:may|might|could|possibly)\b(?:\s+\w+){0,3}"
)
PLACEHOLDER_PATTERN = (
    r"(?iU)\b(?:example|sample|placeholder|redacted|masked|dummy|fake|not-a-secret|\*{4,})\b"
)
ASSIGNED_PLACEHOLDER_PATTERN = (
    r"(?iU)\A(?:example|sample|placeholder|redacted|masked|dummy|fake|not-a-secret|\*{4,})\z"
)
BENIGN_VALUE_PATTERN = (
    r"(?iU)\A(?:\$\{?[A-Z][A-Z0-9_]*\}?|(?:env|environment)(?::|[._-])?[A-Z][A-Z0-9_]*|"
    r"vault://[a-z0-9._-]++(?:/[a-z0-9._-]++)++#[a-z0-9._-]++|"
    r"(?:generated|managed|configured|injected|provided|resolved|loaded|fetched)"
    r"(?:[-_](?:at|by|from|during|via)[-_][a-z0-9_-]++)++)\z"
)


def _material(value: Column) -> Column:
    """A captured assignment value that is neither empty nor a known harmless form."""
    unquoted = F.regexp_replace(value, r"\A[\"']", "")
    stripped = F.regexp_replace(unquoted, r"(?U)\A\s+|\s+\z", "")
    candidate = F.regexp_replace(stripped, r"[,.;)]+\z", "")
    dashed = F.regexp_replace(candidate, r"(?U)[\s_]+", "-")
    return (
        (candidate != "")
        & ~candidate.rlike(ASSIGNED_PLACEHOLDER_PATTERN)
        & ~candidate.rlike(BENIGN_VALUE_PATTERN)
        & ~dashed.rlike(BENIGN_VALUE_PATTERN)
    )


# Literals (lower case) without which the pattern of that name cannot match.
REQUIRED_LITERALS = {
    "private-key": ("-----begin",),
    "aws-access-key": ("akia", "asia"),
    "github-token": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "api-token": ("sk",),
    "bearer-token": ("bearer",),
    "assigned-secret": ("key", "token", "secret", "pass"),
    "hedged": ("credential", "key", "token", "secret", "pass"),
}
# Unicode white space plus the backslash, removed before the compact re-scan.
COMPACT_REMOVED = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\\"
)


def _mentions(lowered: Column, name: str) -> Column:
    """Cheap literal test that spares most texts the regular expression."""
    found = F.lit(False)
    for literal in REQUIRED_LITERALS[name]:
        found = found | F.contains(lowered, F.lit(literal))
    return found


def _categories(texts: Column) -> Column:
    text, lowered, compact, compact_lowered = (texts[name] for name in ("text", "lowered", "compact", "compact_lowered"))
    values = F.regexp_extract_all(text, F.lit("(?iU)" + SECRET_KEY_PATTERN + SECRET_VALUE_PATTERN), F.lit(1))
    flags = [
        F.when(_mentions(lowered, name) & text.rlike(pattern), F.lit(name))
        for name, pattern in CONFIRMED_PATTERNS.items()
    ]
    assigned = _mentions(lowered, "assigned-secret") & (F.contains(text, F.lit("=")) | F.contains(text, F.lit(":")))
    flags.append(F.when(assigned & F.exists(values, _material), F.lit("assigned-secret")))
    flags += [
        F.when(_mentions(compact_lowered, name) & compact.rlike(pattern), F.lit(name))
        for name, pattern in COMPACT_PATTERNS.items()
    ]
    return F.array_distinct(F.array_compact(F.array(*flags)))


def sensitive_categories(text: Column) -> Column:
    """Confirmed categories in a fixed order; empty array when there are none."""
    pair = F.struct(text.alias("text"), F.translate(text, COMPACT_REMOVED, "").alias("compact"))
    return bind(
        pair,
        lambda p: bind(
            F.struct(
                p["text"].alias("text"),
                F.lower(p["text"]).alias("lowered"),
                p["compact"].alias("compact"),
                F.lower(p["compact"]).alias("compact_lowered"),
            ),
            _categories,
        ),
    )


def has_hedged_language(text: Column) -> Column:
    """Speculative credential wording that is not a placeholder."""
    match = bind(
        F.lower(text),
        lambda lowered: F.when(_mentions(lowered, "hedged"), F.regexp_extract(text, UNCERTAIN_PATTERN, 0)),
    )
    return bind(match, lambda found: F.coalesce((found != "") & ~found.rlike(PLACEHOLDER_PATTERN), F.lit(False)))


def is_sensitive(text: Column) -> Column:
    """True when the text must not be stored as it is. Null text is not sensitive."""
    return F.coalesce((F.size(sensitive_categories(text)) > 0) | has_hedged_language(text), F.lit(False))
