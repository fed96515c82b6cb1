"""Language rules that keep transient or ill-formed statements out of the memory."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class GateRule:
    """A pattern on one column; ``only_type`` limits it to a memory type."""

    reason: str
    column: str
    pattern: str
    only_type: str | None = None


# Wording in English and Chinese. RE2-compatible, so that SQL can run them too.
STANDING_MARKERS = r"(?i)(以后|今后|一律|统一|每次|永远|始终|默认|从现在起|不要|不用|别|禁止|不得|\bfrom now on\b|\balways\b|\bnever\b|\bmust not\b)"
ONE_OFF_MARKERS = r"(?i)(这次|本次|这一次|今天|\bthis time\b|\bjust once\b|\bfor now\b)"
REQUEST = r"(?i)^\s*(请?帮我|全部提交|继续|提交|修复|please\b|fix\b|commit\b|continue\b|run\b|deploy\b)"
RULES = (
    GateRule("question", "content", r"[?？]\s*$"),
    GateRule("question", "evidence_snippet", r"[?？]\s*$"),
    GateRule(
        "dialogue reference",
        "content",
        r"(?i)(\b(above|earlier|just now|previous message|aforementioned)\b|上面|刚才|前述|上一条)",
    ),
    GateRule("unbound pronoun", "content", r"(?i)^\s*(it|they|he|she)\b"),
    GateRule("unbound pronoun", "content", r"(?i)^\s*(this|that|these|those)\s+(is|are|was|were|requires|uses|means|reduces)\b"),
    GateRule("unbound pronoun", "content", r"(?i)\b(says?|said|thinks?|believes?|on|with)\s+(that\s+)?(it|they|them)\b"),
    GateRule("unbound pronoun", "content", r"^(它|他们|她们|这个|那个)(需要|使用|是)"),
    GateRule("more than one atomic claim", "content", r"(?i)\b(prefers?|likes?)\b.+\band\b", "preference"),
    GateRule("more than one atomic claim", "content", r"偏好.+(和|并且|以及)", "preference"),
    GateRule("more than one atomic claim", "content", r"(?i)\band\s+(requires?|prefers?|needs?|wants?)\b"),
    GateRule(
        "transient or non-semantic output",
        "content",
        r"(?i)(\b(tomorrow|tonight|today|next (week|sprint|month)|this (week|sprint))\b|\bis (migrating|deploying|running)\b|明天|下周|今晚)",
    ),
)
