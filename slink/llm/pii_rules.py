"""The base rules of personal data: exact spans of emails, addresses, cards and phones in a text.

Each rule takes leftmost matches that do not overlap and drops those that fail its check. All scans are linear in the
text, however long its words and numbers are.
"""

from __future__ import annotations

import re

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, str, int]  # start, kind, end (code points)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where its run of digits does, since a run that fails from its first digit fails from each.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    """Check digit of a card number."""
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = ord(digit) - 48
        if place % 2:
            value = value * 2 - 9 if value > 4 else value * 2
        total += value
    return total % 10 == 0


def digits_of(text: str) -> str:
    return _NOT_DIGITS.sub("", text)


def small(part: str) -> bool:
    """A number of any length that is at most 255."""
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def emails(text: str) -> list[tuple[int, int]]:
    found, taken, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > taken and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at) if start < at else None
        if domain:
            taken = domain.end()
            found.append((start, taken))
        at = text.find("@", max(at + 1, taken))
    return found


def ips(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _IP.finditer(text) if all(map(small, m[0].split(".")))]


def cards(text: str) -> list[tuple[int, int]]:
    found = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = digits_of(m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append(m.span())
    return found


def phones(text: str) -> list[tuple[int, int]]:
    if "+" not in text:
        return []
    return [m.span() for m in _PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]


RULES = {"email": emails, "ip": ips, "card": cards, "phone": phones}


def base_spans(text: str) -> list[Span]:
    """All base spans by start, then kind as listed."""
    found = [(start, kind, end) for kind in KINDS for start, end in RULES[kind](text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))


def listed(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)
