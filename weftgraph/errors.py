"""Refusals with the reason codes that callers match on."""

from __future__ import annotations


class UnsupportedQuery(ValueError):
    """A query outside what is answered; ``reason`` is a stable code."""

    def __init__(self, reason: str, detail: str = "") -> None:
        super().__init__(f"{reason}: {detail}" if detail else reason)
        self.reason = reason


def refuse(detail: str, reason: str = "unsupported") -> UnsupportedQuery:
    return UnsupportedQuery(reason, detail)
