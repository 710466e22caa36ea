"""Robots rules of one host as a trie over pattern segments, asked for the longest match."""

from __future__ import annotations

import re
from collections.abc import Iterable
from urllib.parse import unquote

_BAD_ESCAPE = re.compile(r"%(?![0-9A-Fa-f]{2})")


def decoded(text: str) -> str:
    """Percent escapes decoded, plus signs left alone; the text itself where an escape is broken."""
    return text if "%" not in text or _BAD_ESCAPE.search(text) else unquote(text, errors="replace")


class RuleTrie:
    """Patterns by their first literal segment; below it those with more segments, longest first.

    A star stands for anything, a dollar at the end for the end of the target.
    A pattern is as long as its characters without them; the longest match
    decides, and among equally long ones an allowing one.
    """

    def __init__(self, rules: Iterable[tuple[bool, str]]):
        self.plain: dict[str, tuple[int, bool]] = {}
        self.more: dict[str, list[tuple[int, bool, list[str], bool]]] = {}
        self.is_decoded: RuleTrie | None = None
        rules = list(rules)
        self._add((allow, pattern, None) for allow, pattern in rules)
        again = [(allow, "*".join(map(decoded, pattern.split("*"))), self.length(pattern)) for allow, pattern in rules]
        if any(new != old for (_, new, _), (_, old) in zip(again, rules, strict=True)):
            self.is_decoded = RuleTrie([])
            self.is_decoded._add(again)

    @staticmethod
    def length(pattern: str) -> int:
        return len(pattern.removesuffix("$").replace("*", ""))

    def _add(self, rules: Iterable[tuple[bool, str, int | None]]) -> None:
        for allow, pattern, length in rules:
            length = self.length(pattern) if length is None else length
            ends = pattern.endswith("$")
            first, *rest = pattern.removesuffix("$").split("*")
            if rest or ends:
                self.more.setdefault(first, []).append((length, allow, rest, ends))
            else:
                self.plain[first] = max(self.plain.get(first, (-1, False)), (length, allow))
        for found in self.more.values():
            found.sort(key=lambda x: x[:2], reverse=True)
        self.lengths = sorted({len(p) for p in (*self.plain, *self.more)}, reverse=True)

    def best(self, target: str) -> tuple[int, bool]:
        """Length of the longest match and whether it allows; length -1 without any."""
        best = (-1, True)
        for n in self.lengths:
            if n > len(target):
                continue
            key = target[:n]
            best = max(best, self.plain.get(key, best))
            for length, allow, rest, ends in self.more.get(key, ()):
                if (length, allow) <= best:
                    break
                if self._matches(target, n, rest, ends):
                    best = (length, allow)
                    break
        return best

    @staticmethod
    def _matches(target: str, at: int, rest: list[str], ends: bool) -> bool:
        if not rest:
            return at == len(target)
        for segment in rest[:-1]:
            at = target.find(segment, at)
            if at < 0:
                return False
            at += len(segment)
        return target.endswith(rest[-1]) and len(target) - len(rest[-1]) >= at if ends else target.find(rest[-1], at) >= 0

    def allows(self, target: str) -> bool:
        best = self.best(target)
        other = self.is_decoded or self
        plain = decoded(target)
        if other is not self or plain != target:
            best = max(best, other.best(plain))
        return best[1]
