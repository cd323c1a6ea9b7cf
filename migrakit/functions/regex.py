"""Regular expressions that mean the same in Java (Spark) and RE2 (DuckDB):
no look-around, no ``(?i)`` (case-insensitivity is spelled out per letter,
so Unicode case folding cannot differ between the engines), and every
character that is not a letter, digit or ``_`` written as ``\\x{..}``."""

from __future__ import annotations

from typing import Iterable


def ci_literal(text: str) -> str:
    """A literal that matches ``text`` in any ASCII letter case."""
    out = []
    for ch in text:
        if ch.isascii() and ch.isalpha():
            out.append(f"[{ch.lower()}{ch.upper()}]")
        elif ch.isascii() and (ch.isdigit() or ch == "_"):
            out.append(ch)
        else:
            out.append("\\x{%x}" % ord(ch))
    return "".join(out)


def alternation(names: Iterable[str]) -> str:
    """Case-insensitive alternation of literals as a prefix tree
    (``sales|sales_eu|hr`` -> ``(?:[sS][aA]...(?:_[eE][uU])?|[hH][rR])``).

    Matching costs the length of a name, not the number of names, so a
    dictionary of thousands of schemas stays cheap; the optional tails are
    greedy, so the longest name is tried first."""
    end = ""
    trie: dict = {}
    for n in names:
        if not n:
            continue
        node = trie
        for ch in n.lower() if n.isascii() else n:
            node = node.setdefault(ch, {})
        node[end] = {}
    if not trie:
        raise ValueError("need at least one name")

    def render(node: dict) -> str:
        alts = [ci_literal(ch) + render(child) for ch, child in sorted(node.items()) if ch != end]
        if not alts:
            return ""
        body = alts[0] if len(alts) == 1 else "(?:" + "|".join(alts) + ")"
        return "(?:" + body + ")?" if end in node else body

    return render(trie)


def re2_replacement(text: str) -> str:
    """Escape ``\\`` for an RE2 replacement string."""
    return text.replace("\\", "\\\\")
