"""What can be said about the texts that a regular expression matches, without matching it."""

from __future__ import annotations

from collections.abc import Iterable

_SPECIAL = set("\\^$.|?*+()[]{}")


def required_literals(pattern: str) -> tuple[str, ...] | None:
    """Texts of which one at least occurs in every text that the pattern matches; None if none is found.

    Each branch of the pattern gives its longest run of plain characters. What is optional, repeated from zero, a class
    or a group breaks a run; flags, quotes and anything unclear give up.
    """
    branches, run, runs, i = [], "", [], 0

    def close():
        nonlocal run
        runs.append(run)
        run = ""

    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            if i + 1 == len(pattern) or pattern[i + 1] in "QE0123456789cuxNpPkX":
                return None
            if pattern[i + 1].isalnum():
                close()  # a class such as \d or a boundary
            else:
                run += pattern[i + 1]
            i += 2
        elif c in "([":
            end = _closing(pattern, i)
            if end is None or pattern.startswith("(?", i) and pattern[i + 2: i + 3] not in (":", "="):
                return None
            close()
            i = end + 1
        elif c in "*?{":
            # The character before may be missing; after a group or a class nothing is lost.
            run = run[:-1]
            close()
            i += 1 if c != "{" else pattern.find("}", i) - i + 1
            if c == "{" and pattern[i - 1] != "}":
                return None
        elif c == "|":
            close()
            branches.append(runs)
            runs = []
            i += 1
        elif c in "+.^$":
            close()
            i += 1
        elif c in "])}":
            return None
        else:
            run += c
            i += 1
    close()
    branches.append(runs)
    longest = [max(parts, key=len) for parts in branches]
    return tuple(dict.fromkeys(longest)) if all(longest) else None


def _closing(pattern: str, start: int) -> int | None:
    """Where the group or class that opens at ``start`` ends."""
    depth, i, classes = 0, start, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            if pattern[i + 1: i + 2] in ("Q", "E"):
                return None
            i += 1
        elif c == "[":
            if classes or pattern.startswith("[]", i) or pattern.startswith("[^]", i):
                return None  # classes inside classes
            classes += 1
        elif c == "]" and classes:
            classes -= 1
            if not classes and not depth:
                return i
        elif not classes and c == "(":
            depth += 1
        elif not classes and c == ")":
            depth -= 1
            if not depth:
                return i
        i += 1
    return None


def escaped(text: str) -> str:
    return "".join(f"\\{c}" if c in _SPECIAL else c for c in text)


def any_of(literals: Iterable[str]) -> str:
    """A pattern for any of the texts, the longest where one begins with another; common beginnings are written once,
    so that matching does not try the texts one by one."""
    tree = {}
    for literal in literals:
        node = tree
        for c in literal:
            node = node.setdefault(c, {})
        node[""] = {}

    def written(node: dict) -> str:
        parts = [escaped(c) + written(below) for c, below in sorted(node.items()) if c]
        if not parts:
            return ""
        joined = parts[0] if len(parts) == 1 and "" not in node else f"(?:{'|'.join(parts)})"
        return joined + "?" if "" in node else joined

    return written(tree)
