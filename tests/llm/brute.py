"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def base_counts(text: str | None) -> dict[str, int]:
    found = words(text)
    lines = [line for line in (text or "").split("\n") if words(line)]
    windows = Counter(zip(found, found[1:], found[2:]))
    repeated = set()
    for i in range(len(found) - 2):
        if windows[tuple(found[i:i + 3])] > 1:
            repeated.update((i, i + 1, i + 2))
    return {"n_words": len(found), "word_chars": sum(map(len, found)),
            "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(repeated)}


def shingles(text: str | None, size: int = 4) -> frozenset:
    found = words((text or "").translate(LOWER))
    if len(found) < size:
        return frozenset([tuple(found)] if found else [])
    return frozenset(zip(*[found[i:] for i in range(size)]))


def near_components(docs: dict[int, str | None], percent: int = 80, size: int = 4
                    ) -> dict[int, int]:
    sets = {i: shingles(text, size) for i, text in docs.items()}
    root = {i: i for i in docs}

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(i for i in docs if sets[i])
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: find(i) for i in docs}


def repeated_words(docs: dict[int, str | None], window: int) -> dict[int, list[bool]]:
    """For each word, whether it lies in a window that starts in a document with a smaller id."""
    first: dict[tuple, int] = {}
    out = {}
    for i in sorted(docs):
        found = words(docs[i])
        gone = [False] * len(found)
        for k in range(len(found) - window + 1):
            if first.setdefault(tuple(found[k:k + window]), i) < i:
                gone[k:k + window] = [True] * window
        out[i] = gone
    return out


def without_words(text: str | None, gone: list[bool]) -> str:
    """The text without the words that are gone and the white space behind each of them."""
    spans = [m.span() for m in WORD.finditer(text or "")]
    out, at = [], 0
    for n, (start, _) in enumerate(spans):
        after = spans[n + 1][0] if n + 1 < len(spans) else len(text)
        if gone[n]:
            out.append(text[at:start])
            at = after
    return "".join([*out, (text or "")[at:]])


def lines_of(text: str | None) -> list[str]:
    return [line.strip(" \t\n\x0b\x0c\r") for line in (text or "").split("\n") if words(line)]


def repeated_lines(docs: dict[int, str | None], run: int, least: int) -> dict[int, list[int]]:
    """Numbers of the lines in runs of `run` lines or `least` words that start at an earlier
    position, counting lines with a word; all lines of a shorter document that occurs earlier.

    Follows the definition: of all runs from each line on, up to the longest there is any need to
    look at, every one that counts and was seen before marks its lines.
    """
    seen, short, out = set(), set(), {}
    for i in sorted(docs):
        lines = lines_of(docs[i])
        sizes = [len(words(line)) for line in lines]
        gone = set()
        for k in range(len(lines)):
            for size in range(1, 2 * run + 2):
                if k + size > len(lines):
                    break
                key = tuple(lines[k:k + size])
                if size < run and sum(sizes[k:k + size]) < least:
                    continue
                if key in seen:
                    gone.update(range(k, k + size))
                seen.add(key)
        if lines and len(lines) < run and sum(sizes) < least:
            if tuple(lines) in short:
                gone.update(range(len(lines)))
            short.add(tuple(lines))
        out[i] = sorted(gone)
    return out


def without_lines(text: str | None, gone: list[int]) -> str:
    kept, number = [], -1
    for line in (text or "").split("\n"):
        number += bool(words(line))
        if not (words(line) and number in gone):
            kept.append(line)
    return "\n".join(kept)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
