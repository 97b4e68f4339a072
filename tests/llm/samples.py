"""Small tables with every awkward case, and plain brute-force versions of the operators."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, `part` int, `row` string"
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def messy_documents(seed: int = 5) -> list[tuple]:
    """Nulls, empty and blank texts, copies, near copies, shared passages, one long text, and clashing extra columns."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghiklmnoprstuvé", k=rng.randint(2, 8))) for _ in range(400)]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    base, passage = text(120), text(40)
    texts = [None, "", "   \n\t ", "word", "two words", base, base, base + " tail", base.replace(" ", "  ", 3), base.upper()]
    for _ in range(12):
        words = base.split()
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        texts.append(" ".join(words))
    texts += [text(30) + " " + passage + "\n" + text(20) for _ in range(6)]
    texts += [text(rng.randint(1, 60)) for _ in range(20)] + [text(6000), "x" * 3000, "é" * 120, "☃ 日本語 \x00 end", "!!! ### 123"]
    rows = [(k * 3 + 1, t, "en" if k % 4 else None, f"s{k % 3}", len(t or ""), 0.5, k % 2, "r") for k, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, base, None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return rows


def unique_documents(rows: list[tuple]) -> list[tuple]:
    seen: set = set()
    return [r for r in rows if r[0] is not None and not (r[0] in seen or seen.add(r[0]))]


def shingles(text: str | None, size: int) -> frozenset:
    words = WORDS.findall((text or "").encode().lower())
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1)))


def near_components(rows: list[tuple], size: int, percent: int) -> dict[int, int]:
    """Smallest id reachable over links, by comparing all pairs."""
    sets = [(r[0], shingles(r[1], size)) for r in rows if r[0] is not None]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, left) in enumerate(sets):
        for b, right in sets[:k]:
            if left and right and 100 * len(left & right) >= percent * len(left | right):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {i: root(i) for i in parent}


def removed_flags(rows: list[tuple], depth: int = 50) -> list[list[bool]]:
    """For every row, which bytes a window covers that also starts in a document with a smaller id."""
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    windows: dict[bytes, int] = {}
    for i, data in texts:
        for k in range(len(data) - depth + 1 if i is not None else 0):
            window = data[k : k + depth]
            windows[window] = min(windows.get(window, i), i)
    out = []
    for i, data in texts:
        flags = [False] * len(data)
        for k in range(len(data) - depth + 1 if i is not None else 0):
            if windows[data[k : k + depth]] < i:
                flags[k : k + depth] = [True] * depth
        out.append(flags)
    return out
