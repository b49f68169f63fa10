"""Plain versions that the operators are held against."""

import re


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def partition(texts):
    sets, root = list(map(shingles, texts)), list(range(len(texts)))
    for _ in texts:
        for i, x in enumerate(sets):
            for j, y in enumerate(sets[:i]):
                if x == y or 5 * len(x & y) >= 4 * len(x | y):
                    root[i] = root[j] = min(root[i], root[j])
    return root
