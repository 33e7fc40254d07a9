"""Small fixtures and brute-force versions."""

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    x, out = seed * 2654435761 % 2**32 or 1, []
    for _ in range(n):
        x = (1103515245 * x + 12345) % 2**31
        out.append(f"w{x // 7 % vocabulary}")
    return " ".join(out)


def odd_texts() -> list:
    """Null, empty, wordless, tiny, very long, repeated and non-Latin texts."""
    long = prose(99, 30_000, 5000)
    return [None, "", " \n\t ", "one", "a b c d", "A b c d e", long, long, "Ünï çødé " * 20, "日本語 テスト", "x\x00y <|endoftext|> z", "é a b c", "😀 😀 😀", "!!! ??? ###"]


def shingles(text) -> frozenset:
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def near_groups(rows: list) -> dict:
    """doc_id -> (set size, smallest id reachable), over all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    group = {i: i for i in sets}

    def find(a):
        while group[a] != a:
            a = group[a]
        return a

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                group[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def quality(text) -> tuple:
    w = WORD.findall(text or "")
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {i + j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(hit), failed


BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(text, items: list) -> tuple:
    words = BENCH_WORD.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for key, item in items:
        w = BENCH_WORD.findall((item or "").translate(LOWER))
        for i in range(max(1, len(w) - 9) if w else 0):
            g = w[i : i + 10]
            for p in range(len(words) - len(g) + 1):
                if words[p : p + len(g)] == g:
                    hit |= set(range(p, p + len(g)))
                    found.add(str(key))
    return len(words), len(hit), sorted(found)
