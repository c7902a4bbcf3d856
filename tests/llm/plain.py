"""Plain versions of the operators' definitions, for comparison."""

import re
from collections import Counter, defaultdict

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return WORD.findall(lower(text))


def shingles(text, n=5):
    w = words(text)
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def repeats(rows, length=50):
    """For each (id, text): its bytes and which of them go."""
    least = {}
    for i, text in rows:
        data = (text or "").encode()
        for k in range(len(data) - length + 1):
            piece = data[k : k + length]
            least[piece] = min(least.get(piece, 1 << 62), 1 << 62 if i is None else i)
    out = []
    for i, text in rows:
        data = (text or "").encode()
        gone = [False] * len(data)
        for k in range(len(data) - length + 1):
            if least[data[k : k + length]] < (1 << 62 if i is None else i):
                gone[k : k + length] = [True] * length
        out.append((data, gone))
    return out


def windows(items, size=13):
    found = defaultdict(set)
    for i, text in items:
        w = words(text)
        for k in range(max(1, len(w) - size + 1)) if w else []:
            found[tuple(w[k : k + size])].add(i)
    return found


def contamination(text, found):
    w = words(text)
    hit, items = set(), set()
    for size in {len(p) for p in found}:
        for k in range(len(w) - size + 1):
            piece = tuple(w[k : k + size])
            if piece in found:
                hit |= set(range(k, k + size))
                items |= found[piece]
    return len(w), len(hit), sorted(str(i) for i in items if i is not None)


def links(rows, threshold=0.8):
    """For each place in rows: linked places."""
    sets = [shingles(t) for _, t in rows]
    holders = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            holders[x].append(k)
    common = Counter((a, b) for held in holders.values() for a in held for b in held if a < b)
    out = defaultdict(set)
    for (a, b), n in common.items():
        if n >= threshold * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
            out[a].add(b)
            out[b].add(a)
    return sets, out
