"""Plain versions of the operators, for small inputs."""

import re
from collections import Counter, defaultdict


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


def shingles(text, n=5):
    w = words(text)
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def linked(a, b):
    return bool(a) and bool(b) and 100 * len(a & b) >= 75 * len(a | b)


def components(texts):
    """Least id reached by links, for {id: text}."""
    sets, at, inverted = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}, defaultdict(list)

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    for i, s in sets.items():
        met = Counter(j for g in s for j in inverted[g])
        for j, n in met.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                x, y = sorted((root(i), root(j)))
                at[y] = x
        for g in s:
            inverted[g].append(i)
    return {i: root(i) for i in texts}


def without_repeated_lines(texts):
    """{id: text} without lines that an earlier one, by id and place, resembles."""
    held, inverted, out = [], defaultdict(list), {}
    for i in sorted(texts):
        if texts[i] is None:
            out[i] = None
            continue
        kept = []
        for line in texts[i].split("\n"):
            s = frozenset(re.findall(r"[^\x20\x09-\x0D]+", line.lower()))
            met = Counter(j for g in s for j in inverted[g])
            if not any(100 * n >= 75 * (len(s) + len(held[j]) - n) for j, n in met.items()):
                kept.append(line)
            if s:
                for g in s:
                    inverted[g].append(len(held))
                held.append(s)
        out[i] = "\n".join(kept)
    return out
