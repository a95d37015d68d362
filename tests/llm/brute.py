"""Plain Python versions of the operators, for small inputs."""

import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall(text or "")


def components(ids, links):
    least = {}
    for x in sorted(ids):
        if x in least:
            continue
        least[x], todo = x, [x]
        while todo:
            for y in links[todo.pop()]:
                if y not in least:
                    least[y] = x
                    todo.append(y)
    return least


def shingles(text, n=4):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(w) < n:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def jaccard(rows, percent=85, n=4):
    """{id: (set size, component, links)} for rows with distinct ids."""
    sets = {i: shingles(t, n) for i, t in rows}
    links = defaultdict(set)
    for a in sets:
        for b in sets:
            common = len(sets[a] & sets[b])
            union = len(sets[a]) + len(sets[b]) - common
            if a < b and common and 100 * common >= percent * union:
                links[a].add(b)
                links[b].add(a)
    least = components(sets, links)
    return {i: (len(sets[i]), least[i], len(links[i])) for i in sets}


def substrings(rows, window=13):
    """[(id, words, removed, sha256)] of (id, text) rows, in order."""
    first = {}
    for i, text in rows:
        w = words(text)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, text in rows:
        w = words(text)
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)


def secrets(text):
    """Base spans (kind, start, end) by start, then kind as listed."""
    text = text or ""
    spans = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(kind, start, end) for start, _, kind, end in sorted(spans)]
