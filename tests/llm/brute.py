"""Plain versions of the operators, to compare with."""

import hashlib
import re


def words(text, pattern=rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"):
    low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    return re.findall(pattern, low)


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def decontamination(docs, items, window=10):
    out = {}
    wanted = {}
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - window, 0) + 1 if w else 0):
            wanted.setdefault(tuple(w[i : i + window]), set()).add(str(item))
    sizes = {len(k) for k in wanted}
    for doc, text in docs:
        w = words(text)
        hit, names = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if own := wanted.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    names |= own
        out[doc] = (len(w), len(hit), len(names), sha(",".join(sorted(names))), bool(hit))
    return out


def shingles(text, n=5):
    w = words(text, rb"[^\x20\x09-\x0D]+")
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(max(len(w) - n, 0) + 1))


def similar(docs, p=75, q=100):
    sets = [(d, shingles(t)) for d, t in docs]
    top = {i: i for i in range(len(sets))}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    where = {}
    for i, (_, s) in enumerate(sets):
        for e in s:
            where.setdefault(e, []).append(i)
    for i, (_, s) in enumerate(sets):
        shared = {}
        for e in s:
            for j in where[e]:
                if j < i:
                    shared[j] = shared.get(j, 0) + 1
        for j, n in shared.items():
            if q * n >= p * (len(s) + len(sets[j][1]) - n):
                a, b = sorted((root(i), root(j)))
                top[b] = a
    least = {}
    for i, (d, _) in enumerate(sets):
        r = root(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return sorted(((d, len(s), least.get(root(i), d)) for i, (d, s) in enumerate(sets)), key=str)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def line_dedup(docs, edits, least, near=lambda a, b, k: abs(len(a) - len(b)) <= k and distance(a, b) <= k):
    """The texts after line dedup, in the order of docs."""
    seen, lost = [], {}
    unique = {(d, t): None for d, t in docs}
    for d, t in sorted(unique, key=lambda x: (x[0] is not None, x[0] or 0)):
        lines, out = (t or "").split("\n"), []
        for line in lines:
            if len(line) < least or not any(near(line, s, edits) for s in seen):
                out.append(line)
            if len(line) >= least:
                seen.append(line)
        lost[d, t] = t if t is None else "\n".join(out)
    return [lost[x] for x in docs]
