"""Plain-Python versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from itertools import combinations

BLANK = re.compile(r"[ \t-\r]+")


def words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in BLANK.split(lowered) if w]


def shingles(text, size):
    found = words(text)
    if not found:
        return set()
    width = min(size, len(found))
    return {tuple(found[k : k + width]) for k in range(len(found) - width + 1)}


def components(nodes, edges):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_duplicates(docs, size, percent):
    """docs: id -> text. Returns id -> component."""
    sets = {d: shingles(t, size) for d, t in docs.items()}
    edges = []
    for a, b in combinations(sorted(docs), 2):
        both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * either:
            edges.append((a, b))
    return components(docs, edges)


def exact(rows):
    """rows: (id, text). Returns one (id, keep, size, sha) per row."""
    bodies = [(i, BLANK.sub(" ", t or "")) for i, t in rows]
    groups = defaultdict(list)
    for i, body in bodies:
        groups[body].append(i)
    keep = {b: min((i for i in g if i is not None), default=None) for b, g in groups.items()}
    return [(i, keep[b], len(groups[b]), hashlib.sha256(b.encode()).hexdigest()) for i, b in bodies]


def clean_lines(rows, ratio, least):
    """rows: (id, host, text). Returns (id, n_lines, n_dropped, text) per row."""
    pages, seen = Counter(), Counter()
    for host, text in {(h, t) for _, h, t in rows}:
        pages[host] += 1
        for line in {x.strip(" \t\r") for x in (text or "").split("\n")} - {""}:
            seen[host, line] += 1
    bad = {k for k, n in seen.items() if n >= least and n > ratio * pages[k[0]]}
    out = []
    for i, host, text in rows:
        parts = (text or "").split("\n")
        kept = [x for x in parts if (host, x.strip(" \t\r")) not in bad]
        out.append((i, len(parts), len(parts) - len(kept), None if text is None else "\n".join(kept)))
    return out


def leaks(docs, items, size, share):
    """docs, items: (id, text) rows. Returns (doc, item, shingles, shared) rows."""
    out = []
    for item, item_text in items:
        wanted = shingles(item_text, size)
        if not wanted:
            continue
        width = len(next(iter(wanted)))
        for doc, text in docs:
            found = words(text)
            own = {tuple(found[k : k + width]) for k in range(len(found) - width + 1)}
            shared = len(wanted & own)
            if shared >= share * len(wanted) - 1e-9:
                out.append((doc, item, len(wanted), shared))
    return out


def mix(rows, weights=(5.0, 2.0, 1.0), share=1.5, seed="mix"):
    """rows: (id, source, text, quality weight). Returns source -> target and the copies per row."""
    sizes = [len([w for w in BLANK.split(t or "") if w]) for _, _, t, _ in rows]
    total = Counter()
    for (_, s, _, _), n in zip(rows, sizes):
        total[s] += n
    names = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, free, left = {}, set(names), share * sum(total.values())
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 2 * total[s]}
        if not full:
            target.update({s: level * weight[s] for s in free})
            break
        target.update({s: 2.0 * total[s] for s in full})
        left -= sum(2.0 * total[s] for s in full)
        free -= full
    copies = [0] * len(rows)
    for s in names:
        mine = [k for k, r in enumerate(rows) if r[1] == s]
        epochs = int(target[s] // total[s]) if total[s] else 0
        rest = target[s] - epochs * total[s]

        def key(k):
            text = "" if rows[k][0] is None else str(rows[k][0])
            u = (int(hashlib.md5(f"{seed}:{text}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            return (-math.log(u) / rows[k][3], rows[k][0] is None, rows[k][0] or 0, sizes[k])

        through = 0
        for k in sorted(mine, key=key):
            before, through = through, through + sizes[k]
            copies[k] = epochs + (through <= rest or (rest > before and through - rest < rest - before))
    return target, total, sizes, copies


class Ppm:
    """Order-4 PPM with escape method C and full exclusion, one symbol at a time."""

    def __init__(self, texts, order=4):
        self.order, self.counts = order, defaultdict(Counter)
        for text in texts:
            data = self.padded(text)
            for at in range(order, len(data)):
                for k in range(order + 1):
                    self.counts[data[at - k : at]][data[at]] += 1

    def padded(self, text):
        return b"\xfe" * self.order + (text or "").encode() + b"\xff"

    def score(self, text):
        data, total = self.padded(text), 0.0
        for at in range(self.order, len(data)):
            excluded: set[int] = set()
            for k in range(self.order, -1, -1):
                here = self.counts.get(data[at - k : at])
                if not here:
                    continue
                left = {s: c for s, c in here.items() if s not in excluded}
                n, t = sum(left.values()), len(left)
                if data[at] in left:
                    total += math.log10(left[data[at]] / (n + t))
                    break
                if n + t:
                    total += math.log10(t / (n + t))
                excluded |= set(here)
            else:
                total -= math.log10(max(1, 256 - len(excluded)))
        return total
