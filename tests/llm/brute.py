"""Plain, slow versions of the corpus operators."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, width):
    w = words(lower(text))
    if len(w) >= width:
        return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)}
    return {tuple(w)} if w else set()


def near(docs, width, per_cent):
    """docs: [(doc_id, text)]; gives {doc_id: (n, component)}."""
    sets = {d: shingles(t, width) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= per_cent * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {d: (len(sets[d]), find(d)) for d in ids}


def features(text):
    w, t = words(text), text or ""
    lines = [x for x in t.split("\n") if WORD.search(x)]
    c = Counter(zip(w, w[1:], w[2:]))
    hit = {i + j for i in range(len(w) - 2) if c[tuple(w[i:i + 3])] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(hit), t.count("\n") + 1


def keeps(text):
    n, chars, symbols, dup, rep, lines = features(text)
    base = n < 50 or 100 * rep > 50 * n
    return not base and 2 * n <= chars <= 15 * n and 10 * symbols <= 3 * n and 2 * dup <= lines


def passages(docs, width):
    """{(doc_id, text): (n, removed places)}; a null doc_id is behind all others."""
    order = lambda d: (d is None, d or 0)
    first = {}
    for d, t in docs:
        w = words(t)
        for i in range(len(w) - width + 1):
            k = tuple(w[i:i + width])
            first[k] = min(first.get(k, order(d)), order(d))
    out = {}
    for d, t in docs:
        w = words(t)
        out[d, t] = len(w), {i + j for i in range(len(w) - width + 1) if first[tuple(w[i:i + width])] < order(d) for j in range(width)}
    return out


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def lines(docs, min_chars):
    """{(doc_id, place)} of the lines to take out; doc_ids are unique."""
    at = [(d, i, x) for d, t in sorted((d, t) for d, t in docs if t is not None) for i, x in enumerate(t.split("\n")) if WORD.search(x)]
    out = set()
    for k, (d, i, x) in enumerate(at):
        for _, _, y in at[:k]:
            if x == y or min(len(x), len(y)) >= min_chars and abs(len(x) - len(y)) < 2 and edits(x, y) < 2:
                out.add((d, i))
                break
    return out


def leak(item, text):
    """Smallest number of word edits between the item and any stretch of the text."""
    plain = lambda s: re.findall(r"[a-z0-9\x80-\U0010ffff]+", (s or "").lower())
    a, b = plain(item), plain(text)
    row = [0] * (len(b) + 1)
    for x in a:
        new = [row[0] + 1]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row), len(a)


def targets(sizes, weights=(5, 2, 1), cap=3):
    """Reshare what is above the caps again and again until nothing is."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = float(sum(sizes.values())), set(order), {}
    while True:
        total = sum(w[s] for s in free)
        full = [s for s in free if left * w[s] / total > cap * sizes[s]] if free else []
        if not full:
            return out | {s: left * w[s] / total for s in free}
        for s in full:
            out[s] = float(cap * sizes[s])
        free -= set(full)
        left -= sum(out[s] for s in full)


def number(text, digits):
    return int(hashlib.md5(text.encode()).hexdigest()[:digits], 16)


def mixture(docs):
    """docs: [(doc_id, source, size, tie)], unique doc_ids; gives {doc_id: copies}."""
    key = lambda x: "n" if x is None else f"s{x}"
    by = defaultdict(list)
    for d, s, n, tie in docs:
        by[s].append((n, number(key(d), 8) % 4096, d, tie))
    sizes = {s: sum(x[0] for x in rows) for s, rows in by.items()}
    goal, out = targets(sizes), {}
    for s, rows in by.items():
        rate = int(goal[s] / sizes[s] * (1 << 24)) if sizes[s] else 0
        at = number("mix|" + key(s), 6)
        for _, _, d, _ in sorted(rows):
            out[d] = (at + rate >> 24) - (at >> 24)
            at += rate
    return out, goal, sizes
