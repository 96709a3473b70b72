"""Plain-Python versions of the operators' definitions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def groups(nodes, links):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    least = {}
    for n in nodes:
        least[top(n)] = min(least.get(top(n), n), n)
    return {n: least[top(n)] for n in nodes}


def shingles(text):
    w = WORD.findall(text or "")
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near(docs, least=0.8):
    """doc_id -> smallest id of its group."""
    sets = {i: shingles(t) for i, t in docs}
    by = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            by[x].add(i)
    links = []
    for i, s in sets.items():
        for j, same in Counter(j for x in s for j in by[x] if j > i).items():
            if same >= least * (len(s) + len(sets[j]) - same) - 1e-9:
                links.append((i, j))
    return groups(sets, links)


def repeats(docs, n=200):
    """doc_id -> (n_bytes, n_removed, n_spans, hash of what is kept)."""
    count = Counter()
    raw = {i: (t or "").encode() for i, t in docs}
    for b in raw.values():
        count.update(b[k : k + n] for k in range(len(b) - n + 1))
    out = {}
    for i, b in raw.items():
        gone = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if count[b[k : k + n]] > 1:
                gone[k : k + n] = b"\1" * n
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def quality(text):
    t = text or ""
    w = WORD.findall(t)
    at = defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    inside = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(8)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(inside), n < 20 or 100 * len(inside) > 30 * n


def base_spans(text):
    t, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append((m.start(), 0, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m.group() if c.isdigit()]
        if 12 <= len(d) <= 19 and sum((v * 2 - 9 if v > 4 else v * 2) if k % 2 else v for k, v in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((m.start(), 3, "phone", m.end()))
    return [(k, a, b) for a, _, k, b in sorted(out)]


def targets(sizes, weights=(3, 1, 2), budget=1.5, cap=2.0):
    """source -> target, by sharing the excess again and again."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    left, free, out = budget * sum(sizes.values()), set(order), {}
    while free:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
            free.remove(s)
    return out


def banded(text, part, diagonal, band):
    """(matched, first word + band - diagonal, last word + 1, last place in the part) of the best local alignment in a band:
    a match counts 2, any other step -1; of equal scores the first end, then more matches, then the later start."""
    before, top, best = {}, 0, (0, 0, 0, 0)
    for i, word in enumerate(part):
        now = {}
        for c in range(2 * band + 1):
            j = diagonal + i - band + c
            if not 0 <= j < len(text):
                continue
            score, matched, first = before.get(c, (0, 0, i + c))
            same = text[j] == word
            ways = [(score + (2 if same else -1), matched + same, first)]
            ways += [(s - 1, m, f) for side, k in ((before, c + 1), (now, c - 1)) if k in side for s, m, f in [side[k]]]
            if max(ways)[0] > 0:
                now[c] = max(ways)
        if now and max(v[0] for v in now.values()) > top:
            top = max(v[0] for v in now.values())
            c = min(k for k, v in now.items() if v[0] == top)
            best = (now[c][1], now[c][2], diagonal + i - band + c + 1, i)
        before = now
    return best


def corpus(seed=3, n=120):
    """Small documents with copies, near copies, shared passages, repeated lines and odd cases."""
    r = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(400)] + ["über", "naïve", "𝒳", "日本"]
    text = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    shared, line = text(70), text(12)
    docs = []
    for i in range(n):
        t = text(r.choice([3, 30, 80, 200]))
        if i % 7 == 1 and docs:
            t = docs[-1][1]
        elif i % 7 == 2 and docs and docs[-1][1]:
            w = docs[-1][1].split(" ")
            w[r.randrange(len(w))] = "edited"
            t = " ".join(w)
        elif i % 9 == 3:
            t += "\n" + shared + "\n" + text(20)
        elif i % 11 == 4:
            t += ("\n" + line) * 4
        docs.append((i, t))
    docs += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "ab " * 4000), (n + 4, "x" * 5000), (n + 5, "x" * 5000 + "y"), (n + 6, text(30000)), (n + 7, "one two"), (n + 8, "two  one\n"), (n + 9, "one  two")]
    return docs
