"""The operators written down plainly, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def near_groups(rows):
    sets = {}
    for i, t in rows:
        w = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    holders = defaultdict(list)
    for i, s in sets.items():
        for e in s:
            holders[e].append(i)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in sets.items():
        common = defaultdict(int)
        for e in s:
            for o in holders[e]:
                if o < i:
                    common[o] += 1
        for o, n in common.items():
            if 100 * n >= 75 * (len(s) + len(sets[o]) - n) and (a := find(i)) != (b := find(o)):
                root[max(a, b)] = min(a, b)
    return {(i, len(s), find(i), find(i) == i) for i, s in sets.items()}


def without_repeats(rows, length):
    rows = sorted(((1 << 63 if i is None else i, i, (t or "").encode()) for i, t in rows), key=lambda r: r[0])
    first = {}
    for key, _, b in rows:
        for s in range(len(b) - length + 1):
            first.setdefault(b[s : s + length], key)
    out = []
    for key, i, b in rows:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if first[b[s : s + length]] < key:
                gone[s : s + length] = b"\1" * length
        left = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(g and (j == 0 or not gone[j - 1]) for j, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(left).hexdigest(), left.decode(errors="ignore")))
    return out


def leaks(rows, items):
    """(doc_id, item_id) where a window of as many shingles as the item has reaches the similarity."""

    def shingles(text):
        w = (text or "").lower().split()
        return [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []

    bags, found = {i: shingles(t) for i, t in items}, set()
    for doc_id, text in rows:
        s = shingles(text)
        have = set(s)
        for item, bag in bags.items():
            if not have.isdisjoint(bag):
                n, c = len(bag), Counter(bag)
                for at in range(max(1, len(s) - n + 1)):
                    both = sum((Counter(s[at : at + n]) & c).values())
                    if both / (len(s[at : at + n]) + n - both) >= 0.75:
                        found.add((doc_id, item))
                        break
    return found
