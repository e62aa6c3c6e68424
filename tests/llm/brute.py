"""Plain versions of the operators' contracts, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


def plain(s):
    return re.findall(r"[^\x20\x09-\x0D]+", s or "")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def components(nodes, linked):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def similar(sets, share=75):
    """Pairs of keys whose sets have at least share % of their union in common."""
    holders = defaultdict(list)
    for k, s in sets.items():
        for x in s:
            holders[x].append(k)
    for k, s in sets.items():
        common = defaultdict(int)
        for x in s:
            for j in holders[x]:
                if j < k:
                    common[j] += 1
        for j, n in common.items():
            if 100 * n >= share * (len(s) + len(sets[j]) - n):
                yield j, k


def jaccard(docs):
    sets = {}
    for k, text in docs.items():
        w = plain(lower(text))
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    comp = components(docs, similar(sets))
    return {k: (len(sets[k]), comp[k]) for k in docs}


def lines(docs):
    """Line numbers that go from each document."""
    where = defaultdict(list)
    for k in sorted(docs):
        for n, line in enumerate((docs[k] or "").split("\n")):
            if line := line.strip(" \t\r\v\f"):
                where[line].append((k, n))
    comp = components(where, similar({x: {x[i : i + 8] for i in range(max(1, len(x) - 7))} for x in where}))
    first = {}
    for x, at in where.items():
        first[comp[x]] = min(first.get(comp[x], at[0]), *at)
    gone = {k: set() for k in docs}
    for x, at in where.items():
        for k, n in at:
            if (k, n) != first[comp[x]]:
                gone[k].add(n)
    return gone


def substrings(docs, window=13):
    first = {}
    for k in sorted(docs):
        w = plain(docs[k])
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), k)
    out = {}
    for k in docs:
        w = plain(docs[k])
        keep = [True] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < k:
                keep[i : i + window] = [False] * window
        out[k] = (len(w), keep.count(False), sha(" ".join(x for x, y in zip(w, keep, strict=True) if y)))
    return out


def contamination(docs, items, window=13):
    words = lambda s: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(s))
    found = defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            found[tuple(w[i : i + window])].add(item)
    out = {}
    for k, text in docs.items():
        w, hit, of = words(text), set(), set()
        for size in {len(x) for x in found}:
            for i in range(len(w) - size + 1):
                if x := found.get(tuple(w[i : i + size])):
                    hit |= set(range(i, i + size))
                    of |= x
        out[k] = (len(w), len(hit), len(of), sha(",".join(sorted(map(str, of)))), 0 < len(hit) and 20 * len(hit) >= len(w))
    return out


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def pii(text):
    out = []
    for k, (kind, pattern) in enumerate(PII.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255 or kind == "card" and not (14 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x for *_, x in sorted(out))
