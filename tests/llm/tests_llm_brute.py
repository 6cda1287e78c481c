"""Brute-force versions that several tests use."""

import hashlib
import re
from collections import defaultdict


def brute_decontaminate(texts, items, n=13):
    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = defaultdict(set)
    for i, t in items:
        w = low(t)
        for s in range(max(1, len(w) - n + 1) if w else 0):
            wins[tuple(w[s : s + n])].add(str(i))
    out = {}
    for d, t in enumerate(texts):
        w, hit, names = low(t), set(), set()
        for k in {len(x) for x in wins}:
            for s in range(len(w) - k + 1):
                if (x := tuple(w[s : s + k])) in wins:
                    hit |= set(range(s, s + k))
                    names |= wins[x]
        out[d] = (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def brute_components(texts, k):
    sets = []
    for t in texts:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return {i: (len(s), label[i], label[i] == i) for i, s in enumerate(sets)}
