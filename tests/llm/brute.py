"""Plain versions of the operators' contracts, in Python, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def substring_dedup(docs):
    """docs: [(doc_id, text)] -> {doc_id: (n_words, n_removed, kept)}"""
    least = {}
    for i, t in docs:
        w = words(t)
        for a in range(len(w) - 12):
            k = tuple(w[a : a + 13])
            least[k] = min(least.get(k, i), i)
    out = {}
    for i, t in docs:
        w = words(t)
        gone = set()
        for a in range(len(w) - 12):
            if least[tuple(w[a : a + 13])] < i:
                gone.update(range(a, a + 13))
        out[i] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    return out


def shingles(text, k=4):
    w = words(lower(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[a : a + k]) for a in range(len(w) - k + 1)) or frozenset([tuple(w)])


def jaccard_components(docs, percent=85):
    """docs: [(doc_id, text)] -> {doc_id: (n_shingles, component)}"""
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    held = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            held[x].append(i)
    shared = Counter()
    for own in held.values():
        shared.update((a, b) for n, a in enumerate(own) for b in own[n + 1 :])
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def phrases(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    at, labels = [], set()
    for p, x in PHRASES.items():
        p = p.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                at.append(i)
                labels.add(x)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def licence_blocks(text, templates, containment):
    own, best = set(), 0.0
    for line in re.split(r"[\n\r]+|(?<=[.!?])[ \t]+", text or ""):
        w = set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(line)))
        for name, t in templates.items():
            t = set(t.split())
            if len(t & w) >= containment * len(t) - 1e-9:
                own.add(name)
                best = max(best, len(t & w) / len(t))
    return own, best


def token_pieces(text, tokenizer, sequence=2048):
    ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
    return [(i, len(x), zlib.crc32(b"".join(n.to_bytes(4, "little") for n in x)), len(ids)) for i in range(0, len(ids), sequence) for x in [ids[i : i + sequence]]]


def token_crc(text, tokenizer, start, length):
    """CRC-32 of some of a text's ids, and how many ids it has."""
    ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
    return zlib.crc32(b"".join(n.to_bytes(4, "little") for n in ids[start : start + length])), len(ids)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def source_rates(sizes, target, most=2):
    """Rates r = min(most, exp(m * size / scale)) with sum(r * size) = target, by halving."""
    scale = sum(x * x for x in sizes) / sum(sizes)
    rates = lambda m: [min(most, math.exp(min(50, m * x / scale))) if x else 0.0 for x in sizes]
    if target >= most * sum(sizes) * (1 - 1e-9):
        return [float(most) if x else 0.0 for x in sizes]
    low, high = -1e3, 1e6
    for _ in range(300):
        m = (low + high) / 2
        low, high = (m, high) if sum(r * x for r, x in zip(rates(m), sizes, strict=True)) < target else (low, m)
    return rates(low)


def slot_table(shards, slots, weights=None):
    """Every shard walks its own permutation of the slots and claims the next free one at its turn."""
    walks = []
    for s in shards:
        h = hashlib.sha256(s.encode()).digest()
        start, skip = int.from_bytes(h[:8], "big") % slots, int.from_bytes(h[8:16], "big") % (slots - 1) + 1
        walks.append(iter([(start + i * skip) % slots for i in range(slots)]))
    table = {}
    while len(table) < slots:
        for i, walk in enumerate(walks):
            for _ in range((weights or [1] * len(shards))[i]):
                if len(table) < slots:
                    table[next(x for x in walk if x not in table)] = i
    return [table[i] for i in range(slots)]


def languages(rows, names, text_logs, declared_trust, path_trust, host_weight, little):
    """rows: (declared, path, suffix, domain, host, evidence or None); -> [(language, confidence)]"""

    def said(x, trust):
        rest = math.log((1 - trust) / max(1, len(names) - 1))
        return [math.log(trust) if n == x else rest for n in names] if x in names else [0.0] * len(names)

    def posterior(logs):
        e = [math.exp(x - max(logs)) for x in logs]
        return [x / sum(e) for x in e]

    logs = [[a + b + c for a, b, c in zip(ev or [0.0] * len(names), said(d, declared_trust), said(p, path_trust), strict=True)] for d, p, _, _, _, ev in rows]
    counts = defaultdict(lambda: [0.0] * len(names))
    for (_, _, suffix, domain, host, ev), own in zip(rows, logs, strict=True):
        if ev is not None:
            for i, x in enumerate(posterior(own)):
                if x >= little:
                    for key in ((), (suffix,), (suffix, domain), (suffix, domain, host)):
                        counts[key][i] += x
    n = len(names)
    drawn = {(): [(x + 1) / (sum(counts[()]) + n) for x in counts[()]]}
    for depth in (1, 2, 3):
        for key in [k for k in counts if len(k) == depth]:
            drawn[key] = [(x + host_weight * above) / (sum(counts[key]) + host_weight) for x, above in zip(counts[key], drawn[key[:-1]], strict=True)]
    out = []
    for (_, _, suffix, domain, host, ev), own in zip(rows, logs, strict=True):
        prior = drawn.get((suffix, domain, host))
        final = posterior([a + (math.log(b) if prior else 0.0) for a, b in zip(own, prior or [1.0] * n, strict=True)])
        out.append((names[final.index(max(final))] if ev is not None else None, max(final)))
    return out
