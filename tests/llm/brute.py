"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
NORMAL = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def components(ids, links) -> dict:
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def near_duplicates(docs, shingle, percent):
    sets = {}
    for i, text in docs:
        w = SPACED.findall(lower(text or ""))
        sets[i] = {tuple(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))} if w else set()
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    comp = components(ids, links)
    return sorted((i, len(sets[i]), comp[i], comp[i] == i) for i in ids)


def repeats_removed(docs, size):
    words = [SPACED.findall(t or "") for _, t in docs]
    starts = Counter(tuple(w[k : k + size]) for w in words for k in range(len(w) - size + 1))
    out = []
    for (i, _), w in zip(docs, words, strict=True):
        hit = [False] * len(w)
        for k in range(len(w) - size + 1):
            if starts[tuple(w[k : k + size])] > 1:
                hit[k : k + size] = [True] * size
        kept = [x for x, h in zip(w, hit, strict=True) if not h]
        out.append((i, len(w), sum(hit), " ".join(kept)))
    return sorted(out)


def contamination(docs, items, size):
    windows = defaultdict(set)
    for item, text in items:
        w = NORMAL.findall(lower(text or ""))
        if w:
            for k in range(max(1, len(w) - size + 1)):
                windows[tuple(w[k : k + size])].add(str(item))
    out = []
    for i, text in docs:
        w = NORMAL.findall(lower(text or ""))
        hit, ids = set(), set()
        for g, names in windows.items():
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    ids |= names
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def targets(sizes, weights, most=3):
    """What each source should give: shares by weight of the sum of all sizes, none above most times its size."""
    out, left, rest = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while left:
        share = rest / sum(weights[i] for i in left)
        over = {i for i in left if share * weights[i] > most * sizes[i]}
        if not over:
            return [share * weights[i] if i in left else x for i, x in enumerate(out)]
        for i in over:
            out[i] = float(most * sizes[i])
        rest, left = rest - sum(out[i] for i in over), left - over
    return out


def mix(draws, weights, most=3, temper=0.5):
    """(doc_id, size, source_size, target, taken) of rows (doc_id, text, source, u): documents sorted by rank, up to the words that are left, and the one that closes the gap best."""
    sized = [(i, text, s, len(SPACED.findall(text or "")), u) for i, text, s, u in draws]
    names = sorted({s for _, _, s, _, _ in sized}, key=lambda s: (s is None, (s or "").encode()))
    words = {n: sum(x[3] for x in sized if x[2] == n) for n in names}
    want = dict(zip(names, targets([words[n] for n in names], [weights[k % len(weights)] for k in range(len(names))], most), strict=True))
    out = []
    for n in names:
        rows = [x for x in sized if x[2] == n]
        whole = int(want[n] // words[n]) if words[n] else 0
        left, power = want[n] - whole * words[n], sum(x[3] ** (1 + temper) for x in rows)
        p = [min(1.0, left / power * x[3] ** temper) if power else 0.0 for x in rows]
        rank = {k: x[4] / (1 - x[4]) * (1 - p[k]) / p[k] for k, x in enumerate(rows) if x[3] and p[k] > 0}
        groups = defaultdict(list)  # rows that repeat are taken together
        for k in rank:
            groups[rank[k], str(rows[k][0]), rows[k][1]].append(k)
        taken, got, rest = set(), 0, []
        for g in sorted(groups):
            size = sum(rows[k][3] for k in groups[g])
            if not rest and got + size <= left:
                taken |= set(groups[g])
                got += size
            else:
                rest.append(g)
        closing = [(abs(left - got - rows[groups[g][0]][3]), g) for g in rest if abs(left - got - rows[groups[g][0]][3]) < left - got]
        if closing:
            taken |= set(groups[min(closing)[1]])
        out += [(x[0], x[3], words[n], round(want[n], 6), x[3] * (whole + (k in taken)) if x[3] else 0) for k, x in enumerate(rows)]
    return out


def code_length(texts, text, order=3):
    """Bits of a text (bytes) in a context tree of the texts: the longest context first, an escape of kinds / (total + kinds) where a byte is new to it, 8 bits at last."""
    import math

    follows = defaultdict(Counter)
    for t in texts:
        padded = [None] * order + list(t)
        for i in range(order, len(padded)):
            for k in range(order + 1):
                follows[tuple(padded[i - k : i])][padded[i]] += 1
    bits, padded = 0.0, [None] * order + list(text)
    for i in range(order, len(padded)):
        for k in range(order, -1, -1):
            seen = follows.get(tuple(padded[i - k : i]))
            if seen and padded[i] in seen:
                bits -= math.log2(seen[padded[i]] / (seen.total() + len(seen)))
                break
            if seen:
                bits -= math.log2(len(seen) / (seen.total() + len(seen)))
        else:
            bits += 8
    return bits


def trie(sequences: dict) -> set:
    """Nodes of {conv_id: [(role, text)]}, as prefix_trie gives them."""
    members = defaultdict(list)
    for conv, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)

    def sums(node):
        below = [sums(x) for x in children[node]]
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        return (sum(x[0] for x in below) or 1, own + sum(x[1] for x in below))

    out = set()
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in convs if len(sequences[c]) == len(node)))
        leaves, saved = sums(node)
        out.add((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children[node]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def divergence(docs, least=10, top=10) -> set:
    """Rows of (text, lang, source), as divergence.audit gives them."""
    docs = [tuple(x or "" for x in d) for d in docs]
    n, df = defaultdict(Counter), defaultdict(Counter)
    groups = {(lang, source) for _, lang, source in docs}
    for text, lang, source in docs:
        words = TERM.findall(lower(text))
        n[lang, source].update(words)
        df[lang].update(set(words))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, c in df[lang].items() if c >= least]
        mine = sorted(s for g, s in groups if g == lang)

        def rates(count, kept=kept):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p = {s: rates(n[lang, s]) for s in mine}
        q = rates(sum((n[lang, s] for s in mine), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in mine:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in mine if o != s]
            terms = [(-f(p[s][t], q[t]), t.encode(), t) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, item, -v, r) for r, (v, _, item) in enumerate(items, 1)}
    return out
