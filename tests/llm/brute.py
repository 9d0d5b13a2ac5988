"""Plain Python versions of the corpus operators, used as the expected results in tests."""

from __future__ import annotations

import re

import xxhash


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def simhash(text, shingle=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text))
    if not words:
        return 0
    n = min(shingle, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + n]).encode(), 42) for i in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids_and_prints, distance=3):
    """doc_id -> smallest doc_id reachable."""
    prints = sorted({p for _, p in ids_and_prints})
    parent = {p: p for p in prints}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for i, a in enumerate(prints):
        for b in prints[i + 1:]:
            if (a ^ b).bit_count() <= distance:
                parent[root(a)] = root(b)
    least = {}
    for d, p in ids_and_prints:
        r = root(p)
        least[r] = min(least.get(r, d), d)
    return {d: least[root(p)] for d, p in ids_and_prints}


def decontaminate(text, items, window=13):
    """n_words, n_hit, sorted item ids as text, of one document against (item_id, text) pairs."""
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t))
    doc, hit, found = words(text), set(), set()
    for item_id, item in items:
        w = words(item)
        n = min(window, len(w))
        if not n:
            continue
        parts = {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}
        for s in range(len(doc) - n + 1):
            if tuple(doc[s:s + n]) in parts:
                hit.update(range(s, s + n))
                if item_id is not None:
                    found.add(str(item_id))
    return len(doc), len(hit), sorted(found)


def line_dedup(rows, width=3):
    """Text without repeated lines of every (doc_id, text), ids being unique and not missing."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        if text is None:
            out[doc_id] = None
            continue
        lines = text.split("\n")
        gone = set()
        for i in range(len(lines) - width + 1):
            part = tuple(lines[i:i + width])
            if not any(x.strip(" ") for x in part):
                continue
            if part in seen:
                gone.update(range(i, i + width))
            seen.add(part)
        out[doc_id] = text if not gone else "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def top_k(vectors, queries, k):
    """(query_id, rank, vec_id, score) rows."""
    out = set()
    for q, a in queries:
        scored = sorted(
            ((-sum(x * y for x, y in zip(a, b)), v) for v, b in vectors if v != q and len(a) == len(b)))[:k]
        out.update((q, i + 1, v, -s) for i, (s, v) in enumerate(scored))
    return out


def fisher_yates(n, draw):
    """The inside-out shuffle of 0 .. n-1; ``draw(i)`` is at most i."""
    out = []
    for i in range(n):
        j = draw(i)
        out.append(i)
        out[i], out[j] = out[j], i
    return out
