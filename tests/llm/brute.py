"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import re
from collections import Counter, defaultdict


def components(nodes, links):
    parent = {n: n for n in nodes}

    def top(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return frozenset()
    k = min(k, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def near_duplicates(rows, k, num, den):
    """{doc_id: (n_shingles, component)} for rows of distinct ids."""
    sets = {d: shingles(t, k) for d, t in rows}
    links = [
        (a, b)
        for a in sets
        for b in sets
        if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])
    ]
    found = components(sets, links)
    return {d: (len(s), found[d]) for d, s in sets.items()}


def line_shingles(line):
    return frozenset([line]) if len(line) < 5 else frozenset(line[i : i + 5] for i in range(len(line) - 4))


def dedup_lines(rows):
    """{doc_id: text} for rows of distinct ids, kept first by id."""
    sets = {}
    for _, text in rows:
        for line in (text or "").split("\n"):
            line = line.lower().strip(" ")
            if line.strip():
                sets[line] = line_shingles(line)
    lines = list(sets)
    links = [
        (i, j)
        for i, a in enumerate(lines)
        for j in range(i)
        if 5 * len(sets[a] & sets[lines[j]]) >= 4 * len(sets[a] | sets[lines[j]])
    ]
    place = components(range(len(lines)), links)
    number = {line: place[i] for i, line in enumerate(lines)}
    seen, out = set(), {}
    for d, text in sorted(rows):
        if text is None:
            out[d] = None
            continue
        kept = []
        for line in text.split("\n"):
            norm = line.lower().strip(" ")
            if norm.strip():
                if number[norm] in seen:
                    continue
                seen.add(number[norm])
            kept.append(line)
        out[d] = "\n".join(kept)
    return out


def contamination(docs, items):
    """{doc_id: (n_words, n_hit, sorted ids)}."""
    low = {c: c + 32 for c in range(65, 91)}
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low))
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(len(w), 10)
        for s in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[s : s + n])].add(i)
    out = {}
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                found = windows.get(tuple(w[s : s + n]))
                if found:
                    hit.update(range(s, s + n))
                    ids |= found
        out[d] = (len(w), len(hit), sorted(str(i) for i in ids if i is not None))
    return out


def cosine_links(rows, threshold):
    """{vec_id: (n_links, component)} for rows (id, vector, label) of distinct ids."""
    import math

    def usable(v):
        return v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    good = [(i, v, lab) for i, v, lab in rows if lab is not None and usable(v)]
    links = []
    for i, v, lab in good:
        for j, w, other in good:
            if i < j and lab == other and len(v) == len(w):
                dot = sum(a * b for a, b in zip(v, w))
                if dot / math.sqrt(sum(a * a for a in v) * sum(b * b for b in w)) >= threshold:
                    links.append((i, j))
    degree = Counter(x for pair in links for x in pair)
    found = components([i for i, *_ in rows], links)
    return {i: (degree[i], found[i]) for i, *_ in rows}
