"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
WINDOW = 13


def words(text):
    return WORD.findall(text or "")


def judge_url(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [
        (len(h) + len(p), len(h), v == "block", h + p, v)
        for h, p, v in rules
        if h is not None and p is not None and (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else default


def without_repeats(docs):
    """docs: (doc_id, text). Per row: words kept."""
    first = {}
    order = lambda i: float("inf") if i is None else i
    for i, text in docs:
        w = words(text)
        for a in range(len(w) - WINDOW + 1):
            key = tuple(w[a : a + WINDOW])
            first[key] = min(order(i), first.get(key, float("inf")))
    out = []
    for i, text in docs:
        w = words(text)
        gone = set()
        for a in range(len(w) - WINDOW + 1):
            if first[tuple(w[a : a + WINDOW])] < order(i):
                gone.update(range(a, a + WINDOW))
        out.append((i, len(w), len(gone), " ".join(x for a, x in enumerate(w) if a not in gone)))
    return out


def fingerprint(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_groups(docs, prints=None, bits=2):
    """docs: (doc_id, text). {index: (fingerprint, least id reachable)}."""
    prints = prints or [fingerprint(t) for _, t in docs]
    distinct = sorted(set(prints))
    parent = {p: p for p in distinct}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= bits:
                parent[root(a)] = root(b)
    ids = defaultdict(list)
    for (i, _), p in zip(docs, prints):
        if i is not None:
            ids[root(p)].append(i)
    return [(p, min(ids[root(p)], default=None)) for p in prints]


def counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w = words(text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)
