"""Plain Python versions of what SQL cannot say."""

from __future__ import annotations

import re


def shingle_set(text: str | None, k: int) -> frozenset:
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", lower) if w]
    k = min(k, len(words))
    return frozenset(tuple(words[i:i + k]) for i in range(len(words) - k + 1)) if words else frozenset()


def near_components(rows: list[tuple[int, str | None]], k: int, percent: int) -> dict[int, tuple[int, int]]:
    """doc_id -> (set size, smallest reachable id); every pair that shares a shingle is compared."""
    sets = {i: shingle_set(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    holders: dict = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    common: dict = {}
    for ids in holders.values():
        for n, a in enumerate(ids):
            for b in ids[n + 1:]:
                common[a, b] = common.get((a, b), 0) + 1
    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def repeated_bytes(texts: list[str | None], window: int) -> list[tuple[int, int, int, str]]:
    """(n_bytes, n_removed, n_spans, sha256 of the rest) of each text, every window in one table."""
    import hashlib

    rows = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for b in rows:
        for i in range(len(b) - window + 1):
            seen[b[i:i + window]] = seen.get(b[i:i + window], 0) + 1
    out = []
    for b in rows:
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if seen[b[i:i + window]] > 1:
                gone[i:i + window] = b"\1" * window
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        rest = bytes(c for c, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), spans, hashlib.sha256(rest).hexdigest()))
    return out


def base_secrets(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind."""
    t = text or ""
    name = r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    out = [(0, m.start(), m.end()) for m in re.finditer(name + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
    out += [(1, m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(2, m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return [(("assign", "access", "hex")[k], a, b) for k, a, b in sorted(out, key=lambda s: (s[1], s[0]))]


def viterbi(scores: list, moves: list) -> list[int]:
    """The best labels of a whole chain, begun and ended by label 0."""
    at, back = [scores[0][y] + moves[0][y] for y in range(3)], []
    for s in scores[1:]:
        ways = [max(range(3), key=lambda a: at[a] + moves[a][y]) for y in range(3)]
        at = [at[ways[y]] + moves[ways[y]][y] + s[y] for y in range(3)]
        back.append(ways)
    labels = [max(range(3), key=lambda y: at[y] + moves[y][0])]
    for ways in reversed(back):
        labels.append(ways[labels[-1]])
    return labels[::-1]


def ranked(docs: list[tuple], items: list[tuple], top: int = 10) -> list[tuple]:
    """(item_id, rank, doc_id, score) by scoring every document for every item."""
    import math
    split = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    bags = [(i, split(t)) for i, t in docs]
    n_docs, n_terms = sum(1 for _, w in bags if w), sum(len(w) for _, w in bags)
    df: dict = {}
    for _, w in bags:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    wanted: dict = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(split(t))
    out = []
    for item, terms in wanted.items():
        scored = []
        for i, w in bags:
            m = 10 + 90 * len(w) * n_docs // max(n_terms, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * w.count(t) // (1000 * w.count(t) + 8 * m))
                        for t in terms if t in df and t in w)
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(sorted(scored, key=lambda r: (r[0], r[1], r[2] or 0))[:top])]
    return out
