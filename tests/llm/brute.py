"""Plain versions of the operators on small inputs."""

from __future__ import annotations

import hashlib
import re

WHITE = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LAST = 2**63 - 1


def order(doc_id):
    return LAST if doc_id is None else doc_id


def removed_words(rows, window=50):
    """``[(doc_id, n_words, n_removed, kept_sha256)]`` of ``[(doc_id, text)]``."""
    first: dict = {}
    words = [WHITE.findall(t or "") for _, t in rows]
    for (doc_id, _), w in zip(rows, words, strict=True):
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            first[key] = min(first.get(key, LAST), order(doc_id))
    out = []
    for (doc_id, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < order(doc_id):
                gone[s : s + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((doc_id, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def shingles(text, size=5):
    w = WHITE.findall((text or "").translate(FOLD))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def components(rows, size=5, percent=80):
    """``[(doc_id, n_shingles, component_id)]``."""
    sets = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            same_id = rows[i][0] is not None and rows[i][0] == rows[j][0] and a and b
            if same_id or (a and b and 100 * len(a & b) >= percent * len(a | b)):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    low: dict = {}
    for i, (doc_id, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), LAST), order(doc_id))
    return [(d, len(s), None if low[find(i)] == LAST else low[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def contamination(rows, items, size=10):
    """``[(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)]``."""
    windows: dict = {}
    for item, text in items:
        w = LETTERS.findall((text or "").translate(FOLD))
        n = min(size, len(w))
        for s in range(len(w) - n + 1) if n and item is not None else ():
            windows.setdefault(tuple(w[s : s + n]), set()).add(str(item))
    lengths = {len(k) for k in windows}
    out = []
    for doc_id, text in rows:
        w = LETTERS.findall((text or "").translate(FOLD))
        hit, found = [False] * len(w), set()
        for n in lengths:
            for s in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[s : s + n]))) is not None:
                    hit[s : s + n] = [True] * n
                    found |= own
        out.append((doc_id, len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), any(hit)))
    return out


def segment(vocabulary, unknown, text):
    """Greatest score and ids of a text by dynamic programming over characters."""
    data = b" " + text.encode()
    look = {vocabulary.pieces[i]: i for i in vocabulary.normal}
    ends = [0, *(i for i in range(1, len(data) + 1) if i == len(data) or data[i] & 0xC0 != 0x80)]
    best, choice = {0: 0.0}, {}
    for at, i in enumerate(ends[1:], 1):
        before = ends[at - 1]
        best[i], choice[i] = best[before] + unknown, [int(vocabulary.byte_ids[b]) for b in data[before:i]]
        for j in (e for e in ends[:at] if i - e <= 64):
            piece = look.get(data[j:i])
            if piece is not None and best[j] + vocabulary.scores[piece] > best[i]:
                best[i], choice[i] = best[j] + vocabulary.scores[piece], [piece]
    out, i = [], len(data)
    while i:
        out = choice[i] + out
        i -= sum(len(vocabulary.pieces[x]) for x in choice[i])
    return best[len(data)], out
