"""Plain versions of the contracts, over a list of ``(doc_id, text)``; slow and obvious."""

import hashlib
import re
from collections import defaultdict

SPACE_WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def lower(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def passages(rows, width=50):
    words = [SPACE_WORDS.findall(text or "") for _, text in rows]
    smallest = {}
    for (doc, _), own in zip(rows, words):
        for i in range(len(own) - width + 1):
            key = tuple(own[i : i + width])
            smallest[key] = min(smallest.get(key, doc), doc)
    out = []
    for (doc, _), own in zip(rows, words):
        gone = set()
        for i in range(len(own) - width + 1):
            if smallest[tuple(own[i : i + width])] < doc:
                gone.update(range(i, i + width))
        out.append((doc, len(own), len(gone), sha(" ".join(w for i, w in enumerate(own) if i not in gone))))
    return sorted(out)


def substrings(rows, width=200):
    raw = [(text or "").encode() for _, text in rows]
    places = defaultdict(int)
    for data in raw:
        for i in range(len(data) - width + 1):
            places[data[i : i + width]] += 1
    out = []
    for (doc, _), data in zip(rows, raw):
        gone = bytearray(len(data))
        for i in range(len(data) - width + 1):
            if places[data[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((doc, len(data), sum(gone), spans, sha(bytes(c for c, g in zip(data, gone) if not g))))
    return sorted(out)


def near(rows, q=2, percent=80):
    sets = {}
    for doc, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        sets[doc] = {tuple(words[i : i + q]) for i in range(max(1, len(words) - q + 1))} if words else set()
    parent = {d: d for d in sets}

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d

    docs = sorted(sets)
    for i, a in enumerate(docs):
        for b in docs[i + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return [(d, len(sets[d]), find(d), d == find(d)) for d in docs]
