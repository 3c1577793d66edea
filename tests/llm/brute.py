"""Plain Python versions of the operators, for small tables."""

import hashlib
import re
from collections import defaultdict

import regex
import xxhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def simhash(text, shingle):
    words = words_of((text or "").translate(LOWER))
    shingles = [" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(n, linked):
    """Root (smallest place) of each of n places."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [find(x) for x in range(n)]


def remove_repeats(rows, window):
    """rows: (doc_id, text) -> (doc_id, n_words, n_removed, kept)."""
    least = {}
    for doc, text in rows:
        words = words_of(text)
        for i in range(len(words) - window + 1):
            x = tuple(words[i:i + window])
            if doc is not None and doc < least.get(x, doc + 1):
                least[x] = doc
    out = []
    for doc, text in rows:
        words = words_of(text)
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            x = tuple(words[i:i + window])
            if doc is not None and least[x] < doc:
                gone[i:i + window] = [True] * window
        kept = [w for w, g in zip(words, gone, strict=True) if not g]
        out.append((doc, len(words), sum(gone), " ".join(kept)))
    return out


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def pii(text):
    """(kind, start, end) of the agreed kinds."""
    found = []
    for place, (kind, pattern) in enumerate(PII.items()):
        for m in regex.finditer(pattern, text or ""):
            digits = re.sub(r"[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else None,
                "card": 12 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                found.append((m.start(), place, kind, m.end()))
    return [(k, s, e) for s, _, k, e in sorted(found)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def decontaminate(docs, items, window):
    """(doc_id, n_words, n_hit, n_items, items) per document."""
    grams = defaultdict(set)
    for item, text in items:
        terms = terms_of(text)
        for i in range(max(1, len(terms) - window + 1)) if terms else ():
            grams[tuple(terms[i:i + window])].add(item)
    sizes = {len(g) for g in grams}
    out = []
    for doc, text in docs:
        terms, hit, found = terms_of(text), set(), set()
        for size in sizes:
            for i in range(len(terms) - size + 1):
                if (g := tuple(terms[i:i + size])) in grams:
                    hit.update(range(i, i + size))
                    found |= grams[g]
        out.append((doc, len(terms), len(hit), len(found), ",".join(sorted(map(str, found)))))
    return out
