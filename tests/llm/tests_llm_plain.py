"""Plain versions of the pipeline's stages, for tests."""

import re
from collections import Counter

import xxhash


def fingerprint_of(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints):
    label = {i: i for i in prints}
    while True:
        new = {i: min(label[j] for j, q in prints.items() if (p ^ q).bit_count() <= 4) for i, p in prints.items()}
        if new == label:
            return label
        label = new


def leaked(text, item):
    shingles = lambda t: [tuple(t[i : i + 5]) for i in range(len(t) - 4)]
    a, b = shingles((text or "").lower().split()), shingles((item or "").lower().split())
    mine = Counter(b)
    if not b or not set(a) & set(b):
        return False
    for s in range(max(1, len(a) - len(b) + 1)):
        shared = sum((Counter(a[s : s + len(b)]) & mine).values())
        if shared >= 0.8 * (len(a[s : s + len(b)]) + len(b) - shared):
            return True
    return False


def spans_of(text):
    """The text with base spans replaced, and the spans."""
    found = []
    for kind, p in (("EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("IP", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("CARD", r"[0-9]([\x20-]?[0-9])+"), ("PHONE", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, text or ""):
            d = [int(c) for c in m[0] if c.isdigit()]
            luhn = sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(reversed(d))) % 10 == 0
            if kind == "EMAIL" or (kind == "IP" and all(int(x) <= 255 for x in m[0].split("."))) or (kind == "CARD" and 13 <= len(d) <= 19 and luhn) or (kind == "PHONE" and 9 <= len(d) <= 15):
                found.append((m.start(), -m.end(), kind))
    out, at = [], 0
    for s, e, kind in sorted(found):
        if s >= at:
            out += [text[at:s], f"[{kind}]"]
        at = max(at, -e)
    return "".join(out) + (text or "")[at:], found


def targets_of(docs):
    sizes = Counter()
    for source, n in docs.values():
        sizes[source] += n
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    full, total = {}, sum(sizes.values())
    while True:
        rest = {s: w for s, w in weight.items() if s not in full}
        left = total - sum(full.values())
        share = {s: left * w / sum(rest.values()) for s, w in rest.items()}
        over = {s: 3 * sizes[s] for s in rest if share[s] > 3 * sizes[s]}
        if not over:
            return {s: (sizes[s], (full | share)[s]) for s in sizes}
        full |= over
