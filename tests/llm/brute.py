"""Plain-loop versions of the operators, for small fixtures."""

from __future__ import annotations

import collections
import hashlib
import math
import re

LOWER = {i: i + 32 for i in range(65, 91)}
WORD = r"[^\x20\x09-\x0D]+"


def words(text):
    return re.findall(WORD, text or "")


def rule_counts(text):
    text = text or ""
    found = words(text)
    windows = collections.defaultdict(list)
    for i in range(len(found) - 2):
        windows[tuple(found[i : i + 3])].append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if words(line):
            repeated += line in seen
            seen.add(line)
    n = len(found)
    failed = n < 50 or 100 * len(covered) > 50 * n
    symbols = sum(c in "#*$%&|<>" for c in text)
    return n, sum(map(len, found)), symbols, repeated, len(covered), failed


def repeated_bytes(docs):
    """(doc_id, bytes, removed, spans, digest) by every window of 100 bytes."""
    seen, out = set(), []
    for doc, text in sorted(docs):
        body = (text or "").encode()
        gone = bytearray(len(body))
        for i in range(len(body) - 99):
            window = body[i : i + 100]
            if window in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(window)
        runs = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(b for b, g in zip(body, gone, strict=True) if not g)
        out.append((doc, len(body), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def shingle_set(text):
    found = words((text or "").translate(LOWER))
    if not found:
        return frozenset()
    if len(found) < 3:
        return frozenset([tuple(found)])
    return frozenset(tuple(found[i : i + 3]) for i in range(len(found) - 2))


def linked_groups(docs):
    sets = {doc: shingle_set(text) for doc, text in docs}
    parent = {doc: doc for doc in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            one, two = sets[a], sets[b]
            if one and two and 100 * len(one & two) >= 90 * len(one | two):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return [(doc, len(sets[doc]), root(doc)) for doc in ids]


KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text):
    """Counts by kind, and the joined base spans."""
    spans, counts = [], []
    for rank, (kind, pattern) in enumerate(KINDS):
        n = 0
        for match in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", match.group())
            if kind == "ip":
                fine = all(int(part) <= 255 for part in match.group().split("."))
            elif kind == "card":
                fine = 12 <= len(digits) <= 19 and luhn(digits)
            elif kind == "phone":
                fine = 9 <= len(digits) <= 15
            else:
                fine = True
            if fine:
                n += 1
                spans.append((match.start(), rank, f"{kind}:{match.start()}:{match.end()}"))
        counts.append(n)
    return (*counts, ",".join(s[2] for s in sorted(spans)))


def kneser_ney(train, texts):
    """(tokens, known, N, base, score) of each text under a bigram model of the training texts."""

    def tokens(text):
        return words((text or "").translate(LOWER)) + ["\n"]

    count, pairs, context = collections.Counter(), collections.Counter(), collections.Counter()
    for text in train:
        row = tokens(text)
        count.update(row)
        for v, w in zip([None, *row], row, strict=False):
            pairs[v, w] += 1
            context[v] += 1
    total, kinds = sum(count.values()), len(count)

    def discount(numbers):
        n = [sum(c == k for c in numbers) for k in (1, 2, 3, 4)]
        if min(n) == 0:
            return [0, 0.5, 0.75, 0.75]
        y = n[0] / (n[0] + 2 * n[1])
        raw = [k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3)]
        return [0, *(min(max(d, 0.05), k + 0.95) for k, d in enumerate(raw))]

    ahead = collections.Counter(w for _, w in pairs)
    high, low = discount(pairs.values()), discount(ahead.values())
    rest = sum(low[min(a, 3)] for a in ahead.values()) / len(pairs) if pairs else 1.0
    follow = collections.defaultdict(float)
    for (v, _), c in pairs.items():
        follow[v] += high[min(c, 3)]

    def lower(w):
        own = max(ahead[w] - low[min(ahead[w], 3)], 0) / len(pairs) if pairs else 0.0
        return own + rest / (kinds + 1)

    def probability(v, w):
        if not context[v]:
            return lower(w)
        c = pairs[v, w]
        return max(c - high[min(c, 3)], 0) / context[v] + follow[v] / context[v] * lower(w)

    out = []
    for text in texts:
        row = tokens(text)
        base = sum(math.log10((count[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in row)
        score = sum(math.log10(probability(v, w)) for v, w in zip([None, *row], row, strict=False))
        out.append((len(row), sum(count[w] > 0 for w in row), total, base, score))
    return out
