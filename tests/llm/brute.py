"""Plain single-machine versions of the operators."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, lower=True):
    return WORD.findall((text or "").translate(LOWER) if lower else text or "")


def shingles(text, k):
    w = words(text)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def near_duplicates(rows, k):
    """doc_id -> (shingles, smallest reachable)."""
    sets = {d: shingles(t, k) for d, t in rows if d is not None}
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def without_repeats(rows, length=200):
    """One (n_bytes, n_removed, n_spans, sha) per row; ``rows``: texts."""
    data = [(t or "").encode() for t in rows]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def quality_base(text):
    w = words(text, lower=False)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often = Counter(windows)
    covered = {j for i, x in enumerate(windows) if often[x] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    counts = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))
    return counts, counts[0] < 10 or 100 * counts[4] > 20 * counts[0]


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _fine(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(x) <= 255 for x in found.split("."))
    if kind == "card":
        d = [int(c) for c in reversed(digits)]
        return 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def pii_base(text):
    spans = [(m.start(), i, m.end(), k) for i, (k, p) in enumerate(PII.items()) for m in re.finditer(p, text or "") if _fine(k, m.group())]
    counts = Counter(k for *_, k in spans)
    spelled = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))
    return tuple(counts[k] for k in PII), hashlib.sha256(spelled.encode()).hexdigest()


def leaks(docs, items, length, differ):
    """(doc_id, item_id) whose words agree along some alignment, by looking at all of them."""
    out = set()
    for d, t in docs:
        w = words(t)
        at = defaultdict(list)
        for i, x in enumerate(w):
            at[x].append(i)
        for item, text in items:
            it = words(text)
            n = min(length, len(it))
            for shift in {p - k for k, x in enumerate(it) for p in at.get(x, ())}:
                same = [w[p] == it[p - shift] for p in range(max(0, shift), min(len(w), shift + len(it)))]
                if any(n - sum(same[a : a + n]) <= differ * n for a in range(len(same) - n + 1)):
                    out.add((d, item))
    return out


def smallest_capacity(sizes, shards):
    def fits(c):
        n, s = 1, 0
        for x in sizes:
            if x > c:
                return False
            if s + x > c:
                n, s = n + 1, 0
            s += x
        return n <= shards

    low, high = max(sizes), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


def crc(text):
    return zlib.crc32((text or "").encode())


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def merkle(rows, arity=3):
    """(doc_id, leaf, subroot, root, proof, folded root, verified) of rows (doc_id, source, lang, n_chars, text)."""

    def leaf(row):
        return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    def climb(nodes):
        levels = []
        while len(nodes) > 1:
            levels.append(nodes)
            nodes = [digest(*nodes[i : i + arity]) for i in range(0, len(nodes), arity)]
        return levels, nodes[0]

    def path(levels, i):
        for nodes in levels:
            low = i - i % arity
            yield nodes[low:i], nodes[i + 1 : low + arity]
            i //= arity

    by = defaultdict(list)
    for row in rows:
        by[row[1]].append(row)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {s: climb([leaf(r) for r in by[s]]) for s in sources}
    tops, root = climb([trees[s][1] for s in sources]) if sources else ([], None)
    out = []
    for k, s in enumerate(sources):
        levels, subroot = trees[s]
        for i, row in enumerate(by[s]):
            way = [*path(levels, i), *path(tops, k)]
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[4] is not None
            h = leaf((*row[:4], row[4].replace("\n", "")) if hit else row)
            for left, right in way:
                h = digest(*left, h, *right)
            out.append((row[0], leaf(row), subroot, root, digest(*(x for left, right in way for x in left + right)), h, h == root))
    return out


FEATURE_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def feature_crcs(text, most=3):
    w = FEATURE_WORD.findall((text or "").translate(LOWER))
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) for i in range(len(w)) for k in range(1, most + 1) if i + k <= len(w)]


def importance(rows, target, buckets=10_000):
    """(doc_id, n_features, weight, score, rank) of rows (doc_id, text)."""
    found = [(d, *feature_crcs(t)) for d, t in rows]
    s = Counter(c % buckets for _, _, f in found for c in f)
    t = Counter(c % buckets for x in target for c in feature_crcs(x)[1])
    n_s, n_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    out = []
    for d, n, f in found:
        weight = sum(math.floor(1000 * math.log((t[c % buckets] + 1) * n_s / ((s[c % buckets] + 1) * n_t))) for c in f)
        h = int(hashlib.sha256(f"42:{d}".encode()).hexdigest()[:8], 16)
        score = None if d is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([d, len(f), weight, score, None, n])
    fit = sorted((r for r in out if r[5] >= 20 and r[3] is not None), key=lambda r: (-r[3], r[0]))
    for i, r in enumerate(fit[: 5 * len(fit) // 100]):
        r[4] = i + 1
    return [tuple(r[:5]) for r in out]


def without_lines(texts, least=10, chars=1):
    """(kept text, n_lines, n_dropped) of each text."""

    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)

    parts = [(t or "").split("\n") for t in texts]
    seen = Counter(k for p in parts for k in {key(x) for x in p})
    kept = [[x for x in p if len(key(x)) < chars or seen[key(x)] < least] for p in parts]
    return [("\n".join(k), len(p), len(p) - len(k)) for k, p in zip(kept, parts)]
