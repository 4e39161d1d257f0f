"""Plain re-statements of the contracts, by other means than the operators use. Each takes dicts of id -> text."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import xxhash

WS = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lines(docs, min_chars=40, min_docs=5):
    holders = defaultdict(set)
    for i, t in docs.items():
        for x in (t or "").split("\n"):
            k = x.strip(WS).translate(LOWER)
            if len(k) >= min_chars:
                holders[k].add(i)
    out = {}
    for i, t in docs.items():
        all_ = (t or "").split("\n")
        kept = [x for x in all_ if len(h := holders.get(x.strip(WS).translate(LOWER), ())) < min_docs or max(h) == i]
        out[i] = (len(all_), len(all_) - len(kept), "\n".join(kept))
    return out


def base_counts(text):
    w = words(text)
    at = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = {j for i in range(len(w) - 7) if at[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for x in (text or "").split("\n"):
        if words(x):
            dup += x in seen
            seen.add(x)
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(inside), n < 20 or 100 * len(inside) > 30 * n


def shingles(text):
    w = words((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def near(docs):
    sets = {i: shingles(t) for i, t in docs.items()}
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    ids = sorted(i for i in docs if sets[i])
    by = defaultdict(list)
    for i in ids:
        for s in sets[i]:
            by[s].append(i)
    pairs = {p for v in by.values() for p in combinations(v, 2)}
    for a, b in pairs:
        x, y = sets[a], sets[b]
        if 100 * len(x & y) >= 75 * len(x | y):
            ra, rb = find(a), find(b)
            root[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), find(i)) for i in docs}


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def contaminated(docs, items):
    windows = defaultdict(set)
    for item, t in items.items():
        w = bench_words(t)
        k = min(13, len(w))
        for i in range(len(w) - k + 1) if w else ():
            windows[tuple(w[i : i + k])].add(item)
    out = {}
    lengths = {len(k) for k in windows}
    for d, t in docs.items():
        w, hit, found = bench_words(t), set(), set()
        for k in lengths:
            for i in range(len(w) - k + 1):
                if (own := windows.get(tuple(w[i : i + k]))) is not None:
                    hit.update(range(i, i + k))
                    found |= own
        out[d] = (len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit) and 20 * len(hit) >= len(w))
    return out


def warc(pages):
    payload = {i: (h or "").encode() for i, h in pages.items()}
    top = {}
    for i, p in payload.items():
        top[p] = max(i, top.get(p, i))
    return {i: (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if top[p] == i else "revisit", None if top[p] == i else top[p]) for i, p in payload.items()}


def fingerprint(text):
    w = words((text or "").translate(LOWER))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def components(ids, near):
    """The smallest id that a chain of near ids leads to; near(a, b) of two ids."""
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(ids), 2):
        if near(a, b):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in ids}


def vocabulary(docs):
    counts = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            at = h % len(run)
            counts[run if h % 199 else run[:at] + run[at + 1 :]] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def one_error(a, b):
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(counts):
    near = {w: [v for v in counts if one_error(w, v)] for w in counts}
    best = {w: min(vs, key=lambda v: (-counts[v], v), default=None) for w, vs in near.items()}
    form = {w: v if v is not None and counts[v] >= 5 * counts[w] else None for w, v in best.items()}

    def last(w):
        return w if form[w] is None else last(form[w])

    return {w: (form[w], last(w), counts[w], len(near[w]), counts.get(form[w])) for w in counts}
