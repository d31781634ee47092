"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import collections
import hashlib
import math
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
NO_ID = -(2**63)


def words(text):
    return WORD.findall(text or "")


def line_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    w = words(text)
    seen, repeats = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            repeats += line in seen
            seen.add(line)
    windows = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    covered = {q for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for q in range(k, k + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), repeats, len(covered)


def substring_dedup(rows, window=20):
    docs = [(NO_ID if i is None else i, words(t)) for i, t in rows]
    first = {}
    for i, w in docs:
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            first[key] = min(first.get(key, (i, p)), (i, p))
    out = []
    for (given, _), (i, w) in zip(rows, docs):
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < (i, p):
                gone[p : p + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((given, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def jaccard_components(rows, shingle=5, percent=80):
    sets = []
    for i, t in rows:
        w = words((t or "").translate(LOWER))
        pieces = [tuple(w[k : k + shingle]) for k in range(len(w) - shingle + 1)] if len(w) >= shingle else [tuple(w)] if w else []
        sets.append((NO_ID if i is None else i, frozenset(pieces)))
    ids = collections.defaultdict(list)
    for i, s in sets:
        ids[s].append(i)
    keys = [s for s in ids if s]
    root = {s: s for s in keys}

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    for k, a in enumerate(keys):
        for b in keys[:k]:
            both = len(a & b)
            if 100 * both >= percent * (len(a) + len(b) - both):
                root[find(a)] = find(b)
    lowest = {}
    for s in keys:
        r = find(s)
        lowest[r] = min(lowest.get(r, min(ids[s])), min(ids[s]))
    real = lambda i: None if i == NO_ID else i
    return [(real(i), len(s), real(lowest[find(s)] if s else i)) for i, s in sets]


def backoff(rows, order=3, alpha=0.4):
    texts = [words(t) for _, t in rows]
    grams = lambda w, k: collections.Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    own = [{k: grams(w, k) for k in range(1, order + 1)} for w in texts]
    all_of = {k: sum((o[k] for o in own), collections.Counter()) for k in range(1, order + 1)}
    total, out = sum(map(len, texts)), []
    for (i, _), w, mine in zip(rows, texts, own):
        others = lambda g: all_of[len(g)][g] - mine[len(g)][g]  # noqa: E731, B023
        score, unseen = 0.0, 0
        for p in range(len(w)):
            for k in range(min(order, p + 1), 0, -1):
                gram = tuple(w[p - k + 1 : p + 1])
                if others(gram) > 0:
                    context = others(gram[:-1]) if k > 1 else total - len(w)
                    score += math.log(others(gram) / context) + (order - k) * math.log(alpha)
                    break
            else:
                score += math.log(alpha**order * 0.5 / max(1, total - len(w)))
                unseen += 1
        out.append((i, len(w), unseen, score))
    return out


def edit_distance_to_run(item, text):
    """Smallest edit distance of ``item`` to any run of ``text``, both lists of tokens."""
    best = [0] * (len(text) + 1)
    for k, token in enumerate(item, 1):
        row = [k]
        for j, other in enumerate(text, 1):
            row.append(min(best[j - 1] + (token != other), best[j] + 1, row[j - 1] + 1))
        best = row
    return min(best)


def merkle_tamper(rows):
    """tamper_check over (doc_id, source, lang, n_chars, text) rows."""
    import zlib

    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    leaf = lambda r: digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([digest("".join(out[-1][k : k + 3])) for k in range(0, len(out[-1]), 3)])
        return out

    def steps(tree, k):
        for nodes in tree[:-1]:
            first = k // 3 * 3
            yield "".join(nodes[first:k]), "".join(nodes[k + 1 : first + 3])
            k //= 3

    by_source = collections.defaultdict(list)
    for r in rows:
        by_source[r[1]].append((r[0], leaf(r), r))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        by_source[s].sort(key=lambda e: (e[0] is not None, e[0] or 0, e[1]))
    trees = {s: levels([e[1] for e in by_source[s]]) for s in sources}
    top = levels([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for at, (i, own, r) in enumerate(by_source[s]):
            path = [*steps(trees[s], at), *steps(top, k)]
            h = own
            if i is not None and r[4] is not None and zlib.crc32(str(i).encode()) % 2 == 0:
                h = leaf((*r[:4], r[4].replace("\n", "")))
            for left, right in path:
                h = digest(left + h + right)
            proof = digest("".join(a + b for a, b in path))
            out.append((i, own, trees[s][-1][0], top[-1][0], proof, h, h == top[-1][0]))
    return out


def resample(rows, targets, percent=5, min_words=20, buckets=10_000):
    import zlib

    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def features(text):
        w = word.findall((text or "").translate(LOWER))
        return len(w), [zlib.crc32(" ".join(w[p : p + k]).encode()) % buckets for k in (1, 2, 3) for p in range(len(w) - k + 1)]

    own = [(i, *features(t)) for i, t in rows]
    raw = collections.Counter(b for _, _, f in own for b in f)
    target = collections.Counter(b for t in targets for b in features(t)[1])
    all_raw, all_target = raw.total(), target.total()
    gain = lambda b: math.floor(1000 * math.log((target[b] + 1) * (all_raw + buckets) / ((raw[b] + 1) * (all_target + buckets))))
    out = []
    for i, n, f in own:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        out.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))])
    able = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return [(r[0], *r[2:], rank.get(id(r))) for r in out]
