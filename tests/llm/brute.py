"""Brute-force versions of the contracts, one document at a time in plain Python."""

import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANK = " \t\n\x0b\x0c\r"
ASCII = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def substring(docs, width=13):
    starts = {}
    words = [(d, WORD.findall(t or "")) for d, t in docs]
    for d, w in words:
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            starts[k] = min(starts.get(k, d), d)
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - width + 1):
            if starts[tuple(w[i : i + width])] < d:
                gone.update(range(i, i + width))
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return sorted(out)


def lines(docs, least=10):
    held = defaultdict(set)
    key = lambda x: x.strip(BLANK).translate(ASCII)
    for d, t in docs:
        for x in (t or "").split("\n"):
            held[key(x)].add(d)
    out = []
    for d, t in docs:
        ls = (t or "").split("\n")
        kept = [x for x in ls if not (len(key(x)) >= least and min(held[key(x)]) < d)]
        out.append((d, len(ls), len(ls) - len(kept), sha("\n".join(kept))))
    return sorted(out)


def exact(docs):
    norm = [(d, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for d, t in docs]
    groups = defaultdict(list)
    for d, t in norm:
        groups[t].append(d)
    return sorted((d, min(groups[t]), len(groups[t]), d == min(groups[t]), sha(t)) for d, t in norm)


def shingles(text, width=5):
    w = WORD.findall((text or "").translate(ASCII))
    if not w:
        return frozenset()
    if len(w) < width:
        return frozenset([tuple(w)])
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1))


def jaccard(docs):
    sets = [(d, shingles(t)) for d, t in docs]
    top = {d: d for d, _ in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    by = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for x in s:
            by[x].append(i)
    for i, (d, s) in enumerate(sets):
        common = defaultdict(int)
        for x in s:
            for j in by[x]:
                if j > i:
                    common[j] += 1
        for j, n in common.items():
            if 100 * n >= 80 * (len(s) + len(sets[j][1]) - n):
                a, b = sorted((find(d), find(sets[j][0])))
                top[b] = a
    return sorted((d, len(s), find(d)) for d, s in sets)


def rules(docs):
    out = []
    for d, t in docs:
        t = t or ""
        w = WORD.findall(t)
        seen, dup = set(), 0
        for x in t.split("\n"):
            if WORD.search(x):
                dup += x in seen
                seen.add(x)
        at = defaultdict(list)
        for i in range(len(w) - 2):
            at[tuple(w[i : i + 3])].append(i)
        covered = {i + k for p in at.values() if len(p) > 1 for i in p for k in range(3)}
        n, r = len(w), len(covered)
        out.append((d, n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, r, n < 50 or 100 * r > 50 * n))
    return sorted(out)


def licenses(docs):
    """Base columns: phrases whose words stand consecutively, whatever is between them."""
    phrases = {("under", "the", "mit", "license"): "mit", ("apache", "license", "version", "2"): "apache-2", ("cc", "by", "nc"): "cc-by-nc"}
    out = []
    for d, t in docs:
        w = re.findall("[0-9a-z\x80-\U0010ffff]+", (t or "").translate(ASCII))
        at = [(i, label) for p, label in phrases.items() for i in range(len(w)) if tuple(w[i : i + len(p)]) == p]
        places = [i for i, _ in at] or [-1]
        out.append((d, len(w), len(at), min(places), max(places), ",".join(sorted({x for _, x in at}))))
    return sorted(out)


def bpe(docs):
    import base64

    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = [(d, enc.encode_ordinary(t or ""), t or "") for d, t in docs]
    return sorted((d, len(x), sha(",".join(map(str, x))), sha(t)) for d, x, t in ids)


def lm(docs, target, prior=4.0, shared=1000.0):
    """(doc_id, n_tokens, target loss, background loss): each document against the counts of all others."""
    import math
    from collections import Counter

    words = [(d, WORD.findall((t or "").translate(ASCII))) for d, t in docs]
    every, near = Counter(), Counter()
    for d, w in words:
        grams = Counter(w) + Counter(zip(w, w[1:], strict=False))
        every += grams
        if d in target:
            near += grams
    n_every, n_near = sum(len(w) for _, w in words), sum(len(w) for d, w in words if d in target)
    types, scale = len({x for _, w in words for x in w}), n_near / n_every if n_near else 1.0
    out = []
    for d, w in words:
        own = Counter(w) + Counter(zip(w, w[1:], strict=False))
        loss = [0.0, 0.0]
        e = lambda g: every[g] - own[g]
        t = lambda g: near[g] - (own[g] if d in target else 0)
        for i, x in enumerate(w):
            wide = (e(x) + 1) / (n_every + types)
            one = (t(x) + shared * wide) / (n_near + shared)
            p, q = one, wide
            if i:
                pair = (w[i - 1], x)
                p = (t(pair) + prior * one) / (t(w[i - 1]) + prior)
                q = (scale * e(pair) + prior * wide) / (scale * e(w[i - 1]) + prior)
            loss[0] -= math.log(p)
            loss[1] -= math.log(q)
        out.append((d, len(w), *(x / len(w) if w else None for x in loss)))
    return sorted(out, key=lambda r: r[0])


def template_labels(docs, templates, threshold=0.8):
    """(doc_id, labels, best containment) by lines and by every window from a template word on."""
    split = lambda t: re.findall("[0-9a-z\x80-\U0010ffff]+", t.translate(ASCII))
    out = []
    for d, t in docs:
        w, lines, got = split(t or ""), [set(split(x)) for x in (t or "").split("\n")], {}
        for label, text in templates:
            s, span = set(text.split()), len(text.split()) * 3 // 2
            need = -(-round(threshold * 100) * len(s) // 100)
            blocks = [x & s for x in lines] + [set(w[i : i + span]) & s for i, x in enumerate(w) if x in s]
            best = max(map(len, blocks), default=0)
            if best >= need:
                got[label] = max(got.get(label, 0), best / len(s))
        out.append((d, ",".join(sorted(got)), max(got.values(), default=0)))
    return sorted(out)


def mix(docs, weights=(3, 1, 2), seed="mix-1"):
    """(doc_id, size, source_size, target, taken) of (doc_id, text, source); ids are distinct."""
    from fractions import Fraction

    rows = [(d, len(WORD.findall(t or "")), s) for d, t, s in docs]
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    whole = {s: sum(n for _, n, x in rows if x == s) for s in sources}
    target, open_ = {}, list(sources)
    left = Fraction(3, 2) * sum(whole.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * whole[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = Fraction(2 * whole[s])
            left -= target[s]
            open_.remove(s)
    out = []
    for s in sources:
        budget, run = int(target[s] + Fraction(1, 2)), 0
        for _, d, n in sorted((hashlib.md5(f"{seed}|{d}".encode()).hexdigest(), d, n) for d, n, x in rows if x == s):
            taken = sum(max(0, min(n, budget - epoch * whole[s] - run)) for epoch in (0, 1))
            out.append((d, n, whole[s], float(target[s]), taken))
            run += n
    return sorted(out)


def pipeline(docs, kept):
    """(doc_id, n_tokens, ids) after the quality stage has left the ids ``kept`` of (doc_id, text, source)."""
    import base64

    import public_tokenizers as P
    import tiktoken

    docs = [(d, t, s) for d, t, s in docs if d in kept]
    key = lambda x: x.strip(BLANK).translate(ASCII)
    first = {}
    for d, t, _ in docs:
        for x in (t or "").split("\n"):
            first[key(x)] = min(first.get(key(x), d), d)
    docs = [(d, "\n".join(x for x in (t or "").split("\n") if len(key(x)) < 10 or first[key(x)] == d), s) for d, t, s in docs]
    stays = {d for d, _, c in jaccard([(d, t) for d, t, _ in docs]) if d == c}
    docs = [x for x in docs if x[0] in stays]
    times = {d: -(-taken // n) if taken else 0 for d, n, _, _, taken in mix(docs)}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return sorted((d, s, len(ids := enc.encode_ordinary(t)), tuple(ids)) for d, t, s in docs for _ in range(times[d]))
