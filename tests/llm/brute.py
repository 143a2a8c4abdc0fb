"""Plain versions of the operators' base columns, row by row."""

import hashlib
import re
import zlib

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def quality(text):
    t = text or ""
    words = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    seen = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(8)}
    n = len(words)
    return {
        "n_words": n,
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in t),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "base_failed": n < 20 or 100 * len(covered) > 30 * n,
    }


def shingles(text):
    w = WORD.findall(lower(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near(rows):
    """doc_id -> (n_shingles, component_id, kept) of (doc_id, text) rows with distinct ids."""
    sets = {i: shingles(t) for i, t in rows}
    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    shared = {}
    for ids in holders.values():
        for k, a in enumerate(ids):
            for b in ids[:k]:
                shared[b, a] = shared.get((b, a), 0) + 1
    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}


PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def licenses(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    at = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return {
        "n_words": len(w),
        "n_base": len(at),
        "first_word": min((i for i, _ in at), default=None),
        "last_word": max((i for i, _ in at), default=None),
        "base_labels": ",".join(sorted({x for _, x in at})),
    }


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def digits(m):
    return re.sub("[^0-9]", "", m)


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
}


def pii(text):
    out, spans = {}, []
    for kind, (pattern, passes) in BASE.items():
        own = [(kind, m.start(), m.end()) for m in re.finditer(pattern, text or "") if passes(m[0])]
        out[f"n_{kind}"] = len(own)
        spans += own
    return out | {"base_sha256": hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()}, spans


def bpe(text, enc):
    ids = enc.encode_ordinary(text or "")
    return {"n_tokens": len(ids), "ids_sha256": hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), "decoded_sha256": hashlib.sha256((text or "").encode()).hexdigest()}


def token_pieces(text, tokenizer, size):
    ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
    first = len(ids) % size or size
    bounds = [0, *range(first, len(ids) + 1, size)]
    return [(k, s, e - s, zlib.crc32(ids[s:e].tobytes())) for k, (s, e) in enumerate(zip(bounds, bounds[1:]))]


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n


def unigrams(rows):
    """doc_id -> base columns of the language-model query."""
    import math
    from collections import Counter

    tokens = {i: [*WORD.findall(lower(t)), None] for i, t in rows}
    c = Counter(w for i, ws in tokens.items() if crc(i, 5) != 1 for w in ws)
    n, v = sum(c.values()), len(c)
    return {
        i: {"held_out": crc(i, 5) == 1, "n_tokens": len(ws), "n_known": sum(w in c for w in ws), "train_tokens": n, "base_score": sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)}
        for i, ws in tokens.items()
    }


def suffix_scores(rows, depth, least, m, penalty=1.0, lump=0.5):
    """id -> log10 probability by the suffix tree learned from the rows (id, text, held) that are not held out."""
    from collections import Counter, defaultdict

    texts = [(i, [*WORD.findall(lower(t)), "\n"], h) for i, t, h in rows]
    c = Counter(w for _, ws, h in texts if not h for w in ws)
    n, v = sum(c.values()), len(c)
    p = lambda w: (c[w] + lump) / (n + lump * (v + 1))
    rare = (sum(k for k in c.values() if k < least) + lump * (sum(k < least for k in c.values()) + 1)) / (n + lump * (v + 1))
    symbol = lambda w: w if c[w] >= least else None
    follow, total, kept = defaultdict(Counter), Counter(), set()

    def now(before, s, most):
        q = rare if s is None else p(s)
        for j in range(1, min(most, len(before)) + 1):
            x = tuple(before[-j:])
            if None in x:
                break
            if x in kept:
                q = (follow[x][s] + m * q) / (total[x] + m)
        return q

    for d in range(1, depth + 1):
        for _, ws, h in texts:
            s = [symbol(w) for w in ws]
            for i in range(d, len(s)) if not h else ():
                if None not in s[i - d : i]:
                    follow[tuple(s[i - d : i])][s[i]] += 1
        new = set()
        for x in [x for x in follow if len(x) == d]:
            total[x] = sum(follow[x].values())
            q = {s: 2 ** (-np.rint(-4 * np.log2(now(x, s, d - 1))) / 4) for s in follow[x]}
            ratio = 2 * sum(k * np.log(k / total[x] / q[s]) for s, k in follow[x].items())
            if total[x] >= least and ratio > penalty * len(follow[x]) * np.log(total[x]):
                new.add(x)
        kept |= new
    out = {}
    for i, ws, _ in texts:
        s = [symbol(w) for w in ws]
        out[i] = sum(np.log10(now(s[:k], x, depth)) + (0 if x is not None else np.log10(p(w) / rare)) for k, (w, x) in enumerate(zip(ws, s, strict=True)))
    return out


def convnet(text, m, p):
    """The network's probability, loop by loop."""
    b = (text or "").encode("utf-8", "surrogatepass")
    parts = [b[: p.chunk]]
    while len(parts) * p.step + p.chunk - p.step < len(b):
        parts.append(b[len(parts) * p.step :][: p.chunk])
    values = []
    for c in parts:
        c = c + bytes(p.chunk - len(c))
        values.append([np.log1p(max(0.0, max(sum(float(m["table"][k, c[i + k], f]) for k in range(p.width)) for i in range(p.chunk - p.width + 1)) + float(m["bias"][f]))) for f in range(p.filters)])
    v = np.array(values)
    z = float(np.concatenate([v.mean(0), v.max(0), v.min(0)]) @ m["out"] + m["last"][0])
    return 1 / (1 + np.exp(-z))


def language(text, model, p):
    """(language, score) by the nearest centroid, with plain dictionaries."""
    from collections import Counter

    if not model.languages or text is None or not any(c.isalpha() for c in text):
        return "und", 0.0
    u, last = [], None
    for c in text.lower():
        x = max(ord(c), 32) if ord(c) >= 65 else 32
        if not (x == 32 and last == 32):
            u.append(x)
        last = x
    mask, a = (1 << 64) - 1, 0x9E3779B97F4A7C15
    count = Counter()
    for i, x in enumerate(u):
        one = (x + 1) * a & mask
        count[one >> 64 - p.bits] += 1
        if i + 1 < len(u):
            two = ((one ^ (u[i + 1] + 77)) * a) & mask
            count[two >> 64 - p.bits] += 1
            if i + 2 < len(u):
                count[((two ^ (u[i + 2] + 7777)) * a & mask) >> 64 - p.bits] += 1
    w = {k: (1 + np.log(n)) * model.idf[k] for k, n in count.items()}
    norm = np.sqrt(sum(x * x for x in w.values()))
    cos = [sum(x * float(c[k]) for k, x in w.items()) / norm if norm else 0.0 for c in model.centroids]
    best = [max(c for c, o in zip(cos, model.owner, strict=True) if o == k) for k in range(len(model.languages))]
    e = np.exp(p.sharpness * (np.array(best) - max(best)))
    return model.languages[int(np.argmax(best))], float(e.max() / e.sum())
