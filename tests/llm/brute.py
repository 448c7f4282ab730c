"""Plain versions of the operators: one document at a time, no Spark, no numpy passes over many."""

import hashlib
import math
import re
from collections import Counter

import numpy as np

from proofmark.llm import langid

BLANK = r"[^\x20\x09-\x0D]+"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# ---------------------------------------------------------------- languages

def trigrams(text):
    """Counter of hashed trigrams of letters; everything else is one blank."""
    low = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in f" {text or ''} ")
    low = re.sub(" +", " ", low)
    out = Counter()
    for a, b, c in zip(low, low[1:], low[2:]):
        h = (ord(a) * int(langid._A) + ord(b) * int(langid._B) + ord(c) * int(langid._C)) % 2**64
        out[((h ^ h >> 29) * int(langid._A) % 2**64) >> 49] += 1
    return out


class Languages:
    def __init__(self, rows):
        counts = {}
        for text, lang in rows:
            if text is not None and lang is not None:
                counts.setdefault(lang, Counter()).update(trigrams(text))
        self.names = sorted(counts)
        self.p = {}
        for name, c in counts.items():
            total = sum(c.values()) + 0.1 * langid.BUCKETS
            self.p[name] = (lambda c, total: lambda g: (c[g] + 0.1) / total)(c, total)

    def em(self, grams, pi, times):
        def mix(g):
            return sum(pi[x] * self.p[x](g) for x in pi)
        for _ in range(times):
            new = dict.fromkeys(pi, 0.0)
            for g, n in grams.items():
                whole = mix(g)
                for x in pi:
                    new[x] += n * pi[x] * self.p[x](g) / whole
            pi = {x: v / sum(grams.values()) for x, v in new.items()}
        return pi, sum(n * math.log(mix(g)) for g, n in grams.items()) / 3

    def predict(self, text):
        """(language, score, fit)"""
        grams = trigrams(text)
        total = sum(grams.values())
        if not total or not self.names:
            return "und", 0.0, None
        penalty = 0.5 * math.log(total)
        pi, fit = self.em(grams, {x: 1 / len(self.names) for x in self.names}, 16)

        def without(dropped):
            nonlocal pi, fit
            start = {x: v + 1e-6 for x, v in pi.items() if x not in dropped}
            whole = sum(start.values())
            new, new_fit = self.em(grams, {x: v / whole for x, v in start.items()}, 8)
            if new_fit >= fit - penalty * len(dropped):
                pi, fit = new, new_fit
                return True
            return False

        most = max(self.names, key=lambda x: pi[x])
        little = {x for x in pi if x != most and pi[x] * total / 3 < penalty}
        if len(self.names) > 2 and little:
            without(little)
        while len(pi) > 1 and without({min(sorted(pi), key=lambda x: pi[x])}):
            pass
        best = min(pi, key=lambda x: (-pi[x], x))
        return best, pi[best] * total / (total + 1), 3 * fit / total + math.log(langid.BUCKETS)


# ---------------------------------------------------------------- secrets

KINDS = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
         ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24)]


def base_spans(text):
    return sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(KINDS) for m in p.finditer(text or "") if ok(m))


def tail(z):
    x = min(9.0, max(-9.0, z))
    return 1 / (1 + math.exp(1.5976 * x + 0.070566 * x**3))


def battery(token):
    """(encoding, symbols, p-value)"""
    if re.fullmatch("[0-9a-f]+|[0-9A-F]+", token):
        enc, alphabet, symbols = "hex", "0123456789abcdef", token.lower()
    elif re.fullmatch("[A-Z2-7]+", token):
        enc, alphabet, symbols = "base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", token
    else:
        enc, alphabet, symbols = "base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", token.replace("-", "+").replace("_", "/")
    v, k, n = [alphabet.index(c) for c in symbols], len(alphabet), len(symbols)
    z_chi = (sum(c * c for c in Counter(v).values()) * k / n - n - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n)
    up = [x >= k // 2 for x in v]
    high, mean = sum(up), sum(v) / n
    runs = 1 + sum(a != b for a, b in zip(up, up[1:]))
    mu = 1 + 2 * high * (n - high) / n
    z_runs = 9.0 if high in (0, n) else abs(runs - mu) / math.sqrt(max((mu - 1) * (mu - 2) / (n - 1), 1e-9))
    var, cov = sum((x - mean) ** 2 for x in v), sum((a - mean) * (b - mean) for a, b in zip(v, v[1:]))
    z_serial = 9.0 if var <= 0 else abs(cov / var * math.sqrt(n) + 1 / math.sqrt(n))
    h = -sum(math.log(min(1.0, tail(z) * sides)) for z, sides in ((z_chi, 1), (z_runs, 2), (z_serial, 2)))
    return enc, n, math.exp(-h) * (1 + h + h * h / 2)


def random_tokens(texts, fdr=0.05, bins=100):
    """For each text the spans of tokens that pass the battery."""
    band = lambda n: min(int(math.floor(math.log2(n / 20) * 2)), 8)
    tested = [[(m.start(), 3, m.end(), battery(m[0])) for m in re.finditer("[A-Za-z0-9+/_-]{20,}", t or "") if re.search("[0-9]", m[0])] for t in texts]
    groups = {}
    for *_, (enc, n, p) in (x for t in tested for x in t):
        groups.setdefault((enc, band(n)), Counter())[min(int(p * bins), bins - 1)] += 1
    limit = {}
    for key, h in groups.items():
        uniform = 2 * sum(c for b, c in h.items() if b >= bins // 2)
        seen = lambda b: sum(c for x, c in h.items() if x >= b)  # noqa: E731, B023
        fits = [b for b in h if b > 0 and uniform > 0 and seen(b) - uniform * (1 - b / bins) <= fdr * seen(b)]
        if fits:
            limit[key] = min(fits) / bins
    return [[x[:3] for x in t if x[3][2] >= limit.get((x[3][0], band(x[3][1])), 2.0)] for t in tested]


def redacted(text, spans, mark="[SECRET]"):
    if text is None:
        return None
    out, at = "", 0
    for start, _, stop in sorted(spans):
        if start >= at:
            out += text[at:start] + mark
        at = max(at, stop)
    return out + text[at:]


# ---------------------------------------------------------------- copies, benchmark, mixing

def components(texts):
    sets = []
    for t in texts:
        w = lower(t).encode().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]) and up[i] != up[j]:
                low, high = min(up[i], up[j]), max(up[i], up[j])
                up = [low if x == high else x for x in up]
    return [(len(s), c) for s, c in zip(sets, up)]


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def aligned(template, text):
    """(matched, first, last + 1) of the longest common subsequence that starts latest and, of those, ends earliest."""
    best = [(0, 0, 0)] * (len(text) + 1)
    for t in template:
        row = [(0, 0, 0)]
        for j, x in enumerate(text):
            m, first, _ = best[j]
            row.append(max(best[j + 1], row[j], (m + 1, first if m else j, -j - 1) if x == t else (0, 0, 0)))
        best = row
    m, first, last = best[-1]
    return m, first, -last


def plain_words(text):
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", lower(text))


def benchmark_scores(text, item, half=24, answer=8):
    """The best (share, answer) of the windows of a text at which an item may match; none if none does."""
    w, t = plain_words(item), plain_words(text)
    best = None
    for at in range(0, len(t), half):
        window = t[at : at + 4 * half + len(w)]
        if sum((Counter(w) & Counter(window)).values()) >= 0.6 * len(w):
            got = subsequence(w, window) / len(w), subsequence(w[-answer:], window) / min(answer, len(w))
            if got[0] >= 0.75 or got[0] >= 0.6 and got[1] >= 0.75:
                best = max(best or got, got)
    return best


def water_fill(sizes, weights, total, epochs):
    target, open_ = {}, set(sizes)
    while open_:
        left, w = total - sum(target.values()), sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] / w >= epochs * sizes[s]}
        if not over:
            return target | {s: left * weights[s] / w for s in open_}
        target |= {s: epochs * sizes[s] for s in over}
        open_ -= over
    return target


def mixed(rows):
    """doc_id -> (size, target, taken) of (doc_id, source, text) rows, one row an id."""
    size = {i: len(re.findall(BLANK, t or "")) for i, _, t in rows}
    order = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(size[i] for i, x, _ in rows if x == s) for s in order}
    target = water_fill(sizes, dict(zip(order, [3, 1, 2] * len(order))), 1.5 * sum(sizes.values()), 2)
    out = {}
    for s in order:
        own = {i: int(hashlib.md5(f"{'' if i is None else i}:1".encode()).hexdigest()[:3], 16) for i, x, _ in rows if x == s}
        whole = int(target[s] // sizes[s]) if sizes[s] else 0
        left, cut, upto = target[s] - whole * sizes[s], -1, 0
        for b in sorted(set(own.values())):
            n = sum(size[i] for i, x in own.items() if x == b)
            if upto + n / 2 <= left:
                cut = b
            upto += n
        out |= {i: (size[i], target[s], size[i] * (whole + (b <= cut))) for i, b in own.items()}
    return out


def dedup(texts):
    """(words, removed, checksum of what is kept) of each text, in order."""
    seen, out = set(), []
    for t in texts:
        w = (t or "").encode().split()
        covered = [False] * len(w)
        for i in range(len(w) - 19):
            key = tuple(w[i : i + 20])
            if key in seen:
                covered[i : i + 20] = [True] * 20
            seen.add(key)
        kept = b" ".join(x for x, c in zip(w, covered) if not c)
        out.append((len(w), sum(covered), hashlib.sha256(kept).hexdigest()))
    return out


def top_k(rows, k):
    """(query_id, rank, vec_id, score) of (vec_id, vector) rows."""
    limit = np.finfo(float).max / 4
    fine = [(i, [int(np.floor(min(limit, max(-limit, 64 * x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (i, v) in enumerate(fine):
        if i % 20 == 0:
            best = sorted((-max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(v, w)))), j) for b, (j, w) in enumerate(fine) if a != b and len(w) == len(v))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)
