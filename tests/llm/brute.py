"""Plain versions of the operators' contracts."""

import hashlib
import math
import re
from collections import Counter

import numpy as np

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def components(rows, n, num, den):
    """(doc_id, n_shingles, component_id) of (doc_id, text)."""
    sets = []
    for _, text in rows:
        words = SPACED.findall(lowered(text))
        sets.append(frozenset(tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))) if words else frozenset())
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]) and group[a] != group[b]:
                group = [group[b] if g == group[a] else g for g in group]
    least = {g: min((r[0] for r, h in zip(rows, group) if h == g and r[0] is not None), default=None) for g in group}
    return Counter((r[0], len(s), least[g]) for r, s, g in zip(rows, sets, group))


def contamination(docs, bench):
    """op2's rows of (doc_id, text) and (item_id, text)."""
    windows = {}
    for i, text in bench:
        words = ALNUM.findall(lowered(text))
        n = min(13, len(words))
        for k in range(len(words) - n + 1 if n else 0):
            windows.setdefault(tuple(words[k : k + n]), set()).add("null" if i is None else str(i))
    out = Counter()
    for d, text in docs:
        words, hit, items = ALNUM.findall(lowered(text)), set(), set()
        for n in {len(w) for w in windows}:
            for k in range(len(words) - n + 1):
                found = windows.get(tuple(words[k : k + n]))
                if found:
                    items |= found
                    hit |= set(range(k, k + n))
        out[d, len(words), len(hit), len(items), sha(",".join(sorted(items))), bool(hit) and 20 * len(hit) >= len(words)] += 1
    return out


def substrings(rows, window=35):
    """op4's rows."""
    words = [(i, SPACED.findall(t or "")) for i, t in rows]
    count = Counter(tuple(w[k : k + window]) for _, w in words for k in range(len(w) - window + 1))
    out = Counter()
    for i, w in words:
        gone = {p for k in range(len(w) - window + 1) if count[tuple(w[k : k + window])] > 1 for p in range(k, k + window)}
        out[i, len(w), len(gone), sha(" ".join(x for p, x in enumerate(w) if p not in gone))] += 1
    return out


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    """(start, kind's number, end, kind), sorted."""
    out = []
    for no, (kind, pattern) in enumerate(KINDS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}
            if ok[kind]:
                out.append((m.start(), no, m.end(), kind))
    return sorted(out)


def statistics(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    words = SPACED.findall(text)
    places = {}
    for k in range(len(words) - 2):
        places.setdefault(tuple(words[k : k + 3]), []).append(k)
    repeated = {k + d for at in places.values() if len(at) > 1 for k in at for d in range(3)}
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated), len(words) < 50 or 100 * len(repeated) > 50 * len(words)


def features(stats):
    n, chars, symbols, lines, repeats, _ = stats
    n = max(n, 1)
    exact = (math.log(n), math.log(max(chars, 1) / n), math.sqrt(symbols / n), math.sqrt(lines / n), math.sqrt(repeats / n))
    return [math.floor(1000 * x + 0.5) if x >= 0 else -math.floor(-1000 * x + 0.5) for x in exact]


def mcd_distances(rows, floors, starts, steps, search, half, rim, scale):
    """Squared distances of rows from the minimum-covariance-determinant estimate of their distinct vectors."""
    x = np.unique(np.array(rows, float), axis=0)

    def estimate(kept, share):
        return kept.mean(0), np.cov(kept.T, bias=True) * scale(share) + np.diag(np.array(floors, float) ** 2)

    def distances(of, model):
        z = of - model[0]
        return np.einsum("ij,jk,ik->i", z, np.linalg.inv(model[1]), z)

    def nearer(model):
        bins = np.floor(256 * np.log1p(distances(x, model)))
        return estimate(x[bins <= math.ceil(np.percentile(bins, 100 * half))], half)

    models = []
    for s in starts:
        centre = np.percentile(x, 100 * s, axis=0)
        spread = np.maximum(1.4826 * np.percentile(np.abs(x - centre), 50, axis=0), floors)
        models.append((centre, np.diag(spread**2)))
    for _ in range(search):
        models = [nearer(m) for m in models]
    model = min(models, key=lambda m: np.linalg.slogdet(m[1])[1])
    for _ in range(steps - search):
        model = nearer(model)
    model = estimate(x[distances(x, model) <= rim[1]], rim[0])
    return distances(np.array(rows, float), model)


def shard_of(key, weights):
    """Rendezvous hashing: the shard of the least -ln(u) / weight."""
    digest = hashlib.md5((r"\N" if key is None else str(key)).encode()).hexdigest()
    prime, stride = 2147483647, 1640531527
    a, b = (int(digest[at : at + 8], 16) % prime for at in (0, 8))
    best = []
    for i, w in enumerate(weights):
        y = (a + (i + 1) * stride) % prime
        y = (y * y + b) % prime
        y = (y * y + a + i) % prime
        best.append((-math.log((y + 0.5) / prime) / w, i))
    return min(best)[1]
