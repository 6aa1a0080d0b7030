"""Small brute-force models, one per stage, written for the tests only."""

import hashlib
import math
import re


def tokens(body):
    out = []
    for run in re.findall("[A-Za-z]+|[0-9]+", body):
        cut = [m.start() + 1 for m in re.finditer("[a-z][A-Z]", run)]
        edges = [0, *cut, len(run)]
        pieces = [run[a:b].lower() for a, b in zip(edges, edges[1:])]
        out += pieces + ([run.lower()] if cut else [])
    return out


def hash_vector(toks, dim):
    vec = [0] * dim
    for f in toks + [x + "::" + y for x, y in zip(toks, toks[1:])]:
        digest = hashlib.sha256(f.encode()).hexdigest()
        vec[int(digest[:8], 16) % dim] += 1 if int(digest[8:10], 16) % 2 else -1
    length = math.sqrt(sum(v * v for v in vec))
    return [v / length for v in vec] if length else vec


def bm25(query, docs):
    n, avg = len(docs), max(sum(map(len, docs)) / len(docs), 1)
    scores = []
    for doc in docs:
        total = 0.0
        for t in dict.fromkeys(query):
            tf, df = doc.count(t), sum(t in d for d in docs)
            if tf:
                idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
                total += idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(doc) / avg))
        scores.append(total)
    return scores


def scaled(values):
    lo, hi = min(values), max(values)
    if math.isclose(lo, hi):
        return [float(hi > 0)] * len(values)
    return [(v - lo) / (hi - lo) for v in values]


def specificity(df, n):
    return max(0.0, min(1.0, math.log((n + 1) / (df + 1)) / math.log((n + 1) / 3)))


def retrieve(query_text, ids, spans, postings, dim, broad_k=40, pool=200):
    """spans: {id: body}; postings: {(identifier, kind): set(ids)}. Returns ordered rows."""
    names = sorted(spans)
    docs = [tokens(spans[s]) for s in names]
    q = tokens(query_text)
    lexical = bm25(q, docs)
    qv = hash_vector(q, dim)
    dense = [sum(a * b for a, b in zip(qv, hash_vector(d, dim))) for d in docs]
    hybrid = dict(zip(names, (0.5 * a + 0.5 * b for a, b in zip(scaled(lexical), scaled(dense)))))
    broad = sorted(names, key=lambda s: (-round(hybrid[s], 12), s))[:broad_k]
    live = {k: v for k, v in postings.items() if 2 <= len(v) <= 50}
    edges = {}

    def reach(identifier, strength):
        for (name, _), sources in live.items():
            if name == identifier:
                for s in sources:
                    edges.setdefault(s, []).append(strength * specificity(len(sources), len(names)))

    for identifier in ids:
        reach(identifier, 1.0)
    for rank, s in enumerate(broad, 1):
        own = sorted((len(v), name, kind) for (name, kind), v in live.items() if s in v)
        for identifier in list(dict.fromkeys(name for _, name, _ in own))[:8]:
            reach(identifier, 1 / math.log2(rank + 1))
    relation = {s: max(v) for s, v in edges.items()}
    extra = sorted((s for s in relation if s not in broad), key=lambda s: (-round(relation[s], 12), -round(hybrid[s], 12), s))
    final = {s: 0.75 * hybrid[s] + 0.25 * relation.get(s, 0.0) for s in broad + extra[: pool - broad_k]}
    order = sorted(final, key=lambda s: (-round(final[s], 12), -round(hybrid[s], 12), s))
    return [(s, i, round(final[s], 8), broad.index(s) + 1 if s in broad else None) for i, s in enumerate(order, 1)]


def windows(lines):
    out, at = [], 0
    while at < len(lines):
        stop = at + 1
        while stop < min(at + 80, len(lines)):
            more = "\n".join(lines[at:stop + 1])
            if len(more) > 4000 or len(more.encode()) > 1800:
                break
            stop += 1
        out.append((at, stop))
        if stop == len(lines):
            break
        at = max(stop - 10, at + 1)
    return out
