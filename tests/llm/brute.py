"""Plain versions of what the operators compute."""

from __future__ import annotations

import collections
import hashlib
import re

import regex
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall(text or "")


def shingles(text, n):
    w = words((text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def near_duplicates(docs, n, percent=80):
    """{doc_id: (set size, component)}; docs: (doc_id, text) with unique ids."""
    sets = {d: shingles(t, n) for d, t in docs}
    lists, shared = collections.defaultdict(list), collections.Counter()
    for d, s in sets.items():
        for x in s:
            lists[x].append(d)
    for l in lists.values():
        shared.update((a, b) for k, a in enumerate(l) for b in l[k + 1 :])
    at = {d: d for d in sets}

    def top(x):
        while at[x] != x:
            x = at[x]
        return x

    for (a, b), k in shared.items():
        if 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
            a, b = top(a), top(b)
            at[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), top(d)) for d in sets}


def repeated_words(w, span=8):
    grams = [tuple(w[i : i + span]) for i in range(len(w) - span + 1)]
    n = collections.Counter(grams)
    return len({i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(span)})


def sainte_lague(weights, seats):
    got = [0] * len(weights)
    for _ in range(seats):
        k = max(range(len(weights)), key=lambda i: (weights[i] / (2 * got[i] + 1), -i))
        got[k] += 1
    return got


def targets(sizes, weights=(5, 2, 1), most=3):
    """sizes: {source: words}, sources in order."""
    total, w = sum(sizes.values()), {s: weights[k % len(weights)] for k, s in enumerate(sizes)}
    full = set()
    while True:
        left, share = total - sum(most * sizes[s] for s in full), sum(w[s] for s in sizes if s not in full)
        out = {s: most * sizes[s] if s in full else left * w[s] / share for s in sizes}
        over = {s for s in sizes if s not in full and out[s] > most * sizes[s] + 1e-9}
        if not over:
            return out
        full |= over


def paragraphs(text, long=200, pick=16):
    out = []
    for part in regex.split(r"(?V1)(?<=\n)|(?<=[.!?] )", text):
        if len(part) <= long:
            out.append(part)
            continue
        run = ""
        for word in regex.split(r"(?V1)(?<=[^\p{L}\p{M}]|[\u2E80-\uD7FF])", part):
            run += word
            if xxhash.xxh64_intdigest(word.encode(), 42) % pick == 0:
                out.append(run)
                run = ""
        out.append(run)
    return [p for p in out if p]


def fingerprint(text, sketch, lanes=64):
    """(the string, {cell: mass} of all paragraphs)."""
    sums, masses = [0] * lanes, collections.Counter()
    for p in paragraphs(text):
        seed = xxhash.xxh64_intdigest(hashlib.sha256(p.encode()).hexdigest()[:32].encode(), 42)
        masses[seed % 2**31] += len(p)
        for j in range(lanes):
            sums[j] += xxhash.xxh64_intdigest(j.to_bytes(4, "little"), seed)
    cells = sorted(masses)
    bound = cells[sketch - 1] if len(cells) > sketch else 2**31 - 1
    kept = ",".join(f"{c:x}:{masses[c]:x}" for c in cells[:sketch])
    return f"{''.join(f'{x % 2**32:08x}' for x in sums)}/{masses.total():x}/{bound:x}/{kept}", masses


def share(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def spark_hash(*values):
    """xxhash64 of Spark: strings, ints of 4 bytes as (n, 4), longs as (n, 8); null leaves it as it is."""
    h = 42
    for v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v[0].to_bytes(v[1], "little", signed=True), h)
    return h - 2**64 if h >= 2**63 else h


def taken(docs, block, shard_docs, seed=7, most=3):
    """{doc_id: words taken}; docs: (doc_id, source, size) with unique ids and no null source."""
    sizes = collections.Counter()
    for _, s, n in docs:
        sizes[s] += n
    order = sorted(sizes)
    want = targets({s: sizes[s] for s in order})
    quotas = dict(zip(order, sainte_lague([want[s] for s in order], int(sum(want.values()) / block + 0.5)), strict=True))
    out = {}
    for s in order:
        mine = [(d, n) for d, t, n in docs if t == s]
        shards = collections.defaultdict(list)
        for d, n in mine:
            shards[spark_hash((seed, 4), (d, 8)) % -(-len(mine) // shard_docs)].append((spark_hash((seed + 1, 4), (d, 8)), d, n))
        keys = sorted(shards)
        for k, seats in zip(keys, sainte_lague([sum(n for *_, n in shards[k]) for k in keys], quotas[s]), strict=True):
            owner = [d for _, d, n in sorted(shards[k]) for _ in range(n)]
            run = min(seats * block, most * len(owner))
            full, rest = divmod(run, len(owner)) if owner else (0, 0)
            out |= {d: full * n for _, d, n in shards[k]}
            ranked = sorted(range(-(-len(owner) // block)), key=lambda b: spark_hash((seed + 2, 4), s, (k, 4), (b, 8)))
            for b in ranked[: (rest + block // 2) // block]:
                for d in owner[b * block : (b + 1) * block]:
                    out[d] += 1
    return out
