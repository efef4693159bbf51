"""Plain versions of the contracts, a row at a time."""

import hashlib
import re
import zlib
from collections import defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def groups(docs):
    """docs: (id, text) with distinct ids."""
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in docs}
    by = defaultdict(list)
    for i, t in norm.items():
        by[t].append(i)
    return {i: (min(by[t]), len(by[t]), sha(t)) for i, t in norm.items()}


def secrets(text):
    text = text or ""
    out = {"assign": [], "access": [], "hex": []}
    key = "(?:%s)" % "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    for m in re.finditer(key + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[1]) >= 8:
            out["assign"].append(m.span())
    for kind, pattern, least in (("access", "AKIA[A-Z0-9]+", 16), ("hex", "[0-9a-f]+", 32)):
        out[kind] = [m.span() for m in re.finditer(pattern, text) if m.end() - m.start() >= least]
    order = list(out)
    flat = sorted((s, order.index(k), e) for k, spans in out.items() for s, e in spans)
    return {k: len(v) for k, v in out.items()}, ",".join(f"{order[k]}:{s}:{e}" for s, k, e in flat)


def owned_secrets(docs, max_owners=2, max_repos=4):
    """id -> (live spans joined, base spans with an example's value). docs: (id, text, source, lang)."""
    key = "(?:%s)" % "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    patterns = [(key + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8), ("AKIA[A-Z0-9]+", 0, 16), ("[0-9a-f]+", 0, 32), ("[A-Za-z0-9+/_.=-]+", 0, 12)]
    found, owners, repos, used = [], defaultdict(set), defaultdict(set), set()
    for i, text, source, lang in docs:
        for k, (p, group, least) in enumerate(patterns):
            for m in re.finditer(p, text or ""):
                v = m[group]
                if len(v) < least or k == 3 and not re.search("[0-9]", v):
                    continue
                bare = v.rstrip(".")
                stem = bare.rstrip("=")
                size = len(stem.split("=")[-1]) + len(bare) - len(stem)
                value, end = (bare[-size:], m.end() - len(v) + len(bare)) if size else (v, m.end())
                found.append((i, k, end - len(value), end, value))
                owners[value].add(source)
                repos[value].add((source, lang))
                used |= {value} if k < 3 else set()
    wide = {v for v in used if len(owners[v]) > max_owners or len(repos[v]) > max_repos}
    looks = lambda v: len(v) >= 12 and re.search("[0-9]", v) and re.search("[A-Za-z]", v) and len(set(v)) >= 6 and not re.search("example|changeme|placeholder|dummy|sample|xxxx|1234567", v, re.I)
    live, n_example = defaultdict(set), defaultdict(int)
    for i, k, start, end, v in found:
        n_example[i] += k < 3 and v in wide
        if v in used and v not in wide and looks(v):
            live[i].add((start, end))
    return {d[0]: (",".join(f"live:{a}:{b}" for a, b in sorted(live[d[0]])), n_example[d[0]]) for d in docs}


def fingerprint(text, size=4):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near(fps, bits=4):
    """id -> smallest id reachable. fps: id -> fingerprint."""
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (fps[a] ^ fps[b]).bit_count() <= bits:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def leaks(docs, bench, n=8):
    words = lambda t: TOKEN.findall((t or "").translate(LOWER))
    items = defaultdict(set)
    for item, t in bench:
        w = words(t)
        k = min(n, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            items[tuple(w[i : i + k])].add(str(item))
    sizes = {len(k) for k in items}
    out = {}
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for k in sizes:
            for at in range(len(w) - k + 1):
                if got := items.get(tuple(w[at : at + k])):
                    hit.update(range(at, at + k))
                    found |= got
        out[i] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), len(found) >= 2)
    return out


def lines(docs, least=10):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    at = defaultdict(set)
    for i, t in docs:
        for x in (t or "").split("\n"):
            at[key(x)].add(i)
    out = {}
    for i, t in docs:
        all_ = (t or "").split("\n")
        kept = [x for x in all_ if not (key(x) and len(at[key(x)]) >= least)]
        out[i] = (len(all_), len(all_) - len(kept), sha("\n".join(kept)))
    return out


def targets(sizes, weights=(5, 2, 1), total=1.5, most=2.0):
    """sizes: source -> words. Shares again and again until none is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = total * sum(sizes.values()), set(order), {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * share > most * sizes[s]}
        if not over:
            out |= {s: weight[s] * share for s in open_}
            break
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def crc(ids):
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))


def url(u, rules):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
    host, path = (m[1].translate(LOWER), m[2]) if m else ("", "")
    fit = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def block_words(goal):
    """goal: source -> target."""
    quota = [round(t) for t in goal.values()]
    least = min((q for q in quota if q > 0), default=0)
    return max(1, min(1024, max(least // 1024, sum(quota) // 2**20)))


def mix(docs, keys, *, block=None, step=0.6180339887498949):
    """id -> words taken. docs: (id, text, source) with distinct ids; keys: id -> shuffle key."""
    size = {i: len(WORD.findall(t or "")) for i, t, _ in docs}
    by = defaultdict(list)
    for i, _, s in docs:
        by[s].append(i)
    total = {s: sum(size[i] for i in ids) for s, ids in by.items()}
    goal = targets(total)
    block = block or block_words(goal)
    order = sorted(goal, key=lambda s: (s is None, s or ""))
    quota = {s: int(goal[s] + 0.5) for s in order}
    n, words = -(-sum(quota.values()) // block), sum(quota.values())
    far, drawn = step * 2**20 % 1.0, []
    for k in range(n):
        u, at = ((k >> 20) * far + (k % 2**20) * step) % 1.0, 0
        for s in order:
            if quota[s] and at / words <= u < (at + quota[s]) / words:
                drawn.append(s)
            at += quota[s]
    taken = dict.fromkeys(size, 0)
    for s in order:
        stream = [i for i in sorted(by[s], key=lambda i: (keys[i], i)) for _ in range(size[i])]
        cut = [stream[a : a + block] for a in range(0, len(stream), block)]
        for rank in range(ranks := drawn.count(s)):
            if rank < 2 * len(cut):
                whole = cut[rank % len(cut)]
                left = quota[s] - rank // len(cut) * len(stream) - rank % len(cut) * block
                for i in whole[: max(0, left)] if rank == ranks - 1 else whole:
                    taken[i] += 1
    return taken


def similar(rows, size=5, similarity=0.8):
    """id -> smallest id that it hangs together with by similar sets of shingles. rows: (id, text)."""
    sets = {}
    for i, t in rows:
        words = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))}
    root = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    return root
