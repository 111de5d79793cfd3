"""Plain Python versions of the operators' contracts, for small inputs."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

SPACE = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def url(value, rules, default):
    rest = value.split("://", 1)[1] if value and "://" in value else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.host + r.path), default=None)
    return host, path, best and best.host + best.path, best.verdict if best else default


def fingerprint(text):
    import xxhash
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    found = WORD.findall(text)
    if not found:
        return 0
    shingles = [" ".join(found[i:i + 3]) for i in range(len(found) - 2)] or [" ".join(found)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def groups(fingerprints, bits=3):
    """Component of each fingerprint: the smallest reachable one."""
    distinct = sorted(set(fingerprints))
    up = {f: f for f in distinct}

    def root(f):
        while up[f] != f:
            f = up[f]
        return f
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= bits:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {f: root(f) for f in distinct}


def near(docs):
    """Rows (doc_id, fingerprint, component_id) of (doc_id, text)."""
    fps = [fingerprint(t) for _, t in docs]
    label = groups(fps)
    smallest = defaultdict(list)
    for (doc_id, _), f in zip(docs, fps):
        if doc_id is not None:
            smallest[label[f]].append(doc_id)
    return [(d, f"{f:016x}", min(smallest[label[f]], default=None)) for (d, _), f in zip(docs, fps)]


def shingles(text, size=5):
    """Distinct word shingles; a text of fewer words is one."""
    found = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(found[i:i + size]) for i in range(len(found) - size + 1)} or {tuple(found)}


def similar(texts, size=5, similarity=(4, 5)):
    """Component of each text at that Jaccard similarity or more: the first text reachable, by comparing all."""
    held, up = [shingles(t, size) for t in texts], list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    for i, a in enumerate(held):
        for j in range(i):
            if len(a & held[j]) * similarity[1] >= len(a | held[j]) * similarity[0]:
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(texts))]


def quality(text):
    found = words(text)
    lines, seen, dup = [x for x in (text or "").split("\n") if WORD.search(x)], set(), 0
    for line in lines:
        dup += line in seen
        seen.add(line)
    windows = [tuple(found[i:i + 5]) for i in range(len(found) - 4)]
    times = Counter(windows)
    repeated = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 5)}
    return len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(repeated)


def votes(text):
    """What each quality rule says of a text: 0 bad, 1 good, None."""
    n_words, chars, symbols, dup, repeat = quality(text)
    found = words(text)
    text = text if found else ""
    lines = sum(bool(WORD.search(x)) for x in text.split("\n"))
    upper, stops = (sum(c in marks for c in text) for marks in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", ".,;:"))
    letters = sum(c.isascii() and c.isalpha() or ord(c) > 127 for c in text)
    stutter = sum(a == b for a, b in zip(found, found[1:]))
    if not found:
        symbols = 0
    says = [(symbols > 0.1 * n_words, symbols <= 0.01 * n_words), (n_words >= 20 and letters < 0.92 * chars, letters >= 0.95 * chars),
            (n_words >= 30 and upper > 0.03 * chars, upper < 0.025 * chars), (dup > 0.1 * lines, lines >= 3 and dup == 0),
            (repeat > 0.04 * n_words, n_words >= 50 and repeat == 0), (stutter > 0.02 * n_words, n_words >= 50 and stutter < 0.008 * n_words),
            (n_words >= 30 and not 4.5 * n_words <= chars <= 6 * n_words, 4.6 * n_words <= chars <= 5.8 * n_words),
            (n_words >= 50 and not 0.085 * n_words <= stops <= 0.22 * n_words, n_words >= 50 and 0.1 * n_words <= stops <= 0.19 * n_words)]
    return [0 if bad else 1 if good else None for bad, good in says]


def kept(texts, floor=0.01, rounds=200):
    """Which texts stay: a plain expectation maximisation over documents, one after the other."""
    import math
    failed = [n < 10 or 100 * r > 20 * n for n, _, _, _, r in map(quality, texts)]
    said = [votes(t) for t in texts]
    used = [v for v, f in zip(said, failed) if not f]
    lean, rules, prior = 0.002 * len(used) + 1, len(said[0]) if said else 0, 0.9
    rate = {0: [0.05] * rules, 1: [0.4] * rules}  # of bad votes, on good and on bad documents

    def good(vote):
        odds = math.log(prior / (1 - prior))
        for n, v in enumerate(vote):
            if v is not None:
                a, b = rate[0][n], rate[1][n]
                odds += math.log(a / b) if v == 0 else math.log((1 - a) / (1 - b))
        return 1 / (1 + math.exp(-odds))
    clip = lambda x: min(max(x, floor), 1 - floor)
    for _ in range(rounds if used else 0):
        share = [good(v) for v in used]
        new = {}
        for kind, start in ((0, 0.05), (1, 0.4)):
            weight = [s if kind == 0 else 1 - s for s in share]
            new[kind] = [clip((sum(w for w, v in zip(weight, used) if v[n] == 0) + lean * start)
                              / (sum(w for w, v in zip(weight, used) if v[n] is not None) + lean)) for n in range(rules)]
        rate, prior = new, min(max((sum(share) + lean * 0.9) / (len(used) + lean), 0.5), 1 - floor)
    return [not f and good(v) >= 0.5 for f, v in zip(failed, said)], said


def targets(sizes, weights=(5, 2, 1), most=3):
    """Target of each source by resharing until nothing is above its limit."""
    total = Counter()
    for source, size in sizes:
        total[source] += size
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed, free, left = {}, set(names), float(sum(total.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        above = [s for s in free if level * weight[s] >= most * total[s]]
        if not above:
            fixed |= {s: level * weight[s] for s in free}
            break
        for s in above:
            fixed[s] = most * total[s]
            left -= fixed[s]
            free.remove(s)
    return fixed, total


def conversation(turns):
    """n_turns, turns_sha256, loss_chars, loss_sha256 of ordered (role, text)."""
    told = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def exact(docs):
    """Rows (doc_id, keep_id, group_size, text_sha256) of (doc_id, text)."""
    shas = [hashlib.sha256(SPACE.sub(" ", t or "").encode()).hexdigest() for _, t in docs]
    ids, size = defaultdict(list), Counter(shas)
    for (doc_id, _), sha in zip(docs, shas):
        if doc_id is not None:
            ids[sha].append(doc_id)
    return [(d, min(ids[s], default=None), size[s], s) for (d, _), s in zip(docs, shas)]


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
