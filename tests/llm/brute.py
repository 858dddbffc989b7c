"""Plain versions of the operators for small inputs: rows in, dictionaries by document out."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import defaultdict

from courtside.llm.common import LOWER, UPPER

ASCII_LOWER = str.maketrans(UPPER, LOWER)
BLANK_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def words1(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII_LOWER))


def decontaminated(docs, items, n=10):
    """docs: (doc_id, text); items: (item_id, text)."""
    windows = defaultdict(set)
    for item, text in items:
        w = words1(text)
        for i in range(max(1, len(w) - n + 1)) if w else ():
            windows[tuple(w[i:i + n])].add(str(item))
    sizes = {len(w) for w in windows}
    out = {}
    for doc, text in docs:
        w, hit, found = words1(text), set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if (g := tuple(w[i:i + k])) in windows:
                    hit.update(range(i, i + k))
                    found |= windows[g]
        out[doc] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit))
    return out


def url_parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest)[0]
    return host.translate(ASCII_LOWER), re.split(r"[?#]", rest[len(host):])[0]


def judged(pages, rules, default="allow"):
    out = []
    for page, url in pages:
        host, path = url_parts(url)
        fits = [(len(h) + len(p), len(h), h + p, a) for h, p, a in rules
                if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, 0, None, default))
        out.append((page, host, path, best[2], best[3]))
    return sorted(out, key=repr)


def base_spans(text):
    """(start, kind number, end) of the base patterns."""
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
    out = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def secret_spans(text, scope=200):
    """(start, kind number, end) of what is reported, base and weak."""
    base = base_spans(text)
    weak = [(m.start(), 3, m.end()) for m in re.finditer(r"[A-Za-z0-9+/_=-]+", text)
            if len(m[0]) >= 20 and all(re.search(c, m[0]) for c in ("[0-9]", "[A-Z]", "[a-z]"))]
    weak += [(m.start(), 4, m.end()) for m in re.finditer(
        r"""((?i:username|user_?id|account|login|client_?id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9@+/_.-]+)""", text, re.ASCII) if len(m[2]) >= 3]
    weak += [(m.start(), 5, m.end()) for m in re.finditer(
        r"(?i:https?|s3|jdbc:[a-z]+|postgres|mysql|mongodb|redis|amqp)://[^\x20\x09-\x0D\"'<>]+", text, re.ASCII) if len(m[0]) >= 8]
    weak = [s for s in weak if not any(a < s[2] and s[0] < b for a, _, b in base)]
    near = lambda s, kinds: any(k in kinds and (a <= s[0] <= b + scope or s[0] <= a <= s[2] + scope) for a, k, b in base + weak)
    out = list(base)
    for s in weak:
        identifier, secret = near(s, (1, 4)), near(s, (0, 2, 3))
        if (identifier, secret, identifier and secret)[s[1] - 3]:
            out.append(s)
    return sorted(out)


def copies(docs):
    groups = defaultdict(list)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    for doc, text in docs:
        groups[norm(text)].append((-len(text or ""), doc))
    return {doc: (min(groups[norm(text)])[1], len(groups[norm(text)]), doc == min(groups[norm(text)])[1], sha(norm(text)))
            for doc, text in docs}


def mixed(docs, weights, epochs=3):
    """docs: (doc_id, text, source); weights by source."""
    size = {d: len(BLANK_WORD.findall(t or "")) for d, t, _ in docs}
    total = defaultdict(int)
    for d, _, s in docs:
        total[s] += size[d]
    clamped, level = set(), 0.0
    while True:
        open_ = [s for s in total if s not in clamped]
        if not open_:
            break
        level = (sum(total.values()) - sum(epochs * total[s] for s in clamped)) / sum(weights[s] for s in open_)
        more = {s for s in open_ if level * weights[s] >= epochs * total[s]}
        if not more:
            break
        clamped |= more
    target = {s: float(epochs * total[s]) if s in clamped else level * weights[s] for s in total}
    out = {}
    for s in total:
        whole = math.floor(target[s] / total[s]) if total[s] else 0
        rest, ahead = target[s] - whole * total[s], 0
        draw = lambda d: int(hashlib.md5(f"0:{d}".encode()).hexdigest()[:15], 16)
        for d in sorted((d for d, _, x in docs if x == s), key=lambda d: (draw(d), d)):
            extra = int(rest > 0 and ahead + size[d] / 2 <= rest)
            ahead += size[d]
            out[d] = (size[d], total[s], target[s], (whole + extra) * size[d])
    return out


def substrings_removed(docs, n=50):
    first = {}
    words = {d: BLANK_WORD.findall(t or "") for d, t in docs}
    for d in sorted(words):
        for i in range(len(words[d]) - n + 1):
            first.setdefault(tuple(words[d][i:i + n]), d)
    out = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - n + 1):
            if first[tuple(w[i:i + n])] < d:
                gone.update(range(i, i + n))
        out[d] = (len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def near_groups(docs, size=4, percent=80):
    sets = {}
    for d, t in docs:
        w = BLANK_WORD.findall((t or "").translate(ASCII_LOWER))
        sets[d] = {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
    holders, up = defaultdict(list), {d: d for d in sets}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    for d in sorted(sets):
        common = defaultdict(int)
        for g in sets[d]:
            for other in holders[g]:
                common[other] += 1
            holders[g].append(d)
        for other, both in common.items():
            if 100 * both >= percent * (len(sets[d]) + len(sets[other]) - both):
                a, b = sorted((root(d), root(other)))
                up[b] = a
    return {d: (len(sets[d]), root(d), root(d) == d) for d in sets}


def remainder(doc_id, by):
    return zlib.crc32(str(doc_id).encode()) % by
