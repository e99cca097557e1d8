"""Plain versions of the operators, for small inputs."""

import collections
import hashlib
import math
import re
import zlib

import xxhash

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(ASCII_LOWER))


def repeats(texts, length):
    """Per text: bytes, removed, spans and digest of the rest."""
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(d, gone) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((len(d), len(d) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def fingerprint(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII_LOWER))
    if not found:
        return 0
    width = min(3, len(found))
    hashes = [xxhash.xxh64_intdigest(" ".join(found[i:i + width]).encode(), 42) for i in range(len(found) - width + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, bits=2):
    """``prints``: {id: number}; the least id of every component."""
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def contamination(texts, items, width=10):
    """``items``: [(id, text)]; per text: words, words hit, sorted ids."""
    windows = collections.defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows[tuple(w[i:i + width])].add(item)
    sizes = {len(w) for w in windows}
    out = []
    for text in texts:
        w, hit, found = words(text), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if items_ := windows.get(tuple(w[i:i + size])):
                    hit.update(range(i, i + size))
                    found |= items_
        names = ",".join(sorted(str(i) for i in found if i is not None))
        out.append((len(w), len(hit), len(found - {None}), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return out


def quality_counts(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [line for line in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = list(zip(found, found[1:], found[2:]))
    often = {w for w, n in collections.Counter(windows).items() if n > 1}
    repeated = {j for i, w in enumerate(windows) if w in often for j in (i, i + 1, i + 2)}
    return (
        len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated),
    )


def binomial_at_most(k, n, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def cut(texts, length, width):
    """Texts without repeated strings of ``length`` bytes and repeated runs of ``width`` words, and how many were cut."""
    data = [(t or "").encode() for t in texts]
    spans = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", d)] for d in data]
    seen = collections.Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    found = [[d[a:b] for a, b in s] for d, s in zip(data, spans)]
    runs = collections.Counter(tuple(w[i:i + width]) for w in found for i in range(len(w) - width + 1))
    out = []
    for d, s, w in zip(data, spans, found):
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        for i in range(len(w) - width + 1):
            if runs[tuple(w[i:i + width])] > 1:
                lo, hi = s[i][0], s[i + width - 1][1]
                gone[lo:hi] = b"\1" * (hi - lo)
        out.append(bytes(c for c, g in zip(d, gone) if not g).decode("utf-8", "ignore"))
    return out


def word_runs(texts, width):
    """Per text: maximal runs of words covered by ``width``-word strings that start anywhere else too, and the words in them."""
    found = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = collections.Counter(tuple(w[i:i + width]) for w in found for i in range(len(w) - width + 1))
    out = []
    for w in found:
        gone = bytearray(len(w))
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i:i + width])] > 1:
                gone[i:i + width] = b"\1" * width
        out.append((len(re.findall(b"\1+", bytes(gone))), sum(gone)))
    return out


def prefix_nodes(rows, group=20, heads=4):
    """``rows``: (conv_id, turn, role, text); the result rows of the prefix operator, sorted."""
    turns = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            code = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            turns[conv].append((turn is not None, turn, code, role, text))
    for own in turns.values():
        own.sort(key=lambda t: (t[0], t[1] or 0, t[2]))
    rebuilt = {}
    for conv, own in turns.items():
        h = zlib.crc32(str(conv).encode()) % heads
        rebuilt[conv] = [t[3:] for t in turns.get(conv - int(math.fmod(conv, group)), [])[:h] + own[h:]]
    members = collections.defaultdict(list)
    for conv, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(conv)
    children = collections.defaultdict(set)
    for node in members:
        if node:
            children[node[:-1]].add(node)
    leaves, saved = collections.Counter(), collections.Counter()
    for node in members:
        spared = (len(members[node]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += spared
    out = []
    for node, own in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in own if len(rebuilt[c]) == len(node)))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(own), len(node), parent, len(own), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def shingle_set(text, size):
    found = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII_LOWER))
    width = min(size, len(found))
    return {tuple(found[i:i + width]) for i in range(len(found) - width + 1)} if found else set()


def alike_heads(rows, hundredths=85, size=3):
    """``rows``: (id, text); the least id of each row's component, linked by resemblance or by an equal id."""
    sets = [shingle_set(text, size) for _, text in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            same = rows[i][0] is not None and rows[i][0] == rows[j][0]
            if a and sets[j] and (same or 100 * len(a & sets[j]) >= hundredths * len(a | sets[j])):
                root[find(i)] = find(j)
    least = {}
    for i, (name, _) in enumerate(rows):
        if name is not None:
            least[find(i)] = min(name, least.get(find(i), name))
    return [(name, len(s), least.get(find(i)) if s else name) for i, ((name, _), s) in enumerate(zip(rows, sets))]
