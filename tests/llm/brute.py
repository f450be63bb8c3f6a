"""Plain Python versions of the operators, for small tables."""
import re
import string

_FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SPACES = " \t\n\x0b\f\r"


def lower(text):
    return (text or "").translate(_FOLD)


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def line_dedup(rows):
    """rows: [(doc_id, text)] with distinct ids -> {doc_id: (lines, dropped, kept text)}."""
    key = lambda line: lower(line.strip(SPACES))
    owner = {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        for line in (text or "").split("\n"):
            owner.setdefault(key(line), doc)
    out = {}
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or owner[key(x)] == doc]
        out[doc] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def contaminated(docs, items, window=13):
    """-> {doc_id: (words, hit words, item ids)}."""
    windows = {}
    for item, text in items:
        w = plain_words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[i:i + window]), set()).add(item)
    sizes = {len(k) for k in windows}
    out = {}
    for doc, text in docs:
        w, hit, found = plain_words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(w[i:i + n])]
        out[doc] = (len(w), len(hit), sorted(x for x in found if x is not None))
    return out


def rule_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, dup = [], 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            dup += line in lines
            lines.append(line)
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
       "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def pii_base(text):
    """[(kind, start, end)] by start, then kind."""
    out = []
    for k, (kind, pattern) in enumerate(PII.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            double = [int(c) * (1 + i % 2) for i, c in enumerate(digits[::-1])]
            good = {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else 0,
                    "card": 14 <= len(digits) <= 19 and sum(d // 10 + d % 10 for d in double) % 10 == 0, "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), k, kind, m.end()))
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


def exact_copies(rows):
    """rows: [(doc_id, text)] with distinct ids -> [(id, keep id, group size, kept, sha256)]."""
    import hashlib
    groups = {}
    for doc, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(doc)
    return [(d, min(g), len(g), d == min(g), hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for d in g]


def rebuilt(rows, every=5, most=8):
    """rows: [(conv_id, turn, role, text)] with distinct turns -> {conv_id: [(role, text)]}."""
    import zlib
    own = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0)):
        own.setdefault(c, []).append((role or "", text or ""))
    h = {c: zlib.crc32(str(c).encode()) % (most + 1) for c in own}
    return {c: own.get(c - c % every, [])[: h[c]] + t[h[c]:] for c, t in own.items()}


def trie(convs):
    """{conv_id: [(role, text)]} -> [(conv_id, depth, parent, members, children, leaves, saved, sha256)]."""
    import hashlib
    members, out = {}, []
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    for node, ids in members.items():
        below = [k for k in members if k[: len(node)] == node]
        parents = {k[:-1] for k in members if k}
        ends = sorted(c for c in ids if len(convs[c]) == len(node))
        out.append((min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), sum(1 for k in below if len(k) == len(node) + 1), sum(1 for k in below if k not in parents),
                    sum((len(members[k]) - 1) * len(k[-1][1].encode()) for k in below if k), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return out


def whitened(vectors, top=16):
    """vectors: list of integer lists -> (n, S, values, components as columns) of the covariance of the distinct ones."""
    import numpy as np
    fit = np.array(sorted(set(map(tuple, vectors))), dtype=np.int64)
    sums = fit.sum(0)
    off = (fit - fit[0]) - (sums - len(fit) * fit[0]) / len(fit)
    values, axes = np.linalg.eigh(off.T @ off / len(fit))
    return len(fit), sums, values[::-1][:top], axes[:, ::-1][:, :top], values.sum()
