"""Plain Python versions of the training-data queries, to test them against."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def targets(rows, weights=(5, 2, 1), times=3):
    """rows of (doc_id, source, text) -> {source: (size, target)}, by resharing until none is above."""
    size = defaultdict(int)
    for _, source, text in rows:
        size[source] += len(SPACE_WORD.findall(text or ""))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, capped = float(sum(size.values())), set()
    while True:
        open_ = [s for s in names if s not in capped]
        level = left / sum(weight[s] for s in open_) if open_ else 0
        above = [s for s in open_ if level * weight[s] > times * size[s]]
        if not above:
            break
        for s in above:
            capped.add(s)
            left -= times * size[s]
    return {s: (size[s], times * size[s] if s in capped else level * weight[s]) for s in names}


def contamination(docs, items, n=10):
    """docs of (doc_id, text), items of (item_id, text) -> {doc_id: (n_words, n_hit, n_items, items_sha256)}."""
    windows = defaultdict(set)
    for item, text in items:
        words = ALNUM_WORD.findall(lower(text))
        k = min(n, len(words))
        for i in range(len(words) - k + 1 if k else 0):
            windows[tuple(words[i : i + k])].add(str(item))
    out = {}
    for doc, text in docs:
        words = ALNUM_WORD.findall(lower(text))
        hit, found = set(), set()
        for k in {len(w) for w in windows}:
            for i in range(len(words) - k + 1):
                if own := windows.get(tuple(words[i : i + k])):
                    hit |= set(range(i, i + k))
                    found |= own
        out[doc] = (len(words), len(hit), len(found), sha(",".join(sorted(found))))
    return out


def secrets(text):
    """(n_assign, n_access, n_hex, base_sha256, base spans)."""
    text = text or ""
    patterns = [
        (re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), 2, 6),
        (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
        (re.compile(r"[0-9a-f]+"), 0, 24),
    ]
    found = [[m.span() for m in p.finditer(text) if len(m[g]) >= least] for p, g, least in patterns]
    spans = sorted((a, k, b) for k, own in enumerate(found) for a, b in own)
    joined = [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans]
    return (*map(len, found), sha(",".join(joined)), joined)


def kept(docs, n=20):
    """docs of (doc_id, text) in ascending order -> {doc_id: (n_words, n_removed, kept_sha256)}."""
    seen, out = set(), {}
    for doc, text in sorted(docs):
        words = SPACE_WORD.findall(text or "")
        gone = set()
        for i in range(len(words) - n + 1):
            window = tuple(words[i : i + n])
            if window in seen:
                gone |= set(range(i, i + n))
            seen.add(window)
        out[doc] = (len(words), len(gone), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))
    return out


def edited(docs):
    """docs of (doc_id, text) -> {doc_id: (n_chars, edited_sha256)}."""
    docs = sorted((d, t or "") for d, t in docs)
    out = {}
    for i, (doc, text) in enumerate(docs):
        half = len(text) // 2
        out[doc] = (len(text), sha(text[: len(text) - half] + docs[(i + 1) % len(docs)][1][:half]))
    return out


def components(docs, n=5, num=80, den=100):
    """docs of (doc_id, text) -> {doc_id: (n_shingles, component_id)}."""
    sets = {}
    for doc, text in docs:
        words = SPACE_WORD.findall(lower(text))
        sets[doc] = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())
    holders = defaultdict(list)
    for doc in sorted(sets):
        for shingle in sets[doc]:
            holders[shingle].append(doc)
    root = {doc: doc for doc in sets}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for doc in sets:
        shared = defaultdict(int)
        for shingle in sets[doc]:
            for other in holders[shingle]:
                if other > doc:
                    shared[other] += 1
        for other, both in shared.items():
            if den * both >= num * (len(sets[doc]) + len(sets[other]) - both):
                a, b = find(doc), find(other)
                root[max(a, b)] = min(a, b)
    return {doc: (len(sets[doc]), find(doc)) for doc in sets}


def tokens(docs, tokenizer, end=0):
    """docs of (doc_id, text) -> {doc_id: (start, n_tokens, ids_crc32)}."""
    at, out = 0, {}
    for doc, text in sorted(docs):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]
        out[doc] = (at, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)))
        at += len(ids)
    return out


def chats(rows):
    """rows of (conv_id, turn, role, text) -> {conv_id: (n_turns, turns_sha256, loss_chars, loss_sha256)}."""
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn, role or "", text or ""))
    out = {}
    for conv, turns in groups.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss))
    return out
