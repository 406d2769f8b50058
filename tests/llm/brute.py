"""Plain versions of the operators for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def order(key):
    """Null keys come after all others."""
    return (key is None, key or 0)


def repeats(rows, length=50, whole=False):
    """``(key, n_bytes, n_removed, n_spans, kept)`` for rows of key, text."""
    first = {}
    held = [(k, (t or "").encode()) for k, t in rows]
    for k, b in sorted(held, key=lambda r: order(r[0])):
        for i in range(len(b) - length + 1):
            first.setdefault(b[i : i + length], order(k))
    out = []
    for k, b in held:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < order(k):
                gone[i : i + length] = b"\1" * length
        if whole:
            at = 0
            for ch in b.decode():
                n = len(ch.encode())
                if not all(gone[at : at + n]):
                    gone[at : at + n] = bytes(n)
                at += n
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((k, len(b), sum(gone), spans, kept))
    return out


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def simhash(text, words=3) -> int:
    w = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_components(prints: list[int], budget=2) -> list[int]:
    """Place of the first fingerprint that chains of near ones reach, for each place."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= budget:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def edited(rows):
    """``(key, n_chars, sha of the edited text)`` for distinct integer keys, in falling order."""
    rows = sorted(rows, key=lambda r: -r[0])
    out = []
    for i, (k, t) in enumerate(rows):
        t, after = t or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(t) // 2
        out.append((k, len(t), sha((t[: len(t) - half] + after[:half]).encode())))
    return out


def line_counts(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [l for l in t.split("\n") if WORD.search(l)]
    windows = {}
    for i in range(len(w) - 2):
        windows.setdefault(tuple(w[i : i + 3]), []).append(i)
    repeated = {p + k for places in windows.values() if len(places) > 1 for p in places for k in range(3)}
    n_repeat = len(repeated)
    return (
        len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), n_repeat,
        len(w) < 50 or 100 * n_repeat > 50 * len(w),
    )


RUN = re.compile("[A-Za-zÀ-ÿ]+")


def counted(rows, every=97, least=5):
    """How often each word occurs, for rows of key, text."""
    n = {}
    for k, t in rows:
        for w in RUN.findall(t or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if k is None else k}:{w}".encode())
            if every and h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= least:
                n[w] = n.get(w, 0) + 1
    return n


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def variants(n):
    """``(word, form, root, n, n_near, form_n)`` by comparing all words with all."""
    form, near = {}, {}
    for w in n:
        near[w] = [v for v in n if v != w and abs(len(v) - len(w)) < 2 and one_edit(w, v)]
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return out


def periodic_runs(words):
    """``(start, length, period)`` of every run, by trying each period at each place."""
    n, out = len(words), []
    code = {}
    at = [code.setdefault(w, len(code)) for w in words]
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and at[j] == at[j + p]:
                j += 1
            length = j - i + p
            if j > i and length >= max(6, 4 * p):
                run = at[i : i + length]
                if all(run[q:] != run[:-q] for q in range(1, p)):
                    out.append((i, length, p))
            i = j + 1
    return sorted(out)


def collapsed(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def planted(key, words):
    h = zlib.crc32(str(key).encode())
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
