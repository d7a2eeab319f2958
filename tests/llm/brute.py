"""Plain Python forms of the operators' results, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import regex
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def ascii_lower(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def quality_base(docs):
    """doc_id -> n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    out = {}
    for doc, text in docs:
        text = text or ""
        words = WORD.findall(text)
        grams = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
        often = {g for g, n in Counter(grams).items() if n > 1}
        covered = {i + j for i, g in enumerate(grams) if g in often for j in range(8)}
        lines = [line for line in text.split("\n") if WORD.search(line)]
        n, r = len(words), len(covered)
        out[doc] = (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), r, n < 20 or 100 * r > 30 * n)
    return out


def substrings(docs, width=13):
    """(doc_id, n_words, n_removed, sha of the kept words), one for each row."""
    first = {}
    for doc, text in docs:
        words = WORD.findall(text or "")
        for i in range(len(words) - width + 1):
            win = tuple(words[i:i + width])
            if doc is not None:
                first[win] = min(first.get(win, doc), doc)
    out = []
    for doc, text in docs:
        words = WORD.findall(text or "")
        gone = {i + j for i in range(len(words) - width + 1) for j in range(width)
                if doc is not None and first[tuple(words[i:i + width])] < doc}
        out.append((doc, len(words), len(gone), sha(" ".join(w for i, w in enumerate(words) if i not in gone))))
    return out


def lines(docs, min_chars=20, min_docs=3):
    """(doc_id, n_lines, n_dropped, sha of the kept lines), one for each row."""
    key = lambda line: ascii_lower(line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for doc, text in docs:
        for line in (text or "").split("\n"):
            if doc is not None and len(key(line)) >= min_chars:
                holders[key(line)].add(doc)
    out = []
    for doc, text in docs:
        found = (text or "").split("\n")
        kept = [x for x in found if doc is None or len(holders[key(x)]) < min_docs or doc == max(holders[key(x)])]
        out.append((doc, len(found), len(found) - len(kept), sha("\n".join(kept))))
    return out


def token_rows(docs, tokenizer, end_id=2):
    """(doc_id, start, n_tokens, crc32) in ascending id order."""
    out, start = [], 0
    for doc, text in sorted(docs):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, end_id]
        out.append((doc, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def components(docs, width=2, percent=80):
    """doc_id -> (size of the set, smallest reachable doc_id), by comparing all pairs."""
    sets = {}
    for doc, text in docs:
        words = WORD.findall(ascii_lower(text or ""))
        sets[doc] = {tuple(words[i:i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} if words else set()
    root = {doc: doc for doc in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {doc: (len(s), find(doc)) for doc, s in sets.items()}


def coded(docs, tokenizer):
    """(doc_id, n_tokens, sha of the ids, sha of the decoded text)."""
    out = []
    for doc, text in docs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        out.append((doc, len(ids), sha(" ".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False))))
    return out


KINDS = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 12 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15)]


def luhn(number):
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(number))) % 10 == 0


def personal(text):
    """Counts by kind, and the base spans as text."""
    spans = [(m.start(), k, m.end(), name) for k, (name, pattern, valid) in enumerate(KINDS) for m in pattern.finditer(text or "") if valid(m[0])]
    return tuple(sum(s[1] == k for s in spans) for k in range(4)), ",".join(f"{n}:{a}:{b}" for a, _, b, n in sorted(spans))


def leaks(docs, items, threshold=0.8):
    """(doc_id, item_id) -> highest weighted similarity of a window of the item's size, if it reaches the threshold."""
    def words(text):
        alone = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]\p{M}*"
        return [w for run in regex.findall(r"[\p{L}\p{M}\p{N}_]+", (text or "").lower()) for w in regex.sub(f"({alone})", r" \1 ", run).split()]

    def weighted(tokens, width):
        out = Counter()
        for i in range(len(tokens) - width + 1):
            gram = tuple(tokens[i:i + width])
            out[gram] += sum(len(w.encode()) for w in gram)
        return out

    targets = [(i, words(t), weighted(words(t), min(5, len(words(t))))) for i, t in items if words(t)]
    by_gram = defaultdict(set)
    for place, (_, _, grams) in enumerate(targets):
        for gram in grams:
            by_gram[gram].add(place)
    out = {}
    for doc, text in docs:
        tokens = words(text)
        near = {p for w in range(1, 6) for i in range(len(tokens) - w + 1) for p in by_gram.get(tuple(tokens[i:i + w]), ())}
        for place in near:
            item, target, grams = targets[place]
            for i in range(max(1, len(tokens) - len(target) + 1)):
                window = weighted(tokens[i:i + len(target)], min(5, len(target)))
                both = sum((window & grams).values())
                score = both / (sum(window.values()) + sum(grams.values()) - both)
                if score >= threshold:
                    out[doc, item] = max(score, out.get((doc, item), 0))
    return out


def collocations(docs, min_count=100, max_words=5, top=2000):
    """(lang, rank, phrase, a, l, r, n, score) of documents (text, lang), in order."""
    counts, totals, out = defaultdict(Counter), Counter(), []
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", ascii_lower(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            counts[lang].update(tuple(words[i:i + k]) for k in range(1, max_words + 1) for i in range(len(words) - k + 1))
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        inside = {p[i:i + k] for p, a in candidates.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if a >= f[p[i:i + k]]}
        ranked = []
        for p, a in candidates.items():
            score, k = min((1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]], p not in inside))
        for rank, (score, a, phrase, left, right, _) in enumerate([x for x in sorted(ranked) if x[-1]][:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def simhash(text, width=3):
    words = WORD.findall(ascii_lower(text or ""))
    parts = [" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def fingerprint_groups(docs, radius=2):
    """(doc_id, fingerprint, component_id), one for each row; rows of one id are one document."""
    prints = [(doc, simhash(text)) for doc, text in docs]
    root = {doc: doc for doc, _ in prints if doc is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(prints):
        for b, y in prints[:i]:
            if a is not None and b is not None and (x ^ y).bit_count() <= radius:
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return [(doc, f"{x:016x}", None if doc is None else find(doc)) for doc, x in prints]


def clusters(rows, k=40, rounds=5, dims=64, scale=256, seed="2"):
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of rows (vec_id, vector)."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted(((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None))
    centroids = [v for _, v in named[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds if centroids else 0):
        members = defaultdict(list)
        for _, v in kept:
            members[nearest(v)[1]].append(v)
        centroids = [[sum(x) // len(members[j]) for x in zip(*members[j])] if members[j] else c for j, c in enumerate(centroids)]
    if not centroids:
        return []
    found = [(i, *nearest(v)) for i, v in kept]
    inertia = Counter()
    for _, d, j in found:
        inertia[j] += d
    return [(i, j, d, inertia[j], sum(inertia.values()), sha(",".join(map(str, centroids[j])))) for i, d, j in found]
