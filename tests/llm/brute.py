"""Plain Python versions of the operators' contracts, to hold results against."""

import bisect
import hashlib
import re

import xxhash

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def pii_base(text: str | None) -> list[tuple[str, int, int]]:
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                "card": 16 <= len(digits) <= 19 and luhn(digits),
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def pii_digest(text: str | None) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in pii_base(text)).encode()).hexdigest()


def words(text: str | None) -> list[str]:
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x20\x09-\x0D]+", lower) if w]


def simhash(text: str | None, size: int = 3) -> int:
    w = words(text)
    shingles = [" ".join(w[k : k + size]) for k in range(len(w) - size + 1)] if len(w) >= size else [" ".join(w)] if w else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), seed=42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if counts[b] * 2 > len(shingles))


def simhash_components(prints: dict[int, int], bits: int = 3) -> dict[int, int]:
    import numpy as np

    ids = sorted(prints)
    fp = np.array([prints[i] for i in ids], dtype=np.uint64)
    root = list(range(len(ids)))

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for k in range(len(ids)):
        for j in np.nonzero(np.bitwise_count(fp[k + 1 :] ^ fp[k]) <= bits)[0]:
            a, b = find(k), find(k + 1 + int(j))
            root[max(a, b)] = min(a, b)
    return {i: ids[find(k)] for k, i in enumerate(ids)}


def lines_kept(docs: list[tuple], least: int = 10) -> list[tuple[int, int, str]]:
    """Of (doc_id, text) rows: lines, lines dropped, and what is left; rows of one id are one document, those without an id the last."""
    white = " \t\n\x0b\f\r"

    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(white))

    first, holders = {}, {}
    for i, text in docs:
        for line in (text or "").split("\n"):
            k, i_ = key(line), float("inf") if i is None else i
            if len(k) >= least:
                first[k] = min(first.get(k, i_), i_)
                holders.setdefault(k, set()).add(i_)
    out = []
    for i, text in docs:
        i_ = float("inf") if i is None else i
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or len(holders[key(x)]) < 2 or first[key(x)] == i_]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def negatives(rows: list[tuple], every: int = 50, positives: int = 5, most: int = 3) -> list[tuple]:
    """Of (vec_id, label, embedding) rows: (anchor, positive, rank, negative, positive's score, negative's score)."""
    import math

    part = set()
    for i, label, x in rows:
        if label is not None and x is not None and all(v is not None and math.isfinite(v) for v in x):
            part.add((i, label, tuple(math.floor(256 * v) for v in x)))
    part = sorted(part, key=repr)
    out = []
    last = float("inf")
    for a in (r for r in part if r[0] is not None and r[0] % every == 0):
        scored = sorted(((-sum(p * q for p, q in zip(a[2], r[2])), last if r[0] is None else r[0], r) for r in part if r is not a), key=lambda x: (x[0], x[1], repr(x[2])))
        for s, _, r in [x for x in scored if x[2][1] == a[1]][:positives]:
            inside = [x for x in scored if x[2][1] != a[1] and 50 * -s <= 100 * -x[0] <= 95 * -s][:most]
            out += [(a[0], r[0], k + 1, x[2][0], -s, -x[0]) for k, x in enumerate(inside)]
    return out


def alignment(texts: list[str | None], a_path: str, b_path: str) -> list[tuple]:
    """Of each text, encoded whole by both tokenizers: tokens of each, groups, links, best links, sum of counts, groups as text."""
    from collections import Counter, defaultdict
    from itertools import accumulate

    import sentencepiece
    from tokenizers import Tokenizer

    a_all, b_all = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    a_all.encode_special_tokens = True
    stand = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
    letter = {chr(b): b for b in range(256) if b not in stand} | {chr(256 + k): b for k, b in enumerate(stand)}

    def b_bytes(i):
        return bytes([int(b_all.id_to_piece(i)[3:5], 16)]) if b_all.is_byte(i) else b_all.id_to_piece(i).replace("▁", " ").encode()

    found, counts = [], Counter()
    for text in texts:
        groups = []
        if text:
            a, b = a_all.encode(" " + text, add_special_tokens=False).ids, b_all.encode(text)
            a_raw, b_raw = [bytes(letter[c] for c in a_all.id_to_token(i)) for i in a], [b_bytes(i) for i in b]
            if b"".join(a_raw) == b"".join(b_raw) == (" " + text).encode():
                a_end, b_end = list(accumulate(map(len, a_raw))), list(accumulate(map(len, b_raw)))
                by = defaultdict(lambda: ([], []))
                ends = sorted({*a_end} & {*b_end})
                for side, (ids, at) in enumerate(((a, a_end), (b, b_end))):
                    for i, e in zip(ids, at):
                        by[ends[bisect.bisect_left(ends, e)]][side].append(i)
                groups = [by[e] for e in ends]
        pairs = Counter()
        for a, b in groups:
            ca, cb = Counter(a), Counter(b)
            for i, n in ca.items():
                for j, m in cb.items():
                    pairs[i, j] += n * m
        found.append((groups, pairs))
        counts.update(pairs.keys())
    best = defaultdict(int)
    for (i, _), n in counts.items():
        best[i] = max(best[i], n)
    return [
        (sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(p.values()), sum(m for k, m in p.items() if counts[k] == best[k[0]]), sum(m * counts[k] for k, m in p.items()),
         ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g))
        for g, p in found
    ]
