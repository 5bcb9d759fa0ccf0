"""Cross-tokenizer alignment: which tokens of two tokenizers stand for the same bytes, and how often their ids meet.

A worker encodes its texts by both tokenizers and cuts them where tokens of both end. Texts are cut into units first, at
single spaces between characters that are no white space: neither a byte-level BPE with the usual pattern nor a piece BPE,
whose pieces have the space mark only in front, has a token across such a place, so a unit is encoded and aligned once for all its
occurrences at hand.

What is shuffled are postings: for each pair of ids its documents and multiplicities, packed by chunks of neighbouring
documents and dealt by the id of the first tokenizer. Chunks are counted before that, so that a pair of every document costs a row a task.
Counts of pairs meet the postings in a cogroup, dealt by buckets of first ids and, so that frequent ids are split, by slices of chunks:
Spark sorts and spills both streams, each task finds its ids' highest counts and gives every document's share, and shares are
summed by document. Buckets and slices grow in number with pairs and postings, so tasks stay as large as they are.

Defined cases: null and empty texts, and texts whose tokens of either side don't spell the space and the text, have no tokens;
every row is a document of its own, repeated rows and rows without an id too; ties for the highest count are all best; very long texts are
encoded whole; an empty table gives an empty table; other columns are ignored (:func:`alignment_report`), whatever their names.
"""

from __future__ import annotations

import itertools
import json
import re
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, pieces

A_MODEL = "/opt/tokenizers/byte_bpe_50k.json"
B_MODEL = pieces.MODEL
#: Units that a worker remembers, twice.
MEMO_UNITS = 150_000
#: Pairs in a bucket and postings in a slice of it, about; entries that a task counts before it hands them on.
BUCKET_PAIRS, SLICE_POSTINGS, COUNTED = 1_000_000, 4_000_000, 2_000_000
#: Pairs of occurrences in a group beyond which its distinct ids are paired instead.
LARGE_GROUP = 100_000
#: White space but the space itself, as Unicode has it.
WHITE = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0                　"
#: How byte-level BPE cuts texts before it merges: a fixed value.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BETWEEN = re.compile(r"(?<=\S) (?=\S)")


def units(text: str) -> list[str]:
    """Parts of a text that both tokenizers encode apart, each without the space before it."""
    odd = "  " in text or text[0].isspace() or text[-1].isspace() or any(c in text and (" " + c in text or c + " " in text) for c in WHITE)
    return BETWEEN.split(text) if odd else text.split(" ")


def byte_letters() -> dict[str, int]:
    """Bytes by the letters that stand for them in a byte-level vocabulary: printable ones for themselves, the others for letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def plain_encoder(settings: dict, spelled: list[bytes]):
    """The same BPE with its ids as ranks, which is faster; None if ids don't ascend with merges, or texts are cut or changed otherwise than by the usual pattern."""
    import tiktoken

    model, before = settings["model"], settings["pre_tokenizer"] or {}
    merged = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
    usual = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and settings["normalizer"] is None and not model.get("ignore_merges")
    special = {x["id"] for x in settings.get("added_tokens", [])}
    ranks = {raw: i for i, raw in enumerate(spelled) if i not in special}
    if not usual or merged != sorted(merged) or max(ranks.get(bytes([b]), 1 << 30) for b in range(256)) >= min(merged):
        return None
    return tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class Tokenizers:
    """Both tokenizers in a worker, and each id's bytes."""

    def __init__(self, a_json: str, b_model: bytes):
        import os

        import numpy as np
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_str(a_json)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        letters = byte_letters()
        settings = json.loads(a_json)
        vocabulary = settings["model"]["vocab"]
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
        self.a_plain = plain_encoder(settings, self.a_bytes)
        ids = range(self.b.get_piece_size())
        self.b_bytes = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace(pieces.SPACE, " ").encode() for i in ids]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in some], np.int64) for some in (self.a_bytes, self.b_bytes))
        # ids as text, with what may follow them: another of the same side, and the end of the side in its group
        self.said = [f"{i}{c}" for some, ends in ((self.a_bytes, ",|"), (self.b_bytes, ",;")) for c in ends for i in range(len(some))]


class Aligner:
    """Encodes and aligns units; remembers those seen lately.

    A unit's entry: its groups as text, then as bytes of integers: tokens of each side, groups and links; the keys (first id << 32 | second id) of
    its pairs; their multiplicities, nothing if all are 1. Or None if the tokens don't spell the unit."""

    def __init__(self, tokenizers: Tokenizers):
        self.t, self.young, self.old = tokenizers, {}, {}

    def entries(self, wanted: list[str]) -> list[tuple | None]:
        young, old, new = self.young, self.old, []
        found = [young.get(u, 0) for u in wanted]
        for k, e in enumerate(found):
            if e == 0:
                u = wanted[k]
                e = old.get(u, 0)
                if e == 0:
                    new.append(u)
                else:
                    found[k] = young[u] = e
        fresh = {}
        lo = size = 0
        for k, u in enumerate(new):  # so many units at a time that their arrays stay small
            size += len(u)
            if size > 500_000 or k + 1 == len(new):
                fresh.update(self.aligned(new[lo : k + 1]))
                lo, size = k + 1, 0
        if fresh:
            found = [fresh[u] if e == 0 else e for u, e in zip(wanted, found, strict=True)]
            young.update((u, e) for u, e in fresh.items() if len(u) < 64)
        if len(young) > MEMO_UNITS:
            self.young, self.old = {}, young
        return found

    def aligned(self, some: list[str]) -> dict[str, tuple | None]:
        """Units that begin and end without white space are encoded by the first tokenizer in one go, as no token crosses the space between them."""
        plain = [u for u in some if not u[0].isspace() and not u[-1].isspace()]
        odd = [u for u in some if u[0].isspace() or u[-1].isspace()]
        out = self._together(plain) if plain else {}
        return out | self._apart(odd) if odd else out

    def _together(self, some: list[str]) -> dict[str, tuple | None]:
        import numpy as np

        t = self.t
        spelled = [(" " + u).encode("utf-8", "replace") for u in some]
        text = " " + " ".join(some)
        a = t.a_plain(text) if t.a_plain else t.a.encode(text, add_special_tokens=False).ids
        b = t.b.encode(some, num_threads=1)
        whole = b"".join(spelled)
        b_flat = [i for x in b for i in x]
        if b"".join([t.a_bytes[i] for i in a]) != whole or b"".join([t.b_bytes[i] for i in b_flat]) != whole:
            return self._apart(some)
        a, b_flat = np.array(a, np.int64), np.array(b_flat, np.int64)
        a_end, b_end = np.cumsum(t.a_sizes[a]), np.cumsum(t.b_sizes[b_flat])
        unit_end = np.cumsum([len(x) for x in spelled])
        at = np.searchsorted(a_end, unit_end)
        if (a_end[at] != unit_end).any() or (b_end[np.cumsum([len(x) for x in b]) - 1] != unit_end).any():
            return self._apart(some)
        return dict(zip(some, self._entries(a, b_flat, a_end, b_end, unit_end), strict=True))

    def _apart(self, some: list[str]) -> dict[str, tuple | None]:
        import numpy as np

        t, out = self.t, dict.fromkeys(some)
        spelled = [(" " + u).encode("utf-8", "replace") for u in some]
        a_ids = [e.ids for e in t.a.encode_batch_fast([" " + u for u in some], add_special_tokens=False)]
        b_ids = t.b.encode(some, num_threads=1)
        sound = [k for k, (s, a, b) in enumerate(zip(spelled, a_ids, b_ids, strict=True)) if b"".join([t.a_bytes[i] for i in a]) == s and b"".join([t.b_bytes[i] for i in b]) == s]
        if sound:
            a, b = (np.array([i for k in sound for i in ids[k]], np.int64) for ids in (a_ids, b_ids))
            unit_end = np.cumsum([len(spelled[k]) for k in sound])
            out.update(zip((some[k] for k in sound), self._entries(a, b, np.cumsum(t.a_sizes[a]), np.cumsum(t.b_sizes[b]), unit_end), strict=True))
        return out

    def _entries(self, a, b, a_end, b_end, unit_end) -> list[tuple]:
        """Entries of units that follow each other, from the ids and ends of their tokens."""
        import numpy as np

        t, n = self.t, len(unit_end)
        ends = np.intersect1d(a_end, b_end)
        a_group, b_group = np.searchsorted(ends, a_end), np.searchsorted(ends, b_end)
        n_a, n_b = np.bincount(a_group, minlength=len(ends)), np.bincount(b_group, minlength=len(ends))
        links = n_a * n_b
        group_unit = np.searchsorted(unit_end, ends)  # the unit that a group lies in
        first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        # pairs of small groups, occurrence by occurrence
        many = np.where(links <= LARGE_GROUP, n_b, 0)[a_group]
        left = np.repeat(np.arange(len(a)), many)
        right = np.arange(len(left)) - np.repeat(np.cumsum(many) - many - first_b[a_group], many)
        keys, owner, mults = a[left] << 32 | b[right], group_unit[a_group[left]], None
        if (large := np.nonzero(links > LARGE_GROUP)[0].tolist()):
            mults = np.ones(len(keys), np.int64)
            for g in large:
                (x, nx), (y, ny) = (np.unique(ids[f : f + m], return_counts=True) for ids, f, m in ((a, first_a[g], n_a[g]), (b, first_b[g], n_b[g])))
                keys = np.concatenate([keys, (x[:, None] << 32 | y).ravel()])
                mults = np.concatenate([mults, (nx[:, None] * ny).ravel()])
                owner = np.concatenate([owner, np.full(len(x) * len(y), group_unit[g])])
            order = np.argsort(owner, kind="stable")
            keys, mults, owner = keys[order], mults[order].astype("<i8").tobytes(), owner[order]
        pair_at = (8 * np.searchsorted(owner, np.arange(n + 1))).tolist()
        group_at = np.searchsorted(group_unit, np.arange(n + 1))
        summed = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[group_at])
        sizes = [summed(x) for x in (n_a, n_b, np.ones(len(ends), np.int64), links)]
        stats = np.stack(sizes, 1).astype("<i8").tobytes()
        # ids in the order they are told in: a group's first side, then its second
        code = np.empty(len(a) + len(b), np.int64)
        wide_a, wide_b = len(t.a_bytes), len(t.b_bytes)
        code[np.arange(len(a)) + first_b[a_group]] = a + wide_a * (np.arange(len(a)) == (first_a + n_a - 1)[a_group])
        code[np.arange(len(b)) + (first_a + n_a)[b_group]] = b + 2 * wide_a + wide_b * (np.arange(len(b)) == (first_b + n_b - 1)[b_group])
        words = list(map(t.said.__getitem__, code.tolist()))
        word_at = [0, *np.cumsum(sizes[0] + sizes[1]).tolist()]
        raw = keys.astype("<i8").tobytes()
        return [
            ("".join(words[lo:hi])[:-1], stats[32 * k : 32 * k + 32], raw[p:q], b"" if mults is None else mults[p:q])
            for k, (lo, hi, p, q) in enumerate(zip(word_at, word_at[1:], pair_at, pair_at[1:], strict=False))
        ]


class _Numbered(dict):
    """Numbers what it is asked for in the order of the first questions."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def chunk_of(aligner: Aligner, texts: list[str | None]):
    """Of neighbouring documents: a list of (n_a, n_b, n_groups, n_links, groups as text or ''), and their postings: sorted keys, documents a key, places of documents, multiplicities."""
    import numpy as np

    number = _Numbered()
    cut = [list(map(number.__getitem__, units(t))) if t else [] for t in texts]
    names = list(number)
    entries = aligner.entries(names)
    bad = {k for k, e in enumerate(entries) if e is None}
    if bad:  # whole texts then: units of which one isn't spelled may yet spell the text together
        for d, words in enumerate(cut):
            if not bad.isdisjoint(words):
                (whole,) = aligner.aligned([texts[d]]).values()
                cut[d] = [] if whole is None else [len(entries)]
                if whole is not None:
                    entries.append(whole)
    entries = [e or ("", bytes(32), b"", b"") for e in entries]
    stats = np.frombuffer(b"".join([e[1] for e in entries]), "<i8").reshape(-1, 4)
    said = [e[0] for e in entries]
    sizes = np.array([len(e[2]) // 8 for e in entries], np.int64)
    keys = np.frombuffer(b"".join([e[2] for e in entries]), "<i8")
    mults = np.ones(len(keys), np.int64)
    for k, e in enumerate(entries):
        if e[3]:
            at = int(sizes[:k].sum())
            mults[at : at + sizes[k]] = np.frombuffer(e[3], "<i8")
    docs = []
    flat = np.fromiter(itertools.chain.from_iterable(cut), np.int64)
    lengths = np.array([len(words) for words in cut], np.int64)
    at = 0
    for words in cut:
        n = len(words)
        docs.append((*(stats[flat[at : at + n]].sum(axis=0).tolist() if n else (0, 0, 0, 0)), ";".join([said[w] for w in words])))
        at += n
    # each document's units once, then their pairs
    both, times = np.unique(np.repeat(np.arange(len(texts)), lengths) * max(1, len(entries)) + flat, return_counts=True)
    doc, unit = both // max(1, len(entries)), both % max(1, len(entries))
    many = sizes[unit]
    start = np.cumsum(sizes) - sizes
    pick = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many - start[unit], many)
    distinct, place = np.unique(keys, return_inverse=True)
    posting = place[pick] * len(texts) + np.repeat(doc, many)
    order = np.argsort(posting, kind="stable")
    posting, weight = posting[order], (mults[pick] * np.repeat(times, many))[order]
    first = np.nonzero(np.diff(posting, prepend=-1))[0]
    total = np.add.reduceat(weight, first) if len(first) else weight
    posting = posting[first]
    which = posting // max(1, len(texts))
    each = np.bincount(which, minlength=len(distinct))
    return docs, (distinct[each > 0], each[each > 0], posting % max(1, len(texts)), total)


def packed(keys, each, docs, mults) -> bytes:
    import numpy as np
    import zstandard

    head = np.array([len(keys), len(docs)], "<i8").tobytes()
    body = [np.diff(keys, prepend=0).astype("<i8"), each.astype("<u4"), docs.astype("<u4"), mults.astype("<i8")]
    # by bytes of the same worth, which are mostly zeros
    planes = [np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes() for x in body]
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(planes))


def unpacked(blob: bytes):
    import numpy as np
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, m = np.frombuffer(raw, "<i8", 2).tolist()
    at, out = 16, []
    for count, kind in ((n, "<i8"), (n, "<u4"), (m, "<u4"), (m, "<i8")):
        wide = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, count * wide, at).reshape(wide, count).T).view(kind).ravel())
        at += count * wide
    return np.cumsum(out[0]), out[1].astype(np.int64), out[2].astype(np.int64), out[3]


ENCODED = "chunk long, at int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, postings binary"


def encoded(docs: DataFrame, a_path: str = A_MODEL, b_path: str = B_MODEL, text: str = "text", doc: str = "doc_id", digest: bool = True) -> DataFrame:
    """A row a document (chunk, at, ..., groups or their SHA-256) and, with a negative ``at``, one a chunk with its postings."""
    spark = docs.sparkSession
    common.small_batches(spark)
    held = spark.sparkContext.broadcast((Path(a_path).read_text(encoding="utf-8"), Path(b_path).read_bytes()))

    def run(batches):
        import gc
        import hashlib

        import pyarrow as pa
        from pyspark import TaskContext

        gc.disable()  # what is remembered has no cycles, and looking for some takes a fifth of the time
        aligner, chunk = Aligner(Tokenizers(*held.value)), TaskContext.get().partitionId() << 33
        schema = pa.schema([("chunk", pa.int64()), ("at", pa.int32()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups", pa.string()), ("postings", pa.binary())])
        try:
            for batch in (part for whole in batches for part in pieces.slices(whole, 1)):
                done, postings = chunk_of(aligner, batch.column(1).to_pylist())
                n = len(done)
                said = [hashlib.sha256(x[4].encode()).hexdigest() if x[4] and digest else x[4] for x in done]
                yield pa.RecordBatch.from_arrays([
                    pa.array([chunk] * (n + 1), pa.int64()), pa.array([*range(n), -1], pa.int32()), pa.array([*batch.column(0).to_pylist(), None], pa.int64()),
                    *(pa.array([*(x[k] for x in done), None], pa.int64()) for k in range(4)), pa.array([*said, None], pa.string()), pa.array([None] * n + [packed(*postings)], pa.binary()),
                ], schema=schema)
                chunk += 1
        finally:
            gc.enable()

    return docs.select(F.col(doc).cast("long"), F.col(text)).mapInArrow(run, ENCODED)


def pair_counts(held: DataFrame) -> DataFrame:
    """a, b, n: in how many documents each pair of ids is linked. Tasks add up their chunks first."""

    def count(batches):
        import numpy as np
        import pyarrow as pa

        keys, sums, size = [], [], 0

        def added():
            k, at = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.zeros(len(k), np.int64)
            np.add.at(n, at, np.concatenate(sums))
            return k, n

        def told(k, n):
            for lo in range(0, len(k), 100_000):
                part = k[lo : lo + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array((part >> 32).astype(np.int32)), pa.array((part & 0xFFFFFFFF).astype(np.int32)), pa.array(n[lo : lo + 100_000])], names=["a", "b", "n"])

        for batch in batches:
            for blob in batch.column(0).to_pylist():
                k, n, _, _ = unpacked(blob)
                keys.append(k)
                sums.append(n)
                size += len(k)
                if size > COUNTED:
                    k, n = added()
                    if len(k) > COUNTED // 2:
                        yield from told(k, n)
                        keys, sums, size = [], [], 0
                    else:
                        keys, sums, size = [k], [n], len(k)
        if size:
            yield from told(*added())

    return held.where("at < 0").select("postings").mapInArrow(count, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def contributions(held: DataFrame, counts: DataFrame, buckets: int, slices: list[int]) -> DataFrame:
    """chunk, at, n_best, count_sum: each bucket's shares of documents. ``slices``: into how many parts each bucket's chunks are dealt."""

    def dealt(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys, each, docs, mults = unpacked(blob)
                to = (keys >> 32) % buckets
                posted = np.repeat(to, each)
                rows = []
                for b in np.unique(to).tolist():
                    some, theirs = to == b, posted == b
                    rows.append((b, zlib.crc32(chunk.to_bytes(8, "little")) * slices[b] >> 32, chunk, packed(keys[some], each[some], docs[theirs], mults[theirs])))
                if rows:
                    cols = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary())], names=["bucket", "slice", "chunk", "postings"])

    def together(batches):
        import numpy as np
        import pyarrow as pa
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            bucket, key, n = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            rows = []
            for b in np.unique(bucket).tolist():
                some = bucket == b
                rows.append((b, squeeze.compress(key[some].astype("<i8").tobytes()), squeeze.compress(n[some].astype("<i8").tobytes())))
            cols = list(zip(*rows, strict=True))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], names=["bucket", "keys", "n"])

    def share(postings, counted):
        import numpy as np
        import pyarrow as pa
        import zstandard

        out = [[], [], [], []]
        if postings.num_rows:
            blow = zstandard.ZstdDecompressor()
            key, n = (np.concatenate([np.frombuffer(blow.decompress(x), "<i8") for x in counted.column(c).to_pylist()]) for c in ("keys", "n"))
            order = np.argsort(key)
            key, n = key[order], n[order]
            first = np.nonzero(np.diff(key >> 32, prepend=-1))[0]
            highest = np.repeat(np.maximum.reduceat(n, first), np.diff(first, append=len(n)))
            best = (n == highest).astype(np.int64)
            for chunk, blob in zip(postings.column("chunk").to_pylist(), postings.column("postings").to_pylist(), strict=True):
                keys, each, docs, mults = unpacked(blob)
                at = np.repeat(np.searchsorted(key, keys), each)
                place, where = np.unique(docs, return_inverse=True)
                sums = np.zeros((2, len(place)), np.int64)
                np.add.at(sums[0], where, mults * best[at])
                np.add.at(sums[1], where, mults * n[at])
                for o, x in zip(out, (np.full(len(place), chunk), place, sums[0], sums[1]), strict=True):
                    o.append(x)
        chunk, at, n_best, count_sum = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)
        return pa.table({"chunk": pa.array(chunk, pa.int64()), "at": pa.array(at.astype(np.int32)), "n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64())})

    postings = held.where("at < 0").select("chunk", "postings").mapInArrow(dealt, "bucket int, slice int, chunk long, postings binary")
    counted = counts.select(F.expr(f"a % {buckets}").alias("bucket"), F.expr("shiftleft(cast(a as bigint), 32) | b").alias("key"), "n").repartition("bucket").mapInArrow(together, "bucket int, keys binary, n binary")
    counted = counted.withColumn("slice", F.explode(F.expr(f"sequence(0, get(array({','.join(map(str, slices))}), bucket) - 1)")))
    return postings.groupBy("bucket", "slice").cogroup(counted.groupBy("bucket", "slice")).applyInArrow(share, "chunk long, at int, n_best long, count_sum long")


def aligned(docs: DataFrame, a_path: str = A_MODEL, b_path: str = B_MODEL, text: str = "text", doc: str = "doc_id", digest: bool = True) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups: the groups as text, or the SHA-256 of that."""
    spark = docs.sparkSession
    held = common.staged(encoded(docs, a_path, b_path, text, doc, digest), "alignment")
    counts = common.staged(pair_counts(held), "pair-counts")
    pairs = counts.count()
    buckets = max(1, -(-pairs // BUCKET_PAIRS))
    weights = dict(counts.groupBy(F.expr(f"a % {buckets}").alias("bucket")).agg(F.sum("n")).collect())  # one row a bucket
    cores = max(spark.sparkContext.defaultParallelism, 8)
    slices = [max(-(-weights.get(b, 0) // SLICE_POSTINGS), -(-4 * cores // buckets)) for b in range(buckets)]
    shares = contributions(held, counts, buckets, slices).groupBy("chunk", "at").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    rows = spark.read.schema(held.schema).parquet(held.staged_at).where("at >= 0")
    return rows.join(shares, ["chunk", "at"], "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups")


def alignment_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row."""
    return aligned(docs.select("doc_id", "text")).withColumnRenamed("groups", "groups_sha256")
