"""SentencePiece encoding and decoding over a relational lattice.

Texts are cut into words (a run of the space mark and what follows it: no piece crosses that cut). The
corpus' frequent words, counted over all rows, get a lattice: substrings of bounded length are exploded and equi-joined
to the piece table, edges are grouped by word, and a Spark higher-order ``aggregate`` folds them to a
segmentation. Unigram models are folded by Viterbi. The public model here is a BPE model, on whose
scores the best path isn't the model's result, so its lattice is folded by merging, of the edges that join two
neighbours, the best-scored leftmost one, until none is left.

Documents are then encoded where they lie, with the frequent words' table (at most ``HEAD_WORDS`` rows of
``HEAD_CHARS``) broadcast; other words, of any length, are segmented in the worker without
a lattice, by the same merges (or Viterbi steps). So no text is shuffled and no word is left out.

Defined cases: a null text is empty and has no pieces; characters outside the model become byte pieces; a
text that holds the space mark itself decodes to spaces there, as in the model; rows are encoded each on its own;
an empty table gives an empty table; other columns stay, the added ones replace those of the same name.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

if TYPE_CHECKING:
    import numpy as np

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
HEAD_WORDS, HEAD_CHARS = 300_000, 40
MEMO_WORDS = 200_000
#: Texts that a worker holds as words at a time.
SLICE_BYTES = 2_000_000
UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


@dataclass(frozen=True)
class Pieces:
    """A piece table: (piece, id, score) of the pieces texts can hold, the ids of the 256 byte pieces, and the kind of model."""

    table: tuple[tuple[str, int, float], ...]
    bytes_at: tuple[int, ...]
    unknown: int
    kind: str = "bpe"

    @staticmethod
    def read(path: str = MODEL) -> Pieces:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(m.get_piece_size())
        at = {m.id_to_piece(i): i for i in ids if m.is_byte(i)}
        table = tuple((m.id_to_piece(i), i, m.get_score(i)) for i in ids if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i)))
        kind = {1: "unigram", 2: "bpe"}.get(model_type(m.serialized_model_proto()))
        if kind is None:
            raise ValueError("only unigram and BPE models are read")
        return Pieces(table, tuple(at[f"<0x{b:02X}>"] for b in range(256)) if len(at) == 256 else (), m.unk_id(), kind)

    @property
    def longest(self) -> int:
        return max(len(p) for p, _, _ in self.table)


def model_type(raw: bytes) -> int:
    """What a model file says it is: field 3 (1 unigram, 2 BPE) of the trainer's settings, which are its field 2."""

    def fields(data: bytes):
        at = 0

        def varint() -> int:
            nonlocal at
            value = shift = 0
            while True:
                byte = data[at]
                at += 1
                value |= (byte & 127) << shift
                shift += 7
                if byte < 128:
                    return value

        while at < len(data):
            number, wire = divmod(varint(), 8)
            if wire == 0:
                yield number, varint()
            else:
                size = {1: 8, 5: 4}.get(wire)
                size = varint() if size is None else size
                yield number, data[at : at + size]
                at += size

    settings = next((v for k, v in fields(raw) if k == 2), b"")
    return next((v for k, v in fields(settings) if k == 3), 1)


def lattice(words: DataFrame, pieces: Pieces) -> DataFrame:
    """word and edges: array<struct<s, e, score, id>> in the order of (e, s), of each distinct ``word``."""
    spark = words.sparkSession
    table = spark.createDataFrame(list(pieces.table), "piece string, id int, score double")
    cut = words.select("word", F.explode(F.expr("sequence(0, length(word) - 1)")).alias("s"))
    cut = cut.select("word", "s", F.explode(F.expr(f"sequence(s + 1, least(s + {pieces.longest}, length(word)))")).alias("e"))
    edges = cut.withColumn("piece", F.expr("substring(word, s + 1, e - s)")).join(F.broadcast(table), "piece")
    grouped = edges.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("e", "s", "score", "id"))).alias("edges"))
    return words.join(grouped.withColumnRenamed("word", "__word"), F.col("word") == F.col("__word"), "left").select(
        "word", F.expr("coalesce(edges, cast(array() as array<struct<e:int,s:int,score:double,id:int>>))").alias("edges")
    )


def _bpe_cuts() -> str:
    """Cuts of ``word`` after merging: each step drops the cut between the best-scored, then leftmost, pair that an edge joins."""
    best = (
        "array_max(transform(filter(edges, x -> x.e > x.s + 1 and array_position(c, x.s) > 0 and get(c, cast(array_position(c, x.s) as int) + 1) = x.e),"
        " x -> named_struct('score', x.score, 'left', -x.s)))"
    )
    step = f"transform(array({best}), b -> case when b is null then c else array_remove(c, get(c, cast(array_position(c, -b.left) as int))) end)[0]"
    return f"aggregate(sequence(1, greatest(1, length(word) - 1)), sequence(0, length(word)), (c, k) -> {step})"


def _viterbi_cuts(unknown: float) -> str:
    """Cuts of ``word`` on its best path, folded over the edges by where they end; a character without a piece costs ``unknown``."""
    singles = f"transform(filter(sequence(0, length(word) - 1), i -> not exists(edges, x -> x.s = i and x.e = i + 1)), i -> named_struct('e', i + 1, 's', i, 'score', {unknown}D, 'id', -1))"
    start = "transform(sequence(0, length(word)), i -> named_struct('score', if(i = 0, 0.0D, -1.0E300D), 'back', -1))"
    fold = (
        f"aggregate(array_sort(concat(edges, {singles})), {start}, (b, x) -> case when get(b, x.s).score + x.score > get(b, x.e).score"
        " then transform(b, (v, i) -> if(i = x.e, named_struct('score', get(b, x.s).score + x.score, 'back', x.s), v)) else b end)"
    )
    back = "aggregate(sequence(1, length(word)), array(length(word)), (c, k) -> if(c[0] <= 0, c, concat(array(get(b, c[0]).back), c)))"
    return f"transform(array({fold}), b -> {back})[0]"


def segmented(lattices: DataFrame, pieces: Pieces) -> DataFrame:
    """word and ids: array<int>, of lattices (word, edges)."""
    cuts = _bpe_cuts() if pieces.kind == "bpe" else _viterbi_cuts(min(s for _, _, s in pieces.table) - 10)
    if pieces.bytes_at:
        spelled = "transform(sequence(1, octet_length(part)), k -> get(array({}), cast(conv(substring(hex(cast(part as binary)), 2 * k - 1, 2), 16, 10) as int)))".format(",".join(map(str, pieces.bytes_at)))
    else:
        spelled = f"array({pieces.unknown})"
    spelled = spelled.replace("part", "substring(word, get(cuts, j) + 1, get(cuts, j + 1) - get(cuts, j))")
    own = "get(filter(edges, x -> x.s = get(cuts, j) and x.e = get(cuts, j + 1)), 0).id"
    ids = f"flatten(transform(sequence(0, size(cuts) - 2), j -> case when {own} is not null then array({own}) else {spelled} end))"
    return lattices.withColumn("cuts", F.expr(cuts)).select("word", F.expr(ids).alias("ids"))


def words_of(text: Column) -> Column:
    """The words of a text, without the mark each begins with. Where spaces stand alone, they part the words."""
    marked = F.concat(F.lit(SPACE), F.replace(text, F.lit(" "), F.lit(SPACE)))
    odd = F.transform(F.split(marked, f"(?<=[^{SPACE}])(?={SPACE})"), lambda w: F.substring(w, 2, 1 << 30))
    plain = ~(text.startswith(" ") | text.endswith(" ") | F.contains(text, F.lit("  ")) | F.contains(text, F.lit(SPACE)))
    return F.when(text == "", F.expr("cast(array() as array<string>)")).when(plain, F.split(text, " ")).otherwise(odd)


def frequent_words(docs: DataFrame, text: str = "text", most: int = HEAD_WORDS) -> DataFrame:
    """The words of at most HEAD_CHARS whose counts over all rows are so high that at most ``most`` have them."""
    counts = common.staged(
        docs.select(F.explode_outer(words_of(common.text_of(text))).alias("word")).where(F.length("word") < HEAD_CHARS).groupBy("word").agg(F.count("*").alias("n")).where("n > 1"), "word-counts"
    )
    # words by the power of 1.25 that their count reaches: some hundred rows
    level = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.25)))
    sizes = dict(counts.groupBy(level.alias("level")).count().collect())
    total, least = 0, None
    for k in sorted(sizes, reverse=True):
        total += sizes[k]
        if total > most:
            break
        least = k
    return counts.where(F.lit(False) if least is None else level >= least).select(F.concat(F.lit(SPACE), "word").alias("word"))


@dataclass(frozen=True)
class Pairs:
    """What two neighbouring parts merge to, as open-addressed tables: parts are numbered, pieces by their place in the piece table, then characters that aren't pieces."""

    characters: dict[str, int]
    size: int
    probes: int
    slots: np.ndarray
    scores: np.ndarray
    merged: np.ndarray
    ids: np.ndarray

    @staticmethod
    def of(pieces: Pieces) -> Pairs:
        import numpy as np

        number = {p: k for k, (p, _, _) in enumerate(pieces.table)}
        for p, _, _ in pieces.table:
            for c in p:
                number.setdefault(c, len(number))
        n, found = len(number), []
        for p, _, score in pieces.table:
            for cut in range(1, len(p)):
                a, b = number.get(p[:cut]), number.get(p[cut:])
                if a is not None and b is not None:
                    found.append((a * n + b, score, number[p]))
        bits = max(4, (4 * len(found)).bit_length())
        slots, scores, merged = np.full(1 << bits, -1), np.full(1 << bits, -np.inf), np.zeros(1 << bits, np.int32)
        probes = 1
        for key, score, whole in found:
            at = Pairs.place(key, bits)
            steps = 1
            while slots[at] >= 0:
                at, steps = (at + 1) % (1 << bits), steps + 1
            slots[at], scores[at], merged[at], probes = key, score, whole, max(probes, steps)
        ids = np.full(n, -1, np.int32)
        ids[: len(pieces.table)] = [i for _, i, _ in pieces.table]
        return Pairs({c: k for c, k in number.items() if len(c) == 1}, n, probes, slots, scores, merged, ids)

    @staticmethod
    def place(key, bits: int):
        """Where the search for a key begins."""
        return (key * 0x9E3779B97F4A7C1 & 0x7FFFFFFFFFFFFFF) >> 59 - bits

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The score of each pair, which is -inf where it doesn't merge, and what it merges to."""
        import numpy as np

        bits = len(self.slots).bit_length() - 1
        key = np.where((left >= 0) & (right >= 0), left.astype(np.int64) * self.size + right, -2)
        with np.errstate(over="ignore"):
            at = Pairs.place(key, bits)
        score, whole = np.full(len(key), -np.inf), np.zeros(len(key), np.int32)
        open_ = np.arange(len(key))
        for _ in range(self.probes):
            slot = self.slots[at[open_]]
            hit = slot == key[open_]
            score[open_[hit]], whole[open_[hit]] = self.scores[at[open_[hit]]], self.merged[at[open_[hit]]]
            open_ = open_[~hit & (slot >= 0)]
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & (len(self.slots) - 1)
        return score, whole

    def segmented(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of words of about equal length: the piece ids of their parts, with -1 where a part is no piece, and the parts' lengths, 0 behind the last."""
        import numpy as np

        long = max(map(len, words))
        sizes = np.array([len(w) for w in words])
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        seen, where = np.unique(codes, return_inverse=True)
        known = np.array([self.characters.get(chr(c), -1) for c in seen], np.int32)
        parts = np.full((len(words), long), -2, np.int32)
        inside = np.arange(long) < sizes[:, None]
        parts[inside] = known[where]
        lengths = inside.astype(np.int32)
        score, whole = (x.reshape(len(words), long - 1) for x in self.find(parts[:, :-1].ravel(), parts[:, 1:].ravel()))
        done_parts, done_lengths, rows = parts.copy(), lengths.copy(), np.arange(len(words))
        while len(rows) and long > 1:
            at = score.argmax(axis=1)
            each = np.arange(len(rows))
            going = score[each, at] > -np.inf
            if not going.all():
                done_parts[rows[~going]], done_lengths[rows[~going]] = parts[~going], lengths[~going]
                rows, at, parts, lengths, score, whole = rows[going], at[going], parts[going], lengths[going], score[going], whole[going]
                each = np.arange(len(rows))
            made = whole[each, at]
            both = lengths[each, at] + lengths[each, at + 1]
            # what stands behind the pair moves up by one
            step = np.arange(long) + (np.arange(long) > at[:, None])
            inner = np.minimum(step, long - 1)
            parts, lengths = np.take_along_axis(parts, inner, 1), np.take_along_axis(lengths, inner, 1)
            parts[:, -1], lengths[:, -1] = -2, 0
            parts[each, at], lengths[each, at] = made, both
            inner = np.minimum(step[:, :-1], long - 2)
            score, whole = np.take_along_axis(score, inner, 1), np.take_along_axis(whole, inner, 1)
            score[:, -1] = -np.inf
            after = np.where(at + 1 < long, parts[each, np.minimum(at + 1, long - 1)], -2)
            edge = np.minimum(at, long - 2)
            s, w = self.find(made, after)
            score[each, edge], whole[each, edge] = np.where(at < long - 1, s, score[each, edge]), np.where(at < long - 1, w, whole[each, edge])
            first = at > 0
            s, w = self.find(parts[each[first], at[first] - 1], made[first])
            score[each[first], at[first] - 1], whole[each[first], at[first] - 1] = s, w
        return np.where(done_parts >= 0, self.ids[done_parts], -1), done_lengths


class Encoder:
    """Encodes words in a worker by the merges or Viterbi steps of the fold that Spark runs over frequent words, without its lattice.

    With ``pairs``, words that aren't frequent are merged many at a time."""

    def __init__(self, pieces: Pieces, head: dict[str, bytes], misspelt: frozenset[str] = frozenset(), pairs: Pairs | None = None):
        """``head``: the ids of frequent words, without the mark they begin with; ``misspelt``: those of them that don't decode to themselves."""
        self.head, self.memo, self.pieces = head, {}, pieces
        self.misspelt, self.raw, self.pairs = set(misspelt), spelling(pieces), pairs
        self.ids = {p: i for p, i, _ in pieces.table}
        self.scores = {p: s for p, _, s in pieces.table}
        self.unknown_score = min(self.scores.values()) - 10

    def encode(self, text: str | None) -> tuple[bytes, bool]:
        """The ids, four bytes each; and whether each word's ids decode to it, and so all of them to the text."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[tuple[bytes, bool]]:
        found = []
        missing: dict[str, None] = {}
        for text in texts:
            words = text.split(" ") if text else []
            if text and (SPACE in text or "" in words):  # spaces in a row, or the mark itself: words by the rule, without the mark they begin with
                words = [w[1:] for w in UNIT.findall(SPACE + text.replace(" ", SPACE))]
            ids = list(map(self.head.get, words))
            if None in ids:
                missing.update((w, None) for w, x in zip(words, ids, strict=True) if x is None and w not in self.memo)
            found.append((text, words, ids))
        fresh = self.learnt(list(missing))
        out = []
        for text, words, ids in found:
            if None in ids:
                for k, x in enumerate(ids):
                    if x is None:
                        got = self.memo.get(words[k])
                        ids[k] = fresh[words[k]] if got is None else got
            out.append((b"".join(ids), not text or SPACE not in text and (not self.misspelt or self.misspelt.isdisjoint(words))))
        if len(self.memo) + len(fresh) > MEMO_WORDS:
            self.memo.clear()
        if len(fresh) <= MEMO_WORDS:
            self.memo |= {w: ids for w, ids in fresh.items() if len(w) < HEAD_CHARS}
        return out

    def learnt(self, words: list[str]) -> dict[str, bytes]:
        """The ids of words that have none yet, without the mark they begin with."""
        import numpy as np

        out = {}
        by: dict[int, list[str]] = {}
        for w in words:
            if self.pairs is None or self.pieces.kind != "bpe" or len(w) >= 64:
                out[w] = self.new(w)
            else:
                by.setdefault(len(w) // 4, []).append(w)
        for some in by.values():
            for k in range(0, len(some), 12000):
                part = some[k : k + 12000]
                ids, lengths = self.pairs.segmented([SPACE + w for w in part])
                inside = lengths > 0
                plain = ((ids >= 0) | ~inside).all(axis=1)
                raw = ids[inside].astype("<i4").tobytes()
                ends = 4 * np.cumsum(inside.sum(axis=1))
                for w, lo, hi in zip(part, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                    out[w] = raw[lo:hi]
                for k in np.nonzero(~plain)[0].tolist():
                    out[part[k]] = self.spelled(SPACE + part[k], ids[k].tolist(), lengths[k].tolist())
        return out

    def spelled(self, word: str, ids: list[int], lengths: list[int]) -> bytes:
        """The ids of a word whose parts are known, those that are no pieces by their bytes."""
        import struct

        if not self.pieces.bytes_at:
            return self.new(word[1:])
        out, at = [], 0
        for i, n in zip(ids, lengths, strict=True):
            if i >= 0:
                out.append(i)
            else:
                out += [self.pieces.bytes_at[b] for b in word[at : at + n].encode("utf-8", "replace")]
            at += n
        return struct.pack(f"<{len(out)}i", *out)

    def new(self, rest: str) -> bytes:
        """A word with parts that may be no pieces."""
        got = self.word(SPACE + rest)
        if not self.spells(SPACE + rest, got):
            self.misspelt.add(rest)
        return got

    def spells(self, word: str, ids: bytes) -> bool:
        import struct

        return b"".join([self.raw.get(i, b"") for i in struct.unpack(f"<{len(ids) // 4}i", ids)]) == word.replace(SPACE, " ").encode()

    def word(self, word: str) -> bytes:
        import struct

        parts = self.viterbi(word) if self.pieces.kind != "bpe" else self.merged(word) if len(word) <= 64 else self.merged_long(word)
        ids = []
        for p in parts:
            own = self.ids.get(p)
            if own is not None:
                ids.append(own)
            elif self.pieces.bytes_at:
                ids += [self.pieces.bytes_at[b] for b in p.encode("utf-8", "replace")]
            else:
                ids.append(self.pieces.unknown)
        return struct.pack(f"<{len(ids)}i", *ids)

    def merged(self, word: str) -> list[str]:
        parts, score = list(word), self.scores.get
        edges = [score(a + b) for a, b in zip(parts, parts[1:], strict=False)]
        while True:
            best = at = None
            for k, s in enumerate(edges):
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del edges[at]
            if at:
                edges[at - 1] = score(parts[at - 1] + parts[at])
            if at < len(edges):
                edges[at] = score(parts[at] + parts[at + 1])

    def merged_long(self, word: str) -> list[str]:
        """The same with a heap of edges, for words of any length."""
        import heapq

        parts: list[str | None] = list(word)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = []

        def push(a: int) -> None:
            b = after[a]
            if b < len(parts) and (s := self.scores.get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (-s, a, parts[a], parts[b]))

        for k in range(len(parts)):
            push(k)
        while heap:
            _, a, x, y = heapq.heappop(heap)
            b = after[a]
            if parts[a] != x or b >= len(parts) or parts[b] != y:
                continue
            parts[a], parts[b] = x + y, None
            after[a] = after[b]
            if after[b] < len(parts):
                before[after[b]] = a
            push(a)
            if before[a] >= 0:
                push(before[a])
        return [p for p in parts if p is not None]

    def viterbi(self, word: str) -> list[str]:
        n, longest = len(word), self.pieces.longest
        best, back = [0.0] + [float("-inf")] * n, [0] * (n + 1)
        for e in range(1, n + 1):
            for s in range(max(0, e - longest), e):
                score = self.scores.get(word[s:e], self.unknown_score if e == s + 1 else None)
                if score is not None and best[s] + score > best[e]:
                    best[e], back[e] = best[s] + score, s
        out, at = [], n
        while at:
            out.append(word[back[at] : at])
            at = back[at]
        return out[::-1]


def spelling(pieces: Pieces) -> dict[int, bytes]:
    return {i: p.replace(SPACE, " ").encode() for p, i, _ in pieces.table} | {i: bytes([b]) for b, i in enumerate(pieces.bytes_at)}


def decoder(pieces: Pieces):
    """A function from ids to their text."""
    raw = spelling(pieces)

    def decode(ids) -> str:
        return b"".join([raw.get(i, b"") for i in ids]).decode("utf-8", "replace").removeprefix(" ")

    return decode


def slices(batch, at: int):
    """An Arrow batch in parts of about ``SLICE_BYTES`` of the texts in its column ``at``, or of one text that is longer."""
    import pyarrow.compute as pc

    lo = size = 0
    for k, n in enumerate(pc.binary_length(batch.column(at)).to_pylist()):
        if k > lo and size + (n or 0) > SLICE_BYTES:
            yield batch.slice(lo, k - lo)
            lo, size = k, 0
        size += n or 0
    if lo < batch.num_rows:
        yield batch.slice(lo)


def head_table(docs: DataFrame, pieces: Pieces, text: str = "text") -> tuple[dict[str, bytes], frozenset[str]]:
    """The ids of the frequent words, from their lattices; and those words whose ids don't decode to them."""
    import struct

    done = segmented(lattice(frequent_words(docs, text), pieces), pieces)
    got = done.toArrow()
    head = {w[1:]: struct.pack(f"<{len(i)}i", *i) for w, i in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True)}
    encoder = Encoder(pieces, head)
    return head, frozenset(w for w, ids in head.items() if not encoder.spells(SPACE + w, ids))


def encoded(docs: DataFrame, pieces: Pieces | None = None, text: str = "text", keep_text: bool = True, digest: str = "") -> DataFrame:
    """``docs`` (without ``text`` if that isn't kept) with ``piece_ids`` array<int> and ``decodes``: whether decoding them gives the text again.
    And ``digest``, if it is named: the lowercase hex SHA-256 of the ids, four bytes each, the lowest first."""
    from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

    spark: SparkSession = docs.sparkSession
    pieces = pieces or Pieces.read()
    common.small_batches(spark)
    held = spark.sparkContext.broadcast((pieces, *head_table(docs, pieces, text), Pairs.of(pieces) if pieces.kind == "bpe" else None))
    added = ("piece_ids", "decodes", *([digest] if digest else []))
    kept = [c for c in docs.columns if c not in added]
    at = kept.index(text)
    back = [k for k, c in enumerate(kept) if keep_text or c != text]
    names = [*(kept[k] for k in back), *added]

    def encode(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        encoder = Encoder(*held.value)
        for batch in (part for whole in batches for part in slices(whole, at)):
            done = encoder.encode_all(batch.column(at).to_pylist())
            ids, same = [raw for raw, _ in done], [whole for _, whole in done]
            ends = np.cumsum([0, *(len(raw) // 4 for raw in ids)])
            values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
            digests = [pa.array([hashlib.sha256(raw).hexdigest() for raw in ids], pa.string())] if digest else []
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in back), lists, pa.array(same, pa.bool_()), *digests], names=names)

    schema = StructType([*docs.select(*(kept[k] for k in back)).schema.fields, StructField("piece_ids", ArrayType(IntegerType())), StructField("decodes", BooleanType()), *([StructField(digest, StringType())] if digest else [])])
    return docs.select(*kept).mapInArrow(encode, schema)


def decoded(docs: DataFrame, pieces: Pieces | None = None) -> DataFrame:
    """``docs`` (with ``piece_ids``) with ``decoded``: their text."""
    pieces = pieces or Pieces.read()
    decode = decoder(pieces)

    @F.pandas_udf("string")
    def run(ids):
        return ids.map(lambda x: None if x is None else decode(x.tolist()))

    return docs.withColumn("decoded", run("piece_ids"))


def encoding_report(docs: DataFrame, pieces: Pieces | None = None) -> DataFrame:
    """doc_id, n_pieces, ids_sha256 (see :func:`encoded`), decodes, piece_ids of each document."""
    done = encoded(docs.select("doc_id", "text"), pieces, keep_text=False, digest="ids_sha256")
    return done.select("doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), "ids_sha256", "decodes", "piece_ids")
