"""SentencePiece (merge type) encoding with seeded merge-dropout, and its lossless decoding.

An agenda holds the adjacent pairs whose concatenation is a piece; the best-scored, leftmost
first, is merged. A candidate is skipped for good when a keyed hash of the document's id, the
chunk's place in it and the candidate's place in the chunk says so. So each occurrence of a word
is cut by itself, without any random state: reruns and lost executors change nothing.
White space becomes part of the pieces, and characters without a piece fall back to bytes, so
every text comes back exactly.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chelate.llm.blocks import trim
from chelate.llm.common import id_text, small_batches, table, unused

DROPOUT, SEED = 0.1, 17
#: Words and nodes that a worker keeps at most between two calls, and symbols of a chunk above which the agenda runs for it alone.
KEPT, LONG = 120_000, 48
#: Bytes of text and chunks that are segmented side by side.
TEXT_BYTES, CHUNKS = 1 << 20, 100_000
#: No piece crosses the border of two chunks: spaces start one, a line's end is one.
CHUNK = re.compile(" +[^ \n]*|[^ \n]+|\n")
SLOTS = 1 << 19
FAR = np.int64(1) << np.int64(60)
A, B, C, D, E, G = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, (1 << 64) - 1)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with their scores; kind: normal, byte or other (never in a text)."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: str

    @staticmethod
    def load(path: str) -> Vocabulary:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = range(m.vocab_size())
        kinds = "".join("b" if m.is_byte(i) else "o" if m.is_control(i) or m.is_unknown(i) or m.is_unused(i) else "n" for i in n)
        v = Vocabulary(tuple(m.id_to_piece(i) for i in n), tuple(m.get_score(i) for i in n), kinds)
        if len(n) > 1 << 16 or kinds.count("b") != 256 or any("\n" in p or "▁" in p.lstrip("▁") for p, k in zip(v.pieces, kinds, strict=True) if k == "n"):
            raise ValueError("needs a byte-fallback model of at most 65,536 pieces, none of which crosses words")
        return v

    @cached_property
    def normal(self) -> dict[str, int]:
        return {p.replace("▁", " "): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == "n"}

    @cached_property
    def byte(self) -> list[int]:
        return [i for i, k in enumerate(self.kinds) if k == "b"]

    @cached_property
    def pairs(self) -> dict[int, int]:
        """left << 16 | right -> the piece that both make."""
        return {self.normal[p[:j]] << 16 | self.normal[p[j:]]: i for p, i in self.normal.items() for j in range(1, len(p)) if p[:j] in self.normal and p[j:] in self.normal}

    @cached_property
    def slots(self) -> tuple[np.ndarray, np.ndarray]:
        """pairs as a hash table, probed from slot() on; -1 is free."""
        keys, made = np.full(SLOTS + len(self.pairs), -1, np.int64), np.zeros(SLOTS + len(self.pairs), np.int32)
        for (k, m), at in zip(self.pairs.items(), slot(np.fromiter(self.pairs, np.int64, len(self.pairs))).tolist(), strict=True):
            while keys[at] >= 0:
                at += 1
            keys[at], made[at] = k, m
        return keys, made

    def made(self, pair: np.ndarray) -> np.ndarray:
        """The piece that each pair makes, or -1."""
        keys, made = self.slots
        at = slot(pair)
        out = np.where(keys[at] == pair, made[at], -1)
        open_ = np.flatnonzero((out < 0) & (keys[at] >= 0))
        while len(open_):
            at[open_] += 1
            k = keys[at[open_]]
            hit = k == pair[open_]
            out[open_[hit]] = made[at[open_[hit]]]
            open_ = open_[~hit & (k >= 0)]
        return out

    @cached_property
    def ranks(self) -> np.ndarray:
        """0 is merged first; equal scores share a rank."""
        return np.unique(-np.array(self.scores), return_inverse=True)[1].astype(np.int64)

    @cached_property
    def by_code(self) -> np.ndarray:
        """Code point -> the piece of this one character, or -1."""
        ids = np.full(0x110000, -1, np.int32)
        for p, i in self.normal.items():
            if len(p) == 1:
                ids[ord(p)] = i
        return ids

    @cached_property
    def bytes(self) -> list[bytes]:
        value = {i: bytes([b]) for b, i in enumerate(self.byte)} | {i: p.encode() for p, i in self.normal.items()}
        return [value.get(i, b"") for i in range(len(self.pieces))]


def skipped(key, start, mid, end, limit):
    """Whether the candidate (start, mid, end) of the chunk with this key is skipped; of numbers or arrays."""
    x = (key + start * A + mid * B + end * C) & G
    x = ((x ^ (x >> 30)) * D) & G
    x = ((x ^ (x >> 27)) * E) & G
    return (x ^ (x >> 31)) >> 11 < limit


def slot(pair: np.ndarray) -> np.ndarray:
    return ((pair.astype(np.uint64) * np.uint64(A)) >> np.uint64(45)).astype(np.int64)


def code(start, mid, end):
    """A candidate of a chunk of LONG symbols at most, as one number."""
    return start << 12 | mid << 6 | end


def mixed(x: np.ndarray) -> np.ndarray:
    u = np.uint64
    x = (x ^ (x >> u(30))) * u(D)
    x = (x ^ (x >> u(27))) * u(E)
    return x ^ (x >> u(31))


def chunk_keys(docs: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The key of the chunk at each place of the document with each key."""
    return mixed(docs + places.astype(np.uint64) * np.uint64(A))


def threshold(dropout: float) -> int:
    return int(dropout * (1 << 53))


def agenda(v: Vocabulary, chunk: str, key: int, limit: int) -> list[int]:
    """The piece ids of one chunk, by a heap; -1 for a character without a piece."""
    ranks = v.ranks
    sym = [v.normal.get(c, -1) for c in chunk]
    n = len(sym)
    after, before, end, alive = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
    heap: list[tuple[int, int, int, int, int]] = []

    def push(i: int) -> None:
        j = after[i] if i >= 0 else n
        if i >= 0 and j < n and sym[i] >= 0 and sym[j] >= 0 and (m := v.pairs.get(sym[i] << 16 | sym[j])) is not None:
            heapq.heappush(heap, (int(ranks[m]), i, j, end[j], m))

    for i in range(n - 1):
        push(i)
    while heap:
        _, i, j, stop, m = heapq.heappop(heap)
        if not (alive[i] and j < n and alive[j] and after[i] == j and end[j] == stop) or skipped(key, i, j, stop, limit):
            continue
        sym[i], end[i], after[i], alive[j] = m, stop, after[j], False
        if after[i] < n:
            before[after[i]] = i
        push(before[i])
        push(i)
    return [s for s, on in zip(sym, alive, strict=True) if on]


def merge_all(v: Vocabulary, chunks: list[str], keys: np.ndarray, limit: int, banned: np.ndarray | None = None, moves: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """agenda() of many short chunks side by side: in each round, each chunk's best candidate is merged.

    Returns all ids in a row and how many each chunk has. banned: sorted chunk << 18 | code() of
    candidates that are skipped too; moves gets (chunks, code() of what each merged) by round.
    Both need chunks of LONG symbols at most.
    """
    lens = np.fromiter(map(len, chunks), np.int64, len(chunks))
    sym = v.by_code[np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
    which = np.repeat(np.arange(len(chunks)), lens)
    start = np.arange(len(sym)) - np.repeat(np.cumsum(lens) - lens, lens)
    stop = start + 1
    ended: list[tuple[np.ndarray, np.ndarray]] = []

    def candidates(i: np.ndarray) -> None:
        """Refresh the candidates that start at symbols i."""
        best[i] = FAR
        i = i[i + 1 < len(sym)]
        i = i[(which[i] == which[i + 1]) & (sym[i] >= 0) & (sym[i + 1] >= 0)]
        m = v.made(sym[i] << 16 | sym[i + 1])
        i, m = i[m >= 0], m[m >= 0]
        ok = np.ones(len(i), bool)
        u = np.uint64
        if limit:
            x = keys[which[i]] + start[i].astype(u) * u(A) + start[i + 1].astype(u) * u(B) + stop[i + 1].astype(u) * u(C)
            ok = mixed(x) >> u(11) >= u(limit)
        if banned is not None and len(banned):
            at = which[i] << 18 | code(start[i], start[i + 1], stop[i + 1])
            ok &= banned[np.minimum(np.searchsorted(banned, at), len(banned) - 1)] != at
        i, m = i[ok], m[ok]
        to[i] = m
        best[i] = (v.ranks[m] << 20) + start[i]

    to, best = np.zeros(len(sym), np.int64), np.full(len(sym), FAR)
    if len(sym):
        candidates(np.arange(len(sym)))
    while len(sym):
        first = np.flatnonzero(np.diff(which, prepend=-1))
        least = np.minimum.reduceat(best, first)
        size = np.diff(first, append=len(sym))
        if (done := least == FAR).any():
            gone = np.repeat(done, size)
            ended.append((which[gone], sym[gone]))
            keep = ~gone
            sym, which, start, stop, to, best = (a[keep] for a in (sym, which, start, stop, to, best))
            least, size = least[~done], size[~done]
            if not len(sym):
                break
        hit = np.flatnonzero(best == np.repeat(least, size))
        if moves is not None:
            moves.append((which[hit], code(start[hit], start[hit + 1], stop[hit + 1])))
        sym[hit], stop[hit] = to[hit], stop[hit + 1]
        keep = np.ones(len(sym), bool)
        keep[hit + 1] = False
        hit -= np.arange(len(hit))
        sym, which, start, stop, to, best = (a[keep] for a in (sym, which, start, stop, to, best))
        left = hit[(hit > 0) & (which[hit - 1] == which[hit])] - 1
        candidates(np.concatenate([hit, left]))
    owner = np.concatenate([w for w, _ in ended]) if ended else which
    ids = np.concatenate([i for _, i in ended])[owner.argsort(kind="stable")] if ended else sym
    return ids, np.bincount(owner, minlength=len(chunks))


def doc_key(name: str, copy: int, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(f"{copy}:{name}".encode(), seed)


class Encoder:
    """Segments chunks, each occurrence by its own key; one for each worker and setting.

    What happens to a chunk is a tree: a node is the chunk with the candidates skipped so far, its
    moves are the merges that follow if no more are skipped, and skipping a move leads to a child.
    Nodes hold no key, so occurrences share them, and every occurrence's own hashes choose its way.
    A node that only one occurrence has asked for isn't kept; that occurrence runs by itself.
    """

    kept: dict[tuple, Encoder] = {}

    def __init__(self, v: Vocabulary, dropout: float, seed: int, most: int = KEPT) -> None:
        self.v, self.limit, self.seed, self.most = v, threshold(dropout), seed, most
        self.clear()

    def clear(self) -> None:
        #: Each word's number, words by number, and by number the root (-1: never asked for, -2: once).
        self.number: dict[str, int] = defaultdict(count().__next__)
        self.words: list[str] = []
        self.root = np.zeros(0, np.int64)
        self.word = np.zeros(0, np.int64)
        #: By node: its word, above; its moves (from, how many, how many came before), ids (from, how many), the move whose skip leads to it.
        self.first, self.size, self.base, self.at, self.n_ids, self.above = (np.zeros(0, np.int64) for _ in range(6))
        #: By move: its code, its part of the hash, the node it belongs to, the child (-1: never asked for, -2: once).
        self.code, self.part, self.owner, self.child = np.zeros(0, np.int32), np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.pool = np.zeros(0, np.uint16)

    @classmethod
    def of(cls, v: Vocabulary, dropout: float, seed: int) -> Encoder:
        at = (hash(v.pieces), dropout, seed)
        if at not in cls.kept:
            cls.kept.clear()
            cls.kept[at] = cls(v, dropout, seed)
        return cls.kept[at]

    def learn(self, words: np.ndarray, above: np.ndarray) -> np.ndarray:
        """New nodes of these words: below the moves ``above``, or roots at -1."""
        out = np.arange(len(self.word), len(self.word) + len(words))
        for a in range(0, len(words), 20_000):
            some, up = [self.words[i] for i in words[a : a + 20_000].tolist()], above[a : a + 20_000]
            bans, who, slot, base = [], np.flatnonzero(up >= 0), up[up >= 0], np.zeros(len(some), np.int64)
            if len(slot):
                node = self.owner[slot]
                base[who] = self.base[node] + slot - self.first[node]
            while len(slot):
                bans.append(who << 18 | self.code[slot])
                slot = self.above[self.owner[slot]]
                who, slot = who[slot >= 0], slot[slot >= 0]
            moves: list[tuple[np.ndarray, np.ndarray]] = []
            ids, n = merge_all(self.v, some, np.zeros(0, np.uint64), 0, np.sort(np.concatenate(bans)) if bans else None, moves)
            ids, n = self.with_bytes(some, ids, n)
            which = np.concatenate([w for w, _ in moves]) if moves else np.zeros(0, np.int64)
            codes = np.concatenate([c for _, c in moves]) if moves else np.zeros(0, np.int64)
            order = which.argsort(kind="stable")
            which, codes, total = which[order], codes[order], np.bincount(which, minlength=len(some))
            later = np.arange(len(which)) - np.repeat(np.cumsum(total) - total, total) >= base[which]
            which, codes, size = which[later], codes[later], total - base
            self.first = np.concatenate([self.first, len(self.code) + np.cumsum(size) - size])
            self.size, self.base, self.above = np.concatenate([self.size, size]), np.concatenate([self.base, base]), np.concatenate([self.above, up])
            self.at, self.n_ids = np.concatenate([self.at, len(self.pool) + np.cumsum(n) - n]), np.concatenate([self.n_ids, n])
            u = codes.astype(np.uint64)
            part = (u >> np.uint64(12)) * np.uint64(A) + (u >> np.uint64(6) & np.uint64(63)) * np.uint64(B) + (u & np.uint64(63)) * np.uint64(C)
            self.code, self.part = np.concatenate([self.code, codes.astype(np.int32)]), np.concatenate([self.part, part])
            self.owner = np.concatenate([self.owner, (which + len(self.word)).astype(np.int32)])
            self.child = np.concatenate([self.child, np.full(len(codes), -1, np.int32)])
            self.pool = np.concatenate([self.pool, ids])
            self.word = np.concatenate([self.word, words[a : a + 20_000]])
        return out

    def with_bytes(self, chunks: list[str], ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """uint16 ids, with the bytes of characters without a piece, and how many each chunk has."""
        if (ids >= 0).all():
            return ids.astype(np.uint16), n
        parts, n = np.split(ids, np.cumsum(n)[:-1]), n.copy()
        for i in np.unique(np.repeat(np.arange(len(chunks)), n)[ids < 0]).tolist():
            parts[i] = np.array(self.ids(chunks[i], parts[i].tolist()), np.int64)
            n[i] = len(parts[i])
        return np.concatenate(parts).astype(np.uint16), n

    def ids(self, chunk: str, merged: list[int]) -> list[int]:
        """Ids with the bytes of characters without a piece."""
        out, at = [], 0
        for i in merged:
            if i >= 0:
                out.append(i)
                at += len(self.v.bytes[i].decode())
            else:
                out += [self.v.byte[b] for b in chunk[at].encode("utf-8", "surrogateescape")]
                at += 1
        return out

    def segment(self, chunks: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks in a row, and how many each has."""
        if max(len(self.words), len(self.word)) > self.most:
            self.clear()
        word = np.fromiter(map(self.number.__getitem__, chunks), np.int64, len(chunks))
        self.words += islice(self.number, len(self.words), None)
        self.root = np.concatenate([self.root, np.full(len(self.words) - len(self.root), -1)])
        asked, n = np.unique(word[self.root[word] < 0], return_counts=True)
        long = np.fromiter((len(self.words[i]) > LONG for i in asked.tolist()), bool, len(asked))
        often = asked[~long & ((n > 1) | (self.root[asked] == -2))]
        self.root[asked] = -2
        self.root[often] = self.learn(often, np.full(len(often), -1))
        node = self.root[word]

        alone, live = [np.flatnonzero(node < 0)], np.flatnonzero(node >= 0)
        while self.limit and len(live):
            at, size = node[live], self.size[node[live]]
            who = np.repeat(np.arange(len(live)), size)
            move = np.arange(len(who)) + np.repeat(self.first[at] - np.cumsum(size) + size, size)
            hit = np.flatnonzero(mixed(keys[live][who] + self.part[move]) >> np.uint64(11) < np.uint64(self.limit))
            hit = hit[np.diff(who[hit], prepend=-1) > 0]
            live, move = live[who[hit]], move[hit]
            asked, inverse, n = np.unique(move, return_inverse=True, return_counts=True)
            learn = asked[(self.child[asked] < 0) & ((n > 1) | (self.child[asked] == -2))]
            self.child[asked[(self.child[asked] == -1) & (n == 1)]] = -2
            self.child[learn] = self.learn(self.word[self.owner[learn]], learn)
            node[live] = self.child[move]
            alone.append(live[node[live] < 0])
            live = live[node[live] >= 0]

        single = np.concatenate(alone)
        short = single[np.fromiter((len(chunks[i]) <= LONG for i in single.tolist()), bool, len(single))]
        pools, start, length = [self.pool], np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
        known = node >= 0
        start[known], length[known] = self.at[node[known]], self.n_ids[node[known]]
        end = len(self.pool)
        for a in range(0, len(short), 20_000):
            some = short[a : a + 20_000]
            words = [chunks[i] for i in some.tolist()]
            ids, n = self.with_bytes(words, *merge_all(self.v, words, keys[some], self.limit))
            start[some], length[some] = end + np.cumsum(n) - n, n
            pools.append(ids)
            end += len(ids)
        for i in np.setdiff1d(single, short).tolist():
            ids = np.array(self.ids(chunks[i], agenda(self.v, chunks[i], int(keys[i]), self.limit)), np.uint16)
            start[i], length[i] = end, len(ids)
            pools.append(ids)
            end += len(ids)
        return np.concatenate(pools)[np.arange(length.sum()) + np.repeat(start - np.cumsum(length) + length, length)], length

    def encode(self, texts: list[bytes | None], names: list[str], copies: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has."""
        found = [CHUNK.findall(" " + t.decode("utf-8", "surrogateescape")) if t else [] for t in texts]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        docs = np.array([doc_key(n, c, self.seed) for n, c in zip(names, copies, strict=True)], np.uint64)
        keys = chunk_keys(np.repeat(docs, sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes))
        chunks = list(chain.from_iterable(found))
        parts = [self.segment(chunks[a : a + CHUNKS], keys[a : a + CHUNKS]) for a in range(0, len(chunks), CHUNKS)]
        ids = np.concatenate([np.zeros(0, np.uint16), *(i for i, _ in parts)])
        counts = np.concatenate([np.zeros(0, np.int64), *(n for _, n in parts)])
        ends = np.concatenate([[0], np.cumsum(counts)])
        return ids, np.diff(ends[np.concatenate([[0], np.cumsum(sizes)])])


def spans(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """(from, rows) of rows in a row; a span ends with the row that reaches the limit."""
    a, total = 0, 0
    for i, n in enumerate(sizes):
        total += n
        if total >= limit or i == len(sizes) - 1:
            yield a, i + 1 - a
            a, total = i + 1, 0


def numbered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", copy_col: str = "copy") -> DataFrame:
    """id, text and ``copy_col``, which numbers the rows that share both from 1. They are equal, so any order is the same."""
    rows = docs.select(id_col, text_col, F.xxhash64(F.col(text_col).cast("binary")).alias("_hash"))
    same = Window.partitionBy(id_col, "_hash").orderBy(text_col)
    return rows.withColumn(copy_col, F.row_number().over(same)).drop("_hash")


def encode(docs: DataFrame, model: str | None = None, dropout: float = DROPOUT, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", check: bool = False, copy_col: str | None = None) -> DataFrame:
    """id, n_tokens and ids (array<int>) of every row; with ``check`` also lossless, whether they decode to the text.

    Each occurrence of a word is segmented by a key of its text's id, its place there and, where
    ``copy_col`` names a column, that copy number; null or no column counts as 0. dropout 0 is the
    plain encoding. A null or empty text has no ids; an empty table gives an empty result; a null
    id counts as the empty name; rows repeated with id and copy number are encoded alike. Bytes
    that aren't UTF-8 become byte pieces. Other columns aren't read. model: the file's path, read
    by the driver alone.
    """
    v = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model or default_model()))  # the vocabulary's size, under 2 MB
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(v.value, dropout, seed)
        pieces = pa.array(v.value.bytes, pa.binary())
        for whole in batches:
            for a, n in spans(pc.binary_length(whole.column("text")).fill_null(0).to_pylist(), TEXT_BYTES):
                b = whole.slice(a, n)
                flat, counts = encoder.encode(*(b.column(c).to_pylist() for c in ("text", "name", "copy")))
                ends = np.cumsum([0, *counts]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32)))
                out = {id_col: b.column(id_col), "n_tokens": pa.array(np.diff(ends), pa.int32()), "ids": ids}
                if check:
                    out["lossless"] = pa.array([x == (t or b"") for x, t in zip(joined(pieces, ids), b.column("text").to_pylist(), strict=True)], pa.bool_())
                yield pa.RecordBatch.from_pydict(out)
        trim()

    copy = F.coalesce(F.col(copy_col).cast("long"), F.lit(0)) if copy_col else F.lit(0)
    rows = small_batches(docs).select(F.col(id_col), F.col(text_col).cast("binary").alias("text"), id_text(F.col(id_col)).alias("name"), copy.alias("copy"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_tokens int, ids array<int>" + (", lossless boolean" if check else ""))


def joined(pieces: pa.Array, ids: pa.ListArray) -> Iterator[bytes | None]:
    """The text of each list of ids, without the space that encoding puts first."""
    parts = pa.ListArray.from_arrays(ids.offsets, pieces.take(ids.values), mask=ids.is_null() if ids.null_count else None)
    return (None if x is None else x[1:] for x in pc.binary_join(parts, b"").to_pylist())


def decode(encoded: DataFrame, model: str | None = None, ids_col: str = "ids") -> DataFrame:
    """Add ``decoded`` (binary, UTF-8 where the text was): the text that ids stand for.

    Null ids give null, none the empty text. Where a column of this name exists, the new one's name
    ends in an underscore, or more. Rows repeated stay so; an empty table gives an empty result;
    long texts are put together a batch of rows at a time.
    """
    name = unused(encoded, "decoded")[0]
    v = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(model or default_model()).bytes)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pa.array(v.value, pa.binary())
        for b in batches:
            text = pa.array(joined(pieces, b.column(ids_col)), pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, text], [*b.schema.names, name])

    return small_batches(encoded).mapInArrow(run, f"{fields}, `{name}` binary")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents; lossless: whether they decode to the whole text."""
    return encode(table(spark, sf_dir, "documents"), check=True)


QUERIES = {"op2_sentencepiece": op2_sentencepiece}
ORACLES: dict[str, str] = {}  # SQL has no agenda; the tests use a plain agenda, the library's own encoding and round trips
