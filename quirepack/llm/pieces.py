"""SentencePiece (BPE) encoding and decoding by vectorised merge rounds.

Texts are cut into segments that no piece can span. The symbols of all new
segments lie in one flat array; each round looks up the rank of every adjacent
pair, takes the least rank of each segment, merges all its leftmost
non-overlapping occurrences at once, and compacts the array, until no segment has
a pair left. Pairs whose rank several pieces share are merged one at a time. If a
merge made a pair of a better rank than the round before (the order of single
merges could then matter), that segment is encoded again by single merges.

A null text is empty and has no ids. Characters outside the vocabulary become
byte pieces. Repeated rows and any extra columns are kept as they are.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField

from .arrowmap import with_columns
from .segments import SegmentIds
from .textscan import buffers

MARK = "▁"
BLOCK_BYTES = 1 << 20
_NONE = np.int64(1 << 40)
_SHIFT = 21


class PieceModel:
    """Tables of a BPE model with byte fallback, a leading mark and the identity normaliser."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        text = {i: model.id_to_piece(i) for i in plain}
        self.ids = {t: i for i, t in text.items()}
        score = {i: model.get_score(i) for i in plain}
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.size = n
        if any(MARK in t.lstrip(MARK) for t in text.values()):
            raise ValueError("a piece goes over a word's start")
        levels = {s: k for k, s in enumerate(sorted(set(score.values()), reverse=True))}
        rank = {i: levels[s] for i, s in score.items()}
        shared = np.bincount(list(rank.values()), minlength=len(levels)) > 1
        pairs = {}
        for t, i in self.ids.items():
            for k in range(1, len(t)):
                if t[:k] in self.ids and t[k:] in self.ids:
                    pairs[self.ids[t[:k]] << _SHIFT | self.ids[t[k:]]] = (rank[i], i)
        keys = sorted(pairs)
        self.keys = np.array(keys, np.int64)
        self.ranks = np.array([pairs[k][0] for k in keys], np.int64)
        self.merged = np.array([pairs[k][1] for k in keys], np.int64)
        self.shared = np.append(shared, False)
        self.pairs = pairs
        #: A character's first symbol: its piece, or a number beyond all pieces.
        self.symbol_of = np.arange(0x110000, dtype=np.int64) + n
        for t, i in self.ids.items():
            if len(t) == 1:
                self.symbol_of[ord(t)] = i
        self.symbol_of[0x20] = self.ids.get(MARK, n + ord(MARK))
        inside = {c for t in self.ids if len(t) > 1 for c in t}
        #: ASCII bytes that stand in no longer piece: texts may be cut on both sides of them.
        self.alone = np.zeros(256, bool)
        for c in range(128):
            self.alone[c] = c != 0x20 and chr(c) not in inside
        self.pieces = [text[i].replace(MARK, " ").encode() if i in text else b"" for i in range(n)]
        for value, i in self.bytes.items():
            self.pieces[i] = bytes([value])
        self.table = pa.array(self.pieces, pa.large_binary())
        self.decimals = pa.array([b"%d," % i for i in range(n)], pa.large_binary())
        self.cache = SegmentIds(self.encode_segments)

    def final(self, symbols: list[int]) -> list[int]:
        out = []
        for s in symbols:
            if s < self.size:
                out.append(s)
            else:
                out.extend(self.bytes[b] for b in chr(s - self.size).encode())
        return out

    def one_by_one(self, symbols: list[int]) -> list[int]:
        """Single merges, best rank first and then leftmost."""
        nxt, prv, live = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1)), list(symbols)
        heap = []

        def push(i: int) -> None:
            if 0 <= i and nxt[i] < len(live):
                found = self.pairs.get(live[i] << _SHIFT | live[nxt[i]])
                if found:
                    heapq.heappush(heap, (found[0], i, live[i], live[nxt[i]], found[1]))

        for i in range(len(live) - 1):
            push(i)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            if live[i] != a or nxt[i] >= len(live) or live[nxt[i]] != b:
                continue
            j = nxt[i]
            live[i], live[j], nxt[i] = made, -1, nxt[j]
            if nxt[i] < len(live):
                prv[nxt[i]] = i
            push(prv[i])
            push(i)
        return [s for s in live if s >= 0]

    def ranked(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of pairs; _NONE where there is none."""
        key = left << _SHIFT | right
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        ok = self.keys[place] == key
        return np.where(ok, self.ranks[place], _NONE), self.merged[place]

    def encode_segments(self, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all segments, one after the other, and each one's number of ids."""
        texts = [s.decode() for s in segments]
        counts = np.fromiter(map(len, texts), np.int64, len(texts))
        flat = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        begin = np.append(0, np.cumsum(counts))
        sym = self.symbol_of[flat]
        word = np.repeat(np.arange(len(texts)), counts)
        last = np.full(len(texts), -1, np.int64)
        many, again = np.zeros(len(texts), bool), np.zeros(len(texts), bool)
        ended: list[tuple[np.ndarray, np.ndarray]] = []
        rank, made = np.full(len(sym), _NONE), np.zeros(len(sym), np.int64)
        pair = np.flatnonzero(word[:-1] == word[1:])
        rank[pair], made[pair] = self.ranked(sym[pair], sym[pair + 1])
        while len(sym):
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.minimum.reduceat(rank, starts)
            best = np.repeat(least, np.diff(np.append(starts, len(sym))))
            done = best == _NONE
            if done.any():
                ended.append((word[done], sym[done]))
            own = word[starts]
            again[own[(least < last[own]) & many[own]]] = True
            last[own] = least
            at = np.flatnonzero((rank == best) & ~done)
            if not len(at):
                break
            # leftmost non-overlapping: every other one of a run of neighbouring pairs
            fresh = np.append(True, (np.diff(at) > 1) | (word[at[1:]] != word[at[:-1]]))
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            take = at[(np.arange(len(at)) - run) % 2 == 0]
            first_of = np.append(True, word[take[1:]] != word[take[:-1]])
            take = take[first_of | ~self.shared[rank[take]]]
            many[word[take[1:]][word[take[1:]] == word[take[:-1]]]] = True
            sym[take] = made[take]
            keep = ~done
            keep[take + 1] = False
            changed = np.zeros(len(sym), bool)
            changed[take] = True
            changed[take[take > 0] - 1] = True  # where that symbol goes away too, the one before it was merged
            sym, word, rank, made, changed = sym[keep], word[keep], rank[keep], made[keep], changed[keep]
            pair = np.flatnonzero(changed)
            inner = pair < len(sym) - 1
            inner[inner] = word[pair[inner]] == word[pair[inner] + 1]
            rank[pair[~inner]] = _NONE
            pair = pair[inner]
            rank[pair], made[pair] = self.ranked(sym[pair], sym[pair + 1])
        where = np.concatenate([w for w, _ in ended]) if ended else np.zeros(0, np.int64)
        value = np.concatenate([v for _, v in ended]) if ended else np.zeros(0, np.int64)
        order = np.argsort(where, kind="stable")
        where, value = where[order], value[order]
        bounds = np.searchsorted(where, np.arange(len(texts) + 1)).tolist()
        raw = memoryview(value.astype("<i4").tobytes())
        out = [bytes(raw[4 * a : 4 * b]) for a, b in zip(bounds[:-1], bounds[1:])]
        odd = np.unique(where[value >= self.size]).tolist()
        for i in odd:
            out[i] = np.array(self.final(value[bounds[i] : bounds[i + 1]].tolist()), "<i4").tobytes()
        for i in np.flatnonzero(again).tolist():
            first = self.symbol_of[flat[begin[i] : begin[i + 1]]].tolist()
            out[i] = np.array(self.final(self.one_by_one(first)), "<i4").tobytes()
        return np.frombuffer(b"".join(out), "<i4").astype(np.int32), np.fromiter(map(len, out), np.int64, len(out)) // 4

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Starts of segments: texts, blanks after other than blanks, and both sides of bytes that stand alone."""
        blank, alone = data == 0x20, self.alone[data]
        start = np.zeros(len(data) + 1, bool)
        start[1:-1] = (blank[1:] & ~blank[:-1]) | alone[1:] | alone[:-1]
        start[offsets] = True
        return np.flatnonzero(start)

    def encode(self, column: pa.Array):
        """Yields the ids of consecutive texts with their offsets, a block of texts at a time."""
        column = column.fill_null("").cast(pa.large_string())
        text = pc.replace_substring(column, MARK, " ")
        text = pc.if_else(pc.equal(pc.binary_length(text), 0), "", pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), text, pa.scalar("", pa.large_string())))
        data, offsets = buffers(text)
        i, n = 0, len(offsets) - 1
        while i < n:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK_BYTES, side="right")) - 1)
            own = data[offsets[i] : offsets[j]]
            bounds = offsets[i : j + 1] - offsets[i]
            if len(own):
                cuts = self.cuts(own, bounds)
                flat, counts = self.cache.ids(own, cuts)
                ends = np.append(0, np.cumsum(counts))
                yield flat, ends[np.searchsorted(cuts, bounds)]
            else:
                yield np.zeros(0, np.int32), np.zeros(j - i + 1, np.int64)
            i = j

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Texts of id sequences: pieces joined, marks as blanks, the leading one dropped."""
        taken = self.table.take(pa.array(ids))
        data, at = buffers(taken.cast(pa.large_binary())) if len(taken) else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
        view, ends = memoryview(data), at[offsets]
        out = []
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
            out.append(bytes(view[a + (b > a and view[a] == 0x20) : b]))
        return out


_models: dict[str, PieceModel] = {}


def model_of(path: str) -> PieceModel:
    """The model of a worker process; its cache lives as long as the process."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encode(df: DataFrame, model: str, text: str = "text", decoded: bool = False) -> DataFrame:
    """Adds ids, and decoded (the text of those ids) if asked for; columns of these names are replaced."""
    fields = [StructField("ids", ArrayType(IntegerType()))] + [StructField("decoded", StringType())] * decoded

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        own = model_of(model)
        ids, sizes, texts = [], [], []
        for flat, offsets in own.encode(batch.column(text)):
            ids.append(flat)
            sizes.append(np.diff(offsets))
            if decoded:
                texts.extend(own.decode(flat, offsets))
        offsets = np.append(0, np.cumsum(np.concatenate(sizes))) if sizes else np.zeros(1, np.int64)
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        out = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))]
        return out + ([pa.array([t.decode(errors="replace") for t in texts], pa.string())] if decoded else [])

    return with_columns(df, fields, compute, text)


def digests(df: DataFrame, model: str, text: str = "text", with_ids: bool = False) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of the encoded and decoded texts in place of the texts, and ids if asked for; else ids do not go through the JVM."""
    fields = [StructField("ids", ArrayType(IntegerType()))] * with_ids + [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        own = model_of(model)
        counts, ids_hash, text_hash, ids = [], [], [], []
        for flat, offsets in own.encode(batch.column(text)):
            counts.extend(np.diff(offsets).tolist())
            ids.extend([flat] * with_ids)
            data, at = buffers(own.decimals.take(pa.array(flat))) if len(flat) else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
            view, ends = memoryview(data), at[offsets].tolist()
            ids_hash.extend(hashlib.sha256(view[a : max(a, b - 1)]).hexdigest() for a, b in zip(ends[:-1], ends[1:]))
            text_hash.extend(hashlib.sha256(t).hexdigest() for t in own.decode(flat, offsets))
        own_ids = [pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32()))] if with_ids else []
        return own_ids + [pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]

    return with_columns(df, fields, compute, text, gone=[text])


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids, n_tokens and the digests of the ids and of the decoded text."""
    return digests(docs.select("doc_id", "text"), model, with_ids=True)


def op8(docs: DataFrame, model: str) -> DataFrame:
    return digests(docs.select("doc_id", "text"), model)
