"""Encoding and decoding with a public sentencepiece BPE model by vectorised merge rounds.

A task turns its texts into words (a run of spaces with what follows), and encodes each distinct word once: the symbols of all
new words lie in one flat array, every round finds the best pair of each word (segmented minimum of the pair ranks) and merges
its occurrences from the left in all words at once, then compacts the array, until no pair is left.

Where a round opens a pair at least as good as the one it merged more than once, the order of single merges matters; such words
are encoded one merge at a time instead. Null and empty texts give the begin and end ids only; repeated rows are encoded alike.
Words of any length are whole: there is no cut and no cap.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from shiftgrid.llm.common import map_rows

SPACE_MARK = "▁"
NORMAL, CONTROL, BYTE = 1, 3, 6
NONE = np.iinfo(np.int64).max
# Distinct words a task remembers; the memory is emptied when it is full, which changes speed only.
REMEMBERED = 200_000


class Model:
    """Tables of one model file: symbols, mergeable pairs with their ranks, and the bytes of every id."""

    def __init__(self, data: bytes):
        from sentencepiece import sentencepiece_model_pb2 as proto

        m = proto.ModelProto()
        m.ParseFromString(data)
        n = m.normalizer_spec
        if (m.trainer_spec.model_type != 2 or not m.trainer_spec.byte_fallback or n.precompiled_charsmap
                or n.remove_extra_whitespaces or not n.add_dummy_prefix):
            raise ValueError("only BPE models with byte fallback, a dummy prefix and no other normalisation are read")
        self.size = len(m.pieces)
        self.bos, self.eos, self.unk = m.trainer_spec.bos_id, m.trainer_spec.eos_id, m.trainer_spec.unk_id
        self.unk_surface = m.trainer_spec.unk_surface.encode()
        self.kind = np.array([p.type for p in m.pieces])
        piece = {p.piece: i for i, p in enumerate(m.pieces) if p.type == NORMAL}
        if any(SPACE_MARK in s.lstrip(SPACE_MARK) or "\n" in s for s in piece):
            raise ValueError("a piece crosses a word border")
        self.byte_id = np.zeros(256, np.int64)
        self.surface: list[bytes] = []
        for i, p in enumerate(m.pieces):
            if p.type == BYTE:
                value = int(p.piece[3:5], 16)
                self.byte_id[value] = i
                self.surface.append(bytes([value]))
            else:
                self.surface.append(b"" if p.type == CONTROL else p.piece.replace(SPACE_MARK, " ").encode())
        # Symbols: the pieces, then single characters that only occur inside pieces.
        self.symbol = dict(piece)
        for s in piece:
            for c in s:
                self.symbol.setdefault(c, self.size + len(self.symbol))
        self.stride = max(self.symbol.values()) + 2  # the last number stands for any character unknown to the model
        place = {s: r for r, s in enumerate(sorted({m.pieces[i].score for i in piece.values()}, reverse=True))}
        pairs = [
            (self.symbol[s[:k]] * self.stride + self.symbol[s[k:]], place[m.pieces[i].score], i)
            for s, i in piece.items() for k in range(1, len(s)) if s[:k] in self.symbol and s[k:] in self.symbol
        ]
        pairs.sort()
        self.pair_key = np.array([p[0] for p in pairs] + [NONE], np.int64)
        self.pair_rank = np.array([p[1] for p in pairs] + [NONE], np.int64)
        self.pair_made = np.array([p[2] for p in pairs] + [-1], np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (NONE where the two do not merge) and the symbol it makes."""
        key = left * self.stride + right
        at = np.searchsorted(self.pair_key, key)
        found = self.pair_key[at] == key
        return np.where(found, self.pair_rank[at], NONE), self.pair_made[at]


def merge_rounds(model: Model, words: list[str]) -> list[np.ndarray]:
    """Ids of each word (not empty)."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    unknown = model.stride - 1
    chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    known, place = np.unique(chars, return_inverse=True)
    symbols = np.fromiter((model.symbol.get(chr(c), unknown) for c in known), np.int64, known.size)[place]
    word = np.repeat(np.arange(len(words)), lengths)
    origin = np.arange(chars.size)  # first character of a symbol
    best_before = np.full(len(words), -1, np.int64)
    several = np.zeros(len(words), bool)
    ordered = np.zeros(len(words), bool)  # words for which the order of merges matters
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while symbols.size:
        start = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        rank = np.full(symbols.size, NONE, np.int64)
        made = np.full(symbols.size, -1, np.int64)
        rank[:-1], made[:-1] = model.ranks(symbols[:-1], symbols[1:])
        rank[start[1:] - 1] = NONE
        best = np.minimum.reduceat(rank, start)
        own = word[start]
        ordered[own[several[own] & (best <= best_before[own])]] = True
        spread = np.repeat(best, np.diff(np.append(start, symbols.size)))
        go = (spread != NONE) & ~ordered[word]
        ready = ~go
        if ready.any():
            done.append((word[ready], origin[ready], symbols[ready]))
        hit = go & (rank == spread)
        # overlapping occurrences stand in a row; from the left, every other one merges
        at = np.flatnonzero(hit)
        first = np.concatenate(([True], np.diff(at) != 1)) if at.size else np.zeros(0, bool)
        since = np.arange(at.size) - np.maximum.accumulate(np.where(first, np.arange(at.size), 0))
        at = at[since % 2 == 0]
        best_before[own] = best
        several[:] = np.bincount(word[at], minlength=len(words)) > 1
        symbols[at] = made[at]
        keep = go
        keep[at + 1] = False
        symbols, word, origin = symbols[keep], word[keep], origin[keep]
    words_of, origins, final = (np.concatenate([d[i] for d in done]) for i in range(3))
    order = np.argsort(origins)  # origins rise with the words
    words_of, origins, final = words_of[order], origins[order], final[order]
    ends = np.append(origins[1:], chars.size)
    bounds = np.searchsorted(words_of, np.arange(len(words) + 1))
    plain = final < model.size
    out = []
    offset = np.concatenate(([0], np.cumsum(lengths)))
    for i, w in enumerate(words):
        a, b = bounds[i], bounds[i + 1]
        if ordered[i]:
            out.append(single_merges(model, w))
        elif plain[a:b].all():
            out.append(final[a:b])
        else:
            ids: list[int] = []
            for s, x, y in zip(final[a:b].tolist(), (origins[a:b] - offset[i]).tolist(), (ends[a:b] - offset[i]).tolist(), strict=True):
                ids += [s] if s < model.size else model.byte_id[list(w[x:y].encode())].tolist()
            out.append(np.array(ids, np.int64))
    return out


def single_merges(model: Model, w: str) -> np.ndarray:
    """Ids of one word, one merge at a time: the best rank first, the leftmost among equals."""
    unknown = model.stride - 1
    symbol = [model.symbol.get(c, unknown) for c in w]
    after = [*range(1, len(w)), -1]
    before = [*range(-1, len(w) - 1)]
    heap: list[tuple[int, int, int, int, int]] = []

    def offer(i: int, j: int) -> None:
        if i >= 0 and j >= 0:
            rank, made = model.ranks(np.array([symbol[i]]), np.array([symbol[j]]))
            if rank[0] != NONE:
                heapq.heappush(heap, (int(rank[0]), i, symbol[i], symbol[j], int(made[0])))

    for i in range(len(w) - 1):
        offer(i, i + 1)
    while heap:
        _, i, a, b, made = heapq.heappop(heap)
        j = after[i]
        if symbol[i] != a or j < 0 or symbol[j] != b:
            continue
        symbol[i], symbol[j] = made, -1
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        offer(before[i], i)
        offer(i, after[i])
    ids: list[int] = []
    for i, s in enumerate(symbol):
        if s >= 0:
            ids += [s] if s < model.size else model.byte_id[list(w[i].encode())].tolist()
    return np.array(ids, np.int64)


WORD = re.compile(f"{SPACE_MARK}*[^{SPACE_MARK}\n]+|{SPACE_MARK}+|\n")


class Encoder:
    """Encodes lists of texts; remembers the ids of words it has seen as little-endian 32-bit numbers."""

    def __init__(self, model: Model):
        self.model, self.seen = model, {}
        self.begin, self.end = (np.array([i], "<u4").tobytes() for i in (model.bos, model.eos))

    def split(self, text: str) -> list[str]:
        return WORD.findall(SPACE_MARK + text.replace(" ", SPACE_MARK)) if text else []

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.split(t) for t in texts]
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        new = list({w for words in split for w in words if w not in self.seen})
        at = 0
        while at < len(new):  # flat arrays of about a million symbols at a time
            end, total = at, 0
            while end < len(new) and (end == at or total < 1_000_000):
                total += len(new[end])
                end += 1
            for w, ids in zip(new[at:end], merge_rounds(self.model, new[at:end]), strict=True):
                self.seen[w] = ids.astype("<u4").tobytes()
            at = end
        seen = self.seen
        return [self.begin + b"".join([seen[w] for w in words]) + self.end for words in split]


def decode(model: Model, ids: Iterable[int]) -> bytes:
    """UTF-8 bytes of the text that ids stand for: pieces joined, byte pieces read as UTF-8, the dummy space taken off."""
    ids = list(ids)
    parts = [model.surface[i] for i in ids]
    if model.unk in ids:
        parts = [model.unk_surface if i == model.unk else p for i, p in zip(ids, parts, strict=True)]
    at = next((k for k, i in enumerate(ids) if model.kind[i] != CONTROL), None)
    if at is not None and ids[at] != model.unk and model.kind[ids[at]] != BYTE and parts[at].startswith(b" "):
        parts[at] = parts[at][1:]
    out = b"".join(parts)
    try:
        out.decode()
        return out
    except UnicodeDecodeError:  # each byte that starts no whole character becomes U+FFFD
        text, k = [], 0
        while k < len(out):
            for size in range(1, 5):
                try:
                    text.append(out[k:k + size].decode())
                    k += size
                    break
                except UnicodeDecodeError:
                    continue
            else:
                text.append("�")
                k += 1
        return "".join(text).encode()


def encoded(docs: DataFrame, keep: list[str], model_path: str, text: str = "text", ids: bool = True) -> DataFrame:
    """``keep``, ids (array<int>, with begin and end ids; left out if not asked for), n_tokens, and decoded text's bytes digest.

    The model file is read where the plan is built (it is some 500 KB, whatever the input) and travels with the tasks.
    """
    with open(model_path, "rb") as f:
        data = f.read()

    def make():
        model = Model(data)
        encoder = Encoder(model)

        def function(texts: list[bytes | None]):
            for a in range(0, len(texts), 256):
                part = [(t or b"").decode() for t in texts[a:a + 256]]
                for code in encoder.encode(part):
                    values = np.frombuffer(code, "<u4")
                    row = (values.size, hashlib.sha256(code).hexdigest(),
                           hashlib.sha256(decode(model, values.tolist())).hexdigest())
                    yield (values.astype(np.int32), *row) if ids else row

        return function

    fields = [T.StructField("ids", T.ArrayType(T.IntegerType(), False))] if ids else []
    fields += [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
               T.StructField("decoded_sha256", T.StringType())]
    return map_rows(docs, keep, text, make, T.StructType(fields))
