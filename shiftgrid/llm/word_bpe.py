"""Encoding and decoding with a public word-end BPE vocabulary, one merge queue per distinct word.

A text is cut at the added tokens, normalised (NFC, lower case) and split into words, contractions, single digits and runs of
signs; white space only separates. Each distinct word becomes a doubly linked list of byte symbols, the last of which carries
the word end. A priority queue holds the rank and place of every pair that merges; the best rank goes first, the leftmost among
equals, and entries whose pair has changed since are skipped. Decoding looks ids up and joins their vocabulary strings.

Null and empty texts, and texts of white space only, have no ids. Repeated rows are encoded alike. Bytes that are no UTF-8 are
read as U+FFFD. Words of any length are encoded whole: there is no cut and no cap. Columns of the input that are neither kept
nor the text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable
from heapq import heapify, heappop, heappush
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from shiftgrid.llm.common import map_rows

# The split pattern and normalisation of the vocabulary file this module reads.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALISATION = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]

ASCII_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t-\ra-z0-9]+")
# Distinct words a task remembers, and the longest of them; forgetting changes speed only.
REMEMBERED = 300_000
LONGEST_REMEMBERED = 64


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself where it is a visible Latin-1 sign, else the next one from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    stands = {b: chr(b) for b in visible} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}
    return [stands[b] for b in range(256)]


class Model:
    """Tables of one vocabulary file: byte symbols inside and at the end of a word, merges with rank and result, id strings."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        bpe = spec["model"]
        normal = (spec.get("normalizer") or {}).get("normalizers")
        parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}, {}]
        if (bpe["type"] != "BPE" or bpe.get("continuing_subword_prefix") or bpe.get("byte_fallback") or bpe.get("unk_token")
                or bpe.get("ignore_merges") or normal != NORMALISATION or spec.get("decoder")
                or parts[0].get("pattern") != {"Regex": SPLIT} or not parts[0].get("invert") or parts[1].get("use_regex")
                or parts[1].get("add_prefix_space")):
            raise ValueError("only byte-level BPE with word ends, NFC, lower case and the known word pattern is read")
        added = spec["added_tokens"]
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("only plain added tokens are read")
        vocab = bpe["vocab"]
        end = bpe["end_of_word_suffix"]
        symbols = byte_symbols()
        self.inside = [vocab[s] for s in symbols]
        self.final = [vocab[s + end] for s in symbols]
        self.string = {i: s for s, i in vocab.items()} | {t["id"]: t["content"] for t in added}
        self.stride = max(self.string) + 1
        self.rank_of = {vocab[a] * self.stride + vocab[b]: rank for rank, (a, b) in enumerate(bpe["merges"])}
        self.made_by = [vocab[a + b] for a, b in bpe["merges"]]
        self.number = {i: str(i) for i in self.string}
        self.added = {t["content"]: t["id"] for t in added}
        names = sorted(self.added, key=len, reverse=True)
        self.cuts = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None


def merged(model: Model, word: str) -> list[int]:
    """Ids of one normalised word."""
    data = word.encode()
    symbol = [model.inside[b] for b in data[:-1]] + [model.final[data[-1]]]
    n = len(symbol)
    if n == 1:
        return symbol
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    rank_of, made_by, stride = model.rank_of.get, model.made_by, model.stride
    queue = []  # rank and place as one number
    for i in range(n - 1):
        rank = rank_of(symbol[i] * stride + symbol[i + 1])
        if rank is not None:
            queue.append(rank * n + i)
    heapify(queue)
    while queue:
        rank, i = divmod(heappop(queue), n)
        j = after[i]
        if symbol[i] < 0 or j < 0:
            continue
        made = made_by[rank]
        now = rank_of(symbol[i] * stride + symbol[j])
        if now is None or made_by[now] != made:  # stale: the pair at this place is another one by now
            continue
        symbol[i], symbol[j] = made, -1
        k = after[i] = after[j]
        if k >= 0:
            before[k] = i
            rank = rank_of(made * stride + symbol[k])
            if rank is not None:
                heappush(queue, rank * n + i)
        h = before[i]
        if h >= 0:
            rank = rank_of(symbol[h] * stride + made)
            if rank is not None:
                heappush(queue, rank * n + h)
    return [s for s in symbol if s >= 0]


class Splitter:
    """Normalises and splits a stretch of text without added tokens.

    Python's tables and those of the library agree on every character that Python's Unicode version knows. Stretches with a
    character it does not know are put to the library's own normaliser and splitter.
    """

    def __init__(self, data: bytes):
        import regex
        from tokenizers import Tokenizer

        self.pattern = regex.compile(SPLIT.replace(r"[^\s", r"[^\p{White_Space}"))
        self.library = Tokenizer.from_str(data.decode())
        self.back = {s: b for b, s in enumerate(byte_symbols())}
        self.unknown: dict[str, bool] = {}

    def words(self, text: str) -> list[str]:
        if text.isascii():
            return ASCII_WORD.findall(text.lower())
        unknown = self.unknown
        for c in set(text):
            if c not in unknown:
                unknown[c] = unicodedata.category(c) == "Cn"
            if unknown[c]:
                return self.by_library(text)
        # one character at a time: a capital sigma never looks at its neighbours
        return self.pattern.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def by_library(self, text: str) -> list[str]:
        normal = self.library.normalizer.normalize_str(text)
        back = self.back
        return [bytes([back[c] for c in w]).decode() for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]


class Encoder:
    """Encodes texts; remembers the ids of words it has seen."""

    def __init__(self, data: bytes):
        self.model, self.splitter = Model(data), Splitter(data)
        self.seen: dict[str, list[int]] = {}

    def encode(self, text: str) -> list[int]:
        model, seen = self.model, self.seen
        ids: list[int] = []
        for part in model.cuts.split(text) if model.cuts else [text]:
            if part in model.added:
                ids.append(model.added[part])
                continue
            words = self.splitter.words(part)
            if len(seen) > REMEMBERED:
                seen.clear()
            new = set(words).difference(seen)
            for w in new:
                seen[w] = merged(model, w)
            ids.extend(chain.from_iterable(map(seen.__getitem__, words)))
            for w in new:
                if len(w) > LONGEST_REMEMBERED:
                    del seen[w]
        return ids


def decode(model: Model, ids: Iterable[int]) -> str:
    """The vocabulary strings of the ids with a space between; ids the vocabulary does not hold are left out."""
    string = model.string
    return " ".join([string[i] for i in ids if i in string])


def encoded(docs: DataFrame, keep: list[str], model_path: str, text: str = "text", ids: bool = True) -> DataFrame:
    """``keep``, ids (array<int>; left out if not asked for), n_tokens, ids_sha256 of the decimal ids joined by a space, and
    decoded_sha256 of the decoded text.

    The file is read where the plan is built (some 2 MB, whatever the input) and travels with the tasks. One row per input row.
    """
    with open(model_path, "rb") as f:
        data = f.read()

    def make():
        encoder = Encoder(data)
        model = encoder.model
        number = model.number

        def function(texts: list[bytes | None]):
            for t in texts:
                found = encoder.encode((t or b"").decode("utf-8", "replace"))
                row = (len(found), hashlib.sha256(" ".join([number[i] for i in found]).encode()).hexdigest(),
                       hashlib.sha256(decode(model, found).encode()).hexdigest())
                yield (found, *row) if ids else row

        return function

    fields = [T.StructField("ids", T.ArrayType(T.IntegerType(), False))] if ids else []
    fields += [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
               T.StructField("decoded_sha256", T.StringType())]
    return map_rows(docs, keep, text, make, T.StructType(fields))
