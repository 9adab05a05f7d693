"""BPE encoding and decoding with a public tokenizer file, by batched numpy merge rounds.

A text is normalised and cut into pre-tokens; both steps never look past white space, so they are done for the
distinct space-separated words of a slice. The symbols of all new pre-tokens lie in one flat array. In each round the
rank of every neighbouring pair is found by binary search over the sorted pair keys, and each pre-token merges its pair
of the lowest rank, everywhere it occurs, from the left; a pre-token without a mergeable pair is finished. Ids of words
seen before come from a table of bounded size that a worker keeps (``KEEP_WORDS``; it is emptied when full, which
changes no result). The texts' ids are then gathered in one step.

The file says what is done: NFC, white space, lower case (character by character), a split pattern, byte-level symbols,
an end-of-word suffix, and special tokens that are found in the raw text first. Decoding has no decoder in such a file:
the tokens are joined by one space.

Nulls and odd rows: a null or blank text has no ids and decodes to an empty text; repeated rows are encoded alike;
texts are whole, however long.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from tidemark.llm.arrays import find_words, lists, ragged, slices, span_hashes

KEEP_WORDS = 1 << 18
_SLICE = 2 << 20
_NONE = np.int64(1) << 40
#: Fixed value: the split pattern of the tokenizer file.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the others from U+0100 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(other)) for b in range(256)]


LETTER, DIGIT, OTHER = 1, 2, 3


@functools.lru_cache(2)
def characters(pattern: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the characters of the basic plane: whether they are plain, their lower case, and their kind (0: space).

    Kinds stand for the split pattern's runs of letters, single digits and runs of the rest.
    """
    if pattern != SPLIT:
        raise ValueError("another split pattern than the one this encoder knows")
    code = [c for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    chars = "".join(map(chr, code))
    plain, lower, kind = np.zeros(0x10000, bool), np.arange(0x10000, dtype=np.uint32), np.full(0x10000, OTHER, np.uint8)
    small = [c.lower() for c in chars]
    plain[code] = [len(c) == 1 for c in small]
    plain[[ord("'"), ord("<")]] = False
    lower[code] = [ord(c[0]) for c in small]
    for what, found in ((LETTER, r"\p{L}"), (DIGIT, r"\p{N}"), (0, r"\s")):
        kind[[ord(c) for c in regex.findall(found, chars)]] = what
    return plain, lower, kind[lower]


class Bpe:
    """A tokenizer of one file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.tokens = [""] * (max([*vocab.values(), *(x["id"] for x in spec["added_tokens"])]) + 1)
        for token, i in vocab.items():
            self.tokens[i] = token
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        for token, i in self.special.items():
            self.tokens[i] = token
        self.special_pattern = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        letters = byte_letters()
        self.first = np.array([vocab.get(c, -1) for c in letters], np.int64)
        self.last = np.array([vocab.get(c + suffix, -1) for c in letters], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([(vocab[a] << 20) | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made
        self.forget()

    def forget(self) -> None:
        self.seen = np.zeros(0, np.uint64)
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.int32)

    def pieces(self, word: str) -> list[bytes | int]:
        """Pre-tokens of a word as bytes, special tokens as ids."""
        out: list[bytes | int] = []
        if self.special_pattern and "<|" in word:
            at = 0
            for m in self.special_pattern.finditer(word):
                out += self.pieces_of(word[at:m.start()])
                out.append(self.special[m.group()])
                at = m.end()
            return out + self.pieces_of(word[at:])
        return self.pieces_of(word)

    def pieces_of(self, word: str) -> list[bytes]:
        if word.isascii():
            word = word.lower()
        else:
            word = "".join(c.lower() for c in unicodedata.normalize("NFC", word))
        return [x.encode() for x in self.split.findall(word)]

    def merge(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many pre-tokens (spans of bytes, none empty) in one flat array, and how many each has."""
        data = data[ragged(starts, sizes)]
        ends = np.cumsum(sizes)
        sym = self.first[data]
        sym[ends - 1] = self.last[data[ends - 1]]
        word = np.repeat(np.arange(len(sizes)), sizes)
        done_word, done_sym = [], []
        while len(sym):
            key = (sym[:-1] << 20) | sym[1:]
            near = word[:-1] == word[1:]
            at = np.searchsorted(self.keys, key)
            at[at == len(self.keys)] = 0
            rank = np.full(len(sym), _NONE)
            found = near & (self.keys[at] == key)
            rank[:-1][found] = self.ranks[at[found]]
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            low = np.minimum.reduceat(rank, starts)
            ended = np.repeat(low == _NONE, np.diff(np.r_[starts, len(sym)]))
            if ended.any():
                done_word.append(word[ended])
                done_sym.append(sym[ended])
            best = np.repeat(low, np.diff(np.r_[starts, len(sym)]))
            take = (rank == best) & ~ended
            where = np.flatnonzero(take)
            if len(where) > 1:  # of overlapping pairs (aaa) every second one, from the left
                run = np.cumsum(np.r_[True, np.diff(where) != 1])
                begin = where[np.r_[True, np.diff(where) != 1]][run - 1]
                where = where[(where - begin) % 2 == 0]
            sym[where] = self.made[rank[where]]
            keep = ~ended
            keep[where + 1] = False
            sym, word = sym[keep], word[keep]
        if not done_word:
            return np.zeros(0, np.int32), np.zeros(len(sizes), np.int64)
        word, sym = np.concatenate(done_word), np.concatenate(done_sym)
        order = np.argsort(word, kind="stable")
        return sym[order].astype(np.int32), np.bincount(word, minlength=len(sizes))

    def _pretokens(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """(word, fixed id or -1, bytes, starts, sizes) of the pre-tokens of some words, in order of the words.

        Words of plain characters are lower-cased and cut all at once, by table; the few others one by one: those with
        an apostrophe or a special token, outside the basic plane, or changed by NFC or to two lower-case letters.
        """
        spaced = np.full(int((ends - starts).sum()) + len(starts), 0x20, np.uint8)
        sizes = ends - starts
        spaced[ragged(np.cumsum(sizes + 1) - sizes - 1, sizes)] = data[ragged(starts, sizes)]
        text = spaced.tobytes().decode("utf-8", "replace")
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        plain, lower, kind = characters(self.split.pattern)
        gap = code == 0x20
        word = np.cumsum(gap) - gap
        short = np.minimum(code, 0xFFFF)
        odd = np.zeros(len(starts), bool)
        odd[word[~plain[short] | (code > 0xFFFF)]] = True
        words = None
        if not unicodedata.is_normalized("NFC", text):
            words = text.split(" ")
            odd |= np.fromiter((not w.isascii() and not unicodedata.is_normalized("NFC", w) for w in words[:-1]), bool)
        kinds = np.where(odd[np.minimum(word, len(odd) - 1)], 0, kind[short])
        begin = (kinds > 0) & (np.r_[True, kinds[1:] != kinds[:-1]] | (kinds == DIGIT))
        last = (kinds > 0) & np.r_[(kinds[1:] != kinds[:-1]) | begin[1:], True]
        low = lower[short]
        size = 1 + (low >= 0x80).astype(np.int64) + (low >= 0x800)
        place = np.cumsum(size) - size
        small = low.astype("<u4").tobytes().decode("utf-32-le", "replace").encode()
        b, e = np.flatnonzero(begin), np.flatnonzero(last)
        owner, at = word[b], place[b]
        length = place[e] + size[e] - at
        fixed = np.full(len(b), -1, np.int64)
        if odd.any():
            words = words or text.split(" ")
            extra = [(i, p) for i in np.flatnonzero(odd).tolist() for p in self.pieces(words[i])]
            tails = [b"" if isinstance(p, int) else p for _, p in extra]
            sizes = np.fromiter(map(len, tails), np.int64, len(tails))
            owner = np.r_[owner, np.fromiter((i for i, _ in extra), np.int64, len(extra))]
            at, length = np.r_[at, len(small) + np.cumsum(sizes) - sizes], np.r_[length, sizes]
            fixed = np.r_[fixed, np.fromiter((p if isinstance(p, int) else -1 for _, p in extra), np.int64, len(extra))]
            small += b"".join(tails)
            order = np.argsort(owner, kind="stable")
            owner, at, length, fixed = owner[order], at[order], length[order], fixed[order]
        return owner, fixed, np.frombuffer(small, np.uint8), at, length

    def _learn(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        owner, fixed, letters, at, length = self._pretokens(data, starts, ends)
        cut = fixed < 0
        _, index, inverse = np.unique(span_hashes(letters, at[cut], (at + length)[cut]), return_index=True,
                                      return_inverse=True)
        ids, sizes = self.merge(letters, at[cut][index], length[cut][index])
        special = fixed[~cut]
        first, count = np.zeros(len(cut), np.int64), np.ones(len(cut), np.int64)
        first[cut], count[cut] = (np.cumsum(sizes) - sizes)[inverse], sizes[inverse]
        first[~cut] = len(ids) + np.arange(len(special))
        flat = np.concatenate([ids, special.astype(np.int32)])[ragged(first, count)]
        size = np.bincount(owner, count, len(hashes)).astype(np.int64)
        start = len(self.pool) + np.cumsum(size) - size
        order = np.argsort(np.concatenate([self.seen, hashes]), kind="stable")
        self.seen = np.concatenate([self.seen, hashes])[order]
        self.at, self.size = np.concatenate([self.at, start])[order], np.concatenate([self.size, size])[order]
        self.pool = np.concatenate([self.pool, flat])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts data[offsets[i]:offsets[i + 1]] in one array, and its offsets."""
        words = find_words(data, offsets)
        distinct, index, inverse = np.unique(words.hashes(), return_index=True, return_inverse=True)
        if len(self.seen) > KEEP_WORDS:
            self.forget()
        new = ~np.isin(distinct, self.seen, assume_unique=True)
        if new.any():
            self._learn(distinct[new], data, words.starts[index[new]], words.ends[index[new]])
        at = np.searchsorted(self.seen, distinct)
        size = self.size[at][inverse]
        ids = self.pool[ragged(self.at[at][inverse], size)]
        total = np.r_[0, np.cumsum(size)]
        return ids, total[words.first]

    def decode(self, ids: np.ndarray) -> str:
        return " ".join([self.tokens[i] for i in ids.tolist()])


@functools.lru_cache(2)
def tokenizer(path: str) -> Bpe:
    return Bpe(path)


def _run(docs: DataFrame, id_col: str, text_col: str, path: str, with_text: bool) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    fields = [StructField("doc_id", LongType()), StructField("ids", ArrayType(IntegerType()))]
    fields += [StructField("decoded", StringType())] * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(1), _SLICE):
                ids, at = bpe.encode(data, offsets)
                columns = [batch.column(0).slice(lo, hi - lo), lists(pa.array(ids), at)]
                if with_text:
                    columns.append(pa.array([bpe.decode(ids[at[i]:at[i + 1]]) for i in range(hi - lo)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    return rows.mapInArrow(run, StructType(fields))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every row."""
    return _run(docs, id_col, text_col, path, False)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and decoded text of rows with ids; null ids are none."""
    rows = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            texts = [" ".join([bpe.tokens[i] for i in x or ()]) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "decoded"])

    return rows.mapInArrow(run, "doc_id long, decoded string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids and decoded: encoding and decoding in one pass over the rows."""
    return _run(docs, id_col, text_col, path, True)
