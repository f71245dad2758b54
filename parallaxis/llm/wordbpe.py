"""BPE encoding and decoding by a depth-first walk over the trie of distinct words.

For every prefix of a word the last token of that prefix's encoding is unique, and the encoding of a longer prefix is
the encoding of a shorter one followed by one token that is compatible with its last token. Words are visited in
sorted order, which is the depth-first order of their trie: the stack of last-token states up to the branching point is
kept, so the encoding of a shared prefix is computed once.

Rows: null text counts as empty; empty text has no ids. Special tokens written in a text become their own ids, as the
tokenizers library does by default. Other columns of the input take no part, whatever their names.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .runtime import columns_or_null, ship

INF = 1 << 60
#: Distinct words whose ids a worker keeps; the table starts anew beyond it, so memory stays bounded.
CACHE_WORDS = 400_000
#: Token pairs whose compatibility a worker keeps.
CACHE_PAIRS = 500_000
#: Documents of a batch that are Python objects at a time.
ROWS = 1000
#: Characters of Latin-1 that the fast word splitter knows; other texts go through the library's own splitter.
_PLAIN = re.compile("[^\t\n\r\x20-\x7e¡-ÿ]")
_LETTERS = "a-zªµºß-öø-ÿ"
_NUMBERS = "0-9²³¹¼-¾"
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\\s{_LETTERS}{_NUMBERS}]+")


def byte_alphabet() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    out = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [out[b] for b in range(256)]


def check_rules(spec: dict, path: str) -> None:
    """The splitting of words and the joining of tokens here are those of one kind of vocabulary file; others are refused."""
    normal, split, model = (spec.get("normalizer") or {}), (spec.get("pre_tokenizer") or {}), spec["model"]
    steps = [x["type"] for x in normal.get("normalizers", [])]
    pieces = [x["type"] for x in split.get("pretokenizers", [])]
    plain = not (model.get("dropout") or model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("ignore_merges"))
    if model["type"] != "BPE" or not model.get("end_of_word_suffix") or steps != ["NFC", "Replace", "Lowercase"] or pieces != ["Split", "ByteLevel"] or spec.get("decoder") is not None or not plain:
        raise ValueError(f"{path}: not a lower-case byte-level BPE vocabulary with word ends and without a decoder")


class TrieEncoder:
    """Encodes words of a byte-level BPE vocabulary with word-end symbols."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check_rules(spec, path)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.largest = max([*vocab.values(), *self.special.values()])
        back = {c: b for b, c in enumerate(byte_alphabet())}
        self.unmap = back
        #: Tokens as byte strings: those inside a word, and those that close it.
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        for t, i in vocab.items():
            closes = bool(self.end) and t.endswith(self.end) and len(t) > len(self.end)
            body = t[: -len(self.end)] if closes else t
            (self.final if closes else self.inner)[bytes(back[c] for c in body)] = i
        #: Every ending of a token, with the token's id if the ending is a whole token and else -1.
        self.inner_ends, self.final_ends = ({t[i:]: -1 for t in known for i in range(len(t))} | known for known in (self.inner, self.final))
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for k, m in enumerate(model["merges"]):
            a, b = m if not isinstance(m, str) else m.split(" ")
            pair, made = (vocab[a], vocab[b]), vocab[a + b]
            self.rank.setdefault(pair, k)
            self.parts.setdefault(made, (*pair, k))
        self.right: dict[int, list[tuple[int, int]]] = {}
        self.left: dict[int, list[tuple[int, int]]] = {}
        self.fits: dict[int, bool] = {}
        self.cache: dict[str, bytes] = {}

    def spine(self, token: int, side: int, memo: dict) -> list[tuple[int, int]]:
        """Symbols that stand at one edge of the token while it is being merged, each with the rank that ends it."""
        if token not in memo:
            out, at = [(token, INF)], token
            while at in self.parts:
                *halves, ends = self.parts[at]
                at = halves[side]
                out.append((at, ends))
            memo[token] = out[::-1]
        return memo[token]

    def compatible(self, a: int, b: int) -> bool:
        """Whether the text of tokens a and b is encoded as just these two, so no merge crosses their border."""
        key = a << 20 | b
        known = self.fits.get(key)
        if known is not None:
            return known
        p, t = self.spine(a, 1, self.right), self.spine(b, 0, self.left)
        i = j = 0
        ok = True
        while True:
            (x, dx), (y, dy) = p[i], t[j]
            k = self.rank.get((x, y))
            if k is not None and k < dx and k <= dy:  # of equal ranks, the leftmost pair goes first
                ok = False
                break
            if dx == INF and dy == INF:
                break
            if dx <= dy:
                i += 1
            else:
                j += 1
        self.fits[key] = ok
        return ok

    def encode_words(self, words: Iterable[bytes]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of sorted distinct words.

        last[i] is the token that ends the encoding of the current word's first i bytes, length[i] its length. It is the
        one token that ends there and is compatible with the last token of what stands before it.
        """
        last, length, before = [0], [0], b""
        closed, fits, compatible = bool(self.end), self.fits, self.compatible
        inner, final = self.inner_ends, self.final_ends
        for w in words:
            stop = len(w) - closed
            shared, most = 0, min(len(before), stop, len(last) - 1)
            while shared < most and before[shared] == w[shared]:
                shared += 1
            del last[shared + 1 :], length[shared + 1 :]
            ends = inner
            for i in range(shared + 1, len(w) + 1):
                if i > stop:
                    ends = final
                j = i - 1
                while True:
                    t = ends[w[j:i]]  # -1: no token by itself, but one ends with it
                    if t >= 0:
                        if not j:
                            break
                        pair = last[j] << 20 | t
                        if fits[pair] if pair in fits else compatible(last[j], t):
                            break
                    j -= 1
                last.append(t)
                length.append(i - j)
            ids, i = [], len(w)
            while i > 0:
                ids.append(last[i])
                i -= length[i]
            ids.reverse()
            yield array("I", ids).tobytes()
            if closed:
                del last[-1], length[-1]
            before = w

    def split(self, text: str) -> list[str]:
        """Words of a text, as strings of its normalised characters, special tokens as they are."""
        if "<|" in text and self.split_special is not None and self.split_special.search(text):
            out: list[str] = []
            for k, piece in enumerate(self.split_special.split(text)):
                out += [piece] if k % 2 else self.split_plain(piece)
            return out
        return self.split_plain(text)

    def split_plain(self, text: str) -> list[str]:
        if not _PLAIN.search(text):
            return _WORDS.findall(text.lower())
        normal = self.library.normalizer.normalize_str(text)
        back = self.unmap
        return [bytes(back[c] for c in w).decode("utf-8", "surrogateescape") for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def learn(self, docs: list[list[str]]) -> None:
        """Put the ids of all words of these documents in the cache, by one walk over the trie of the new ones."""
        new = set().union(*docs)
        if len(self.cache) + len(new) > CACHE_WORDS:
            self.cache.clear()
        if len(self.fits) > CACHE_PAIRS:
            self.fits.clear()
        new.difference_update(self.cache)
        for s in new & self.special.keys():
            self.cache[s] = np.uint32(self.special[s]).tobytes()
            new.discard(s)
        words = sorted(new)  # code points sort as their UTF-8
        self.cache.update(zip(words, self.encode_words(map(str.encode, words)), strict=True))

    def encode_docs(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text. Texts are taken in groups of about 4 MB."""
        at = 0
        while at < len(texts):
            docs, chars = [], 0
            while at < len(texts) and (not docs or chars + len(texts[at]) < 4_000_000):
                docs.append(self.split(texts[at]))
                chars += len(texts[at])
                at += 1
            self.learn(docs)
            get = self.cache.__getitem__
            for words in docs:
                yield b"".join(map(get, words))


class TokenTable:
    """The texts of a vocabulary's tokens by id."""

    def __init__(self, path: str):
        import json

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check_rules(spec, path)
        known = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.texts = [b""] * (max(known.values()) + 1)
        for t, i in known.items():
            self.texts[i] = t.encode()

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the text the library's decode gives for these ids: the vocabulary has no decoder, so tokens are joined by blanks."""
        return b" ".join(map(self.texts.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_kept: dict[tuple, TrieEncoder | TokenTable] = {}


def kept(kind: type, path: str):
    """One of a kind per worker process and vocabulary file."""
    if (kind, path) not in _kept:
        _kept[kind, path] = kind(path)
    return _kept[kind, path]


def encoder(path: str) -> TrieEncoder:
    return kept(TrieEncoder, path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit, as binary) of every whole text; no shuffle."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                texts = part.column("text").fill_null("").to_pylist()
                yield pa.record_batch([part.column("doc_id"), pa.array(enc.encode_docs(texts), pa.binary())], ["doc_id", "ids"])

    return columns_or_null(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, ids binary")


def decode(coded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and decoded (the text as the library decodes these ids)."""
    ship(coded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = kept(TokenTable, path)
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                ids = part.column("ids").fill_null(b"")
                text = pa.array((known.decode(x.as_buffer()) for x in ids), pa.binary()).cast(pa.string())
                yield pa.record_batch([part.column("doc_id"), ids, text], ["doc_id", "ids", "decoded"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded string")
