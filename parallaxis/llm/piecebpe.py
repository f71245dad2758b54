"""SentencePiece BPE encoding and decoding by merge rounds over flat symbol arrays.

The distinct new words of a batch lie one after the other in one array of symbols. A round finds the least rank of every
word's adjacent pairs (a segmented minimum), merges its leftmost non-overlapping occurrences in all words at once, looks up
only the pairs that touch a merged symbol, and compacts the arrays; words without a pair leave them. Rounds end when no pair
is left. One merge at a time would give the same: where a merge makes a pair that must go before the occurrences to its
right (of equal or lesser rank), those wait for a later round.

Words are cut where no piece of the vocabulary can reach across: before a run of blanks, and inside the rounds between any
two characters that no piece has side by side. So a text without blanks is many short words too.

Rows: null text counts as empty; with begin and end ids an empty text has those two. Repeated rows each have their own
result, tables without rows give none, other columns of the input take no part, whatever their names. Texts of any length
are encoded whole.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .runtime import columns_or_null, ship

SPACE = "▁"
#: Distinct words whose ids a worker keeps; the table starts anew beyond it, so memory stays bounded.
CACHE_WORDS = 400_000
#: Longer words are encoded anew wherever they stand, so that the kept ones have a bounded size.
CACHE_LETTERS = 64
#: Documents of a batch that are Python objects at a time, and about how many characters of them.
ROWS, CHARS = 1000, 4_000_000
NONE = np.int32(2**31 - 1)
#: Symbols from here on are characters that are no piece.
FOREIGN = 1 << 21
_WORDS = re.compile("▁*[^▁]+|▁+")


def one_mark_a_byte(error: UnicodeError):
    return "�", error.start + 1


codecs.register_error("one_mark_a_byte", one_mark_a_byte)


class PieceCodec:
    """Pieces, ranks and pair tables of one BPE model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        plain = [i for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if sp.normalize(" a  ﬁ\n ") != "▁▁a▁▁ﬁ\n▁" or not all(map(sp.is_byte, self.byte_ids)) or any(map(sp.is_unused, ids)):
            raise ValueError(f"{path}: not a vocabulary of unchanged texts with a leading blank and byte fallback")
        self.begin, self.end = sp.bos_id(), sp.eos_id()
        known = {sp.id_to_piece(i): i for i in plain}
        order = {s: k for k, s in enumerate(sorted({sp.get_score(i) for i in plain}, reverse=True))}
        rank = {i: order[sp.get_score(i)] for i in plain}

        chars = {ord(c): known[c] for c in known if len(c) == 1}
        pairs, sides = {}, set()
        for text, made in known.items():
            sides.update(ord(a) << 21 | ord(b) for a, b in zip(text, text[1:], strict=False))
            for cut in range(1, len(text)):
                a, b = known.get(text[:cut]), known.get(text[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = (rank[made], made)
            if any(c not in known for c in text):
                raise ValueError(f"{path}: a character of {text!r} is no piece")
            if SPACE in text.lstrip(SPACE):
                raise ValueError(f"{path}: {text!r} has a blank inside")
        self.codes = np.array(sorted(chars), np.int64)
        self.code_ids = np.array([chars[c] for c in sorted(chars)], np.int64)
        self.sides = np.array(sorted(sides), np.int64)
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in sorted(pairs)], np.int32)
        self.made = np.array([pairs[k][1] for k in sorted(pairs)], np.int64)

        #: What each id reads as; control ids read as nothing.
        self.texts = [sp.id_to_piece(i).replace(SPACE, " ").encode() if i in rank else " ⁇ ".encode() if sp.is_unknown(i) else b"" for i in ids]
        self.leads = [i in rank and self.texts[i].startswith(b" ") for i in ids]
        for b, i in enumerate(self.byte_ids):
            self.texts[i] = bytes([b])
        self.cache: dict[str, bytes] = {}
        self.block = self.blank_block(known, rank)

    def blank_block(self, known: dict[str, int], rank: dict[int, int]) -> int:
        """Length of the longest piece of blanks if long runs of blanks fall into just these from the left, else 0.

        It holds where blanks join last, all at one rank and so from the left, and no other piece begins with two."""
        runs = {len(t): i for t, i in known.items() if len(t) > 1 and not t.strip(SPACE)}
        others = [i for t, i in known.items() if len(t) > 1 and t.strip(SPACE)]
        alone = len({rank[i] for i in runs.values()}) == 1 and min(rank[i] for i in runs.values()) > max(rank[i] for i in others)
        if not runs or not alone or any(t.startswith(SPACE * 2) and t.strip(SPACE) for t in known):
            return 0
        most = max(runs)
        for n in (most, 2 * most, 3 * most):
            if not np.array_equal(np.frombuffer(self.encode_words([SPACE * n])[0], "<u4"), [runs[most]] * (n // most)):
                return 0
        return most

    @staticmethod
    def look(table: np.ndarray, values: np.ndarray, keys: np.ndarray, absent):
        """The values of keys in a sorted table."""
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return np.where(table[at] == keys, values[at], absent)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.look(self.keys, self.ranks, a << 32 | b, NONE)

    def rounds(self, code: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Symbols by the place of their first character, -1 elsewhere; code and word of each character are given."""
        out = np.full(len(code), -1, np.int64)
        sym = self.look(self.codes, self.code_ids, code, -1)
        sym = np.where(sym < 0, code + FOREIGN, sym)
        reach = np.zeros(len(code), bool)
        reach[1:] = (word[1:] == word[:-1]) & (self.look(self.sides, self.sides, code[:-1] << 21 | code[1:], -1) >= 0)
        seg = np.cumsum(~reach)
        pos = np.arange(len(code))
        inside = np.append(seg[1:] == seg[:-1], False)
        rank = np.full(len(code), NONE)
        at = np.flatnonzero(inside)
        rank[at] = self.pair_ranks(sym[at], sym[at + 1])
        while len(sym):
            first = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
            size = np.diff(np.append(first, len(seg)))
            least = np.minimum.reduceat(rank, first)
            live = least < NONE
            if not live.all():
                stays = np.repeat(live, size)
                out[pos[~stays]] = sym[~stays]
                sym, seg, pos, rank = sym[stays], seg[stays], pos[stays], rank[stays]
                if not len(sym):
                    break
                size, least = size[live], least[live]
            hits = np.flatnonzero(rank == np.repeat(least, size))
            # of pairs that overlap, every second one from the left
            begins = np.flatnonzero(np.append(True, (hits[1:] != hits[:-1] + 1) | (seg[hits[1:]] != seg[hits[:-1]])))
            hits = hits[(np.arange(len(hits)) - np.repeat(begins, np.diff(np.append(begins, len(hits))))) % 2 == 0]
            made = self.look(self.keys, self.made, sym[hits] << 32 | sym[hits + 1], -1)
            own = rank[hits]
            # pairs that each merge makes while all to its right still wait
            before, after = hits - 1, hits + 2
            left = np.where(before >= 0, sym[before], -1)
            follows = np.append(False, (hits[1:] - 2 == hits[:-1])) if len(hits) else np.zeros(0, bool)
            left[follows] = made[:-1][follows[1:]]
            has_left = (before >= 0) & (seg[before] == seg[hits])
            nxt = np.minimum(after, len(sym) - 1)
            has_right = (after < len(sym)) & (seg[nxt] == seg[hits])
            l_rank = np.where(has_left, self.pair_ranks(np.maximum(left, 0), made), NONE)
            r_rank = np.where(has_right, self.pair_ranks(made, sym[nxt]), NONE)
            early = (l_rank <= own) | (r_rank <= own)
            if early.any():
                # merges to the right of an early pair wait
                turns = np.cumsum(early) - early
                starts = np.flatnonzero(np.append(True, seg[hits[1:]] != seg[hits[:-1]]))
                base = np.repeat(turns[starts], np.diff(np.append(starts, len(hits))))
                goes = turns == base
                hits, made = hits[goes], made[goes]
            sym[hits] = made
            stays = np.ones(len(sym), bool)
            stays[hits + 1] = False
            where = np.cumsum(stays) - 1
            sym, seg, pos, rank = sym[stays], seg[stays], pos[stays], rank[stays]
            new = where[hits]
            touched = np.concatenate([new, new[new > 0] - 1])
            ends = np.minimum(touched + 1, len(sym) - 1)
            joined = (touched + 1 < len(sym)) & (seg[ends] == seg[touched])
            rank[touched] = np.where(joined, self.pair_ranks(sym[touched], sym[ends]), NONE)
        return out

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each word (▁ for blanks)."""
        code = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        sizes = np.array([len(w) for w in words])
        word = np.repeat(np.arange(len(words)), sizes)
        out = self.rounds(code, word)
        there = out >= 0
        sym, word = out[there], word[there]
        foreign = np.flatnonzero(sym >= FOREIGN)
        if len(foreign):
            kinds, which = np.unique(sym[foreign], return_inverse=True)
            spelt = [[self.byte_ids[b] for b in chr(k - FOREIGN).encode()] for k in kinds.tolist()]
            length = np.ones(len(sym), np.int64)
            length[foreign] = np.array([len(s) for s in spelt])[which]
            start = np.cumsum(length) - length
            wide = np.repeat(sym, length)
            letters = np.zeros((len(spelt), 4), np.int64)
            for k, s in enumerate(spelt):
                letters[k, : len(s)] = s
            for k in range(4):
                has = length[foreign] > k
                wide[start[foreign[has]] + k] = letters[which[has], k]
            sym, word = wide, np.repeat(word, length)
        ends = np.searchsorted(word, np.arange(len(words)), side="right").tolist()
        raw = sym.astype("<u4").tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def words(self, text: str) -> list[str]:
        """The words of a text: a run of blanks goes with the letters after it; whole blocks of a long run stand alone."""
        if not text:
            return []
        found = _WORDS.findall(SPACE + text.replace(" ", SPACE))
        if self.block and SPACE * (self.block + 1) in text.replace(" ", SPACE):
            out: list[str] = []
            for w in found:
                blocks = (len(w) - len(w.lstrip(SPACE)) - 1) // self.block
                if blocks > 0:
                    out += [SPACE * self.block] * blocks
                    w = w[blocks * self.block :]
                out.append(w)
            return out
        return found

    def encode_docs(self, texts: list[str], ends: bool = True) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text, with begin and end ids."""
        opens, closes = (np.uint32(i).tobytes() if ends else b"" for i in (self.begin, self.end))
        at = 0
        while at < len(texts):
            docs, chars = [], 0
            while at < len(texts) and (not docs or chars + len(texts[at]) < CHARS):
                docs.append(self.words(texts[at]))
                chars += len(texts[at])
                at += 1
            new = set().union(*docs)
            if len(self.cache) + len(new) > CACHE_WORDS:
                self.cache.clear()
            new.difference_update(self.cache)
            fresh = sorted(new)
            known = dict(zip(fresh, self.encode_words(fresh), strict=True)) if fresh else {}
            self.cache.update(known)
            get = self.cache.__getitem__
            for own in docs:
                yield b"".join([opens, *map(get, own), closes])
            for w in fresh:
                if len(w) > CACHE_LETTERS:
                    del self.cache[w]

    def decode(self, ids: bytes) -> str:
        """The text of these ids: the blank that encoding adds goes, each byte that is no UTF-8 is U+FFFD."""
        read = np.frombuffer(ids, "<u4").tolist()
        text = b"".join(map(self.texts.__getitem__, read)).decode("utf-8", "one_mark_a_byte")
        first = next((i for i in read if self.texts[i]), 0)
        return text[1:] if self.leads[first] else text


_kept: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    """One per worker process and model file."""
    if path not in _kept:
        _kept[path] = PieceCodec(path)
    return _kept[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit, as binary, with begin and end) of every whole text; no shuffle."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = codec(path)
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                texts = part.column("text").fill_null("").to_pylist()
                yield pa.record_batch([part.column("doc_id"), pa.array(known.encode_docs(texts), pa.binary())], ["doc_id", "ids"])

    return columns_or_null(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, ids binary")


def decode(coded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and decoded, the text of these ids; null ids read as an empty text."""
    ship(coded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = codec(path)
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                ids = part.column("ids").fill_null(b"")
                text = pa.array((known.decode(x.as_buffer()) for x in ids), pa.string())
                yield pa.record_batch([part.column("doc_id"), ids, text], ["doc_id", "ids", "decoded"])

    return columns_or_null(coded, doc_id="long", ids="binary").mapInArrow(run, "doc_id long, ids binary, decoded string")
