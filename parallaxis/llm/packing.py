"""Bounded-space online packing of token ids into fixed windows.

Each partition keeps a fixed number of open windows. A document's full windows go out at once; what remains goes to the
open window that it fits best. If none has room and no more may be opened, the fullest is filled with a first part of it
and emitted. Windows left open at the end of all partitions are merged in groups of bounded size: their pieces are laid
end to end into full windows, and the last rest of a group is cut at powers of two, which need no padding.

Rows: null text counts as empty and has only the closing id; a null doc_id is kept; repeated rows are packed as often
as they come; an empty table gives no pieces. Other columns take no part.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import columns_or_null, materialize, ship

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
NAMES = [x.split()[0] for x in PIECES.split(", ")]
#: Tokens that one merging task takes, and where its sequence numbers begin.
MERGE_TOKENS = 250_000
MERGED_IDS = 1 << 62

_codecs: dict = {}


def codec(json_path: str, ranks_path: str | None):
    """Text to ids as the tokenizers library gives them: by the same vocabulary's ranks where given, else by that library."""
    key = (json_path, ranks_path)
    if key not in _codecs:
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(json_path)
        plain = lambda texts: [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
        if ranks_path is None:
            _codecs[key] = plain
        else:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            special = {t.content: i for i, t in library.get_added_tokens_decoder().items()}
            fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

            def encode(texts: list[str]) -> list:
                try:
                    return [np.frombuffer(fast.encode_to_numpy(x, allowed_special="all"), np.uint32) for x in texts]
                except ValueError:  # its pattern engine gives up on some very long runs
                    return plain(texts)

            _codecs[key] = encode
    return _codecs[key]


class Packer:
    """Best fit into at most `most` open windows of `size` tokens. Pieces are (doc_id, start, ids, doc_tokens)."""

    def __init__(self, size: int, most: int, first_id: int):
        self.size, self.most, self.next = size, most, first_id
        self.open: list[tuple[int, int]] = []  # (free, window), sorted
        self.pieces: dict[int, list[tuple]] = {}

    def window(self) -> int:
        self.next += 1
        return self.next - 1

    def put(self, window: int, free: int, piece: tuple) -> list[tuple[int, list[tuple]]]:
        """Lay a piece into a window with so much room; the window, if that fills it."""
        held = self.pieces.setdefault(window, [])
        held.append(piece)
        if free == len(piece[2]):
            return [(window, self.pieces.pop(window))]
        insort(self.open, (free - len(piece[2]), window))
        return []

    def add(self, doc_id: int, ids: np.ndarray) -> list[tuple[int, list[tuple]]]:
        """Windows that this document completes."""
        total, at, out = len(ids), 0, []
        while total - at >= self.size:
            out += self.put(self.window(), self.size, (doc_id, at, ids[at : at + self.size], total))
            at += self.size
        while at < total:
            left = total - at
            k = bisect_left(self.open, (left, -1))
            if k < len(self.open):
                free, window = self.open.pop(k)
            elif len(self.open) < self.most:
                free, window = self.size, self.window()
            else:
                free, window = self.open.pop(0)
            n = min(left, free)
            out += self.put(window, free, (doc_id, at, ids[at : at + n], total))
            at += n
        return out


def rows(windows: list[tuple[int, list[tuple]]]) -> list[tuple]:
    out = []
    for window, pieces in windows:
        offset = 0
        for doc_id, start, ids, total in pieces:
            out.append((doc_id, start, len(ids), ids.astype("<u4").tobytes(), total, window, offset))
            offset += len(ids)
    return out


KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]


def batch_of(found: list[tuple], more: dict | None = None) -> pa.RecordBatch:
    columns = list(zip(*found, strict=True)) or [[] for _ in NAMES]
    arrays = [pa.array(c, k) for c, k in zip(columns, KINDS, strict=True)]
    return pa.record_batch([*arrays, *(more or {}).values()], [*NAMES, *(more or {})])


def pack(docs: DataFrame, json_path: str, ranks_path: str | None = None, size: int = 1024, open_windows: int = 64, end_id: int = 0) -> DataFrame:
    """Pieces of all documents with their ids (little-endian unsigned 32-bit), sequence and offset in it."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = codec(json_path, ranks_path)
        packer = Packer(size, open_windows, TaskContext.get().partitionId() << 32)
        out = lambda found, left: batch_of(found, {"left": pa.array([left] * len(found), pa.bool_())})
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                done = []
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), encode(part.column("text").fill_null("").to_pylist()), strict=True):
                    done += packer.add(doc_id, np.append(np.asarray(ids, np.uint32), np.uint32(end_id)))
                yield out(rows(done), False)
        yield out(rows(list(packer.pieces.items())), True)

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        pieces = sorted(zip(*(table.column(c).to_pylist() for c in ("sequence_id", "offset", "doc_id", "start", "ids", "doc_tokens")), strict=True))
        sizes = np.zeros(0, np.int64)
        total = sum(len(p[4]) // 4 for p in pieces)
        rest = total % size
        sizes = [size] * (total // size) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]
        ends = np.cumsum(sizes)
        out, at, k = [], 0, 0
        for _, _, doc_id, start, ids, doc_tokens in pieces:
            done = 0
            while done < len(ids) // 4:
                n = int(min(len(ids) // 4 - done, ends[k] - at))
                out.append((doc_id, start + done, n, ids[4 * done : 4 * (done + n)], doc_tokens, MERGED_IDS + (key[0].as_py() << 32) + k, at - int(ends[k]) + sizes[k]))
                done, at = done + n, at + n
                k += at == ends[k]
        return pa.Table.from_batches([batch_of(out)])

    docs = columns_or_null(docs, doc_id="long", text="string")
    placed = materialize(docs.mapInArrow(run, PIECES + ", left boolean"), "pieces")
    left = placed.where("left").drop("left")
    tokens = left.agg(F.sum("length")).first()[0] or 0
    groups = -(-tokens // MERGE_TOKENS) or 1
    # whole windows stay together; their numbers spread them evenly
    merged = left.withColumn("part", F.pmod(F.xxhash64("sequence_id"), F.lit(groups))).groupBy("part").applyInArrow(merge, PIECES)
    return placed.where("not left").drop("left").unionByName(merged)
