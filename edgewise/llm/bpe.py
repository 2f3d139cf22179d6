"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

A text is cut by the vocabulary's split pattern. Within a piece, the tree's leaves hold ``rank * width + position`` of
the pair that begins at each live position, so the root is the leftmost pair of lowest rank. A merge links its
neighbours together and updates the points whose pairs it changed, each along one path to the root, until no leaf holds a
pair that can merge. Pieces of like length go through these steps side by side, as rows of one numpy array; long pieces,
of which there are few, go one by one, with the tree in a list.

Defined cases: a null or empty text has no ids and decodes to an empty text; strings of special tokens become their ids,
as in the library's default; very long texts are encoded whole, and a piece of n bytes takes n log n steps; of equal ranks
the leftmost pair merges; an empty table gives no rows; repeated rows get equal rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .chunks import BARE, ChunkCache, at_blanks, byte_symbols, chunk_of
from .common import id_and_text

#: Fixed value: how byte-level vocabularies of this kind split a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Of long pieces so many are merged side by side at least; fewer are merged one by one.
FEW_ROWS = 64
_NONE = np.iinfo(np.int64).max


class ByteBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocabulary: dict[str, int] = spec["model"]["vocab"]
        symbols = byte_symbols()
        of = {s: b for b, s in enumerate(symbols)}
        self.byte_ids = np.array([vocabulary[s] for s in symbols], np.int64)
        self.bytes_of = {i: bytes(map(of.__getitem__, token)) for token, i in vocabulary.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of |= {i: content.encode() for content, i in self.special.items()}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        keys = np.array([vocabulary[a] << 32 | vocabulary[b] for a, b in pairs], np.int64)
        merged = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.merged = keys[order], order.astype(np.int64), merged
        self.pattern = regex.compile(PATTERN)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.pieces: dict[bytes, bytes] = {}
        self.cache = ChunkCache(at_blanks, lambda keys: self._encode_chunks(list(map(chunk_of, keys))), self._encode_whole, list(self.special), BARE)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; _NONE where a pair does not merge."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def _merge_rows(self, rows: list[bytes], width: int) -> list[bytes]:
        """Encode pieces of at most ``width`` bytes, a power of two."""
        n = len(rows)
        lengths = np.fromiter(map(len, rows), np.int64, n)
        grid = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), np.uint8).reshape(n, width)
        symbols = self.byte_ids[grid]
        place = np.arange(width, dtype=np.int64)
        tree = np.full((n, 2 * width), _NONE, np.int64)
        if width > 1:
            rank = self._rank(symbols[:, :-1], symbols[:, 1:])
            live = (rank != _NONE) & (place[1:] < lengths[:, None])
            tree[:, width : 2 * width - 1] = np.where(live, rank * width + place[:-1], _NONE)
        for k in range(width - 1, 0, -1):
            np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1], out=tree[:, k])
        after = np.broadcast_to(place + 1, (n, width)).copy()
        after[after >= lengths[:, None]] = width
        before = np.broadcast_to(place - 1, (n, width)).copy()
        alive = place < lengths[:, None]

        def update(rows_at: np.ndarray, places: np.ndarray, values: np.ndarray) -> None:
            node = places + width
            tree[rows_at, node] = values
            while node[0] > 1:
                node = node >> 1
                tree[rows_at, node] = np.minimum(tree[rows_at, 2 * node], tree[rows_at, 2 * node + 1])

        def pair_value(rows_at: np.ndarray, left: np.ndarray) -> np.ndarray:
            right = after[rows_at, left]
            inside = right < width
            rank = self._rank(symbols[rows_at, left], symbols[rows_at, np.minimum(right, width - 1)])
            good = inside & (rank != _NONE)
            return np.where(good, np.where(good, rank, 0) * width + left, _NONE)

        todo = np.flatnonzero(tree[:, 1] != _NONE)
        while len(todo):
            root = tree[todo, 1]
            left = root % width
            right = after[todo, left]
            symbols[todo, left] = self.merged[root // width]
            alive[todo, right] = False
            beyond = after[todo, right]
            after[todo, left] = beyond
            linked = beyond < width
            before[todo[linked], beyond[linked]] = left[linked]
            update(todo, right, np.full(len(todo), _NONE, np.int64))
            update(todo, left, pair_value(todo, left))
            previous = before[todo, left]
            has = previous >= 0
            if has.any():
                update(todo[has], previous[has], pair_value(todo[has], previous[has]))
            todo = todo[tree[todo, 1] != _NONE]
        flat = symbols.astype("<u4")
        ends = np.cumsum(alive.sum(1)) * 4
        joined = flat[alive].tobytes()
        return [joined[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def _merge_one(self, piece: bytes, width: int) -> bytes:
        """The same for one long piece, with the tree in a list: a merge costs its path, not numpy calls."""
        none, table = int(_NONE), self._table()
        symbols = [int(self.byte_ids[b]) for b in piece]
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * width)

        def value(left: int) -> int:
            right = after[left]
            rank = table.get(symbols[left] << 32 | symbols[right]) if right < n else None
            return none if rank is None else rank * width + left

        def update(place: int, new: int) -> None:
            node = place + width
            tree[node] = new
            while node > 1:
                node >>= 1
                one, two = tree[2 * node], tree[2 * node + 1]
                best = one if one < two else two
                if tree[node] == best:
                    break
                tree[node] = best

        tree[width : width + n] = map(value, range(n))
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        while tree[1] != none:
            rank, left = divmod(tree[1], width)
            right = after[left]
            symbols[left] = int(self.merged[rank])
            after[left] = beyond = after[right]
            if beyond < n:
                before[beyond] = left
            update(right, none)
            update(left, value(left))
            if before[left] >= 0:
                update(before[left], value(before[left]))
        out, at = [], 0
        while at < n:
            out.append(symbols[at])
            at = after[at]
        return np.array(out, "<u4").tobytes()

    @functools.cache  # noqa: B019 - one object per vocabulary and worker
    def _table(self) -> dict[int, int]:
        return dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))

    def _encode_pieces(self, pieces: set[bytes]) -> dict[bytes, bytes]:
        by_width: dict[int, list[bytes]] = {}
        for piece in pieces:
            by_width.setdefault(1 << max(0, (len(piece) - 1).bit_length()), []).append(piece)
        out: dict[bytes, bytes] = {}
        for width, rows in by_width.items():
            if width * FEW_ROWS > 1 << 18 or (width > 256 and len(rows) < FEW_ROWS):
                out |= {row: self._merge_one(row, width) for row in rows}
                continue
            step = max(1, (1 << 18) // width)
            for lo in range(0, len(rows), step):
                out |= dict(zip(rows[lo : lo + step], self._merge_rows(rows[lo : lo + step], width), strict=True))
        return out

    def _encode_chunks(self, chunks: list[str]) -> list[bytes]:
        if len(self.pieces) > 400_000:
            self.pieces.clear()
        cuts = [[p.encode() for p in self.pattern.findall(c)] for c in chunks]
        self.pieces |= self._encode_pieces({p for cut in cuts for p in cut if p not in self.pieces})
        return [b"".join(map(self.pieces.__getitem__, cut)) for cut in cuts]

    def _encode_whole(self, text: str) -> bytes:
        parts = self.split_special.split(text) if self.split_special else [text]
        return b"".join(self.special[p].to_bytes(4, "little") if p in self.special else self._encode_chunks([p])[0] for p in parts)

    def encode(self, texts: pa.Array | list[str]) -> Iterator[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        return self.cache.encode(texts)

    def decode(self, ids: bytes) -> str:
        """The text of these ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@functools.cache
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


def bpe_round_trip(docs: DataFrame, vocabulary: str, with_ids: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256 of the text that the ids give, and with ``with_ids`` the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(vocabulary)
        for batch in batches:
            encoded = list(bpe.encode(batch.column(1)))
            columns = {
                "doc_id": batch.column(0),
                "n_tokens": pa.array([len(x) // 4 for x in encoded], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in encoded], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in encoded], pa.string()),
            }
            if with_ids:
                columns["ids"] = pa.array(encoded, pa.binary())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids)
