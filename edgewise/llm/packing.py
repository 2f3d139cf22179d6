"""Cost-balanced packing of documents into training sequences.

The cost of a document in a sequence is estimated as linear plus quadratic attention work. Within a group of documents,
in descending order, each goes to the lowest-cost sequence that has token capacity left; where it is longer than what is
left, it is cut there and its rest goes on in the same way. A group has as many sequences as its tokens fill, so all are
full but for the last tokens, which are cut into sequences whose lengths are powers of two: nothing is padded.

A group is what one task reads in a row, up to ``GROUP_TOKENS``. There is no shuffle, and a lost task makes the same
pieces again. Sequence ids count from ``partition << 33`` on.

Defined cases: a null or empty text is a document of the end id alone; a very long text is cut into as many pieces as it
needs, in a group that ends after it; an empty table gives no rows; repeated rows are packed once each; documents of
equal cost go in order of doc_id, then of their place in the input; other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .chunks import word_level_cache
from .common import id_and_text

SEQUENCE_TOKENS = 2048
GROUP_TOKENS = 1 << 21
END_ID = 1
#: Attention work of a token with itself against work that each token needs once.
QUADRATIC = 1.0 / 1024


def cost(tokens: int) -> float:
    return tokens + QUADRATIC * tokens * tokens


def assign(lengths: list[int], size: int = SEQUENCE_TOKENS) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document's index, start, length, sequence, offset) for documents of these lengths."""
    total = sum(lengths)
    full, rest = divmod(total, size)
    capacity = [size] * full + [1 << k for k in range(size.bit_length() - 1, -1, -1) if rest >> k & 1]
    filled = [0] * len(capacity)
    heap = [(0.0, k) for k in range(len(capacity))]
    pieces = []
    for index in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        start = 0
        while start < lengths[index]:
            spent, k = heapq.heappop(heap)
            length = min(lengths[index] - start, capacity[k] - filled[k])
            pieces.append((index, start, length, k, filled[k]))
            filled[k] += length
            start += length
            if filled[k] < capacity[k]:
                heapq.heappush(heap, (spent + cost(length), k))
    return pieces


_SCHEMA = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [("ids", pa.binary())])


def pack(docs: DataFrame, vocabulary: str, with_ids: bool = False) -> DataFrame:
    """One row per piece; ``with_ids`` adds the ids themselves, as little-endian unsigned 32-bit integers."""

    def rows(group: list[tuple[int, bytes]], first: int) -> tuple[pa.RecordBatch, int]:
        group.sort(key=lambda x: (x[0] is None, x[0]))
        pieces = assign([len(ids) // 4 for _, ids in group])
        out = []
        for index, start, length, k, offset in pieces:
            doc_id, ids = group[index]
            part = ids[4 * start : 4 * (start + length)]
            out.append((doc_id, start, length, zlib.crc32(part), len(ids) // 4, first + k, offset, part if with_ids else None))
        columns = list(zip(*out, strict=True))
        fields = list(_SCHEMA)[: None if with_ids else -1]
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=False)], schema=pa.schema(fields))
        return batch, first + 1 + max(p[3] for p in pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, end = word_level_cache(vocabulary), END_ID.to_bytes(4, "little")
        context = TaskContext.get()
        first, group, tokens = (context.partitionId() if context else 0) << 33, [], 0
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for doc_id, encoded in zip(ids, cache.encode(batch.column(1)), strict=True):
                group.append((doc_id, encoded + end))
                tokens += len(encoded) // 4 + 1
                if tokens >= GROUP_TOKENS:
                    out, first = rows(group, first)
                    yield out
                    group, tokens = [], 0
        if group:
            yield rows(group, first)[0]

    ddl = ", ".join(f"{f.name} long" for f in list(_SCHEMA)[:-1]) + (", ids binary" if with_ids else "")
    return id_and_text(docs).mapInArrow(run, ddl)
