"""Compact codecs for sorted lists of integers in [0, 2^32), as Arrow column functions and as plain Python objects.

All codecs share encode and decode; names are those of the registry below. A codec works on many lists at once, as flat
values and a length for each list, so a batch of rows takes a fixed number of numpy calls; one list is a batch of one.

Byte layouts of the variable-byte family, of stream and group variable bytes, of frame of reference and of the packed
blocks (a word with the number of packed values, words of four widths, high byte first, then each block's words; blocks of
128 in four lanes, of 32 in one) follow their published forms. The patched blocks have a layout of their own: width and
number of exceptions in one word before each block, and two words for each exception after it.

``select`` and ``lower_bound`` read encoded lists piece by piece, no further than they must; frames and copies are read
at the places in question only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column
from pyspark.sql import functions as F

LIMIT = 1 << 32
#: About this many values are decoded at a time by ``select`` and ``lower_bound``.
PIECE = 2048


def _checked(xs: Sequence[int] | np.ndarray) -> np.ndarray:
    out = np.asarray(xs, np.int64)
    if len(out) and (out.min() < 0 or out.max() >= LIMIT):
        raise ValueError("values must be in [0, 2^32)")
    return out


# Lists side by side: ``sizes`` are their lengths.
def starts_of(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def ramp(sizes: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... anew for each list."""
    return np.arange(int(sizes.sum())) - np.repeat(starts_of(sizes), sizes)


def sums_of(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One sum for each list."""
    ends = np.concatenate([[0], np.cumsum(values)])
    first = starts_of(sizes)
    return ends[first + sizes] - ends[first]


def sums_before(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each value the sum of those before it in its list."""
    before = np.cumsum(values) - values
    return before - np.repeat(np.append(before, 0)[starts_of(sizes)], sizes)


def padded(sizes: np.ndarray) -> np.ndarray:
    return (sizes + 3) // 4 * 4


def bit_lengths(values: np.ndarray) -> np.ndarray:
    return np.frexp(values.astype(np.float64))[1].astype(np.int64)


def put_bits(words: np.ndarray, word: np.ndarray, shift: np.ndarray, values: np.ndarray, stride: int = 1) -> None:
    """Add each value, ``shift`` bits up, to a 32-bit word and the word ``stride`` after it; no two values share a bit."""
    wide = values.astype(np.uint64) << shift.astype(np.uint64)
    low, high = wide & np.uint64(LIMIT - 1), wide >> np.uint64(32)
    # Sums of a word stay below 2^32, so doubles hold them.
    words += np.bincount(word, low, len(words)).astype(np.uint32)
    over = np.flatnonzero(high)
    words += np.bincount(word[over] + stride, high[over], len(words)).astype(np.uint32)


def get_bits(words: np.ndarray, word: np.ndarray, shift: np.ndarray, width: np.ndarray, stride: int = 1) -> np.ndarray:
    low = words[word].astype(np.uint64)
    high = words[np.minimum(word + stride, len(words) - 1)].astype(np.uint64) if len(words) else low
    mask = (np.uint64(1) << width.astype(np.uint64)) - np.uint64(1)
    return ((low | high << np.uint64(32)) >> shift.astype(np.uint64) & mask).astype(np.int64)


def get_words(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The little-endian 32-bit words at these bytes."""
    return raw[at[:, None] + np.arange(4)].astype(np.int64) @ (1 << 8 * np.arange(4))


def set_words(raw: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
    raw[at[:, None] + np.arange(4)] = values[:, None] >> 8 * np.arange(4) & 255


def whole_words(raw: np.ndarray) -> np.ndarray:
    return np.frombuffer(raw.tobytes() + bytes(-len(raw) % 4 + 4), "<u4")


def get_bytes(raw: np.ndarray, at: np.ndarray, count: np.ndarray, bits: int = 8) -> np.ndarray:
    """Values whose groups of ``bits`` bits lie in ``count`` bytes from ``at`` on, low ones first."""
    out = np.zeros(len(at), np.int64)
    for k in range(int(count.max(initial=0))):
        more = np.flatnonzero(count > k)
        out[more] |= (raw[at[more] + k].astype(np.int64) & (1 << bits) - 1) << bits * k
    return out


def set_bytes(raw: np.ndarray, at: np.ndarray, count: np.ndarray, values: np.ndarray) -> None:
    for k in range(int(count.max(initial=0))):
        more = np.flatnonzero(count > k)
        raw[at[more] + k] = values[more] >> 8 * k & 255


def reached(following: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Marks of the places met from ``first`` on by going to the ``following`` one again and again (the last place: an end).

    Each round doubles the way that all marked places look ahead.
    """
    marks = np.zeros(len(following), bool)
    marks[first] = True
    while True:
        before = int(marks.sum())
        marks[following[marks]] = True
        if int(marks.sum()) == before:
            marks[-1] = False
            return marks
        following = following[following]


# Delta schemes: distance to the element some places before, or to the last one of the four before.
def to_deltas(xs: np.ndarray, sizes: np.ndarray, scheme: str) -> np.ndarray:
    if scheme == "none" or not len(xs):
        return xs
    place = ramp(sizes)
    back = place % 4 + 1 if scheme == "dm" else np.full(len(xs), int(scheme[1:]))
    return xs - np.where(place >= back, xs[np.arange(len(xs)) - np.minimum(back, place)], 0)


def from_deltas(ds: np.ndarray, sizes: np.ndarray, scheme: str) -> np.ndarray:
    if scheme == "none" or not len(ds):
        return ds
    if scheme == "d1":
        return sums_before(ds, sizes) + ds
    place = ramp(sizes)
    if scheme == "dm":
        return ds + sums_before(np.where(place % 4 == 3, ds, 0), sizes)
    lanes = int(scheme[1:])
    lane = np.repeat(np.arange(len(sizes)) * lanes, sizes) + place % lanes
    order = np.argsort(lane, kind="stable")
    per_lane, out = np.bincount(lane, minlength=len(sizes) * lanes), np.empty_like(ds)
    out[order] = sums_before(ds[order], per_lane) + ds[order]
    return out


class Codec:
    """Encodes sorted lists; ``delta`` codecs store differences."""

    def __init__(self, delta: str = "none"):
        self.delta = delta

    def pack(self, ds: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of lists of stored values, and how many bytes each list takes."""
        raise NotImplementedError

    def unpack(self, raw: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Stored values and the lists' sizes, from bytes and the lists' bytes."""
        raise NotImplementedError

    def pieces(self, raw: np.ndarray) -> Iterator[np.ndarray]:
        """The stored values of one list in runs; all but the last are a multiple of four long."""
        yield self.unpack(raw, np.array([len(raw)]))[0]

    def encode_lists(self, xs: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.pack(to_deltas(_checked(xs), sizes, self.delta), sizes)

    def decode_lists(self, raw: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ds, sizes = self.unpack(raw, lengths)
        return from_deltas(ds, sizes, self.delta), sizes

    def encode(self, xs: Sequence[int] | np.ndarray) -> bytes:
        return self.encode_lists(np.asarray(xs, np.int64), np.array([len(xs)]))[0].tobytes()

    def decode(self, data: bytes) -> np.ndarray:
        return self.decode_lists(np.frombuffer(data, np.uint8), np.array([len(data)]))[0]

    def runs(self, data: bytes) -> Iterator[np.ndarray]:
        """The list's elements, in the runs of ``pieces``."""
        before = np.zeros(4, np.int64)
        for ds in self.pieces(np.frombuffer(data, np.uint8)):
            xs = from_deltas(ds, np.array([len(ds)]), self.delta)
            if self.delta == "dm":
                xs = xs + before[-1]
            elif self.delta != "none":
                lanes = int(self.delta[1:])
                xs = xs + before[4 - lanes + np.arange(len(xs)) % lanes]
            yield xs
            before = xs[-4:] if len(xs) >= 4 else before

    def select(self, data: bytes, index: int) -> int:
        if index < 0:
            raise IndexError(index)
        for xs in self.runs(data):
            if index < len(xs):
                return int(xs[index])
            index -= len(xs)
        raise IndexError("the list ends before this index")

    def lower_bound(self, data: bytes, key: int) -> tuple[int, int | None]:
        """The place and value of the first element that is not below ``key``; the list's length and None where all are."""
        first = 0
        for xs in self.runs(data):
            if len(xs) and xs[-1] >= key:
                at = int(np.searchsorted(xs, key))
                return first + at, int(xs[at])
            first += len(xs)
        return first, None

    def insert(self, data: bytes, key: int) -> bytes:
        xs = self.decode(data)
        return self.encode(np.insert(xs, int(np.searchsorted(xs, key)), key))


class Direct(Codec):
    """Codecs that can read any element by itself."""

    def size(self, data: bytes) -> int:
        raise NotImplementedError

    def at(self, data: bytes, index: int) -> int:
        raise NotImplementedError

    def select(self, data: bytes, index: int) -> int:
        if not 0 <= index < self.size(data):
            raise IndexError(index)
        return self.at(data, index)

    def lower_bound(self, data: bytes, key: int) -> tuple[int, int | None]:
        low, high = 0, self.size(data)
        while low < high:
            middle = (low + high) // 2
            low, high = (middle + 1, high) if self.at(data, middle) < key else (low, middle)
        return low, self.at(data, low) if low < self.size(data) else None


class Copy(Direct):
    def pack(self, ds: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return ds.astype("<u4").view(np.uint8), 4 * sizes

    def unpack(self, raw: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(raw.tobytes(), "<u4").astype(np.int64), lengths // 4

    def size(self, data: bytes) -> int:
        return len(data) // 4

    def at(self, data: bytes, index: int) -> int:
        return int.from_bytes(data[4 * index : 4 * index + 4], "little")


class VariableByte(Codec):
    """Seven bits to a byte, low groups first. ``stop``: the high bit marks a value's last byte, else all but the last."""

    def __init__(self, stop: bool, delta: str = "d1"):
        super().__init__(delta)
        self.stop = stop

    def pack(self, ds: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count = np.maximum(1, -(-bit_lengths(ds) // 7))
        filled = sums_of(count, sizes)
        lengths = padded(filled)
        out = np.full(int(lengths.sum()), 0 if self.stop else 255, np.uint8)
        place = ramp(count)
        groups = (np.repeat(ds, count) >> 7 * place & 127).astype(np.uint8)
        groups[(place == np.repeat(count, count) - 1) == self.stop] |= 128
        out[np.repeat(starts_of(lengths), filled) + ramp(filled)] = groups
        return out, lengths

    def unpack(self, raw: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # Padding never ends a value.
        ends = np.flatnonzero((raw >= 128) == self.stop)
        owner = np.repeat(np.arange(len(lengths)), lengths)[ends]
        first = np.maximum(np.concatenate([[-1], ends[:-1]]) + 1, starts_of(lengths)[owner]) if len(ends) else ends
        return get_bytes(raw, first, ends - first + 1, 7), np.bincount(owner, minlength=len(lengths))

    def pieces(self, raw: np.ndarray) -> Iterator[np.ndarray]:
        at = 0
        while at < len(raw):
            part = raw[at : at + 5 * PIECE]
            ends = np.flatnonzero((part >= 128) == self.stop)
            if at + len(part) < len(raw):
                part = part[: ends[len(ends) // 4 * 4 - 1] + 1]
            yield self.unpack(part, np.array([len(part)]))[0]
            at += len(part)


def _byte_counts(ds: np.ndarray) -> np.ndarray:
    return np.maximum(1, -(-bit_lengths(ds) // 8))


class StreamByte(Codec):
    """Lengths of one to four bytes, two bits each, apart from the data bytes, behind the bytes that follow and the count."""

    def pack(self, ds: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count, keys = _byte_counts(ds), (sizes + 3) // 4
        lengths = 8 + keys + sums_of(count, sizes)
        first, place = starts_of(lengths), ramp(sizes)
        key_at = np.repeat(first + 8, sizes) + place // 4
        out = np.bincount(key_at, count - 1 << 2 * (place % 4), int(lengths.sum())).astype(np.uint8)
        set_words(out, first, lengths - 4)
        set_words(out, first + 4, sizes)
        set_bytes(out, np.repeat(first + 8 + keys, sizes) + sums_before(count, sizes), count, ds)
        return out, lengths

    def unpack(self, raw: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = starts_of(lengths)
        sizes = get_words(raw, first + 4)
        place = ramp(sizes)
        count = (raw[np.repeat(first + 8, sizes) + place // 4] >> 2 * (place % 4) & 3).astype(np.int64) + 1
        return get_bytes(raw, np.repeat(first + 8 + (sizes + 3) // 4, sizes) + sums_before(count, sizes), count), sizes

    def pieces(self, raw: np.ndarray) -> Iterator[np.ndarray]:
        size = int(get_words(raw, np.array([4]))[0])
        at = 8 + (size + 3) // 4
        for lo in range(0, size, PIECE):
            place = np.arange(lo, min(size, lo + PIECE))
            count = (raw[8 + place // 4] >> 2 * (place % 4) & 3).astype(np.int64) + 1
            yield get_bytes(raw, at + np.cumsum(count) - count, count)
            at += int(count.sum())


class GroupByte(Codec):
    """The count, then groups of four values behind one byte of lengths."""

    def pack(self, ds: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count = _byte_counts(ds)
        lengths = padded(4 + (sizes + 3) // 4 + sums_of(count, sizes))
        first, place = starts_of(lengths), ramp(sizes)
        at = np.repeat(first + 4, sizes) + place // 4 + 1 + sums_before(count, sizes)
        # The key of a group stands before its first value's bytes.
        key_at = at[np.arange(len(ds)) - place % 4] - 1
        out = np.bincount(key_at, count - 1 << 2 * (place % 4), int(lengths.sum())).astype(np.uint8)
        set_words(out, first, sizes)
        set_bytes(out, at, count, ds)
        return out, lengths

    def unpack(self, raw: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = starts_of(lengths)
        sizes = get_words(raw, first)
        # Any byte taken as a key leads to the byte after its group; only those met from the first key on are keys.
        codes = raw[:, None] >> 2 * np.arange(4, dtype=np.uint8) & 3
        following = np.append(np.minimum(np.arange(len(raw)) + 5 + codes.sum(1, dtype=np.int64), np.repeat(first + lengths, lengths)), len(raw))
        # A list's end is the first byte of the next one, which is a count and leads nowhere.
        following[first] = len(raw)
        marks = reached(following, first[sizes > 0] + 4)[:-1]
        marks[first] = False
        keys = np.flatnonzero(marks)
        owner = np.repeat(np.arange(len(lengths)), lengths)[keys]
        # What comes after a list's last key is padding.
        keys = keys[ramp(np.bincount(owner, minlength=len(lengths))) < ((sizes + 3) // 4)[owner]]
        place = ramp(sizes)
        key = np.repeat(keys, 4)[np.repeat(starts_of((sizes + 3) // 4) * 4, sizes) + place]
        count = codes[key, place % 4].astype(np.int64) + 1
        groups = np.bincount(np.cumsum(place % 4 == 0) - 1, minlength=len(keys)) if len(place) else np.zeros(0, np.int64)
        return get_bytes(raw, key + 1 + sums_before(count, groups), count), sizes


class EightByteGroups(Codec):
    """The count, then as many values as fit into eight data bytes behind a byte whose bits mark their last bytes."""

    def pack(self, ds: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count = _byte_counts(ds)
        ends, last = np.cumsum(count), np.repeat(starts_of(sizes) + sizes, sizes)
        # A group from a value on reaches to the first value that would be the ninth byte.
        following = np.minimum(np.searchsorted(ends, ends - count + 8, "right"), last)
        # A list's last group leads to the next list's first value, which begins a group as well.
        begins = reached(np.append(following, len(ds)), starts_of(sizes)[sizes > 0])[:-1] if len(ds) else np.zeros(0, bool)
        lengths = 4 + 9 * sums_of(begins.astype(np.int64), sizes)
        first = starts_of(lengths)
        per_group = np.diff(np.append(np.flatnonzero(begins), len(ds)))
        mark = np.repeat(first + 4, sizes) + 9 * (sums_before(begins.astype(np.int64), sizes) + begins - 1)
        inside = sums_before(count, per_group)
        out = np.bincount(mark, 1 << inside + count - 1, int(lengths.sum())).astype(np.uint8)
        set_words(out, first, sizes)
        set_bytes(out, mark + 1 + inside, count, ds)
        return out, lengths

    def unpack(self, raw: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, groups = starts_of(lengths), (lengths - 4) // 9
        marks = np.repeat(first + 4, groups) + 9 * ramp(groups)
        return self._groups(raw, marks), get_words(raw, first)

    @staticmethod
    def _groups(raw: np.ndarray, marks: np.ndarray) -> np.ndarray:
        group, end = np.nonzero(np.unpackbits(raw[marks][:, None], axis=1, bitorder="little"))
        begin = np.where(np.diff(group, prepend=-1) > 0, 0, np.concatenate([[0], end[:-1] + 1])) if len(end) else end
        return get_bytes(raw, marks[group] + 1 + begin, end - begin + 1)

    def pieces(self, raw: np.ndarray) -> Iterator[np.ndarray]:
        held = np.zeros(0, np.int64)
        for lo in range(4, len(raw), 9 * PIECE // 4):
            held = np.concatenate([held, self._groups(raw, np.arange(lo, min(len(raw), lo + 9 * PIECE // 4), 9))])
            whole = len(held) // 4 * 4
            yield held[:whole]
            held = held[whole:]
        yield held


class Frame(Direct):
    """Count, minimum and width, then offsets from the minimum; an empty list takes no bytes."""

    def pack(self, ds: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        some = sizes[sizes > 0]
        low = np.minimum.reduceat(ds, starts_of(some)) if len(some) else some
        width = bit_lengths(np.maximum.reduceat(ds, starts_of(some)) - low) if len(some) else some
        lengths = 9 + (some * width + 7) // 8
        first = starts_of(lengths)
        words = np.zeros((int(lengths.sum()) + 7) // 4, np.uint32)
        bit = np.repeat(8 * (first + 9), some) + ramp(some) * np.repeat(width, some)
        put_bits(words, bit // 32, bit % 32, ds - np.repeat(low, some))
        out = words.view(np.uint8)[: int(lengths.sum())].copy()
        set_words(out, first, some)
        set_words(out, first + 4, low)
        out[first + 8] = width
        every = np.zeros(len(sizes), np.int64)
        every[sizes > 0] = lengths
        return out, every

    def unpack(self, raw: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes, first = np.zeros(len(lengths), np.int64), starts_of(lengths)[lengths > 0]
        some = sizes[lengths > 0] = get_words(raw, first)
        width = np.repeat(raw[first + 8].astype(np.int64), some)
        bit = np.repeat(8 * (first + 9), some) + ramp(some) * width
        return get_bits(whole_words(raw), bit // 32, bit % 32, width) + np.repeat(get_words(raw, first + 4), some), sizes

    def size(self, data: bytes) -> int:
        return int.from_bytes(data[:4], "little")

    def at(self, data: bytes, index: int) -> int:
        width, first = data[8], 72 + index * data[8]
        part = int.from_bytes(data[first // 8 : (first + width + 7) // 8], "little") >> first % 8
        return int.from_bytes(data[4:8], "little") + (part & (1 << width) - 1)


class Blocks(Codec):
    """Packed blocks of one width each; what is left after the last whole group goes to a variable-byte codec.

    ``block`` values in ``lanes`` words side by side; widths stand before up to ``group`` blocks, four to a word, or,
    where ``patched``, each with the number of exceptions before its block. Headers of four lanes take four words.
    """

    PADDING = 123456

    def __init__(self, block: int, lanes: int, group: int, delta: str, least: int = 128, patched: bool = False):
        super().__init__(delta)
        self.block, self.lanes, self.group, self.least, self.patched = block, lanes, group, least, patched
        self.head = 4 if lanes == 4 and not patched else 1
        self.rest = VariableByte(True, "none")

    def _places(self, width: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word and shift of each value of blocks of these widths whose words begin at ``first``."""
        k = np.arange(self.block)
        bit = (k // self.lanes)[None, :] * width[:, None]
        return (first[:, None] + bit // 32 * self.lanes + (k % self.lanes)[None, :]).ravel(), (bit % 32).ravel()

    def _width_words(self, blocks: np.ndarray) -> np.ndarray:
        """Words of widths that stand right before each of a list's blocks (given their places in the list)."""
        return np.where(blocks % self.group == 0, self.group // 4, 0) if not self.patched else np.ones_like(blocks)

    def pack(self, ds: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        whole = sizes - sizes % self.least
        place, limit = ramp(sizes), np.repeat(whole, sizes)
        tails, tail_lengths = self.rest.pack(ds[place >= limit], sizes - whole)
        blocks = whole // self.block
        matrix = ds[place < limit].reshape(-1, self.block)
        lengths = bit_lengths(matrix)
        width = lengths.max(1, initial=0)
        odd = np.zeros(len(matrix), np.int64)
        if self.patched and len(matrix):
            # The width with the smallest block; an exception costs 64 bits; of equal ones the greater.
            above = np.stack([(lengths > w).sum(1) for w in range(33)], 1)
            cost = above * 64 + self.block * np.arange(33)
            cost[np.arange(33)[None, :] > width[:, None]] = 1 << 40
            width = 32 - cost[:, ::-1].argmin(1)
            odd = above[np.arange(len(matrix)), width]
        order = ramp(blocks)
        own = self._width_words(order) + width * self.block // 32 + 2 * odd
        words = self.head + sums_of(own, blocks)
        list_first = starts_of(words)
        first = np.repeat(list_first + self.head, blocks) + sums_before(own, blocks) + self._width_words(order)
        out = np.zeros(int(words.sum()) + self.lanes, np.uint32)
        out[list_first] = whole
        for k in range(1, self.head):
            out[list_first + k] = self.PADDING
        word, shift = self._places(width, first)
        values = matrix & ((1 << width) - 1)[:, None]
        used = np.repeat(width, self.block) > 0
        put_bits(out, word[used], shift[used], values.ravel()[used], self.lanes)
        if self.patched:
            out[first - 1] = width | odd << 8
            row, k = np.nonzero(lengths > width[:, None])
            at = np.repeat(first + width * self.block // 32, odd) + 2 * ramp(odd)
            out[at], out[at + 1] = k, matrix[row, k] >> width[row]
        else:
            begin = np.repeat((first - self._width_words(order))[order % self.group == 0], np.bincount(np.cumsum(order % self.group == 0) - 1) if len(order) else order)
            inside = order % self.group
            put_bits(out, begin + inside // 4, 8 * (3 - inside % 4), width)
        packed, bytes_ = out[: int(words.sum())].view(np.uint8), 4 * words
        total = bytes_ + tail_lengths
        both, to = np.zeros(int(total.sum()), np.uint8), starts_of(total)
        both[np.repeat(to, bytes_) + ramp(bytes_)] = packed
        both[np.repeat(to + bytes_, tail_lengths) + ramp(tail_lengths)] = tails
        return both, total

    def _headers(self, words: np.ndarray, at: int, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Width, number of exceptions and first word of ``count`` blocks whose headers begin at word ``at``; the word after them."""
        if not self.patched:
            inside = np.arange(count)
            width = (words[at + inside // 4] >> (8 * (3 - inside % 4)).astype(np.uint32) & 255).astype(np.int64)
            own = width * self.block // 32
            return width, np.zeros(count, np.int64), at + self.group // 4 + np.cumsum(own) - own, at + self.group // 4 + int(own.sum())
        found = []
        for _ in range(count):
            word = int(words[at])
            found.append((word & 255, word >> 8, at + 1))
            at += 1 + (word & 255) * self.block // 32 + 2 * (word >> 8)
        width, odd, first = np.array(found, np.int64).reshape(-1, 3).T
        return width, odd, first, at

    def _values(self, words: np.ndarray, width: np.ndarray, odd: np.ndarray, first: np.ndarray) -> np.ndarray:
        word, shift = self._places(width, first)
        wide = np.repeat(width, self.block)
        # Blocks of width 0 have no words.
        out = np.where(wide > 0, get_bits(words, np.minimum(word, len(words) - 1), shift, wide, self.lanes), 0)
        if odd.any():
            at = np.repeat(first + width * self.block // 32, odd) + 2 * ramp(odd)
            row = np.repeat(np.arange(len(odd)), odd)
            out[row * self.block + words[at]] |= words[at + 1].astype(np.int64) << width[row]
        return out

    def unpack(self, raw: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = starts_of(lengths)
        words = whole_words(raw)
        whole = words[first // 4].astype(np.int64)
        headers, ends = [], first + 4 * self.head
        # Where a group of blocks begins depends on the widths before it.
        for k in np.flatnonzero(whole).tolist():
            at, left = int(ends[k]) // 4, int(whole[k]) // self.block
            while left:
                *found, at = self._headers(words, at, min(left, self.group))
                headers.append(found)
                left -= len(found[0])
            ends[k] = 4 * at
        blocks = self._values(words, *(np.concatenate(x) for x in zip(*headers, strict=True))) if headers else np.zeros(0, np.int64)
        tail_lengths = first + lengths - ends
        tails, tail_sizes = self.rest.unpack(raw[np.repeat(ends, tail_lengths) + ramp(tail_lengths)], tail_lengths)
        sizes = whole + tail_sizes
        out, begin = np.empty(int(sizes.sum()), np.int64), starts_of(sizes)
        out[np.repeat(begin, whole) + ramp(whole)] = blocks
        out[np.repeat(begin + whole, tail_sizes) + ramp(tail_sizes)] = tails
        return out, sizes

    def pieces(self, raw: np.ndarray) -> Iterator[np.ndarray]:
        words, at = whole_words(raw), self.head
        left = int(words[0]) // self.block
        while left:
            count = min(left, self.group)
            width, odd, first, at = self._headers(words, at, count)
            yield self._values(words, width, odd, first)
            left -= count
        yield from self.rest.pieces(raw[4 * at :])


def _packed(delta: str) -> Blocks:
    return Blocks(128, 4, 16, delta)


def _patched(delta: str) -> Blocks:
    return Blocks(128, 4, 16, delta, patched=True)


CODECS: dict[str, Codec] = {
    "copy": Copy(), "varint": VariableByte(True), "vbyte": VariableByte(False), "maskedvbyte": VariableByte(False), "streamvbyte": StreamByte("d1"),
    "varintgb": GroupByte("d1"), "varintg8iu": EightByteGroups("d1"), "frameofreference": Frame(), "simdframeofreference": Frame(), "for": Frame(),
    "bp32": Blocks(32, 1, 4, "d1"), "ibp32": Blocks(32, 1, 4, "d1"), "fastpfor": _patched("d1"),
    **{f"s4-fastpfor-{d}": _patched(d) for d in ("d1", "d2", "d4", "dm")},
    **{f"s4-bp128-{d}": _packed(d) for d in ("d1", "d2", "d4", "dm")},
    **{f"s4-bp128-{d}-ni": _packed(d) for d in ("d1", "d2", "d4")},
}
DEFAULT = "s4-bp128-dm"
#: Lists up to this length are stored as they are.
THRESHOLD = 64


def all_names() -> list[str]:
    return sorted(CODECS)


def is_valid(name: str) -> bool:
    return name in CODECS


def get(name: str) -> Codec:
    if name not in CODECS:
        raise KeyError(f"no codec {name}; there are {', '.join(all_names())}")
    return CODECS[name]


def compress(xs: Sequence[int] | np.ndarray, name: str = DEFAULT, threshold: int = THRESHOLD) -> bytes:
    """A marked blob: short lists, and those that would not get smaller, are stored as they are."""
    raw = get("copy").encode(xs)
    coded = get(name).encode(xs) if len(raw) > 4 * threshold else raw
    return b"\x01" + coded if len(coded) < len(raw) else b"\x00" + raw


def decompress(blob: bytes, name: str = DEFAULT) -> np.ndarray:
    return get(name if blob[0] else "copy").decode(blob[1:])


# Column functions; a null list or blob gives null.
def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and sizes of lists none of which is null."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)


def _blobs(raw: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    data, ends = raw.tobytes(), np.concatenate([[0], np.cumsum(lengths)]).tolist()
    return [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _joined(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(blobs), np.uint8), np.array([len(x) for x in blobs], np.int64)


def _at_places(found: list[bytes], column: pa.Array) -> pa.Array:
    """The blobs at the places of a column's values, nulls at the others."""
    held = iter(found)
    return pa.array([next(held) if there else None for there in column.is_valid().to_pylist()], pa.binary())


def _as_lists(xs: np.ndarray, some: np.ndarray, column: pa.Array) -> pa.Array:
    """Lists at the places of a column's values, nulls at the others."""
    there = column.is_valid().to_numpy(zero_copy_only=False)
    sizes = np.zeros(len(there), np.int64)
    sizes[there] = some
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(~there, False) if column.null_count else None), pa.array(xs, pa.int64()))


def encode(xs: Column | str, name: str = DEFAULT) -> Column:
    codec = get(name)

    def run(lists: pa.Array) -> pa.Array:
        return _at_places(_blobs(*codec.encode_lists(*_flat(lists.drop_null()))), lists)

    return F.arrow_udf(run, "binary")(xs)


def decode(data: Column | str, name: str = DEFAULT) -> Column:
    codec = get(name)

    def run(blobs: pa.Array) -> pa.Array:
        return _as_lists(*codec.decode_lists(*_joined(blobs.drop_null().to_pylist())), blobs)

    return F.arrow_udf(run, "array<long>")(data)


def encode_marked(xs: Column | str, name: str = DEFAULT, threshold: int = THRESHOLD) -> Column:
    """``compress`` of a column of lists."""
    codec, plain = get(name), get("copy")

    def run(lists: pa.Array) -> pa.Array:
        values, sizes = _flat(lists.drop_null())
        tried = sizes > threshold
        coded = iter(_blobs(*codec.encode_lists(values[np.repeat(tried, sizes)], sizes[tried])))
        found = []
        for raw, is_tried in zip(_blobs(*plain.encode_lists(values, sizes)), tried.tolist(), strict=True):
            blob = next(coded) if is_tried else raw
            found.append(b"\x01" + blob if len(blob) < len(raw) else b"\x00" + raw)
        return _at_places(found, lists)

    return F.arrow_udf(run, "binary")(xs)


def decode_marked(data: Column | str, name: str = DEFAULT) -> Column:
    """``decompress`` of a column of blobs."""
    codecs = get("copy"), get(name)

    def run(blobs: pa.Array) -> pa.Array:
        present = blobs.drop_null().to_pylist()
        marks = np.array([x[0] for x in present], np.int64)
        parts = [codec.decode_lists(*_joined([x[1:] for x in present if x[0] == mark])) for mark, codec in enumerate(codecs)]
        sizes = np.zeros(len(present), np.int64)
        for mark in (0, 1):
            sizes[marks == mark] = parts[mark][1]
        out = np.empty(int(sizes.sum()), np.int64)
        for mark in (0, 1):
            out[np.repeat(marks == mark, sizes)] = parts[mark][0]
        return _as_lists(out, sizes, blobs)

    return F.arrow_udf(run, "array<long>")(data)


def select_encoded(data: Column | str, index: int, name: str = DEFAULT) -> Column:
    """The element at ``index`` of each encoded list, null where the list is shorter."""
    codec = get(name)

    def one(blob: bytes | None) -> int | None:
        try:
            return None if blob is None else codec.select(blob, index)
        except IndexError:
            return None

    def run(blobs: pa.Array) -> pa.Array:
        return pa.array([one(x) for x in blobs.to_pylist()], pa.int64())

    return F.arrow_udf(run, "long")(data)


def lower_bound_encoded(data: Column | str, key: int, name: str = DEFAULT) -> Column:
    """position and value of each encoded list's first element that is not below ``key``."""
    codec = get(name)
    kind = pa.struct([("position", pa.int64()), ("value", pa.int64())])

    def run(blobs: pa.Array) -> pa.Array:
        found = [None if x is None else codec.lower_bound(x, key) for x in blobs.to_pylist()]
        return pa.array([None if x is None else {"position": x[0], "value": x[1]} for x in found], kind)

    return F.arrow_udf(run, "position long, value long")(data)


def bits_per_integer(data: Column, xs: Column) -> Column:
    return F.octet_length(data) * 8.0 / F.size(xs)
