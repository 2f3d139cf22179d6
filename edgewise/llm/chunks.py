"""Cutting texts at white space so that each distinct chunk is tokenized once per worker.

Both tokenizer files split a text before they merge, and no merge crosses such a split. Chunks that end at splits can
thus be encoded apart and their ids joined. Texts where that could be wrong (runs of white space or white space other
than blanks and line feeds, whose places decide splits; strings of special tokens) are encoded in one piece.

Texts are taken in slices of bounded size. Arrow splits a slice and numbers its distinct chunks, so Python sees each chunk
once a slice, and the library each word once as long as it is remembered; Arrow then deals the ids out to the places.
"""

from __future__ import annotations

import array
import functools
import json
import os
import re
import string
import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
#: White space inside a chunk.
INNER_SPACE = re.compile(r"[ \t\r\x0b\x0c\n]", re.ASCII)
#: What may end a chunk and is split from the letters before it: ASCII punctuation but for the apostrophe, which begins contractions.
ENDS = string.punctuation.replace("'", "")
#: Up to here letters are Latin ones without doubt, in every version of the character tables.
LAST_LETTER = "\u012f"
_END = f"(?P<end>[{re.escape(ENDS)}]+)$"
_WORD_AND_END = f"[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-{LAST_LETTER}]{_END}"
#: Begins the key of a chunk that has no white space before it.
BARE = "\x00"
#: Words that one worker remembers, about 230 bytes each, by generations: the one before stays for words that come again.
REMEMBERED = 250_000
#: Bytes of text that are cut at once.
SLICE_BYTES = 1 << 23


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Consecutive parts of about ``most`` bytes; a longer text is a part of its own."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    lo = 0
    while lo < len(texts):
        done = int(ends[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, done + most, "right")))
        yield texts.slice(lo, hi - lo)
        lo = hi


def at_blanks(texts: pa.Array) -> pa.Array:
    """Keys of chunks: a word after a blank is its own key, one after a line feed keeps the line feed, the first follows BARE."""
    return pc.split_pattern(pc.binary_join_element_wise(BARE, pc.replace_substring(texts, "\n", " \n"), ""), " ")


def at_white_space(texts: pa.Array) -> pa.Array:
    """Keys of chunks where white space does not count: words between ASCII white space, A-Z as a-z."""
    return pc.ascii_split_whitespace(pc.ascii_lower(texts))


def as_list(strings: pa.Array) -> list[str]:
    """A list of Python strings, several times faster than one by one."""
    return strings.to_numpy(zero_copy_only=False).tolist()


class ChunkCache:
    """Texts to ids (bytes of little-endian unsigned 32-bit integers), by chunks.

    A chunk that ends in punctuation after a plain Latin letter splits there, so words share their ids with or without
    such an end; a line feed before a word splits from it likewise.
    """

    def __init__(self, cut: Callable, encode_many: Callable[[list[str]], list[bytes]], whole: Callable[[str], bytes], specials: Sequence[str], bare: str):
        self.cut, self.encode_many, self.whole, self.bare = cut, encode_many, whole, bare
        #: Texts that hold one of these are encoded in one piece; in a key, BARE must be what ``cut`` put there.
        self.apart = [s.lower() for s in specials] + [bare] * bool(bare)
        self.feed = whole("\n")
        self.always = {bare: b""}
        self.known: dict[str, bytes | bool] = dict(self.always)
        self.old: dict[str, bytes | bool] = {}

    def _unsafe(self, key: str) -> bool:
        """Whether the ids could depend on what stands around the chunk."""
        return not key.strip("\n") or (not key.isprintable() and bool(INNER_SPACE.search(key, 1) or OTHER_SPACE.search(key)))

    def _learn(self, keys: list[str]) -> None:
        known = self.known
        plain = [k for k in keys if k.isalpha()]
        rest = [k for k in keys if not k.isalpha()] if len(plain) < len(keys) else []
        plain += [k for k in rest if k[:1] != "\n" and not self._unsafe(k)]
        known.update(zip(plain, self.encode_many(plain), strict=True))
        if len(plain) < len(keys):
            known.update((k, False) for k in rest if self._unsafe(k))
            lines = [k for k in rest if k not in known]
            if lines:
                ids = self._ids([self.bare + k[1:] for k in lines])
                known.update((k, self.feed + x) for k, x in zip(lines, ids, strict=True))

    def _ids(self, keys: list[str]) -> list[bytes | bool]:
        known, old = self.known, self.old
        out = list(map(known.get, keys))
        at = [k for k, x in enumerate(out) if x is None]
        if at:
            missing = dict.fromkeys([keys[k] for k in at])
            known.update([(k, old[k]) for k in missing if k in old])
            self._learn([k for k in missing if k not in known])
            for k in at:
                out[k] = known[keys[k]]
        return out

    def _encode_slice(self, texts: pa.Array) -> Iterator[bytes]:
        if len(self.known) > REMEMBERED:
            self.old, self.known = self.known, dict(self.always)
        words = self.cut(texts)
        starts = words.offsets.to_numpy() - words.offsets[0].as_py()
        coded = words.flatten().dictionary_encode()
        # Ends of punctuation leave their words, and both are looked up apart.
        ended = pc.match_substring_regex(coded.dictionary, _WORD_AND_END)
        ids = self._ids(as_list(pc.if_else(ended, pc.ascii_rtrim(coded.dictionary, ENDS), coded.dictionary)))
        ends = self._ids([self.bare + x for x in as_list(pc.struct_field(pc.extract_regex(coded.dictionary.filter(ended), _END), "end"))])
        for k, x in zip(np.flatnonzero(ended.to_numpy(zero_copy_only=False)).tolist(), ends, strict=True):
            ids[k] = ids[k] and ids[k] + x
        unsafe = np.array([x is False for x in ids], bool)
        apart = np.zeros(len(texts), bool)
        if unsafe.any():
            count = np.concatenate([[0], np.cumsum(unsafe[coded.indices.to_numpy()])])[starts]
            apart = count[1:] > count[:-1]
            ids = [x or b"" for x in ids]
        lowered = pc.ascii_lower(texts)
        for string_ in self.apart:
            apart |= pc.match_substring(lowered, string_).to_numpy(zero_copy_only=False)
        joined = pa.array(ids, pa.large_binary()).take(coded.indices)
        bounds = np.frombuffer(joined.buffers()[1], np.int64)[starts].tolist() if len(joined) else [0] * len(starts)
        data = memoryview(joined.buffers()[2] or b"")
        for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            yield self.whole(texts[k].as_py()) if apart[k] else bytes(data[a:b])

    def encode(self, texts: pa.Array | list[str]) -> Iterator[bytes]:
        """The ids of each text in turn; only one slice is held at a time."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        for part in slices(texts):
            yield from self._encode_slice(part)


@functools.cache
def library(path: str):
    """The tokenizers library's object for a file, without truncation and padding."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def packed(ids: list[int]) -> bytes:
    return array.array("I", ids).tobytes() if sys.byteorder == "little" else b"".join([i.to_bytes(4, "little") for i in ids])


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


def chunk_of(key: str) -> str:
    """The text of a key of ``at_blanks``."""
    return key[1:] if key[0] == BARE else key if key[0] == "\n" else " " + key


def special_strings(path: str) -> list[str]:
    return [t.content for t in library(path).get_added_tokens_decoder().values()]


def _library_cache(path: str, cut: Callable, as_text: Callable[[str], str], fold: Callable[[str], str], bare: str) -> ChunkCache:
    tokenizer = library(path)
    tokenize, symbols = tokenizer.model.tokenize, byte_symbols()
    blank, shown = symbols[32], dict(enumerate(symbols))
    between = separator(path)

    def whole(text: str) -> bytes:
        return packed(tokenizer.encode(text, add_special_tokens=False).ids)

    def pieces_of(key: str) -> str | None:
        """The symbols that go to the merges; None for chunks that need the rules for cutting and folding."""
        text = as_text(key)
        word = text[1:] if text[0] == " " else text
        # A word of plain Latin letters is one piece.
        if not word.isalpha():
            return None
        if word.isascii():
            return word if word is text else blank + word
        return fold(text).encode().decode("latin-1").translate(shown) if max(word) <= LAST_LETTER else None

    def encode_many(keys: list[str]) -> list[bytes]:
        plain = list(map(pieces_of, keys))
        words = [w for w in plain if w is not None]
        if between is None:
            ids = iter([packed([t.id for t in tokenize(w)]) for w in words])
        else:
            # Several words a call, apart by a symbol that no merge takes.
            symbol, number = between
            flat = [number]
            for lo in range(0, len(words), 16):
                flat += [t.id for t in tokenize(symbol.join(words[lo : lo + 16]))]
                flat.append(number)
            places = (np.flatnonzero(np.array(flat, np.uint32) == number) * 4).tolist()
            data = packed(flat)
            ids = (data[a + 4 : b] for a, b in zip(places[:-1], places[1:], strict=True))
        return [whole(as_text(k)) if w is None else next(ids) for k, w in zip(keys, plain, strict=True)]

    return ChunkCache(cut, encode_many, whole, special_strings(path), bare)


@functools.cache
def separator(path: str) -> tuple[str, int] | None:
    """A byte's symbol that occurs in no merge, and its id; None where words end in a suffix of their own or there is none."""
    model = json.loads(library(path).to_str())["model"]
    merged = set("".join(x for m in model["merges"] for x in m))
    free = [s for s in byte_symbols()[:32] if s not in merged and s in model["vocab"]]
    return (free[0], model["vocab"][free[0]]) if free and not model.get("end_of_word_suffix") else None


@functools.cache
def byte_level_cache(path: str) -> ChunkCache:
    """For byte-level vocabularies, where white space belongs to the tokens."""
    return _library_cache(path, at_blanks, chunk_of, str, BARE)


@functools.cache
def word_level_cache(path: str) -> ChunkCache:
    """For vocabularies that drop white space."""
    return _library_cache(path, at_white_space, str, str.lower, "")
