"""Token ids of whole texts by the tokenizers library, through a cache of pre-token units.

A text is cut where the tokenizer's own pre-tokeniser always cuts: at white space, and between a
letter and ASCII punctuation other than the apostrophe. The units of a batch that the cache lacks are
joined by a separator that is always a token of its own, encoded by the library in one call, and
split there again. For a tokenizer whose pre-tokeniser is not one of the two known forms, whole texts
go to the library.

Strings of special tokens inside a text are ordinary text, as the vocabularies' own description sets
it (``encode_special_tokens``): a text cannot forge the id that ends a document.
"""

from __future__ import annotations

import ctypes
import functools
import gc
import json
import resource
import sys
import types
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute

from .kernels import LOWER, OWN, SPACE, Roller, U, eights, same_bytes, spread, text_buffer

#: Ids of cached units that a worker keeps; beyond it the cache starts anew.
CACHE = 16_000_000
#: Bits of the table that finds a cached unit; a byte form, whose units differ by the space before them, has one more.
TABLE = 22
#: Bytes of text that are encoded at a time.
STEP = 1 << 19

LETTER, PUNCT, OTHER = 1, 2, 3
KIND = np.full(256, OTHER, np.uint8)
KIND[[*range(65, 91), *range(97, 123)]] = LETTER
KIND[[x for x in range(33, 127) if not chr(x).isalnum() and x != 39]] = PUNCT
KIND[SPACE] = 0

#: The letter that the byte form's vocabulary has for each byte (two bytes each); the separator stays as it is.
LETTERS = np.arange(256, dtype="<u2")
_UNSEEN = [x for x in range(256) if not (33 <= x <= 126 or 161 <= x <= 172 or x >= 174)]
LETTERS[_UNSEEN] = 256 + np.arange(len(_UNSEEN))
LETTERS[10] = 10


class UnitEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        pre = json.loads(self.tokenizer.pre_tokenizer.__getstate__()) if self.tokenizer.pre_tokenizer else {}
        normal = self.tokenizer.normalizer.__getstate__().decode() if self.tokenizer.normalizer else ""
        written = json.dumps(pre)
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not normal:
            self.form, self.separator = "bytes", b"\n"
        elif "[^\\\\s\\\\p{L}\\\\p{N}]+" in written and "[\\\\p{N}]|" in written and "Lowercase" in normal and '"invert": true' in written:
            self.form, self.separator = "words", b" 1 "
        else:
            self.form = "whole"
        if self.form != "whole":
            # the separator must be one id of its own
            ids = self.whole(self.separator.decode())
            self.mark = ids[0] if len(ids) == 1 else None
            if self.mark is None:
                self.form = "whole"
        # plain units of the byte form are one pre-token each, so they can go to the library's model without its
        # pre-tokeniser; added tokens other than special ones would be looked for before that
        self.model = self.tokenizer.model if self.form == "bytes" and all(t.special for t in self.tokenizer.get_added_tokens_decoder().values()) else None
        self.bits = TABLE + (self.form == "bytes")
        self.roller = Roller(71)
        self.clear()

    def clear(self):
        self.flat = np.empty(1 << 16, np.int32)
        self.at = np.zeros(1 << 14, np.int32)
        self.raw = np.zeros(1 << 16, np.uint8)
        self.raw_at = np.zeros(1 << 14, np.int64)
        self.head = np.zeros(1 << 14, np.uint64)
        self.used = self.count = 0
        self.seen_slot = np.zeros(1 << self.bits, np.int32)

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def plain(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Units of Latin letters or of ASCII punctuation alone, after at most one leading space."""
        kind = KIND[data]
        lead = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7))
        kind[lead] = kind[lead + 1] = LETTER
        first = start + (data[start] == 0x20)
        odd = np.concatenate([[0], np.cumsum((kind == OTHER) | (kind == 0), dtype=np.int32)])
        return (first < end) & (odd[end] == odd[np.minimum(first, end)])

    def encoded(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the given units, flat, and their number for each."""
        plain = self.plain(data, start, end)
        own, odd = np.flatnonzero(plain), np.flatnonzero(~plain)
        gap = np.frombuffer(self.separator, np.uint8)
        sizes = end[own] - start[own]
        row, place = spread(sizes + len(gap))
        joined = np.empty(len(row), np.uint8)
        body = place < sizes[row]
        joined[body] = data[start[own][row[body]] + place[body]]
        joined[~body] = gap[place[~body] - sizes[row[~body]]]
        counts = np.zeros(len(start), np.int64)
        if self.model is not None:
            tokenize = self.model.tokenize
            parts = [[t.id for t in tokenize(unit)] for unit in LETTERS[joined].tobytes().decode("utf-16-le").split("\n")[:-1]]
            ids = np.array([x for p in parts for x in p], np.int32)
            counts[own] = [len(p) for p in parts]
        else:
            ids = np.array(self.whole(joined.tobytes().decode()), np.int32)
            cuts = np.flatnonzero(ids == self.mark)
            ids = ids[ids != self.mark]
            counts[own] = np.diff(cuts, prepend=-1) - 1
        if not len(odd):
            return ids, counts
        texts = [data[s:e].tobytes().decode() for s, e in zip(start[odd].tolist(), end[odd].tolist(), strict=True)]
        rest = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        counts[odd] = [len(x) for x in rest]
        out, first = np.empty(counts.sum(), np.int32), np.cumsum(counts) - counts
        for which, values in ((own, ids), (odd, [x for r in rest for x in r])):
            row, place = spread(counts[which])
            out[first[which][row] + place] = values
        return out, counts

    def add(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Slots of new units, with their ids and their bytes."""
        row, place = spread(end - start)
        data, end = data[start[row] + place], np.cumsum(end - start)  # from here on of these units alone
        start = np.concatenate([[0], end[:-1]])
        ids, counts = self.encoded(data, start, end)
        n = self.count + len(counts)
        if n + 2 > len(self.at):
            more = max(n + 2, len(self.at))
            self.at = np.concatenate([self.at, np.zeros(more, np.int32)])
            self.raw_at = np.concatenate([self.raw_at, np.zeros(more, np.int64)])
            self.head = np.concatenate([self.head, np.zeros(more, np.uint64)])
        filled = int(self.raw_at[self.count])
        if filled + len(data) + 8 > len(self.raw):
            self.raw = np.concatenate([self.raw, np.zeros(max(len(data) + 8, len(self.raw)), np.uint8)])
        self.raw[filled : filled + len(data)] = data
        self.raw_at[self.count + 1 : n + 1] = filled + end
        self.head[self.count : n] = self.heads(data, start, end)
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty(max(len(ids), len(self.flat)), np.int32)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.at[self.count + 1 : n + 1] = self.used + np.cumsum(counts)
        self.used += len(ids)
        slots = np.arange(self.count, n)
        self.count = n
        return slots

    @staticmethod
    def heads(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The first seven bytes of each unit, and its length (255 stands for all from there on)."""
        size = end - start
        return (eights(data)[start] & OWN[np.minimum(size, 7)]) | (np.minimum(size, 255).astype(np.uint64) << U(56))

    def units(self, data: np.ndarray, at: np.ndarray):
        """Start and end of each unit, and the first unit of each row."""
        kind = KIND[data]
        lead = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)) if len(data) else np.empty(0, int)
        kind[lead] = LETTER
        kind[lead + 1] = LETTER
        before = np.concatenate([[0], kind[:-1]]).astype(np.uint8)
        cut = (kind + before == LETTER + PUNCT) & (kind != 0) & (before != 0)  # a letter beside punctuation
        first = np.zeros(len(data), bool)
        first[at[:-1][at[:-1] < len(data)]] = True
        space = kind == 0
        if self.form == "words":
            begin = ~space & (first | cut | (before == 0))
            start = np.flatnonzero(begin)
            # a unit ends at the next unit's start or at white space, whichever comes first
            after = np.concatenate([start[1:], [len(data)]])
            gaps = np.append(np.flatnonzero(space), len(data))
            end = np.minimum(after, gaps[np.searchsorted(gaps, start)])
            return start, end, np.searchsorted(start, at)
        follows = np.concatenate([first[1:], [True]])  # the row ends after this byte
        next_space = np.concatenate([space[1:], [True]]) | follows
        last = space & ~next_space  # the white space byte right before a word
        blank = last & (data == 0x20)
        # white space: a run's first byte, and its last byte where a word follows
        begin = (space & ((before != 0) | first)) | last | cut
        begin |= ~space & ((before == 0) | first)
        # a word takes the single space before it
        taken = np.flatnonzero(blank) + 1
        begin[taken] = False
        begin |= first
        start = np.flatnonzero(begin)
        return start, np.concatenate([start[1:], [len(data)]]), np.searchsorted(start, at)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, flat, and the number of ids of each row."""
        if self.form == "whole":
            out = [e.ids for e in self.tokenizer.encode_batch_fast([x or "" for x in column.to_pylist()], add_special_tokens=False)]
            return np.concatenate([np.empty(0, np.int32), *(np.array(x, np.int32) for x in out)]), np.array([len(x) for x in out], np.int64)
        data, at = text_buffer(column)
        if self.form == "words":
            data = LOWER[data]
        start, end, first = self.units(data, at)
        keys, size = self.roller.words(data, start, end), end - start
        if self.used > CACHE:
            self.clear()
        spot = (keys & U((1 << self.bits) - 1)).astype(np.int64)
        slot = self.seen_slot[spot].astype(np.int64)
        # hashes only find a cached unit: its bytes decide
        head = self.heads(data, start, end)
        known = self.head[slot] == head
        long = np.flatnonzero(known & (size > 7))
        if len(long):
            begin = self.raw_at[slot[long]]
            alike = self.raw_at[slot[long] + 1] - begin == size[long]
            alike[alike] = same_bytes(data, start[long[alike]], self.raw, begin[alike], size[long[alike]], roomy=True)
            known[long[~alike]] = False
        missed = np.flatnonzero(~known)
        if len(missed):
            _, where, inverse = np.unique(keys[missed], return_index=True, return_inverse=True)
            where = missed[where]
            slots = self.add(data, start[where], end[where])
            slot[missed] = slots[inverse]
            self.seen_slot[spot[where]] = slots
            like = where[inverse]
            apart = np.flatnonzero(size[missed] != size[like])
            same = np.flatnonzero(size[missed] == size[like])
            odd = missed[np.concatenate([apart, same[~same_bytes(data, start[missed[same]], data, start[like[same]], size[missed[same]])]])]
            if len(odd):  # other units of an equal hash
                slot[odd] = self.add(data, start[odd], end[odd])
        begin = self.at[slot].astype(np.int64)
        sizes = self.at[slot + 1] - begin
        total = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.flat[np.repeat(begin - total[:-1], sizes) + np.arange(total[-1])]
        counts = np.diff(total[first])
        odd = self.odd_rows(data, at) if self.form == "bytes" else ()
        if len(odd):
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for r in odd:
                parts[r] = np.array(self.tokenizer.encode(column[int(r)].as_py(), add_special_tokens=False).ids, np.int32)
            ids, counts = np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
        return ids, counts

    @staticmethod
    def odd_rows(data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rows with white space other than 0x20 and 0x09-0x0D, which may join with its neighbours."""
        found = np.flatnonzero((data >= 0x1C) & (data <= 0x1F))
        wide = np.flatnonzero(np.isin(data, np.array([0xC2, 0xE1, 0xE2, 0xE3], np.uint8)))
        if len(wide):
            pad = np.concatenate([data, np.zeros(2, np.uint8)])
            a, b, c = pad[wide], pad[wide + 1], pad[wide + 2]
            odd = ((a == 0xC2) & ((b == 0x85) | (b == 0xA0))) | ((a == 0xE1) & (b == 0x9A)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
            odd |= (a == 0xE2) & (((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F)))
            found = np.concatenate([found, wide[odd]])
        return np.unique(np.searchsorted(at, found, "right") - 1)


def encoder(path: str) -> UnitEncoder:
    """The worker's encoder for a vocabulary file; kept from task to task."""
    kept = sys.modules.setdefault("_tidemark_worker", types.ModuleType("_tidemark_worker")).__dict__
    if path not in kept:
        kept[path] = UnitEncoder(path)
    return kept[path]


#: Resident bytes from which on a worker gives memory back; below, it is not worth the time.
LARGE = 170 << 20


def release(keep: bool = False) -> None:
    """Give back what a worker holds: the encoders of earlier tasks unless they are to be kept, and, where
    it is much, the allocators' free pages."""
    kept = sys.modules.get("_tidemark_worker")
    if kept is not None and not keep:
        kept.__dict__.clear()
    try:
        with open("/proc/self/statm") as f:
            resident = int(f.read().split()[1]) * resource.getpagesize()
    except OSError:  # not Linux
        return
    if resident >= LARGE:
        trim()


def trim() -> None:
    """Give the allocators' free pages back."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):  # not glibc
        ctypes.CDLL(None).malloc_trim(0)


def keep_pages() -> None:
    """Have the allocator keep the pages of freed arrays for the next ones, up to 256 MiB, where each would be
    mapped anew; ``release`` gives them back at the end of a task."""
    with suppress(AttributeError, OSError):  # not glibc
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 256 << 20)  # M_TRIM_THRESHOLD


def lean(run, keep: bool = False):
    """A mapper over batches that leaves nothing behind (but encoders, with ``keep``): workers are reused,
    and one that waits for its next task should not hold what the last one needed."""

    @functools.wraps(run)
    def wrapped(batches):
        release(keep)
        try:
            yield from run(batches)
        finally:
            release(keep)

    return wrapped


def slices(column: pa.Array, step: int = STEP, most: int = 4096):
    """Row ranges of about ``step`` bytes of text, and ``most`` rows at most."""
    sizes = np.array([0 if x is None else x for x in pa.compute.binary_length(column).to_pylist()], np.int64)
    part = np.cumsum(sizes + -(-step // most)) // step
    cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else np.array([0, 0])
    yield from zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)
