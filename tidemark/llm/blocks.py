"""Hash exchange in packed blocks: what each mapper block holds is counted before it is shuffled.

A mapper gathers a bounded block of hashes, keeps each distinct one once and deals them to hash-range
buckets as packed arrays; a bucket merges one entry per block and hash, however many documents hold
it, and answers each block by the entries' places. A hash that a third of all rows hold costs a bucket
one entry per block. The number of buckets follows the input without a limit.
"""

from __future__ import annotations

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .kernels import U
from .scratch import input_bytes

#: Hashes that a mapper packs at a time.
BLOCK = 600_000
#: Documents of a block; their places are 16-bit numbers.
BLOCK_DOCS = 60_000


def bucket_count(df: DataFrame, bucket_bytes: int) -> int:
    return int(min(1 << 31, max(16, input_bytes(df) // bucket_bytes)))


def bucket_cuts(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Of ascending hashes: the buckets that occur, and where each begins and the last ends."""
    part = ((h >> U(32)) * U(buckets) >> U(32)).astype(np.int64)
    lead = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.empty(0, np.int64)
    return part[lead], np.append(lead, len(h))


def repeats(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places and values of counts over 1; all others are 1."""
    at = np.flatnonzero(counts > 1)
    return at.astype(np.uint32), counts[at].astype(np.uint16)


def counts_of(size: int, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.ones(size, np.int64)
    out[at] = values
    return out


def first_block() -> int:
    """The number of this task's first block; a task has fewer than 2**24 of them."""
    return TaskContext.get().partitionId() << 24


def own_key(block: int) -> int:
    """The (negative) bucket under which a block's own row travels beside the buckets."""
    return -1 - block


def gathered(pdf, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(pdf[name]), kind)
