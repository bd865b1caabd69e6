"""Words of many texts at once: each distinct word of a batch is handled and hashed once."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash

from .common import words_of


def coded_words(texts: list[bytes | None]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct words of the batch, place of each word in that list, number of words of each text)."""
    split = [words_of(t) for t in texts]
    lengths = np.fromiter(map(len, split), np.int64, len(split))
    coded = pa.array(chain.from_iterable(split), pa.large_binary()).dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), lengths


def hash_all(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w) for w in words), np.uint64, len(words))
