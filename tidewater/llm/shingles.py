"""Sets of word shingles as sorted 64-bit hashes, for many texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tidewater.llm import bytes_np as B

U64 = np.uint64


def shingle_sets(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): each row's distinct shingles, ascending.

    Words are runs of anything but ASCII white space, with A-Z lower-cased. A text of fewer
    words than a shingle has one shingle, its whole sequence; one without words has none.
    """
    data, offsets = B.text_buffer(column)
    data = B.lower_ascii()[data]
    starts, ends = B.word_spans(~B.SPACE[data], offsets)
    hashes = B.span_hash(B.prefix_hash(data), starts, ends)
    first = B.rows_of(starts, offsets)
    counts = np.diff(first)
    # words past the end count as zero, so that a short text's one shingle is its whole sequence
    padded = np.concatenate([hashes, np.zeros(words, U64)])
    row = np.repeat(np.arange(len(counts)), counts)
    left = first[1:][row] - np.arange(len(hashes))  # words from here to the row's end
    out = np.zeros(len(hashes), U64)
    for k in range(words):
        out += np.where(left > k, padded[k : k + len(hashes)], U64(0)) * U64(pow(0xA24BAED4963EE407, k + 1, 1 << 64))
    out = B.mix(out)
    keep = left >= np.minimum(words, counts[row])
    out, row = out[keep], row[keep]
    ends_of = np.searchsorted(row, np.arange(len(counts) + 1))
    for a, b in zip(ends_of[:-1].tolist(), ends_of[1:].tolist()):
        out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (row[1:] != row[:-1])
    out, row = out[new], row[new]
    return out, np.searchsorted(row, np.arange(len(counts) + 1))
