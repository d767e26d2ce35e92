"""Bit-sliced Hamming search inside a task.

Fingerprints are kept as bit planes: word ``planes[b, j]`` holds bit ``j`` of 64
fingerprints, one per lane. A query is compared with all 64 lanes by XORing the
planes with its bits and adding the differences with carry-save counters, which
are words as well; a block of lanes is abandoned as soon as every lane's
counter exceeds the radius.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
FULL = U(0xFFFFFFFFFFFFFFFF)
#: Query-block rows compared at a time (each takes 64 plane words of 8 bytes).
ROWS = 1 << 15


def planes(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bit planes ``(blocks, 64)`` and the lanes in use ``(blocks,)`` of uint64 fingerprints."""
    n = len(fps)
    blocks = -(-n // 64)
    padded = np.zeros(blocks * 64, dtype=U)
    padded[:n] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(blocks, 64, 8), axis=2, bitorder="little")
    sliced = np.packbits(np.ascontiguousarray(bits.transpose(0, 2, 1)), axis=2, bitorder="little")
    used = np.full(blocks, FULL)
    if n % 64:
        used[-1] = U((1 << (n % 64)) - 1)
    return sliced.view(U).reshape(blocks, 64), used


def within(block_planes: np.ndarray, queries: np.ndarray, used: np.ndarray, radius: int) -> np.ndarray:
    """Lanes of row ``r``'s block within ``radius`` bits of ``queries[r]``, as a word per row."""
    n = len(queries)
    out = np.zeros(n, dtype=U)
    width = max(1, radius.bit_length())
    counters = [np.zeros(n, dtype=U) for _ in range(width)]
    over = np.zeros(n, dtype=U)
    rows, p, q, lanes = np.arange(n), block_planes, queries, used
    one, zero = U(1), U(0)
    for j in range(64):
        carry = p[:, j] ^ (zero - ((q >> U(j)) & one))
        for c in counters:
            both = c & carry
            c ^= carry
            carry = both
        over |= carry
        if j % 8 == 7:
            # Counter > radius, compared bit by bit from the top.
            more, equal = np.zeros(len(q), dtype=U), np.full(len(q), FULL)
            for i in range(width - 1, -1, -1):
                if not radius >> i & 1:
                    more |= equal & counters[i]
                    equal &= ~counters[i]
                else:
                    equal &= counters[i]
            over |= more
            alive = (~over & lanes) != 0
            if j == 63:
                out[rows[alive]] = (~over & lanes)[alive]
            elif not alive.all():
                rows, p, q, lanes, over = rows[alive], p[alive], q[alive], lanes[alive], over[alive]
                counters = [c[alive] for c in counters]
                if not len(rows):
                    break
    return out


def _lanes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, lane) of every set bit."""
    bits = np.unpackbits(words.view(np.uint8).reshape(len(words), 8), axis=1, bitorder="little")
    return np.nonzero(bits)


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable index for each of ``n`` nodes under edges ``a[i]-b[i]``."""
    label = np.arange(n)
    while len(a):
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if np.array_equal(before, label):
            break
    return label


def link_small(fps: np.ndarray, starts: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (index pairs) of many buckets of at most 64 fingerprints each.

    ``fps`` holds the buckets one after another, ``starts`` their first indexes.
    """
    sizes = np.diff(np.append(starts, len(fps)))
    found_a, found_b = [], []
    step = max(1, ROWS // 64)
    for lo in range(0, len(starts), step):
        first, size = starts[lo:lo + step], sizes[lo:lo + step]
        grid = np.zeros((len(first), 64), dtype=U)
        lane = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        block = np.repeat(np.arange(len(first)), size)
        member = first[block] + lane
        grid[block, lane] = fps[member]
        p, _ = planes(grid.reshape(-1))
        # Each member asks for the lanes after its own.
        used = (FULL >> (U(64) - size[block].astype(U))) & (FULL << lane.astype(U)) & ~(U(1) << lane.astype(U))
        ask = used != 0
        hits = within(p[block[ask]], fps[member[ask]], used[ask], radius)
        row, hit = _lanes(hits)
        found_a.append(member[ask][row])
        found_b.append(first[block[ask][row]] + hit)
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    return _star(len(fps), a, b)


def _star(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    label = local_components(n, a, b)
    node = np.flatnonzero(label != np.arange(n))
    return label[node], node


def link_large(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (index pairs) that connect one bucket of any size as its links do.

    Breadth first from 64 seeds at a time: a fingerprint that was reached joins a tree and
    asks once itself. It asks the fingerprints not reached yet and those of other trees that have
    still to ask, so two trees cannot stay apart, and a bucket of near copies (one tree) costs
    about its size, not its square.
    """
    n = len(fps)
    tree = np.arange(n)                      # smallest known index of each fingerprint's tree
    left = np.arange(n)                      # not reached yet
    asking = np.zeros(0, dtype=np.int64)     # reached, still to ask
    while len(left) or len(asking):
        if not len(asking):
            asking, left = left[:64], left[64:]
        # Batches of one tree where possible: they need not ask their own tree.
        asking = asking[np.argsort(tree[asking], kind="stable")]
        batch, rest = asking[:64], asking[64:]
        own = tree[batch[0]]
        others = asking if tree[batch[-1]] != own else rest[tree[rest] != own]
        asking = rest
        asked = np.concatenate([left, others])
        if not len(asked):
            continue
        p, used = planes(fps[asked])
        reached = np.zeros(len(asked), dtype=bool)
        blocks = max(1, ROWS // len(batch))
        for lo in range(0, len(p), blocks):
            part, lanes = p[lo:lo + blocks], used[lo:lo + blocks]
            row_q = np.repeat(np.arange(len(batch)), len(part))
            row_b = np.tile(np.arange(len(part)), len(batch))
            hits = within(part[row_b], fps[batch][row_q], lanes[row_b], radius)
            row, lane = _lanes(hits)
            where = (lo + row_b[row]) * 64 + lane
            tree = local_components(n, tree[batch[row_q[row]]], tree[asked[where]])[tree]
            reached[where] = True
        fresh = reached[:len(left)]
        asking = np.concatenate([asking, left[fresh]])
        left = left[~fresh]
    node = np.flatnonzero(tree != np.arange(n))
    return tree[node], node
