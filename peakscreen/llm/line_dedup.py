"""Fuzzy line deduplication across documents.

1. Lines are normalised (lower case, digit runs to 0, other runs of non-letters to one space).
2. Equal normalised lines collapse by a 128-bit hash: a line that occurs in a third
   of all documents is one row from here on.
3. Each distinct line gets a SimHash and block keys. Lines of up to ``SHORT`` words take both from their character
   trigrams, lines of ``LONG`` words and more from their distinct words (lines between have both kinds). A block
   key joins the smallest draws of a few features (words weigh by their length, so common words seldom decide), so lines that share most of them
   meet in some block. Blocks of bits of the SimHash itself cannot serve: at an edit similarity of 0.8 a fifth of the features
   differ, that is 10 to 14 of 64 bits, and a block of bits that survives this is shared by everything.
4. Within a block, SimHashes are compared bit-sliced; what hangs together within ``RADII`` bits is named by its
   smallest SimHash, and all that has one name, in whichever block, is a unit: it lies in the blocks of one line. A block beyond ``TILE`` lines is a unit as it is.
   Within a unit, lines in the radius are verified: edit similarity 1 - distance / longer
   length of the normalised lines of at least ``SIMILARITY``. A verified line is
   reached once and then asks itself, so near copies cost about their number. A unit with
   more than ``TILE`` lines is cut into tiles and each pair of tiles is a unit of work.
5. Connected groups; of each group the first occurrence (smallest doc_id, then line) stays.

Lines without a letter or digit are layout and always stay. Cleaned texts are the
remaining lines joined by line feeds.

Defined cases: a null text stays null and has no line; an empty text has one empty line;
rows with equal id and text are one occurrence and are cleaned alike; null ids come last among
occurrences; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Generator, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakscreen.llm import bitslice
from peakscreen.llm.common import boxed, discard, let, map_arrow, staged, staged_at, strings
from peakscreen.llm.components import connected_components, contracted
from peakscreen.session import ship_package

#: Bits by which SimHashes of words and of trigrams may differ.
RADII = (17, 19)
SIMILARITY = 0.8
#: Words up to which a line has trigram blocks, and from which it has word blocks.
SHORT, LONG = 8, 6
#: Blocks of a line and smallest hashes in a block key, for words and for trigrams.
WORD_BLOCKS, TRIGRAM_BLOCKS = (16, 4), (24, 4)
TILE = 4096
#: Block keys travel packed by ranges of their highest bits; bytes of whole ranges that are sorted together, about.
RANGE_BITS, _PACKED = 11, 4_000_000
#: Words whose hash bits are counted at a time; at most 255 fit into an 8-bit counter.
_WORDS, _COUNTER = 1 << 20, 255
#: Bit j of a byte as the lowest bit of byte j of a word: eight counters side by side.
_SPREAD = np.array([sum((b >> j & 1) << (8 * j) for j in range(8)) for b in range(256)], dtype=np.uint64)


def normalised(lines: pa.Array) -> pa.Array:
    """Lower case, digit runs to 0, other runs of non-letters to one space, trimmed; line feeds stay."""
    low = pc.utf8_lower(lines.cast(pa.large_string()))
    low = pc.replace_substring_regex(low, r"\p{N}+", "0")
    # Most runs are a single space already: those need no match.
    low = pc.replace_substring_regex(low, r"[^\p{L}0\n ][^\p{L}0\n]*| [^\p{L}0\n]+", " ")
    return pc.utf8_trim(low, " ")


def _plain(texts: pa.Array) -> pa.Array:
    return normalised(pc.fill_null(texts, ""))


def normalise(line: str) -> str:
    return normalised(pa.array([line]))[0].as_py()


_U = np.uint64
_GOLD, _MIX = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9)


def _scatter(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> _U(30)) * _MIX
    return h ^ h >> _U(31)


def _majority(line: np.ndarray, code: np.ndarray, lines: int, hashes: np.ndarray) -> np.ndarray:
    """SimHash of each line's distinct features: bits set in over half of their ``hashes``; pairs sorted by line.

    Eight bit counters share a machine word, so a feature's 64 bits are added in eight additions.
    """
    spread = _SPREAD[hashes.view(np.uint8)].reshape(-1, 8)
    n = np.bincount(line, minlength=lines)
    first = np.cumsum(n) - n
    place = np.arange(len(line)) - np.repeat(first, n)
    parts = np.flatnonzero(place % _COUNTER == 0)            # a line's features, 255 at a time
    sums = np.empty((len(parts), 8), dtype=np.uint64)
    bounds = np.append(parts, len(line))
    at = 0
    while at < len(parts):
        stop = max(at + 1, int(np.searchsorted(bounds, bounds[at] + _WORDS, "right")) - 1)
        own = spread[code[bounds[at]:bounds[stop]]]
        sums[at:stop] = np.add.reduceat(own, bounds[at:stop] - bounds[at], axis=0)
        at = stop
    counts = sums.view(np.uint8).reshape(-1, 64)
    if len(parts) > lines:
        counts = np.add.reduceat(counts.astype(np.int64), np.searchsorted(parts, first), axis=0)
        over = counts * 2 > n[:, None]
    else:
        over = counts > (n // 2)[:, None]
    return np.packbits(over, axis=1, bitorder="little").view(np.int64).reshape(-1)


def _block_keys(line: np.ndarray, code: np.ndarray, lines: int, hashes: np.ndarray, weights: np.ndarray, blocks: int, rows: int) -> np.ndarray:
    """``(lines, blocks)`` keys of 32 bits: each joins the smallest of ``rows`` draws over the line's features.

    A draw is exponential with the feature's weight as its rate, so heavy features are the smallest more often.
    """
    first = np.searchsorted(line, np.arange(lines))
    out = np.empty((lines, blocks), dtype=np.int32)
    for b in range(blocks):
        key = np.zeros(lines, dtype=np.uint64)
        for r in range(rows):
            u = _scatter(hashes ^ np.full(1, b * rows + r + 1, dtype=np.uint64) * _GOLD) >> _U(11)
            drawn = (-np.log((u + 0.5) * 2.0 ** -53) / weights).astype(np.float32)
            key = key * _GOLD ^ np.minimum.reduceat(drawn[code], first).view(np.uint32)
        out[:, b] = (_scatter(key) >> _U(32)).astype(np.uint32).view(np.int32)
    return out


def _features(line: np.ndarray, code: np.ndarray, codes: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (line, feature) pairs, sorted."""
    pairs = line * np.int64(codes) + code
    pairs.sort()
    pairs = pairs[np.diff(pairs, prepend=-1) != 0]
    return pairs // codes, pairs % codes


def _word_features(lines: pa.Array):
    cut = pc.split_pattern(lines.cast(pa.large_string()), " ")
    ends = np.diff(cut.offsets.to_numpy())
    coded = cut.flatten().dictionary_encode()
    words = strings(coded.dictionary)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(w, 1) for w in words], dtype=np.uint64)
    # Common words are short: their weight keeps them from making a block of everything.
    weights = np.minimum([len(w) for w in words], 16) ** 1.5
    return *_features(np.repeat(np.arange(len(lines)), ends), coded.indices.to_numpy(), len(words)), hashes, weights, ends


def _trigram_features(lines: pa.Array):
    """Distinct trigrams of each line with a space before and behind."""
    texts = [f" {t} " if len(t) > 1 else f" {t}  " for t in strings(lines)]
    ends = np.array([len(t) for t in texts]) - 2
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    grams = points[:-2] | points[1:-1] << _U(21) | points[2:] << _U(42)
    starts = np.cumsum(ends + 2) - (ends + 2)
    at = np.repeat(starts, ends) + np.arange(ends.sum()) - np.repeat(np.cumsum(ends) - ends, ends)
    values, code = np.unique(grams[at], return_inverse=True)
    return *_features(np.repeat(np.arange(len(lines)), ends), code, len(values)), _scatter(values * _GOLD), np.ones(len(values))


def _sketched(lines: pa.Array) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """SimHashes, block keys and who has them, by words and by trigrams, of normalised, non-empty lines."""
    n = len(lines)
    kinds = [(np.zeros(n, dtype=np.int64), np.zeros((n, b), dtype=np.int32), np.zeros(n, dtype=bool)) for b, _ in (WORD_BLOCKS, TRIGRAM_BLOCKS)]
    if n:
        line, code, hashes, weights, words = _word_features(lines)
        for (fps, keys, has), own, shape in zip(kinds, (words >= LONG, words <= SHORT), (WORD_BLOCKS, TRIGRAM_BLOCKS)):
            has[:] = own
            if not own.any():
                continue
            if shape is WORD_BLOCKS:
                mine = own[line]
                rank = np.cumsum(own) - 1
                got = rank[line[mine]], code[mine], hashes, weights
            else:
                got = _trigram_features(lines.filter(pa.array(own)))
            k = int(own.sum())
            fps[own], keys[own] = _majority(got[0], got[1], k, got[2]), _block_keys(got[0], got[1], k, got[2], got[3], *shape)
    return kinds


def sketches(lines: pa.Array) -> pa.StructArray:
    """``wfp, wkeys, tfp, tkeys`` of each normalised, non-empty line; null where a line has no such kind."""
    columns = []
    for fps, keys, has in _sketched(lines):
        size = has.astype(np.int32) * keys.shape[1]
        offsets = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
        columns += [pa.array(fps, mask=~has), pa.ListArray.from_arrays(offsets, pa.array(keys[has].reshape(-1)), mask=pa.array(~has))]
    return pa.StructArray.from_arrays(columns, names=["wfp", "wkeys", "tfp", "tkeys"])


def _packs(kinds: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, pa.Array]:
    """Range of keys and ``(key, fp)`` of all blocks in it. One long names block number, key and, in its lowest bit, kind."""
    names, fps = [], []
    for kind, (fp, keys, has) in enumerate(kinds):
        own = keys[has].view(np.uint32).astype(np.uint64) | np.arange(64 * kind, 64 * kind + keys.shape[1], dtype=np.uint64) << _U(32)
        names.append((_scatter(own * _GOLD) & ~_U(1) | _U(kind)).reshape(-1))
        fps.append(np.repeat(fp[has], keys.shape[1]))
    name, fp = np.concatenate(names).view(np.int64), np.concatenate(fps)
    ranges = (name >> (64 - RANGE_BITS)).astype(np.int16)
    order = np.argsort(ranges, kind="stable")
    ranges = ranges[order]
    firsts = np.flatnonzero(np.diff(ranges, prepend=ranges[:1] - 1))
    packed = np.stack([name[order], fp[order]], axis=1)
    offsets = np.append(firsts, len(ranges)) * 16
    return ranges[firsts].astype(np.int32), pa.Array.from_buffers(
        pa.binary(), len(firsts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(packed)])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``key, kind, fp`` sorted by key, from packs sorted by range: blocks with company only. A SimHash that
    comes more than twice in a block (a line that many parts hold) comes twice."""
    def blocks(packs):
        key, fp = np.frombuffer(b"".join(packs), dtype=np.int64).reshape(-1, 2).T
        order = np.argsort(key)
        key, fp = key[order], fp[order]
        same = key[1:] == key[:-1]
        company = np.append(same, False) | np.append(False, same)
        key, fp = key[company], fp[company]
        order = np.lexsort([fp, key])
        key, fp = key[order], fp[order]
        keep = np.ones(len(key), dtype=bool)
        keep[2:] = (key[2:] != key[:-2]) | (fp[2:] != fp[:-2])
        key, fp = key[keep], fp[keep]
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array((key & 1).astype(np.int32)), pa.array(fp)], names=["key", "kind", "fp"])

    held, size, now = [], 0, None
    for b in batches:
        for at, pack in zip(b.column("range").to_pylist(), b.column("pack").to_pylist()):
            if at != now and size >= _PACKED:
                yield blocks(held)
                held, size = [], 0
            now, size = at, size + len(pack)
            held.append(pack)
    if held:
        yield blocks(held)


def edit_distance(a: str, b: str, most: int | None = None) -> int:
    """Levenshtein distance, bit-parallel over the columns of ``a``; once it is sure to exceed ``most``, any number above that."""
    while a and b and a[-1] == b[-1]:
        n = len(a)
        step = next((k for k in (4096, 256, 16) if n > k and a[-k:] == b[-k:]), 1)
        a, b = a[:-step], b[:-step]
    start = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    a, b = a[start:], b[start:]
    if not a or not b:
        return len(a) + len(b)
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full, top, distance = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    up, down = full, 0
    left = len(b) + (len(a) + len(b) if most is None else most)
    for ch in b:
        match = where.get(ch, 0)
        zero = (((match & up) + up) ^ up) | match | down
        plus, minus = down | (~(zero | up) & full), up & zero
        distance += bool(plus & top) - bool(minus & top)
        left -= 1
        if distance > left:          # each remaining column lowers it by one at most
            return distance
        plus = (plus << 1 | 1) & full
        minus = minus << 1 & full
        up, down = minus | (~(zero | plus) & full), plus & zero
    return distance


def aligned_cost(a: str, b: str, ahead: int = 3) -> int:
    """An upper bound of the edit distance: words in step, passing over up to ``ahead`` unequal words on either side.

    Every word counts with the space behind it; a stretch that differs costs its longer side.
    """
    x, y = a.split(" "), b.split(" ")
    i = j = cost = 0
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            i, j = i + 1, j + 1
            continue
        k, m = next(((k, n - k) for n in range(1, 2 * ahead + 1) for k in range(max(0, n - ahead), min(n, ahead) + 1)
                     if i + k < len(x) and j + n - k < len(y) and x[i + k] == y[j + n - k]), (1, 1))
        cost += max(sum(map(len, x[i:i + k])) + k, sum(map(len, y[j:j + m])) + m)
        i, j = i + k, j + m
    return cost + max(sum(map(len, x[i:])) + len(x) - i, sum(map(len, y[j:])) + len(y) - j)


def similar(a: str, b: str, least: float = SIMILARITY) -> bool:
    longer = max(len(a), len(b))
    if min(len(a), len(b)) < least * longer:
        return False
    if longer - aligned_cost(a, b) >= least * longer:
        return True
    return longer - edit_distance(a, b, int((1 - least) * longer) + 1) >= least * longer


def most_edits(longer: np.ndarray, least: float) -> np.ndarray:
    """Largest edit distance at which lines whose longer one has ``longer`` characters are similar."""
    most = np.floor((1 - least) * longer).astype(np.int64) + 1
    for _ in range(2):
        most -= longer - most < least * longer
    return most


#: Characters up to which lines are compared many pairs at a time, diagonals of such a batch and pairs that are worth it.
_CHARS, _CELLS, _FEW = 4096, 1 << 16, 8
_FAR = 20_000


def _grid(codes: list[np.ndarray], rows: int, backwards: bool) -> np.ndarray:
    """``(rows, len(codes))``: a column for each line, one row before it and the rest behind, or the reverse of this."""
    size = np.array([len(c) for c in codes])
    out = np.zeros((len(codes), rows), dtype=np.uint16)
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + 1
    out[np.repeat(np.arange(len(codes)), size), rows - 1 - at if backwards else at] = np.concatenate(codes)
    return np.ascontiguousarray(out.T)


def _banded(a: list[np.ndarray], b: list[np.ndarray], most: np.ndarray) -> np.ndarray:
    """Whether the edit distance of ``a[k]`` and ``b[k]`` (the longer one) is at most ``most[k]``.

    The distance table of all pairs is filled by antidiagonals, and of these only the diagonals that a path
    of so few edits can touch. Even and odd diagonals alternate, each has its own rows.
    """
    la, lb = (np.array([len(c) for c in x]) for x in (a, b))
    gap, n = lb - la, len(a)
    before, after = int(((most - gap) // 2).max()), int((gap + (most - gap) // 2).max())
    half = -(-(before + after) // 2)                            # diagonals -before ... 2 * half - before
    after = 2 * half - before
    end = la + lb
    stops, last = set(end.tolist()), int(end.max())
    # The first line is read backwards as the second is read forwards.
    x, y = _grid(a, (last + before) // 2 + 3, True), _grid(b, (last + after) // 2 + 3, False)
    even, odd = (np.full((half + k, n), _FAR, dtype=np.uint16) for k in (1, 2))      # odd: a row beyond the band on either side
    (spare, unequal), one = np.empty((2, half + 1, n), dtype=np.uint16), np.ones((half + 1, n), dtype=np.uint16)
    if before % 2:
        odd[(before + 1) // 2] = 0
    else:
        even[before // 2] = 0
    got, column = np.zeros(n, dtype=bool), np.arange(n)
    got[end == 0] = True
    for s in range(1, last + 1):
        which = (s - before) % 2                                # the diagonals d = 2 * m + which - before
        own, near = (odd[1:-1], even) if which else (even, odd)
        lo = max(0, -(-(before - s - which) // 2))
        hi = min(len(own) - 1, (before + s - which) // 2)
        if lo <= hi:
            d, rows = 2 * lo + which - before, hi - lo + 1
            at, j = len(x) - 1 - (s - d) // 2, (s + d) // 2
            t, u, mine = spare[:rows], unequal[:rows], own[lo:hi + 1]
            np.bitwise_xor(x[at:at + rows], y[j:j + rows], out=u)
            np.minimum(u, one[:rows], out=u)                    # far faster than with a number
            np.minimum(near[lo:lo + rows], near[lo + 1:lo + rows + 1], out=t)
            t += 1
            mine += u
            np.minimum(mine, t, out=mine)
        if s in stops:
            over = np.flatnonzero(end == s)
            over = over[(gap[over] + before) % 2 == which]
            got[column[over]] = own[(gap[over] + before - which) // 2, over] <= most[over]
        if s % 64 == 0:
            # Neither a finished pair nor one that needs too many edits on every diagonal goes on.
            on = end > s
            low = np.full(len(on), _FAR, dtype=np.int64)
            for own, first in ((even, 0), (odd[1:-1], 1)):
                if len(own):
                    rest = np.abs(np.arange(first - before, first - before + 2 * len(own), 2)[:, None] - gap)
                    low = np.minimum(low, (own + rest).min(axis=0))
            on &= low <= most
            if not on.any():
                break
            if on.mean() <= 0.7:
                x, y, even, odd = (np.ascontiguousarray(c[:, on]) for c in (x, y, even, odd))
                end, gap, most, column = end[on], gap[on], most[on], column[on]
                spare, unequal, one = (np.ascontiguousarray(c[:, :len(column)]) for c in (spare, unequal, one))
    return got


def _trimmed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without common beginning and end; ``a`` is not longer."""
    unequal = a != b[:len(a)]
    at = int(unequal.argmax()) if len(a) else 0
    if not len(a) or not unequal[at]:
        return a[:0], b[len(a):]
    a, b = a[at:], b[at:]
    unequal = a[::-1] != b[len(b) - len(a):][::-1]
    back = int(unequal.argmax())
    back = back if unequal[back] else len(a)
    return a[:len(a) - back], b[:len(b) - back]


def all_similar(pairs: list[tuple[str, str]], least: float = SIMILARITY) -> np.ndarray:
    """:func:`similar` for many pairs at a time."""
    pairs = [(a, b) if len(a) <= len(b) else (b, a) for a, b in pairs]
    longer = np.array([len(b) for _, b in pairs], dtype=np.int64)
    most, gap = most_edits(longer, least), longer - np.array([len(a) for a, _ in pairs], dtype=np.int64)
    out = np.zeros(len(pairs), dtype=bool)
    for k in np.flatnonzero((gap <= most) & (longer > _CHARS)).tolist():
        out[k] = similar(*pairs[k], least)
    todo = np.flatnonzero((gap <= most) & (longer <= _CHARS))
    if not len(todo):
        return out
    # Code points as numbers of 16 bits.
    own = list({t for k in todo.tolist() for t in pairs[k]})
    points = np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if len(points) and points.max() > 0xFFFF:
        values, points = np.unique(points, return_inverse=True)
        if len(values) > 1 << 16:
            out[todo] = [similar(*pairs[k], least) for k in todo.tolist()]
            return out
    points, ends = points.astype(np.uint16), np.cumsum([len(t) for t in own])
    codes = {t: points[e - len(t):e] for t, e in zip(own, ends.tolist())}
    cut = {k: _trimmed(codes[pairs[k][0]], codes[pairs[k][1]]) for k in todo.tolist()}
    size = np.array([len(cut[k][1]) for k in todo.tolist()])
    out[todo[size <= most[todo]]] = True
    todo, size = todo[size > most[todo]], size[size > most[todo]]
    # Together go pairs of similar bands and lengths, more of them if they are short.
    band = (np.log2(most[todo] + 16) * 1.5).astype(np.int64)
    order = np.lexsort([size, band])
    todo, size, band = todo[order], size[order], most[todo[order]] + 4
    at = 0
    while at < len(todo):
        count = np.arange(1, min(len(todo) - at, _CELLS) + 1)
        stop = at + max(1, int(np.searchsorted(np.maximum.accumulate(band[at:at + _CELLS]) * count, _CELLS, "right")))
        own, at = todo[at:stop], stop
        if len(own) < _FEW:
            for k in own.tolist():
                out[k] = edit_distance(*pairs[k], int(most[k])) <= most[k]
        else:
            out[own] = _banded(*zip(*[cut[k] for k in own.tolist()]), most[own])
    return out


def occurrences(docs: DataFrame) -> DataFrame:
    """``id, text_hash, line, key, wfp, tfp``: the lines with content (text left behind); and, with a null ``key``,
    ``range, pack``: their blocks.

    A line repeated within a part of a batch has its SimHashes at its first occurrence there.
    """
    names = ["id", "text_hash", "line", "key", "wfp", "tfp", "range", "pack"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def rows(**own):
        n = len(next(iter(own.values())))
        return pa.RecordBatch.from_arrays([own[c] if c in own else pa.nulls(n, t) for c, t in zip(names, types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                cut = pc.split_pattern(_plain(part.column("text")), "\n")
                sizes = np.diff(cut.offsets.to_numpy())
                row = np.repeat(np.arange(part.num_rows), sizes)
                number = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                lines = pc.utf8_trim(cut.flatten(), " ")
                some = pc.not_equal(lines, "")
                keep = some.to_numpy(zero_copy_only=False)
                # Lines repeated within the part are hashed once.
                coded, at = lines.filter(some).dictionary_encode(), pa.array(row[keep])
                if not len(at):
                    continue
                keys = pa.array([xxhash.xxh3_128_digest(x) for x in strings(coded.dictionary)], pa.binary())
                codes = coded.indices.to_numpy()
                again = np.ones(len(codes), dtype=bool)
                again[np.unique(codes, return_index=True)[1]] = False
                kinds = _sketched(coded.dictionary)
                firsts = pa.array(codes, mask=again)
                wfp, tfp = (pa.array(fps, mask=~has).take(firsts) for fps, _, has in kinds)
                yield rows(id=part.column("id").take(at), text_hash=part.column("text_hash").take(at), line=pa.array(number[keep], pa.int32()),
                           key=keys.take(coded.indices), wfp=wfp, tfp=tfp)
                ranges, packs = _packs(kinds)
                yield rows(range=pa.array(ranges), pack=packs)

    ship_package(docs.sparkSession)
    return docs.mapInArrow(run, "id long, text_hash long, line int, key binary, wfp long, tfp long, range int, pack binary")


def _units(batches: Iterator[pa.RecordBatch], radii: tuple[int, int], tile: int) -> Iterator[pa.RecordBatch]:
    """``unit, kind, fp`` of the lines that have company in their block, from batches sorted by block key.

    A unit is named by its smallest SimHash; a block beyond ``tile`` rows passes through under its key.
    """
    def rows(unit, kind, fp):
        return pa.RecordBatch.from_arrays([pa.array(unit.view(np.int64)), pa.array(kind), pa.array(fp.view(np.int64))],
                                          names=["unit", "kind", "fp"])

    def members(kind, fp, a, b):
        label = bitslice.local_components(len(fp), a, b)
        company = np.bincount(label, minlength=len(fp))[label] > 1
        low = np.full(len(fp), ~_U(0))
        np.minimum.at(low, label, fp)
        name = _scatter((low[label] ^ kind.astype(np.uint64)) * _GOLD)
        return rows(name[company], kind[company], fp[company])

    def whole(key, kind, fp):
        """Complete blocks."""
        firsts = np.flatnonzero(np.diff(key, prepend=~key[:1]))
        sizes = np.diff(np.append(firsts, len(key)))
        for k, radius in enumerate(radii):
            few = (sizes > 1) & (sizes <= 64) & (kind[firsts] == k)
            if few.any():
                small, some = np.repeat(few, sizes), sizes[few]
                yield members(kind[small], fp[small], *bitslice.link_small(fp[small], np.cumsum(some) - some, radius))
        for r in np.flatnonzero(sizes > 64).tolist():
            own = slice(firsts[r], firsts[r] + sizes[r])
            yield members(kind[own], fp[own], *bitslice.link_large(fp[own], radii[kind[firsts[r]]])) if sizes[r] <= tile else \
                rows(key[own].view(np.uint64), kind[own], fp[own])

    none = (np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint64))
    held, passing = none, None
    for b in batches:
        if not b.num_rows:
            continue
        now = [b.column("key").to_numpy(), b.column("kind").to_numpy(), b.column("fp").to_numpy().view(np.uint64)]
        if passing is not None:
            n = int(np.searchsorted(now[0], passing, "right"))
            if n:
                yield rows(now[0][:n].view(np.uint64), now[1][:n], now[2][:n])
            if n == b.num_rows:
                continue
            now, passing = [c[n:] for c in now], None
        key, kind, fp = (np.concatenate([h, c]) for h, c in zip(held, now))
        end = int(np.searchsorted(key, key[-1], "left"))           # the last block is open
        if end:
            yield from whole(key[:end], kind[:end], fp[:end])
        held = key[end:], kind[end:], fp[end:]
        if len(held[0]) > tile:
            yield rows(held[0].view(np.uint64), held[1], held[2])
            held, passing = none, int(held[0][0])
    if len(held[0]) > 1:
        yield from whole(*held)


#: Pairs that are verified together, characters of the units they come from, and pairs that a unit may always ask at a time, about.
_ASKED, _OPEN, _WIDE = 8192, 16_000_000, 64


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row of a batch once."""
    for b in batches:
        unit, fp = (b.column(c).to_numpy() for c in ("unit", "fp"))      # a unit is of one kind
        order = np.lexsort([fp, unit])
        new = np.ones(len(order), dtype=bool)
        new[1:] = (np.diff(unit[order]) != 0) | (np.diff(fp[order]) != 0)
        yield b.take(pa.array(order[new]))


def _reach(texts: list[str], fps: np.ndarray, radius: int, least: float) -> Generator[list[tuple[int, int]], np.ndarray, list[tuple[int, int]]]:
    """Verified links (index pairs) that connect the lines as all verified pairs do.

    Yields the pairs to be verified next and is sent whether each is similar: the pairs of many units are verified together.
    """
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    queue, left, at, width, found = [0], np.arange(1, len(texts)), 0, 1, []
    tree = np.arange(len(texts))

    def link(pairs):
        for a, b in pairs:
            if tree[a] != tree[b]:
                found.append((a, b))
                tree[tree == tree[b]] = tree[a]

    def near(x, y):
        close = np.bitwise_count(fps[x][:, None] ^ fps[y][None, :]) <= radius
        if close.any():
            longer = np.maximum(sizes[x][:, None], sizes[y][None, :])
            close &= np.minimum(sizes[x][:, None], sizes[y][None, :]) >= least * longer
        return close

    while len(left):
        if at == len(queue):                                # all trees are complete: new ones, which ask each other as well
            seeds, left = left[:width], left[width:]
            queue += seeds.tolist()
            if len(seeds) > 1:
                q, x = np.nonzero(np.triu(near(seeds, seeds), 1))
                if len(q):
                    pairs = list(zip(seeds[q].tolist(), seeds[x].tolist()))
                    good = yield pairs
                    link(pairs[k] for k in np.flatnonzero(good).tolist())
            continue
        asked = np.array(queue[at:at + width])
        at += len(asked)
        q, x = np.nonzero(near(asked, left))
        hits, pairs = 0, len(q)
        if pairs:
            good = yield list(zip(asked[q].tolist(), left[x].tolist()))
            q, x = q[good], x[good]
            hits = len(q)
            if hits:
                x, first, back = np.unique(x, return_index=True, return_inverse=True)
                lead, fresh = asked[q[first]], left[x]
                found += zip(lead.tolist(), fresh.tolist())
                tree[fresh] = tree[lead]
                link((int(asked[q[k]]), int(fresh[back[k]])) for k in np.flatnonzero(tree[asked[q]] != tree[fresh[back]]).tolist())
                queue += fresh.tolist()
                left = np.delete(left, x)
                # Lines of other trees that have still to ask do not find these among the left ones any more.
                waiting = np.array(queue[at:])
                if (tree[waiting] != tree[waiting[0]]).any():
                    q, x = np.nonzero(near(fresh, waiting) & (tree[fresh][:, None] != tree[waiting][None, :]))
                    if len(q):
                        cross = sorted({(min(a, b), max(a, b)) for a, b in zip(fresh[q].tolist(), waiting[x].tolist())})
                        good = yield cross
                        link(cross[k] for k in np.flatnonzero(good).tolist())
        # Where links are rare, more lines are asked at a time.
        width = 4 * width if 4 * hits <= pairs else max(1, width // 2)
        width = min(max(width, _WIDE // (len(left) + 1)), _ASKED // (len(left) + 1) + 1)
    return found


def _verify(batches: Iterator[pa.RecordBatch], radii: tuple[int, int], least: float) -> Iterator[pa.RecordBatch]:
    """Links within each run of equal ``unit, a, b`` in batches sorted by them."""
    def units():
        held, now = [], None
        for b in batches:
            names = zip(b.column("unit").to_pylist(), b.column("a").to_pylist(), b.column("b").to_pylist())
            for unit, *row in zip(names, strings(b.column("key")), b.column("fp").to_pylist(), strings(b.column("text")), b.column("kind").to_pylist()):
                if unit != now:
                    if len(held) > 1:
                        yield held
                    held, now = [], unit
                held.append(row)
        if len(held) > 1:
            yield held

    def links(rows, found):
        return pa.RecordBatch.from_arrays([pa.array([rows[x[side]][0] for x in found], pa.binary()) for side in (0, 1)], names=["u", "v"])

    coming, more, open_units = units(), True, []           # (rows, their search, the pairs it asks, characters)
    while more or open_units:
        asks, size = sum(len(x[2]) for x in open_units), sum(x[3] for x in open_units)
        while more and asks < _ASKED and size < _OPEN:
            rows = next(coming, None)
            if rows is None:
                more = False
                break
            search = _reach([r[2] for r in rows], np.array([r[1] for r in rows], dtype=np.int64).view(np.uint64), radii[rows[0][3]], least)
            try:
                open_units.append((rows, search, next(search), sum(len(r[2]) for r in rows)))
                asks, size = asks + len(open_units[-1][2]), size + open_units[-1][3]
            except StopIteration as done:
                if done.value:
                    yield links(rows, done.value)
        good = all_similar([(rows[a][2], rows[b][2]) for rows, _, asked, _ in open_units for a, b in asked], least)
        at, going = 0, []
        for rows, search, asked, chars in open_units:
            try:
                going.append((rows, search, search.send(good[at:at + len(asked)]), chars))
            except StopIteration as done:
                if done.value:
                    yield links(rows, done.value)
            at += len(asked)
        open_units = going


def _with_text(lines: DataFrame, docs: DataFrame) -> DataFrame:
    """``key, units, text``: lines that are in some unit, with the normalised text, read again from their first occurrence."""
    wanted = staged(lines.groupBy(F.col("first.id").alias("_wid"), F.col("first.text_hash").alias("_wth")).agg(
        F.collect_list(F.struct(F.col("first.line").alias("line"), "key", "units")).alias("lines")), "lines-wanted")
    # Rows with equal id and text hold the same lines: one of them is enough.
    rows = docs.join(wanted, docs["id"].eqNullSafe(wanted["_wid"]) & (docs["text_hash"] == wanted["_wth"])) \
        .select(F.explode(let(F.split("text", "\n"), lambda cut: F.transform("lines", lambda x: F.struct(
            x["key"].alias("key"), x["units"].alias("units"), F.get(cut, x["line"]).alias("text"))))).alias("x")).select("x.*")

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        i = b.schema.get_field_index("text")
        return b.set_column(i, "text", normalised(b.column(i)).cast(pa.string()))

    return map_arrow(rows, batch, rows.schema)


def line_groups(docs: DataFrame, radii: tuple[int, int] = RADII, least: float = SIMILARITY, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """(occurrences, ``key, keeper``): the occurrence that stays for every line that is not unique."""
    spark = docs.sparkSession
    parsed, parsed_at = staged_at(occurrences(docs), "lines-parsed")
    lines = staged(parsed.where(F.col("key").isNotNull()).drop("range", "pack"), "lines")
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash", "line")
    distinct = staged(lines.groupBy("key").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"),
                                               F.max("wfp").alias("wfp"), F.max("tfp").alias("tfp")), "lines-distinct")

    dealt = parsed.where(F.col("key").isNull()).select("range", "pack").repartition("range").sortWithinPartitions("range")
    met, met_at = staged_at(dealt.mapInArrow(lambda it: _once(_units(_unpacked(it), radii, tile)), "unit long, kind int, fp long"), "lines-met")
    discard(spark, parsed_at)
    met = met.distinct()
    kinds = F.explode(F.filter(F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(fp).alias("fp")) for kind, fp in enumerate(("wfp", "tfp"))]),
                               lambda x: x["fp"].isNotNull()))
    nodes = distinct.select("key", "first", kinds.alias("x")).select("key", "first", "x.*")
    inside = staged(nodes.join(met, ["kind", "fp"]), "lines-inside")
    discard(spark, met_at)
    sizes = inside.groupBy("unit").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    by_line = inside.join(sizes, "unit").groupBy("key").agg(F.first("first").alias("first"), F.collect_list(F.struct(
        "unit", "kind", "fp", F.ceil(F.col("size") / tile).cast("int").alias("tiles"))).alias("units"))
    texts = _with_text(by_line, docs).select("key", "text", F.explode("units").alias("x")).select("key", "text", "x.*")
    own = F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    units = (texts.withColumn("own", own).withColumn("other", other)
             .select("unit", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "key", "kind", "fp", "text")
             .repartition("unit", "a", "b").sortWithinPartitions("unit", "a", "b", "key"))
    found = staged(units.mapInArrow(lambda it: _verify(it, radii, least), "u binary, v binary"), "lines-verified")
    groups = connected_components(contracted(found)).withColumnRenamed("node", "key")
    repeated = distinct.join(groups, "key", "left").where((F.col("n") > 1) | F.col("component").isNotNull()) \
        .select("key", "first", F.coalesce("component", "key").alias("group"))
    keepers = repeated.groupBy("group").agg(F.min("first").alias("keeper"))
    return lines, staged(repeated.select("key", "group").join(keepers, "group").select("key", "keeper"), "lines-keepers")


def _cleaned(docs: DataFrame, **params) -> DataFrame:
    """``row`` (all columns, the text cleaned), ``lines`` (their number) and ``removed``."""
    marked = boxed(docs, id=F.col("doc_id").cast("long"), text_hash=F.xxhash64("text"), text=F.col("text"))
    lines, keepers = line_groups(marked.select("id", "text_hash", "text").where(F.col("text").isNotNull()), **params)
    kept = F.col("keeper")
    stays = kept["id"].eqNullSafe(F.col("id")) & (kept["text_hash"] == F.col("text_hash")) & (kept["line"] == F.col("line"))
    gone = staged(lines.join(keepers, "key").where(~stays).groupBy(
        F.col("id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).agg(F.collect_set("line").alias("gone")),
        "lines-removed")
    joined = marked.join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("text_hash") == F.col("gone_hash")), "left")
    none = F.array().cast("array<int>")
    gone_here = F.map_from_entries(F.transform(F.coalesce("gone", none), lambda i: F.struct(i.alias("k"), F.lit(True).alias("v"))))
    left = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(let(F.split("text", "\n"), lambda cut: F.get(
        F.transform(F.array(gone_here), lambda g: F.filter(cut, lambda x, i: F.element_at(g, i).isNull())), F.lit(0))), "\n"))
    return joined.select(F.col("row").withField("text", left).alias("row"),
                         F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("lines"),
                         F.coalesce(F.size(F.coalesce("gone", none)), F.lit(0)).cast("long").alias("removed"))


def dedup_lines(docs: DataFrame, **params) -> DataFrame:
    """The documents with cleaned ``text``, their number of lines as ``_lines`` and how many went as ``_removed``
    (with more underscores if the table has such columns)."""
    names = []
    for name in ("_lines", "_removed"):
        while name in docs.columns:
            name = "_" + name
        names.append(name)
    return _cleaned(docs, **params).select("row.*", F.col("lines").alias(names[0]), F.col("removed").alias(names[1]))


def line_table(docs: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_removed, text`` with the cleaned text."""
    return _cleaned(docs.select("doc_id", "text")).select(
        "row.doc_id", F.when(F.col("row.text").isNull(), F.lit(0).cast("long")).otherwise(F.col("lines")).alias("n_lines"),
        F.col("removed").alias("n_removed"), "row.text")
