"""SimHash near-dedup against brute force."""

import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from peakscreen.llm import bitslice, simhash_dedup as sd

SCHEMA = "doc_id long, text string, lang string, source string, fp string"


def slow_fingerprint(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    sh = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hs) > len(hs))


def slow_components(rows, radius=4):
    fps = [slow_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (fps[i] ^ fps[j]).bit_count() <= radius and label[j] != label[i]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    low = {}
    for (d, _), lab in zip(rows, label):
        if d is not None:
            low[lab] = min(low.get(lab, d), d)
    return sorted(((d, format(f, "016x"), low.get(lab)) for (d, _), f, lab in zip(rows, fps, label)), key=str)


def test_query_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    vocab = ["Wort", "été", "the", "of", "X1", "straße", "data", "中", "end."]
    base = [" ".join(rng.choice(vocab, size=int(n))) for n in (3, 4, 30, 60, 90, 40)]
    near = [b.replace("the", "tha", 1) + " Wort" for b in base]
    texts = [None, "", " \t\n", "One", *base, *near, base[2], base[2].upper(), "w " * 30000, "a\x0bb\x1cc d e f"]
    rows = [(i * 3 % 31, t) for i, t in enumerate(texts)] + [(None, base[3]), (None, "alone is this text now here"), (7, base[4]), (7, base[4])]
    df = spark.createDataFrame([(d, t, "en", "s", "x") for d, t in rows], SCHEMA)
    got = sorted(map(tuple, sd.dedup_table(df).collect()), key=str)
    assert got == slow_components(rows)
    kept = sd.keep_one(df).collect()
    assert len(kept) == len({r[2] if r[2] is not None else r[1] for r in got})
    assert sd.keep_one(df).columns == df.columns
    assert sd.dedup_table(df.where("false")).collect() == []
    assert sd.keep_one(df.where("false")).collect() == []


@pytest.mark.parametrize("radius", [1, 3, 4, 7])
def test_within_counts_bits(radius):
    rng = np.random.default_rng(radius)
    fps = rng.integers(0, 1 << 63, size=130, dtype=np.uint64)
    for i in range(1, 130, 2):
        for b in rng.choice(64, size=int(rng.integers(0, 9)), replace=False):
            fps[i] = fps[i - 1] ^ np.uint64(1 << int(b)) if b % 2 else fps[i] ^ np.uint64(1 << int(b))
    p, used = bitslice.planes(fps)
    for q in fps:
        got = bitslice.within(p, np.full(len(p), q), used, radius)
        _, lane = np.nonzero(np.unpackbits(got.view(np.uint8), bitorder="little").reshape(1, -1))
        want = [i for i, f in enumerate(fps) if (int(f) ^ int(q)).bit_count() <= radius]
        assert lane.tolist() == want


def chain(n, rng):
    """Each fingerprint is 1 to 3 bits from an earlier one, plus strangers."""
    out = [int(x) for x in rng.integers(0, 1 << 63, size=3, dtype=np.uint64)]
    while len(out) < n:
        f = out[int(rng.integers(len(out)))]
        for b in rng.choice(64, size=int(rng.integers(1, 4)), replace=False):
            f ^= 1 << int(b)
        out.append(f)
    return out


def test_links_connect_as_all_pairs_do(spark):
    """Also with keys cut into tiles of 70 and buckets above 64 lanes."""
    rng = np.random.default_rng(5)
    fps = sorted(set(chain(260, rng) + [int(x) for x in rng.integers(0, 1 << 63, size=40, dtype=np.uint64)]))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")

    def groups(edges):
        at = {f: i for i, f in enumerate(signed)}
        a = np.array([at[u] for u, _ in edges], dtype=int)
        b = np.array([at[v] for _, v in edges], dtype=int)
        return bitslice.local_components(len(signed), a, b).tolist()

    pairs = [(signed[i], signed[j]) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    want = groups(pairs)
    for tile in (70, 1 << 14):
        got = [tuple(r) for r in sd.links(df, tile=tile).collect()]
        assert all((u ^ v) & ((1 << 64) - 1) for u, v in got)
        assert groups(got) == want
    # A far smaller key makes large buckets: the breadth-first search must agree.
    a, b = bitslice.link_large(np.array(fps, dtype=np.uint64), 4)
    assert bitslice.local_components(len(fps), a, b).tolist() == want


def test_large_bucket_joins_trees_of_different_seeds():
    """s1-r1-r2-s2: r1 and r2 are reached in one round, each from its own seed."""
    rng = np.random.default_rng(11)
    for links, fillers in ((3, 80), (6, 80), (40, 300), (200, 10)):
        fps = [int(x) for x in rng.integers(0, 1 << 63, size=fillers, dtype=np.uint64)]
        # Sparse chains: neighbours differ in 4 bits, in one bit of each of four bytes.
        for _ in range(3):
            path = [int(rng.integers(0, 1 << 63, dtype=np.uint64))]
            for i in range(links):
                path.append(path[-1] ^ sum(1 << (8 * int(k) + int(rng.integers(8)))
                                           for k in rng.choice(8, size=4, replace=False)))
            # Ends first: they are seeds of their own.
            fps = path[:1] + path[-1:] + fps + path[1:-1]
        fps = list(dict.fromkeys(fps))
        pairs = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
        want = bitslice.local_components(len(fps), *np.array(pairs).T).tolist()
        a, b = bitslice.link_large(np.array(fps, dtype=np.uint64), 4)
        assert bitslice.local_components(len(fps), a, b).tolist() == want


def signed(fps):
    return [f - (1 << 64) if f >> 63 else f for f in fps]


def test_tiles_keep_their_size_however_batches_fall():
    """Batches of 7 do not divide a tile of 16: no tile is larger, and a unit to stay whole is never cut."""
    fps = signed([int(x) for x in np.random.default_rng(2).integers(0, 1 << 63, size=90, dtype=np.uint64)])
    table = pa.table({"fp": pa.array(fps, pa.int64()), "key": pa.array([1] * 5 + [2] * 69 + [3] * 16, pa.int64())})
    rows = pa.Table.from_batches(sd._link_sorted(iter(table.to_batches(max_chunksize=7)), 4, 16, ["key"])).to_pylist()
    sizes = {}
    for r in rows:
        if r["tile"] >= 0:
            sizes[r["key"], r["tile"]] = sizes.get((r["key"], r["tile"]), 0) + 1
    assert sizes == {(2, 0): 16, (2, 1): 16, (2, 2): 16, (2, 3): 16, (2, 4): 5, (3, 0): 16}
    with pytest.raises(ValueError, match="whole"):
        list(sd._link_sorted(iter(table.to_batches(max_chunksize=7)), 4, 68, ["key"], whole=True))
    list(sd._link_sorted(iter(table.to_batches(max_chunksize=7)), 4, 69, ["key"], whole=True))


def test_links_between_tiles_with_batches_that_do_not_divide_them(spark):
    """One key of 420 strangers and 30 chains; every chain has to be found across the tiles of 70."""
    rng = np.random.default_rng(9)
    # The low 32 bits are equal: with 6 blocks at radius 4, all share the keys of the blocks in there.
    fps = [int(x) << 32 for x in rng.integers(0, 1 << 31, size=420, dtype=np.uint64)]
    for f in list(fps[:30]):
        for _ in range(4):
            f ^= sum(1 << int(k) for k in rng.choice(np.arange(32, 64), size=4, replace=False))
            fps.append(f)
    fps = list(dict.fromkeys(fps))
    rng.shuffle(fps)
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    want = bitslice.local_components(len(fps), *np.array(pairs).T).tolist()
    at = {f: i for i, f in enumerate(signed(fps))}
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "60")
    try:
        df = spark.createDataFrame([(f,) for f in at], "fp long").coalesce(1)
        got = sd.links(df, tile=70).collect()
    finally:
        spark.conf.set(name, before)
    a, b = np.array([(at[u], at[v]) for u, v in got]).T
    assert bitslice.local_components(len(fps), a, b).tolist() == want
