"""Fuzzy line dedup against brute force."""

import numpy as np
import pyarrow as pa

from peakscreen.llm import components
from peakscreen.llm import line_dedup as ld

SCHEMA = "doc_id long, text string, line string"


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_edit_distance():
    rng = np.random.default_rng(3)
    for _ in range(300):
        a, b = ("".join(rng.choice(list("abé "), size=int(rng.integers(0, 40)))) for _ in range(2))
        assert ld.edit_distance(a, b) == slow_distance(a, b)
    for _ in range(300):
        a, b = ("".join(rng.choice(list("abé "), size=int(rng.integers(0, 40)))) for _ in range(2))
        most = int(rng.integers(0, 30))
        assert min(ld.edit_distance(a, b, most), most + 1) == min(slow_distance(a, b), most + 1)
    long = "ab c" * 5000
    assert ld.edit_distance(long, long[:-1] + "xy") == 2


def slow(rows, least):
    """Cleaned text per row, by edit similarity alone."""
    occ = []
    for d, t in dict.fromkeys(rows):
        for i, x in enumerate(t.split("\n") if t is not None else []):
            n = ld.normalise(x)
            if n:
                occ.append(((d is None, d if d is not None else 0), t, i, n))
    keys = sorted({o[3] for o in occ})
    group = list(range(len(keys)))
    changed = True
    while changed:
        changed = False
        for i in range(len(keys)):
            for j in range(i):
                if group[i] != group[j] and ld.similar(keys[i], keys[j], least):
                    group[i] = group[j] = min(group[i], group[j])
                    changed = True
    first = {}
    for pos, t, i, n in occ:
        g = group[keys.index(n)]
        first[g] = min(first.get(g, (pos, i, t)), (pos, i, t))
    out = []
    for d, t in rows:
        if t is None:
            out.append((d, None))
            continue
        pos = (d is None, d if d is not None else 0)
        stay = [x for i, x in enumerate(t.split("\n"))
                if not ld.normalise(x) or first[group[keys.index(ld.normalise(x))]] == (pos, i, t)]
        out.append((d, "\n".join(stay)))
    return sorted(out, key=str)


def test_matches_brute_force(spark):
    rng = np.random.default_rng(8)
    vocab = [f"w{c}{d}" for c in "abcdefgh" for d in "xyzé"]
    base = [" ".join(rng.choice(vocab, size=int(n))) for n in (6, 12, 40, 60, 80)]
    lines = [*base, "Page 17", "page 4!", "---", "", " ", "of", "ok ok"]
    for b in base * 3:
        w = b.split()
        w[int(rng.integers(len(w)))] += "q"
        lines.append(" ".join(w))
    texts = ["\n".join(rng.choice(lines, size=int(rng.integers(1, 9)))) for _ in range(40)] + [None, "", "\n\n", "x " * 20000 + "\nof"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[4]), (None, "only here now")]
    df = spark.createDataFrame([(d, t, "extra") for d, t in rows], SCHEMA)
    for tile in (ld.TILE, 3):
        got = sorted(((r["doc_id"], r["text"]) for r in ld.dedup_lines(df, tile=tile).collect()), key=str)
        assert got == slow(rows, ld.SIMILARITY)
    r = {x["doc_id"]: x for x in ld.line_table(df.where("doc_id >= 40")).collect()}
    assert (r[40]["n_lines"], r[40]["text"]) == (0, None)
    assert (r[41]["n_lines"], r[41]["text"]) == (1, "")
    assert ld.line_table(df.where("false")).collect() == []


def test_clashing_names_and_many_lines(spark):
    """Columns of our names stay; a document of 20,000 lines is split once."""
    long = "\n".join(f"line number {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)} of the book" for i in range(20_000))
    rows = [(1, long, 7, "h"), (2, "line number aaa of the book\nsomething else entirely here", 8, "i"), (3, None, 9, "j")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _lines int, _text_hash string")
    out = {r.doc_id: r for r in ld.dedup_lines(df).collect()}
    assert [(out[i]._lines, out[i]._text_hash) for i in (1, 2, 3)] == [(7, "h"), (8, "i"), (9, "j")]
    assert out[2].text == "something else entirely here" and out[2]["_removed"] == 1 and out[1]["__lines"] == 20_000


def test_contracted_edges_keep_their_components(spark):
    import random
    rng = random.Random(1)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(i, i + 1) for i in range(500, 700)]
    df = spark.createDataFrame(pairs, "u long, v long")
    plain = {tuple(r) for r in components.connected_components(df).collect()}
    assert plain == {tuple(r) for r in components.connected_components(components.contracted(df, 40)).collect()}


def meets(a, b):
    """Which pairs of lines share a block and lie within the radius in one kind of features."""
    left, right = (ld.sketches(pa.array(x)).to_pylist() for x in (a, b))
    return np.array([any(x[f] is not None and y[f] is not None and any(p == q for p, q in zip(x[k], y[k]))
                         and ((x[f] ^ y[f]) & (2 ** 64 - 1)).bit_count() <= most for f, k, most in (("wfp", "wkeys", ld.RADII[0]), ("tfp", "tkeys", ld.RADII[1])))
                     for x, y in zip(left, right)])


def changed_pairs(rng, vocab, n, how, count=400):
    """Lines of ``n`` words and a changed line each, edit similarity of at least 0.8."""
    out = []
    while len(out) < count:
        w = list(rng.choice(vocab, size=n))
        a = " ".join(w)
        if how != "typos":
            for i in rng.permutation(n)[:1 if how == "word" else n // 6]:
                w[int(i)] = str(rng.choice(vocab))
            b = " ".join(w)
        else:
            chars = list(a)
            for _ in range(max(1, len(a) // 40)):
                chars[int(rng.integers(len(chars)))] = "q"
            b = "".join(chars)
        b = ld.normalise(b)
        if a != b and ld.similar(a, b):
            out.append((a, b))
    return [x for x, _ in out], [y for _, y in out]


def vocabulary(rng):
    return np.array(sorted({"".join(rng.choice(list("abcdefghijklmnoprstuvwz"), size=int(rng.integers(3, 10)))) for _ in range(3000)}))


def test_recall_by_length():
    """Share of pairs at edit similarity 0.8 or more that meet, by words in the line."""
    rng = np.random.default_rng(17)
    vocab = vocabulary(rng)
    got = {(how, n): round(float(meets(*changed_pairs(rng, vocab, n, how)).mean()), 4)
           for how in ("word", "typos", "a sixth of the words") for n in (4, 6, 8, 10, 11, 15, 20, 40, 60) if n > 5 or how != "a sixth of the words"}
    print(got)
    assert min(got.values()) >= 0.9


def test_sketches_of_odd_lines():
    rng = np.random.default_rng(2)
    lines = ["a", "é", "0", "ab", "a b c d e f", " ".join(["x"] * 40), "中文", " ".join(rng.choice(list("abcdefg"), 5000))]
    got = ld.sketches(pa.array(lines)).to_pylist()
    assert all((x["wfp"] is None) == (len(t.split(" ")) < ld.LONG) and (x["tfp"] is None) == (len(t.split(" ")) > ld.SHORT) for x, t in zip(got, lines))
    # A line's sketch does not depend on its neighbours.
    assert [ld.sketches(pa.array([t])).to_pylist()[0] for t in lines] == got
    assert len(ld.sketches(pa.array([], pa.string()))) == 0


def test_large_blocks_pass_whole():
    rng = np.random.default_rng(5)
    key = np.sort(np.concatenate([np.full(300, 7), np.full(90, 9), rng.integers(20, 60, 80)])).astype(np.int64)
    fp = np.where(rng.random(len(key)) < .5, 0, rng.integers(0, 1 << 62, len(key)))
    table = pa.table({"key": key, "kind": pa.array(np.zeros(len(key), np.int32)), "fp": fp.astype(np.int64)})
    results = []
    for size in (1000, 37, 5):
        out = [r for b in ld._units(iter(table.to_batches(max_chunksize=size)), (3, 3), 100) for r in b.to_pylist()]
        results.append(sorted((r["unit"], r["fp"]) for r in out))
    assert results[0] == results[1] == results[2]
    assert sum(u == 7 for u, _ in results[0]) == 300


def test_aligned_cost_bounds_the_distance():
    rng = np.random.default_rng(6)
    vocab = list(vocabulary(rng)[:40])
    for _ in range(400):
        w = list(rng.choice(vocab, size=int(rng.integers(1, 15))))
        v = list(w)
        for _ in range(int(rng.integers(0, 4))):
            at = int(rng.integers(len(v) + 1))
            v[at:at + int(rng.integers(0, 3))] = list(rng.choice(vocab, size=int(rng.integers(0, 3))))
        a, b = " ".join(w), " ".join(v)
        assert ld.aligned_cost(a, b) >= slow_distance(a, b)
        assert ld.similar(a, b) == (max(len(a), len(b)) - slow_distance(a, b) >= 0.8 * max(len(a), len(b)))
    assert ld.aligned_cost("a b c d", "a b x c d") == 2 and ld.aligned_cost("a b", "a b") == 0


def edited(rng, text, edits):
    chars = list(text)
    for _ in range(edits):
        at, how = int(rng.integers(len(chars) + 1)), int(rng.integers(3))
        if how == 0 or at == len(chars):
            chars.insert(at, str(rng.choice(list("abé 中😀"))))
        elif how == 1:
            del chars[at]
        else:
            chars[at] = str(rng.choice(list("abcé ")))
    return "".join(chars)


def test_many_pairs_at_a_time():
    """Pairs verified together give what each gives alone: odd characters, empty and very long lines, few pairs."""
    rng = np.random.default_rng(9)
    pairs = []
    for _ in range(3000):
        a = "".join(rng.choice(list("abcdé 😀"), size=int(rng.choice([0, 1, 2, 3, 8, 20, 60, 200]))))
        pairs.append((a, edited(rng, a, int(rng.integers(0, max(2, len(a) // 3))))))
    pairs += [("ab c" * 2000, "ab c" * 1999 + "xy"), ("q" * 5000, "r" * 5000), ("", "")]
    for least in (0.5, ld.SIMILARITY, 0.9, 1.0):
        longer = [max(map(len, p)) for p in pairs]
        slow = [n - ld.edit_distance(a, b) >= least * n for (a, b), n in zip(pairs, longer)]
        assert ld.all_similar(pairs, least).tolist() == slow
        assert [bool(ld.all_similar([p], least)[0]) for p in pairs[:200]] == slow[:200]
    assert ld.all_similar([]).tolist() == []


def test_large_unit_of_lines_in_radius():
    """300 lines of one SimHash, each like one other: the links connect what all pairs connect, in few calls."""
    rng = np.random.default_rng(10)
    vocab = list(vocabulary(rng))
    base = [" ".join(rng.choice(vocab, size=12)) for _ in range(150)]
    texts = base + [edited(rng, b, 3) for b in base]
    calls, real = [], ld.all_similar
    rows = [(b"%03d" % k, 5, t, 0) for k, t in enumerate(texts)]
    batch = pa.table({"unit": pa.array([1] * 300, pa.int64()), "a": pa.array([0] * 300, pa.int32()), "b": pa.array([0] * 300, pa.int32()),
                      "key": [r[0] for r in rows], "fp": pa.array([5] * 300, pa.int64()), "text": texts, "kind": pa.array([0] * 300, pa.int32())})
    ld.all_similar = lambda pairs, least: calls.append(len(pairs)) or real(pairs, least)
    try:
        out = [(int(r["u"]), int(r["v"])) for size in (300, 64) for b in ld._verify(iter(batch.to_batches(size)), (0, 0), ld.SIMILARITY) for r in b.to_pylist()]
    finally:
        ld.all_similar = real
    assert {(min(e), max(e)) for e in out} == {(k, k + 150) for k in range(150)}
    assert len(calls) < 2 * 60


def test_trees_that_grow_together_keep_their_links():
    """Whatever lines are similar, the search connects what all pairs connect."""
    rng = np.random.default_rng(12)
    for _ in range(400):
        n = int(rng.integers(2, 60))
        like = np.triu(rng.random((n, n)) < rng.choice([0.0, 0.5, 1.0, 2.0, 4.0]) / n, 1)
        like |= like.T
        search = ld._reach(["x"] * n, np.zeros(n, dtype=np.uint64), 0, ld.SIMILARITY)
        answer = None
        try:
            while True:
                asked = search.send(answer)
                answer = np.array([like[a, b] for a, b in asked], dtype=bool)
        except StopIteration as done:
            found = done.value
        assert all(like[a, b] for a, b in found)
        label = [ld.bitslice.local_components(n, *np.array(e, dtype=np.int64).reshape(-1, 2).T).tolist() for e in (found, np.argwhere(like))]
        assert label[0] == label[1]
