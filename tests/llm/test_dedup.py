"""Window, suffix and SimHash dedup against brute force, on sampled and odd documents."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

from ledgerloom.llm import common, simhash, suffixes, windows
from ledgerloom.llm.common import pack_bits, pack_longs, pack_sorted, runs_hash, unpack_bits, unpack_longs, unpack_sorted

INF = float("inf")


def by_id(rows):
    return sorted(rows, key=lambda r: INF if r[0] is None else r[0])


def brute_windows(rows, width):
    first, out = {}, []
    docs = [(INF if i is None else i, (t or "").encode().split()) for i, t, *_ in by_id(rows)]
    for i, w in docs:
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            first[key] = min(first.get(key, (INF, INF)), (i, k))
    for (i, w), (raw, *_) in zip(docs, by_id(rows)):
        gone = set()
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < (i, k):
                gone.update(range(k, k + width))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((raw, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def brute_strings(rows, width):
    out, earlier, now, last = [], set(), set(), None
    for i, t, *_ in by_id(rows):
        b = (t or "").encode()
        if i != last or i is None and last is not None:
            earlier |= now
            now = set()
        last = i
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - width + 1):
            s = b[k : k + width]
            now.add(s)
            if s in earlier:
                gone[k : k + width] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def brute_classes(rows, roots=False):
    def mark(t):
        w = (t or "").encode().lower().split()
        if not w:
            return 0
        parts = [b" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))]
        hs = [xxhash.xxh64_intdigest(p, seed=42) for p in parts]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    marks = [mark(t) for _, t, *_ in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (marks[a] ^ marks[b]).bit_count() <= 4:
                up[root(a)] = root(b)
    low = {}
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            low[root(k)] = min(low.get(root(k), i), i)
    out = [(r[0], f"{m:016x}", low.get(root(k))) for k, (r, m) in enumerate(zip(rows, marks))]
    return [(*x, root(k)) for k, x in enumerate(out)] if roots else out


def same(df, want):
    got = sorted(map(repr, map(tuple, df.collect())))
    assert got == sorted(map(repr, want))


def mixed_rows(rows, odd, seed=3):
    """Texts that share passages, some shifted, some within one text."""
    rng = random.Random(seed)
    out = list(odd)
    for n in range(60):
        a, b = rng.choice(rows)[1].split(), rng.choice(rows)[1].split()
        cut = rng.randint(0, len(a))
        out.append((1000 + n, " ".join(a[cut : cut + 60] + b[:40] + a[cut : cut + 30]), "en", "a"))
    return out


@pytest.fixture(params=[1, 4])
def blocks(request, monkeypatch, make_docs, sample_rows, odd_rows):
    """Runs a test in one block, then in several."""
    monkeypatch.setattr(common, "BLOCK_BYTES", 1 << 16 if request.param > 1 else 4 << 20)
    assert common.layout(make_docs(mixed_rows(sample_rows, [r for r in odd_rows if r[0] not in (11, 12)]))).blocks >= request.param
    return request.param


def tied_rows():
    """Several different texts for each id and without one, which share passages at different places."""
    rng = random.Random(9)
    shared = [" ".join(f"{c}{k}" for k in range(30)) for c in "abcdef"]
    rows = []
    for n in range(240):
        parts = [f"own{n}x{k}" for k in range(rng.randint(0, 12))]
        parts += [x for _ in range(3) for x in (rng.choice(shared), f"mid{n}")]
        rows.append((None if n % 4 == 0 else n % 9, " ".join(parts), "en", "a"))
    return rows


@pytest.mark.parametrize("kind", ["windows", "strings"])
def test_tied_ids_in_many_partitions(monkeypatch, make_docs, kind):
    rows = tied_rows()
    for size in (1 << 14, 4 << 20):
        monkeypatch.setattr(common, "BLOCK_BYTES", size)
        docs = make_docs(rows, clashing=True).repartition(13, "text")
        if kind == "windows":
            same(windows.window_digest(docs), brute_windows(rows, 20))
        else:
            same(suffixes.string_digest(docs), brute_strings(rows, 50))
    plan = common.Layout(len(rows), 0, 8, 8)
    per = [r["count"] for r in common.in_blocks(docs.where("doc_id IS NULL"), plan).groupBy("block").count().collect()]
    assert len(per) > 4


def test_arrival_order_does_not_number_a_block():
    import pyarrow as pa

    rows = [(7 if i is None or i > 4 else None, t) for i, t, *_ in tied_rows()][:40]
    tables = [pa.table({"doc_id": pa.array([r[0] for r in x], pa.int64()), "text": [r[1] for r in x]}) for x in (rows, rows[::-1])]
    one, two = (suffixes.BlockSuffixes(t, 50, 26, 40).stretches(50) for t in tables)
    assert one[0] == two[0] and all((a == b).all() for a, b in zip(one[1:], two[1:]))
    one, two = (windows.BlockWindows(t, 20, common.WordKeys(b"k")) for t in tables)
    assert (one.hash == two.hash).all() and (one.at == two.at).all() and (one.ids == two.ids).all()


@pytest.mark.parametrize("width", [20, 5])
def test_windows_are_those_of_brute_force(blocks, make_docs, sample_rows, odd_rows, width):
    rows = mixed_rows(sample_rows, odd_rows)
    same(windows.window_digest(make_docs(rows, clashing=True), width), brute_windows(rows, width))


@pytest.mark.parametrize("hot_blocks", [suffixes.HOT_BLOCKS, 1, 0])
def test_strings_are_those_of_brute_force(blocks, make_docs, sample_rows, odd_rows, hot_blocks):
    rows = [r for r in mixed_rows(sample_rows, odd_rows) if r[0] not in (11, 12)] + [(11, "long text " * 900, "de", "b"), (12, "long text " * 901, "de", "b")]
    found = suffixes.remove_repeated_strings(make_docs(rows, clashing=True), hot_blocks=hot_blocks)
    same(found.drop("kept"), brute_strings(rows, 50))


def test_classes_are_those_of_brute_force(make_docs, sample_rows, odd_rows):
    rows = sample_rows + [(5000 + i, t.replace(" the ", " a ", 1), *r) for i, t, *r in sample_rows[:60]] + odd_rows
    same(simhash.near_duplicates(make_docs(rows, clashing=True)), brute_classes(rows))


def test_one_of_each_component_stays(make_docs, sample_rows, odd_rows):
    rows = sample_rows + odd_rows
    kept = simhash.one_of_each(make_docs(rows, clashing=True))
    want = sorted(i for i, _ in {(i, root) for i, _, c, root in brute_classes(rows, roots=True) if i is not None and i == c})
    got = [r.doc_id for r in kept.collect()]
    assert sorted(x for x in got if x is not None) == want and got.count(None) == 2
    assert kept.columns == make_docs(rows, clashing=True).columns


@pytest.mark.parametrize("bits,tile", [(4, 4096), (4, 50)])
def test_tree_and_tiles_link_what_brute_force_links(spark, monkeypatch, bits, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = random.Random(1)
    values = {rng.getrandbits(64) for _ in range(300)}
    for v in list(values)[:120]:
        for _ in range(3):
            v ^= 1 << rng.randrange(64)
            values.add(v ^ (1 << rng.randrange(64)))
    hub = rng.getrandbits(64)
    values |= {hub ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(a)}
    values = sorted(values)
    array = np.array(values, np.uint64)
    tree = simhash.GrayTree(array)
    i, j = tree.within(0, len(values), bits)
    got = {(int(tree.values[a]), int(tree.values[b])) for a, b in zip(i, j) if a != b}
    assert got == {(a, b) for a in values for b in values if a != b and (a ^ b).bit_count() <= bits}
    signed = array.view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.local_links(df, len(values), bits)).collect()}
    value, low = simhash.smallest_linked(array, bits)
    want = dict(zip(value.tolist(), low.tolist()))
    assert {v: roots.get(v, v) for v in signed} == want


def test_chain_of_links_is_one_component(spark):
    links = spark.createDataFrame([(k + 1, k) for k in range(40)] + [(100, 99)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(links).collect()}
    assert got == {**{k: 0 for k in range(1, 41)}, 100: 99}


def test_empty_tables(make_docs):
    none = make_docs([])
    for report in (windows.window_digest, suffixes.string_digest, simhash.near_duplicates, simhash.one_of_each):
        assert report(none).collect() == []


def test_suffix_order_is_the_sorted_one():
    rng = random.Random(4)
    text = "".join(rng.choice("ab") for _ in range(200)) * 3 + "a" * 120 + "".join(rng.choice("abc") for _ in range(300))
    pool = np.frombuffer(text.encode(), np.uint8)
    starts = np.arange(len(pool) - 49)
    order, group = suffixes.deep_shallow(suffixes.symbols(pool), starts)
    strings = [text[s : s + 50] for s in starts]
    ranked = [strings[k] for k in order]
    assert ranked == sorted(strings)
    for k in range(1, len(ranked)):
        assert (group[k] == group[k - 1]) == (ranked[k] == ranked[k - 1])


def test_word_values_tell_words_apart():
    rng = random.Random(8)
    words = {bytes(rng.choice(b"ab\x00\xff") for _ in range(n)) for n in (*range(1, 20), *range(60, 70), 200) for _ in range(60)}
    words = sorted(w for w in words if w.split() == [w])
    for lead in (b"", b"x ", b"\n\n\n"):
        data = np.frombuffer(lead + b" ".join(words), np.uint8)
        got = common.words_of(data, np.array([0, len(data)]), common.WordKeys(b"secret"))
        value, other = (x[1 if lead == b"x " else 0 :].tolist() for x in (got.value, got.other))
        assert len(value) == len(words) == len(set(value)) == len(set(other))
        if not lead:
            first = value, other
        assert (value, other) == first
    assert common.words_of(data, np.array([0, len(data)]), common.WordKeys(b"another")).value.tolist() != value


def test_words_that_polynomials_confuse_stay(make_docs):
    turns = "ab"
    for _ in range(9):
        turns += turns.translate({97: "b", 98: "a"})
    mirror = turns.translate({97: "b", 98: "a"})
    lead = " ".join(f"w{k}" for k in range(19))
    rows = [(1, f"{lead} {turns}", "en", "a"), (2, f"{lead} {mirror}", "en", "a"), (3, f"{turns} {mirror} " * 15, "en", "a")]
    rows += [(4, " ".join({"a": turns, "b": mirror}[c] for c in turns[:64]), "en", "a"), (5, " ".join({"a": turns, "b": mirror}[c] for c in mirror[:64]), "en", "a")]
    same(windows.window_digest(make_docs(rows)), brute_windows(rows, 20))


@pytest.mark.parametrize("offset", range(14, 50))
def test_tries_split_on_complementary_bytes(offset):
    rng = random.Random(offset)
    strings = []
    for x in (0, 1, 127, 254):
        tail = bytes(rng.randrange(256) for _ in range(49 - offset))
        for first, rest in ((x, bytes(49 - offset)), (x + 1, b"\xff" * (49 - offset)), (x, tail), (x + 1, bytes(255 - c for c in tail))):
            strings.append(b"p" * offset + bytes([first]) + rest)
    pool = np.frombuffer(b"".join(strings), np.uint8)
    order, group = suffixes.deep_shallow(suffixes.symbols(pool), np.arange(len(strings)) * 50)
    ranked = [strings[k] for k in order]
    assert ranked == sorted(strings)
    assert [bool(group[k] == group[k - 1]) for k in range(1, len(ranked))] == [a == b for a, b in zip(ranked[1:], ranked)]


def test_texts_that_differ_by_all_bits_end(make_docs):
    common = "the same forty-one bytes before they differ"[:41]
    rows = [(2 * k + j, f"{k:02d} {common}" + tail * 12, "en", "a") for k in range(20) for j, tail in enumerate(("\u00e9", "<V"))]
    same(suffixes.string_digest(make_docs(rows)), brute_strings(rows, 50))


def test_packing_keeps_values():
    rng = np.random.default_rng(1)
    values = np.unique(rng.integers(0, 1 << 63, 1000).astype(np.uint64))
    assert (unpack_sorted(pack_sorted(values)) == values).all() and len(unpack_sorted(pack_sorted(values[:0]))) == 0
    signed = rng.integers(-(1 << 62), 1 << 62, 100)
    assert (unpack_longs(pack_longs(signed)) == signed).all()
    flags = rng.random(77) < 0.5
    assert (unpack_bits(pack_bits(flags)) == flags).all()
    for width in (1, 5, 20, 26):
        hashes = runs_hash(values, width)
        assert len(hashes) == len(values) - width + 1 and hashes[7] == runs_hash(values[7 : 7 + width], width)[0]
