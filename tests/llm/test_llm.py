"""The operators against brute-force versions on small tables, and their defined results for odd rows."""

import collections
import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, cls string, part string, packed string, fold string, rank string, key string"
WORDS = "el gato negro come pan con queso y bebe agua en la casa roja del pueblo viejo mientras llueve mucho sobre los campos verdes de trigo".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS, n)) if n else ""


def table(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, lang, src, len(t or ""), "x", "x", "x", "x", "x", "x") for i, t, lang, src in rows], DOCS)


@pytest.fixture(scope="module")
def corpus():
    """Exact and near copies, shared passages, nulls, blanks, one long text, and a source with most rows."""
    rng = np.random.default_rng(1)
    rows, passage = [], prose(rng, 60)
    for i in range(120):
        t = prose(rng, int(rng.integers(1, 160)))
        if i % 5 == 1 and rows:
            t = rows[int(rng.integers(len(rows)))][1]
        elif i % 5 == 2 and rows:
            w = (rows[int(rng.integers(len(rows)))][1] or "").split()
            for j in rng.integers(0, max(len(w), 1), 2):
                if w:
                    w[j] = str(rng.choice(WORDS))
            t = " ".join(w)
        elif i % 5 == 3:
            t = f"{prose(rng, 10)} {passage} {prose(rng, 20)}"
        rows.append((int(i * 3 % 121), t, ["en", "de"][i % 2], "hot" if i % 3 else f"s{i % 7}"))
    rows += [(500, None, None, None), (501, "", "en", "hot"), (502, " \t\n\x0b ", "en", None), (503, "uno", "en", "a"), (504, "Ñandú\u00a0é  dos\x0btres", "es", "a"), (505, prose(rng, 30_000), "en", "hot"), (506, "uno", "en", "b")]
    return rows


def split(t):
    return [w for w in re.split("[\x20\x09-\x0d]+", t or "") if w]


def lower(t):
    return (t or "").translate({i: i + 32 for i in range(65, 91)})


def shingles(t, k):
    w = split(lower(t))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


def components_of(nodes, links):
    low = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low


def jaccard_truth(rows, k, percent):
    sets = {i: shingles(t, k) for i, t, *_ in rows}
    links = []
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    links.append((a, b))
    return {i: (len(sets[i]), c) for i, c in components_of(sets, links).items()}


@pytest.mark.parametrize("k, percent", [(3, 90), (5, 80), (2, 50)])
def test_jaccard_components_equal_brute_force(spark, corpus, k, percent):
    from kindred.llm.ngram_join import jaccard_components

    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(table(spark, corpus), k, percent).collect()}
    assert got == jaccard_truth(corpus, k, percent)


def test_jaccard_chain_of_near_copies_in_small_tiles(spark, monkeypatch):
    from kindred.llm import ngram_join

    monkeypatch.setattr(ngram_join, "TILE", 3)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*(f"n{j}" for j in range(i)), *words[i:]]), "en", "s") for i in range(25)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(table(spark, rows), 3, 80).collect()}
    assert got == jaccard_truth(rows, 3, 80)


@pytest.mark.parametrize("percent", [50, 60, 75, 90])
def test_jaccard_keys_meet_at_the_limit(percent):
    """Nested sets whose similarity is the least that links share a key, whatever bands they fall in."""
    from kindred.llm.ngram_join import bands, block_keys

    rng = np.random.default_rng(11)
    plan = bands(percent)
    for _ in range(60):
        n = int(rng.integers(1, 200))
        whole = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        part = np.sort(rng.choice(whole, -(-len(whole) * percent // 100), replace=False))
        keys, owner = block_keys(np.concatenate([part, whole]), np.array([0, len(part), len(part) + len(whole)]), np.array([len(part), len(whole)]), np.array([0, 1]), plan, percent)
        if len(part) < len(whole):
            assert set(keys[owner == 0]) & set(keys[owner == 1])
    with pytest.raises(ValueError):
        bands(0)


def test_jaccard_filter_passes_all_wanted_ids(spark):
    from kindred.llm.ngram_join import _filter, _place

    ids = np.random.default_rng(15).integers(-(1 << 62), 1 << 62, 3000)
    bits = _filter(spark.createDataFrame([(int(i),) for i in ids[:1500]], "cls long"))
    at = _place(ids)
    passing = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1
    assert passing[:1500].all() and passing[1500:].mean() < 0.02


def test_jaccard_blocks_shared_by_many(spark):
    """Copies and near copies of one text over many batches: what a batch decides and what goes on make one whole."""
    from kindred.llm.ngram_join import jaccard_components

    rng = np.random.default_rng(13)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(120):
        w = list(base)
        for j in rng.integers(0, 80, i % 4):
            w[j] = f"x{rng.integers(6)}"
        rows.append((i, " ".join(w), "en", "s"))
    df = table(spark, rows).repartition(7)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df, 3, 80).collect()} == jaccard_truth(rows, 3, 80)


def test_jaccard_rows_that_share_a_doc_id(spark):
    from kindred.llm.ngram_join import jaccard_components

    rows = [(7, "a b c d e", "en", "s"), (7, "p q r s t u", "en", "s"), (9, "P q r s t u", "en", "s"), (None, "a b c d e", "en", "s")]
    assert {tuple(r) for r in jaccard_components(table(spark, rows), 3, 90).collect()} == {(7, 4, 7), (9, 4, 7)}


def thue_morse(n):
    a = "a"
    while len(a) < n:
        a += a.translate(str.maketrans("ab", "ba"))
    return a


def test_jaccard_of_words_that_weak_hashes_confuse(spark):
    from kindred.llm.ngram_join import jaccard_components

    a = thue_morse(1024)
    b = a.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"{a} {a} {b} {a}", "en", "s"), (2, f"{b} {b} {a} {b}", "en", "s"), (3, a, "en", "s"), (4, b, "en", "s")]
    assert {(r.doc_id, r.component_id) for r in jaccard_components(table(spark, rows), 3, 90).collect()} == {(i, i) for i in range(1, 5)}


def test_jaccard_links_equal_sets_in_another_order(spark):
    from kindred.llm.ngram_join import jaccard_components

    rows = [(1, "a b c a b c", "en", "s"), (2, "a b c a b c a", "en", "s"), (3, "b c a b c a b c a b", "en", "s"), (4, "a b", "en", "s"), (5, "A  b", "en", "s")]
    for percent in (90, 100):
        assert {(r.doc_id, r.component_id) for r in jaccard_components(table(spark, rows), 3, percent).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)}


@pytest.mark.parametrize("bits", [64, 6, 1])
def test_jaccard_verifies_by_words_where_hashes_collide(bits):
    import pyarrow as pa
    import zstandard

    from kindred.llm.ngram_join import _verifier

    rng = np.random.default_rng(5)
    texts = ["", "a b", "a  B", "b a", "a b c", "a b c a b c", "a b c a b c a"]
    for _ in range(40):
        w = list(rng.choice(WORDS, int(rng.integers(1, 60))))
        texts.append(" ".join(w))
        for j in rng.integers(0, len(w), 1):
            w[j] = "otro"
        texts.append(" ".join(w))
    pairs = [(i, j) for i in range(len(texts)) for j in range(i)]
    pack = zstandard.ZstdCompressor().compress
    batch = pa.record_batch({"a": [i for i, _ in pairs], "b": [j for _, j in pairs], "left": [pack(texts[i].encode()) for i, _ in pairs], "right": [pack(texts[j].encode()) for _, j in pairs]})
    got = {(x, y) for out in _verifier(3, 80, bits)(iter([batch])) for x, y in zip(out["src"].to_pylist(), out["dst"].to_pylist())}
    sets = [shingles(t, 3) for t in texts]
    assert got == {(i, j) for i, j in pairs if sets[i] & sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}


def test_repeats_of_many_rows_that_share_one_id(spark):
    """With 300 texts of one doc_id, 16 bits can't tell them apart: only the copy of the first row's text loses words."""
    from kindred.llm.substring_dedup import remove_repeats

    rng = np.random.default_rng(6)
    texts = [" ".join(map(str, rng.integers(0, 1 << 30, 14))) for _ in range(300)]
    rows = [(1, texts[0], "en", "s"), *((5, t, "en", "s") for t in texts), (5, texts[0], "en", "s")]
    got = collections.Counter((r.doc_id, r.n_removed) for r in remove_repeats(table(spark, rows), 13).collect())
    assert got == {(1, 0): 1, (5, 14): 2, (5, 0): 299}


def test_repeats_equal_brute_force(spark, corpus):
    from kindred.llm.substring_dedup import remove_repeats

    first = collections.defaultdict(lambda: 1 << 60)
    for i, t, *_ in corpus:
        w = split(t)
        for j in range(len(w) - 12):
            key = tuple(w[j : j + 13])
            first[key] = min(first[key], i)
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in remove_repeats(table(spark, corpus), 13).collect()}
    for i, t, *_ in corpus:
        w = split(t)
        gone = {j + d for j in range(len(w) - 12) if first[tuple(w[j : j + 13])] < i for d in range(13)}
        assert got[i] == (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))


def test_repeats_with_small_groups_and_shared_ids(spark, corpus, monkeypatch):
    from kindred.llm import substring_dedup as s

    whole = sorted(tuple(r) for r in s.remove_repeats(table(spark, corpus), 13).collect())
    monkeypatch.setattr(s.prefix_plan, "__defaults__", (500,))
    assert sorted(tuple(r) for r in s.remove_repeats(table(spark, corpus), 13).collect()) == whole
    a, b = " ".join(map(str, range(20))), " ".join(map(str, range(100, 130)))
    rows = [(1, a, "en", "s"), (2, b, "en", "s"), (2, a, "en", "s"), (2, "x " + a, "en", "s")]
    assert sorted((r.n_words, r.n_removed) for r in s.remove_repeats(table(spark, rows), 13).collect() if r.doc_id == 2) == [(20, 20), (21, 20), (30, 0)]


def test_repeats_of_other_window_lengths(spark, corpus):
    from kindred.llm.substring_dedup import remove_repeats

    for window in (1, 3, 6):
        first = collections.defaultdict(lambda: 1 << 60)
        for i, t, *_ in corpus:
            w = split(t)
            for j in range(len(w) - window + 1):
                first[tuple(w[j : j + window])] = min(first[tuple(w[j : j + window])], i)
        got = {r.doc_id: r.n_removed for r in remove_repeats(table(spark, corpus), window).collect()}
        for i, t, *_ in corpus:
            w = split(t)
            assert got[i] == len({j + d for j in range(len(w) - window + 1) if first[tuple(w[j : j + window])] < i for d in range(window)})


def test_suffix_tree_nodes():
    """Order of leaves, common prefixes and deep nodes, against sorting tuples of words."""
    from kindred.llm.substring_dedup import deep_nodes, leaves

    rng = np.random.default_rng(10)
    for n, window in ((3, 4), (2, 13), (70_000, 13), (1, 5)):
        codes = np.concatenate([rng.integers(0, n, 60)] * 2 + [rng.integers(0, n, 200)])
        at = rng.permutation(len(codes) - window)[:200]
        order, common = leaves(codes, n, at, window)
        words = [tuple(codes[i : i + window]) for i in at[order]]
        assert words == sorted(words)
        want = [0] + [next((k for k in range(window) if a[k] != b[k]), window) for a, b in zip(words[:-1], words[1:])]
        assert common.tolist() == want
        for depth in (1, 2, window):
            groups = collections.Counter(w[:depth] for w in words)
            first, end = deep_nodes(common, depth)
            assert {words[a][:depth]: b - a for a, b in zip(first, end)} == {g: c for g, c in groups.items() if c > 1}


@pytest.mark.parametrize("collide", [False, True])
def test_repeats_compare_words_where_hashes_collide(corpus, monkeypatch, collide):
    """The tasks' functions, with hashes that are all alike: no window goes for another's sake."""
    import pyarrow as pa

    from kindred.llm import substring_dedup as s

    monkeypatch.setattr(s, "BATCH", 3000)
    if collide:
        real = s._windows
        monkeypatch.setattr(s, "_windows", lambda w, n: (lambda at, anchor, prefixes, path: (at, anchor, [p * 0 for p in prefixes], path * 0))(*real(w, n)))
    rows = [r for r in corpus if r[0] != 505]
    counts = np.zeros((3, 1 << s.SLOT_BITS), np.int64)
    counts[:] = 10
    first, parts = s.prefix_plan(counts, 100_000)
    batches = [pa.record_batch({"doc_id": [r[0] for r in rows[a : a + 40]], "text": [r[1] for r in rows[a : a + 40]], "shared": [a == 40] * len(rows[a : a + 40])}) for a in range(0, len(rows), 40)]
    sent = pa.Table.from_batches(list(s._emit(13, first, parts, 2)(iter(batches))))
    got = set()
    for kind, part in {(k, p) for k, p in zip(sent["kind"].to_pylist(), sent["part"].to_pylist())}:
        own = sent.filter((pa.compute.equal(sent["kind"], kind)).combine_chunks()).filter(pa.compute.equal(sent.filter(pa.compute.equal(sent["kind"], kind))["part"], part))
        out = s._meet(13, 2)(own)
        for head, body in zip(out["head"].to_pylist(), out["body"].to_pylist()):
            ids, _, pos = s._decode(head, body)
            got |= set(zip(ids.tolist(), pos.tolist()))
    low = collections.defaultdict(lambda: 1 << 60)
    windows = [(i, j, tuple(split(t)[j : j + 13])) for i, t, *_ in rows for j in range(len(split(t)) - 12)]
    for i, _, x in windows:
        low[x] = min(low[x], i)
    assert got == {(i, j) for i, j, x in windows if low[x] < i} and got


def test_decontamination_equals_brute_force(spark, corpus):
    from kindred.llm.decontaminate import decontaminate

    rng = np.random.default_rng(3)
    long = split(next(t for i, t, *_ in corpus if i == 505))
    items = [(1, " ".join(long[50:90])), (2, "Uno"), (3, None), (4, ""), (5, "nadie dijo esto jamas en ningun lugar del mundo entero hoy"), (6, prose(rng, 2)), (1, " ".join(long[50:90])), (10, " ".join(long[60:75])), (None, "uno"), (7, "NEGRO! come"), (None, " ".join(long[200:215]))]
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in decontaminate(table(spark, corpus), spark.createDataFrame(items, "item_id long, text string"), 10).collect()}
    tokens = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t))
    windows = {(i, tuple(w[j : j + min(10, len(w))])) for i, t in items for w in [tokens(t)] if w for j in range(len(w) - min(10, len(w)) + 1)}
    for i, t, *_ in corpus:
        w, hit, named = tokens(t), set(), set()
        for item, x in windows:
            for j in range(len(w) - len(x) + 1):
                if w[j] == x[0] and tuple(w[j : j + len(x)]) == x:
                    hit |= set(range(j, j + len(x)))
                    named |= {str(item)} - {"None"}
        assert got[i] == (len(w), len(hit), sorted(named), bool(hit)), i


def test_mixing_meets_targets(spark, corpus):
    from kindred.llm.mixing import mix

    repeated = corpus + corpus[:3]
    assert mix(table(spark, repeated), block=16).count() == len(repeated)
    got = mix(table(spark, corpus), block=16).toPandas()
    assert len(got) == len(corpus)
    size = {i: len(split(t)) for i, t, *_ in corpus}
    assert all(size[r.doc_id] == r.size and 0 <= r.taken <= 2 * r.size for r in got.itertuples())
    total, by = 0.0, got.groupby(got.source.fillna("~null"))
    for _, g in by:
        assert g.source_size.nunique() == 1 and g.source_size.iloc[0] == g["size"].sum()
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 1
        assert g.target.iloc[0] <= 2 * g["size"].sum() + 1e-9
        total += g.target.iloc[0]
    assert total == pytest.approx(1.5 * got["size"].sum())
    again = mix(table(spark, corpus[::-1]), block=16).toPandas()
    assert sorted(zip(again.doc_id, again.taken, strict=True)) == sorted(zip(got.doc_id, got.taken, strict=True))


def test_mixing_schedule_keeps_shares_everywhere(spark, corpus):
    from kindred.llm.mixing import mix

    p = mix(table(spark, corpus), block=16, pieces=True).join(table(spark, corpus).select("doc_id", "source"), "doc_id").toPandas()
    share = p.groupby(p.source.fillna("~"))["words"].sum() / p["words"].sum()
    half = p[p.slot < p.slot.max() / 2]
    for s, v in (half.groupby(half.source.fillna("~"))["words"].sum() / half["words"].sum()).items():
        assert abs(v - share[s]) < 0.05
    assert p.groupby("slot")["words"].sum().max() <= 16


def test_mixing_follows_the_schedule(spark, corpus):
    """first_slot and n_stretches by walking the golden-ratio points one by one."""
    from kindred.llm.mixing import mix

    block = 16
    got = mix(table(spark, corpus), block=block).toPandas()
    sources = sorted({r.source for r in got.itertuples()}, key=lambda s: (not isinstance(s, str), s if isinstance(s, str) else ""))
    quota = {s: int(np.floor(got[got.source.isna() if not isinstance(s, str) else got.source == s].target.iloc[0] + 0.5)) for s in sources}
    total, at, edges = sum(quota.values()), 0, []
    for s in sources:
        edges.append((at / total, (at + quota[s]) / total, s))
        at += quota[s]
    slot_of, n = collections.defaultdict(dict), -(-total // block)
    for slot in range(n):
        point = (slot + 1) * 0.6180339887498949 % 1.0
        s = next((s for lo, hi, s in edges if lo <= point < hi), None)
        if s in quota and len(slot_of[s]) < -(-quota[s] // block):
            slot_of[s][len(slot_of[s])] = slot
    for s in sources:
        for rank in range(len(slot_of[s]), -(-quota[s] // block)):
            slot_of[s][rank] = n + rank
    for s in sources:
        own = got[got.source.isna() if not isinstance(s, str) else got.source == s]
        own = sorted(own.itertuples(), key=lambda r: (hashlib.md5(str(r.doc_id).encode()).hexdigest(), r.doc_id, r.size))
        start, whole = 0, sum(r.size for r in own)
        for r in own:
            slots = [slot_of[s][rank] for turn in (0, 1) for lo in [turn * whole + start] for hi in [min(lo + r.size, quota[s])] if lo < hi for rank in range(lo // block, (hi - 1) // block + 1)]
            assert (r.n_stretches, None if np.isnan(r.first_slot) else r.first_slot) == (len(slots), min(slots, default=None))
            start += r.size


def test_mixing_spreads_rows_that_share_ids(spark, monkeypatch):
    """Half of all rows without doc_id, most of them equal: each has its own place in the shuffled order."""
    from kindred.llm import mixing

    monkeypatch.setattr(mixing, "COPIES_A_ROW", 7)
    rng = np.random.default_rng(4)
    rows = [(None, prose(rng, 9), "es", "a")] * 50 + [(None, prose(rng, n % 13), "es", "b") for n in range(30)] + [(n // 2, prose(rng, n % 5), "es", "ab"[n % 2]) for n in range(60)] + [(8, None, None, None)] * 9
    got = mixing.mix(table(spark, rows), block=16).toPandas()
    assert sorted((str(i), str(s), len(split(t))) for i, t, _, s in rows) == sorted((str(int(r.doc_id)) if r.doc_id == r.doc_id else "None", str(r.source), r.size) for r in got.itertuples())
    for _, g in got.groupby(got.source.fillna("~")):
        quota, whole = int(np.floor(g.target.iloc[0] + 0.5)), int(g["size"].sum())
        assert whole == g.source_size.iloc[0]
        own = sorted((hashlib.md5(b"" if r.doc_id != r.doc_id else str(int(r.doc_id)).encode()).hexdigest(), r.size, r.taken) for r in g.itertuples())
        start, want = 0, []
        for key, size, _ in own:
            want.append((key, size, sum(max(0, min(turn * whole + start + size, quota) - turn * whole - start) for turn in (0, 1))))
            start += size
        assert sorted(want) == own


def cosine_truth(rows, least):
    good = {i: (label, np.array(v, float)) for i, v, label in rows if label is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = [(a, b) for a in good for b in good if a < b and good[a][0] == good[b][0] and len(good[a][1]) == len(good[b][1]) and good[a][1] @ good[b][1] / np.linalg.norm(good[a][1]) / np.linalg.norm(good[b][1]) >= least]
    n = collections.Counter(x for pair in links for x in pair)
    return {i: (n[i], c) for i, c in components_of([i for i, *_ in rows], links).items()}


@pytest.mark.parametrize("tile", [4, 1024])
def test_embedding_links_equal_brute_force(spark, monkeypatch, tile):
    from kindred.llm import embedding_dedup as e

    monkeypatch.setattr(e, "TILE", tile)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(12, 16))
    rows = [(i, [float(x) for x in base[i % 12] + rng.normal(size=16) * 0.12], i % 3 if i % 10 else None) for i in range(80)]
    rows += [(100, None, 1), (101, [0.0] * 16, 1), (102, [float("nan")] + [1.0] * 15, 1), (103, [None] + [1.0] * 15, 1), (104, [float("inf")] + [1.0] * 15, 1), (105, [], 1), (106, [1.0, 2.0], 1), (107, [2.0, 4.0], 1), (108, rows[1][1], 1), (109, [x * 1e200 for x in rows[1][1]], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("links", F.lit("x")).withColumn("tile", F.lit("x"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in e.near_duplicates(df, 0.93, 0.999999).collect()}
    truth = cosine_truth(rows[:-1], 0.93)
    truth = {**truth, 109: truth[108]}
    for i, n in enumerate([x for x in truth if truth[x][1] == truth[108][1]]):
        pass
    with np.errstate(over="ignore"):
        scaled = rows[:-1] + [(109, rows[1][1], 1)]
    assert got == {i: (n, c, i == c) for i, (n, c) in cosine_truth(scaled, 0.93).items()}


def test_embedding_copies_are_folded(spark):
    from kindred.llm.embedding_dedup import merged, near_duplicates

    rng = np.random.default_rng(3)
    base = rng.normal(size=(3, 8))
    rows = [(i, [float(x) for x in (base[0] if i < 60 else base[i % 3] + rng.normal(size=8) * 0.1)], 1) for i in range(90)]
    rows += [(i, [-0.0 if j else 1.0 for j in range(8)] if i % 2 else [0.0 if j else 1.0 for j in range(8)], 2) for i in range(200, 210)] + [(200, rows[0][1], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    rows = [(r.vec_id, list(r.embedding), r.label) for r in df.collect()]
    once = {}
    for i, v, label in rows:
        once[i] = min(once.get(i, (label, v)), (label, v))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_duplicates(df, 0.93, 0.999999).collect()}
    assert got == {i: (n, c, i == c) for i, (n, c) in cosine_truth([(i, v, label) for i, (label, v) in once.items()], 0.93).items()}
    a, b = rng.integers(0, 200, (2, 150))
    low = components_of(range(200), list(zip(a.tolist(), b.tolist())))
    assert merged(np.arange(200), a, b).tolist() == [low[i] for i in range(200)]


def test_url_rules_and_models(spark):
    from kindred.llm.queries import URL_RULES
    from kindred.llm.url_filter import judge

    rng = np.random.default_rng(4)
    name = lambda kind: "".join(rng.choice(list("abcde" if kind else "vwxyz"), 8))
    urls = [f"https://{name(True)}.org/en/{i}" for i in range(300)] + [f"http://{name(False)}.com/de/{i}" for i in range(300)]
    odd = ["HTTP://WWW.Example.ORG/es/x?q=/fr/", "https://sub.example.org/en/12#t", "https://example.org/en/2", "x.org/es/", None, "", "http://org", "http://org/", "ftp://notexample.org/es/1", "https://a.com?x=/fr/", "a://b://c.com/fr/"]
    seen = [f"https://{name(True)}.net/en/{i}" for i in range(40)], [f"https://{name(False)}.net/en/{i}" for i in range(40)]
    rows = list(enumerate(urls + odd + seen[0] + seen[1]))
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("x")).withColumn("score", F.lit("y"))
    got = {r.page_id: r for r in judge(df, URL_RULES).collect()}
    assert len(got) == len(rows)
    for i, u in rows:
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        rest = re.split("[?#]", rest)[0]
        host, path = (lower(rest.split("/")[0]), rest[len(rest.split("/")[0]) :])
        fit = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, max(fit)[1] if fit else None), u
        assert got[i].verdict == max(fit)[2] if fit else got[i].verdict in ("allow", "block")
    n = len(urls) + len(odd)
    good = sum(got[i].verdict == "allow" for i in range(n, n + 40)), sum(got[i].verdict == "block" for i in range(n + 40, n + 80))
    assert min(good) >= 32
    assert judge(spark.createDataFrame([], "page_id long, url string"), URL_RULES).count() == 0
    assert judge(df.where("page_id >= 600"), ()).count() == len(rows) - 600


def test_url_models_plan_is_one_table_of_suffixes(spark):
    """The driver holds the plan; a chain of tables, one an order, was 49 exchanges and 72 aggregates."""
    from kindred.llm.url_filter import ratios

    counts = spark.createDataFrame([("^^^^^a", 2, 1), ("^^^^ab", 0, 3)], "gram string, n0 long, n1 long")
    plan = ratios(counts)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 12 and plan.count("HashAggregate") <= 10


def test_url_models_equal_brute_force(spark, monkeypatch):
    """Scores by counting grams of all orders in Python; unseen contexts back off."""
    from kindred.llm import url_filter as u
    from kindred.llm.queries import URL_RULES

    rng = np.random.default_rng(12)
    urls = [f"https://{''.join(rng.choice(list('abcé'), 4))}.{rng.choice(['org', 'com', 'net'])}/{rng.choice(['fr', 'de', 'xx'])}/{rng.integers(30)}?Q={rng.integers(3)}" for _ in range(260)] + [None, "", "http://zzz.net/ww", "http://zzz.net/ww"]
    urls += [urls[5]] * 90
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("gram", F.lit("x")).withColumn("id", F.lit("x"))
    got = {r.page_id: r for r in u.judge(df, URL_RULES).collect()}
    # few frequent keys, or none, make no difference
    for share in (1, 20):
        monkeypatch.setattr(u, "SHARE", share)
        assert {r.page_id: r for r in u.judge(df, URL_RULES).collect()} == got
    fold = {r.url: r.f for r in df.select(F.coalesce("url", F.lit("")).alias("url"), F.expr("pmod(xxhash64(coalesce(url, '')), 4)").alias("f")).collect()}
    text = lambda x: "^" * u.ORDER + re.sub("[^a-z0-9./_-]", "~", (x or "").lower()) + "^"
    grams = lambda x: [text(x)[i : i + u.ORDER + 1] for i in range(len(text(x)) - u.ORDER)]
    seen = [collections.Counter(), collections.Counter()]
    ruled = {x: got[i].verdict == "allow" for i, x in enumerate(urls) if got[i].rule}
    for x, good in ruled.items():
        if fold[x] != 0:
            for g in grams(x):
                for k in range(u.ORDER + 1):
                    seen[good][g[u.ORDER - k :]] += 1
    after = [collections.Counter(), collections.Counter()], [collections.Counter(), collections.Counter()]
    for side in (0, 1):
        for e, n in seen[side].items():
            after[0][side][e[:-1]] += n
            after[1][side][e[:-1]] += 1

    def p(side, e):
        lower = p(side, e[1:]) if len(e) > 1 else 1 / u.SYMBOLS
        n, t = after[0][side][e[:-1]], after[1][side][e[:-1]]
        return (seen[side][e] + t * lower) / (n + t) if t else lower

    def score(x):
        return np.mean([np.log(p(1, g)) - np.log(p(0, g)) for g in grams(x)])

    cell = lambda x: int(np.floor(np.clip(round(score(x), 9), -u.REACH, u.REACH) * u.BINS))
    held = [(cell(x), good) for x, good in ruled.items() if fold[x] == 0]
    goods, bads = sum(g for _, g in held), sum(not g for _, g in held)
    errors = {b: round(sum(g for c, g in held if c < b) / goods + 1 - sum(not g for c, g in held if c < b) / bads, 9) for b, _ in held}
    threshold = min(errors, key=lambda b: (errors[b], abs(b), b)) / u.BINS
    for i, x in enumerate(urls):
        if got[i].rule is None:
            assert got[i].score == pytest.approx(score(x), abs=1e-8) and got[i].threshold == threshold
            assert got[i].verdict == ("allow" if got[i].score >= threshold else "block")
    assert len(got) == len(urls) and bads and goods


@pytest.fixture(scope="module")
def toxic():
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for i in range(900):
        w = [("".join(rng.choice(list("aeiourstnl"), 5)) if rng.random() < 0.5 else str(rng.choice(WORDS))) for _ in range(int(rng.integers(3, 120)))]
        bad = i % 4 == 0
        if bad:
            for _ in range(2):
                w.insert(int(rng.integers(len(w))), str(rng.choice(["grumblex", "VORTIQ", "zankpfel"])) + str(rng.choice(["", "!", "ito"])))
        rows.append((i, " ".join(w), ["en", "de", "fr"][i % 3], "s"))
        labels.append((i, int(i % 2), int(bad)))
    return rows, labels


def test_toxicity_held_out_accuracy(spark, toxic):
    from kindred.llm.toxicity import fold, toxicity, train

    rows, labels = toxic
    docs, lab = table(spark, rows + [(2000, None, None, None), (2001, "", "xx", "s")]), spark.createDataFrame(labels + [(5, 1, 0), (None, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    model = train(docs, lab, sample=500)
    got = toxicity(docs, model).withColumn("fold", fold()).toPandas()
    assert len(got) == len(rows) + 2 and got.toxicity_score.between(0, 1).all()
    held = got[(got.fold == 2) & (got.doc_id < 2000)]
    right = (held.toxicity_score >= 0.3) == (held.doc_id % 4 == 0)
    assert right.mean() > 0.95
    assert not got[got.doc_id >= 2000].toxic_rejected.any()
    # the language decides the threshold only
    other = toxicity(docs.withColumn("lang", F.lit("en")), model).toPandas()
    assert (other.sort_values("doc_id").toxicity_score.to_numpy() == got.sort_values("doc_id").toxicity_score.to_numpy()).all()


def test_toxicity_forward_pass_equals_plain_convolution():
    """Tables, gathers and pooling by segment against loops over words, filters and places; cuts of batches don't matter."""
    import pyarrow as pa

    from kindred.llm import toxicity as x
    from kindred.llm._words import text_buffer, words

    rng = np.random.default_rng(14)
    width = x.FILTERS * len(x.WIDTHS)
    m = x.Model(rng.normal(size=(sum(x.ROWS), x.DIM)).astype(np.float32), [rng.normal(size=(n, x.DIM, x.FILTERS)).astype(np.float32) for n in x.WIDTHS], rng.normal(size=width), rng.normal(size=width), 0.3)
    texts = [prose(rng, int(n)) for n in (0, 1, 2, 3, 9, 40, 0, 5)] + [None]
    read = lambda some: words(*text_buffer(pa.array(some, pa.string())), lower=True, alnum=True)
    got = m.logits(read(texts), m.tables())
    for i, t in enumerate(texts):
        e = m.embed[x._buckets(read([t]))].sum(1) if t else np.zeros((0, x.DIM))
        pooled = []
        for f in m.filters:
            for c in range(x.FILTERS):
                places = [sum(float(e[p + k] @ f[k, :, c]) for k in range(len(f)) if p + k < len(e)) for p in range(len(e))]
                pooled.append(max(places, default=0.0))
        assert got[i] == pytest.approx(float(np.maximum(np.array(pooled) + m.bias, 0) @ m.head + m.offset), rel=1e-4, abs=1e-3)
    alone = np.concatenate([m.logits(read([t]), m.tables()) for t in texts])
    assert np.allclose(alone, got, atol=1e-4)


def test_toxicity_sample_is_bounded_and_repeats_count_once(spark, toxic):
    from kindred.llm.toxicity import toxicity, train

    rows, labels = toxic
    rows = rows[:200] + rows[:60] + [(0, "a b " * 200_000, "en", "s")]
    docs, lab = table(spark, rows), spark.createDataFrame(labels[:200], "doc_id long, quality int, toxic int")
    model = train(docs, lab, sample=100, sample_bytes=20_000)
    out = toxicity(docs, model)
    assert out.count() == len(rows) and out.where("toxicity_score between 0 and 1").count() == len(rows)


def test_toxicity_with_one_label_or_none(spark, toxic):
    from kindred.llm.toxicity import toxicity, train

    docs = table(spark, toxic[0][:40])
    for rows in ([], [(i, 1, 0) for i in range(40)]):
        assert toxicity(docs, train(docs, spark.createDataFrame(rows, "doc_id long, quality int, toxic int"))).where("toxicity_score between 0 and 1").count() == 40
    with pytest.raises(ValueError):
        toxicity(docs.withColumn("toxic_rejected", F.lit(1)), train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")))


def test_toxicity_calibrates_on_all_held_rows(spark, toxic):
    """The sample bounds what filters are fitted on, not what thresholds see."""
    from kindred.llm.toxicity import calibrate, toxicity, train

    rows, labels = toxic
    rows = [(i + 1000 * k, t, "qq" if i % 12 < 3 else "en", s) for k in range(2) for i, t, _, s in rows]
    docs, lab = table(spark, rows), spark.createDataFrame([(i + 1000 * k, q, x) for k in range(2) for i, q, x in labels], "doc_id long, quality int, toxic int")
    model = train(docs, lab, sample=60)
    assert set(model.thresholds) == {"qq", "en"}
    # thresholds have the fewest errors among all cuts over the held rows
    held = toxicity(docs, model).where("pmod(crc32(cast(doc_id as string)), 4) <> 2 and pmod(xxhash64(doc_id, 3), 5) = 0").toPandas()
    assert len(held) > 100
    for lang, part in held.groupby("lang"):
        s, bad = part.toxicity_score.to_numpy(), part.doc_id.to_numpy() % 1000 % 4 == 0
        errors = [(bad != (s >= cut)).sum() for cut in [0.0, *s, 1.1]]
        assert part.toxic_rejected.ne(bad).sum() <= min(errors) + 1, lang
    # a language with few examples of a label has none of its own
    scored = spark.createDataFrame([("a", int(i >= 30), (i - 30) / 8 + (i == 29)) for i in range(60)] + [("b", int(i >= 10), float(i)) for i in range(20)] + [(None, 0, -1.0)], "lang string, toxic int, logit double")
    calibrate(model, scored)
    assert set(model.thresholds) == {"a"}


def luhn(d):
    t = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
    return t % 10 == 0


def card(rng):
    d = "4" + "".join(map(str, rng.integers(0, 10, 14)))
    return next(d + str(c) for c in range(10) if luhn(d + str(c)))


#: As the contract has them.
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def base_truth(t):
    out = []
    for k in ("email", "ip", "card", "phone"):
        for m in BASE[k].finditer(t or ""):
            d = re.sub("[^0-9]", "", m.group())
            if {"email": True, "ip": k == "ip" and all(int(p) <= 255 for p in m.group().split(".")), "card": 16 <= len(d) <= 19 and luhn(d or "1"), "phone": 8 <= len(d) <= 15}[k]:
                out.append((k, m.start(), m.end()))
    return out


def test_pii_base_spans_of_dense_texts():
    from kindred.llm.pii import Cover, base_spans

    rng = np.random.default_rng(9)
    for letters in ("a@.-1 ", "0123.", "012 -+().", "@@a.b1+- 4"):
        for _ in range(1500):
            t = "".join(rng.choice(list(letters), int(rng.integers(1, 60))))
            assert base_spans(t) == base_truth(t), t
    spans = [(int(a), int(a + n)) for a, n in rng.integers(1, 40, (12, 2))]
    cover = Cover(spans)
    for a in range(90):
        assert cover.meets(a, a + 3) == any(a < y and x < a + 3 for x, y in spans)


@pytest.mark.parametrize("unit", ["7", "a", "a@", "1.", "a.b@", "+", "7 7-", " ", "(at) ", "x at y ", "a dot b "])
def test_pii_reads_very_long_texts_in_linear_time(unit):
    """Five million characters of what patterns could read again and again."""
    import time

    from kindred.llm.pii import Detector, base_spans, candidates, fit

    detector: Detector = fit(np.zeros((0, 1)), np.zeros(0))
    t = unit * (5_000_000 // len(unit)) + " me@example.com"
    began = time.time()
    assert base_spans(t)[0][0] == "email"
    candidates(t)
    assert time.time() - began < 20
    began = time.time()
    assert sum(len(x) for x in detector.find([t[-1_000_000:]])) >= 1
    assert time.time() - began < 40


def test_pii_base_spans_and_respelt_ones(spark):
    from kindred.llm.pii import pii_spans, redact, train

    rng = np.random.default_rng(6)
    made = [lambda: f"u{rng.integers(99)}@mail{rng.integers(9)}.example.com", lambda: ".".join(map(str, rng.integers(0, 256, 4))), lambda: card(rng), lambda: f"+1 ({rng.integers(200, 999)}) {rng.integers(200, 999)}-{rng.integers(1000, 9999)}"]
    rows = []
    for i in range(300):
        t = prose(rng, 12)
        for f in rng.choice(4, 2):
            t += f" {made[f]()} {prose(rng, 6)}"
        rows.append((i, t + f" version {rng.integers(9)}.{rng.integers(9)} año {rng.integers(1900, 2030)} total {rng.integers(10**9)}", "en", "s"))
    odd = ["é a@b.c@d.e.f x", "1.2.3.4.5 999.1.1.1 0001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1234567 +12345678 +1 2", None, "", "a@b", "escribe a juan.perez (at) correo (dot) com hoy", "llame al (212) 555-0187 hoy", "tel 212-555-0187 gracias", "clean text without any of it"]
    rows += [(1000 + j, t, "en", "s") for j, t in enumerate(odd)]
    docs = table(spark, rows)
    detector = train(docs)
    got = {r.doc_id: r.spans for r in pii_spans(docs, detector).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        want = base_truth(t)
        assert [(s.kind, s.start, s.end) for s in got[i] if s.base] == want
        extra = [s for s in got[i] if not s.base]
        assert not any(s.start < e and a < s.end for s in extra for _, a, e in want)
    added = {i: [(s.kind, rows[300 + i - 1000][1][s.start : s.end]) for s in got[i] if not s.base] for i in range(1008, 1012)}
    assert added[1008] == [("email", "juan.perez (at) correo (dot) com")]
    assert [k for k, _ in added[1009]] == ["phone"] and [k for k, _ in added[1010]] == ["phone"] and added[1011] == []
    assert sum(not s.base for i in range(300) for s in got[i]) <= 6
    clean = {r.doc_id: r for r in redact(docs, detector).collect()}
    assert clean[1002].text == "[CARD]" and clean[1002].n_chars == 6 and clean[1002].cls == "x"
    assert clean[1005].text is None and clean[1011].text == odd[11]


def test_pii_rare_kinds_are_learnt_and_calibrated(spark):
    """A kind in one of a hundred candidates' documents has its examples whatever the sample."""
    from kindred.llm.pii import pii_spans, train

    rng = np.random.default_rng(8)
    rows = []
    for i in range(3000):
        made = f"u{rng.integers(99)}@mail{rng.integers(9)}.example.com" if i % 100 == 0 else ".".join(map(str, rng.integers(0, 256, 4)))
        rows.append((i, f"{prose(rng, 5)} {made} {prose(rng, 5)} total {rng.integers(10**6)}", "en", "s"))
    detector = train(table(spark, rows), sample=40)
    assert detector.thresholds["email"] < 1 and detector.thresholds["ip"] < 1
    odd = table(spark, [(0, "escribe a juan.perez (at) correo (dot) com hoy", "es", "s")])
    assert [(s.kind, s.start, s.end) for s in pii_spans(odd, detector).head().spans] == [("email", 10, 42)]


@pytest.mark.parametrize("text", ["jane (at) example.com", "jane {at} example {dot} com", "jane [at] example.com", "jane at example.com", "x jane at example dot com y"])
def test_pii_filters_let_all_wide_matches_pass(text):
    import pyarrow as pa

    from kindred.llm.pii import WIDE, _likely, candidates

    m = WIDE["email"].search(text)
    assert ("email", m.start(), m.end()) in candidates(text)
    assert _likely(pa.array([text, "look at this", None])).tolist() == [True, False, False]


def test_revisits_equal_brute_force(spark):
    from kindred.llm.warc import UPDATABLE, resolve_revisits

    rng = np.random.default_rng(7)
    rows = []
    for i in range(400):
        url = None if i % 97 == 0 else f"http{'s' * (i % 2)}://{['www.', ''][i % 2]}A.example.com{['', ':80'][i % 2]}/p{rng.integers(12) if i % 3 else 0}{['', '/', '#x', '?utm_source=z'][i % 4]}"
        headers = None if i % 31 == 0 else {"ETag": f'{"W/" * (i % 2)}"{rng.integers(2)}"', "X-Own": str(i)} | ({"Date": str(i)} if i % 4 else {})
        rows.append((i, url, None if i % 89 == 0 else int(rng.integers(20_000)), "revisit" if i % 3 == 0 else "response", headers, f"body {i}"))
    df = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, headers map<string,string>, html string").withColumn("chunk", F.lit("x"))
    got = {r.record_id: r for r in resolve_revisits(df, "html").collect()}
    key = lambda u: None if u is None else re.sub(r"[/]*$", "", re.sub(r"[#?].*", "", re.sub(r":80", "", re.sub(r"^https?://(www\.)?", "", u.replace("A.", "a.")))))
    for i, u, ts, kind, h, body in rows:
        own = {k.lower(): v for k, v in (h or {}).items()}
        before = [r for r in rows if key(r[1]) == key(u) and u and ts is not None and r[2] is not None and r[3] == "response" and (r[2], r[0]) < (ts, i)]
        base = max(before, key=lambda r: (r[2], r[0]), default=None)
        assert got[i].canonical_url == key(u)
        if kind == "response":
            assert (got[i].outcome, got[i].resolved_id, got[i].html, got[i].merged) == ("response", i, body, own)
        elif base is None:
            assert (got[i].outcome, got[i].resolved_id, got[i].merged) == ("orphan", None, own)
        else:
            theirs = {k.lower(): v for k, v in (base[4] or {}).items()}
            tags = [x.get("etag", "").removeprefix("W/") for x in (own, theirs)]
            if all(tags) and tags[0] != tags[1]:
                assert (got[i].outcome, got[i].resolved_id) == ("mismatch", None)
            else:
                assert (got[i].outcome, got[i].resolved_id, got[i].html) == ("resolved", base[0], base[5])
                assert got[i].merged == theirs | {k: v for k, v in own.items() if k in UPDATABLE}


def test_length_report_equals_brute_force(spark, corpus):
    from kindred.llm.token_lengths import PATTERN, VOCABULARY, encoded_lengths, length_report

    base64, tiktoken = pytest.importorskip("base64"), pytest.importorskip("tiktoken")
    with open(VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    n = {i: len(enc.encode_ordinary(t or "")) for i, t, *_ in corpus}
    lengths = encoded_lengths(table(spark, corpus))
    assert {tuple(r) for r in lengths.collect()} == set(n.items())
    v = np.array(list(n.values()))
    got = {r.n_tokens: r for r in length_report(lengths).collect()}
    assert set(got) == set(v.tolist())
    for x, r in got.items():
        assert (r.n_docs, r.docs_up_to, r.docs_over, r.tokens_up_to, r.truncated_tokens, r.total_tokens) == ((v == x).sum(), (v <= x).sum(), (v > x).sum(), v[v <= x].sum(), np.minimum(v, x).sum(), v.sum())
        assert r.share_up_to == pytest.approx((v <= x).mean())


def test_long_white_space_is_encoded_exactly(spark):
    import base64

    import tiktoken

    from kindred.llm.token_lengths import LONG_SPACE, PATTERN, VOCABULARY, encoded_lengths, pieces

    with open(VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [a + s * n + b for a in ("", "x", "don't ") for b in ("", "y", " y", "'s", "\u3000") for s in (" ", "\n", "\t \n", "\u2003") for n in (4095, 4096, 5001)]
    got = {r.doc_id: r.n_tokens for r in encoded_lengths(table(spark, [(i, t, "en", "s") for i, t in enumerate([*texts, texts[0]])])).collect()}
    assert got == {i: len(enc.encode_ordinary(t)) for i, t in enumerate([*texts, texts[0]])}
    assert sum(space for t in texts for _, space in pieces(t)) > 100 and all(re.match(r"\s", c) for c in "\t\r \x85\xa0\u1680\u2028") and LONG_SPACE
    very = encoded_lengths(table(spark, [(1, "a" + "\n" * 1_000_000 + "b", "en", "s"), (1, "a" + "\n" * 1_000_000 + "b", "en", "s")])).collect()
    assert len(very) == 2 and very[0] == very[1] and very[0].n_tokens > 1000


def test_revisits_of_header_spellings_repeats_and_popular_responses(spark, monkeypatch):
    from kindred.llm import warc

    monkeypatch.setattr(warc, "SALTS", 3)
    schema = "record_id long, url string, ts long, kind string, headers map<string,string>, html string"
    rows = [(1, "http://a.b/", 10, "response", {"ETag": "1", "etag": "2", "ETAG": "0"}, "one"), (1, "http://a.b/", 10, "response", {"ETag": "1"}, "one")]
    rows += [(i, "http://a.b/", i, "revisit", {"ETAG": "0", "Etag": "9"} if i % 2 else {"etag": "1"}, None) for i in range(20, 60)]
    rows += [(100, None, 5, "revisit", None, None), (None, "http://c.d", 1, "response", None, "two"), (20, "http://a.b/", 20, "revisit", {"etag": "1"}, None)]
    got = sorted(warc.resolve_revisits(spark.createDataFrame(rows, schema), "html").collect(), key=str)
    assert len(got) == len(rows)
    by = collections.Counter((r.outcome, r.resolved_id, r.html) for r in got)
    # the first record's tag is that of its first spelling, "0"; the second's, which is the last of equal ids, is "1" or "0"
    assert by[("response", 1, "one")] == 2 and by[("orphan", None, None)] == 1
    assert by[("resolved", 1, "one")] + by[("mismatch", None, None)] == 41 and by[("resolved", 1, "one")] in (20, 21)
    assert {tuple(sorted(r.merged.items())) for r in got if r.record_id == 21} <= {(("etag", "0"),)}


def test_empty_tables(spark):
    from kindred.llm.decontaminate import decontaminate
    from kindred.llm.embedding_dedup import near_duplicates
    from kindred.llm.mixing import mix
    from kindred.llm.ngram_join import jaccard_components
    from kindred.llm.pii import pii_spans, train
    from kindred.llm.substring_dedup import remove_repeats
    from kindred.llm.token_lengths import encoded_lengths, length_report
    from kindred.llm.warc import resolve_revisits

    docs, items = table(spark, []), spark.createDataFrame([], "item_id long, text string")
    assert jaccard_components(docs).count() == 0
    assert remove_repeats(docs).count() == 0
    assert decontaminate(docs, items).count() == 0
    assert mix(docs).count() == 0
    assert length_report(encoded_lengths(docs)).count() == 0
    assert pii_spans(docs, train(docs)).count() == 0
    assert near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    assert resolve_revisits(spark.createDataFrame([], "record_id long, url string, ts long, kind string, headers map<string,string>")).count() == 0
    some = table(spark, [(1, "uno dos", "en", "s")])
    assert [r.contaminated for r in decontaminate(some, items).collect()] == [False]


def test_components(spark):
    from kindred.llm._graph import components

    rng = np.random.default_rng(8)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (250, 2))] + [(i, i + 1) for i in range(1000, 1040)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {n: c for n, c in components_of({x for e in edges for x in e}, edges).items() if n in linked}


def test_pipeline_stages(spark, corpus, toxic, tmp_path):
    import corpus_pipeline

    rows = [(i + 10_000, *r) for i, *r in corpus] + [(i + 20_000, *r) for i, *r in toxic[0]]
    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    table(spark, rows).select(cols).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i + 20_000, q, t) for i, q, t in toxic[1]], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    long = split(next(t for i, t, *_ in corpus if i == 505))
    spark.createDataFrame([(1, " ".join(long[50:90]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).persist()
        assert docs.columns == cols
        seen.append({r.doc_id: r.text for r in docs.collect()})
    bad = {i + 20_000 for i, _, t in toxic[1] if t}
    assert len(bad & set(seen[0])) < 0.06 * len(bad) and len(set(i for i, *_ in rows) - bad - set(seen[0])) < 0.02 * len(rows)
    kept = [(i, t) for i, t in seen[0].items()]
    assert set(seen[1]) == {i for i, (_, c) in jaccard_truth(kept, 5, 80).items() if i == c}
    assert set(seen[1]) - set(seen[2]) == {10_505} & set(seen[1])
    assert set(seen[3]) == set(seen[2])
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.collect()} == set(seen[3])


def test_pipeline_stages_judge_rows_without_and_with_shared_ids(spark, corpus, tmp_path):
    import corpus_pipeline

    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    text, leak = " ".join(f"w{i}" for i in range(40)), " ".join(f"b{i}" for i in range(20))
    rows = [(1, text), (None, text), (2, text + " more"), (3, leak), (3, "clean words only here today"), (3, "clean words only here today"), (None, "x " + leak), (None, "alone and clean"), (None, None)]
    docs = table(spark, [(i, t, "en", "s") for i, t in rows]).select(cols)
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    near = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path))
    assert near.columns == cols
    assert sorted(((r.doc_id, r.text) for r in near.collect()), key=str) == sorted([(1, text), (3, leak), (3, "clean words only here today"), (None, "alone and clean"), (None, None)], key=str)
    clean = corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path))
    assert sorted(((r.doc_id, r.text) for r in clean.collect()), key=str) == sorted([x for x in rows if leak not in (x[1] or "")], key=str)


def test_digests_of_queries(spark):
    """The thin queries' digest columns follow from the operators' outputs."""
    from kindred.llm.queries import QUERIES

    d = "/root/testdata/sf0.001"
    row = QUERIES["op1_pii_boosting"](spark, d).where("spans = ''").first()
    assert row.base_sha256 == hashlib.sha256(b"").hexdigest()
    assert set(QUERIES["op5_toxicity_cnn"](spark, d).columns) >= {"doc_id", "held_out", "score", "predicted"}


def test_token_lengths_at_any_limit(spark):
    from kindred.llm.token_lengths import at_limits, length_report, quantile_lengths

    rng = np.random.default_rng(11)
    lengths = [int(x) for x in rng.integers(0, 5000, 60)] + [1024, 1024, 2048, 0]
    report = length_report(spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, n_tokens long"))
    limits = [-5, 0, 1, 1023, 1024, 1025, 2047, 3000, 4999, 5000, 10**9, 3000, None]
    got = sorted(tuple(r) for r in at_limits(report, spark.createDataFrame([(x,) for x in limits], "limit long")).collect())
    want = []
    for x in limits:
        if x is not None:
            fit = [n for n in lengths if n <= x]
            want.append((x, len(fit), len(lengths) - len(fit), sum(fit), sum(fit) + (len(lengths) - len(fit)) * max(x, 0), len(fit) / len(lengths), sum(lengths)))
    assert got == sorted(want)
    order = sorted(lengths)
    shares = [0.01, 0.25, 0.5, 0.9, 1.0]
    assert {r.share: r.n_tokens for r in quantile_lengths(report, shares).collect()} == {s: next(n for n in order if sum(m <= n for m in order) / len(order) >= s) for s in shares}
    none = length_report(spark.createDataFrame([], "doc_id long, n_tokens long"))
    assert at_limits(none, spark.createDataFrame([(1,)], "limit long")).count() == 0 == quantile_lengths(none, [0.5]).count()


def test_decontamination_of_a_very_long_item(spark):
    """Two million words of one item are windows a few thousand at a time."""
    from kindred.llm.decontaminate import decontaminate, item_windows

    item = " ".join(map(str, range(2_000_000)))
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert item_windows(items, 10).selectExpr("count(*) n", "count(distinct words) m", "max(size(grams)) g").first()[:] == (1_999_991, 1_999_991, 8)
    docs = table(spark, [(1, " ".join(map(str, range(1_500_000, 1_500_030))), "en", "s"), (2, "x y 5 6 7 8 9 10 11 12 13 z", "en", "s"), (3, "x y 5 6 7 8 9 10 11 12 13 14 z", "en", "s")])
    assert {(r.doc_id, r.n_words, r.n_hit) for r in decontaminate(docs, items, 10).collect()} == {(1, 30, 30), (2, 12, 0), (3, 13, 10)}
