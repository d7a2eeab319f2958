"""Golay fingerprints, collocations and centroid clusters on small and odd tables, against plain Python."""

import random
import tracemalloc

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evenkeel.llm import arrays, centroid_clusters, collocations, decontaminate, golay_dedup, queries
from test_edges import LINE, SHARED, TEXTS

DOCS = "doc_id bigint, text string, lang string, id bigint, key string, fp bigint, n bigint, rank int, phrase string, salt int"


@pytest.fixture(scope="module")
def rows():
    return list(enumerate(TEXTS)) + [(12, SHARED), (8, TEXTS[8]), (8, TEXTS[0]), (30, SHARED.upper()), (31, TEXTS[19]), (None, SHARED), (None, LINE)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    made = [(i, t, "xx" if (i or 0) % 2 else None, 5, "k", 7, 1, 3, "p", 2) for i, t in rows]
    return spark.createDataFrame(made, DOCS).repartition(3).cache()


def text_order(rows):
    return sorted(map(str, map(tuple, rows)))


def test_code_is_perfect():
    assert len(set(golay_dedup.ERRORS.tolist())) == 1 << golay_dedup.CHECK_BITS
    values = np.random.default_rng(3).integers(0, 1 << golay_dedup.LENGTH, 500)
    for flips in range(1, 3):
        other = values.copy()
        for i in range(len(other)):
            for bit in random.Random(i).sample(range(golay_dedup.LENGTH), flips):
                other[i] ^= 1 << bit
        a, b = (golay_dedup.nearby_indices(v, golay_dedup.LENGTH)[0] for v in (values, other))
        assert all(set(x) & set(y) for x, y in zip(a.tolist(), b.tolist()))


def test_keys_meet_within_two_bits():
    rng = np.random.default_rng(4)
    prints = rng.integers(0, 1 << 63, 400, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 400, dtype=np.uint64)
    other = prints ^ (np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64))

    def sets(values):
        keys, counts = golay_dedup.golay_keys(values)
        assert counts.max() <= 18
        return [set(k.tolist()) for k in np.split(keys, np.cumsum(counts)[:-1])]

    assert all(a & b for a, b in zip(sets(prints), sets(other)))


def test_fingerprints_of_odd_texts(docs, rows):
    assert text_order(golay_dedup.fingerprint_components(docs).collect()) == text_order(brute.fingerprint_groups(rows))
    assert golay_dedup.fingerprint_components(docs.where("false")).count() == 0


@pytest.mark.parametrize("radius", [0, 1, 2])
def test_crowded_buckets(spark, radius):
    """Hundreds of fingerprints a few bits apart: buckets far above the limit, beside small ones."""
    rng = random.Random(radius)
    centre = rng.getrandbits(64)
    prints = {centre}
    while len(prints) < 300:
        x = centre
        for bit in rng.sample(range(64), rng.randint(1, 6)):
            x ^= 1 << bit
        prints.add(x)
    while len(prints) < 400:
        x = rng.getrandbits(64)
        prints |= {x, x ^ 1 << rng.randrange(64)}
    rows = [(x - (1 << 64) if x >> 63 else x, i) for i, x in enumerate(sorted(prints))]
    got = golay_dedup.connected_components(golay_dedup.links_of(spark.createDataFrame(rows, "fp bigint, rep bigint"), radius)).collect()
    found = {i: i for _, i in rows} | {r["id"]: r["component"] for r in got}
    root = {i: i for _, i in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, i in rows:
        for b, j in rows:
            if i < j and ((a ^ b) & (1 << 64) - 1).bit_count() <= radius:
                p, q = sorted((find(i), find(j)))
                root[q] = p
    assert found == {i: find(i) for _, i in rows}
    with pytest.raises(ValueError):
        golay_dedup.fingerprint_components(spark.createDataFrame([], "doc_id bigint, text string"), radius=3)


def test_collocations_of_odd_texts(docs, rows):
    plain = [(t, "xx" if (i or 0) % 2 else None) for i, t in rows]
    for least in (2, 3):
        assert sorted(map(tuple, collocations.mine_collocations(docs, min_count=least).collect())) == brute.collocations(plain, least)
    assert collocations.mine_collocations(docs.where("false")).count() == 0


def test_collocations_spill_and_rank(spark):
    """Tiny tries spill often, long texts are cut, and ties are broken by text in byte order."""
    source = random.Random(11)
    vocabulary = ["of", "the", "Straße", "ünder", "zed", "a b", "Of"]
    texts = [(" ".join(source.choices(vocabulary, k=200)) + source.choice([".", "\n", ", ", " "]) + "tie one, tie two, tie One", source.choice(["en", "de", None]))
             for _ in range(60)] + [("x y. " * 40 + "no", "one"), ("é z. " * 40, "one"), ("z é. " * 40, "one")]
    docs = spark.createDataFrame(texts, "text string, lang string")
    for entries in (50, 1 << 20):
        got = collocations.mine_collocations(docs, min_count=5, top=40, max_entries=entries)
        assert sorted(map(tuple, got.collect())) == brute.collocations(texts, 5, top=40)
    assert all(r["f"] == 40 for r in collocations.counted(docs.where("lang = 'one'").select("lang", F.col("text").cast("binary").alias("text")), 2, 2, everything(), 10).collect())


def everything():
    """A filter that knows everything."""
    return collocations.Filter(np.full(1 << 17, 255, np.uint8), 20)


def test_sketch_knows_every_frequent_pair(spark, monkeypatch):
    """Buckets are shared by many pairs here; none of those that reach the count is missing, and most others are."""
    monkeypatch.setattr(collocations, "LEAST_FILTER_BITS", 1 << 12)
    monkeypatch.setattr(collocations, "SKETCH_PAIRS", 500)
    source = random.Random(12)
    texts = [(" ".join(f"w{int(source.paretovariate(0.6))}" for _ in range(80)).encode(), source.choice(["en", "de"])) for _ in range(150)]
    sketch = collocations.pair_sketch(spark.createDataFrame(texts, "text binary, lang string").repartition(3), 12_000, 5)
    f = {lang: {} for lang in ("en", "de")}
    for text, lang in texts:
        found = text.split()
        for pair in zip(found, found[1:]):
            f[lang][pair] = f[lang].get(pair, 0) + 1
    verdicts = {True: [], False: []}
    for lang, counts in f.items():
        for pair, n in counts.items():
            block = next(collocations.blocks(pa.array([b" ".join(pair)], pa.binary())))
            hashes = collocations.pair_hashes(collocations.hash_words(block.data, collocations.split_words(block)))
            verdicts[n >= 5].append(bool(sketch.known(collocations.mix(hashes ^ collocations.seed_of(lang)))[0]))
    assert all(verdicts[True]) and verdicts[True] and sum(verdicts[False]) < 0.5 * len(verdicts[False])


def test_trie_bursts_and_spills_whole_subtrees():
    trie = collocations.HatTrie(depth=2, burst=8)
    source = random.Random(5)
    want = {}
    for _ in range(40):
        keys = sorted(b"".join(bytes([0, 0, 0, source.randrange(6)]) for _ in range(source.randint(3, 5))) for _ in range(50))
        trie.add("en", keys, [1] * len(keys))
        for key in keys:
            want[key] = want.get(key, 0) + 1
    assert type(trie.roots["en"]) is collocations.Node and trie.size == len(want)
    found = {}
    for lang, keys, counts in [*trie.spill(len(want) // 2), *trie.spill(0)]:
        assert lang == "en" and not found.keys() & set(keys)
        found |= dict(zip(keys, counts))
    assert found == want and trie.size == 0


def test_long_texts_are_cut_between_pieces(monkeypatch):
    monkeypatch.setattr(collocations, "LONG_BYTES", 20)
    texts = [b"one two. three four, five six; seven", None, b"x" * 50, b"x" * 30 + b"." + b"y" * 30, b""]
    for text in texts:
        cut = collocations.in_portions(pa.array([text], pa.binary())).to_pylist()
        assert b"".join(x or b"" for x in cut) == (text or b"")
        while cut and not cut[-1]:
            cut.pop()
        assert all(c[-1:] in (b".", b",", b";") for c in cut[:-1])
        assert all(len(c) <= 20 or c.strip(b"xy.") == b"" for c in cut if c)


def test_clusters_of_odd_vectors(spark):
    source = random.Random(2)
    vectors = [[source.gauss(c % 3, 0.3) for _ in range(4)] for c in range(300)]
    rows = list(enumerate(vectors)) + [(3, vectors[3]), (3, [9.0] * 4), (None, vectors[5]), (400, None), (401, []), (402, [1.0] * 5), (403, [1.0, None, 1.0, 1.0]),
                                       (404, [float("nan")] * 4), (405, [float("inf")] * 4), (406, [-0.0, 1e-9, -1e-9, 0.0]), (407, [1e4] * 4)]
    frame = spark.createDataFrame([(*r, 1, "c", 2) for r in rows], "vec_id bigint, embedding array<double>, cluster int, ids string, n int").repartition(3)
    for k in (1, 7, 1000):
        counts = []
        got = centroid_clusters.cluster_vectors(frame, k=k, dims=4, counts=counts).collect()
        assert text_order(got) == text_order(brute.clusters(rows, k=k, dims=4))
        assert len(counts) == 6 and all(n <= 305 for n in counts)
    assert centroid_clusters.cluster_vectors(frame.where("false")).count() == 0
    assert centroid_clusters.cluster_vectors(frame.where("vec_id > 400"), dims=9).count() == 0


def test_bounds_spare_scans_and_stay_exact(spark, monkeypatch):
    """Separated groups: most vectors are settled by their bounds, over portions of any size."""
    rng = np.random.default_rng(8)
    vectors = (rng.integers(0, 12, 3000)[:, None] * 3 + rng.normal(0, 0.5, (3000, 8))).tolist()
    rows = list(enumerate(vectors))
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    counts = []
    got = centroid_clusters.cluster_vectors(frame, k=20, dims=8, counts=counts).collect()
    assert text_order(got) == text_order(brute.clusters(rows, k=20, dims=8))
    assert counts[0] == 3000 and sum(counts[1:]) < 0.6 * 5 * 3000


def test_loosening_holds_for_every_vector_of_a_sphere():
    """No point of a sphere comes nearer to a moved centroid than the loosening says, and it is often less than the drift."""
    rng = np.random.default_rng(9)
    tighter = 0
    for _ in range(300):
        before = rng.normal(0, 10, (3, 5))
        after = before + rng.normal(0, 2, (3, 5)) * rng.integers(0, 2, (3, 1))
        radii = rng.uniform(0, 12, 3)
        found = centroid_clusters.loosenings(before, after, radii)
        drift = np.sqrt(((after - before) ** 2).sum(axis=1))
        for a in range(3):
            others = [j for j in range(3) if j != a]
            points = rng.normal(0, 1, (400, 5))
            points = before[a] + radii[a] * points / np.sqrt((points ** 2).sum(axis=1))[:, None]
            nearer = np.sqrt(((points[:, None] - before[others]) ** 2).sum(axis=2)) - np.sqrt(((points[:, None] - after[others]) ** 2).sum(axis=2))
            assert nearer.max() <= found[a]
            tighter += found[a] < 0.9 * drift[others].max()
    assert tighter > 100


def test_wide_components():
    """Beyond doubles whole numbers are still exact; beyond 64-bit squares the job says so."""
    vectors = np.array([[1 << 26, -(1 << 26)], [(1 << 26) + 1, 3]], np.int64)
    assert centroid_clusters.squared_distances(vectors, vectors[::-1]).tolist() == [
        [sum((int(a) - int(b)) ** 2 for a, b in zip(v, c)) for c in vectors[::-1]] for v in vectors]
    with pytest.raises(OverflowError):
        centroid_clusters.cut_off(np.array([[1 << 28]]))


def test_pieces_like_the_tokenizer():
    """Texts of signs that are cut, may not be cut, or look like white space, in one block and alone."""
    from evenkeel.llm.token_files import PieceEncoder

    signs = ["a", "b", " ", "  ", "\n", "\t", "'s", "'", " ", " ", "　", "\u0085", "é", "“", "日", "1", "!", ",", ";a",
             "<|endoftext|>", "\r\n", " the", "\x1c", "́", "", " Word", "\U0001f600", "ʼ", "ß", "ª", "x" * 70]
    chosen = random.Random(7)
    texts = ["".join(chosen.choices(signs, k=chosen.randint(0, 14))) for _ in range(4000)]
    encoder = PieceEncoder(queries.tokenizer_file("byte_bpe_50k.json"))
    want = [x.ids for x in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    column = pa.array([t.encode() for t in texts], pa.binary())
    for _ in range(2):  # asked, then remembered
        assert [np.frombuffer(x, encoder.dtype).tolist() for x in encoder.encode(column)] == want
    assert [np.frombuffer(x, encoder.dtype).tolist() for x in encoder.encode(column.slice(17, 300))] == want[17:317]
    assert list(encoder.encode(pa.array([], pa.binary()))) == [] and list(encoder.encode(pa.array([None, b""], pa.binary()))) == [b"", b""]


def found_leaks(docs, items):
    index = decontaminate.build_index(items)
    column = pa.array([None if text is None else text.encode() for _, text in docs], pa.binary())
    return {(docs[row][0], leak[0]): leak[1] for row, leaks in decontaminate.leaks_of(column, index) for leak in leaks}


@pytest.mark.parametrize("kind", ["repeated word", "changed words", "shortened", "punctuation"])
def test_every_leak_is_found(kind):
    chosen = random.Random(kind)

    def words(n):
        return ["".join(chosen.choices("abcdefghijklmnop", k=chosen.randint(2, 9))) for _ in range(n)]

    docs, items = [], []
    for number in range(60):
        body = words(chosen.randint(6, 30) if kind == "shortened" else 200)
        a, b = words(2)
        times = chosen.choice([20, 30, 40]) if kind == "repeated word" else 0
        items.append((number, " ".join(body + [a] * times)))
        if kind != "repeated word":
            for _ in range(chosen.randint(0, 1 if kind == "shortened" else 5)):
                body[chosen.randrange(len(body))] = words(1)[0]
        if kind == "shortened":
            docs.append((number, " ".join(body[:len(body) - chosen.randint(0, 3)])))
        else:
            between = chosen.choice([" ", "“ ", " — ", "… "]) if kind == "punctuation" else " "
            docs.append((number, between.join(words(30) + body + [b] * times + words(30)).upper()))
    want = brute.leaks(docs, items)
    assert found_leaks(docs, items) == pytest.approx(want) and len(want) > 10


def test_leaks_in_other_scripts():
    items = [(1, "Où est la bibliothèque générale de l’École de Médecine à Étampes, près du vieux marché"),
             (2, "東京都は日本の首都であり世界最大の都市圏の一つである。人口は約千四百万人")]
    docs = [(1, "x y OÙ EST LA «BIBLIOTHÈQUE GÉNÉRALE» DE L‘ÉCOLE DE MÉDECINE À ÉTAMPES — PRÈS DU VIEUX MARCHÉ"),
            (2, "これは、東京都は日本の首都であり、世界最大の都市圏の一つである。人口は約千四百万人、です"), (3, None), (4, ""), (5, "。—")]
    assert found_leaks(docs, items) == brute.leaks(docs, items) == {(1, 1): 1.0, (2, 2): 1.0}


def test_words_are_hashed_like_their_whole_bytes(monkeypatch):
    """Tiles, and words longer than a tile, give the hashes of one run over all bytes."""
    chosen = random.Random(5)
    raw = " ".join("".join(chosen.choices("abcé", k=chosen.choice([1, 3, 15, 16, 17, 40, 200]))) for _ in range(300)).encode()
    for column in ([raw, None, b"", b" ", raw[:90]], [b"x" * 64], [b""]):
        block = next(arrays.blocks(pa.array(column, pa.binary())))
        words = arrays.split_words(block)
        want = arrays.hash_spans(arrays.BYTE_VALUES[block.data], words.starts, words.ends)
        for size in (1, 16, 1 << 18):
            monkeypatch.setattr(arrays, "HASH_BYTES", size)
            assert arrays.hash_words(block.data, words).tolist() == want.tolist()


@pytest.mark.parametrize("text", ["some words " * 381_300, "x" * (4 << 20)], ids=["short words", "one word"])
def test_hashing_holds_a_small_part(monkeypatch, text):
    """Beyond its results, hashing the words of 4 MB takes a few MB and not the values of all bytes (over 100 MB)."""
    monkeypatch.setattr(arrays, "POWERS", arrays._Powers())
    block = next(arrays.blocks(pa.array([text.encode()], pa.binary()), 8 << 20))
    words = arrays.split_words(block)
    tracemalloc.start()
    arrays.hash_words(block.data, words)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * len(words.starts) + (20 << 20)


def test_leaks_are_searched_in_portions():
    """A batch of many rows is searched and given back about 1 MB at a time; the leaks are those of the whole."""
    chosen = random.Random(3)
    texts = [None if n % 50 == 7 else " ".join("".join(chosen.choices("abcdefgé", k=5)) for _ in range(300)) for n in range(1500)]
    items = [(n, texts[n]) for n in range(0, 1500, 100)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1500)), pa.array(texts)], names=["doc_id", "text"]).slice(3)
    whole = decontaminate.build_index(items)
    kept = list(decontaminate.without_leaks(iter([batch, batch.slice(0, 0)]), "text", whole))
    assert len(kept) > 1 and all(part.column("text").nbytes < 1.2 * arrays.PORTION_BYTES for part in kept)
    leaking = {row for row, _ in decontaminate.leaks_of(batch.column("text").cast(pa.binary()), whole)}
    assert [i for part in kept for i in part.column("doc_id").to_pylist()] == [row + 3 for row in range(1497) if row not in leaking]
    assert len(leaking) == 14
