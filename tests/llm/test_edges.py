"""Nulls, empty and very long texts, repeated rows, ties, empty tables and columns with clashing names."""

import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evenkeel.llm import bpe, decontaminate, elias_fano, language_id, line_dedup, minhash, pii, quality, ranges, substring_dedup, token_files, url_filter
from evenkeel.llm.queries import tokenizer_file
from evenkeel.session import work_path

RANDOM = random.Random(7)
SYLLABLES = ["ka", "lo", "mi", "tre", "Ühn", "é", "sto", "ng", "ba", "-", "ïx"]


def words(n, seed=None):
    source = random.Random(seed) if seed is not None else RANDOM
    return " ".join("".join(source.choices(SYLLABLES, k=source.randint(1, 5))) for _ in range(n))


SHARED = words(60, 1)
LINE = "This very line is shared by several documents."
TEXTS = [
    None, "", " \t\n ", "one", "one", "Two words", words(12), words(13), f"{words(30)}\n{LINE}\n{words(20)}", f"{LINE}\n{SHARED}", f"{SHARED}\n{LINE}",
    f"\x0b{LINE.upper()} \n{words(40)} {SHARED}", SHARED, SHARED + " more", words(40, 1) + " " + words(8), "x" * 3000, "1 " * 4000 + "+1 (555) 555-0100",
    "mail a.b@c.example.com, 10.0.0.300 10.20.30.40 4539 1488 0343 6467 +49 30 1234567", "İstanbul ΑΣΣ ΣΑΣ e\u0301\u0323 \u1112\u1161\u11ab's <|endoftext|> don't'll 'S \x1c\x85\u3000end",
    words(60_000, 3), "\U0001f600 \U0001f600\ufffd" * 3, "a  b   c \n\n d \n", " lead", "trail ", "<|startoftext|>a<|endoftext|>"]


@pytest.fixture(scope="module")
def rows():
    return list(enumerate(TEXTS)) + [(12, SHARED), (8, TEXTS[8]), (None, SHARED), (None, LINE)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    """Documents whose other columns bear names that operators use for theirs."""
    schema = "doc_id bigint, text string, lang string, id bigint, n bigint, key string, grp int, score string, kept string, n_tokens string, base string, bucket int"
    made = [(i, t, "xx" if (i or 0) % 2 else None, 5, None, "k", 1, "s", None, "t", "b", 2) for i, t in rows]
    return spark.createDataFrame(made, schema).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def test_line_dedup(docs, empty, rows):
    got = line_dedup.dedup_lines(docs, report=True)
    assert sorted(map(str, (tuple(r) for r in got.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256)).collect()))) == sorted(map(str, brute.lines(rows)))
    assert line_dedup.dedup_lines(docs).columns == docs.columns
    assert line_dedup.dedup_lines(empty).count() == 0


def test_substring_dedup(docs, empty, rows):
    for group_bytes in (200, 1 << 20):
        got = substring_dedup.dedup_substrings(docs, group_bytes=group_bytes).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute.substrings(rows)))
    assert substring_dedup.dedup_substrings(empty).count() == 0


def test_negative_and_sparse_ids(spark):
    rows = [(-10**17, SHARED), (-3, SHARED + " x"), (10**18, words(20) + " " + SHARED), (0, SHARED)]
    got = substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id bigint, text string"), group_bytes=100)
    assert sorted(map(tuple, got.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)).collect())) == sorted(brute.substrings(rows))


def test_groups_are_bounded_for_any_spread_of_ids(spark):
    """One outlier, several dense clusters, and many equal texts without id."""
    text = words(12, 5)
    clusters = [*range(300), *range(10**9, 10**9 + 300), 10**15]
    for ids in (clusters, [*clusters, -2**63, 2**63 - 1]):
        rows = [(i, f"{text} {i}") for i in ids] + [(None, text)] * 300
        grouped, total = ranges.with_id_groups(spark.createDataFrame(rows, "id bigint, text string"), "id", "text", 2000, "grp")
        found = grouped.collect()
        held = {}
        for r in found:
            held[r["grp"]] = held.get(r["grp"], 0) + len(r["text"].encode()) + 16
        assert len(found) == len(rows) and sum(held.values()) == total
        named = sorted((r["id"], r["grp"]) for r in found if r["id"] is not None)
        assert [g for _, g in named] == sorted(g for _, g in named) and named[0][1] >= 0
        assert all(n < 4000 for g, n in held.items() if g >= 0) and all(n < 6000 for g, n in held.items() if g < 0)


def test_token_files(spark, docs, empty, rows):
    from tokenizers import Tokenizer

    name = tokenizer_file("byte_bpe_50k.json")
    path = work_path(spark, "test-shards")
    token_files.write_token_files(docs, path, name, 2, shard_bytes=300)
    got = token_files.read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids"))
    named = [r for r in rows if r[0] is not None]
    want = brute.token_rows([(-1, t) for i, t in rows if i is None], Tokenizer.from_file(name)), brute.token_rows([(i, t or "") for i, t in named], Tokenizer.from_file(name))
    found = sorted((r for r in map(tuple, got.collect())), key=lambda r: r[1])
    assert sorted(r[2:] for r in found if r[0] is None) == sorted(r[2:] for r in want[0])
    assert sorted((r[0], *r[2:]) for r in found if r[0] is not None) == sorted((r[0], *r[2:]) for r in want[1])
    assert [r[1] for r in found] == list(np.cumsum([0, *(r[2] for r in found)]))[:-1]
    assert [r[0] for r in found] == sorted((r[0] for r in found), key=lambda i: (i is not None, i or 0))
    path = work_path(spark, "test-shards")
    token_files.write_token_files(empty, path, name, 2)
    assert token_files.read_token_files(spark, path).count() == 0


def test_elias_fano():
    source = np.random.default_rng(3)
    for values in ([], [0], [5], [0, 0, 0], np.sort(source.integers(0, 10**12, 3000)), np.sort(source.integers(0, 50, 1000)), np.arange(700) * 3):
        values = np.asarray(values, np.int64)
        raw = b"head" + elias_fano.encode(values, int(values[-1]) + 1 if len(values) else 1)
        read = elias_fano.EliasFano(raw, 4)
        assert read.end == len(raw) and read.all().tolist() == values.tolist()
        assert [read.select(i) for i in range(len(values))] == values.tolist()
    raw = elias_fano.encode(np.sort(source.integers(0, 10**9, 10**5)), 10**9)
    assert 8 * len(raw) / 10**5 < 2.5 + np.log2(10**9 / 10**5)


def test_shard_finds_single_documents():
    ids, parts = np.array([3, 3, 900]), [np.arange(5, dtype="<u2"), np.zeros(0, "<u2"), np.arange(9, dtype="<u2")]
    shard = token_files.Shard(token_files.build_shard(ids, np.array([len(p) for p in parts]), np.concatenate(parts)))
    assert [shard.document(i).tolist() for i in range(3)] == [p.tolist() for p in parts]
    assert [shard.doc_id(i) for i in range(3)] == [3, 3, 900]


def test_near_duplicates(docs, empty, rows):
    named = {i: t for i, t in rows if i is not None}
    want = brute.components(sorted(named.items()))
    got = minhash.near_duplicates(docs, width=2).collect()
    assert len(got) == len(rows)
    assert {r[0]: (r[1], r[2]) for r in got if r[0] is not None} == want
    assert all(r["kept"] and r["component_id"] is None for r in got if r[0] is None)
    kept = minhash.drop_near_duplicates(docs, width=2)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {None} | {i for i, (_, c) in want.items() if i == c}
    assert minhash.near_duplicates(empty).count() == 0


def test_chains_and_large_groups_of_near_copies(spark, monkeypatch):
    """Links that only members other than the smallest have, in tiles smaller than the groups."""
    monkeypatch.setattr(minhash, "TILE", 4)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for group in range(3):
        tokens = [f"g{group}{w}" for w in base]
        for step in range(25):
            tokens = list(tokens)
            tokens[(7 * step) % 60] = f"g{group}s{step}"
            rows.append((100 * group + (step * 11) % 25, " ".join(tokens)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), width=2)
    assert {r[0]: (r[1], r[2]) for r in got.collect()} == brute.components(rows)


def test_bpe(docs, empty, rows):
    from tokenizers import Tokenizer

    name = tokenizer_file("word_bpe_49k.json")
    got = bpe.encode_decode(docs, name)
    assert set(docs.columns) <= set(got.columns)
    found = got.select("doc_id", "n_tokens", F.sha2("ids", 256), F.sha2("decoded", 256)).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, brute.coded(rows, Tokenizer.from_file(name))))
    assert bpe.encode_decode(empty, name).count() == 0


def test_bpe_streams_any_cut():
    from tokenizers import Tokenizer

    name = tokenizer_file("word_bpe_49k.json")
    tokenizer, vocabulary = Tokenizer.from_file(name), bpe.Vocabulary(name)
    source = random.Random(11)
    for alphabet in ("abcdefghijklmnopqrstuvwxyz", "ab", "a", "the'sandrell", "aé\u0301\u0323\u1100\u1161\u11a8ΣßI", "!?'s.1a", "inthanreero"):
        text = "".join(source.choices(alphabet, k=3000))
        want = tokenizer.encode(text, add_special_tokens=False).ids
        transducer, got, at, most = bpe.ChunkTransducer(vocabulary), [], 0, 0
        while at < len(text):
            step = source.choice([1, 2, 5, 40, 700])
            got += transducer.push(text[at:at + step])
            most = max(most, len(transducer.word.pending))
            at += step
        got += transducer.push("", last=True)
        assert got == want, alphabet
        assert most <= 6 * transducer.word.hold
        assert bpe.Encoder(vocabulary).encode(text) == want


def test_bpe_takes_distinct_words_of_a_batch_once(monkeypatch):
    """Each distinct word of some texts goes through the transducer once, however few words are remembered."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "CACHE_WORDS", 2)
    name = tokenizer_file("word_bpe_49k.json")
    tokenizer, coder, source = Tokenizer.from_file(name), bpe.TextCoder(name), random.Random(12)
    words = ["".join(source.choices("aeinorst", k=source.choice([1, 3, 9, 64, 65, 200]))) for _ in range(200)]
    marks = [" ", "  ", ", ", "\n", "\xa0", "\u3000", "'s ", "\x1c", "<|endoftext|>", " " + "ab" * 300 + " ", " é\u0301 ", "... "]
    texts = ["", " \n"] + ["".join(source.choice(words) + source.choice(marks) for _ in range(50)) for _ in range(60)]
    taken, whole = [], bpe.WordTransducer.whole
    monkeypatch.setattr(bpe.WordTransducer, "whole", lambda self, some: taken.extend(some) or whole(self, some))
    for portion in (100_000, 7):
        taken.clear()
        monkeypatch.setattr(bpe, "CHUNKS_AT_ONCE", portion)
        counts, ids, decoded = (column.to_pylist() for column in coder.code(pa.array(texts)))
        wanted = [tokenizer.encode(text, add_special_tokens=False).ids for text in texts]
        assert ids == [" ".join(map(str, want)) for want in wanted] and counts == [*map(len, wanted)]
        assert decoded == [tokenizer.decode(want, skip_special_tokens=False) for want in wanted]
        assert portion == 7 or len(taken) == len(set(taken)) > 150


def test_bpe_words_together_or_alone(monkeypatch):
    monkeypatch.setattr(bpe, "WORDS_AT_ONCE", 70)
    transducer, source = bpe.WordTransducer(bpe.Vocabulary(tokenizer_file("word_bpe_49k.json"))), random.Random(13)
    words = ["".join(source.choices(source.choice(["ab", "inthaer", "aé東", "=", "'lre"]), k=source.randint(1, 40))).encode() for _ in range(500)]
    alone = [transducer.push(word) + transducer.finish() for word in words]
    assert [np.frombuffer(raw, bpe.PACKED).tolist() for raw in transducer.whole(words)] == alone
    assert transducer.whole([]) == []


def test_byte_level_decoder():
    decoder = bpe.Decoder.__new__(bpe.Decoder)
    symbols = bpe.byte_symbols()
    text = "é\U0001f600x"
    decoder.tokens = {i: symbols[b] for i, b in enumerate(text.encode() + b"\xff\xe2\x82")}
    decoder.bytes = {s: b for b, s in enumerate(symbols)}
    decoder.state, decoder.begun = bpe.codecs.getincrementaldecoder("utf-8")("replace"), False
    got = "".join(decoder.push([i]) for i in decoder.tokens) + decoder.finish()
    assert got == (text.encode() + b"\xff\xe2\x82").decode(errors="replace")


def test_personal_data(docs, empty, rows):
    found = pii.find_personal_data(docs)
    got = found.select("doc_id", *[pii.count_of("base", kind) for kind in ("email", "ip", "card", "phone")],
                       pii.written(F.col("base"))).collect()
    want = [(i, *brute.personal(t)[0], brute.personal(t)[1]) for i, t in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert pii.find_personal_data(empty).count() == 0
    assert pii.sanitize(docs).columns == docs.columns


def test_telling_terms(spark):
    """A term that stands only with an entity, in enough different lines, is marked where the entity is; frequent ones are not."""
    rows = [(i, f"note {words(5)} Quillfeather wrote from q@mail.example.com today\nnext line") for i in range(4)]
    rows += [(10 + i, f"{words(8)} wrote today from elsewhere\nanother note {words(4)}") for i in range(30)]
    rows += [(50, "Quillfeather q@mail.example.com"), (51, "Quillfeather alone"), (52, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    terms = {r["doc_id"]: [(s["match"], s["start"]) for s in r["spans"] if s["kind"] == "term"] for r in pii.find_personal_data(df, disclosure=0.7).collect()}
    assert terms[50] == [("Quillfeather", 0)]
    assert all([m for m, _ in terms[i]] == ["Quillfeather"] for i in range(4))
    assert not any(terms[i] for i in [*range(10, 40), 51, 52])
    clean = {r[0]: r[1] for r in pii.sanitize(df, disclosure=0.7).collect()}
    assert clean[50] == "[TERM] [EMAIL]" and clean[51] == "Quillfeather alone" and clean[52] == ""
    assert {r[0]: r[1] for r in pii.sanitize(df, remove_terms=True, disclosure=0.7).collect()}[50] == " [EMAIL]"


def test_rare_entities_are_judged_at_the_default(spark):
    """Two meetings, in the entity's line or beside it, or a single one in a large corpus; copies of a line are one meeting."""
    rows = [(1, "common Quillfeather q@mail.example.com\nthe end"), (2, "so Quillfeather wrote common to q@mail.example.com"),
            (3, "signed Marrowby\nm@mail.example.com common"), (4, "n@mail.example.com, m@mail.example.com\ncommon by Marrowby"),
            (5, "Oddfellow o@mail.example.com common")] + [(i, "Copperpot c@mail.example.com common") for i in (6, 7, 8, 9)]

    def marked(lines):
        rest = spark.range(100, 200).select(F.col("id").alias("doc_id"), F.expr(f"repeat('common filler\n', {lines})").alias("text"))
        found = pii.find_personal_data(spark.createDataFrame(rows, "doc_id bigint, text string").union(rest)).where("doc_id < 100")
        return {r["doc_id"]: [s["match"] for s in r["spans"] if s["kind"] == "term"] for r in found.collect()}

    few = {1: ["Quillfeather"], 2: ["Quillfeather"], 3: ["Marrowby"], 4: ["Marrowby"], 5: [], 6: [], 7: [], 8: [], 9: []}
    assert marked(800) == few
    many = marked(6000)
    assert many[5] == ["Oddfellow"] and many[1] == ["Quillfeather"] and "Marrowby" in many[4] and not any("common" in terms for terms in many.values())


def test_long_runs_of_personal_data_characters(spark):
    long = ["a" * 50_000, "1" * 50_000, "1 " * 20_000, "a@" + "b." * 20_000, "+1" + "(" * 50_000, "1." * 20_000, "é@x.yé"]
    got = pii.find_personal_data(spark.createDataFrame(list(enumerate(long)), "doc_id bigint, text string"))
    assert {r[0]: r[1] for r in got.select("doc_id", pii.written(F.col("base"))).collect()} == {i: brute.personal(t)[1] for i, t in enumerate(long)}


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "http://NET", "http://a.NET/x", "https://Example.net/en/1?x", "http://example.net/en", "ftp://b.example.com/de/#t",
            "http://notexample.com/de/", "x://y.org/fr/?http://a.net/", "http://org/fr/", "http://a..net/", "http://ü.net/ö?\n", "a\nb://q.net/\nz", "http://q.net/"]
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(3, urls[3], "h")], "page_id int, url string, host string")
    got = url_filter.filter_urls(df, rules)

    def plain(url):
        if url is None or "://" not in url:
            return "", "", None, "allow"
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = brute.ascii_lower(rest[:cut])
        path = rest[cut:]
        path = path[:min([path.find(c) for c in "?#" if c in path] or [len(path)])]
        fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, max(fits)[1], max(fits)[2]) if fits else (host, path, None, "allow")

    found = got.select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(str, map(tuple, found))) == sorted(str((i, *plain(u))) for i, u in [*enumerate(urls), (3, urls[3])])
    assert url_filter.filter_urls(df.where("false"), rules).count() == 0
    assert {r["verdict"] for r in url_filter.filter_urls(df, []).collect()} == {"allow"}


def test_equal_digests_are_told_apart():
    """Strings are compared, not only digests."""
    index = url_filter.build_index([("a.b", "/", "block"), ("c.d", "/", "block")])
    forged = index._replace(keys=["other/", index.keys[1]])
    hosts = [k[:-1] for k in index.keys]
    assert [p >= 0 for p in url_filter.match(hosts, ["/", "/"], forged)] == [False, True]


def test_languages(spark, docs, empty):
    learned = language_id.fit_dictionaries(docs)
    assert list(learned) == ["xx"]
    got = language_id.identify(docs, learned)
    assert got.count() == docs.count()
    assert all(r["lang_pred"] == ("xx" if any(c.isalpha() for c in r["text"] or "") else "und") for r in got.collect())
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in language_id.identify(docs, {}).collect())
    assert language_id.fit_dictionaries(empty) == {} and language_id.identify(empty, learned).count() == 0
    assert language_id.keep_identified(docs, learned).columns == docs.columns


def test_quality(docs, empty, rows):
    ratios = quality.fit_ratios(docs, docs.where("doc_id % 2 = 0").select("doc_id"))
    got = quality.judge_quality(docs, ratios)
    base = brute.quality_base(list(enumerate(t for _, t in rows)))
    want = sorted(str((i, *base[n])) for n, (i, _) in enumerate(rows))
    assert sorted(str(tuple(r)) for r in got.select("doc_id", *quality.RESULTS[:6]).collect()) == want
    assert not quality.fit_ratios(empty, empty.select("doc_id")).any()
    assert quality.judge_quality(empty, ratios).count() == 0


def test_ratios_favour_the_target(spark):
    """Texts like the target score higher than others."""
    rows = [(1, "a b, a b"), (2, "a || b"), (3, None), (4, "b b b")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    ratios = quality.fit_ratios(df, df.where("doc_id in (1, 3)").select("doc_id"))
    assert (ratios < 0).any() and (ratios > 0).any()
    score = {r["doc_id"]: r["score"] for r in quality.judge_quality(df, ratios).collect()}
    assert score[1] > score[2] and score[1] > score[4] and score[3] == 0


def test_leaks(spark, docs, empty, rows):
    items = [(1, SHARED), (2, "one"), (3, None), (4, "two words"), (5, words(30, 1)), (5, words(25, 1)), (None, "!!!")]
    frame = spark.createDataFrame(items, "item_id bigint, text string")
    named = [(i, t) for i, t in rows if i is not None]
    found = {}
    for r in decontaminate.find_leaks(docs, frame).where("doc_id is not null").collect():
        found[r[0], r[1]] = max(round(r[2], 9), found.get((r[0], r[1]), 0))
    assert found == {k: round(v, 9) for k, v in brute.leaks(named, items).items()}
    leaking = {k[0] for k in found}
    kept = decontaminate.drop_leaks(docs, frame)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, _ in named if i not in leaking} | {None}
    assert decontaminate.find_leaks(docs, frame.where("false")).count() == 0 and decontaminate.drop_leaks(empty, frame).count() == 0


def test_items_cut_short_leak(spark):
    """A document that is an item less some words is compared as a whole."""
    item = [f"word{i}x{i % 7}" for i in range(60)]

    def grams(tokens):
        return {tuple(tokens[i:i + 5]): sum(map(len, tokens[i:i + 5])) for i in range(len(tokens) - 4)}

    texts = {1: item[:-1], 2: item[1:], 3: item[2:-2], 4: item[:30], 5: item[:4], 6: item, 7: ["before", *item[:-3]], 8: item[:52], 9: item[:46]}
    want = {}
    for doc, tokens in texts.items():
        if len(tokens) <= 60:
            both = sum(w for g, w in grams(tokens).items() if g in grams(item))
            score = both / (sum(grams(tokens).values()) + sum(grams(item).values()) - both)
            if score >= decontaminate.THRESHOLD:
                want[doc] = (round(score, 9), 0, len(tokens))
    assert sorted(want) == [1, 2, 3, 6, 7, 8]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, " ".join(item)), (2, "some other item of seven words here"), (3, " ".join(f"b{i}" for i in range(200)))], "item_id bigint, text string")
    found = decontaminate.find_leaks(df, items).collect()
    assert {r["doc_id"]: (round(r["similarity"], 9), r["first_word"], r["n_words"]) for r in found} == want
    assert {r["doc_id"] for r in decontaminate.drop_leaks(df, items).collect()} == {4, 5, 9}


def test_every_fingerprint_within_the_radius_is_found():
    source = np.random.default_rng(5)
    prints = source.integers(0, 1 << 63, 300, dtype=np.uint64)
    items = [decontaminate.Item(i, 9, np.zeros(1, np.uint64), np.ones(1), int(p)) for i, p in enumerate(prints)]
    index = decontaminate.SizeIndex(items)
    for _ in range(200):
        probe = int(prints[source.integers(300)])
        for bit in source.permutation(64)[:source.integers(0, 30)]:
            probe ^= 1 << int(bit)
        want = [i for i, p in enumerate(prints.tolist()) if (p ^ probe).bit_count() <= decontaminate.RADIUS]
        assert index.within(probe).tolist() == want
