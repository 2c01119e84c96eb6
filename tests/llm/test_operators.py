"""Each document operator against a plain version, on rows with every kind of awkward value."""

import base64
import gzip
import hashlib
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from cartolith.llm import decontaminate, html, language, packing, quality, repetition, secrets, sharding, simhash, warc
from cartolith.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, fingerprint string, score double, shard int, kept boolean, start long"


def prose(seed, n):
    rng = random.Random(seed)
    syllables = "ka lo mi ren tu sha ve oru nal et".split()
    return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(n))


def texts():
    a = prose(1, 300)
    return [
        a, a, prose(2, 120), prose(2, 120) + " tail", None, "", " \t\n", "one", "ONE", "two words", prose(3, 30) * 12, "x " * 9000, prose(4, 9000), "é" * 50 + "   ü", "line a\nline b\nline a\n\n", "#### $$$ %%",
        'api_key = "abcdefgh12345" then ' + "0af9" * 10 + " AKIA" + "B" * 16, "tail　wide ſecret=aaaaaaaaaa token: short", "1234 5678",
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "fr", None][i % 3], None if i % 4 == 0 else "s", None, 7, "f", 0.5, 3, False, 9) for i, t in enumerate(texts())]
    rows += [rows[0], rows[2], (None, texts()[2], None, None, None, None, None, None, None, None, None), (None, None) + (None,) * 9, (3, "another text under a known id " * 20) + (None,) * 9]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def same(got, want):
    key = lambda r: tuple((x is None, str(type(x)), str(x)) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_repetition_against_windows(docs, none):
    def plain(doc_id, text):
        words = WORD.findall(text or "")

        def cover(k):
            seen = Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
            return {j for i in range(len(words) - k + 1) if seen[tuple(words[i : i + k])] > 1 for j in range(i, i + k)}

        longest, high = 0, len(words)
        while longest < high:  # cover(k) empty is monotone in k
            mid = (longest + high + 1) // 2
            longest, high = (mid, high) if cover(mid) else (longest, mid - 1)
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        n, three, ten = len(words), len(cover(3)), len(cover(10))
        failed = n < 50 or 100 * three > 50 * n
        return doc_id, n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), three, failed, not failed and 100 * ten <= 20 * n and longest <= 100, ten, longest

    few = docs.where("text is null or length(text) < 20000")
    same(repetition.quality_rules(few).collect(), [plain(*p) for p in pairs(few)])
    assert repetition.quality_rules(docs).count() == docs.count()
    assert repetition.quality_rules(none).count() == 0


def test_lcp_intervals_are_the_maximal_repeats():
    ids = np.array([1, 2, 3, 1, 2, 3, 1, 2], np.int64)
    order, lcp = repetition.suffix_array(ids, np.zeros(8, np.int64), np.full(8, 8))
    assert [tuple(ids[i:]) for i in order] == sorted(tuple(ids[i:]) for i in range(8))
    assert sorted(repetition.lcp_intervals(order, lcp, 2)) == [(2, [0, 3, 6]), (3, [2, 5]), (4, [1, 4]), (5, [0, 3])]


def plain_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    prints = sorted({fp for _, fp in rows})
    up = {p: p for p in prints}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                up[root(a)] = root(b)
    least = defaultdict(lambda: None)
    for d, fp in rows:
        if d is not None and (least[root(fp)] is None or d < least[root(fp)]):
            least[root(fp)] = d
    return [(d, f"{fp:016x}", least[root(fp)]) for d, fp in rows]


def test_simhash_against_all_pairs(docs, none):
    want = plain_components([(d, plain_fingerprint(t)) for d, t in pairs(docs)])
    same(simhash.near_duplicates(docs).collect(), want)
    assert simhash.near_duplicates(none).count() == 0


def test_vantage_point_trees_lose_no_link():
    rng = np.random.default_rng(3)
    points = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    for _ in range(3):  # chains of near copies
        points = np.concatenate([points, points[rng.integers(0, len(points), 400)] ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64))])
    points = np.unique(points)
    tree = simhash.fit_tree(points[::3], 40, 2)
    at, leaf, own = simhash.route(tree, points, np.ones(len(points), bool), 2)
    assert own.sum() == len(points) and len(set(leaf)) > 20
    forest = simhash.Forest(len(points))
    for k in set(leaf.tolist()):
        here = at[leaf == k]
        for a, b in simhash.leaf_forest(points[here], own[leaf == k], 2, block=32):
            assert (int(points[here[a]]) ^ int(points[here[b]])).bit_count() <= 2
            forest.link(int(here[a]), int(here[b]))
    for i in range(len(points)):
        for j in np.flatnonzero(np.bitwise_count(points ^ points[i]) <= 2):
            assert forest.root(i) == forest.root(int(j))


def test_over_full_leaves_are_split(spark):
    rng = np.random.default_rng(6)
    points = rng.integers(0, 1 << 62, 1500).astype(np.uint64)
    points = np.unique(np.concatenate([points, points[:600] ^ (np.uint64(1) << rng.integers(0, 62, 600).astype(np.uint64)), np.uint64(5) ^ np.array([1 << b for b in range(60)], np.uint64)]))
    rows = [(int(k), int(f)) for k, f in enumerate(points.tolist())]
    every = spark.createDataFrame(rows + [(9999, rows[0][1])] * 3, "doc_id long, fp long")
    got = {r["fp"]: (r["component_id"], r["n"]) for r in simhash.link(every, leaf=40, sample=200).collect()}
    want = {int(f, 16): c for _, f, c in plain_components([(k, f) for k, f in rows])}
    assert got == {f: (c, 4 if f == rows[0][1] else 1) for f, c in want.items()}


def test_a_dense_leaf_is_searched_by_name():
    rng = np.random.default_rng(2)
    bits = np.array([rng.choice(64, 3, replace=False) for _ in range(9500)])
    points = np.unique(np.uint64(0x0F0F33335555AAAA) ^ (np.uint64(1) << bits.astype(np.uint64)).sum(axis=1).astype(np.uint64))
    own = np.zeros(len(points), bool)
    own[:300] = True
    edges = simhash.leaf_forest(points, own, 2)
    forest, plain = simhash.Forest(len(points)), simhash.Forest(len(points))
    for a, b in edges:
        assert (int(points[a]) ^ int(points[b])).bit_count() <= 2
        forest.link(a, b)
    for a in range(300):
        for b in np.flatnonzero(np.bitwise_count(points ^ points[a]) <= 2):
            plain.link(a, int(b))
    assert [forest.root(k) for k in range(len(points))] == [plain.root(k) for k in range(len(points))]


def test_keep_first_keeps_one_row_of_each_component(docs):
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    want = {fp: c for _, fp, c in plain_components([(d, plain_fingerprint(t)) for d, t in pairs(docs)])}
    rows = [(plain_fingerprint(t), d) for d, t in pairs(kept)]
    assert len(rows) == len(set(rows))
    for fp, d in rows:  # each row that stayed stands for its own component
        assert d == want[f"{fp:016x}"]
    assert {d for d, _ in pairs(kept)} >= {c for c in want.values() if c is not None}


def test_near_copies_by_five_word_shingles(spark, docs, none):
    def shingles(t):
        words = (t or "").lower().split()
        return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()

    rows = [(k, prose(k, 150)) for k in range(20)]
    for k in range(10):  # near copies: some words changed in one place or several
        words = prose(k, 150).split()
        for j in range(1 + k % 4):
            words[20 + 35 * j] = "changed"
        rows.append((100 + k, " ".join(words)))
    chain = prose(50, 200).split()
    rows += [(200 + k, " ".join(chain[10 * k : 10 * k + 120])) for k in range(6)]  # each like the next, the first unlike the last
    rows += [(300, None), (301, ""), (None, rows[0][1]), rows[3]]
    sets = [(d, shingles(t)) for d, t in rows]
    near = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b)
    groups = []
    for d, s in sets:
        own = [g for g in groups if any(near(s, x) for _, x in g)]
        groups = [g for g in groups if g not in own] + [[(d, s), *(x for g in own for x in g)]]
    assert len(groups) < 35
    want = sorted(min(d for d, _ in g if d is not None) for g in groups)
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = corpus_pipeline.near_dedup(spark, table, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == want
    assert sorted(r["doc_id"] for r in simhash.keep_dissimilar(table, bucket=3).collect()) == want
    assert corpus_pipeline.near_dedup(spark, docs, "").columns == docs.columns
    assert corpus_pipeline.near_dedup(spark, none, "").count() == 0


def test_near_copies_by_vantage_point_trees(spark):
    """Without any band, near copies are found by the trees alone."""
    sets = [simhash.shingle_sets(pa.array([prose(k % 20, 200).replace(" ", f" w{k} ", k // 20 * 2)]))[0] for k in range(120)]
    sets += [np.zeros(0, np.uint32)]
    prints = [simhash.set_fingerprint(x) for x in sets]
    rows = [(k, int(np.uint64(p).astype(np.int64)), []) for k, p in enumerate(prints)]
    nodes = spark.createDataFrame(rows, "fp long, print long, keys array<long>").repartition(3)
    table = spark.createDataFrame([(k, x.tobytes()) for k, x in enumerate(sets)], "fp long, set binary")
    plain = simhash.Forest(len(sets))
    for a in range(len(sets)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= simhash.NEAR and simhash.jaccard(sets[a], sets[b]) >= 0.8:
                plain.link(a, b)
    want = [plain.root(k) for k in range(len(sets))]
    assert 21 < len(set(want)) < 100
    for options in ({}, {"leaf": 8, "sample": 40}):
        roots = simhash.similar_roots(nodes, lambda wanted: table.join(wanted, "fp"), 0.8, **options)
        assert sorted(map(tuple, roots.collect())) == list(enumerate(want))


def test_near_pairs_make_rows_in_proportion(spark, monkeypatch):
    rng, made, kind = np.random.default_rng(8), [], type(spark.range(1))
    plain = kind.mapInPandas
    monkeypatch.setattr(kind, "mapInPandas", lambda *args: made.append(plain(*args)) or made[-1])
    counts = []
    for n in (2000, 10_000):
        made.clear()
        nodes = spark.createDataFrame(pd.DataFrame({"fp": np.arange(n), "print": rng.integers(-(1 << 62), 1 << 62, n)}))
        simhash.near_pairs(nodes, leaf=500).count()
        counts.append(made[0].count())
    assert counts == [7 * 2000, 7 * 10_000]


def test_parts_of_fingerprints_lose_no_link():
    rng = np.random.default_rng(9)
    flips = lambda n, most: np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, most + 1), replace=False)) for _ in range(n)], np.uint64)
    points = rng.integers(0, 1 << 63, 2000).astype(np.uint64)
    points = np.unique(np.concatenate([points, points[:500] ^ flips(500, 6), points[7] ^ flips(300, 3)]))
    parts = simhash.bit_parts(~np.uint64(0), 7)
    assert sum(int(x) for x in parts) == (1 << 64) - 1
    for block in (1024, 16, 2):
        forest, plain = simhash.Forest(len(points)), simhash.Forest(len(points))
        for part in parts:
            links = simhash.part_forest(points, part, 6, block)
            assert len(links) < len(points)
            for a, b in links:
                assert (int(points[a]) ^ int(points[b])).bit_count() <= 6
                forest.link(a, b)
        for a in range(len(points)):
            for b in np.flatnonzero(np.bitwise_count(points ^ points[a]) <= 6).tolist():
                plain.link(a, b)
        assert [forest.root(k) for k in range(len(points))] == [plain.root(k) for k in range(len(points))]
        assert 1900 < len({plain.root(k) for k in range(len(points))}) < 2100


def test_bucket_forest_joins_what_is_similar():
    rng = np.random.default_rng(4)
    words = rng.integers(1, 1 << 60, 400).astype(np.uint64)
    sets = []
    for k in range(60):  # copies with some words changed: near the limit, in chains
        own = words[:120].copy()
        own[rng.integers(0, 120, 2)] = rng.integers(1, 1 << 60, 2)
        sets.append(simhash._mixed(own))
    frame = pd.DataFrame({"fp": range(60), "root": range(60), "set": [x.tobytes() for x in sets]})
    both = pd.concat([frame.assign(probe=False), frame[5:].assign(probe=True)])
    forest, plain = simhash.Forest(60), simhash.Forest(60)
    links = simhash.bucket_forest(both, 0.8)
    assert len(links) < 60
    for a, b in links:
        assert simhash.jaccard(sets[a], sets[b]) >= 0.8
        forest.link(a, b)
    for a in range(5, 60):
        for b in range(60):
            if simhash.jaccard(sets[a], sets[b]) >= 0.8:
                plain.link(a, b)
    assert [forest.root(k) for k in range(60)] == [plain.root(k) for k in range(60)] and len({plain.root(k) for k in range(60)}) < 60


def test_warc_round_trip(spark):
    rows = [(1, "http://a/x", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://a\n b", ""), (4, "u", None), (None, "u", "<p>é</p>"), (5, "u", "x" * 3_000_000), (6, "u", "alone"), (6, "u", "alone")]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, payload string")
    last = {}
    for i, _, h in rows:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        revisit = i != last[h or ""]
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", last[h or ""] if revisit else None))
    same(warc.round_trip(pages).collect(), want)
    assert warc.round_trip(pages.where("false")).count() == 0


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_finds_every_undamaged_record(packed):
    rng = random.Random(5)
    records = [warc.build_record(i, f"http://h/{i}", rng.randbytes(rng.randint(0, 4000)), i - 1 if i % 5 == 4 else None) for i in range(60)]
    if packed:
        records = [gzip.compress(r, 6, mtime=0) for r in records]
    begin = np.cumsum([0, *map(len, records)])
    data = bytearray(b"".join(records))
    hurt = {7, 8, 20, 41}
    for k in hurt:
        data[begin[k] + (2 if k == 20 else len(records[k]) // 2)] ^= 0x55
    data = bytes(data[: begin[59] + 40])
    found = list(warc.Salvager(lambda at, n: data[at : at + n], len(data), step=3000))
    good = [x for x in found if isinstance(x, warc.Record)]
    assert [x.headers["warc-record-id"] for x in good] == [f"<urn:x-page:{i}>" for i in range(59) if i not in hurt]
    gaps = [(x.offset, x.length) for x in found if isinstance(x, warc.Gap)]
    assert gaps == [(begin[7], begin[9] - begin[7]), (begin[20], begin[21] - begin[20]), (begin[41], begin[42] - begin[41]), (begin[59], 40)]
    assert sum(x.length for x in found) == len(data)


def test_salvage_of_odd_archives():
    records = [warc.build_record(i, "http://h/", b"x" * i, None) for i in range(5)]
    old = [r.replace(b"WARC/1.1", b"WARC/0.18") for r in records]
    wide = records[0].replace(b"WARC-Date", b"X-Long: " + b"y" * 3_000_000 + b"\r\nWARC-Date")
    named = bytearray(gzip.compress(records[1], mtime=0))
    named[3] |= 8  # a file name of 10,000 letters in the member's header
    named[10:10] = b"n" * 10_000 + b"\0"
    read = lambda data, **k: list(warc.Salvager(lambda at, n: data[at : at + n], len(data), **k))
    ids = lambda found: [x.headers["warc-record-id"][12:-1] for x in found if isinstance(x, warc.Record)]
    whole = gzip.compress(b"".join(records), mtime=0)
    found = read(whole + gzip.compress(records[2], mtime=0))
    assert ids(found) == ["0", "1", "2", "3", "4", "2"] and sum(x.length for x in found) == len(whole) + len(gzip.compress(records[2], mtime=0))
    inner = bytearray(b"".join(records))
    inner[len(records[0]) + 20] ^= 1
    found = read(gzip.compress(bytes(inner), mtime=0))
    assert ids(found)[0] == "0" and set(ids(found)) >= {"0", "2", "3", "4"}
    assert ids(read(b"".join(old))) == ["0", "1", "2", "3", "4"]
    assert ids(read(wide + records[3])) == ["0", "3"] and ids(read(b"junk" + bytes(named) + b"more" + bytes(named), step=500)) == ["1", "1"]
    assert ids(read(b"")) == [] and [x.reason for x in read(b"\x1f\x8b\x08 not gzip")] == ["member check"]


def test_a_damaged_archive_is_told(spark, tmp_path, monkeypatch):
    pages = spark.createDataFrame([(k, "u", "text " * k) for k in range(40)], "page_id long, url string, html string").coalesce(1)
    files = warc.write_archives(pages, f"file://{tmp_path}/w")
    path = files.first()["path"].removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    data[len(data) // 2] ^= 0x55
    open(path, "wb").write(data)
    rows = warc.read_archives(files).collect()
    assert len([r for r in rows if r["reason"] is None]) == 39 and [r["length"] > 0 for r in rows if r["reason"]] == [True]
    monkeypatch.setattr(warc, "write_archives", lambda *_: files)
    with pytest.raises(OSError, match="40 records written, 39 read; 1 gaps"):
        warc.round_trip(pages)


def test_packing_is_a_partition_of_the_ids(docs, none, spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    ids = {p: tokenizer.encode(p[1] or "", add_special_tokens=False).ids + [1] for p in set(pairs(docs))}
    by_doc = Counter()
    for d, t in pairs(docs):
        by_doc[d] += len(ids[d, t])
    for options in ({}, {"shard_tokens": 5000, "window": 256}):
        window = options.get("window", 2048)
        rows = packing.pack(docs, **options).collect()
        got, sequences = Counter(), defaultdict(list)
        for r in rows:
            got[r["doc_id"]] += r["length"]
            sequences[r["sequence_id"]].append((r["offset"], r["length"]))
            assert any(len(x) == r["doc_tokens"] and crc32(np.array(x[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"] for (d, _), x in ids.items() if d == r["doc_id"])
        assert got == by_doc
        for parts in sequences.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at and length > 0
                at += length
            assert at <= window
        full = sum(sum(n for _, n in p) == window for p in sequences.values())
        assert full >= sum(by_doc.values()) // window - len({s >> 32 for s in sequences})
    assert packing.pack(none).count() == 0


def test_encoder_equals_tokenizer():
    e = packing.Encoder(packing.default_tokenizer(), keep=100)
    odd = ["it's we'll '' ''s 'tis", "ÀÉ œuvre ÿ ſ İ", "a\x85b\xa0c \x1c d\x1de", "<|endoftext|> x", "² ½ 12,5 a_b", "", "日本語 text", "!" * 300, prose(8, 500), None, "a'", "'s", "x'LL'S's'rex", "É'd÷×µ"]
    rng = random.Random(3)
    odd += ["".join(rng.choices("abcs' tdlrevm'ÀéßÞ×÷ªº²½9 7\x85\xa0\t\n\x1c-.!_<|\x00\x7f", k=rng.randint(0, 60))) for _ in range(2000)]
    for texts in (odd, odd[::-1], [], [""]):
        ids, begin = e(pa.array(texts, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(begin[:-1], begin[1:])] == [e.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_bm25_against_the_formula():
    rng = np.random.default_rng(8)
    docs = [rng.zipf(1.4, rng.integers(1, 80)) % 300 for _ in range(60)]
    begin, ids = np.cumsum([0, *map(len, docs)]), np.concatenate(docs)
    df = np.array([sum((d == t).any() for d in docs) for t in range(300)])
    idf, mean = np.log1p((60 - df + 0.5) / (df + 0.5)), len(ids) / 60
    index = packing.Bm25(ids, begin, idf, mean)
    assert len(index.rows) and len(index.doc)  # terms of both sorts
    for seed in range(60):
        got = index.scores(seed)
        for d in range(60):
            tf = Counter(docs[d].tolist())
            want = sum(idf[t] * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(docs[d]) / mean)) for t in set(docs[seed].tolist()) if tf[t])
            if d != seed:
                assert got[d] == pytest.approx(want, rel=1e-5, abs=1e-5)


def test_a_window_holds_the_nearest_unused_documents():
    rng = np.random.default_rng(9)
    docs = [rng.choice(40, 30) + 40 * (k % 3) for k in range(30)]  # three vocabularies
    begin, ids = np.cumsum([0, *map(len, docs)]), np.concatenate(docs)
    df = np.array([sum((d == t).any() for d in docs) for t in range(120)])
    idf = np.log1p((30 - df + 0.5) / (df + 0.5))
    pieces = packing.pack_shard(ids, begin, idf, 30.0, 300)
    first = [d for d, _, _, s, _ in pieces if s == 0]
    plain = packing.Bm25(ids, begin, idf, 30.0).scores(0)
    plain[0] = -1
    assert first == [0, *sorted(range(30), key=lambda d: (-plain[d], d))[:9]] and {d % 3 for d in first} == {0}


def test_packing_ranks_neighbours_by_bm25():
    docs = [np.array([5, 6, 7] * 3), np.array([50, 60, 70] * 3), np.array([5, 6, 9] * 3)]
    idf = np.ones(100)
    pieces = packing.pack_shard(np.concatenate(docs), np.array([0, 9, 18, 27]), idf, 9.0, 18)
    assert [(d, n) for d, _, n, s, _ in pieces if s == 0] == [(0, 9), (2, 9)]


def test_language_on_held_out_rows(spark, sf_dir, docs, none):
    all_docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = language.identify(all_docs).join(all_docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.95 * len(rows) and all(0 <= r["score"] <= 1 for r in rows)
    got = {(r["doc_id"], r["lang_pred"] == "und") for r in language.identify(docs).collect()}
    assert got == {(d, not any(c.isalpha() for c in t or "")) for d, t in pairs(docs)}
    assert {r["held_out"] for r in language.identify(docs).where("doc_id is null").collect()} == {False}
    assert language.identify(none).count() == 0
    assert {r["lang_pred"] for r in language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.keep_identified(docs).columns == docs.columns


def test_language_scores_against_plain_bayes():
    rows = [("b", "abc abd"), ("a", "xyz xyy"), ("b", "abba"), ("c", "xy ab"), ("a", "zzz")]
    found = []
    for lang in "abc":
        own = [t for g, t in rows if g == lang]
        keys, n, _ = language.gram_counts(own)
        sums = Counter()
        for k, c in zip((keys % language.BUCKETS).tolist(), n.tolist()):
            sums[k] += c
        found += [(lang, k, c) for k, c in sums.items()] + [(lang, -1, len(own))]
    model = language.Model(pd.DataFrame(found, columns=["lang", "bucket", "n"]), language.BUCKETS, 0.5)

    def grams(t):
        t = re.sub(r"[^a-z]+", " ", t.lower()) + " "
        return [t[i : i + k] for k in (1, 2, 3) for i in range(len(t) - k + 1) if (t[i : i + k].strip() if k < 3 else t[i + 1] != " ")]

    def plain(text):
        logs = []
        for lang in "abc":
            have = Counter(g for x, t in rows if x == lang for g in grams(t))
            total = sum(have.values())
            log = np.log(sum(x == lang for x, _ in rows) / len(rows)) + sum(np.log((have[g] + 0.5) / (total + 0.5 * language.BUCKETS)) for g in grams(text))
            logs.append(log)
        return "abc"[int(np.argmax(logs))], 1 / np.exp(np.array(logs) - max(logs)).sum()

    asked = ["abd", "zzx, yyx", "xy", "AB? xy!", "c", "1 2", None, "a" * 50_000]
    for at_once in (64, 2, 1):
        language.AT_ONCE, model._whole = at_once, None
        names, sure = model.score(asked)
        assert names[5:7] == ["und", "und"] and sure[5:7] == [0.0, 0.0]
        for k in (0, 1, 2, 3, 4, 7):
            name, p = plain(asked[k])
            assert names[k] == name and sure[k] == pytest.approx(p, rel=1e-4)
    language.AT_ONCE = 64
    tie = language.Model(pd.DataFrame([(g, b, 1) for g in "zyx" for b in (-1, 7)], columns=["lang", "bucket", "n"]), language.BUCKETS, 0.5)
    assert tie.score(["abc"])[0] == ["x"]


def test_decontamination_recall_against_full_scans(spark):
    """All planted items that a scan of every slice finds by the same rule, with a fifth to over a third of their words replaced."""
    rng = random.Random(21)
    items = [prose(700 + k, rng.randint(14, 60)) for k in range(100)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    s = decontaminate.Settings()

    def scan(text, item, idf):
        words, want = decontaminate.word_hashes(text).tolist(), decontaminate.word_hashes(item).tolist()
        m, known = len(want), set(want)
        rare = set(sorted(known, key=lambda w: (-idf[w % s.terms], w))[: s.answer_words])
        for a in range(max(1, len(words) - (m + m // 4 + -(-m // 4)) + 1)):
            part = words[a : a + m + m // 4 + -(-m // 4)]
            if sum(w in known for w in part) >= s.part * m:
                share = decontaminate.common_subsequence(want, part) / m
                if share >= s.whole or share >= s.part and len(rare & set(part)) >= s.answer * len(rare):
                    return True
        return False

    for changed in (0.2, 0.3, 0.35):
        rows = []
        for k, item in enumerate(items):
            words = item.split()
            for j in rng.sample(range(len(words)), round(changed * len(words))):
                words[j] = prose(rng.randrange(10**6), 1)
            rows.append((k, f"{prose(3000 + k, rng.randint(0, 90))} {' '.join(words)} {prose(5000 + k, rng.randint(20, 150))}"))
        rows += [(1000 + k, prose(9000 + k, 150)) for k in range(200)]
        found = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
        df = Counter(t for _, text in rows for t in set((decontaminate.word_hashes(text) % s.terms).tolist()))
        idf = defaultdict(float, {t: np.float32(np.log1p((len(rows) - n + 0.5) / (n + 0.5))) for t, n in df.items()})
        idf.default_factory = lambda: np.float32(np.log1p((len(rows) + 0.5) / 0.5))
        real = [k for k in range(100) if scan(rows[k][1], items[k], idf)]
        assert len(real) > 20 and sum((k, k) in found for k in real) >= 0.9 * len(real) and not any(d >= 1000 for d, _ in found)


def test_the_latent_space_is_made_of_all_passages(spark, monkeypatch):
    """More passages than any sample held: every term has its vector, and the vectors are those of a plain SVD of all."""
    s, n = decontaminate.Settings(terms=1 << 8, rank=8, common=2, extra=60, power=2), 100_000
    words = np.random.default_rng(3).integers(0, 40, (n, 2)).astype("<u4")
    words[:, 1] += 40
    words[::2500] = np.arange(160, 240).reshape(40, 2)  # each a term of one passage alone
    df = np.bincount(words.reshape(-1), minlength=s.terms)  # a row's words differ
    idf = np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32)
    windows = [np.array([k, k + 1, 100 + k], "<u4") for k in range(30)]
    table = spark.createDataFrame(pd.DataFrame({"words": [x.tobytes() for x in words], "n": 2})).repartition(9)
    monkeypatch.setattr(decontaminate, "SHARE", 15_000, raising=False)
    monkeypatch.setattr(decontaminate, "FAN", 2, raising=False)
    used, got = decontaminate.latent_space(table, idf, spark.createDataFrame([(x.tobytes(),) for x in windows], "words binary"), s)
    assert sorted(used.tolist()) == sorted({*words.reshape(-1).tolist(), *(int(t) for x in windows for t in x)})
    plain = np.zeros((n + 30, s.terms))
    for rows, first in ((words, 0), (np.array(windows), n)):
        for column in rows.T:
            plain[first + np.arange(len(rows)), column] += idf[column]
    plain /= np.linalg.norm(plain, axis=1, keepdims=True)
    plain[:n] *= np.sqrt(30 / n)
    value, vector = np.linalg.eigh(plain.T @ plain)
    value, vector = value[::-1][2:10], vector[:, ::-1][used, 2:10]
    want = vector / np.sqrt(value)
    assert np.abs(got @ got.T - want @ want.T).max() < 0.02 * np.abs(want @ want.T).max()


def test_word_hashes_are_taken_without_a_call_a_word(monkeypatch):
    words = ["", "a", "bc", "été", "ß" * 40, "x" * 1000, *(f"w{k}" * (k % 7) for k in range(500))]
    for few in ([], [""], words):
        made = decontaminate.crc32s(pa.array(few, pa.string()))
        assert made.dtype == np.uint32 and made.tolist() == [crc32(w.encode()) for w in few]
    assert decontaminate.crc32s(pa.array(words)[3:6]).tolist() == [crc32(w.encode()) for w in words[3:6]]
    texts = [prose(k, 60) for k in range(5)] + [None, "", " ", "Été à ß, 12_3 x"]
    want = [decontaminate.word_hashes(x).tolist() for x in texts]
    calls = []
    monkeypatch.setattr(decontaminate, "crc32", lambda x: calls.append(x) or crc32(x))
    hashes, begin = decontaminate.all_hashes(pa.array(texts))
    assert [hashes[a:b].tolist() for a, b in zip(begin, begin[1:])] == want and not calls


def test_products_are_those_of_the_matrix():
    rng = np.random.default_rng(6)
    sizes = rng.integers(1, 49, 600)
    row = np.where(rng.random(sizes.sum()) < 0.4, 3, rng.integers(0, 500, sizes.sum())).astype(np.int32)
    idf, shares, x = rng.random(500).astype(np.float32) + 0.5, rng.random(600), rng.standard_normal((500, 7)).astype(np.float32)
    a, whose = np.zeros((600, 500)), np.repeat(np.arange(600), sizes)
    np.add.at(a, (whose, row), idf[row])
    a *= (shares / np.sqrt(np.bincount(whose, idf[row].astype(np.float64) ** 2)))[:, None]
    out = np.zeros_like(x)
    rows = decontaminate._products(row, sizes, shares, idf, x, out)
    assert np.allclose(rows, a @ x, atol=1e-4) and np.allclose(out, a.T @ (a @ x), atol=1e-3)


def test_decontamination_judges_each_row(spark):
    item = prose(77, 30)
    leak, clean = f"{prose(1, 40)} {item} {prose(2, 40)}", prose(3, 100)
    long = f"{prose(4, 30_000)} {item} {prose(5, 30_000)}"
    rows = [(None, leak, 1), (None, clean, 2), (7, leak, 3), (7, clean, 4), (8, None, 5), (9, "", 6), (10, long, 7), (10, clean, 8), (10, clean, 9), (11, "日本 " + item.upper() + " ſ", 10)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, words int, `a.b` int")
    bench = spark.createDataFrame([(0, item), (1, "never seen anywhere at all"), (2, None)], "item_id long, text string")
    for settings in (decontaminate.Settings(), decontaminate.Settings(block_words=4)):
        kept = decontaminate.drop_leaks(docs, bench, settings=settings)
        assert kept.columns == docs.columns and sorted(r["words"] for r in kept.collect()) == [2, 4, 5, 6, 8, 9]
    assert sorted(r["words"] for r in decontaminate.drop_leaks(docs, bench.where("false")).collect()) == list(range(1, 11))
    assert decontaminate.drop_leaks(docs.where("false"), bench).count() == 0


def test_decontamination_finds_copies_and_paraphrases(spark):
    items = [prose(100 + k, 15 + k) for k in range(30)] + ["short one here", "", None]
    rng = random.Random(9)
    rows = []
    for k in range(30):
        words = items[k].split()
        if k % 3 == 1:
            words[rng.randrange(len(words))] = "zzz"
        rows.append((k, prose(200 + k, 100) + "\n" + " ".join(words).upper() + ". " + prose(300 + k, 100)))
    rows += [(100 + k, prose(400 + k, 200)) for k in range(30)] + [(200, None), (201, ""), (None, items[0]), (0, rows[0][1])]
    docs = spark.createDataFrame([(*r, 1.0, 5) for r in rows], "doc_id long, text string, cosine double, item_id long")
    bench = spark.createDataFrame([(k, t, "x") for k, t in enumerate(items)], "item_id long, text string, doc_id string")
    got = [(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, bench).collect()]
    assert Counter(got) == Counter([(k, k) for k in range(30)] + [(None, 0), (0, 0)])
    small = decontaminate.Settings(block_words=100)
    assert Counter(got) == Counter((r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, bench, settings=small).collect())
    assert decontaminate.find_leaks(docs.where("false"), bench).count() == 0
    assert decontaminate.find_leaks(docs, bench.where("false")).count() == 0
    alone = docs.where("doc_id = 7")
    assert [(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(alone, bench).collect()] == [(7, 7)]
    kept = decontaminate.drop_leaks(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {*range(100, 130), 200, 201}


def test_decontamination_finds_items_whose_start_is_missing(spark):
    items = [prose(100 + k, 40) for k in range(6)]
    rows = [(k, " ".join(items[k].split()[4 + k % 3 * 2 :]) + " " + prose(300 + k, 60)) for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, bench).collect()) == [(k, k) for k in range(6)]


def test_common_subsequence():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        return row[-1]

    rng = random.Random(2)
    for _ in range(50):
        a, b = rng.choices(range(5), k=rng.randint(1, 40)), rng.choices(range(5), k=rng.randint(0, 40))
        assert decontaminate.common_subsequence(a, b) == plain(a, b)


def test_sharding_is_rendezvous(docs, none):
    rows = sharding.shard(docs, [1.0] * 16, [1.0] * 17).collect()
    texts_of = Counter((d, len((t or "").encode()) + 1, crc32((t or "").encode())) for d, t in pairs(docs))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == texts_of
    assert all(r["grown_shard"] in (r["shard"], 16) for r in rows)
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())

    def plain(doc_id, n):
        key = "null" if doc_id is None else f"k{doc_id}"
        u = lambda s: (int(hashlib.md5(f"{key}@{s}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13
        return max(range(n), key=lambda s: 1 / -np.log(u(s)))

    assert all((r["shard"], r["grown_shard"]) == (plain(r["doc_id"], 16), plain(r["doc_id"], 17)) for r in rows)
    assert sharding.shard(none, [1.0] * 16).count() == 0


def test_sharding_follows_weights(spark):
    ids = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    counts = {r["shard"]: r["count"] for r in sharding.shard(ids, [1.0, 3.0, 0.0]).groupBy("shard").count().collect()}
    assert set(counts) == {0, 1} and abs(counts[1] / 20_000 - 0.75) < 0.02


def test_secrets_against_full_scans(docs, none):
    rules = secrets.RULES

    def plain(doc_id, text):
        spans = []
        for k, r in enumerate(rules):
            spans += [(m.start(), k, m.end()) for m in re.finditer(r.pattern, text or "", r.flags) if len(m[r.group]) >= r.least]
        spans.sort()
        text_of = lambda keep: ",".join(f"{rules[k].kind}:{a}:{b}" for a, k, b in spans if keep(k))
        return doc_id, *(sum(k == j for _, k, _ in spans) for j in range(3)), hashlib.sha256(text_of(lambda k: k < 3).encode()).hexdigest(), text_of(lambda k: True)

    want = [plain(*p) for p in pairs(docs)]
    assert sum(r[1] for r in want) and sum(r[2] for r in want) and sum(r[3] for r in want)
    same(secrets.scan_secrets(docs).collect(), want)
    assert secrets.scan_secrets(none).count() == 0
    masked = secrets.mask_secrets(docs)
    assert masked.columns == docs.columns and masked.count() == docs.count()
    assert not any(r["base_sha256"] != hashlib.sha256(b"").hexdigest() for r in secrets.scan_secrets(masked).collect())


def test_secrets_are_masked_whole(spark):
    body = "\n".join(("MIIEpAIBAAKCAQEA" + "Qx7/+zYk" * 6)[: 64 - 20 * (k == 3)] for k in range(4)) + "\nq1=="
    begin, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    texts = [f"a {begin}\n{body}\n{end} b", f"a {begin}\nDEK-Info: AES-128-CBC,77\n\n{body}\n{end} b", f"a {begin}\n{body} b", f"a {begin} b {begin}\n{body}\n{end} c", f"a {begin}" + (f"\n{body}\n{end}").replace("\n", r"\n") + " b"]
    texts += ["git clone https://" + "u" * 90 + ":" + "tok3n_" * 30 + "@host.example/x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r["text"] for r in secrets.mask_secrets(docs).orderBy("doc_id").collect()]
    assert got == ["a [secret] b"] * 3 + ["a [secret] b [secret] c", "a [secret] b", "git clone [secret]ost.example/x"]


@pytest.mark.parametrize("pattern,matching", [("ab(cdef.*ghi)jkl", "abcdefXXghijkl"), ("(foo|bar+)baz", "barrbaz"), ("x?yzw", "yzw"), ("(?:abc){2,}d", "abcabcd"), ("[ab]cde|fgh", "fgh"), ("a.c", "abc"), ("colou?r(ed|s)", "colors")])
def test_trigram_queries_hold_for_matches(pattern, matching):
    assert re.search(pattern, matching)
    query = secrets.trigram_query(pattern)
    index = secrets.TrigramIndex([matching.encode(), b"nothing"], frozenset(secrets._trigrams(query)))
    assert 0 in index.answer(query)


PAGE = '<!DOCTYPE html><html><head><title>t</title><script>var t="</p>";</script></head><body><nav><ul><li>menu %d<li>b</ul></nav><div class="ad">buy %d</div><article><h1>Head %d</h1><p>One &amp; two\n three<p><b>bold <i>x</i><br><p>%s</p><div id="comments"><p>reader says</p></div></article><aside>side</aside><footer>&copy; host</footer></body></html>'


def test_html_main_text(spark):
    rows = [(k, f"https://Host.example/{k}", PAGE % (k, k, k, "same" if k % 2 else prose(k, 5))) for k in range(9)]
    rows += [(9, "http://b.example:80/x", None), (10, None, ""), (11, "nonsense", "just text"), (None, "https://host.example/z", PAGE % (1, 1, 1, "q")), rows[0]]
    pages = spark.createDataFrame([(*r, "c", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    want = []
    for i, u, h in rows:
        if h and "<article>" in h:
            n = re.search(r"<h1>(.*?)</h1>", h)[1]
            last = re.search(r"<br><p>(.*?)</p>", h)[1]
            text = f"{n}\nOne & two three\nbold x\n{last}"
        else:
            text = h or ""
        want.append((i, u, text, len(text)))
    same(html.extract_text(pages).collect(), want)
    same(html.extract_text(pages, broadcast_bytes=0).collect(), want)
    assert html.extract_text(pages.where("false")).count() == 0


def test_tree_matching_against_all_matchings():
    rng = random.Random(4)

    def tree(depth):
        return [rng.choice("ab"), "", [tree(depth - 1) for _ in range(rng.randint(0, 3))] if depth else []]

    def plain(a, b):
        if a[0] != b[0]:
            return 0

        def best(x, y):  # order-preserving matchings of two lists of subtrees, by trying all
            if not x or not y:
                return 0
            return max(best(x[1:], y), best(x, y[1:]), plain(x[0], y[0]) + best(x[1:], y[1:]))

        return 1 + best(a[2], b[2])

    for _ in range(200):
        a, b = tree(3), tree(3)
        size, pairs = html.match(a, b, {})
        assert size == plain(a, b) and pairs == sorted(pairs) and (not size or size == 1 + sum(plain(a[2][i], b[2][j]) for i, j in pairs))


PROBES = [
    ('<body><form id="aspnetForm"><h1>T</h1><p>one two</p></form></body>', "T\none two"),
    ('<body><div class="content sidebar-right"><p>hello world</p></div></body>', "hello world"),
    ("<body><article><header><h1>Headline</h1><p>By me</p></header><p>body text one two three four</p></article></body>", "Headline\nbody text one two three four"),
    ('<body><article><h1>X</h1><p id="share-of-market">kept one</p><p class="notice">kept two</p><div class="share-bar">tweet</div></article></body>', "X\nkept one\nkept two"),
    ("<body><p>long text outside of the short main element</p><main>short</main></body>", "long text outside of the short main element\nshort"),
    ("<body><div id=comments>long long long long comment text here</div><div>article text is here</div></body>", "article text is here"),
    ("<body><nav>m m</nav><div class=ad>ad sentence of many words</div><article><h1>W</h1><p>ab</article><footer>&copy; host long sentence</footer></body>", "W\nab"),
    ("<div>" * 5000 + "deep", "deep"),
]


def test_names_do_not_drop_what_a_page_is_about(spark):
    rows = [(k, f"http://h{k}.example/", page) for k, (page, _) in enumerate(PROBES)]
    got = {r["page_id"]: r["text"] for r in html.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: text for k, (_, text) in enumerate(PROBES)}


def test_the_wrapper_decides_where_names_say_nothing(spark):
    tops, tails = [f"Section {k} of our site" for k in range(6)], [f"Printed by house {k}" for k in range(4)]
    page = "<body><div class=aa>%s</div><div class=bb><h2>Story %d</h2><p>%s</p></div><div class=cc><span>%s</span></div></body>"
    rows = [(k, "http://a.example/", page % (tops[k % 6], k, prose(k, 12), tails[k % 4])) for k in range(60)]
    rows += [(100, "http://alone.example/", rows[0][2])]
    mirror = "<body><!-- %d --><div class=aa>%s</div><div class=bb><p>%s</p></div></body>"  # one article on most pages of a host
    rows += [(200 + k, "http://m.example/", mirror % (k, tops[k % 2] if k < 19 else prose(k, 4), prose(50, 60) if k < 18 else prose(k, 60))) for k in range(20)]
    got = {r["page_id"]: r["text"] for r in html.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    for k in range(60):
        assert got[k] == f"Story {k}\n{prose(k, 12)}"
    assert got[100] == f"{tops[0]}\nStory 0\n{prose(0, 12)}\n{tails[0]}"  # without a wrapper
    assert all(prose(50, 60) in got[200 + k] for k in range(18)) and got[200] == prose(50, 60)


def test_wrapper_drops_constant_nodes():
    page = '<body><div id=top>Our site</div><div class="c"><p>One %d</p><ul><li>a<li>b%d</ul></div><div class="z">All rights</div></body>'
    wrapper = {p: True for p, c in html.induce([html.fold([html.parse(page % (i, i))]) for i in range(5)]).items() if c}
    assert html.extract(page % (9, 9), wrapper) == "One 9\na\nb9"
    assert html.extract('<body class="has-sidebar"><div class="no-sidebar">text</div><div class="left sidebar">no</div>') == "text"
    assert html.extract("<div>" * 5000 + "deep") == "deep"
    assert html.extract("<p title='a>b'>x</p><p class=\"open>y</p>") .startswith("x")


def test_template_is_told_by_text_over_all_pages(spark):
    page = "<body><div id=top>Our site</div><div class=box>%s</div><div class=c><p>One %d</p></div></body>"
    rows = [(k, "http://a.example/", page % ("Standing notice", k)) for k in range(40)] + [(40 + k, "http://a.example/", page % (f"Correction {k}", 40 + k)) for k in range(3)]
    rare = "<body><section class=top>Print view</section><section class=text>Two %d</section></body>"  # another layout, on few pages
    rows += [(50 + k, "http://a.example/", rare % k) for k in range(4)]
    got = {r["page_id"]: r["text"] for r in html.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert got == {k: f"One {k}" for k in range(40)} | {40 + k: f"Correction {k}\nOne {40 + k}" for k in range(3)} | {50 + k: f"Two {k}" for k in range(4)}


def test_template_is_dropped_inside_articles(spark):
    page = "<body><main><article><h1>Head %d</h1><p>%s</p><div class=box>Written in our house</div></article></main></body>"
    rows = [(k, "http://a.example/", page % (k, prose(k, 20))) for k in range(8)]
    rows += [(10 + k, "http://b.example/", f"<body><article><h1>Copy {k}</h1><div class=text>{prose(99, 30)}</div></article></body>") for k in range(5)]
    got = {r["page_id"]: r["text"] for r in html.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"Head {k}\n{prose(k, 20)}" for k in range(8)} | {10 + k: f"Copy {k}\n{prose(99, 30)}" for k in range(5)}


def test_quality_on_held_out_rows(spark, docs, none):
    sf = "/root/testdata/sf0.01"
    all_docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.score_quality(all_docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.93 * len(rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    odd = spark.createDataFrame([(0, 1, None), (3, None, 1), (None, 0, 0), (0, 0, 1), (2, 1, 1)], "doc_id long, quality int, score int")
    assert quality.score_quality(docs, odd).count() == docs.count()
    assert {r["score"] for r in quality.score_quality(docs, odd.where("false")).collect()} == {0.5}
    assert quality.score_quality(none, odd).count() == 0


def test_matrices_are_added_up_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(quality, "FAN", 3)
    rows = spark.createDataFrame([(k, (np.arange(4.0) * k).tolist()) for k in range(0, 60, 2)], "part int, x array<double>")
    sums = rows.mapInPandas(lambda frames: (pd.DataFrame({"part": f["part"], "sums": [np.array(x).tobytes() for x in f["x"]]}) for f in frames), "part int, sums binary")
    assert quality.summed(sums).tolist() == (np.arange(4.0) * sum(range(0, 60, 2))).tolist()


def test_quality_against_a_plain_ridge(spark):
    docs = [(k, prose(k, 30 + k % 7 * 20) + (" ### $$$ %% !!" * (k % 2 * 9))) for k in range(240)]
    labels = [(k, k % 2) for k in range(240)]
    got = {r["doc_id"]: r["score"] for r in quality.score_quality(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(labels, "doc_id long, quality int"), features=64, bins=16).collect()}
    part = {k: crc32(str(k).encode()) % 3 for k in range(240)}
    x = np.array([quality.statistics(t) for _, t in docs], np.float32).astype(float)
    fit, tune = ([k for k in range(240) if part[k] == p] for p in (0, 2))
    f = quality.Fourier(x[fit].mean(axis=0), x[fit].std(axis=0), 64, 4.0)
    z, y = f(x[fit]), np.array([k % 2 for k in fit], float)
    w = np.linalg.solve(z.T @ z + 1e-2 * len(fit) / 64 * np.eye(65), z.T @ y)
    at = quality.bin_of(f(x[tune]) @ w, 16)
    ones, n = np.bincount(at, [k % 2 for k in tune], 16), np.bincount(at, minlength=16)
    curve = quality.isotonic(ones, n)
    want = quality.calibrated(f(x) @ w, curve)
    assert all(got[k] == pytest.approx(want[k], abs=1e-6) for k in range(240))


def test_isotonic_is_monotone_and_pooled():
    curve = quality.isotonic(np.array([0, 3, 1, 0, 4, 5.0]), np.array([4, 4, 4, 0, 4, 5.0]))
    assert (np.diff(curve) >= 0).all() and curve[1] == curve[2] == 0.5 and curve[0] == 0


def test_every_operator_has_its_query():
    assert [int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES] == list(range(1, 11))
