"""The training-data operators on small tables, against brute force, with nulls, empty tables and repeated rows."""

from __future__ import annotations

import hashlib
import random
import re
import weakref
import zlib
from functools import cache

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from gridloom.llm import bpe, bwt, fingerprints, html_text, jaccard, language, neighbours, packing, quality, sharding, suffixes
from gridloom.llm.catalog import load
from gridloom.llm.common import word_hashes
from gridloom.llm.graph import components
from gridloom.llm.hilbert import hilbert_index

PATH = public_tokenizers.path("word_bpe_49k.json")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, part int"
FOLDER = "/root/testdata/sf0.001"


@cache
def texts() -> list[tuple]:
    rng = random.Random(5)
    words = ["".join(rng.choice("aeiouthnsr") for _ in range(rng.randrange(1, 9))) for _ in range(150)]
    made = [" ".join(rng.choice(words) for _ in range(rng.randrange(3, 160))) for _ in range(60)]
    long = " ".join(rng.choice(words) for _ in range(9000))
    near = [" ".join(w if rng.random() > 0.02 else "xx" for w in made[7].split()) for _ in range(12)]
    listed = [*made, long, long, *near, *near[:3], made[1] + " " + made[2], made[3][:150] * 4, None, "", " \n", "a b", "a b", "ÀÉ é", "9 9"]
    return [(i, t) for i, t in enumerate(listed)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", None if t is None else len(t), 0.5, 1) for i, t in texts()]
    return spark.createDataFrame(rows + [rows[4], rows[-3]], COLUMNS)  # two repeated rows


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def test_bpe_equals_library(spark, docs, empty):
    library = Tokenizer.from_file(PATH)
    code = bpe.codec(PATH)
    odd = ["", " ", "İstanbul ΣΑΣ", "a\x1cb", "x<|endoftext|>y <|startoftext|>", "don't I'LL we'Re", "²½ Ⅷ 12a", "한국어 中 😀", "q" * 400, "zx" * 200, "\x00\x85\xa0"]
    for text in odd + [t or "" for _, t in texts()]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert code.encode(text).tolist() == ids
        assert code.decode(code.encode(text)) == library.decode(ids, skip_special_tokens=False)
    rows = {r.doc_id: r for r in bpe.digests(docs, PATH).collect()}
    for i, text in texts():
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert bpe.digests(empty, PATH).count() == 0
    assert bpe.round_trip(docs, PATH).count() == docs.count()


def test_certain_cuts_are_never_inside_a_token():
    code = bpe.codec(PATH)
    for token in code.token[:20000:7]:
        body = token.removesuffix(code.suffix)
        assert all(a + b in code.joined for a, b in zip(body, body[1:]))


def test_quality(spark, empty):
    rng = random.Random(1)
    words = ["the", "of", "and", "reed", "hand", "sing", "then"]
    rows = [(i, " ".join(rng.choice(words) + ("###" if i % 3 == 0 else "") for _ in range(40)), i % 3 and 1) for i in range(300)]
    table = spark.createDataFrame([r[:2] for r in rows] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (5, None), (4, 1)], "doc_id long, quality int")
    scored = {r.doc_id: r for r in quality.score(table, quality.fit(table, labels)).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert np.mean([scored[r[0]].predicted == r[2] for r in held]) > 0.95
    assert scored[900].score == scored[901].score and 0 <= scored[900].score <= 1
    assert quality.score(empty, quality.fit(empty, labels)).count() == 0
    none = quality.score(table, quality.fit(table, labels.limit(0)))
    assert {r.score for r in none.collect()} == {0.5}


def test_fingerprints(spark, docs, empty):
    rows = fingerprints.with_neighbours(docs).collect()
    assert len(rows) == docs.count()
    source = sorted([(i, t or "") for i, t in texts()] + [(i, t or "") for i, t in (texts()[4], texts()[-3])], key=lambda r: (-r[0], r[1]))
    by_id = {r.doc_id: r for r in rows}
    for (i, text), (_, after) in zip(source, source[1:] + source[:1]):
        n = len(text) // 3
        new = text[: len(text) - n] + after[:n]
        if i not in (4, source[0][0], len(texts()) - 3):
            assert by_id[i].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
            assert by_id[i].near_next == np.mean([by_id[i].fingerprint[k : k + 8] == fingerprint_of(rows, after)[k : k + 8] for k in range(0, 128, 8)])
    equal: dict[str, str] = {}
    for r in rows:
        assert equal.setdefault(texts()[r.doc_id][1] or "", r.fingerprint) == r.fingerprint
    assert fingerprints.with_neighbours(empty).count() == 0
    one = fingerprints.with_neighbours(docs.where("doc_id = 3")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert fingerprints.fingerprints(docs).count() == docs.count()


def fingerprint_of(rows, text):
    return next(r.fingerprint for r in rows if (texts()[r.doc_id][1] or "") == text)


def shingle_set(text: str | None) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def roots_by_hand(rows: list[tuple]) -> dict[int, int]:
    root = {i: i for i, _ in rows}
    sets = {i: shingle_set(t) for i, t in rows}
    for i in sets:
        for j in sets:
            if j < i and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) > 0:
                low, high = sorted((root[i], root[j]))
                root = {k: low if v == high else v for k, v in root.items()}
    return root


@pytest.mark.parametrize("cell", [1000, 3])
def test_jaccard(spark, docs, empty, monkeypatch, cell):
    monkeypatch.setattr(jaccard, "CELL_ROWS", cell)
    monkeypatch.setattr(jaccard, "LEAD_ROWS", 4)
    monkeypatch.setattr(jaccard, "KEYS", 1)  # leave work to the product
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()}
    by_hand = roots_by_hand(texts())
    assert found == {i: (len(shingle_set(t)), by_hand[i]) for i, t in texts()}
    if cell == 3:
        monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()} == found
        assert jaccard.jaccard_components(empty).count() == 0


def test_product_alone_finds_all_links(spark, docs):
    """Without stars every linked pair of classes has to come out of the product."""
    marks = spark.createDataFrame([], "doc long, root long, skip boolean")
    frequent = jaccard.most_frequent(jaccard.summaries(docs.select("doc_id", "text")))
    pairs = {(r.a, r.b) for r in jaccard.product_pairs(docs.select("doc_id", "text").distinct(), marks, frequent).collect()}
    sets = {i: shingle_set(t) for i, t in texts()}
    for i in sets:
        for j in sets:
            if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) > 0:
                assert (i, j) in pairs


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 100), (50, 50), (7, 3), (7, 3)]
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long"), "t").collect()}
    assert found == {**{i: 0 for i in range(1, 41)}, 101: 100, 102: 100}


def test_language(spark, empty):
    rng = random.Random(2)
    kinds = {"aa": "bcdf", "bb": "klmn"}
    rows = [(i, "".join(rng.choice(kinds[k] + " ") for _ in range(60)), k) for i in range(120) for k in [("aa", "bb")[i % 2]]]
    rows += [(500, None, "aa"), (501, "12 !", "bb"), (502, "bcd bcd", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(table)
    found = {r.doc_id: r for r in language.identify(table, model).collect()}
    assert all(found[r[0]].lang_pred == r[2] for r in rows[:120])
    assert (found[500].lang_pred, found[500].score) == ("und", 0.0) and found[501].lang_pred == "und" and found[502].lang_pred == "aa"
    assert language.identify(empty, language.fit(empty)).count() == 0
    chances = np.exp2(-model["cost"].astype(float)).sum(axis=1)
    assert (chances < 1 + 1e-5).all()  # no context gives more than its share
    text = "".join(rng.choice("bcdfklmn é") for _ in range(700))
    whole = language.code_lengths(model, text)
    old, language.SPAN = language.SPAN, 64
    assert np.allclose(language.code_lengths(model, text), whole)
    language.SPAN = old


PAGES = {
    "": "", "<p>a": "a", "x < y & z": "x < y & z", "<p title='a>b'>hi &lt;b&gt; &amp</p>": "hi <b> &",
    '<article><h1>T</h1><p>A b, c.<br>d</p><div class="comments"><p>bad</p></div><aside>x</aside></article><footer>f</footer>': "T\nA b, c. d",
    '<body><div class="menu"><a href=x>m</a></div><div id=c><p>Some text, here. More text follows.<p>Two</div><script>var a="</p>"</script>': "Some text, here. More text follows.\nTwo",
    "<nav>n</nav>": "", "<article><p>cut off <b>he": "cut off he",
}


def test_html(spark):
    for page, text in PAGES.items():
        assert html_text.main_text(page) == text, page
    rows = [(i, "u", p, 1) for i, p in enumerate(PAGES)] + [(99, None, None, 2)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    found = {r.page_id: (r.text, r.n_chars) for r in html_text.extract(table).collect()}
    assert found == {i: (t, len(t)) for i, t in enumerate(PAGES.values())} | {99: ("", 0)}
    assert html_text.extract(table.limit(0)).count() == 0


def removed_by_hand(rows: list[tuple]) -> dict[int, tuple]:
    seen, out = set(), {}
    for i, text in sorted(rows):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for at in range(len(data) - 99):
            if data[at : at + 100] in seen:
                gone[at : at + 100] = True
            seen.add(data[at : at + 100])
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        out[i] = len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()
    return out


@pytest.mark.parametrize("bits", [22, 12])
def test_suffixes(spark, docs, empty, monkeypatch, bits):
    monkeypatch.setattr(suffixes, "PLACE_BITS", bits)
    monkeypatch.setattr(bwt, "SHARD_BYTES", 700)
    if bits == 12:
        monkeypatch.setattr(suffixes, "MERGE_BYTES", 2000)
        monkeypatch.setattr(suffixes, "BROADCAST_ROWS", 0)
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.digests(docs).collect()}
    assert found == removed_by_hand(texts())
    assert suffixes.digests(empty).count() == 0


def test_merge_of_transforms(monkeypatch):
    rng = random.Random(8)
    strings = list({"".join(rng.choice("ab") for _ in range(rng.randrange(8, 20))).encode() for _ in range(60)})
    monkeypatch.setattr(bwt, "SHARD_BYTES", 150)
    group, string, offset = bwt.repeated(strings, 6)
    found: dict[int, set] = {}
    for g, s, o in zip(group.tolist(), string.tolist(), offset.tolist()):
        found.setdefault(g, set()).add((s, o))
    by_hand: dict[bytes, set] = {}
    for i, s in enumerate(strings):
        for o in range(len(s) - 5):
            by_hand.setdefault(s[o : o + 6], set()).add((i, o))
    assert sorted(map(sorted, found.values())) == sorted(sorted(v) for v in by_hand.values() if len(v) > 1)


def test_hilbert_neighbours_touch():
    for n, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n, indexing="ij"), -1).reshape(-1, n)
        index = hilbert_index(grid, bits)
        assert sorted(index.tolist()) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(index)], axis=0)).sum(axis=1) == 1).all()


def test_sharding(spark, docs, empty):
    rows = sharding.shards(docs).collect()
    assert len(rows) == docs.count()
    by_shard: dict[int, list[int]] = {}
    for r in rows:
        by_shard.setdefault(r.shard, []).append(r.slot)
        data = (texts()[r.doc_id][1] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "rows", None)
    assert sorted(by_shard) == list(range(8)) and all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert max(map(len, by_shard.values())) - min(map(len, by_shard.values())) <= 1
    assert sharding.shards(empty).count() == 0
    assert {(r.shard, r.slot) for r in sharding.shards(docs.where("doc_id < 3")).collect()} == {(0, 0), (2, 0), (5, 0)}


def test_fill_counts():
    rng = random.Random(4)
    for _ in range(200):
        counts = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(rng.randrange(0, 6))}
        chosen = packing.fill_counts(dict(counts), 40)
        sums = {0}
        for length, n in counts.items():
            sums = {s + k * length for s in sums for k in range(n + 1)}
        assert sum(k * v for k, v in chosen.items()) == max(s for s in sums if s <= 40)
        assert all(v <= counts[k] for k, v in chosen.items())


def test_packing(spark, docs, empty):
    library = Tokenizer.from_file(PATH)
    rows = packing.pack(docs.repartition(3), PATH).collect()
    pieces: dict[int, list] = {}
    fills: dict[int, list] = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        fills.setdefault(r.sequence_id, []).append(r)
    for i, text in texts():
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        seen = sorted({(r.start, r.length, r.ids_crc32) for r in pieces[i]}) if i not in (4, len(texts()) - 3) else None
        if seen is not None:
            assert sum(n for _, n, _ in seen) == len(ids) == pieces[i][0].doc_tokens
            assert all(c == zlib.crc32(ids[s : s + n].tobytes()) for s, n, c in seen)
    for sequence in fills.values():
        at = 0
        for r in sorted(sequence, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert sum(sum(r.length for r in s) < 2048 for s in fills.values()) <= 3
    assert packing.pack(empty, PATH).count() == 0


def test_neighbours(spark):
    rng = np.random.RandomState(3)
    rows = [(i, rng.randn(6).round(1).tolist(), 1) for i in range(400)]
    rows += [(1000, rows[0][1], 1), (1001, rows[0][1], 1), (1002, None, 1), (1003, [0.0] * 6, 1), (1004, [float("nan")] * 6, 1), (1100, [1.0, None] * 3, 1), (1006, [1.0], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    data = {i: np.array(v, np.float32).astype(float) for i, v, _ in rows[:402]}
    found: dict[int, list] = {}
    for r in neighbours.nearest(table).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 12)))
    assert sorted(found) == [0, 100, 200, 300, 1000]
    for q in found:
        near = sorted((round(float(np.sqrt(((data[q] - v) ** 2).sum())), 12), i) for i, v in data.items() if i != q)[:10]
        assert found[q] == [(i, d) for d, i in near]
    assert neighbours.nearest(table.limit(0)).count() == 0
    assert neighbours.nearest(table.where("vec_id IN (0, 1, 2)")).count() == 2


def nearest_by_hand(rows: list[tuple], every: int = 100, k: int = 10) -> dict[int, list]:
    data = [(i, np.array(v, float)) for i, v in rows]
    found = {}
    for q in {i for i, _ in data if i % every == 0}:
        own = min((v for i, v in data if i == q), key=list)
        near: dict[int, float] = {}
        for i, v in data:
            d = round(float(np.sqrt(((v - own) ** 2).sum())), 12)
            near[i] = min(d, near.get(i, d)) if i != q else 0
        found[q] = sorted((d, i) for i, d in near.items() if i != q)[:k]
    return found


def nearest_found(table, *args) -> dict[int, list]:
    found: dict[int, list] = {}
    for r in neighbours.nearest(table, *args).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((round(r.score, 12), r.vec_id))
        assert r.rank == len(found[r.query_id])
    return found


@pytest.mark.parametrize("single", [True, False])
def test_neighbours_in_many_dimensions(spark, monkeypatch, single):
    """Lengths from tiny to huge, many equal vectors, far from the origin; all blocks are small."""
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    rng = np.random.RandomState(11)
    v = rng.randn(600, 64)
    v[:200] = v[:200] * 1e-3 + 1000
    v[200:260] = v[200]
    v[300:310] *= 1e18
    v[310:320] *= 1e-18
    v = v.astype(np.float32) if single else v
    rows = [(i, x.tolist()) for i, x in zip(rng.permutation(600).tolist(), v)]
    table = spark.createDataFrame(rows, f"vec_id long, embedding array<{'float' if single else 'double'}>")
    assert nearest_found(table, 20) == nearest_by_hand(rows, 20)


def test_neighbours_with_ids_that_repeat(spark):
    """Windows hold a few ids only, so bounds are loose: the k-th row of a block is not the k-th id."""
    rng = np.random.RandomState(12)
    rows = [(i % 30 * 10, rng.randn(8).tolist()) for i in range(30 * 60)]
    rows += [(300 + i, (np.array(rows[0][1]) + 3 + i / 50).tolist()) for i in range(20)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert nearest_found(table) == nearest_by_hand(rows)


def test_neighbours_move_a_vector_a_few_times(spark, monkeypatch):
    """What is shuffled and stored follows the vectors and not their product with the queries."""
    monkeypatch.setattr(neighbours, "BLOCK", 8)
    rng = np.random.RandomState(13)
    rows = [(i, rng.randn(32).tolist()) for i in range(3000)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(8).cache()
    assert table.count() == 3000
    bus, store = (getattr(spark.sparkContext._jsc.sc(), name)() for name in ("listenerBus", "statusStore"))
    written, threshold = [], spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for a large table
    try:
        for _ in range(2):
            bus.waitUntilEmpty(30_000)
            written.append(store.executorSummary("driver").totalShuffleWrite())
            if len(written) == 1:
                assert neighbours.nearest(table, 10).count() == 3000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        table.unpersist()
    assert written[1] - written[0] < 20 * 3000 * 32 * 4


def test_pipeline_stages_by_hand(spark):
    rows = [r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    listed = [(r.doc_id, r.text) for r in rows]
    first = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, FOLDER).collect()}
    assert first == {i for i, root in roots_by_hand(listed).items() if i == root}
    kept = {r.doc_id: r for r in corpus_pipeline.remove_repeats(spark, docs, FOLDER).collect()}
    for i, (size, gone, _, _) in removed_by_hand(listed).items():
        assert (i in kept) == (gone == 0 or gone < size)
        assert i not in kept or gone or kept[i].text == dict(listed)[i]
    for _, stage in corpus_pipeline.STAGES[:2]:
        made = stage(spark, docs, FOLDER)
        assert made.columns == corpus_pipeline.COLUMNS and 0.7 * len(rows) < made.count() <= len(rows)
    made = corpus_pipeline.run(spark, FOLDER)
    assert made.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and made.count()


def test_every_operator_has_a_query():
    names = list(load()[0])
    assert [n.split("_")[0] for n in names] == [*(f"op{i}" for i in range(1, 14)), "pipeline"]


def test_words_that_any_polynomial_hash_confuses(spark):
    """The Thue-Morse word and its complement: equal under every polynomial modulo 2 ** 64 with an odd base."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = word.translate(str.maketrans("ab", "ba"))
    one, two = (h.tolist() for h in word_hashes([word, other]))
    assert one != two
    df = spark.createDataFrame([(1, word, "en", "s", 1024, 0.5, 1), (2, other, "en", "s", 1024, 0.5, 1)], COLUMNS)
    assert sorted((r.doc_id, r.component_id) for r in jaccard.jaccard_components(df).collect()) == [(1, 1), (2, 2)]


def test_memories_are_bounded_and_change_nothing():
    library = Tokenizer.from_file(PATH)
    code = bpe.Codec(PATH)
    listed = [t or "" for _, t in texts()] + ["x<|endoftext|>y", "", "한국어 é, \x1c"]
    code.memo.room = code.known_words.room = 300
    for _ in range(2):
        for text, ids in zip(listed, code.encode_many(listed)):
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(code.memo) <= 2 + len(code.added) and len(code.known_words) <= 2


def test_frequent_hashes_take_little_memory():
    import tracemalloc

    rng = np.random.RandomState(3)
    for n in (0, 1, 2, 3, 5000):
        rows = [rng.randint(0, 2000, size).astype(np.uint64) << np.uint64(50) for size in (n, n // 2, 0)]
        grams, seen = np.unique(np.concatenate(rows), return_counts=True)
        got = jaccard.often([r.copy() for r in rows], 3)
        assert got[0].tolist() == grams[seen >= 3].tolist() and got[1].tolist() == seen[seen >= 3].tolist()
    held = [rng.randint(0, 1 << 62, 100_000).astype(np.uint64) for _ in range(20)]
    tracemalloc.start()
    jaccard.often(held, 3)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert not held and most < 1.5 * 8 * 2_000_000  # beside the given rows; a sorted copy with indices takes four times that


def test_encoder_with_full_memories():
    """Chunks and words beyond what is remembered, met in one group or again later, give the library's ids."""
    code = bpe.Codec(PATH, 0)
    assert not code.memo.room and bpe.Codec(PATH, 4).memo.room == 4 * bpe.CHUNK_BYTES
    texts = ["Wertzkeit andreinedor, ndthndheon!", "andreinedor x1y2 ertzkeit\u00df ndthndheon", None, "", "ndthndheon " * 40] * 3
    for ids, text in zip(code.encode_many(texts), texts, strict=True):
        assert ids.tolist() == code.library.encode(text or "", add_special_tokens=False).ids
    assert not len(code.memo)


def test_a_forgotten_vocabulary_is_freed():
    """Also where the garbage collector has set it aside: packing loads one for each task of a worker."""
    code = bpe.codec(PATH, 1)
    assert [i.tolist() for i in code.encode_many(["ab cd, ab"])] == [code.library.encode("ab cd, ab", add_special_tokens=False).ids]
    left = weakref.ref(code)
    del code
    bpe.forget()
    assert left() is None


def test_a_task_of_the_pipeline_needs_one_worker(spark):
    """One call of Python between two shuffles: a second call takes a second worker, and each keeps memory."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        plan = stage(spark, docs, FOLDER)._jdf.queryExecution().executedPlan().toString()
        for part in plan.split("Exchange"):
            assert len(re.findall(r"(?:ArrowEvalPython|MapInPandas)\b", part)) <= 1, plan


def test_kept_bytes_as_text(spark):
    """A passage whose cut goes through a letter, a null and an empty text; filters on the numbers change nothing."""
    once = "".join(chr(0x430 + i * 7 % 32) + chr(97 + i * 5 % 26) for i in range(90))
    rows = [(1, once), (2, "\u0444" + once[:88] + "\u0454" + "tail"), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id: r for r in suffixes.without_repeats(docs).where("n_removed = 0 OR n_removed < n_bytes").collect()}
    texts = {r.doc_id: r for r in suffixes.without_repeats(docs, decoded=True).where("n_removed = 0 OR n_removed < n_bytes").collect()}
    assert kept.keys() == texts.keys() == {1, 2, 3, 4} and kept[2].n_removed > 0
    for i, row in kept.items():
        assert texts[i].kept == bytes(row.kept).decode("utf-8", "ignore")
        assert (texts[i].n_bytes, texts[i].n_removed, texts[i].n_spans) == (row.n_bytes, row.n_removed, row.n_spans)


def test_tasks_hand_memory_back(monkeypatch):
    from gridloom.llm import common

    calls = []
    monkeypatch.setattr(common, "release", lambda collect=True: calls.append(collect))
    made = common.freed(lambda batches: (2 * b for b in batches))(iter([1, 2]))
    assert [next(made), next(made)] == [2, 4] and not calls
    assert list(made) == [] and calls == [False]


def test_words_around_come_in_parts(monkeypatch):
    batch = pd.DataFrame({"text": ["a b c d e f g", None, "a a B, C?"]})
    whole = pd.concat(list(quality._contexts(iter([batch]))))
    monkeypatch.setattr(quality, "PART_ROWS", 3)
    parts = list(quality._contexts(iter([batch])))
    assert len(parts) > 2 and max(map(len, parts)) == 3
    parts = pd.concat(parts)
    assert [(t, n, a.tolist()) for t, n, a in parts.values] == [(t, n, a.tolist()) for t, n, a in whole.values]
