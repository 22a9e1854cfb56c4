"""Phrases, the conversation trie and the quality rules against brute force, with nulls, empty tables, ties,
repeated rows, very long texts and clashing column names."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from gridloom.llm import collocations, rules, trie
from gridloom.llm.catalog import OP11_SQL, OP12_SQL, load

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x20\x09-\x0d]+")


# phrases

def brute_phrases(rows, least, top):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for m in range(1, 6):
                for i in range(len(w) - m + 1):
                    f[lang][tuple(w[i : i + m])] += 1
    out = []
    for lang, count in f.items():
        held = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        gone = {p[i:j] for p, a in held.items() for i in range(len(p)) for j in range(i + 1, len(p) + 1) if j - i < len(p) and a >= count[p[i:j]]}
        found = []
        for p, a in held.items():
            if p not in gone:
                score, k = min((1000 * a * n[lang] // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        for k, (s, a, p, left, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, k, p.decode(), -a, left, r, n[lang], -s))
    return sorted(out)


def some_texts(seed):
    rng = random.Random(seed)
    words = ["a", "b", "C", "d\x00", "d", "e\x01f", "\x01", "\x00", "ü", "zz", "the", "of", "\x1c", "x\xa0y"]
    ends = ["", "", "", ".", ",", "\n", "\t", "\r", "!?", "  "]
    rows = []
    for _ in range(80):
        text = " ".join(rng.choice(words[:3] if rng.random() < 0.5 else words) + rng.choice(ends) for _ in range(rng.randrange(60)))
        rows.append((rng.choice(["en", "de", None, "und"]), text))
    return rows + [("en", "one two three four five six seven.")] * 30 + [(None, None), ("xx", ""), ("yy", " .,"), ("zz", "one")]


@pytest.mark.parametrize("seed", [0, 1])
@pytest.mark.parametrize("parts", ["3", "37"])
def test_phrases_equal_brute_force(spark, seed, parts):
    rows = some_texts(seed)
    df = spark.createDataFrame([(lang, text, 1, "k", 0) for lang, text in rows], "lang string, text string, n int, key string, rank int").repartition(4)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        for least, top in ((3, 2000), (20, 15)):
            found = sorted(tuple(r) for r in collocations.collocations(df, least, top).collect())
            assert found == brute_phrases(rows, least, top)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_phrases_of_one_long_text_and_small_blocks(spark, monkeypatch):
    """Blocks end inside the corpus but never inside a text; the counts do not show it."""
    monkeypatch.setattr(collocations, "FLUSH_WORDS", 50)
    monkeypatch.setattr(collocations, "CHUNK_WORDS", 20)
    rng = random.Random(3)
    rows = [("en", " ".join(rng.choice("abcde") for _ in range(20_000)))] + some_texts(4)[:60]
    found = collections.Counter()
    batch = __import__("pyarrow").record_batch([[r[0] or "und" for r in rows], [r[1] for r in rows]], ["lang", "text"])
    for lang, ids, words in collocations._encoded([batch]):
        for i in ids.tolist():
            if i:
                found[lang, words[i]] += 1
    expected = collections.Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            for w in re.findall("[^ \t]+", piece):
                expected[lang or "und", w.encode().replace(b"\x01", b"\x01\x02").replace(b"\x00", b"\x01\x01")] += 1
    assert found == expected
    df = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(map(tuple, collocations.collocations(df, 5, 2000).collect())) == brute_phrases(rows, 5, 2000)


def test_phrases_of_a_full_bit_set(spark, monkeypatch):
    """If every word and pair meets a set bit, more windows are made and nothing else changes."""
    import numpy as np

    rows = some_texts(5)
    full = np.full(collocations.BITS // 8, 255, np.uint8)
    monkeypatch.setattr(collocations, "_bit_set", lambda hashes: full)
    df = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(map(tuple, collocations.collocations(df, 4, 50).collect())) == brute_phrases(rows, 4, 50)


def test_scores_pass_64_bits(spark):
    """Counts as large as a corpus has: exact whole-number division."""
    big = 9 * 10**16
    phrases = spark.createDataFrame([("en", b"a", big), ("en", b"b", big - 3), ("en", b"a\x00b", 10**12 + 7)], "lang string, key binary, n long")
    totals = spark.createDataFrame([("en", 10**17)], "lang string, n long")
    row = collocations.scored(phrases, totals).collect()
    assert [tuple(r) for r in row] == [("en", "a b", 10**12 + 7, big, big - 3, 10**17, 1000 * (10**12 + 7) * 10**17 // (big * (big - 3)))]


def test_no_phrases(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(empty).count() == 0


# conversations

def brute_trie(rows):
    conv = {}
    for c, t, role, text in rows:
        if c is not None:
            conv.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    conv = {c: [(x[2], x[3]) for x in sorted(turns)] for c, turns in conv.items()}
    built = {c: conv.get(c - c % 20, [])[: zlib.crc32(str(c).encode()) % 4] + own[zlib.crc32(str(c).encode()) % 4 :] for c, own in conv.items()}
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = collections.defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved, out = {}, {}, []
    for path in sorted(members, key=len, reverse=True):
        below = children[path]
        leaves[path] = sum(leaves[k] for k in below) or 1
        words = len(WORD.findall(path[-1][1])) if path else 0
        saved[path] = (len(members[path]) - 1) * words + sum(saved[k] for k in below)
        ends = ",".join(str(c) for c in sorted(members[path]) if len(built[c]) == len(path))
        up = min(members[path[:-1]]) if path else None
        out.append((min(members[path]), len(path), up, len(members[path]), len(below), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(seed):
    rng = random.Random(seed)
    rows = []
    for c in range(90):
        if rng.random() < 0.9:
            rows += [(c, rng.choice([t, t, t, None]) if seed else t, rng.choice(["u", "a", None]), rng.choice(["x y", "x", "z z z", "", None])) for t in range(rng.randrange(1, 7))]
    rows += rows[:5] + [(None, 0, "u", "lost")]
    rows += [(1000 + i, t, "u", f"same {t}") for i in range(40) for t in range(25)]  # copies
    rows += [(2000 + i, t, "u", f"same {t}" if t < 8 + i else f"q{i}") for i in range(15) for t in range(25)]  # a long shared path with branches
    return rows + [(5000, t, "u", "w " * 3000) for t in range(3)]


@pytest.mark.parametrize("seed", [0, 1])
def test_trie_equals_brute_force(spark, seed):
    rows = conversations(seed)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, seq string").repartition(5)
    expected = brute_trie(rows)
    distinct = trie.distinct_sequences(trie.rebuilt(trie.sequences(df)))
    for most in (trie.BURST, 60, 7):
        found = sorted((tuple(r) for r in trie.nodes(distinct, most).collect()), key=str)
        assert found == expected
    assert trie.burst(distinct, 7)[1].count() > 3  # containers did burst


def test_trie_joins_ids_of_copies_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOB", 8)
    rows = [(c, 0, "u", "a") for c in range(0, 2000, 20)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted((tuple(r) for r in trie.prefix_trie(df).collect()), key=str) == brute_trie(rows)


def test_trie_without_turns(spark):
    kind = "conv_id long, turn long, role string, text string"
    assert trie.prefix_trie(spark.createDataFrame([], kind)).count() == 0
    assert trie.prefix_trie(spark.createDataFrame([(None, 1, "a", "b")], kind)).count() == 0
    # 21 has h = 1 or more and one own turn; its family's first conversation is absent, so nothing is left of it
    alone = next(c for c in range(21, 400) if zlib.crc32(str(c).encode()) % 4)
    rows = [tuple(r) for r in trie.prefix_trie(spark.createDataFrame([(alone, 1, "a", "b")], kind)).collect()]
    assert rows == [(alone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(alone).encode()).hexdigest())]


# quality rules

def brute_statistics(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = collections.Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    covered = {p for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for p in range(k, k + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def texts_of_rules():
    rng = random.Random(2)
    out = [None, "", " \t\n\x0b\x0c\r", "a", "a b c d e", "a b c d e " * 2, "a " * 40, "x\ny\nx\n \n\ny\nx", "😀 é b #|$ \x00\x1c"]
    out += [" ".join(rng.choice("abc") for _ in range(rng.randrange(60))) for _ in range(60)]
    out.append("the end of it all " * 20_000)
    return out + [" ".join(rng.choice(["one", "two\n", "#5", "A|B"]) for _ in range(300))]


def test_statistics_equal_brute_force(spark):
    rows = list(enumerate(texts_of_rules())) + [(3, "a")]
    df = spark.createDataFrame([(i, t, 7, "w") for i, t in rows], "doc_id long, text string, n_words int, kept string")
    judged = rules.judge(df, [])
    assert judged.columns.count("n_words") == 1 and judged.columns.count("kept") == 1
    found = judged.select("doc_id", *rules.BASE, "base_failed", "kept").collect()
    assert len(found) == len(rows)
    expected = dict(rows)
    for r in found:
        stats = brute_statistics(expected[r["doc_id"]])
        assert tuple(r[c] for c in rules.BASE) == stats
        failed = stats[0] < 10 or 100 * stats[4] > 20 * stats[0]
        assert r["base_failed"] == failed and r["kept"] == (not failed)


def test_statistics_survive_a_filter_above(spark):
    """The optimizer moves filters down to the texts; a long text must not be split anew for each of its words."""
    df = spark.createDataFrame([(1, "the end of it all and more " * 30_000)], "doc_id long, text string")
    assert rules.judge(df, []).where("NOT kept AND n_repeat_words > 5").count() == 1


def test_rules_are_learned_and_emitted_in_order(spark):
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(900):
        n = rng.randrange(20, 60)
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(n)]
        bad = i % 4 == 0
        if bad and i % 8 == 0:
            words = [w + "#" if rng.random() < 0.4 else w for w in words]
        elif bad:
            words = [w.upper() for w in words]
        docs.append((i, " ".join(words)))
        labels.append((i, int(not bad), 0))
    docs_df = spark.createDataFrame(docs, "doc_id long, text string")
    labels_df = spark.createDataFrame([*labels, (None, 0, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    learned = rules.learn(docs_df, labels_df)
    assert learned == rules.learn(docs_df.repartition(3), labels_df.repartition(2))
    text = " ; ".join(rules.describe(learned))
    assert len(learned) == 2 and "symbol_share >" in text and "capital_share >" in text
    judged = {r["doc_id"]: r["kept"] for r in rules.judge(docs_df, learned).collect()}
    held_out = [i for i, _ in docs if zlib.crc32(str(i).encode()) % rules.FOLDS == rules.HELD_OUT]
    assert len(held_out) > 100 and sum(judged[i] == (i % 4 != 0) for i in held_out) / len(held_out) > 0.99
    for i, t in docs[:40]:  # the expression against the rules, one by one
        stats = rules.with_statistics(spark.createDataFrame([(i, t)], "doc_id long, text string")).first() if i < 6 else None
        if stats:
            verdict = not any(all((stats[x.name] > x.threshold) == x.above for x in rule) for rule in learned)
            assert judged[i] == verdict


def test_rules_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    one_kind = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert rules.learn(docs, none) == [] and rules.learn(docs, one_kind) == []
    assert rules.judge(docs, []).first()["kept"]
    assert rules.judge(docs.limit(0), []).count() == 0


def test_rules_are_native(spark):
    judged = rules.judge(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), [(rules.Literal("n_words", True, 1.0),)])
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and "Exchange" not in plan


@pytest.mark.parametrize(("name", "sql"), [("op11_phrases", OP11_SQL), ("op12_trie", OP12_SQL)])
def test_queries_equal_their_sql(spark, name, sql):
    from check import connect, differences

    folder = "/root/testdata/sf0.001"
    assert differences(load()[0][name](spark, folder), connect(folder), sql) is None
