"""Documents: exact and near duplicates, languages, line rules, mixing, tokens and shards, against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F

from driftline.llm import bpe, exact, language, lines, mixing, pieces, shards, simhash
from driftline.llm.batches import WordCache, blocks
from driftline.llm.components import components

WORD_BPE, BYTE_BPE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.tiktoken")


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def classes(ids, linked):
    """Least member of each one's class, by trying all pairs."""
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


# exact duplicates


def test_exact_against_brute_force(docs, texts):
    groups = {}
    for i, t in texts.items():
        groups.setdefault(ascii_lower(t), []).append(i)
    for r in exact.exact_duplicates(docs).collect():
        norm = ascii_lower(texts[r.doc_id])
        ids = groups[norm]
        assert (r.keep_id, r.group_size, r.kept) == (max(ids), len(ids), r.doc_id == max(ids))
        assert r.text_sha256 == hashlib.sha256(norm.encode()).hexdigest()


def test_exact_chunks_hold_the_whole_text(spark, texts):
    df = spark.createDataFrame(list(texts.items())[:50] + [(-1, "no end " * 9000)], "doc_id long, text string")
    table = exact.chunk_table(df, "doc_id", "text", F.xxhash64, exact.chunk_pattern()).collect()
    for r in df.collect():
        got = "".join(c.chunk for c in sorted((c for c in table if c.doc_id == r.doc_id), key=lambda c: c.pos))
        assert got == ascii_lower(r.text)


def test_exact_when_chunk_hashes_collide(spark):
    # All chunks of one length share their hash: only their bytes tell them apart.
    rows = [(i, t) for i, t in enumerate(["abcd", "abce", "ABCD", "ab", "abceabcd", "abcdabce", "abcdabce"])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact.exact_duplicates(df, hashed=lambda c: F.length(c).cast("long"), pattern="(?s).{1,4}").collect()}
    assert got == {0: (2, 2), 1: (1, 1), 2: (2, 2), 3: (3, 1), 4: (4, 1), 5: (6, 2), 6: (6, 2)}


def test_exact_odd(odd_docs, no_docs):
    rows = exact.exact_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    first = [r for r in rows if r.keep_id == 2]
    assert [r.group_size for r in first] == [3, 3, 3] and sum(r.kept for r in first) == 1
    empty = [r for r in rows if r.text_sha256 == hashlib.sha256(b"").hexdigest()]
    assert len(empty) == 3 and {r.keep_id for r in empty} == {4}
    assert exact.exact_duplicates(no_docs).collect() == []
    kept = exact.drop_exact_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([2, 4, 5, 6, 7, 8, None])
    repeated = odd_docs.where("doc_id = 1")
    assert exact.drop_exact_duplicates(repeated).count() == 1


# near duplicates


def plain_fingerprint(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text))
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64(s.encode(), seed=42).intdigest()
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


@pytest.mark.parametrize("text", [None, "", "  ", "a", "a b c", "a b c d", "É a b C\x0bd e", "a b c d " * 500, "w" * 3_000_000 + " x y z"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_fingerprint_over_blocks():
    rnd = random.Random(1)
    text = " ".join(str(rnd.randrange(10**6)) for _ in range(400_000))
    hashes = np.array([xxhash.xxh64_intdigest(" ".join(w), 42) for w in zip(*[text.split()[i:] for i in range(4)])], dtype=np.uint64)
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=int)
    assert simhash.fingerprint(text) == int("".join("1" if 2 * b > len(hashes) else "0" for b in bits), 2)


def test_near_against_brute_force(docs, texts):
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    want = classes(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    got = simhash.near_duplicates(docs).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{prints[i]:016x}", want[i]) for i in texts}
    assert sorted(r.doc_id for r in got if r.kept) == sorted(set(want.values()))


@pytest.mark.parametrize("rows,most", [(1000, 4096), (1000, 15), (1 << 24, 4096)])
def test_links_of_clusters(spark, rows, most):
    rnd = random.Random(rows + most)
    values = set()
    for _ in range(15):
        centre = rnd.getrandbits(64)
        for _ in range(40):
            x = centre
            for _ in range(rnd.randrange(7)):
                x ^= 1 << rnd.randrange(64)
            values.add(x)
    want = classes(sorted(values), lambda a, b: (a ^ b).bit_count() <= 4)
    df = spark.createDataFrame([(simhash.signed(v),) for v in values], "fp bigint")
    roots = {r.node: r.root for r in components(simhash.fingerprint_links(df, rows, 4, most)).collect()}
    named = {}
    for v in values:
        named.setdefault(want[v], set()).add(roots.get(simhash.signed(v), simhash.signed(v)))
    assert all(len(x) == 1 for x in named.values()) and len(set.union(*named.values())) == len(named)


@pytest.mark.parametrize("size,free,most", [(3000, 32, 500), (1200, 11, 64)])
def test_links_of_spread_fingerprints(spark, size, free, most):
    """Fingerprints alike in most bits but of many classes, and more than cuts can part."""
    rnd = random.Random(size)
    top = rnd.getrandbits(64 - free) << free
    values = sorted({top | rnd.getrandbits(free) for _ in range(size)})
    near = np.array(values, np.uint64)
    linked = {(values[i], values[i + 1 + j]) for i in range(len(values)) for j in np.nonzero(np.bitwise_count(near[i + 1 :] ^ near[i]) <= 4)[0]}
    df = spark.createDataFrame([(simhash.signed(v),) for v in values], "fp bigint")
    got = simhash.fingerprint_links(df, len(values), 4, most).distinct().collect()
    mask = (1 << 64) - 1

    def named(pairs):
        parent = {v: v for v in values}

        def find(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a, b in pairs:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
        return {v: find(v) for v in values}

    assert named((r.a & mask, r.b & mask) for r in got) == named(linked)


def test_large_shards_are_cut_to_size(spark):
    rnd = random.Random(4)
    rows = [(simhash.signed(v), 7) for v in {rnd.getrandbits(32) << 16 for _ in range(4000)}] + [(simhash.signed(v), 8) for v in range(1000)]
    shards = spark.createDataFrame(rows, "fp bigint, shard bigint")
    cut = [r["count"] for r in simhash.cut_shards(shards.where("shard = 7"), 4, 500).groupBy("shard").count().collect()]
    assert sum(cut) == 5 * 4000 and max(cut) <= 500
    pairs = simhash.pair_shards(shards, 4, 500)
    sizes = [r["count"] for r in pairs.groupBy("shard").count().collect()]
    assert max(sizes) <= 750 and len(sizes) == 16 * 15 // 2 + 4 * 3 // 2
    held = {}
    for r in pairs.collect():
        held.setdefault(r.fp, set()).add(r.shard)
    for part in ([fp for fp, s in rows if s == 7][:300], [fp for fp, s in rows if s == 8][:300]):
        assert all(held[a] & held[b] for a in part for b in part)


def test_bk_tree_skips_without_loss():
    rnd = random.Random(5)
    dense = list({rnd.getrandbits(11) for _ in range(900)})
    tree = simhash.BKTree(2)
    for x in dense:
        tree.add(x)
    want = classes(dense[:], lambda a, b: (a ^ b).bit_count() <= 2)
    got = {x: tree.find(i) for i, x in enumerate(tree.values)}
    assert all((got[a] == got[b]) == (want[a] == want[b]) for a in dense[:200] for b in dense)


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(300)], [(0, i) for i in range(1, 200)], [(1, 1)], [], [(5, 3), (3, 5), (-7, 3), (9, 10)]])
def test_components(spark, edges):
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    nodes = sorted({x for e in edges for x in e if e[0] != e[1]})
    pairs = {frozenset(e) for e in edges}
    want = classes(nodes, lambda a, b: frozenset((a, b)) in pairs)
    assert set(got) == set(nodes)
    assert all((got[a] == got[b]) == (want[a] == want[b]) for a in nodes for b in nodes[:20])


def test_near_odd(odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    zero = [r for r in rows if r.fingerprint == "0" * 16]
    assert len(zero) == 4 and {r.component_id for r in zero} == {3}
    assert simhash.near_duplicates(no_docs).collect() == []
    kept = simhash.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 3, 6, 7, 8, None])
    assert simhash.drop_near_duplicates(no_docs).count() == 0


# languages


def test_language_of_held_out_rows(docs, spark):
    rows = {r.doc_id: r for r in language.identify_languages(docs).collect()}
    known = {r.doc_id: r.lang for r in docs.collect()}
    import zlib

    assert set(rows) == set(known)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    held = [i for i, r in rows.items() if r.held_out]
    assert sum(rows[i].lang_pred == known[i] for i in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows.values())


def number(*points):
    """The place of an n-gram, from its code points."""
    factors = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
    return sum(c * f for c, f in zip(points, factors, strict=False)) % (1 << 32) >> 14


def test_grams_are_all_of_a_text():
    texts = ["Ab, cd!  E", "", "...", "ß Éa" * 30, "x" * 5, "日本語 です", "Привет мир"]
    table = language.letters()
    flags = np.zeros(language.SIZE, bool)
    for text in texts:
        s = [0]
        for c in text:
            symbol = int(table[ord(c)])
            if symbol or s[-1]:
                s.append(symbol)
        want = {number(a) for a in s} | {number(a, b) for a, b in zip(s, s[1:])} | {number(a, b, c) for a, b, c in zip(s, s[1:], s[2:])}
        assert set(language.grams(text, table, flags).tolist()) == want - {0}
        assert not flags.any()
    long = "abc d é " * 300_000
    assert language.grams(long, table, flags).tolist() == language.grams("abc d é " * 5, table, flags).tolist()


def prose(alphabet, seed, n):
    """Invented texts of words whose letters follow one another by a language's own habits."""
    rng = random.Random(seed)
    habits = {c: rng.sample(alphabet, 6) for c in alphabet}

    def word():
        out = rng.choice(alphabet)
        for _ in range(rng.randrange(1, 7)):
            out += rng.choice(habits[out[-1]])
        return out

    return [" ".join(word() for _ in range(rng.randrange(20, 60))) for _ in range(n)]


def test_scripts_with_thousands_of_letters(spark):
    """Two languages that share most of a large script, beside others: each letter counts for itself."""
    han = [chr(0x4E00 + i) for i in range(1200)]
    kana = [chr(0x3042 + i) for i in range(70)]
    cyrillic, greek, latin = [[chr(a + i) for i in range(n)] for a, n in ((0x430, 32), (0x3B1, 25), (0x61, 26))]
    alphabets = {"zh": han, "ja": han[:600] + kana * 5, "ru": cyrillic, "el": greek, "en": latin}
    texts = [(lang, t) for seed, (lang, letters) in enumerate(alphabets.items()) for t in prose(letters, seed, 200)]
    random.Random(0).shuffle(texts)
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(texts)], "doc_id bigint, text string, lang string")
    rows = [r for r in language.identify_languages(docs).collect() if r.held_out]
    for lang in alphabets:
        mine = [r for r in rows if texts[r.doc_id][0] == lang]
        assert sum(r.lang_pred == lang for r in mine) >= 0.95 * len(mine) > 20, lang


def test_every_language_is_learned(spark):
    """More languages than any list of common ones, one of them with long texts only."""
    words = [f"{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200)]
    rows = [(f"l{i:03}", " ".join([w * 2, w * 3] * 10)) for i, w in enumerate(words) for _ in range(6)] + [("long", "qqzz xxqq " * 5000)] * 8
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id bigint, text string, lang string")
    model = language.fit(docs)
    assert model.languages == sorted({lang for lang, _ in rows})
    found = language.predict_language(docs, model).collect()
    assert sum(r.lang_pred == rows[r.doc_id][0] for r in found) >= 0.95 * len(found)


def test_all_landmarks_equal_a_dense_ridge():
    """With every text a landmark the scores are those of kernel ridge regression on the whole kernel."""
    rows = [(lang, t) for seed, lang in enumerate("abc") for t in prose("abcdefghijklmnop", seed, 12)]
    model = language.Model(rows, landmarks=len(rows) * 3)
    flags = np.zeros(language.SIZE, bool)
    sets = [language.grams(t, model.table, flags) for _, t in rows]
    plain = [set(s.tolist()) for s in sets]
    kernel = np.array([[len(a & b) / math.sqrt(len(a) * len(b)) for b in plain] for a in plain])
    one = np.array([[lang == x for x in "abc"] for lang, _ in rows], float)
    want = kernel @ np.linalg.solve(kernel + language.RIDGE * np.eye(len(rows)), one)
    assert np.allclose(model.kernel(sets) @ model.weights, want, atol=2e-3)


def test_the_sample_knows_no_ids(spark, docs):
    """Other ids of rows that are not held out, and copies of them, change nothing."""
    plain = docs.where(~language.held_out(F.col("doc_id")))
    other = plain.withColumn("doc_id", F.expr("filter(transform(sequence(1, 40), i -> doc_id * 1000 + i), i -> crc32(cast(cast(i as string) as binary)) % 4 <> 2)[0]"))
    a, b = language.fit(plain), language.fit(other.union(other))
    assert a.languages == b.languages and np.allclose(a.weights, b.weights)


def test_kernel_is_shared_grams():
    rows = [("a", "abc abd"), ("b", "xyz xyw"), ("a", "abd abe"), ("b", "zyx w")]
    model = language.Model(rows, landmarks=4)
    flags = np.zeros(language.SIZE, bool)
    sets = [set(language.grams(t, model.table, flags).tolist()) for _, t in rows]
    got = model.kernel([np.array(sorted(s)) for s in sets])
    want = [[len(a & b) / math.sqrt(len(a) * len(b)) for b in sets] for a in sets]
    assert np.allclose(got, want, atol=1e-5)
    assert [p for p, _ in model.predict([np.array(sorted(s)) for s in sets])] == ["a", "b", "a", "b"]


def test_language_odd(odd_docs, no_docs, docs):
    rows = language.identify_languages(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    unknown = Counter(r.doc_id for r in rows if r.lang_pred == "und")
    assert unknown == Counter([3, 4, 5, None, 7])
    assert all(r.score == 0 for r in rows if r.lang_pred == "und")
    assert language.identify_languages(no_docs).collect() == []
    untaught = language.identify_languages(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {(r.lang_pred, r.score) for r in untaught.collect()} == {("und", 0.0)}
    kept = language.keep_identified(odd_docs, language.fit(docs), 0.0)
    assert kept.columns == odd_docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter([1, 1, 2, 6, 8, None])


def test_language_learns_from_the_other_rows_only(docs):
    swapped = docs.withColumn("lang", F.when(language.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    assert language.fit(swapped).languages == language.fit(docs).languages


# lines


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    full = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(full) - len(set(full)), len(covered)


def test_lines_against_brute_force(docs, texts, spark):
    extra = [(-1, "a b c d e f a b c d e x"), (-2, "a a a a a a a"), (-3, "a b c d e"), (-4, "x " * 3000), (-5, "l\nl\n \nl\r\nl"), (-6, None)]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    known = {**texts, **dict(extra)}
    for r in lines.clean_lines(df).collect():
        want = plain_counts(known[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r.doc_id
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])


def test_lines_that_fail(spark):
    good = "A line of words that ends well and says what it has to say, as lines do."
    rows = [
        (1, good + "\nHome | About | Contact | Help\nAll rights reserved by us."),
        (2, good + "\n" + "BUY!! NOW!! OR!! NEVER!! " * 20),
        (3, good + "\nAnother one follows, with other words in it. And it ends too!\nYes."),
        (4, good + "\nThis work is licensed under the Something License, version 2."),
    ]
    got = {r.doc_id: r for r in lines.clean_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].clean_text == good and got[1].kept and got[1].n_failed_lines == 2
    assert not got[2].kept and got[2].clean_text == good
    assert got[3].kept and got[3].n_failed_lines == 0 and got[3].left_share == 1
    assert got[4].kept


@pytest.mark.parametrize("words", [20, 59, 62, 300])
def test_a_notice_of_any_length_fails(spark, words):
    """What counts is how many notice phrases there are for the words of the line; no length is let off."""
    notice = ("We use cookies to improve this site and our privacy policy says more about what they are for and how long they stay . " * 30).split()[:words]
    prose = "A line of words that ends well and says what it has to say , as lines do . ".split() * 30
    rows = [(1, " ".join(notice)), (2, " ".join(prose[:290] + ["uses", "cookies"] + prose[:10]))]
    got = {r.doc_id: r.n_failed_lines for r in lines.clean_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 0}


def test_lines_odd(odd_docs, no_docs):
    rows = lines.clean_lines(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert all(r.base_failed and not r.kept and r.clean_text is not None for r in rows if r.n_words == 0)
    assert lines.clean_lines(no_docs).collect() == []


# mixing


def test_poisson_tables(spark):
    rates = spark.createDataFrame([("a", 1, 0.3), ("b", 1, 1.0), ("c", 1, 40.0), ("d", 1, 5000.0), ("e", 1, 0.0)], "source string, n long, rate double")
    got = {r.source: r for r in mixing.poisson_tables(rates).collect()}
    assert set(got) == {"a", "b", "c", "d"}
    for r in got.values():
        total = 0.0
        for i, c in enumerate(r.table):
            k = r.first + i
            total += math.exp(k * math.log(r.rate) - r.rate - math.lgamma(k + 1))
            assert abs(c - total) < 1e-8
        assert abs(r.table[-1] - 1) < 1e-12


def test_mixture(docs, spark):
    weights = {"src0": 3.0, "src1": 1.0}
    big = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("src"), (F.col("id") % 10 % 3)).alias("source"))
    got = mixing.mix_sources(big, weights, 40_000).collect()
    share = Counter(r.source for r in got)
    assert set(share) == {"src0", "src1"}
    assert abs(share["src0"] - 30_000) < 700 and abs(share["src1"] - 10_000) < 400
    copies = Counter(r.doc_id for r in got)
    assert all(sorted(r.copy for r in got if r.doc_id == i) == list(range(1, copies[i] + 1)) for i in list(copies)[:20])
    again = mixing.mix_sources(big.repartition(7), weights, 40_000).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    assert [r.doc_id for r in got] != sorted(r.doc_id for r in got)


def test_mixture_odd(odd_docs, no_docs):
    rows = mixing.mix_sources(odd_docs, total=1000)
    assert rows.columns[: 5] == odd_docs.columns[:5] and rows.columns.count("copy") == 1
    assert {r.source for r in rows.collect()} == {"a", "b", None}
    assert mixing.mix_sources(no_docs).collect() == []
    assert mixing.mix_sources(odd_docs, {}).collect() == []


# tokens


def test_bpe_equals_the_library(texts):
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(WORD_BPE)
    coder = bpe.WordBpe(open(WORD_BPE, "rb").read())
    rnd = random.Random(2)
    odd = ["", " ", "It's DON'T 'S we'll", "ΑΣ ΟΔΟΣ", "İ ǅ ß ẞ ﬁ", "a<|endoftext|>B<|startoftext|>", "x\x1cy\x85z", "²½Ⅷ_9", "日本 😀👍🏽", "a" * 2000, "é", "​　"]
    odd += ["".join(chr(rnd.choice([rnd.randrange(9, 0x7F), rnd.randrange(0x80, 0x400), rnd.randrange(0x1E00, 0x2060)])) for _ in range(25)) for _ in range(300)]
    for text in [*odd, *texts.values()]:
        ids = known.encode(text, add_special_tokens=False).ids
        mine = coder.encode(text)
        assert np.frombuffer(mine, "<u4").tolist() == ids, text[:80]
        assert coder.decode(mine) == known.decode(ids, skip_special_tokens=False)


def test_merges_by_rank_then_place():
    def slow(ids, merges):
        while True:
            found = min(((merges[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in merges), default=None)
            if found is None:
                return ids
            i = found[1]
            ids = ids[:i] + [merges[ids[i], ids[i + 1]][1]] + ids[i + 2 :]

    rnd = random.Random(3)
    for _ in range(300):
        pairs = list({(rnd.randrange(6), rnd.randrange(6)) for _ in range(10)})
        merges = {p: (rank, rnd.randrange(6)) for rank, p in enumerate(pairs)}
        # A merge makes a symbol of its own, as in a vocabulary.
        merges = {p: (rank, 6 + rank) for p, (rank, _) in merges.items()} | {(6, 1): (20, 30), (1, 6): (21, 31), (7, 7): (22, 32)}
        ids = [rnd.randrange(6) for _ in range(rnd.randrange(40))]
        assert bpe.merge_ids(ids[:], merges) == slow(ids, merges)


def test_bpe_odd(odd_docs, no_docs):
    rows = bpe.encode_documents(odd_docs, WORD_BPE).collect()
    assert len(rows) == odd_docs.count()
    assert [(r.n_tokens, r.ids, r.decoded) for r in rows if r.doc_id in (3, 4, 5)] == [(0, b"", "")] * 3
    digests = bpe.encode_documents(odd_docs, WORD_BPE, digests=True).collect()
    assert [(r.ids_sha256, r.decoded_sha256) for r in digests] == [
        (hashlib.sha256(r.ids).hexdigest(), hashlib.sha256(r.decoded.encode()).hexdigest()) for r in rows]
    assert bpe.encode_documents(no_docs, WORD_BPE).collect() == []


def greedy(word, vocab, later=None):
    count = at = 0
    while at < len(word):
        use = vocab if at == 0 or later is None else later
        size = next((n for n in range(len(word) - at, 0, -1) if word[at : at + n] in use), 0)
        if not size:
            return 1
        at, count = at + size, count + 1
    return count


def test_pieces_against_greedy_match(texts):
    rnd = random.Random(4)
    for _ in range(200):
        first = {bytes(rnd.choice(b"abc") for _ in range(rnd.randint(1, 5))) for _ in range(8)}
        later = None if rnd.random() < 0.5 else {bytes(rnd.choice(b"abc") for _ in range(rnd.randint(1, 4))) for _ in range(6)}
        automaton = pieces.PieceAutomaton(first, later)
        for _ in range(30):
            word = bytes(rnd.choice(b"abc") for _ in range(rnd.randint(1, 14)))
            assert automaton.count(word) == greedy(word, first, later), (first, later, word)
    vocab = pieces.byte_pieces(open(BYTE_BPE, "rb").read())
    automaton, known = pieces.PieceAutomaton(vocab), set(vocab)
    for text in list(texts.values())[:30]:
        for w in set(text.encode().split()):
            assert automaton.count(b" " + w) == greedy(b" " + w, known)


def test_piece_counts(docs, texts, odd_docs, no_docs):
    counts = pieces.PieceAutomaton(pieces.byte_pieces(open(BYTE_BPE, "rb").read())).count
    for r in pieces.count_pieces(docs, BYTE_BPE).collect():
        each = [counts(b" " + w) for w in texts[r.doc_id].encode().split()]
        assert (r.n_words, r.n_pieces, r.most_pieces) == (len(each), sum(each), max(each, default=0))
    rows = pieces.count_pieces(odd_docs, BYTE_BPE).collect()
    assert len(rows) == odd_docs.count() and [r.n_pieces for r in rows if r.doc_id in (3, 4, 5)] == [0, 0, 0]
    assert pieces.count_pieces(no_docs, BYTE_BPE).collect() == []


def test_blocks_and_cache():
    data = b"  word  " * 1000 + b"x" * 500 + b"\ny"
    for size in (1, 7, 100, 10**6):
        parts = list(blocks(data, size))
        assert b"".join(parts) == data and [w for p in parts for w in p.split()] == data.split()
    calls = []
    cache = WordCache(lambda w: calls.append(w) or 0, 3)
    assert cache(["a", "b", "a"]) == [0, 0, 0] and calls == ["a", "b"]
    cache(["c"]), cache(["a"]), cache(["a"])
    assert calls == ["a", "b", "c"]


# shards


@pytest.mark.parametrize("size", [1, 2, 3, 17, 1000, 4097])
def test_permutation(size):
    numbers = np.arange(size)
    a, b = shards.permuted(numbers, size, 1), shards.permuted(numbers, size, 2)
    assert sorted(a.tolist()) == sorted(b.tolist()) == list(range(size))
    assert size < 17 or a.tolist() != b.tolist()


def test_shards_round_trip(docs, texts, spark, tmp_path):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTE_BPE, "rb"))}
    known = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    shards.write_shards(docs, one, BYTE_BPE, P.PATTERN, shard_bytes=1 << 17)
    rows = shards.read_shards(spark, one).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    ids = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.seq)):
        assert len(r.ids) == 2 * r.n_ids
        ids.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u2").tolist())
    assert ids == {i: [*known.encode_ordinary(t), len(ranks)] for i, t in texts.items()}
    order = {(r.slot, r.doc_id, r.seq) for r in rows}
    part = shards.read_shards(spark, one, 50, 200).collect()
    assert {(r.slot, r.doc_id, r.seq) for r in part} == {x for x in order if 50 <= x[0] < 200}
    # The order does not hang on how the work was cut.
    shards.write_shards(docs.repartition(3), two, BYTE_BPE, P.PATTERN, shard_bytes=1 << 24)
    assert {(r.slot, r.doc_id, r.seq) for r in shards.read_shards(spark, two).collect()} == order


def test_shards_odd(odd_docs, no_docs, spark, tmp_path):
    out, empty, apart = (str(tmp_path / x) for x in ("out", "empty", "apart"))
    shards.write_shards(odd_docs, out, BYTE_BPE, P.PATTERN)
    rows = shards.read_shards(spark, out).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    assert Counter(r.doc_id for r in rows if r.seq == 0) == Counter(r.doc_id for r in odd_docs.collect())
    assert [r.n_ids for r in rows if r.doc_id in (3, 4)] == [1, 1]
    shards.write_shards(no_docs, empty, BYTE_BPE, P.PATTERN)
    assert shards.read_shards(spark, empty).collect() == []
    far = spark.createDataFrame([(-(2**63), "a b"), (2**63 - 1, "c"), (0, None)], "doc_id long, text string")
    shards.write_shards(far, apart, BYTE_BPE, P.PATTERN)
    assert {r.doc_id for r in shards.read_shards(spark, apart).collect()} == {-(2**63), 2**63 - 1, 0}
