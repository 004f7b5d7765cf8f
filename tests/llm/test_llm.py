"""Training-data operators against brute force, libraries and edge cases."""

import hashlib
import itertools
import os
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from mimiq.llm import additive, byte_bpe, catalog, chat, digests, html_text, langid, lines, packing, secrets, simhash
from tests.conftest import same_rows

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names clash with working ones."""
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, "the same line here again\nthe same line here again", "en", "a"), (3, "the same line here again\nthe same line here again", "en", "a")]
    rows += [(None, "no id here at all", "en", None), (4, "word " * 30000, "en", "b"), (5, "!!! 123 ...", None, "b"), (6, "é ß 日本語 ΣΑΣ 😀", "fr", "b")]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], DOCS)
    return df.withColumns({"row_key": F.lit("x"), "drop": F.lit(1), "fp": F.lit(2), "__text": F.lit("t"), "pos": F.lit(3), "words": F.lit("w"), "salt": F.lit(9), "tail": F.lit(True)})


def texts_of(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


# packing


def test_packing_covers_every_id_once(spark, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    out = packing.pack_documents(documents, packing.vocabulary_text()).toPandas()
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tok.encode_special_tokens = True
    for who, text in texts_of(documents).items():
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        part = out[out.doc_id == who].sort_values("start")
        assert list(part.start) == [0, *np.cumsum(part.length)[:-1]] and part.length.sum() == len(ids)
        assert (part.doc_tokens == len(ids)).all()
        for p in part.itertuples():
            assert zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32
    for _, seq in out.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert list(seq.offset) == [0, *np.cumsum(seq.length)[:-1]] and seq.length.sum() <= 2048
    n = out.sequence_id.nunique()
    assert out.length.sum() / (n * 2048) > 0.97


def test_packing_edges(spark, odd):
    out = packing.pack_documents(odd, packing.vocabulary_text(), 512).toPandas()
    assert len(out[out.doc_id == 2]) == 1 and out[out.doc_id == 1].length.sum() == 1
    assert out[out.doc_id == 3].length.sum() % 2 == 0 and out.doc_id.isna().sum() == 1
    assert out.groupby("sequence_id").length.sum().max() <= 512
    assert packing.pack_documents(odd.limit(0), packing.vocabulary_text()).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_shortest_pack_first_places_all(seed):
    rng = random.Random(seed)
    histogram = {rng.randint(1, 100): rng.randint(1, 500) for _ in range(40)}
    placed = {}
    for lengths, count in packing.shortest_pack_first(histogram, 100):
        assert sum(lengths) <= 100
        for n in lengths:
            placed[n] = placed.get(n, 0) + count
    assert placed == histogram


@pytest.mark.parametrize("histogram", [{700: 10, 30: 3000}, {90: 7, 45: 20, 20: 100, 3: 500}])
def test_packing_patterns_equal_piece_by_piece(histogram):
    size = 2048 if 700 in histogram else 100
    rooms = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            best = max(range(len(rooms)), key=rooms.__getitem__, default=None)
            if best is not None and rooms[best] >= length:
                rooms[best] -= length
            else:
                rooms.append(size - length)
    assert sum(n for _, n in packing.shortest_pack_first(histogram, size)) == len(rooms)


# byte-level BPE


@pytest.fixture(scope="module")
def codec():
    import public_tokenizers

    return byte_bpe.codec(byte_bpe.rank_file(), public_tokenizers.PATTERN)


def test_bpe_equals_the_library(codec, documents):
    import public_tokenizers
    import tiktoken

    ref = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rng = random.Random(1)
    texts = ["".join(rng.choice(" \n\tab'stéü日1!  　😀") for _ in range(rng.randint(0, 40))) for _ in range(1500)] + list(texts_of(documents).values())
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        assert ids == np.array(ref.encode_ordinary(text), "<u4").tobytes()
        assert codec.decode(ids) == text.encode()


def test_perfect_hash_is_minimal(codec):
    assert sorted(codec.hash.slot(t) for t in codec.ranks) == list(range(len(codec.ranks)))
    assert all(codec.whole(t) == i for t, i in codec.ranks.items())


def test_bpe_edges(spark, odd, codec):
    import public_tokenizers

    out = byte_bpe.encode_documents(odd, byte_bpe.rank_file(), public_tokenizers.PATTERN, with_ids=True).collect()
    assert len(out) == odd.count()
    for r in out:
        if r["doc_id"] in (1, 2):
            assert r["n_tokens"] == 0 and r["ids_sha256"] == hashlib.sha256(b"").hexdigest()
        assert r["n_tokens"] == len(r["ids"])


# SimHash


def brute_fingerprint(text):
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(nodes, linked):
    comp = {n: n for n in nodes}

    def root(n):
        while comp[n] != n:
            n = comp[n]
        return n

    for a, b in itertools.combinations(nodes, 2):
        if linked(a, b):
            x, y = sorted((root(a), root(b)))
            comp[y] = x
    return {n: root(n) for n in nodes}


def test_simhash_equals_brute_force(spark, documents, odd):
    df = documents.select("doc_id", "text").unionByName(odd.filter("doc_id is not null").select((F.col("doc_id") + 10000).alias("doc_id"), "text"))
    found = {r["doc_id"]: (r["fp"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(df).collect()}
    fps = {k: brute_fingerprint(t or "") for k, t in texts_of(df).items()}
    assert {k: v[0] for k, v in found.items()} == fps
    expected = brute_components(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    assert {k: v[1] for k, v in found.items()} == expected


@pytest.mark.parametrize("dense", [2, 64])
def test_links_connect_the_same_in_dense_groups(spark, dense):
    rng = random.Random(3)
    base = [rng.getrandbits(63) for _ in range(12)]
    fps = set(base)
    for b in base[:6]:
        at = b
        for _ in range(60):
            at ^= 1 << rng.randrange(63)
            if rng.random() < 0.5:
                at ^= 1 << rng.randrange(63)
            fps.add(at)
    fps = sorted(fps)
    edges = simhash.link_fingerprints(spark.createDataFrame([(x,) for x in fps], "fp long"), 2, dense).collect()
    assert all((r["a"] ^ r["b"]).bit_count() <= 2 for r in edges)
    linked = {(r["a"], r["b"]) for r in edges} | {(r["b"], r["a"]) for r in edges}
    assert brute_components(fps, lambda a, b: (a, b) in linked) == brute_components(fps, lambda a, b: (a ^ b).bit_count() <= 2)


@pytest.mark.parametrize("dense", [50, 3])
def test_near_stage_finds_all_that_shingles_link(spark, dense):
    import corpus_pipeline

    rng = random.Random(5)
    texts = ["", " ", "one two", "One  two"]
    for f in range(8):
        base = [f"w{rng.randrange(10**6)}" for _ in range((12, 60, 300)[f % 3])]
        for _ in range(7):
            text = list(base)
            for _ in range(rng.randint(0, len(base) // 40 + 1)):
                text[rng.randrange(len(text))] = "other"
            texts.append(" ".join(text))
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in texts)]
    comp = brute_components(range(len(texts)), lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = simhash.alike_documents(df, dense=dense).collect()
    least = {r["component"]: r["doc_id"] for r in found if r["first"]}
    assert {r["doc_id"]: least[r["component"]] for r in found} == comp
    if dense == 50:
        assert {r["doc_id"] for r in corpus_pipeline.near(spark, df, "").collect()} == set(comp.values())


def test_near_stage_searches_by_simhash(spark):
    rng = random.Random(6)
    sets = [np.unique(np.array([rng.getrandbits(63) for _ in range(40)], np.int64)) for _ in range(30)]
    sets += [np.append(s, rng.getrandbits(63)) for s in sets] + [sets[0][:-1]]
    fps = [simhash.set_fingerprint(s) for s in sets]
    bit = lambda s, k: 2 * sum(int(h) >> k & 1 for h in s) > len(s)
    assert all((f >> k & 1) == bit(s, k) for s, f in zip(sets, fps, strict=True) for k in range(64))
    got = simhash.alike_by_fingerprint(spark.createDataFrame([*enumerate(fps), (99, fps[0])], "h long, fp long").localCheckpoint()).collect()
    linked = {(r["a"], r["b"]) for r in got} | {(r["b"], r["a"]) for r in got}
    all_fps = dict([*enumerate(fps), (99, fps[0])])
    assert brute_components(sorted(all_fps), lambda a, b: (a, b) in linked) == brute_components(sorted(all_fps), lambda a, b: ((all_fps[a] ^ all_fps[b]) & (2**64 - 1)).bit_count() <= 2)


def test_near_stage_keeps_different_texts_of_null_and_repeated_ids(spark):
    import corpus_pipeline

    rows = [(None, "one text that stands alone here"), (None, "two is quite another text of its own"), (None, "three has other words again than all"), (3, "four differs from what comes before it"), (3, "five as well and so all of them stay")]
    df = spark.createDataFrame([*rows, rows[4], rows[4], (9, None), (8, "")], "doc_id long, text string").withColumn("ROW_KEY", F.lit(1)).withColumn("__row_key", F.lit(2))
    out = corpus_pipeline.near(spark, df, "")
    assert out.columns == df.columns
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert sorted(map(str, got)) == sorted(map(str, [*rows, (8, "")]))
    assert corpus_pipeline.near(spark, df.limit(0), "").count() == 0


def test_thresholds_follow_the_costs():
    assert simhash.allocate_thresholds([[0, 1, 9, 99], [0, 1, 9, 99], [0, 1, 9, 99]], 2) == [0, 0, 0]
    assert simhash.allocate_thresholds([[0, 1, 2, 99], [0, 1, 9, 99], [0, 50, 90, 99]], 2) == [1, 0, -1]


# line dedup


def test_line_dedup_keeps_first_of_each_group(spark):
    line = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(1, f"{line}\nonly in one document here", "en", "s", 0), (2, f"{line.upper()}!\nsomething quite different stands here", "en", "s", 0), (3, f"a b\n{line}", "en", "s", 0), (4, "a b", "en", "s", 0), (5, None, "en", "s", 0)]
    df = spark.createDataFrame(rows, DOCS)
    out = texts_of(lines.dedup_lines(df))
    assert out == {1: rows[0][1], 2: "something quite different stands here", 3: "a b", 4: "a b", 5: None}


def test_line_dedup_against_brute_force(spark, documents, odd):
    df = documents.select("doc_id", "text").unionByName(odd.filter("doc_id is not null").select((F.col("doc_id") + 10000).alias("doc_id"), "text")).dropDuplicates()
    occ = []
    table = df.selectExpr("doc_id", "posexplode(split(text, '\n')) as (pos, line)")
    for r in lines.with_signature(table.withColumn("words", lines.line_words(F.col("line"))).filter("size(words) >= 3")).collect():
        occ.append((r["doc_id"], r["pos"], tuple(r["words"]), r["sig"]))
    first = {}
    for d, p, w, _ in sorted(occ):
        first.setdefault(w, (d, p))
    sigs = {w: s for _, _, w, s in occ}

    def similar(a, b):
        if (sigs[a] ^ sigs[b]).bit_count() > 2:
            return False
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = new
        return 1 - row[-1] / max(len(a), len(b)) >= 0.8

    words = sorted(first, key=first.get)
    comp = brute_components(range(len(words)), lambda a, b: similar(words[a], words[b]))
    keep = {first[words[c]] for c in set(comp.values())}
    expected = {}
    counted = {(d, p) for d, p, _, _ in occ}
    for d, t in texts_of(df).items():
        expected[d] = None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (d, p) not in counted or (d, p) in keep)
    assert texts_of(lines.dedup_lines(df)) == expected


def test_signature_counts_bits_of_long_and_short_lines(spark):
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)) for n in (3, 40, 500, 501, 2300)]
    df = spark.createDataFrame([(t,) for t in texts], "line string").withColumn("words", F.split("line", " "))
    for r in lines.with_signature(df).withColumn("hs", F.transform("words", lambda w: F.xxhash64(w))).collect():
        assert r["sig"] == sum(1 << b for b in range(lines.BITS) if 2 * sum(h >> b & 1 for h in r["hs"]) > len(r["hs"]))


def word_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited_lines(seed, families, copies):
    """Families of lines around the similarity of 0.8, of few and of many words, with short words and repeats."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.choice((1, 2, 6, 8))))
    out = []
    for f in range(families):
        base = [word() for _ in range((4, 5, 9, 10, 14, 20, 33)[f % 7])]
        base[-1] = base[0]
        for _ in range(copies):
            line = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 5)):
                at = rng.randrange(len(line))
                line[at : at + rng.randint(0, 1)] = [word()] if rng.random() < 0.7 else []
            out.append(" ".join(line))
    return out


@pytest.mark.parametrize("dense", [50, 3])
def test_line_dedup_finds_all_that_edit_similarity_links(spark, dense):
    texts = edited_lines(7, 14, 8)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words = [tuple(t.split()) for t in texts]
    counted = [k for k, w in enumerate(words) if len(w) >= 3]
    comp = brute_components(counted, lambda a, b: 5 * word_edits(words[a], words[b]) <= max(len(words[a]), len(words[b])))
    expected = {k: t if comp.get(k, k) == k else "" for k, t in enumerate(texts)}
    assert texts_of(lines.dedup_lines(df, distance=None, dense=dense)) == expected


def test_line_dedup_finds_all_links_of_long_lines(spark):
    # a fifth of the words replaced, those of the rarest (longest) pairs: the ten rarest of both lines have none in common
    line = [f"u{k}" + "longer" * (k % 5 in (1, 2, 3)) for k in range(60)]
    texts = [" ".join(line), " ".join(f"v{k}longer" if k % 5 == 2 else w for k, w in enumerate(line))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert texts_of(lines.dedup_lines(df, distance=None, keys=10)) == dict(enumerate(texts))
    assert texts_of(lines.dedup_lines(df, distance=None)) == {0: texts[0], 1: ""}


def test_line_pairs_share_two_keys_of_small_or_large_groups(spark):
    # keys 1, 2, 3 are large (over 3 lines), 4 and 5 small
    keys = {1: [1, 2, 10], 2: [1, 2, 11], 3: [1, 4], 4: [1, 4, 12], 5: [2, 5, 3], 6: [4, 5], 7: [3, 5, 4], 8: [2, 3], 9: [3, 13]}
    table = spark.createDataFrame([(h, 10, k) for h, k in keys.items()], "h long, n int, keys array<long>")
    links, many = lines.candidate_pairs(table, 0.8, dense=3)
    expected = {(a, b) for a in keys for b in keys if a < b and len({*keys[a]} & {*keys[b]}) > 1}
    assert {(r["a"], r["b"]) for r in links.collect()} == expected and many.isEmpty()


def test_line_keys_of_a_common_passage_come_last(spark):
    # forty lines share a passage of twelve words and are not alike; the last two are, by the passage too
    passage = " ".join(f"passage{k}longest" for k in range(12))
    texts = [f"{' '.join(f'w{k}x{j}' for j in range(20))} {passage}" for k in range(40)]
    texts.append(texts[-1].replace("w39x3 ", "other ").replace("passage5longest", "changed"))
    split = spark.createDataFrame(list(enumerate(texts)), "h long, line string").withColumn("words", lines.line_words(F.col("line"))).withColumn("n", F.size("words"))
    keyed = split.select("h", "n", lines.counted_pairs(lines.rare_pairs(F.col("words"), 0.8, None)).alias("keys"))
    asked = []

    def again(crowd, large):
        out = lines.reordered_keys(split.select("h", "line").join(crowd.select("h"), "h"), large, 0.8)
        asked.extend(out.collect())
        return out

    links, many = lines.candidate_pairs(lines.materialize(keyed, "test"), 0.8, 10, again)
    assert len(asked) == 41 and {(r["a"], r["b"]) for r in links.collect()} == {(39, 40)} and many.isEmpty()
    # without it all of them meet
    assert lines.candidate_pairs(lines.materialize(keyed, "test"), 0.8, 10)[1].count() > 41
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert texts_of(lines.dedup_lines(df, distance=None, dense=10)) == dict(enumerate([*texts[:-1], ""]))


def test_near_copies_of_a_line_meet_by_rows_in_proportion_to_keys(spark):
    rng = random.Random(5)
    base = [f"word{k}" for k in range(40)]
    texts = []
    for k in range(60):
        line = list(base)
        for at in rng.sample(range(40), k % 14):
            line[at] = f"edit{k}x{at}"
        texts.append(line)
    split = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "h long, line string")
    keyed = lines.reordered_keys(split, spark.range(0).select(F.col("id").alias("key")), 0.8)
    _, many = lines.candidate_pairs(keyed, 0.8, 10, lambda crowd, large: lines.reordered_keys(split.join(crowd.select("h"), "h"), large, 0.8))
    assert many.count() <= 60 and many.select(F.max(F.size("subs"))).first()[0] <= 18
    comp = brute_components(range(60), lambda a, b: word_edits(texts[a], texts[b]) <= 8)
    assert len(set(comp.values())) > 1
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string")
    assert texts_of(lines.dedup_lines(df, distance=None, dense=10)) == {k: " ".join(w) if comp.get(k, k) == k else "" for k, w in enumerate(texts)}


def test_lines_of_a_large_group_meet_once_however_many_keys_they_share(spark, monkeypatch):
    # five lines, three keys, no two lines connected; 4 lacks the least key; 5 lacks all
    subs = {1: [7, 8, 9], 2: [7, 8, 9], 3: [7, 8, 9], 4: [8, 9], 5: [6]}
    rows = [(sub, 1 if h < 5 else 5, h, 10, h, *[0] * 16, keys) for h, keys in subs.items() for sub in keys]
    named = spark.createDataFrame(rows, "sub long, main long, h long, n int, component long, " + ", ".join(f"{x} long" for x in lines.FINE) + ", subs array<long>")
    # no row comes twice, without distinct() as well
    monkeypatch.setattr(type(named), "distinct", lambda self: self)
    got = [(r["a"], r["b"]) for r in lines.unconnected_pairs(named, 0.8, lines.turns(0.8), lines.FINE).collect()]
    assert sorted(got) == [(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4)]


def test_line_keys_are_gone_when_pairs_are_made(spark, monkeypatch):
    keyed = lines.materialize(spark.createDataFrame([(h, 10, [1, 2, h + 10]) for h in range(6)], "h long, n int, keys array<long>"), "test")
    at, make, seen = keyed._written_at.removeprefix("file:").replace("//", "/"), lines.materialize, {}
    monkeypatch.setattr(lines, "materialize", lambda df, tag: (seen.setdefault(tag, os.path.exists(at)), make(df, tag))[1])
    links, many = lines.candidate_pairs(keyed, 0.8, 10, spent=(keyed,))
    assert links.count() == 15 and many.isEmpty() and seen["sizes"] and not seen["paired"]


def test_line_sketches_of_lines_alike_are_within_their_turns(spark):
    texts = [tuple(t.split()) for t in edited_lines(3, 14, 6)]
    split = spark.createDataFrame([(k, list(w), len(w)) for k, w in enumerate(texts)], "h long, words array<string>, n int")
    signed = split.select("h", "n", *lines.sketch(F.transform("words", lambda w: F.xxhash64(w)), lines.FINE))
    bits = {r["h"]: [r[x] % 2**64 for x in lines.FINE] for r in signed.collect()}
    rows = [(a, b, len(texts[a]), len(texts[b])) for a in bits for b in bits if a < b]
    most = {(r["a"], r["b"]): r["t"] for r in spark.createDataFrame(rows, "a long, b long, na int, nb int").withColumn("t", F.expr(lines.turns(0.8))).collect()}
    alike = [(a, b) for a, b, na, nb in rows if 5 * word_edits(texts[a], texts[b]) <= max(na, nb)]
    assert len(alike) > 50 and any(len(texts[a]) != len(texts[b]) for a, b in alike)
    assert all(sum((x ^ y).bit_count() for x, y in zip(bits[a], bits[b], strict=True)) <= most[a, b] for a, b in alike)


def test_line_dedup_leaves_no_shuffle_files_behind(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {p for p in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in p}
    before = shuffled()
    table = spark.range(200).groupBy((F.col("id") % 50).alias("key")).count()
    lines.release(lines.write_once(table, "test"))
    untidy = shuffled()
    assert untidy - before
    lines.release(lines.materialize(table, "test"))
    time.sleep(2)
    assert not shuffled() - untidy


def test_line_dedup_drops_repeats_of_short_lines(spark):
    df = spark.createDataFrame([(1, "a b\n同じ文がここにある。\n!!!\n\nMenu"), (2, "A, b\n同じ文がここにある\n!!!\n\nmenu\nb a")], "doc_id long, text string")
    assert texts_of(lines.dedup_lines(df, distance=None, exact_short=True)) == {1: "a b\n同じ文がここにある。\n!!!\n\nMenu", 2: "!!!\n\nb a"}


def test_signature_counts_short_words(spark):
    words = "alpha beta gamma 1 of to".split()
    got = lines.with_signature(spark.createDataFrame([(words,)], "words array<string>")).withColumn("hs", F.transform("words", lambda w: F.xxhash64(w))).first()
    assert got["n"] == 6
    assert got["sig"] == sum(1 << b for b in range(lines.BITS) if 2 * sum(h >> b & 1 for h in got["hs"]) > 6)


@pytest.mark.parametrize("edit", ["one word replaced", "last word dropped", "a fifth replaced"])
def test_line_recall_by_edit_similarity(spark, documents, edit):
    rng = random.Random(11)
    base = [re.findall(r"[^\W_]+", r["line"].lower()) for r in documents.select(F.explode(F.split("text", "\n")).alias("line")).distinct().orderBy("line").collect()]
    base = [w for w in base if 10 <= len(w) <= 300][:400]
    for w in base:
        rng.shuffle(w)
    pool = [x for w in base for x in w]
    rows = []
    for k, w in enumerate(base):
        v = list(w)
        places = {"one word replaced": [rng.randrange(len(v))], "last word dropped": [], "a fifth replaced": rng.sample(range(len(v)), len(v) // 5)}[edit]
        for at in places:
            v[at] = rng.choice(pool)
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(v[:-1] if edit == "last word dropped" else v))]
    assert len(base) > 100
    gone = {k for k, t in texts_of(lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), distance=None)).items() if not t}
    assert sum(2 * k + 1 in gone or 2 * k in gone for k in range(len(base))) / len(base) >= 0.97


def test_line_dedup_edges(spark, odd):
    out = lines.dedup_lines(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    got = [r["text"] for r in out.filter("doc_id = 3").collect()]
    assert got == ["the same line here again"] * 2
    assert lines.dedup_lines(odd.limit(0)).count() == 0


# secrets


def test_secrets_equal_sql(spark, sf):
    same_rows(secrets.op2_secrets(spark, sf), secrets.op2_sql(), sf)


def test_secret_rules(spark):
    key, code = "AKIA" + "Q7" * 8, "0123456789abcdef" * 2
    rows = [(1, f"é token: abcdef {key}", "en", "a"), (2, "secret=token: abcdef PASSWORD = 'hunter22'", "en", "a"), (3, f"{code}0123456789abcdef", "en", "b"), (4, "AKIASHORT abc123", "en", "c"), (5, None, None, None)]
    df = spark.createDataFrame([(*r, 0) for r in rows], DOCS)
    got = {r["doc_id"]: r["spans"] for r in secrets.scan_secrets(df).collect()}
    assert got[1] == "assign:2:15,access:16:36"
    assert got[2] == "assign:21:41"
    assert got[3] == "hex:0:48" and got[4] == got[5] == ""
    clean = texts_of(secrets.redact_secrets(df))
    assert clean[1] == "é [SECRET] [SECRET]" and clean[4] == rows[3][1] and clean[5] is None


def test_ownership_frequency_tells_examples_from_credentials(spark):
    shared, own = "Ab3dEfGh1jKlMn0pQrStUv", "Zy9xWvUt8sRqPo7nMlKjIh"
    rows = [(k, f"see {shared} here", "en", f"s{k}", 0) for k in range(6)] + [(9, f"see {own} here", "en", "s1", 0)]
    got = {r["doc_id"]: r["spans"] for r in secrets.scan_secrets(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[9] == "token:4:26" and all(got[k] == "" for k in range(6))


def test_secret_edges(spark, odd):
    assert secrets.scan_secrets(odd).count() == odd.count()
    assert sorted(map(str, secrets.redact_secrets(odd).collect())) == sorted(map(str, odd.collect()))


# language ID


def test_language_of_held_out_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.op6_langid(spark, "/root/testdata/sf0.01").join(df.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (out.lang == out.lang_pred).mean() > 0.97 and out.score.between(0, 1).all()


def test_spans_of_mixed_text_and_edges(spark, documents, odd):
    model = langid.train(documents)
    parts = {r["lang"]: " ".join(r["text"].split()[:40]) for r in documents.filter("length(text) > 800 and lang in ('en', 'de')").orderBy("doc_id").collect()}
    mixed = spark.createDataFrame([(1, parts["en"] + ". " + parts["de"])], "doc_id long, text string")
    spans = langid.identify(mixed, model, with_spans=True).first()["spans"]
    assert [s["lang"] for s in spans][:1] == ["en"] and spans[-1]["lang"] == "de" and len(spans) <= 4
    got = langid.identify(odd, model, keep=("doc_id",)).collect()
    assert len(got) == odd.count()
    assert {r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 5)} == {"und"}
    assert langid.identify(odd.limit(0), model).count() == 0


def test_language_without_letters_evidence_or_labels(spark, documents):
    df = spark.createDataFrame([(1, "½ ² ③ Ⅷ"), (2, "漢字 かな"), (3, "١٢٣ 456"), (4, None)], "doc_id long, text string")
    model = langid.train(documents)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(df, model).collect()}
    assert got[1] == got[3] == got[4] == ("und", 0.0)
    assert got[2] == (model.languages[0], 1 / len(model.languages))
    none = langid.train(documents.limit(0))
    assert none.languages == [] and {r["lang_pred"] for r in langid.identify(df, none).collect()} == {"und"}


def test_viterbi_is_optimal():
    rng = np.random.default_rng(0)
    scores = [-rng.random((n, 4)).astype(np.float32) * 6 for n in (1, 5, 64, 65, 300, 0, 3)]
    worth = lambda s, path: sum(s[i, k] for i, k in enumerate(path)) - 7 * np.count_nonzero(np.diff(path))
    for s, path in zip(scores, langid.viterbi(scores, 7.0), strict=True):
        assert len(path) == len(s)
        if len(s):
            v = s[0].astype(float)
            for row in s[1:]:
                v = np.maximum(v, v.max() - 7) + row
            assert abs(worth(s, path) - v.max()) < 1e-2


# digests


def test_digests_follow_the_next_document(spark, documents, odd):
    df = documents.select("doc_id", "text").unionByName(odd.filter("doc_id is not null").select((F.col("doc_id") + 10000).alias("doc_id"), "text")).dropDuplicates()
    texts = {k: t or "" for k, t in texts_of(df).items()}
    order = sorted(texts, reverse=True)
    for size in (20000, 16 << 20):
        dealt = digests.with_next(df, size)
        assert dealt.filter("not tail").count() == len(texts)
    got = {r["doc_id"]: r for r in digests.fingerprint_documents(df).collect()}
    assert set(got) == set(texts)
    for who, after in zip(order, [*order[1:], order[0]], strict=True):
        t, k = texts[who], len(texts[who]) // 3
        edited = t[: len(t) - k] + texts[after][:k]
        assert got[who]["n_chars"] == len(t)
        assert got[who]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[who]["fingerprint"] == digests.digest_text(digests.filters_of(digests.features(t.encode())))
    near = [r["near_edited"] for r in got.values() if r["n_chars"] > 60]
    far = [r["near_next"] for r in got.values() if r["n_chars"] > 60]
    assert np.quantile(near, 0.02) > 0.2 and np.quantile(far, 0.9) < 0.2


def test_digest_ranges_give_the_same_next(spark, documents):
    whole = {(r["doc_id"], r["edited_sha256"]) for r in digests.fingerprint_documents(documents).collect()}
    dealt = digests.with_next(documents, 30000)
    rows = [r for r in dealt.toPandas().itertuples()]
    assert len({r.bucket for r in rows}) > 5
    seen = set()
    for a, b in itertools.pairwise(sorted(rows, key=lambda r: (r.bucket, r.tail, -r.doc_id))):
        if not a.tail and b.bucket == a.bucket:
            k = len(a.text) // 3
            seen.add((a.doc_id, hashlib.sha256((a.text[: len(a.text) - k] + b.text[:k]).encode()).hexdigest()))
    assert seen == whole


def test_digest_rows_without_id_follow_one_another(spark):
    rows = [(None, f"text number {k} of those without an id") for k in range(40)] + [(k, f"text of id {k}") for k in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sorted(map(str, digests.fingerprint_documents(df).collect()))
    dealt = digests.with_next(df, 200)
    assert len(whole) == 50 and dealt.filter("doc_id is null").select("bucket").distinct().count() > 3
    assert dealt.filter("not tail").count() == 50


def plain_features(data):
    """Features by definition: entropies by counting, hashes byte by byte, minima by looking."""
    w, mask = digests.WINDOW, 2**64 - 1
    data = data.ljust(w, b"\0") if data else data
    keys = []
    for i in range(len(data) - w + 1 if data else 0):
        part = data[i : i + w]
        counts = [part.count(b) for b in set(part)]
        entropy = int(2**20 * np.log2(w)) - sum(round(2**20 * c * np.log2(c)) for c in counts) // w
        h = sum((b + 1) * pow(int(digests._ODD), j, 2**64) for j, b in enumerate(part)) & mask
        h = (h ^ (h >> 31)) * 0xBF58476D1CE4E5B9 & mask
        rarity = min(511, abs(entropy - int(digests.USUAL * 2**20)) >> 14)
        keys.append(((511 - rarity) << 54) | ((h ^ (h >> 29)) >> 10))
    near = min(digests.NEAR, len(keys))
    least = [min(keys[i : i + near]) for i in range(len(keys) - near + 1)] if keys else []
    runs = [(k, len(list(g))) for k, g in itertools.groupby(least)]
    chosen = [k for k, n in runs if n >= min(digests.WINS, len(least))] or ([min(keys)] if keys else [])
    return list(dict.fromkeys(chosen))


def test_features_equal_brute_force(documents):
    texts = sorted((t or "" for t in texts_of(documents).values()), key=len)[:80]
    texts += ["", "a", "abcdefg", "abcdefgh", "abcdefghi", "a" * 300, "日本語 ΣΑΣ 😀" * 3]
    for t in texts:
        assert digests.features(t.encode()).tolist() == plain_features(t.encode())


def test_likeness_does_not_break_at_any_length(documents):
    text = max((t for t in texts_of(documents).values() if t), key=len)[:3000]
    for n in (100, 200, 250, 256, 257, 300, 400, 1000, 3000):
        whole, cut = (digests.filters_of(digests.features(t.encode())) for t in (text[:n], text[: n - n // 3]))
        assert digests.likeness(whole, cut) > 0.6


def test_digest_likeness_and_parse():
    a = digests.filters_of(digests.features(b"the quick brown fox jumps over the lazy dog " * 3))
    assert digests.likeness(a, a) == 1.0
    b = digests.parse_digest(digests.digest_text(a))
    assert (b[0] == a[0]).all() and (b[1] == a[1]).all()
    empty = digests.filters_of(digests.features(b""))
    assert digests.likeness(empty, empty) == 1.0 and digests.likeness(a, empty) == 0.0


# nearest neighbours


def test_neighbours_equal_exact_search(spark, sf):
    same_rows(catalog.queries()["op8_additive"](spark, sf), catalog.oracle_sql()["op8_additive"], sf)


def test_neighbour_recall_and_edges(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(6000, 32)).astype(np.float32)
    rows = [(i, [float(v) for v in e]) for i, e in enumerate(x)]
    rows += [(6000 + k, rows[7][1]) for k in range(30)] + [(7000, None), (7001, [0.0] * 32), (7002, [float("nan")] * 32), (7003, [1.0, None] * 16), (7004, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rep", F.lit(1))
    out = additive.nearest(df, df.filter("vec_id % 50 = 0 or vec_id = 7"), rerank=256, shard_rows=2500).toPandas()
    assert not out.vec_id.isin(range(7000, 7005)).any() and not (out.vec_id == out.query_id).any()
    assert list(out[out.query_id == 7].sort_values("rank").vec_id) == list(range(6000, 6010))
    every = np.vstack([x, np.repeat(x[7:8], 30, 0)]).astype(float)
    hit = total = 0
    for who, part in out.groupby("query_id"):
        d = np.sqrt(((every - every[who]) ** 2).sum(1))
        d[who] = np.inf
        best = set(np.lexsort((np.arange(len(d)), d))[:10].tolist())
        hit += len(best & set(part.vec_id))
        total += 10
        assert np.allclose(np.sort(part.score), np.sort(d[part.vec_id.to_numpy()]))
    assert hit / total >= 0.9
    close = spark.createDataFrame([(k, [1.0 + k * 1e-12, 2.0]) for k in range(4)], "vec_id long, embedding array<double>")
    assert all(r["score"] > 0 for r in additive.nearest(close, close.filter("vec_id = 0")).collect())
    assert additive.nearest(df.limit(0), df.limit(0)).count() == 0


# pages


def test_main_text_of_made_pages():
    trees = html_text.train(400)
    right = total = 0
    for page, main in html_text.made_pages(120, 77):
        _, blocks = html_text.parse(page)
        got = set(html_text.main_texts([page], trees)[0].split("\n"))
        for b in blocks:
            right += bool(main & set(b.split())) == (b in got)
            total += 1
    assert right / total > 0.97


def test_pages_query_and_edges(spark, sf):
    out = html_text.op3_html_text(spark, sf).collect()
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert len(out) == len(pages)
    assert sum(r["n_chars"] > 0 for r in out) > 0.95 * len(out) and all(r["n_chars"] == len(r["text"]) for r in out)
    trees = html_text.train(150)
    rows = [(1, None), (2, ""), (3, "<p"), (4, "<article><p>one &amp; two<p>three   four\n five</article>"), (5, "<<<>>>")]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumn("text", F.lit("clash"))
    got = {r["page_id"]: r["text"] for r in html_text.extract_pages(df, trees, keep=("page_id",)).collect()}
    assert got[1] == got[2] == got[3] == "" and len(got) == 5


def test_parse_rules():
    nodes, blocks = html_text.parse("<body><p>a<b>b<p>c &lt;d&gt;<script>if (a<b) '</p>'</script><ul><li>x<li>y</ul><!-- z --><title>t</title></body>")
    assert blocks == ["ab", "c <d>", "x", "y"]
    assert [n.tag for n in nodes] == ["html", "body", "p", "p", "ul", "li", "li"]


@pytest.mark.parametrize(
    ("page", "blocks"),
    [
        ("<p title=it's>Hello world</p><p>don't go > there</p>", ["Hello world", "don't go > there"]),
        ('<p class="a>broken', []),
        ("<p>Area is <math>x=2</math> here</p><noscript><p>shown</p></noscript>", ["Area is x=2 here", "shown"]),
        ("<p>a</ x>b<!-->c<!-- d --!>e<? f ><p a = 'x>y' b>g <i", ["abce", "g"]),
    ],
)
def test_tags_end_as_the_standard_says(page, blocks):
    assert html_text.parse(page)[1] == blocks


def test_decoding_leaves_no_contradiction():
    nodes = [html_text.Node("html", -1, 0), html_text.Node("div", 0, 1), html_text.Node("p", 1, 2), html_text.Node("p", 1, 2)]
    nodes[0].children, nodes[1].children = [1], [2, 3]
    nodes[2].blocks, nodes[3].blocks = [0], [1]
    assert html_text.decode(nodes, np.array([0, 5.0, 4.0, -0.5])).tolist()[2:] == [True, True]
    assert html_text.decode(nodes, np.array([0, 1.0, 4.0, -5.0])).tolist()[2:] == [True, False]


# chat


def test_preferences_equal_sql(spark, sf):
    same_rows(chat.op7_chat(spark, sf), chat.op7_sql(), sf)


def test_common_prefix_is_rendered_once(spark):
    rows = [(0, 0, "user", "hi"), (0, 1, "assistant", "hello"), (0, 2, "user", "more"), (0, 3, "assistant", "good é"), (1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 2, "user", "more"), (1, 3, "assistant", "bad"), (1, 3, "assistant", "bad"), (2, 0, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r["pair_id"]: r for r in chat.format_preferences(chat.pair_conversations(df, F.floor(F.col("conv_id") / 2), F.col("conv_id") % 2 == 0)).collect()}
    r = out[0]
    assert r["n_prefix"] == 3 and r["prompt"].count("hello") == 1
    assert r["chosen"] == "<|assistant|>\ngood é<|end|>\n" and r["rejected"] == "<|assistant|>\nbad<|end|>\n"
    s = r["chosen_spans"][0]
    assert r["chosen"][s["start"] : s["end"]] == "good é<|end|>\n"
    assert out[1]["prompt"] == "" and out[1]["rejected"] == "" and out[1]["chosen"] == "<|user|>\n<|end|>\n" and out[1]["chosen_spans"] == []


# pipeline


def test_pipeline_stages(spark, sf, documents, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    assert [n for n, _ in pipeline.STAGES] == ["language", "lines", "near", "secrets", "packing"]
    docs = documents
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert sorted(out.columns) == sorted(documents.columns)
        path = os.path.join(str(tmp_path), name)
        out.write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        assert docs.count() <= before.count()
        if name == "near":
            found = simhash.alike_documents(before).collect()
            assert {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in found if r["first"]}
    assert not any(re.search(secrets.PATTERNS["access"], t or "") for t in texts_of(docs).values())
    packed = pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == docs.count()
