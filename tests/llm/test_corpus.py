"""Operators over the whole corpus: CTW scores, SimHash components, packing, the pipeline."""

import functools
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tracelake.llm import ctw, packing, ppm, simhash

# ---- language-model scores -----------------------------------------------------------------------


def lgamma_kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)


def plain_ctw(train, texts, depth, spread):
    """log2 P by the definition: one recursion over dictionaries of counts."""
    counts = [Counter() for _ in range(depth + 1)]
    for t in train:
        whole = b"\n" * depth + t
        for i in range(depth, len(whole)):
            for d in range(depth + 1):
                counts[d][whole[i - d : i], whole[i]] += 1
    total = sum(counts[0].values())
    tot = [Counter() for _ in range(depth + 1)]
    for d in range(depth + 1):
        for (c, _), n in counts[d].items():
            tot[d][c] += n
    kept = {b""} | {c for d in range(1, depth + 1) for c, n in tot[d].items() if d == 1 or n * spread >= total}
    own = {c: {s: counts[len(c)][c, s] for s in range(256) if counts[len(c)][c, s]} for c in kept}
    children = {c: [k for k in kept if len(k) == len(c) + 1 and k.endswith(c) and k != c] for c in kept}
    rest = {}
    for c in kept:
        if children[c]:
            r = Counter(own[c])
            for k in children[c]:
                r.subtract(own[k])
            rest[c] = {s: n for s, n in r.items() if n}

    def ab(table, level, node):
        zeros = sum(n for s, n in table.items() if s >> (8 - level) == node and not (s >> (7 - level)) & 1)
        return zeros, sum(n for s, n in table.items() if s >> (8 - level) == node) - zeros

    memo = {}

    def weighted(c, level, node):
        if (c, level, node) not in memo:
            kt = lgamma_kt(*ab(own[c], level, node))
            if children[c]:
                low = sum(weighted(k, level, node) for k in children[c]) + lgamma_kt(*ab(rest[c], level, node))
                memo[c, level, node] = math.log(0.5) + np.logaddexp(kt, low)
            else:
                memo[c, level, node] = kt
        return memo[c, level, node]

    def zero(c, context, level, node):
        a, b = ab(own[c], level, node)
        mine = (a + 0.5) / (a + b + 1)
        if not children[c]:
            return mine
        w = math.exp(math.log(0.5) + lgamma_kt(a, b) - weighted(c, level, node))
        k = context[len(context) - len(c) - 1 :]
        if k in kept:
            below = zero(k, context, level, node)
        else:
            x, y = ab(rest[c], level, node)
            below = (x + 0.5) / (x + y + 1)
        return w * mine + (1 - w) * below

    out = []
    for t in texts:
        whole, bits = b"\n" * depth + t, 0.0
        for i in range(depth, len(whole)):
            s = whole[i]
            for level in range(8):
                p = zero(b"", whole[i - depth : i], level, s >> (8 - level))
                bits += math.log2(1 - p if (s >> (7 - level)) & 1 else p)
        out.append(bits)
    return out


def test_ctw_equals_definition(spark):
    rng = random.Random(3)
    texts = [(i, " ".join("".join(rng.choice("abC") for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(0, 30)))) for i in range(30)] + [(40, None), (41, "zzz \n q"), (42, "")]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    coded = {i: b" ".join((t or "").encode().lower().split()) + b"\n" for i, t in texts}
    want = dict(zip(coded, plain_ctw([coded[i] for i in coded if not held(i)], list(coded.values()), 3, 20)))
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    for r in ctw.score_documents(frame, depth=3, spread=20).collect():
        assert r["held_out"] == held(r["doc_id"])
        assert r["score"] == pytest.approx(want[r["doc_id"]] * math.log10(2), rel=1e-4), r["doc_id"]


@pytest.mark.parametrize(("depth", "frequent_grams"), [(1, 1 << 20), (2, 5), (3, 0), (4, 50), (4, 1 << 20)])
def test_ctw_keeps_every_context(spark, monkeypatch, depth, frequent_grams):
    rng = random.Random(5)
    texts = [(i, " ".join(rng.choice(["ab", "abc", "bca", "Q" + str(i), "é"]) for _ in range(rng.randrange(0, 25)))) for i in range(30)] + [(40, None), (41, "zzz \n q"), (42, "")]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    coded = {i: b" ".join((t or "").encode().lower().split()) + b"\n" for i, t in texts}
    want = dict(zip(coded, plain_ctw([coded[i] for i in coded if not held(i)], list(coded.values()), depth, 10**9)))
    monkeypatch.setattr(ctw, "SUBTREE_ROWS", 20)
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["score"] for r in ctw.score_documents(frame, depth=depth, frequent_grams=frequent_grams).collect()}
    assert any(map(held, coded)) and got == pytest.approx({i: x * math.log10(2) for i, x in want.items()}, rel=1e-9)


def test_ctw_rare_context_has_its_own_node(spark):
    common = [(i, "ab cd " * 4000) for i in range(20) if zlib.crc32(str(i).encode()) % 7 != 2]
    key = next(i for i in range(100, 200) if zlib.crc32(str(i).encode()) % 7 == 2)
    train = [i for i in range(200, 250) if zlib.crc32(str(i).encode()) % 7 != 2][:5]
    frame = spark.createDataFrame([*common, *((i, "xaby xaby") for i in train), (key, "xaby")], "doc_id long, text string")
    whole, bounded = (next(r["score"] for r in ctw.score_documents(frame, depth=4, spread=s).collect() if r["doc_id"] == key) for s in (None, 8192))
    assert whole > bounded + 0.2


@pytest.mark.parametrize("frequent", [1, 20000])
def test_unigram_base_equals_definition(spark, documents, rows, frequent):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = lambda t: [*(t or "").encode().lower().split(), b""]
    c = Counter(w for r in rows if not held(r[0]) for w in tokens(r[1]))
    n, v = sum(c.values()), len(c)
    want = sorted((str(r[0]), len(tokens(r[1])), sum(c[w] > 0 for w in tokens(r[1])), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(r[1])), 6)) for r in rows)
    got = ctw.score_documents(documents, frequent=frequent).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want


def test_ctw_forecasts_sum_to_one_and_empty_tables(spark, nothing):
    assert ctw.score_documents(nothing).count() == 0
    import pandas as pd

    tree = ctw.ContextTree(pd.DataFrame({"depth": [0, 0, 1, 1], "context": [0, 0, 97, 98], "byte": [97, 98, 98, 97], "n": [4, 5, 5, 4]}), 2)
    assert np.allclose(np.exp2(tree.bits.astype(float)).sum(1), 1, atol=1e-4)
    assert np.allclose(np.exp2(ctw.ContextTree(pd.DataFrame(columns=["depth", "context", "byte", "n"])).bits.astype(float)).sum(1), 1, atol=1e-4)


# ---- near duplicates -----------------------------------------------------------------------------


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum((x >> b) & 1 for x in h) > len(h))


def plain_components(prints):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(prints, 2):
        if (a ^ b).bit_count() <= 2:
            root[find(a)] = find(b)
    return {p: find(p) for p in prints}


def test_near_duplicates_equal_brute_force(documents, nothing, rows):
    prints = {r[1]: plain_fingerprint(r[1]) for r in rows}
    comp = plain_components(sorted(set(prints.values())))
    least = {}
    for r in rows:
        if r[0] is not None:
            k = comp[prints[r[1]]]
            least[k] = min(least.get(k, r[0]), r[0])
    want = sorted((str(r[0]), f"{prints[r[1]]:016x}", least.get(comp[prints[r[1]]])) for r in rows)
    got = sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(documents).collect())
    assert got == want
    assert simhash.near_duplicates(nothing).count() == 0
    kept = simhash.one_of_each(documents)
    assert kept.columns == documents.columns
    roots = similar_roots([r[1] for r in rows])
    assert sorted(r["text"] or "" for r in kept.collect()) == sorted({(rows[i][1] or "") if rows[i][0] is not None else rows[i][1] for i in range(len(rows)) if roots[i] == i})


def shingle_set(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def similar_roots(texts, similarity=0.8):
    """For each text the first text that a chain of similar ones reaches."""
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] == sets[j] or both >= similarity * (len(sets[i]) + len(sets[j]) - both):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(texts))]


def test_near_copies_are_linked_by_their_shingle_sets(spark):
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(500)]
    texts = [None, "", "one", "one two"]
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice((60, 200, 2000)))]
        texts.append(" ".join(base))
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.randrange(1, 5) * len(base) // 200):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    roots = similar_roots(texts)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"] for r in simhash.one_of_each(frame).collect()}
    want = {i for i in range(len(texts)) if roots[i] == i}
    assert want <= got  # no document goes without a similar one that stays
    assert len(texts) - len(got) >= 0.95 * (len(texts) - len(want)) and len(want) < 0.6 * len(texts)


def test_a_group_of_unlike_members_is_looked_through_to_the_end(spark, monkeypatch):
    """Many texts in one band, most of them like none of the others."""
    rng = random.Random(2)
    sets = [sorted(rng.sample(range(10_000), 40)) for _ in range(40)]
    members = [np.array(s[: 40 - k], np.uint64) * np.uint64(0x9E3779B97F4A7C15) for s in sets for k in range(4)]
    rows = [(i, i * 1_000_003, [7, 1000 + i], simhash.minhashes(m)[::4].astype(np.uint8).tobytes(), np.unique((m >> np.uint64(32)).astype("<u4")).tobytes()) for i, m in enumerate(members)]
    nodes = spark.createDataFrame(rows, "node long, fp long, bands array<long>, signature binary, members binary")
    found = {tuple(sorted((r["a"], r["b"]))) for r in simhash.verified_links(nodes).collect()}
    roots = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(sorted(found), "a long, b long")).collect()}
    assert all(a // 4 == b // 4 for a, b in found) and roots == {i: i // 4 * 4 for i in range(160)}
    monkeypatch.setattr(simhash, "READERS", 2)
    assert {tuple(sorted((r["a"], r["b"]))) for r in simhash.verified_links(nodes).collect()} == found


def test_pairs_inside_a_component_are_not_verified_again(spark, monkeypatch):
    """Sixty near copies in two shared bands, each with a similarity of some 0.81 to every other: few pairs connect them all."""
    rng = np.random.default_rng(8)
    hashes = rng.integers(0, 1 << 63, (61, 200), dtype=np.uint64) * np.uint64(2)
    members = [np.where(rng.permutation(200) < 11, hashes[i], hashes[60]) for i in range(60)]
    rows = [(i, i * 1_000_003, [7, 8, 1000 + i], simhash.minhashes(m)[::4].astype(np.uint8).tobytes(), np.unique((m >> np.uint64(32)).astype("<u4")).tobytes()) for i, m in enumerate(members)]
    nodes = spark.createDataFrame(rows, "node long, fp long, bands array<long>, signature binary, members binary")
    verified, plain = [], simhash.similar
    monkeypatch.setattr(simhash, "similar", lambda pairs, sets: verified.append(pairs.count()) or plain(pairs, sets))
    found = [(r["a"], r["b"]) for r in simhash.verified_links(nodes).collect()]
    assert set(plain_roots(60, found)) == {0} and sum(verified) <= 2 * 60


def plain_roots(n, pairs):
    """The least number that each of ``n`` is connected with."""
    root = list(range(n))
    for _ in range(n):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_an_anchor_gives_a_forest_of_links():
    rng = np.random.default_rng(3)
    prints = np.unique(rng.integers(0, 64, 40)).astype(np.uint64) << np.uint64(58)
    found = simhash.spanning_links(prints, np.arange(len(prints)), 1)
    comp = plain_components_within(prints.tolist(), 1)
    assert len(found) == len(prints) - len(set(comp.values()))
    assert all(comp[int(prints[a])] == comp[int(prints[b])] for a, b in found)


def plain_components_within(prints: list[int], bits: int) -> dict[int, int]:
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(prints, 2):
        if (a ^ b).bit_count() <= bits:
            root[find(a)] = find(b)
    return {p: find(p) for p in prints}


def test_links_find_every_pair_within_two_bits(spark):
    rng = random.Random(4)
    prints = {0, (1 << 64) - 1}
    for _ in range(60):
        x = rng.getrandbits(64)
        prints.add(x)
        for _ in range(8):
            for b in rng.sample(range(64), rng.randrange(1, 3)):
                x ^= 1 << b
            prints.add(x)
    prints |= {1 << b for b in range(64)} | {3 << 62, (1 << 63) | 1}
    frame = spark.createDataFrame([(simhash.signed(x),) for x in sorted(prints)], "fp long")
    for bits in (0, 1, 2):
        want = {frozenset((a, b)) for a, b in itertools.combinations(prints, 2) if (a ^ b).bit_count() <= bits}
        got = [frozenset((r["a"] % (1 << 64), r["b"] % (1 << 64))) for r in simhash.links(frame, bits).collect()]
        assert set(got) == want and len(got) == len(set(got))
    found = {r["node"] % (1 << 64): r["root"] for r in simhash.components(simhash.links(frame)).collect()}
    comp = plain_components(sorted(prints))
    linked = {p for p in prints if sum(comp[q] == comp[p] for q in prints) > 1}
    assert set(found) == linked
    assert all((found[a] == found[b]) == (comp[a] == comp[b]) for a, b in itertools.combinations(linked, 2))


def test_components_of_a_long_chain(spark):
    order = list(range(300))
    random.Random(6).shuffle(order)
    frame = spark.createDataFrame(list(itertools.pairwise(order)), "a long, b long")
    assert {(r["node"], r["root"]) for r in simhash.components(frame).collect()} == {(i, 0) for i in range(300)}


def test_code_covers_and_is_perfect():
    values = np.random.default_rng(0).integers(0, 1 << 31, 5000)
    word = simhash.nearest_codeword(values)
    assert (np.bitwise_count(values ^ word) <= 1).all() and (simhash.nearest_codeword(word) == word).all()
    anchors, sizes = simhash.anchors_of(np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 100))
    assert sizes.max() <= 33 and len(anchors) == sizes.sum()


def test_one_row_of_each_component_with_null_and_repeated_ids(spark):
    rng = random.Random(11)
    a, b, c, d = (" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(40)) for _ in range(4))
    rows = [(None, a, "x"), (None, a, None), (None, a, "y"), (5, b, "x"), (None, b, "x"), (3, c, "x"), (3, d, "x"), (7, c, "x"), (4, d, "y"), (3, d, "z"), (3, d, "z")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    kept = [tuple(r) for r in simhash.one_of_each(frame).collect()]
    assert sorted(r[1] for r in kept) == sorted([a, b, c, d]) and set(kept) <= set(rows)
    assert {r[1]: r[0] for r in kept} == {a: None, b: 5, c: 3, d: 3}


def test_whole_rows_with_maps_and_clashing_names(spark):
    rows = [(1, "a b c d e", {"x": 1, "y": 2}, [1], 5), (1, "a b c d e", {"y": 2, "x": 1}, [1], 5), (2, "a b c d e", {}, None, 6), (3, None, None, [], 7), (4, "", None, [], 8), (5, "q r s", None, None, None)] * 3
    frame = spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>, `_c0` array<int>, h1 int").repartition(3)
    kept = simhash.one_of_each(frame)
    assert kept.columns == frame.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 5]
    assert simhash.one_of_each(frame.limit(0)).count() == 0


def test_whole_rows_are_shuffled_once(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = simhash.one_of_each(docs)._jdf.queryExecution().executedPlan().toString()
    wide = [line for line in plan.splitlines() if re.search(r"\bExchange hashpartitioning", line)]
    assert "SortMergeJoin" in plan and len(wide) <= 6


@pytest.mark.parametrize("most", [1, 3, 10_000])
def test_frequent_keys_are_joined_where_they_are(spark, most):
    from tracelake.llm.scratch import join_frequent

    rows = spark.createDataFrame([(k, i) for i, k in enumerate([1] * 50 + [2] * 20 + [3, 4, 5])], "k long, i long")
    table = rows.groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.col("k") * 10)
    got = join_frequent(rows, table, "k", "n", most)
    assert got.count() == 73 and got.where("v = k * 10").count() == 73 and "n" not in got.columns
    assert join_frequent(rows.limit(0), table.limit(0), "k", "n", most).count() == 0


# ---- packing -------------------------------------------------------------------------------------


@functools.cache
def whole_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))


def plain_ids(text):
    return [*whole_tokenizer().encode(text or "", add_special_tokens=False).ids, 1]


def check_packing(pieces, capacity):
    bins = {}
    for p in pieces:
        bins.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for x in bins.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= capacity
    return bins


def test_packing_equals_tokenizer_and_fills_gapless(documents, nothing, rows):
    got = packing.pack_documents(documents).collect()
    want = []
    for r in rows:
        ids = plain_ids(r[1])
        want += [(str(r[0]), k, a, len(ids[a : a + 4096]), zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
    assert sorted((str(p["doc_id"]), p["piece"], p["start"], p["length"], p["ids_crc32"]) for p in got) == sorted(want)
    bins = check_packing(got, 4096)
    assert len(bins) == -(-sum(p["length"] for p in got) // 4096)
    assert packing.pack_documents(nothing).count() == 0


def test_words_alone_have_the_ids_of_the_text():
    import public_tokenizers

    from tracelake.llm.textbytes import utf8_views

    words = packing.WordIds(public_tokenizers.path(packing.TOKENIZER))
    texts = ["It's they're DON'T x'll'd", "a<|endoftext|>b <|startoftext|> <|EndOfText|> <|ENDOFTEXT|>", "é Ȩ́ ﬁ Straße İstanbul ΣΑΣ ς", "tabs\tand\x0bmore nbsp em \x1c", "1234 a1b2 ½ ² ...!!! $%& ,,", "東京 日本語 한국어 हिन्दी", "\U0001f600 \x00 ퟿", "ÀÿþÐ×÷ µª º ÉÈ, ßẞ ÞÑ!?! a,b (c) d.e.f. 'q' \"r\" e\u0301 E\u0301. Ã ã Â\u00a0x", "", "  "]
    rng = random.Random(8)
    letters = "aBcdEé É ß × ÷ ' , . ! ( ) - 1 2 \t \n ñ Ñ Ω я 漢 \u0301 \u00a0 < | >"
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 60))) for _ in range(3000)]
    want = [plain_ids(t)[:-1] for t in texts]
    for _ in range(2):  # parts unknown, then known
        ids, at = words.encode(*utf8_views(pa.array(texts)))
        assert [ids[x:y].tolist() for x, y in itertools.pairwise(at.tolist())] == want
    words.forget()
    for t, w in zip(texts[:400], want):
        assert words.encode(*utf8_views(pa.array([t])))[0].tolist() == w, t


def plain_best_fit(lengths, limits):
    bins = []
    full = np.array([limits.tokens, limits.documents, limits.attention])
    w = np.array(limits.weights) / full
    for n in sorted(lengths, reverse=True):
        need = np.array([n, 1, n * n])
        fits = [(np.sqrt((((b - need) * w) ** 2).sum()) if limits.rule == "norm" else -((b * w) * (need * w)).sum(), i) for i, b in enumerate(bins) if (b >= need).all()]
        if fits:
            bins[min(fits)[1]] -= need
        else:
            bins.append(full - need)
    return len(bins)


def histogram_bins(lengths, limits):
    bins = {}
    for length, _, count, sequence, per, _ in packing.best_fit(Counter(lengths), limits):
        for k in range(count):
            bins.setdefault(sequence + k // per, []).append(length)
    return sorted(sorted(x) for x in bins.values())


def plain_bins(lengths, limits):
    bins, full = [], np.array([limits.tokens, limits.documents, limits.attention])
    w = np.array(limits.weights) / full
    for n in sorted(lengths, reverse=True):
        need = np.array([n, 1, n * n])
        fits = [(np.sqrt((((b - need) * w) ** 2).sum()) if limits.rule == "norm" else -((b * w) * (need * w)).sum(), i) for i, (b, _) in enumerate(bins) if (b >= need).all()]
        k = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append((full, []))
        bins[k] = (bins[k][0] - need, [*bins[k][1], n])
    return sorted(sorted(x) for _, x in bins)


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize(("documents", "attention"), [(100, 10000), (3, 10000), (6, 2500), (2, 1500)])
def test_bins_equal_best_fit_piece_by_piece(rule, documents, attention):
    """Also where the document count or the attention cost is what binds."""
    rng = random.Random(documents)
    limits = packing.Capacities(100, documents, attention, (1.0, 0.37, 0.11), rule)
    most = min(100, int(attention**0.5))
    for _ in range(8):
        lengths = [rng.randrange(1, most + 1) for _ in range(60)] + [rng.choice([3, 5, most // 2]) for _ in range(60)]
        assert histogram_bins(lengths, limits) == plain_bins(lengths, limits)


def test_repeated_rows_with_null_ids_share_no_window(spark):
    frame = spark.createDataFrame([(None, 0, 0, 5, 1)] * 5000, "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(4)
    placed = packing.place_pieces(frame).collect()
    assert len({(p["sequence_id"], p["offset"]) for p in placed}) == 5000
    check_packing(placed, 4096)


@pytest.mark.parametrize("limits", [packing.Capacities(100, 100, 10000), packing.Capacities(100, 4, 10000), packing.Capacities(100, 6, 3000), packing.Capacities(100, 6, 10000, (1.0, 2.0, 0.5), "dot")])
def test_best_fit_over_the_histogram(limits):
    rng = random.Random(9)
    most = min(100, int(limits.attention**0.5))
    for _ in range(5):
        lengths = [min(most, int(rng.paretovariate(1)) + 1) for _ in range(400)] + [most] * 30 + [rng.randrange(1, most + 1) for _ in range(100)]
        runs = packing.best_fit(Counter(lengths), limits)
        placed = Counter()
        bins = {}
        for length, first, count, sequence, per, offset in runs:
            assert first == placed[length]
            placed[length] += count
            for k in range(count):
                bins.setdefault(sequence + k // per, []).append((offset + k % per * length, length))
        assert placed == Counter(lengths)
        for x in bins.values():
            at = 0
            for offset, length in sorted(x):
                assert offset == at
                at += length
            assert at <= limits.tokens and len(x) <= limits.documents and sum(n * n for _, n in x) <= limits.attention
        if limits.rule == "norm":
            assert len(bins) <= plain_best_fit(lengths, limits) + 1


# ---- pipeline ------------------------------------------------------------------------------------


def test_pipeline_equals_brute_force(spark, tmp_path):
    import corpus_pipeline

    from tracelake.llm import decontaminate as dc
    from tracelake.llm import secrets

    source = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{source}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{source}/benchmark.parquet").collect()]
    rows = [r.asDict() for r in docs.collect()]
    rows = [r for r in rows if any(c.isalpha() for c in r["text"] or "")]
    rows = sorted(rows, key=lambda r: r["doc_id"])
    least = similar_roots([r["text"] for r in rows])
    rows = [r for i, r in enumerate(rows) if least[i] == i]
    index = dc.ItemIndex(items)
    rows = [r for r in rows if max(index.verify(r["text"].lower().encode(), range(len(index.items)))) < 0.8]
    for r in rows:
        r["text"] = secrets.redacted_text(r["text"], [{"start": a, "end": b} for _, a, b in secrets.brute_force(r["text"])])
    want = sorted((r["doc_id"], len(plain_ids(r["text"]))) for r in rows)
    got = corpus_pipeline.run(spark, source).collect()
    total = Counter()
    for p in got:
        total[p["doc_id"]] += p["length"]
    assert sorted(total.items()) == want
    assert len(check_packing(got, 4096)) <= -(-sum(total.values()) // 4096) + 1
    stage = docs
    for _, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, source)
        assert stage.columns == docs.columns
    mostly = ppm.identify_languages(docs).where("language.lang_pred = lang").count()
    assert mostly > 0.9 * docs.count()


HARD = "doc_id long, text string, lang string, source string, n_chars int, `_language` string, `_items` array<int>, `_secrets` string, `_c0` int, tags map<string,string>, root long"


def hard_rows():
    """Null, empty, blank, repeated, tied and very long rows, with columns named like those the stages used."""
    same = "the quick brown fox jumps over the lazy dog and runs away from it again"
    long = " ".join(f"word{i % 977} runs" for i in range(60_000))
    texts = [(1, same), (2, same), (2, same), (None, same), (None, "a text without an id stays"), (3, None), (4, ""), (5, " \n "), (6, long), (7, "12345 67"), (8, "password: hunter22abc is here"), (9, "benchmark item stands here in full")]
    return [(i, t, "en", "s", len(t or ""), "own", [1, 2], "mine", 7, {"k": "v"}, 5) for i, t in texts]


@pytest.mark.parametrize("place", range(4))
def test_stages_take_hard_rows(spark, tmp_path, place):
    import corpus_pipeline

    docs = spark.createDataFrame(hard_rows(), HARD).repartition(2)
    spark.createDataFrame([(1, "Benchmark item stands here in full"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    name, stage = corpus_pipeline.STAGES[place]
    out = stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    rows = [(r[0], r[1]) for r in hard_rows()]
    if name == "language":
        want = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    elif name == "near_duplicates":
        want = [(1, rows[0][1]), (None, rows[4][1]), (3, None), rows[8], rows[9], rows[10], rows[11]]
    elif name == "decontaminate":
        want = [r for r in rows if r[0] != 9]
    else:
        want = [(i, "[secret] is here" if i == 8 else t) for i, t in rows]
    assert got == sorted(want, key=str)
    assert all((r["_language"], r["_items"], r["_secrets"], r["_c0"], r["tags"]) == ("own", [1, 2], "mine", 7, {"k": "v"}) for r in out.collect())
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_last_stage_takes_hard_rows(spark):
    import corpus_pipeline

    docs = spark.createDataFrame(hard_rows(), HARD)
    out = corpus_pipeline.pack(spark, docs, "").collect()
    assert {p["doc_id"] for p in out} == {None, *range(1, 10)} and sum(p["length"] for p in out) == sum(len(plain_ids(r[1])) for r in hard_rows())
    check_packing(out, 4096)
    assert corpus_pipeline.pack(spark, docs.limit(0), "").count() == 0


def test_dense_prints_bring_no_pairs_of_all(spark):
    """All words within two bits of one: 2,080 links each at the centre, but no more connections than rows of the anchors."""
    prints = [0, *(1 << b for b in range(64)), *((1 << a) | (1 << b) for a, b in itertools.combinations(range(64), 2))]
    frame = spark.createDataFrame([(simhash.signed(x), [simhash.signed(x)]) for x in prints], "node long, fps array<long>")
    found = simhash.connections(frame)
    assert found.count() < simhash.replicated(frame.select("node")).count()
    assert {r["root"] for r in simhash.components(found).collect()} == {min(simhash.signed(x) for x in prints)}
