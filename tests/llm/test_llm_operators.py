"""Each operator against a plain brute-force version, on the small tables and on awkward rows."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quillforge.llm import dart_minhash, decontamination, licenses, mixing, pii, substring_dedup, text_np, token_counts, token_files, toxicity, winnowing
from quillforge.llm.tokens import Encoder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, score double, size long, row string, node long, shard int, words string, u double, label string, hub long, key string, _range int, target double"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
BASE = " ".join(f"base{i}" for i in range(120))
AWKWARD = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "one"),
    (5, "two words"),
    (6, LONG),
    (7, LONG),
    (7, LONG),
    (8, BASE),
    (9, BASE.replace("base60 ", "other ")),
    (10, "intro " + BASE + " outro"),
    (None, BASE),
    (None, None),
    (11, "émoji 😀 and ünïcode\x85next　word"),
    (12, "Released under the MIT License. a@b.co +1 (555) 222-3344 10.0.0.1 4111 1111 1111 1111"),
    (13, "repeat " * 200),
    (14, "x" * 50_000),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(i, t, "en", None if i == 4 else f"s{(i or 0) % 3}", 1.0, 1, "r", 1, 1, "w", 0.5, "l", 1, "k", 1, 1.0) for i, t in AWKWARD], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def words_of(text):
    return WORD.findall(text or "")


def test_range_bucket(spark):
    import bisect

    from quillforge.llm.common import range_bucket

    for n in (0, 1, 2, 3, 10, 57):
        bounds = sorted(random.Random(n).sample(range(-50, 200), n))
        values = [*range(-60, 210), None]
        df = spark.createDataFrame([(v,) for v in values], "v long").select("v", range_bucket(F.col("v"), bounds).alias("b"))
        assert {r["v"]: r["b"] for r in df.collect()} == {v: (n + 1 if v is None else bisect.bisect_right(bounds, v)) for v in values}


# substring deduplication


def brute_repeats(rows, n=50):
    first = {}
    for d, t in rows:
        w = words_of(t)
        if d is not None:
            for i in range(len(w) - n + 1):
                g = tuple(w[i : i + n])
                first[g] = min(first.get(g, d), d)
    out = []
    for d, t in rows:
        w = words_of(t)
        gone = [False] * len(w)
        if d is not None:
            for i in range(len(w) - n + 1):
                if first[tuple(w[i : i + n])] < d:
                    gone[i : i + n] = [True] * n
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("which", ["docs", "awkward"])
def test_repeats(request, which):
    df = request.getfixturevalue(which)
    got = [tuple(r) for r in substring_dedup.remove_repeats(df).drop("repeats").collect()]
    assert sorted(got, key=str) == sorted(brute_repeats(texts_of(df)), key=str)


def test_repeats_of_shuffled_passages(spark):
    random.seed(5)
    passages = [" ".join(random.choice("abcdefgh") + str(random.randint(0, 40)) for _ in range(random.randint(30, 90))) for _ in range(8)]
    rows = [(i, " ".join(random.sample(passages, 3))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in substring_dedup.remove_repeats(df).drop("repeats").collect()]
    assert sorted(got) == sorted(brute_repeats(rows)) and sum(r[2] for r in got) > 1000


def thue_morse(n, letters):
    return "".join(letters[i.bit_count() % 2] for i in range(n))


def test_repeats_are_told_from_collisions(spark):
    """Words built to collide under polynomial hashes, and windows whose first hash is the same."""
    words = [f"w{i}" for i in range(49)]
    one, two = (" ".join([*words[:20], thue_morse(2048, x), *words[20:]]) for x in ("ab", "ba"))
    rows = [(1, one), (2, two), (3, two + " and more")]
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 50}
    random.seed(6)
    passages = [" ".join(f"p{i}x{j}" for j in range(60)) for i in range(6)]
    rows = [(i, " ".join(random.sample(passages, 3))) for i in range(30)]
    got = [tuple(r) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), bits=3).drop("repeats").collect()]
    assert sorted(got) == sorted(brute_repeats(rows)) and sum(r[2] for r in got) > 500


def test_rolling_grams_equal_plain_sums():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    first = np.array([0, 3, 120, 400])
    for n in (1, 2, 8, 50):
        got, valid = text_np.gram_hashes(h, first, n)
        for i in (0, 2, 3, 100, 119, 200, 350):
            plain = sum(int(x) * pow(text_np._GRAM, j, 1 << 64) for j, x in enumerate(h[i : i + n])) % (1 << 64)
            inside = any(a <= i and i + n <= b for a, b in itertools.pairwise(first))
            assert valid[i] == inside and (not inside or got[i] == text_np.splitmix(np.array([plain], np.uint64))[0])


# near-duplicates


def units_of(text):
    w = words_of(text)
    n = min(5, len(w))
    return collections.Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else collections.Counter()


def brute_classes(rows, threshold=0.8):
    ids = sorted({d for d, t in rows if d is not None and t is not None})
    up = {d: d for d in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    known = [(d, t, units_of(t)) for d, t in rows if d is not None and t is not None]
    for i, (d, t, u) in enumerate(known):
        for e, s, v in known[:i]:
            both = sum((u & v).values())
            if t == s or (both and both / (sum(u.values()) + sum(v.values()) - both) >= threshold):
                a, b = sorted((find(d), find(e)))
                up[b] = a
    return [(d, d if d is None or t is None else find(d)) for d, t in rows]


@pytest.mark.parametrize("which", ["docs", "awkward"])
def test_near_duplicates(request, which):
    df = request.getfixturevalue(which)
    got = [(r["doc_id"], r["class_id"]) for r in dart_minhash.near_duplicates(df).collect()]
    assert sorted(got, key=str) == sorted(brute_classes(texts_of(df)), key=str)


def family(n, edits, seed):
    random.seed(seed)
    base = [f"b{i}" for i in range(150)]
    out = []
    for _ in range(n):
        copy = list(base)
        for at in random.sample(range(150), random.choice(edits)):
            copy[at] = f"e{random.randint(0, 10**9)}"
        out.append(" ".join(copy))
    return out


def test_a_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(dart_minhash, "LARGE_BUCKET", 8)
    monkeypatch.setattr(dart_minhash, "BLOCK", 16)
    rows = list(enumerate(family(90, [1, 2, 3, 4, 5], 1) + family(30, [4, 5, 6], 2), 100))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["class_id"]) for r in dart_minhash.near_duplicates(df).collect()]
    assert sorted(got) == sorted(brute_classes(rows))
    assert 1 < len({c for _, c in got}) < 120


def test_signatures_estimate_weighted_similarity():
    import pyarrow as pa

    texts = family(2, [3], 3) + ["a b c d e " * 40, "a b c d e " * 20]
    (_, _, data, offs), = text_np.blocks(pa.array(texts))
    unit, counts = dart_minhash.units(data, offs)
    s = dart_minhash.signatures(unit, counts)
    for i, j in ((0, 1), (2, 3)):
        u, v = units_of(texts[i]), units_of(texts[j])
        both = sum((u & v).values())
        assert abs((s[i] == s[j]).mean() - both / (sum(u.values()) + sum(v.values()) - both)) < 0.12


def test_one_of_each_group_stays(awkward):
    kept = dart_minhash.one_of_each(awkward)
    assert kept.columns == awkward.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([1, 2, 3, 4, 5, 6, 8, 11, 12, 13, 14, None, None], key=str)


def test_one_doc_id_with_different_texts(spark):
    """Rows are judged by their texts: what goes is near a row that stays, whatever their doc_ids."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(80)) for x in "abcd")
    near = a.replace("a40 ", "other ")
    rows = [(5, a), (7, near), (7, b), (7, b), (8, b), (3, c), (3, d)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(map(tuple, dart_minhash.one_of_each(df).collect()))
    assert kept == sorted([(5, a), (7, b), (3, c), (3, d)])
    got = sorted((r["doc_id"], r["class_id"], r["class_size"]) for r in dart_minhash.near_duplicates(df).collect())
    assert got == [(3, 3, 1), (3, 3, 1), (5, 5, 2), (7, 5, 2), (7, 7, 3), (7, 7, 3), (8, 7, 3)]


def test_a_large_bucket_of_one_class_and_a_stray_stays_small(spark):
    """Nodes of the largest class meet the strays only: n nodes and one stray make rows and comparisons in proportion to n."""
    n = 3 * dart_minhash.BLOCK
    large = spark.range(n + 1).select(F.lit(1).cast("long").alias("band"), F.col("id").alias("node"), F.lit(0).alias("band_no"), F.when(F.col("id") == n, n).otherwise(0).cast("long").alias("label"), F.lit(9).cast("long").alias("n_units"), F.lit(9).cast("long").alias("shareable"))
    dealt = dart_minhash._dealt(large)
    assert dealt.count() == n + 4 and dealt.where("label = 0").groupBy("i", "j").count().agg(F.max("count")).first()[0] < 2 * dart_minhash.BLOCK
    assert dart_minhash._dealt(large.where("label = 0")).isEmpty()


def test_join_keys_splits_hot_keys(spark):
    from quillforge.llm.common import join_keys

    rows = spark.range(4000).select("id", F.when(F.col("id") % 3 > 0, F.lit("hot")).when(F.col("id") % 7 > 0, F.col("id").cast("string")).alias("k"))
    per = rows.where("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    got = {r["id"]: (r["k"], r["n"], r["first"]) for r in join_keys(rows, per, "k", "n", 4000).collect()}
    assert got == {i: ("hot", 2666, 1) if i % 3 else (str(i), 1, i) if i % 7 else (None, None, None) for i in range(4000)}
    joined = join_keys(rows, per, "k", "n", 4000).withColumn("p", F.spark_partition_id())
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().toString()


# decontamination


def test_leaks_with_words_replaced(spark):
    random.seed(7)
    item = [f"q{i}" for i in range(40)]
    rows, leaked = [], set()
    for d in range(60):
        filler = [f"f{random.randint(0, 10**6)}" for _ in range(random.randint(5, 80))]
        part = list(item)
        swaps = random.randint(0, 7) if d % 3 else 30
        for at in random.sample(range(40), swaps):
            part[at] = f"z{random.randint(0, 10**6)}"
        at = random.randint(0, len(filler))
        rows.append((d, " ".join(filler[:at] + part + filler[at:]).upper()))
        if d % 3:
            leaked.add(d)
    docs = spark.createDataFrame([*rows, (None, None), (99, ""), (98, " ".join(item[:13]))], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(item), 5), (2, "too short", 5), (3, None, 5)], "item_id long, text string, doc_id long")
    got = {r["doc_id"]: r for r in decontamination.leaks(docs, items).collect()}
    assert set(got) == leaked | {98}  # 13 words in a row are enough
    assert all(got[d]["matched"] >= 33 for d in leaked)
    assert sorted(r["doc_id"] for r in decontamination.without_leaks(docs, items).where("doc_id < 90").collect()) == sorted(set(range(60)) - leaked)


def fewest_replaced(masks, top):
    """For 0, 1, ... top words the fewest that must be replaced to leave no seed of the masks."""
    keep = max(map(len, masks)) - 1
    bits = [(len(m), int(m, 2)) for m in masks]
    states, out = {0: 0}, [0]
    for n in range(1, top + 1):
        following = {}
        for s, c in states.items():
            for x in (0, 1):
                w = s << 1 | x
                if not any(n >= size and not w & m for size, m in bits):
                    k = w & ((1 << keep) - 1)
                    following[k] = min(c + x, following.get(k, top))
        states = following
        out.append(min(states.values()))
    return out


def test_masks_leave_no_placement_out():
    """At the operator's own threshold no item of any length loses a placement of the replaced words: recall is 1."""
    for group in {decontamination.masks_for(n) for n in range(1, 401)}:
        of = [n for n in range(1, 401) if decontamination.masks_for(n) == group]
        fewest = fewest_replaced(group, max(of))
        assert all(fewest[n] > n // 5 for n in of)


@pytest.mark.parametrize("n", [1, 3, 4, 5, 6, 7, 8, 11, 15, 20, 26, 33, 40])
def test_recall_at_the_threshold(spark, n):
    rng = random.Random(n)
    item = [f"q{i}" for i in range(n)]
    rows = []
    for d in range(60):
        part = list(item)
        for at in rng.sample(range(n), n // 5 if d % 2 else rng.randint(0, n // 5)):
            part[at] = f"z{rng.randint(0, 10**6)}"
        rows.append((d, " ".join([*(f"f{rng.randint(0, 10**6)}" for _ in range(d % 7)), *part, "end"])))
    clean = [(100 + d, " ".join(f"q{i}" for i in range(n) if i % 4 != d % 4 or n == 1) + " x" if n > 4 else "q none") for d in range(4)]
    docs = spark.createDataFrame(rows + clean, "doc_id long, text string")
    got = {r["doc_id"] for r in decontamination.leaks(docs, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()}
    assert got - {100, 101, 102, 103} == set(range(60)) and (n > 12 or got == set(range(60)))


def test_leaks_of_awkward_rows(spark, awkward, empty):
    items = spark.createDataFrame([(1, BASE, "x", 3), (2, None, "x", 3), (3, "", "x", 3), (None, "repeat " * 9, "x", 3), (5, "two words", "x", 3), (6, BASE, "x", 3)], "item_id long, text string, words string, doc_id long")
    found = decontamination.leaks(awkward, items)
    got = sorted(((r["doc_id"], r["item_id"]) for r in found.collect()), key=str)
    assert got == sorted([*itertools.product([8, 9, 10, None], [1, 6]), (13, None), (5, 5)], key=str)
    kept = decontamination.without_leaks(awkward, items)
    assert kept.columns == awkward.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([1, 2, 3, 4, 6, 7, 7, 11, 12, 14, None], key=str)
    assert not decontamination.leaks(empty, items).collect() and not decontamination.leaks(awkward, items.limit(0)).collect()
    assert decontamination.without_leaks(awkward, items.limit(0)).count() == awkward.count()


def test_leaks_of_short_items_and_null_ids(spark):
    placements = [(n, c) for n in (8, 9, 10, 12) for c in itertools.combinations(range(n), n // 5)]
    rows = [(k, "before it " + " ".join(f"other{i}" if i in c else f"item{n}x{i}" for i in range(n)) + " after") for k, (n, c) in enumerate(placements)]
    items = [(None if n == 9 else n, " ".join(f"item{n}x{i}" for i in range(n))) for n in (8, 9, 10, 12)]
    got = decontamination.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(k, None if n == 9 else n) for k, (n, _) in enumerate(placements)}


def test_leaks_on_the_tables(spark, sf_dir, docs):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    token = re.compile(r"[^\W_]+")
    bench = {r["item_id"]: token.findall(r["text"].lower()) for r in items.collect()}
    want = set()
    for d, t in texts_of(docs):
        place = collections.defaultdict(list)
        for k, w in enumerate(token.findall(t.lower())):
            place[w].append(k)
        for i, words in bench.items():
            offsets = collections.Counter(p - j for j, w in enumerate(words) for p in place.get(w, ()))
            if offsets and max(offsets.values()) / len(words) >= 0.8:
                want.add((d, i))
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs, items).collect()} == want


# mixing


def fill(sizes, weights, most):
    out, left, total = {}, dict(sizes), sum(sizes.values())
    while True:
        w = sum(weights[s] for s in left)
        over = [s for s in left if total * weights[s] / w > most * left[s]] if w else []
        if not over:
            return out | {s: total * weights[s] / w for s in left}
        for s in over:
            out[s] = most * left.pop(s)
            total -= out[s]


@pytest.mark.parametrize("which", ["docs", "awkward"])
def test_mix(request, which):
    df = request.getfixturevalue(which)
    rows = mixing.mix(df).collect()
    sizes = collections.Counter()
    for r in df.collect():
        sizes[r["source"]] += len(words_of(r["text"]))
    order = sorted(sizes, key=lambda s: (s is None, s))
    want = fill(sizes, {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}, 3)
    taken, longest = collections.Counter(), collections.Counter()
    for r in rows:
        assert r["size"] == len(words_of(r["text"])) and r["taken"] == r["copies"] * r["size"] and r["copies"] <= 3
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
        taken[r["source"]] += r["taken"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= longest[s]
    again = mixing.mix(df.repartition(5)).collect()
    key = lambda r: (str(r["doc_id"]), r["copies"])
    assert sorted(map(key, again)) == sorted(map(key, rows))
    copies = mixing.mixed(df)
    assert copies.columns == df.columns and copies.count() == sum(r["copies"] for r in rows)


def test_mix_of_equal_rows(spark, tmp_path):
    """Of equal rows only as many are taken as the target asks for, row by row, as the SQL has it."""
    import duckdb

    rows = [(7, "w " * 200, "a")] * 80 + [(i, f"b{i} " * 300, "b") for i in range(100, 140)] + [(None, "n " * 50, "c")] * 30 + [(1, "once " * 10, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    df.write.parquet(f"{tmp_path}/documents")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents/*.parquet'")
    want = con.execute(mixing.ORACLE_SQL)
    columns = [d[0] for d in want.description]
    got = mixing.mix(df).select(*columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)
    a = got.where("doc_id = 7").agg(F.sum("taken"), F.max("target"), F.countDistinct("copies")).first()
    assert abs(a[0] - a[1]) <= 100 and a[2] == 2
    assert mixing.mixed(df).count() == got.agg(F.sum("copies")).first()[0]


# personal data


def plain_rules(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for kind, pattern, lo, hi in (("card", r"[0-9]([\x20-]?[0-9])+", 13, 19), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 9, 15)):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if lo <= len(digits) <= hi and (kind == "phone" or pii.luhn(digits)):
                out.append((kind, m.start(), m.end()))
    return out


def test_rules_equal_the_patterns():
    random.seed(11)
    alphabet = ["a", "B1", "@", ".", "-", "+", " ", "(", ")", "12", "255", "256", "4111111111111111", "\n", "é", "_%", "@x.yz", "+1 555 222 3344"]
    for _ in range(20_000):
        text = "".join(random.choice(alphabet) for _ in range(random.randint(0, 16)))
        assert pii.rule_spans(text) == plain_rules(text), text


def test_decoding_equals_enumeration():
    random.seed(3)
    weights = np.random.default_rng(1).normal(size=(len(pii.FIELD), len(pii.FEATURES)))
    for text in ("+1 (555) 222-3344 10.1", "1 2 3 4", "a@b.co 4111 1111"):
        (tokens,) = pii.runs(text)
        lattice = pii.Lattice(text, tokens)
        scores = lattice.scores(weights)

        def ways(i):
            if i == lattice.n:
                yield 0.0, ()
                return
            for s, rest in ways(i + 1):
                yield s, rest
            for k, (a, size, *_) in enumerate(lattice.segments):
                if a == i:
                    for kind in range(len(pii.FIELD)):
                        for s, rest in ways(i + size):
                            yield s + scores[k, kind], ((k, kind), *rest)

        every = list(ways(0))
        assert tuple(lattice.best(weights)) == max(every)[1]
        total = np.logaddexp.reduce([s for s, _ in every])
        marginals, log_total = lattice.marginals(weights)
        assert abs(log_total - total) < 1e-9
        for k in range(len(lattice.segments)):
            mine = [s for s, way in every if (k, 0) in way]
            assert abs(marginals[k, 0] - np.exp(np.logaddexp.reduce(mine) - total)) < 1e-9


@pytest.fixture(scope="module")
def field(spark, sf_dir):
    return pii.fit(spark.read.parquet(f"{sf_dir}/../sf0.01/documents.parquet"))


def planted_private(seed, n=300):
    """Texts with personal data that no rule finds, and the spans; every other text has only numbers of other kinds."""
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9)))

    def card():
        body = "4" + digits(14)
        return body + next(c for c in "0123456789" if pii.luhn(body + c))

    def fours(x, mark):
        return mark.join(x[i : i + 4] for i in range(0, 16, 4))

    private = {
        "phone": [lambda: f"tel: {digits(3)}-{digits(3)}-{digits(4)}", lambda: f"phone (415) {digits(3)}-{digits(4)}", lambda: f"0049 {digits(3)} {digits(4)} {digits(3)}", lambda: f"call 1.{digits(3)}.{digits(3)}.{digits(4)}"],
        "email": [lambda: f"{word()}.{word()}[at]{word()}.com", lambda: f"{word()}{digits(2)} (at) {word()} (dot) org", lambda: f"{word()} [at] {word()}.net"],
        "ip": [lambda: ".".join(str(rng.randint(1, 255)) for _ in range(4)).replace(".", "[.]")],
        "card": [lambda: fours(card(), "."), lambda: "card " + fours(card(), "/")],
        "secret": [lambda: f'secret = "{digits(6)}abX{digits(5)}cdeF{digits(6)}"', lambda: f"password: {word()}{digits(6)}{word()}Z{digits(4)}"],
    }
    clean = [lambda: f"on 2023-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}", lambda: f"version {rng.randint(1, 9)}.{rng.randint(1, 20)}.{rng.randint(1, 9)}", lambda: f"in 19{digits(2)}", lambda: f"{digits(2)},{digits(3)}.00 in all", lambda: f"order {digits(8)}", lambda: f"page {digits(3)} of {digits(3)}", lambda: f"at {rng.randint(1, 12)}:{rng.randint(10, 59)}", lambda: "4" + next(x for x in iter(lambda: digits(15), None) if not pii.luhn("4" + x))]
    out = []
    for i in range(n):
        kind = rng.choice(list(private)) if i % 2 else None
        filler = [" ".join(word() for _ in range(rng.randint(2, 8))) for _ in range(2)]
        piece = rng.choice(private[kind])() if kind else rng.choice(clean)()
        text = f"{filler[0]} {piece} {filler[1]}"
        assert not pii.rule_spans(text)
        out.append((text, kind, len(filler[0]) + 1, len(filler[0]) + 1 + len(piece)))
    return out


def test_the_field_finds_what_the_rules_miss(field):
    """Planted recall of at least 0.9 and precision of at least 0.95; a span must have the kind and lie inside the piece."""
    hits = wrong = 0
    planted = planted_private(17)
    missed = []
    for text, kind, a, b in planted:
        got = pii.added_spans(text, [], field)
        right = [k for k, s, e in got if k == kind and a <= s and e <= b]
        hits += bool(right)
        wrong += len(got) - len(right)
        if (kind and not right) or len(got) > len(right):
            missed.append((text[a:b], kind, [(k, text[s:e]) for k, s, e in got]))
    n = sum(kind is not None for _, kind, _, _ in planted)
    assert hits / n >= 0.9 and hits / (hits + wrong) >= 0.95, (hits, n, wrong, missed[:40])


def test_the_sample_of_runs_does_not_depend_on_partitions(spark, docs):
    few = docs.union(docs.limit(40)).select("text")
    a, b = (pii.fit(few.repartition(k), 200) for k in (1, 7))
    assert np.array_equal(a, b) and a.any()


def test_pii_on_tables(spark, docs, awkward, empty):
    weights = pii.fit(docs)
    for df in (docs, awkward):
        rows = pii.find(df, weights).collect()
        want = {}
        for d, t in texts_of(df):
            spans = plain_rules(t or "")
            want[d, t] = hashlib.sha256(",".join("%s:%d:%d" % s for s in spans).encode()).hexdigest()
        assert sorted(r["base_sha256"] for r in rows) == sorted(want[k] for k in texts_of(df))
    assert pii.find(empty, pii.fit(empty)).count() == 0


# licenses


def test_licenses(docs, awkward, empty):
    for df in (docs, awkward):
        want = []
        for d, t in texts_of(df):
            w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
            starts, labels = [], set()
            for phrase, label in licenses.PHRASES.items():
                p = phrase.split()
                at = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
                starts += at
                labels |= {label} if at else set()
            want.append((d, len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))))
        rows = licenses.scan(df).collect()
        assert sorted((tuple(r)[:6] for r in rows), key=str) == sorted(want, key=str)
        assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in rows)
    assert licenses.scan(empty).count() == 0


def brute_licenses(rows, templates):
    """labels and score by looking for every template's phrase at every place."""
    tokens = [(d, re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for d, t in rows]
    lists = [(label, words.split(), phrase.split()) for label, words, phrase in templates]
    seen = collections.Counter(w for _, ws in tokens for w in set(ws))
    weight = lambda w: max(1e-6, np.log((len(tokens) + 1) / (seen[w] + 1)))
    out = []
    for d, ws in tokens:
        labels, best = {label for p, label in licenses.PHRASES.items() if any(ws[i : i + len(p.split())] == p.split() for i in range(len(ws)))}, 0.0
        for label, words, phrase in lists:
            first = next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)
            full = sum(map(weight, words))
            rarest = first + max(range(len(phrase)), key=lambda k: (weight(phrase[k]), phrase[k]))
            postings = licenses.posted(words, [weight(w) for w in words], rarest)
            for i in [i for i in range(len(ws)) if ws[i : i + len(phrase)] == phrase]:
                stands = lambda k, offset: 0 <= k + offset < len(ws) and ws[k + offset] == words[k]  # noqa: B023, E731
                offsets = [o for o in range(i - first - licenses.SHIFT, i - first + licenses.SHIFT + 1) if any(stands(k, o) for k in postings)]
                part = sum(weight(w) for k, w in enumerate(words) if any(stands(k, o) for o in offsets)) / full
                if part >= licenses.LEAST_SCORE:
                    labels.add(label)
                    best = max(best, min(part, 1.0))
        out.append((d, ",".join(sorted(labels)), round(best, 9)))
    return out


def test_labels_and_scores_equal_brute_force(spark, docs, awkward):
    """Whole texts, notices, and both with words left out, replaced and put in; and the tables."""
    rng = random.Random(8)
    rows = []
    for i in range(160):
        words = rng.choice(licenses.TEMPLATES)[1].split()
        for _ in range(rng.randint(0, 12)):
            at = rng.randrange(len(words))
            words[at : at + 1] = rng.choice(([], ["other"], [words[at], "more"], [rng.choice(words)]))
        lead = " ".join(f"w{rng.randint(0, 50)}" for _ in range(rng.randint(0, 9)))
        rows.append((i, f"{lead} {' '.join(words)}, {rng.choice(licenses.TEMPLATES)[1].upper()}" if i % 3 else f"{' '.join(words)}. end"))
    made = spark.createDataFrame(rows, "doc_id long, text string")
    for df in (made, docs, awkward):
        got = [(r["doc_id"], r["labels"], round(r["score"], 9)) for r in licenses.scan(df).collect()]
        assert sorted(got, key=str) == sorted(brute_licenses(texts_of(df), licenses.TEMPLATES), key=str)
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame([(t, " ".join(words.split())) for t, (_, words, _) in enumerate(licenses.TEMPLATES)] + [(1000 + i, f"plain {i}") for i in range(60)], "doc_id long, text string")).collect()}
    assert all(got[t]["score"] == pytest.approx(1) and label in got[t]["labels"].split(",") for t, (label, _, _) in enumerate(licenses.TEMPLATES))


def test_licenses_beyond_the_phrases(spark):
    rows = [
        (1, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
        (2, "source and binary forms are not the same as redistribution"),
        (3, "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
        *[(10 + i, "plain text of the usual kind with and without the words of a license") for i in range(30)],
    ]
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == "bsd" and got[2] == "" and got[3] == "mpl" and not any(got[10 + i] for i in range(30))


def test_licenses_with_words_put_in_early(spark):
    """A word put in near the beginning moves all that follows; the license keeps its score, but for common words that no posted one stands with."""
    rows = []
    for t, (label, words, phrase) in enumerate(licenses.TEMPLATES):
        w = words.split()
        first = next(i for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split())
        for k, at in enumerate((1, max(1, first - 1), first + len(phrase.split()))):
            rows.append((10 * t + k, " ".join([*w[:at], *["put", "in", "words"][: k + 1], *w[at:]])))
        if len(w) > 40:
            cut = [x for i, x in enumerate(w) if i not in (2, 3, len(w) // 2) or first <= i < first + len(phrase.split())]
            rows.append((10 * t + 5, " ".join(cut)))
    rows += [(10_000 + i, "plain text of the usual kind with and without the words of a license") for i in range(200)]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for t, (label, words, _) in enumerate(licenses.TEMPLATES):
        for k in (0, 1, 2):
            best = max((f["score"] for f in got[10 * t + k]["found"] or [] if f["template"] == t), default=0)
            assert best > 0.8 and label in got[10 * t + k]["labels"].split(","), (t, k, best)
        if 10 * t + 5 in got:
            assert max(f["score"] for f in got[10 * t + 5]["found"] if f["template"] == t) > 0.85


def test_posted_words_leave_less_than_the_score():
    rng = random.Random(3)
    for _ in range(200):
        words = [f"w{rng.randint(0, 9)}" for _ in range(rng.randint(2, 30))]
        weights = [rng.choice([0.01, 0.5, 1.0, 3.0]) for _ in words]
        taken = licenses.posted(words, weights, 1)
        left = sum(w for i, w in enumerate(weights) if i not in taken)
        assert 1 in taken and (left + max(weights) < licenses.LEAST_SCORE * sum(weights) or len(taken) == len(words))


def test_licenses_of_files_with_several_texts(spark):
    texts = {i: words for i, (_, words, _) in enumerate(licenses.TEMPLATES)}
    pairs = [(a, b) for a in texts for b in texts if a < b]
    filler = [w for _, words, _ in licenses.TEMPLATES for w in reversed(words.split())]
    rows = [(k, f"{texts[a]} and also {texts[b]}") for k, (a, b) in enumerate(pairs)]
    rows += [(900, " then ".join(texts.values())), (901, " ".join([*filler, texts[6], *filler]))]
    rows += [(1000 + i, "plain text of the usual kind with and without the words of a license") for i in range(300)]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, pair in enumerate(pairs):
        assert set(pair) <= {f["template"] for f in got[k]["found"] if f["score"] == pytest.approx(1)}
    assert set(texts) <= {f["template"] for f in got[900]["found"]} and set(got[900]["labels"].split(",")) == {label for label, _, _ in licenses.TEMPLATES}
    assert any(f["template"] == 6 and f["place"] == len(filler) and f["score"] == pytest.approx(1) for f in got[901]["found"])


# fingerprints


def plain_winnow(grams, w):
    if not grams:
        return []
    if len(grams) <= w:
        return [min((g, -i) for i, g in enumerate(grams))]
    return list(dict.fromkeys(min((g, -i) for i, g in enumerate(grams[a : a + w], a)) for a in range(len(grams) - w + 1)))


def plain_rolling(hashes, n=5):
    """The cyclic polynomial, each value from the one before it: turn, take the oldest out, take the next in."""
    turn = lambda x, k: (x << k | x >> (64 - k)) & (2**64 - 1)
    now, out = 0, []
    for i, h in enumerate(hashes):
        now = turn(now, 1) ^ h ^ (turn(hashes[i - n], n) if i >= n else 0)
        if i >= n - 1:
            out.append(now)
    return out


def plain_prints(hashes):
    grams = plain_rolling([h % 2**64 for h in hashes])
    return [(grams[-i], -i) for _, i in plain_winnow([g >> 31 for g in grams], 16)]


def test_winnowing_picks_the_rightmost_smallest(spark, docs):
    df = winnowing.with_fingerprint(docs, F.col("text"), "prints")
    df = df.withColumn("h", F.transform(F.regexp_extract_all("text", F.lit(r"\S{1,12}"), F.lit(0)), lambda x: F.xxhash64(x))).where(F.size("h") >= 5)
    for r in df.select("prints", "prints_at", "h").limit(60).collect():
        assert [(x % 2**64, i) for x, i in zip(r["prints"], r["prints_at"], strict=True)] == plain_prints(r["h"])


def test_winnowing_of_passages_without_spaces(spark):
    random.seed(5)
    passages = ["".join(chr(random.randrange(0x4E00, 0x9F00)) for _ in range(150)), "".join(random.choices("abcdefgh😀+/0189", k=2000))]
    rows = []
    for p in passages:
        for shift in range(13):
            before, after = ("".join(random.choices("ijklmn", k=k)) for k in (40 + shift, 20))
            rows.append((len(rows), f"some words {before}{p}{after} and more"))
    rows += [(len(rows), passages[1]), (len(rows) + 1, passages[1][:1000] + "?" + passages[1][1000:])]
    df = winnowing.with_fingerprint(spark.createDataFrame(rows, "doc_id long, text string"), F.col("text"), "prints")
    got = [set(r["h"]) for r in df.orderBy("doc_id").select(F.col("prints").alias("h")).collect()]
    for part in (got[:13], got[13:26]):
        assert all(a & b for a in part for b in part)
    assert len(got[26] & got[27]) / len(got[26] | got[27]) > 0.8
    # a shared passage of the shortest length that is promised
    short = passages[1][700 : 700 + 5 + 16 + 12 - 2]
    pair = [(1, "i" * 61 + short + "j" * 30), (2, "k" * 70 + short + "m" * 47)]
    df = winnowing.with_fingerprint(spark.createDataFrame(pair, "doc_id long, text string"), F.col("text"), "prints")
    one, two = (set(r["h"]) for r in df.select(F.col("prints").alias("h")).collect())
    assert one & two


@pytest.fixture(scope="module")
def many_of_one(spark):
    """A third of the rows share a doc_id, a third have none."""
    rows = [(None if i % 3 == 0 else 77 if i % 3 == 1 else i, f"text {i % 40} " + " ".join(f"w{i}x{j}" for j in range(i % 30))) for i in range(1500)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


def in_file_order(df):
    keyed = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("k", F.xxhash64("text")).collect()
    return [(r["doc_id"], r["text"]) for r in sorted(keyed, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["k"], r["text"]))]


def test_ranges_split_one_frequent_doc_id(spark, many_of_one):
    from quillforge.llm.common import in_ranges

    ranged, order = in_ranges(many_of_one, 16)
    assert ranged.groupBy("_range").count().agg(F.max("count")).first()[0] < 200
    got = [(r["doc_id"], r["text"]) for r in ranged.orderBy("_range", *order).collect()]
    assert got == in_file_order(many_of_one)


@pytest.mark.parametrize("which", ["docs", "awkward", "many_of_one"])
def test_edited_texts(request, spark, which):
    df = request.getfixturevalue(which)
    rows = in_file_order(df)
    edits = []
    for k, (d, t) in enumerate(rows):
        after, half = rows[(k + 1) % len(rows)][1], len(t) // 2
        edits.append((d, t, t[: len(t) - half] + after[:half], after))
    prints = {r["text"]: r for r in winnowing.with_fingerprint(spark.createDataFrame([(x,) for e in edits for x in e[1:]], "text string").distinct(), F.col("text"), "p").collect()}
    line = lambda t: ",".join(f"{h % 2**64:x}:{i}" for h, i in zip(prints[t]["p"], prints[t]["p_at"], strict=True))

    def likeness(a, b):
        x, y = set(prints[a]["p"]), set(prints[b]["p"])
        return len(x & y) / len(x | y) if x | y else 1.0

    want = [(d, len(t), hashlib.sha256(e.encode()).hexdigest(), line(t), line(e), likeness(t, e), likeness(t, n)) for d, t, e, n in edits]
    got = [tuple(r) for r in winnowing.fingerprint_edits(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


# tokens


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_encoder_equals_the_library(tokenizer):
    encoder = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    random.seed(2)
    pieces = [" ", "  ", "\n", "\n\n", "\t", "\xa0", "　", "\x85", "a", "É", "12", ".", ",", "'s", "<|endoftext|>", "!?", "\r\n", "漢", "\x1c", "​", "it'll", "end.", "so,"]
    texts = ["".join(random.choice(pieces) for _ in range(random.randint(0, 12))) for _ in range(3000)]
    got = [np.frombuffer(x, encoder.kind).tolist() for x in encoder.encode(texts)]
    assert got == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("which", ["docs", "awkward"])
def test_token_counts(request, spark, tmp_path, tokenizer, which):
    df = request.getfixturevalue(which)
    path, cache = public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "cache")
    rows = texts_of(df)
    want = sorted(((d, len((t or "").encode()), n := len(tokenizer.encode(t or "", add_special_tokens=False).ids), n > 512) for d, t in rows), key=str)
    half = df.where("doc_id % 2 = 0")
    token_counts.count_tokens(half, path, cache).count()
    stored = spark.read.parquet(cache).count()
    assert stored == len({t or "" for d, t in rows if d is not None and d % 2 == 0})
    assert sorted((tuple(r) for r in token_counts.count_tokens(df, path, cache).collect()), key=str) == want
    total = spark.read.parquet(cache).count()
    assert total == len({t or "" for _, t in rows})  # only misses were added
    token_counts.count_tokens(df, path, cache).count()
    assert spark.read.parquet(cache).count() == total


def test_elias_fano():
    random.seed(1)
    for n, top in ((1, 0), (1, 10**12), (5, 3), (1000, 10**6), (700, 700), (300, 10**9)):
        values = np.sort(np.random.default_rng(n).integers(0, top + 1, n))
        coded = token_files.EliasFano.encode(values, top)
        assert [coded.select(i) for i in range(n)] == values.tolist()
        again, end = token_files.EliasFano.unpack(b"xyz" + coded.pack() + b"tail", 3, n, top)
        assert end == 3 + len(coded.pack()) and [again.select(i) for i in range(0, n, 7)] == values[::7].tolist()
        assert 8 * (len(coded.low) + len(coded.high)) <= n * (3 + max(0, np.log2(max(top, 1) / n))) + 24 and 8 * coded.directory.nbytes <= n / 4 + 32
    with pytest.raises(IndexError):
        coded.select(n)


@pytest.mark.parametrize("which", ["docs", "awkward", "many_of_one"])
def test_token_files(request, spark, tmp_path, tokenizer, monkeypatch, which):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 1000)
    df = request.getfixturevalue(which)
    path = str(tmp_path / "ids")
    token_files.write_token_files(df, path, public_tokenizers.path("byte_bpe_50k.json"))
    want, start = [], 0
    for d, t in in_file_order(df):
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((tuple(r) for r in token_files.summarise(spark, path).collect()), key=str) == sorted(want, key=str)
    assert token_files.read_token_files(spark, path).agg(F.sum(F.size("ids"))).first()[0] == start
    for d in {d for d, *_ in want[:: max(1, len(want) // 5)]} - {None}:
        assert token_files.ids_of(spark, path, d) == [[*tokenizer.encode(t, add_special_tokens=False).ids, 2] for e, t in in_file_order(df) if e == d]


def test_blocks_hold_any_doc_ids():
    kind = np.dtype("<u2")
    ids = [-(2**63), -5, -5, 0, 3, 2**63 - 1]
    block = token_files.Block(token_files.pack(ids, [np.arange(i, dtype=kind).tobytes() for i in range(6)], kind, 9))
    assert [block.doc_id(i) for i in range(6)] == ids and list(block.find(-5)) == [1, 2] and not block.find(4) and block.before == 9
    assert [block.bounds(i) for i in range(6)] == [(0, 0), (0, 1), (1, 3), (3, 6), (6, 10), (10, 15)]
    assert token_files.Block(token_files.pack([None, None], [b"", b"ab"], kind, 0)).doc_id(1) is None
    with pytest.raises(ValueError):
        token_files.Block(b"something else")


# toxicity


def test_toxicity_on_held_out_labels(spark, sf_dir):
    folder = sf_dir.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    out = toxicity.held_out(F.col("doc_id"))
    model = toxicity.fit(docs, labels.where(~out))
    assert len(model[0]) < 5_000  # sparse
    rows = toxicity.score(docs.select("doc_id", "text"), model).join(labels, "doc_id").where(out).select("score", "toxic").toPandas()
    ranks, bad = rows["score"].rank(), rows["toxic"] == 1
    auc = (ranks[bad].mean() - (bad.sum() + 1) / 2) / (~bad).sum()
    assert auc > 0.96
    assert (rows["score"][~bad] >= 0.5).mean() < 0.01 and (rows["score"][bad] >= 0.5).mean() > 0.7


def test_ftrl_equals_the_plain_algorithm():
    """Follow the regularised leader, coordinate by coordinate, from its published definition."""
    rng = random.Random(4)
    rows = [(np.array(sorted(rng.sample(range(40), rng.randint(1, 8))), np.int32), float(rng.random() < 0.4)) for _ in range(120)]
    alpha, beta, l1, l2 = 0.7, 1.5, 0.9, 0.3
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(i):
        penalty = 0.0 if i == "bias" else l1
        if abs(z[i]) <= penalty:
            return 0.0
        return -(z[i] - (penalty if z[i] > 0 else -penalty)) / ((beta + n[i] ** 0.5) / alpha + l2)

    for _ in range(3):
        for cells, label in rows:
            at = [*cells.tolist(), "bias"]
            w = {i: weight(i) for i in at}
            g = 1 / (1 + np.exp(-sum(w.values()))) - label
            for i in at:
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / alpha * w[i]
                n[i] += g * g
    at, w, bias = toxicity.ftrl(rows, alpha, beta, l1, l2, 3)
    want = {i: weight(i) for i in range(40) if weight(i)}
    assert at.tolist() == sorted(want) and 0 < len(want) < 40
    assert np.allclose(w, [want[i] for i in sorted(want)]) and bias == pytest.approx(weight("bias"))


def test_the_model_does_not_depend_on_the_order_of_rows(spark, docs):
    rows = docs.select("doc_id", "text").limit(60).union(docs.select("doc_id", F.upper("text")).limit(60))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("toxic"))
    a, b = (toxicity.fit(rows.repartition(k), labels, l1=0.5) for k in (2, 9))
    assert all(np.array_equal(x, y) for x, y in zip(a, b)) and len(a[0])


def test_toxicity_of_awkward_rows(spark, sf_dir, awkward, empty):
    labels = spark.createDataFrame([(8, 1, 1), (8, 1, 0), (12, 0, 0), (None, 0, 1), (6, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(awkward, labels)
    rows = toxicity.score(awkward, model)
    assert sorted(rows.columns) == sorted(awkward.columns) and all(0 < r["score"] < 1 for r in rows.collect())
    assert toxicity.score(empty, toxicity.fit(empty, labels.limit(0))).count() == 0


# empty tables


def test_empty_tables(spark, empty, tmp_path):
    items = spark.createDataFrame([], "item_id long, text string")
    path = public_tokenizers.path("byte_bpe_50k.json")
    results = [
        substring_dedup.remove_repeats(empty),
        dart_minhash.near_duplicates(empty),
        dart_minhash.one_of_each(empty),
        decontamination.leaks(empty, items),
        decontamination.without_leaks(empty, items),
        mixing.mix(empty),
        mixing.mixed(empty),
        winnowing.fingerprint_edits(empty),
        token_counts.count_tokens(empty, path, str(tmp_path / "cache")),
    ]
    assert [df.count() for df in results] == [0] * len(results)
    token_files.write_token_files(empty, str(tmp_path / "ids"), path)
    assert token_files.summarise(spark, str(tmp_path / "ids")).count() == 0


def test_repeats_with_many_rows_of_one_doc_id(spark):
    """Every row of a doc_id holds a passage, in surroundings of its own; later documents hold windows of any of these rows."""
    rng = random.Random(7)
    passage = [f"p{i}" for i in range(70)]
    rows = [(1, " ".join([*(f"r{k}x{i}" for i in range(60)), *passage, *(f"s{k}x{i}" for i in range(60))])) for k in range(150)]
    rows += [(1, rows[3][1])] * 40 + [(2, " ".join(["new"] * 3 + rows[rng.randrange(150)][1].split()[20:140])) for _ in range(20)]
    rows += [(3 + k, rows[k][1]) for k in range(10)] + [(20, " ".join(passage[:49])), (21, " ".join(passage[:50]))]
    got = [tuple(r) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).drop("repeats").collect()]
    assert sorted(got) == sorted(brute_repeats(rows))


def test_repeats_stay_linear_in_the_rows_of_a_doc_id(spark):
    """5,000 rows of one doc_id and 2,000 later documents share a passage: there are as many pairs as rows, not their product."""
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, f"{passage} row {k} one") for k in range(5_000)] + [(2 + k, f"{passage} doc {k}") for k in range(2_000)]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    counts = got.groupBy((F.col("doc_id") > 1).alias("later"), "n_removed").count().collect()
    assert {(r["later"], r["n_removed"]): r["count"] for r in counts} == {(False, 0): 5_000, (True, 60): 1, (True, 61): 1_999}  # "doc" follows the passage


def test_repeats_in_a_text_that_repeats_itself(spark):
    cycle = " ".join(["a b c d e f g h i j"] * 40)
    rows = [(1, cycle + " x " + cycle), (2, "start " + cycle + " end"), (3, " ".join(["a b c d e f g h i j"] * 4)), (4, "b c d e " + cycle)]
    got = [tuple(r) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).drop("repeats").collect()]
    assert sorted(got) == sorted(brute_repeats(rows))


def test_fit_takes_rows_not_documents(spark):
    """One labelled doc_id with more rows than the fit may take."""
    import pyarrow as pa

    rows = [(1, f"bad word {k % 300}") for k in range(900)] + [(2, "fine text")] * 30 + [(3, "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    order = [r["doc_id"] for r in labels.select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h").collect()]
    by = {d: sorted((r["tie"], r["text"]) for r in docs.where(F.col("doc_id") == d).select("text", F.xxhash64("doc_id", "text").alias("tie")).collect()) for d in order}
    expected = [(t, int(d == 1)) for d in order for _, t in by[d]][:100]
    cells = [c for block in toxicity.features(pa.array([t for t, _ in expected])) for c in block]
    at, w, bias = toxicity.ftrl(list(zip(cells, [y for _, y in expected])), 1.0, 1.0, 8.0, 1.0, 4)
    got = toxicity.fit(docs, labels, fit_rows=100)
    assert got[0].tolist() == at.tolist() and np.allclose(got[1], w) and abs(got[2] - bias) < 1e-9


def test_features_of_a_long_text_in_stretches(monkeypatch):
    import pyarrow as pa

    texts = pa.array(["one two three, four five six seven " * 30 + "end", "short", None, "a b c d e f g"])
    want = [c.tolist() for block in toxicity.features(texts) for c in block]
    monkeypatch.setattr(toxicity, "_STRETCH", 7)
    monkeypatch.setattr(text_np, "BLOCK_BYTES", 50)
    assert [c.tolist() for block in toxicity.features(texts) for c in block] == want


def test_word_sha_by_pieces(monkeypatch):
    monkeypatch.setattr(text_np, "BLOCK_BYTES", 16)
    for text in ("", "  ", "one", " one  two\tthree " * 9, "x" * 50 + " y", "a" * 16 + "b c"):
        assert text_np.word_sha256(text.encode()) == hashlib.sha256(b" ".join(text.encode().split())).hexdigest()


def test_mix_takes_documents_with_their_own_probabilities(spark):
    """90 sources alike, each a sample of its own: documents are taken as often as their rates say, and rates differ."""
    sizes = [20, 30, 45, 60, 80, 110, 150, 200, 300, 500, 800, 1300]
    rows = [(10_000 * s + 100 * i + k, "w " * n, f"s{s:04}") for s in range(90) for i in range(12) for k, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(8)
    got = mixing.mix(df).groupBy((F.substring("source", 2, 4).cast("int") % 3).alias("kind"), (F.col("doc_id") % 100).alias("k")).agg(F.avg("copies").alias("mean"), F.avg("target").alias("target"), F.max("copies").alias("most"), F.count("*").alias("n")).collect()
    seen = set()
    for kind in range(3):
        mine = {r["k"]: r for r in got if r["kind"] == kind}
        low, high = 0.0, 1e9
        for _ in range(200):  # the level by bisection
            level = (low + high) / 2
            if 12 * sum(n * min(3, level / n**0.25) for n in sizes) < mine[0]["target"]:
                low = level
            else:
                high = level
        for k, n in enumerate(sizes):
            rate = min(3, level / n**0.25)
            p = rate % 1
            # the last document may cross the target: the sample's size in words is fixed, its number is not
            assert abs(mine[k]["mean"] - rate) < 4.5 * (p * (1 - p) / mine[k]["n"]) ** 0.5 + 0.03, (kind, n, mine[k]["mean"], rate)
            seen.add(round(rate, 2))
    assert len(seen) > 20
