"""Near-duplicates, quality, mixing, top-k, fingerprints and the pipeline against brute force."""

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from askgrid.llm import fingerprints, mixing, near_dedup, quality, queries, segment_search
from askgrid.llm.components import components
from askgrid.plans.shared import written
from check import TABLES, rows_of

FOLDER = "/root/testdata/sf0.001"


def shingle_set(text, n=5):
    words = (text or "").split()
    return {tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def classes_of(texts, least=0.8):
    """Brute force: all pairs, then union-find; equal texts always together."""
    root = {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = {k: shingle_set(t) for k, t in texts.items()}
    keys = sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (texts[a] or "") == (texts[b] or "") or (
                    sets[a] and sets[b] and jaccard(sets[a], sets[b]) >= least):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def near_corpus(rng):
    """Groups of copies and edited copies, shared passages, short, empty and null texts."""
    def words(n):
        return [f"w{rng.randrange(3000)}" for _ in range(n)]

    texts, passage = {}, words(60)
    for group in range(8):
        base = words(rng.choice([40, 120, 300]))
        for _ in range(rng.choice([1, 3, 12])):
            edited = list(base)
            for _ in range(rng.choice([0, 1, 2, 5])):
                edited[rng.randrange(len(edited))] = f"x{rng.randrange(10**6)}"
            texts[len(texts)] = " ".join(edited)
    for _ in range(30):
        texts[len(texts)] = " ".join([*words(80), *passage])
    for t in ("", None, "", "  ", "a b", "a b", "a  b", "one two three four five", "é " * 200,
              "é " * 300):
        texts[len(texts)] = t
    return texts


def test_probability_jaccard_estimates():
    rng = np.random.default_rng(1)

    def exact(a, b):
        both = set(a) | set(b)
        return sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in both)
                   for i in set(a) & set(b))

    for _ in range(6):
        a = {int(k): float(w) for k, w in zip(rng.choice(60, 30, False), rng.integers(1, 5, 30))}
        b = {k: w + (rng.random() < 0.3) for k, w in a.items() if rng.random() < 0.8}
        b.update({100 + i: 1.0 for i in range(int(rng.integers(1, 8)))})
        elements = [*a, *b]
        got = near_dedup.prob_minhash(
            near_dedup._mix(np.array(elements, np.uint64)),
            np.array([*a.values(), *b.values()], float),
            np.repeat([0, 1], [len(a), len(b)]), 3, 3000)
        assert abs((got[0] == got[1]).mean() - exact(a, b)) < 0.04
        assert not got[2].any()


def test_shingles_follow_the_words():
    texts = ["a b c d e f", " a b  c d e ", "a b", "", None, "x " * 10]
    hashes, doc = near_dedup.shingles(pa.array(texts))
    assert Counter(doc.tolist()) == {0: 2, 1: 1, 2: 1, 5: 6}
    assert hashes[0] == hashes[2] and len(set(hashes[4:].tolist())) == 1
    flat, offsets = near_dedup.shingle_sets(pa.array(texts))
    assert np.diff(offsets).tolist() == [2, 1, 1, 0, 0, 1]


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    edges += [(1000 + i, 1001 + i) for i in range(60)] + [(5000, i) for i in range(6000, 6100)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r.node: r.root for r in got} == {x: find(x) for x in root} and len(got) == len(root)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_near_duplicates_equal_brute_force(spark):
    texts = near_corpus(random.Random(7))
    rows = [(k, t, "x") for k, t in texts.items()]
    docs = spark.createDataFrame([*rows, (None, "a b", "x"), (None, "alone", "x"), rows[0]],
                                 "doc_id bigint, text string, class_id string")
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == len(rows) + 3
    assert {r.doc_id: r.class_id for r in got if r.doc_id is not None} == classes_of(texts)
    short = min(k for k, t in texts.items() if t == "a b")
    assert sorted((r.class_id is None, r.class_id) for r in got if r.doc_id is None) == [
        (False, classes_of(texts)[short]), (True, None)]
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(
        set(classes_of(texts).values()))
    assert kept.where("doc_id is null").count() == 2
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_links_outside_the_leaders_star_are_found(spark):
    """A chain: neighbours are alike, ends are not, so one leader cannot verify all of them."""
    base = [f"w{i}" for i in range(400)]
    texts = {}
    for i in range(12):
        words = list(base)
        for j in range(i):
            words[j * 30 + 5] = f"y{j}"
        texts[i] = " ".join(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs).collect()}
    assert got == classes_of(texts) and set(got.values()) == {0}


def test_a_line_repeated_on_one_side_hides_no_pair(spark):
    rng, texts = random.Random(11), {}
    for pair in range(300):
        words = [f"w{rng.randrange(10**6)}" for _ in range(90)]
        line = words[40:52]
        texts[2 * pair] = " ".join(words)
        texts[2 * pair + 1] = " ".join([*words[:-7], *line * 32])
    alike = [jaccard(shingle_set(texts[i]), shingle_set(texts[i + 1])) for i in range(0, 600, 2)]
    assert 0.8 <= min(alike) and max(alike) < 0.85
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs).collect()}
    assert sum(got[i] == got[i + 1] for i in range(0, 600, 2)) >= 297


def test_unlike_texts_of_one_id_stay_apart(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(50)) for c in "ab")
    docs = spark.createDataFrame(
        [(1, a, "x"), (1, b, "x"), (1, b, "x"), (2, a + " z", "x"), (-(1 << 63), b + " z", "x"),
         ((1 << 63) - 1, "c", "x")], "doc_id bigint, text string, _node string")
    got = sorted((r.doc_id, r.class_id) for r in near_dedup.near_duplicates(docs).collect())
    low, high = -(1 << 63), (1 << 63) - 1
    assert got == [(low, low), (1, low), (1, low), (1, 1), (2, 1), (high, high)]
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [
        (low, b + " z"), (1, a), (high, "c")]


def test_one_outsider_costs_no_copies_of_a_bucket(spark, monkeypatch):
    """A bucket of many members and one outsider: every member meets it once."""
    monkeypatch.setattr(near_dedup, "CELL_MEMBERS", 100)
    members = 5_000
    key = F.unhex(F.lpad(F.hex("id"), 32, "0"))
    placed = spark.range(members).select(
        F.lit(1).alias("band"), key.alias("id"),
        F.when(F.col("id") == 7, key).otherwise(F.unhex(F.lpad(F.lit("0"), 32, "0"))).alias("root"),
        (F.col("id") == 7).alias("outside"))
    sets = spark.range(members).select(key.alias("id"), F.array(
        F.lit(1), F.lit(2), F.lit(3)).cast("array<bigint>").alias("hashes"))
    seen = spark.sparkContext.accumulator(0)
    inner = near_dedup._cell_links(0.8)

    def counting(left, right):
        seen.add(right.num_rows)
        return inner(left, right)

    monkeypatch.setattr(near_dedup, "_cell_links", lambda similarity: counting)
    links = near_dedup._missing_links(placed, sets, 0.8).collect()
    assert seen.value == members and links
    assert all(7 in (int(r.a.hex(), 16), int(r.b.hex(), 16)) for r in links)


def test_op2_over_the_given_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = {r.doc_id: r.class_id for r in queries.op2_near_duplicates(spark, FOLDER).collect()}
    assert got == classes_of(texts)


# --- quality --------------------------------------------------------------------------------------

def test_quality_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    shown = labels.where("doc_id % 2 = 0")
    held = labels.where("doc_id % 2 = 1").withColumnRenamed("quality", "truth")
    got = quality.quality_scores(docs, shown).join(held, "doc_id").select("keep", "truth").collect()
    assert sum(r.keep == bool(r.truth) for r in got) / len(got) > 0.97
    good = [r.keep for r in got if r.truth]
    assert sum(good) / len(good) > 0.99


def test_sites_shift_and_shrink(spark):
    rows = [("bad", "p", -3.0)] * 400 + [("good", "p", 3.0)] * 400 + [("bad", "new", 3.0)] + \
        [(None, None, 3.0)]
    evidence = spark.createDataFrame(rows, "host string, path string, _quality_evidence double")
    sites, top = quality.site_posteriors(evidence, ["host", "path"])
    got = {(r.host, r.path): r._posterior for r in sites.collect()}
    assert 0.45 < top < 0.55 and len(got) == 4
    # One document says little about its path; it leans on the host, and the host on its own many.
    assert got["bad", "p"] < 0.1 and got["good", "p"] > 0.9 and got["bad", "new"] < 0.6
    assert got["bad", "new"] > got["bad", "p"]


def test_repeated_ids_leave_the_fit_alone(spark):
    rows = [(i, ("fine words here " if i % 2 else "X!!! ") * (3 + i % 5)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id bigint, quality int")
    once = quality.fit_model(docs, labels, fit_rows=50)
    again = quality.fit_model(docs.unionByName(docs).unionByName(docs).repartition(7), labels,
                              fit_rows=50)
    assert np.array_equal(once.weights, again.weights) and once.weights.any()


def test_quality_without_usable_labels(spark):
    docs = spark.createDataFrame(
        [(1, "a b c", "h", "en", 1.0), (None, None, None, None, 2.0), (1, "a b c", "h", "en", 1.0)],
        "doc_id bigint, text string, source string, lang string, evidence double")
    none = spark.createDataFrame([(1, None)], "doc_id bigint, quality int")
    got = quality.quality_scores(docs, none).collect()
    assert len(got) == 3 and all(r.keep and r.evidence == 0.5 for r in got)
    one = spark.createDataFrame([(1, 1), (1, 1), (5, 1)], "doc_id bigint, quality int")
    kept = quality.keep_good(docs, one)
    assert kept.columns == docs.columns and kept.count() == 3
    assert quality.quality_scores(docs.limit(0), one).count() == 0
    texts = pa.array(["", None, "A\n" * 100, "x"])
    assert np.isfinite(quality.features(texts)).all()


# --- mixing ---------------------------------------------------------------------------------------

def fill(budget, children):
    """Water filling in small steps of exact fractions: (capacity, weight) per name."""
    from fractions import Fraction

    given, open_ = dict.fromkeys(children, Fraction(0)), {k for k, (_, w) in children.items() if w}
    left = Fraction(budget)
    while open_ and left > 0:
        total = sum(children[k][1] for k in open_)
        full = {k for k in open_ if given[k] + left * children[k][1] / total >= children[k][0]}
        if not full:
            for k in open_:
                given[k] += left * children[k][1] / total
            return given
        for k in full:
            left -= children[k][0] - given[k]
            given[k] = Fraction(children[k][0])
        open_ -= full
    return given


def test_allocation_settles_among_siblings_first(spark):
    leaves = {("web", "en", "a"): 100, ("web", "en", "b"): 1000, ("web", "de", "a"): 500,
              ("books", "en", "c"): 50, ("books", None, "c"): 20, ("code", "en", None): 4000}
    weights = {("web",): 5, ("books",): 4, ("web", "en", "a"): 9, ("web", "de"): 0}
    table = spark.createDataFrame([(*k, v) for k, v in leaves.items()],
                                  "d string, l string, s string, tokens bigint")
    for budget in (0, 7, 300, 2000, 5170, 10**9):
        got = {(r.d, r.l, r.s): r.allocated for r in mixing.allocate(
            table, ["d", "l", "s"], weights, budget, 1).collect()}
        want = {(): budget}
        for depth in (1, 2, 3):
            for parent in list({k[:depth - 1] for k in leaves}):
                nodes = {}
                for k, n in leaves.items():
                    if k[:depth - 1] == parent:
                        nodes[k[:depth]] = (nodes.get(k[:depth], (0,))[0] + n,
                                            weights.get(k[:depth], 1))
                want.update({k: int(v) for k, v in fill(want[parent], nodes).items()})
        assert got == {k: want[k] for k in leaves}


def test_budgets_pass_by_weightless_nodes(spark):
    leaves = {("web", "en", "a"): 100, ("web", "en", "b"): 1000, ("web", "de", "a"): 500,
              ("books", "en", "c"): 50, ("books", None, "c"): 20, ("code", "en", None): 4000,
              ("code", "en", "d"): 900, ("news", "en", "e"): 300}
    weights = {("web",): 5, ("books",): 4, ("web", "en", "a"): 9, ("web", "de"): 0,
               ("code", "en", "d"): 0, ("news", "en"): 0}
    closed = [("web", "de", "a"), ("code", "en", "d"), ("news", "en", "e")]
    able = {k: n for k, n in leaves.items() if k not in closed}
    table = spark.createDataFrame([(*k, v) for k, v in leaves.items()],
                                  "d string, l string, s string, tokens bigint")
    for budget in (0, 7, 300, 2000, 5000, 10**9):
        got = {(r.d, r.l, r.s): r.allocated for r in mixing.allocate_all(
            table, ["d", "l", "s"], weights, budget, 1).collect()}
        want = {(): budget}
        for depth in (1, 2, 3):
            for parent in {k[:depth - 1] for k in able}:
                nodes = {}
                for k, n in able.items():
                    if k[:depth - 1] == parent:
                        nodes[k[:depth]] = (nodes.get(k[:depth], (0,))[0] + n,
                                            weights.get(k[:depth], 1))
                want.update({k: int(v) for k, v in fill(want[parent], nodes).items()})
        assert got == {k: want.get(k, 0) if k in able else 0 for k in leaves}
        most = min(budget, sum(able.values()))
        assert most - len(want) <= sum(got.values()) <= most


def test_mix_deals_the_whole_budget_beside_a_weightless_leaf(spark):
    # The closed leaf holds a third of all words: its parent's share goes to the other domain.
    docs = spark.createDataFrame(
        [(i, *leaf, "w " * 10) for i, leaf in enumerate(
            [("code", "en", "x")] * 300 + [("code", "en", "y")] * 100 + [("web", "en", "z")] * 500)],
        "doc_id bigint, domain string, lang string, source string, text string")
    taken = mixing.mix(docs, ["domain", "lang", "source"], {("code", "en", "x"): 0}, 0.6, 1)
    assert taken.count() == 540


def test_prefixes_are_the_longest_that_fit(spark):
    rng = random.Random(2)
    rows = [(i if i % 50 else None, "en", f"s{min(i % 7, 2)}", "w " * rng.randrange(0, 60))
            for i in range(600)]
    docs = spark.createDataFrame([*rows, rows[1], (9999, None, None, None)],
                                 "doc_id bigint, lang string, source string, text string")
    for share, epochs in ((0.3, 1), (1.4, 2), (5.0, 2)):
        cuts = mixing.leaf_cuts(
            docs.select("doc_id", "lang", "source", mixing.count_words(F.col("text"))
                        .alias("tokens")), ["lang", "source"], {}, share, epochs, 3).collect()
        taken = mixing.mix(docs, ["lang", "source"], {}, share, epochs, 3).collect()
        for c in cuts:
            leaf = [r for r in [*rows, rows[1], (9999, None, None, "")]
                    if (r[1], r[2]) == (c.lang, c.source)]
            places = {}
            for r in leaf:
                key = hashlib.md5(f"3|{c.epochs}|{'null' if r[0] is None else r[0]}".encode())
                places.setdefault(key.hexdigest(), []).append(len(r[3].split()))
            rest, cut = c.allocated - c.epochs * c.tokens, None
            for key in sorted(places):
                rest -= sum(places[key])
                if rest < 0:
                    break
                cut = key
            if c.allocated > c.epochs * c.tokens:
                assert c.cut == cut
            words = sum(len((r.text or "").split()) for r in taken
                        if (r.lang, r.source) == (c.lang, c.source))
            assert words <= c.allocated
        assert max((r.epoch for r in taken), default=0) < epochs
    assert mixing.mix(docs.limit(0), ["lang", "source"], {}).count() == 0


# --- search and fingerprints ----------------------------------------------------------------------

def test_topk_equals_brute_force_with_ties_and_damage(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 10) / 64]) for i in range(400)]
    rows += [(400, None), (420, [0.1, None] * 5), (440, [float("nan")] * 10),
             (460, [float("inf")] * 10), (480, [1.0, 2.0]), (500, [2.0, 1.0]), (None, [0.1] * 10),
             rows[3]]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    valid = {i: [int(np.floor(64 * np.float32(x).astype(float))) for x in v] for i, v in rows
             if i is not None and i not in (400, 420, 440, 460)}
    want = {}
    for q in (i for i in valid if i % 20 == 0):
        scored = [(-int(np.dot(valid[q], v)), i) for i, v in valid.items()
                  if i != q and len(v) == len(valid[q])]
        want[q] = [(i, -s) for s, i in sorted(scored)[:20]]
    for slabs in ((4096, 4096), (50, 7)):
        vectors = segment_search.quantised(table)
        got = segment_search.topk_inner(vectors.where("vec_id % 20 = 0"), vectors, 20, *slabs)
        found = {}
        for r in sorted(got.collect(), key=lambda r: (r.query_id, r.rank)):
            found.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert found == {q: top for q, top in want.items() if top}
    assert segment_search.topk_embeddings(table.limit(0)).count() == 0


def test_bounds_prune_smooth_vectors_and_lose_nothing():
    rng = np.random.default_rng(5)
    smooth = np.floor(np.repeat(rng.normal(size=(3000, 8)), 8, axis=1) * 20)
    stats = [segment_search.segment_statistics(smooth, s) for s in segment_search.SEGMENTS]
    exact = smooth[:40] @ smooth.T
    for level in stats:
        assert (level[:40] @ level.T >= exact - 1e-6).all()
    ids = np.arange(3000)
    rows, cols, score, products = segment_search._block_top(
        smooth[:40], [s[:40] for s in stats], ids[:40], smooth, stats, ids, 20)
    assert products < 0.3 * exact.size
    for q in range(40):
        order = sorted((-int(exact[q, i]), i) for i in range(3000) if i != q)[:20]
        assert sorted((-int(s), int(i)) for s, i in zip(score[rows == q], cols[rows == q])) == order


def test_scores_beyond_doubles_are_exact(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.integers(-(1 << 24), 1 << 24, 6)]) for i in range(60)]
    rows += [(100, [1e15] * 6), (120, [-1e15] * 6)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    whole = {i: [int(np.floor(64 * x)) for x in v] for i, v in rows}
    got = {}
    for r in segment_search.topk_embeddings(table, k=5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    limit = (1 << 63) - 1
    for q in (i for i in whole if i % 20 == 0):
        scored = sorted((-max(-limit - 1, min(limit, sum(a * b for a, b in zip(whole[q], v)))), i)
                        for i, v in whole.items() if i != q)
        assert got[q] == [(i, -s) for s, i in scored[:5]]


def test_op8_edits_and_estimates(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in queries.op8_fingerprints(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(docs)
    errors = []
    for i, d in enumerate(docs):
        after, half, r = docs[(i + 1) % len(docs)].text, len(d.text) // 2, got[d.doc_id]
        edited = d.text[:len(d.text) - half] + after[:half]
        assert r.n_chars == len(d.text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        errors.append((r.near_edited - jaccard(shingle_set(d.text), shingle_set(edited)),
                       r.near_next - jaccard(shingle_set(d.text), shingle_set(after))))
    assert np.abs(errors).max() < 0.2 and np.abs(errors).mean() < 0.02
    by_text = {}
    for d in docs:
        by_text.setdefault(d.text, set()).add(got[d.doc_id].fingerprint)
    assert all(len(prints) == 1 for prints in by_text.values())


@pytest.mark.parametrize("range_rows", [2, 1000])
def test_fingerprints_of_odd_tables(spark, range_rows):
    rows = [(5, "a b c d e f g"), (None, "x y"), (9, None), (2, ""), (2, ""), (7, "漢字é" * 10)]
    docs = spark.createDataFrame([(*r, "z") for r in rows],
                                 "doc_id bigint, text string, bucket string")
    got = fingerprints.fingerprint_edits(docs, range_rows=range_rows).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = []
    for i, (doc, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        want.append((doc or -1, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted((r.doc_id or -1, r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    one = fingerprints.fingerprint_edits(docs.where("doc_id = 5")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert fingerprints.fingerprint_edits(docs.limit(0)).count() == 0


def test_sketches_merge_and_contain(spark):
    words = [f"w{i}" for i in range(3000)]
    a, b = " ".join(words[:2000]), " ".join(words[1000:])
    part = " ".join(words[:1000])
    row = spark.createDataFrame([(a, b, part)], "a string, b string, p string").select(
        *[fingerprints.sketch(F.col(c)).alias(c) for c in "abp"]).select(
        fingerprints.merge_sketches(F.col("a"), F.col("b")).alias("m"), "a", "b", "p").select(
        fingerprints.distinct_shingles(F.col("m")).alias("n"),
        fingerprints.resemblance(F.col("a"), F.col("b")).alias("r"),
        fingerprints.containment(F.col("p"), F.col("a")).alias("c")).first()
    assert abs(row.n - 2996) < 800 and abs(row.r - 1 / 3) < 0.15 and row.c > 0.75


# --- queries and pipeline -------------------------------------------------------------------------

@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    df = queries.QUERIES[name](spark, FOLDER)
    got, columns = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(queries.SQL[name])
    want, wanted = rows_of([c[0] for c in result.description], result.fetchall())
    assert columns == wanted and got == want


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    stages = [docs]
    for _, stage in corpus_pipeline.STAGES:
        stages.append(written(stage(spark, stages[-1], FOLDER)))
    for before, after in zip(stages[:3], stages[1:4]):
        assert after.columns == docs.columns
        assert after.exceptAll(before).count() == 0
    judged = {r.doc_id for r in stages[1].collect()}
    assert sum((d in judged) == bool(q) for d, q in labels.items()) / len(labels) > 0.97
    texts = {r.doc_id: r.text for r in stages[1].collect()}
    assert {r.doc_id for r in stages[2].collect()} == set(classes_of(texts).values())
    packed = stages[4].collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in stages[3].collect()}
    assert sum(r.length for r in packed) == sum(
        {r.doc_id: r.doc_tokens for r in packed}.values())
    ran = corpus_pipeline.run(spark, FOLDER)
    assert sorted(ran.select("doc_id", "start", "length").collect()) == sorted(
        (r.doc_id, r.start, r.length) for r in packed)


def test_mixing_stage_leaves_clashing_columns_alone(spark):
    rows = [(i, f"one two {i}", "en", f"src{i % 3}", "example.org", 7, None) for i in range(30)]
    rows += [rows[0], (None, None, None, None, None, None, 1.5)]
    docs = spark.createDataFrame(
        rows, "doc_id bigint, text string, lang string, source string, domain string, epoch int, "
        "_cut double")
    got = corpus_pipeline.mix(spark, docs, FOLDER)
    assert got.columns == docs.columns and written(got).count() > 10
    assert got.exceptAll(docs).count() == 0
    assert corpus_pipeline.mix(spark, docs.limit(0), FOLDER).count() == 0
