"""The training-data operators: brute force, round trips and held-out accuracy on small tables."""

import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factloom.llm import license_scan, lm_scoring, mixing, mtree, near_dedup, packing, parts, quality, quality_rules, sharding, subwords, supervised, toxicity
from factloom.llm.kernel import mix
from factloom.llm.supervised import fold

DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, label string, score string, id string"


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def edge_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows; the extra columns clash with inner names."""
    rnd = random.Random(4)
    vocab = [f"w{i}" for i in range(300)]
    base = [" ".join(rnd.choice(vocab) for _ in range(80)) for _ in range(12)]
    rows = [(i, t, "en", f"src{i % 3}", len(t), "x", None, "y", "z") for i, t in enumerate(base)]
    rows += [(20 + i, t + " tail", "en", None, 1, None, None, None, None) for i, t in enumerate(base[:4])]
    rows += [rows[0], rows[0], (30, base[1], None, "src1", None, "1", "1", "1", "1")]
    rows += [(40, None, None, None, None, None, None, None, None), (41, "", "en", "src0", 0, "", "", "", ""), (42, " \n ", "xx", "src0", 0, "", "", "", "")]
    rows += [(None, base[2], "en", "src2", 5, "q", "q", "q", "q"), (None, None, None, None, None, None, None, None, None)]
    rows += [(50, "one", "en", "src0", 3, "", "", "", ""), (51, "One", "en", "src0", 3, "", "", "", "")]
    rows += [(60, "all rights reserved. " + " ".join(rnd.choice(vocab) for _ in range(300_000)), "en", "src0", 9, "", "", "", "")]
    return rows


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (1, 1, 0), (2, 0, 1), (3, 0, None), (3, 1, 1), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")


# --- near duplicates --------------------------------------------------------


def components_brute(rows, words):
    sets, ids = [], []
    for r in rows:
        w = WORD.findall(low(r[1]))
        sets.append(frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else []))
        ids.append(r[0])
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    low_id = {}
    for i, x in enumerate(label):
        if ids[i] is not None:
            low_id[x] = min(low_id.get(x, ids[i]), ids[i])
    return sorted(((ids[i], len(sets[i]), low_id.get(label[i]) if sets[i] else ids[i]) for i in range(len(rows))), key=repr)


@pytest.mark.parametrize("words, block", [(2, 1024), (5, 1 << 21)])
def test_near_duplicates_match_brute_force(spark, words, block):
    rnd = random.Random(words)
    vocab = [f"v{i}" for i in range(500)]
    rows = edge_rows()
    seed = [rnd.choice(vocab) for _ in range(120)]
    for i in range(60):  # a chain of copies around the threshold
        w = list(seed)
        for _ in range(rnd.randrange(12)):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        rows.append((100 + i, " ".join(w), "en", "s", 1, "", "", "", ""))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA), shingle_words=words, block=block).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == components_brute(rows, words)
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in got)


def test_near_duplicates_equal_exact_join(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    want = con.sql(near_dedup.ORACLE).fetchall()
    got = near_dedup.op6_minmax_near_dedup(spark, DIR).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def block_rows(rnd, groups, size, apart):
    """Sets of ``groups`` seeds with ``size`` copies each that differ in ``apart`` of 200 items."""
    out = []
    for _ in range(groups):
        seed = [rnd.getrandbits(62) for _ in range(200)]
        out += [sorted([rnd.getrandbits(62) for _ in range(apart)] + rnd.sample(seed, 200 - apart)) for _ in range(size)]
    return out


def test_blocks_emit_a_forest_of_all_links():
    """A hot bucket of rows, none linked so far: as many links as join it, not as many as it has pairs."""
    import pyarrow as pa

    rnd = random.Random(2)
    sets = block_rows(rnd, 3, 200, 16)
    n = len(sets)
    batch = pa.RecordBatch.from_arrays([pa.array([7] * n), pa.array([0] * n), pa.array([0] * n), pa.array([0] * n), pa.array(range(n)), pa.array(range(n)), pa.array(sets, pa.list_(pa.int64()))], ["band", "i", "j", "side", "cid", "label", "items"])
    out = [x for b in near_dedup._block_links(80, 100)([batch.slice(0, 250), batch.slice(250)]) for x in zip(*b.to_pydict().values())]
    label, brute = list(range(n)), list(range(n))
    for a, b in out:
        label = [label[a] if x == label[b] else x for x in label]
    as_set = [set(s) for s in sets]
    for i in range(n):
        for j in range(i):
            both = len(as_set[i] & as_set[j])
            if brute[i] != brute[j] and 100 * both >= 80 * (400 - both):
                brute = [brute[j] if x == brute[i] else x for x in brute]
    first = lambda x: [x.index(k) for k in x]
    assert first(label) == first(brute) and len(out) == n - len(set(brute))


@pytest.mark.parametrize("giant", [0, 90])
def test_large_buckets_are_dealt_whole(spark, giant):
    """Every pair of labels in a bucket meets in a block: split around one large component, or in a grid."""
    rows = [(5, k, 1 if k < giant else 100 + k, 10) for k in range(100)]
    dealt, rest = near_dedup._dealt(spark.createDataFrame(rows, "band long, cid long, label long, n long"), 1024, True)
    assert rest.isEmpty()
    blocks = {}
    for r in dealt.collect():
        blocks.setdefault((r.i, r.j), []).append(r)
    met = {frozenset((a.cid, b.cid)) for (i, j), x in blocks.items() for a in x for b in x if a.label != b.label and (i == j or a.side != b.side)}
    label = {r[1]: r[2] for r in rows}
    assert met == {frozenset((a, b)) for a in label for b in label if label[a] != label[b]}
    assert max(map(len, blocks.values())) <= 60
    if giant:
        assert sum(map(len, blocks.values())) <= 90 + 10 * 8


def test_second_bands_miss_few_pairs():
    """Of pairs at 0.8 that share a band, the further groups of four values catch all in 20,000 draws."""
    draw = np.random.default_rng(1)
    same = draw.random((20_000, 96)) < 0.8
    same[:, :4] = True
    caught = np.zeros(len(same), bool)
    for g in range(24):
        caught |= (g != 0) & same[:, 4 * g : 4 * g + 4].all(1)
        caught |= same[:, g::24].all(1)
    assert caught.all()


def test_large_group_of_near_copies_is_linear(spark):
    """5,000 copies of one text, each with its own words: every table, links included, has at most a row for each of a copy's 24 bands."""
    rnd = random.Random(8)
    seed = [f"v{rnd.randrange(4000)}" for _ in range(150)]
    rows = []
    for i in range(5000):
        w = list(seed)
        for _ in range(rnd.randrange(1, 12)):
            w[rnd.randrange(150)] = f"own{i}x{rnd.randrange(9)}"
        rows.append((i, " ".join(w)))
    seen = {}
    old = near_dedup.materialize

    def counted(df, name="t"):
        out = old(df, name)
        seen.setdefault(name, []).append(out.count())
        return out

    near_dedup.materialize = counted
    try:
        got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=1 << 19).collect()
    finally:
        near_dedup.materialize = old
    assert max(max(v) for v in seen.values()) <= 24 * 5000
    sets = [{tuple(w[k : k + 5]) for k in range(146)} for w in (t.split() for _, t in rows)]
    by = {r.doc_id: r.component_id for r in got}
    for i, j in [(rnd.randrange(5000), rnd.randrange(5000)) for _ in range(4000)]:
        both = len(sets[i] & sets[j])
        if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
            assert by[i] == by[j]


def test_near_duplicates_of_nothing(empty):
    assert near_dedup.near_duplicates(empty).count() == 0


def test_minmax_signature_estimates_similarity():
    a, b = near_dedup._permutations(256)
    x = mix(np.arange(1000, dtype=np.uint64))  # shingle hashes are mixed like this
    est = (near_dedup.signature(x[:900], a, b) == near_dedup.signature(x[100:], a, b)).mean()
    assert abs(est - 0.8) < 0.08


# --- classifiers ------------------------------------------------------------


def auc(y, p):
    r = pd.Series(p).rank().values
    n = y.sum()
    return (r[y == 1].sum() - n * (n + 1) / 2) / n / (len(y) - n)


def test_quality_held_out(spark):
    r = quality.op3_rff_quality(spark, "/root/testdata/sf0.01").toPandas().merge(pd.read_parquet("/root/testdata/sf0.01/labels.parquet"), on="doc_id")
    held = r[r.held_out]
    assert set(held.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5)) == {0}
    assert auc(held.quality.values, held.score.values) > 0.95
    assert ((r.score >= 0.3).astype(int) == r.predicted).all() and r.score.between(0, 1).all()


def test_quality_equals_a_direct_ridge(spark):
    """Partition sums and their solution against plain numpy on the same statistics and features."""
    import pyarrow as pa

    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.fit_quality(docs, labels, fold("id", 5) != 0)
    rows = supervised.labelled(docs, labels, "quality", "doc_id", "text", fold("id", 5) != 0).withColumn("held", F.pmod(F.xxhash64("id"), F.lit(4)) == 0).toPandas()
    s = np.concatenate([x for _, x in quality.statistics(pa.array(rows.text))])
    assert np.allclose(model.mean, s.mean(0)) and np.allclose(model.sd, np.maximum(s.std(0), 1e-3))
    z = np.clip((s - s.mean(0)) / model.sd, -6, 6)
    kernel = np.exp(-((z[:40, None] - z[None, :40]) ** 2).sum(2) / 2 / len(model.w))
    wide = quality.QualityModel(20_000)
    assert np.abs(kernel - (m := wide.map(z[:40]))[:, :-1] @ m[:, :-1].T).max() < 0.05  # the map stands for a Gaussian kernel
    m, y = np.hstack([np.cos(z @ model.w + model.b) * np.sqrt(2 / 256), np.ones((len(z), 1))]), rows.y.values
    v = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    fit = ~rows.held.values
    a = m[fit].T @ (m[fit] * v[fit, None])
    beta = np.linalg.solve(a + 1e-3 * np.trace(a) / 257 * np.eye(257), m[fit].T @ (v[fit] * y[fit]))
    assert np.allclose(m @ model.beta, m @ beta, atol=1e-6)
    raw = m[~fit] @ beta
    best = min((((np.where(raw >= t, hi, lo) - y[~fit]) ** 2).sum() for t in np.quantile(raw, np.linspace(0, 1, 30)) for lo, hi in ((0.1, 0.9), (0.2, 0.8), (0, 1))), default=0)
    assert ((model.score(s[~fit]) - y[~fit]) ** 2).sum() <= best + 1  # no worse than steps, which are isotonic too


@pytest.mark.parametrize("name", sorted(parts.queries()))
def test_parts_equal_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    want = con.sql(parts.oracle_sql()[name])
    got = parts.queries()[name](spark, DIR).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def test_toxicity_held_out(spark):
    r = toxicity.op7_levenshtein_toxicity(spark, "/root/testdata/sf0.01").toPandas().merge(pd.read_parquet("/root/testdata/sf0.01/labels.parquet"), on="doc_id")
    held = r[r.held_out]
    assert set(held.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4)) == {2}
    assert auc(held.toxic.values, held.score.values) > 0.7
    assert ((r.score >= 0.3).astype(int) == r.predicted).all() and r.score.between(0, 1).all()


def test_classifiers_on_edge_rows(edge, empty, labels):
    for fit, score in ((quality.fit_quality, quality.score_quality), (toxicity.fit_toxicity, toxicity.score_toxicity)):
        model = fit(edge, labels, F.lit(True))
        out = score(edge, model, names=("s1", "p1"))
        assert out.columns == [*edge.columns, "s1", "p1"]
        rows = out.collect()
        assert len(rows) == len(edge_rows()) and all(0 <= r.s1 <= 1 and r.p1 == (r.s1 >= 0.3) for r in rows)
        assert score(empty, fit(empty, labels.limit(0), F.lit(True))).count() == 0


def test_isotonic_is_monotone():
    x, y = quality.isotonic(np.array([1.0, 2, 3, 4, 4, 5]), np.array([0.0, 1, 0, 1, 0, 1]))
    assert (np.diff(y) >= 0).all() and (np.diff(x) > 0).all()


def distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        d, p = [i], d
        for j, y in enumerate(b, 1):
            d.append(min(p[j] + 1, d[-1] + 1, p[j - 1] + (x != y)))
    return d[-1]


def test_automaton_is_levenshtein():
    terms = [("idiot", False), ("worthless", False), ("scum", False), ("lowei", True)]
    own, rnd = toxicity.Automaton(terms), random.Random(2)
    for _ in range(4000):
        w = list(rnd.choice(terms)[0])
        for _ in range(rnd.randrange(4)):
            k = rnd.randrange(len(w) + 1)
            w[k : k + rnd.randrange(2)] = rnd.choice(["", "a", "x", "s"])
        w = "".join(w)
        best = [distance(w, t) for t, stem in terms if not stem and distance(w, t) <= toxicity.edits(t, stem)]
        want = 0 if w.startswith("lowei") else min(best, default=-1)
        assert own.match(w) == want, w


def test_quotation_is_not_abuse():
    model = toxicity.ToxicityModel([(t, False) for t in toxicity.INSULTS])
    assert model.features("you are a moron and an idi0t") [0] == 1
    assert model.features('he wrote "moron" in the margin') == (0, 1, 0, 0)
    assert model.features("you worthles clwn")[2] == 2


def test_misspelled_and_split_words_are_hits(spark):
    model = toxicity.ToxicityModel([(t, False) for t in toxicity.INSULTS])
    assert model.features("skum") == (0, 0, 1, 0) and model.features("scum") == (1, 0, 0, 0)
    assert all(model.features(w) == (0, 0, 1, 0) for w in ("id1ot", "m0ron", "st_upid"))
    assert model.features("you_stupid_idiot 7") == (2, 0, 0, 0)  # parts of a word that is no hit itself


def test_whole_words_stay_beside_stems(spark):
    rows = [(i, f"filler{i % 7} glorbnak" + ("s" if i % 2 else ""), 1) for i in range(40)] + [(100 + i, f"filler{i % 7} other", 0) for i in range(400)]
    terms = toxicity.learn_terms(spark.createDataFrame(rows, "id long, text string, y int"))
    assert ("glor", True) in terms and ("glorbnak", False) in terms
    assert toxicity.ToxicityModel(terms).features("gl0rbnak gxorbnak") [2] == 2


def test_long_texts_count_hits_as_a_whole(monkeypatch):
    """Pieces cut no word and no window: the same counts as in one piece, at every size of a piece."""
    rnd = random.Random(5)
    vocab = ["idiot", "st0opid", "moron", "kind", "river", "said", '"', "\u201cyes\u201d", "\u00fcber", "a" * 70]
    texts = [" ".join(rnd.choice(vocab) for _ in range(rnd.randrange(300))) for _ in range(40)]
    model = toxicity.ToxicityModel([("idiot", False), ("moron", False), ("stupid", False)])
    want = [model.features(t) for t in texts]
    assert sum(map(sum, want)) > 100
    for size in (1, 16, 50, 200):
        monkeypatch.setattr(supervised, "PIECE", size)
        assert [model.features(t) for t in texts] == want


def test_term_choice_has_no_cap(spark, monkeypatch):
    """The same terms, whether candidates are looked at all at once or a few a round."""
    rnd = random.Random(11)
    bad = [f"bad{chr(97 + i)}{chr(97 + j)}word" for i in range(6) for j in range(6)]
    rows = [(i, " ".join([rnd.choice(bad), *(f"word{rnd.randrange(90)}" for _ in range(10))]), 1) for i in range(300)]
    rows += [(1000 + i, " ".join(f"word{rnd.randrange(90)}" for _ in range(10)), 0) for i in range(300)]
    sample = spark.createDataFrame(rows, "id long, text string, y int").cache()
    whole = toxicity.learn_terms(sample)
    monkeypatch.setattr(toxicity, "ROUND", 3)
    few = toxicity.learn_terms(sample)
    texts = [r[1] for r in rows]
    hit = [[toxicity.ToxicityModel(t).features(x) for x in texts] for t in (whole, few)]
    assert [sum(f) > 0 for f in hit[0]] == [sum(f) > 0 for f in hit[1]] and sum(sum(f) > 0 for f in hit[0][:300]) > 290


@pytest.mark.parametrize("n", [199, 201])
def test_one_rule_for_terms_at_every_size(spark, n):
    # one document in two is toxic: 'chance' words of two toxic documents prove nothing, a word of 30 does
    rows = [(i, f"{chr(97 + i // 2 % 26)}{chr(97 + i // 52)}qzchance" + (" realterm" if i < 30 else ""), 1) for i in range(n)] + [(1000 + i, "plain", 0) for i in range(n)]
    terms = {t for t, _ in toxicity.learn_terms(spark.createDataFrame(rows, "id long, text string, y int"))}
    assert "realterm" in terms and all("realterm".startswith(t) for t in terms)


def test_rare_significant_terms_are_learned_from_many_labels(spark):
    # 250 toxic rows; a word of four of them, and of none of 20,000 others
    rows = [(i, "commonterm" + (" quixterm" if i < 4 else ""), 1) for i in range(250)] + [(1000 + i, "plain", 0) for i in range(20_000)]
    terms = toxicity.learn_terms(spark.createDataFrame(rows, "id long, text string, y int").withColumn("text", F.when(F.col("id") < 4, "quixterm").otherwise(F.col("text"))))
    assert any(t == "quixterm" or stem and "quixterm".startswith(t) for t, stem in terms)


# --- packing ----------------------------------------------------------------


def test_packing_round_trip(spark, edge):
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    special = (70, "abc <|endoftext|> def<|endoftext|>", None, None, None, None, None, None, None)
    rows = packing.pack_documents(edge.union(spark.createDataFrame([special], SCHEMA)).repartition(2)).toPandas()
    want = Counter()
    for r in [*edge_rows(), special]:
        ids = [*own.encode(r[1] or "", add_special_tokens=False).ids, 0]
        want[(r[0], len(ids))] += len(ids)
    got = Counter()
    for r in rows.itertuples():
        got[(None if pd.isna(r.doc_id) else int(r.doc_id), r.doc_tokens)] += r.length
    assert got == want
    for _, g in rows.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g.offset.values == np.r_[0, g.length.cumsum().values[:-1]]).all() and g.length.sum() <= 1024
    full = rows.groupby("sequence_id").length.sum()
    assert ((full & (full - 1)) == 0).all()  # no padding at all
    one = rows[rows.doc_id == 60].sort_values("start")
    ids = np.array([*own.encode(edge_rows()[-1][1], add_special_tokens=False).ids, 0], "<u4")
    for r in one.itertuples():
        assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    texts = {}
    for r in [*edge_rows(), special]:
        texts.setdefault(r[0], []).append(np.array([*own.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4"))
    for r in rows.itertuples():
        of = texts[None if pd.isna(r.doc_id) else int(r.doc_id)]
        assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in of)


def test_packing_of_nothing(empty):
    assert packing.pack_documents(empty).count() == 0


def test_subwords_equal_the_tokenizer(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    own, rnd = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), random.Random(1)
    texts = ["".join(rnd.choice(["a", "Bc", "é", " ", "  ", "\n", "\t", "1", "'s", "!", "\xa0", "日", "  \n", "<|endoftext|>"]) for _ in range(rnd.randrange(16))) for _ in range(3000)]
    want = [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]
    path, added = subwords.default_ranks(), subwords.default_added()
    for piece in (1 << 20, 4):
        monkeypatch.setattr(subwords, "PIECE", piece)
        assert [subwords.encode_with_added(t, path, added).tolist() for t in texts] == want


# --- mixing -----------------------------------------------------------------


def targets_brute(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = float(most * sizes[s])
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


def test_mixing_targets_and_bounds(spark, edge, empty):
    got = mixing.mix_sources(edge)
    rows = got.join(edge.select("doc_id", "source").distinct(), got.doc_id.eqNullSafe(edge.doc_id)).collect()
    sizes = Counter()
    for r in edge_rows():
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    want = targets_brute(sizes)
    assert got.count() == len(edge_rows())
    for r in rows:
        if r.doc_id is not None:
            assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source]
            assert r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
    assert sorted(map(tuple, mixing.mix_sources(edge).collect()), key=repr) == sorted(map(tuple, got.collect()), key=repr)
    assert mixing.mix_sources(empty).count() == 0


def test_mixing_comes_near_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for block in (mixing.BLOCK, 16):  # blocks of 16 fly in several levels, with little to balance by
        r = mixing.mix_sources(docs, block=block).join(docs.select("doc_id", "source"), "doc_id").toPandas()
        g = r.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"), longest=("size", "max"))
        off = (g.taken - g.target).abs()
        assert len(r) == 1000 and (off <= g.longest).all()  # only the last document of a source lands off its words
        assert block < 100 or (off <= 0.02 * g.target).all()


def test_flight_keeps_both_totals():
    rnd = random.Random(5)
    x = [float(rnd.randrange(1, 900)) for _ in range(400)]
    p = mixing.flight([0.37] * 400, x, rnd, False)
    open_ = [i for i in range(400) if 0 < p[i] < 1]
    assert len(open_) <= 2 and abs(sum(p) - 148) < 1e-6 and abs(sum(a * b for a, b in zip(p, x)) - 0.37 * sum(x)) < 1e-4


# --- native operators -------------------------------------------------------


def plan(df):
    return df._jdf.queryExecution().toString()


def rules_brute(text):
    w = WORD.findall(text or "")
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen, cover = Counter(grams), set()
    for i, g in enumerate(grams):
        if seen[g] > 1:
            cover |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover)


def test_quality_rules_base(spark, edge, empty):
    extra = [(90, "a b c a b c\n\nx # | y\nx # | y\n \n", "en", "s", 0, "", "", "", ""), (91, "a a a a", "fr", "s", 0, "", "", "", ""), (92, "日本 é x * " * 40, "de", "s", 0, "", "", "", "")]
    rows = [*edge_rows(), *extra]
    got = quality_rules.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()
    key = lambda x: repr(x)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=key) == sorted(((r[0], *rules_brute(r[1])) for r in rows), key=key)
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed) for r in got)
    assert quality_rules.quality_rules(empty).count() == 0


def test_quality_rules_keep_clean_and_stay_native(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), pd.read_parquet("/root/testdata/sf0.01/labels.parquet")
    out = quality_rules.quality_rules(docs)
    assert not re.search("Python|Pandas|Arrow", plan(out)) and not re.search("Python|Pandas|Arrow", plan(quality_rules.measures(docs)))
    r = out.toPandas().merge(labels, on="doc_id")
    clean = r[(r.quality == 1) & ~r.base_failed]
    assert clean.kept.all() and not r[(r.quality == 0) & ~r.base_failed].kept.all()


def test_js_distance_is_right(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = quality_rules.measures(docs)
    ref = quality_rules.references(rows)
    r = rows.where("n_words > 60").withColumn("d", quality_rules.word_distance(ref["en"][1])).first()
    q = {**ref["en"][1]}
    q["#"] = 1 - sum(q.values())
    p = {x.w: x.n / r.n_words for x in r.common if x.w in q}
    p["#"] = 1 - sum(p.values())
    js = sum((p.get(k, 0) * np.log2(2 * p.get(k, 0) / (p.get(k, 0) + v)) if p.get(k, 0) else 0) + (v * np.log2(2 * v / (p.get(k, 0) + v)) if v else 0) for k, v in q.items()) / 2
    assert abs(r.d - js**0.5) < 1e-9


def test_license_scan_equals_sql(spark, edge, empty):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    out = license_scan.op4_minhash_license_scan(spark, DIR)
    assert not re.search("Python|Pandas|Arrow", plan(out))
    columns = sorted(out.columns)
    want = c.execute(f"SELECT {', '.join(columns)} FROM ({license_scan.oracle()})").fetchall()
    assert sorted(tuple(r) for r in out.select(*columns).collect()) == sorted(want)
    found = license_scan.license_matches(edge).collect()
    assert [(r.doc_id, r.template, r.first_window) for r in found] == [(60, "all-rights-reserved", 0)]
    assert license_scan.license_matches(empty).count() == 0


def test_license_bands_guarantee():
    for m in (2, 5, 20, 40):
        w = license_scan.scale(m)
        b = license_scan.band_count(m, w, 0.8, 1e-6)
        assert 2 * m <= w and (1 - 0.8 * m / (w + m)) ** b <= 1e-6


# --- sharding and search ----------------------------------------------------


def test_sharding_equals_sql_and_fits(spark):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    got = sharding.shards(spark.read.parquet(f"{DIR}/documents.parquet"), limit=40_000)
    columns = sorted(got.columns)
    want = c.execute(f"SELECT {', '.join(columns)} FROM ({sharding.oracle(40_000)})").fetchall()
    assert sorted(tuple(r) for r in got.select(*columns).collect()) == sorted(want)
    assert got.agg(F.max("shard_bytes")).first()[0] <= 40_000


def test_sharding_of_edge_rows(edge, empty):
    rows = sharding.shards(edge, limit=600, step=30).collect()
    assert len(rows) == len(edge_rows())
    total = Counter()
    for r in rows:
        total[(r.shard, r.overflow)] += r.bytes
    for r in rows:
        assert total[(r.shard, r.overflow)] == r.shard_bytes and (r.shard_bytes <= 600 or r.shard_bytes == r.bytes)
    assert sharding.shards(empty).count() == 0


def test_sharding_of_one_hot_key(spark, tmp_path):
    """5,000 rows of one id: their chain fits the limit and wastes at most half; documents come back whole."""
    rnd = random.Random(3)
    rows = [(7, "x" * rnd.randrange(40)) for _ in range(5000)] + [(7, "y" * 900), (7, "z" * 400), (8, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = sharding.shards(docs, limit=600).collect()
    total = Counter()
    for r in got:
        total[(r.shard, r.overflow)] += r.bytes
    assert len(got) == len(rows) and all(total[(r.shard, r.overflow)] == r.shard_bytes for r in got)
    assert all(n <= 600 or n == 900 for n in total.values()) and len(total) <= 2 + sum(map(len, (t for _, t in rows))) / 300 + 2
    alone = spark.createDataFrame([(i, f"text {i}" * 20) for i in range(60)], "doc_id long, text string")
    sharding.write_shards(alone, sharding.shards(alone, limit=900), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, back.select("doc_id", "text").collect())) == sorted(map(tuple, alone.collect()))
    assert back.select("shard", "overflow").distinct().count() > 4


def top_brute(rows, k):
    v = {}
    vecs = [(i, np.floor(64 * np.array(x, float)).astype(int)) for i, x in rows if i is not None and x and None not in x and np.isfinite(np.array(x, float)).all()]
    out = []
    for q in sorted({i for i, _ in vecs if i % 20 == 0}):
        qv = next(x for i, x in vecs if i == q)
        found = sorted((-int(x[: len(qv)] @ qv[: len(x)]), i) for i, x in vecs if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


def test_top_k_matches_brute_force(spark):
    rnd = np.random.default_rng(0)
    centers = rnd.normal(size=(5, 8))
    rows = [(i, [float(y) for y in (centers[i % 5] + 0.2 * rnd.normal(size=8)) * rnd.uniform(0.5, 2)]) for i in range(700)]
    rows += [(1000 + i, rows[3][1]) for i in range(40)]  # copies, and ties between them
    rows += [(2000, None), (2001, []), (2002, [1.0, None] + [0.0] * 6), (2003, [float("nan")] * 8), (None, [1.0] * 8), (2020, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit("clash")).withColumn("cell", F.lit(1))
    assert sorted(tuple(r) for r in mtree.top_k(df, k=5).collect()) == top_brute(rows, 5)
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in mtree.top_k(few, k=5).collect()) == top_brute(rows[:3], 5)
    assert mtree.top_k(df.limit(0)).count() == 0


def test_tree_skips_distances():
    rnd = np.random.default_rng(1)
    v = np.floor(64 * (np.repeat(rnd.normal(size=(40, 16)), 100, 0) + 0.02 * rnd.normal(size=(4000, 16))))
    top = float((v * v).sum(1).max())
    x = np.hstack([v, np.sqrt(top - (v * v).sum(1))[:, None]])
    tree = mtree.Tree(x, v, [[i] for i in range(len(v))])
    found = tree.search(v[7:8], [7], 10, top, np.array([-np.inf]))[0]
    assert found == sorted((-int(v[i] @ v[7]), i) for i in range(len(v)) if i != 7)[:10]
    assert tree.computed < len(v) / 2


# --- language model ---------------------------------------------------------


def test_attention_gradients_and_probabilities():
    from factloom.llm.attention import IDS, AttentionModel, windows

    rnd = np.random.default_rng(0)
    m = AttentionModel(rnd.random(IDS) * 100)
    for k in m.p:
        m.p[k] = m.p[k].astype(np.float64)
    keys, targets, text = windows(rnd.integers(1, IDS, 100), np.array([70, 0, 30]))
    assert (targets >= 0).sum() == 100 and text.tolist() == [0, 0, 0, 2]
    loss, g = m.gradients(keys, targets)
    assert abs(loss + m.log_probs(keys, targets, m.tables()).sum() / 100) < 1e-4
    for k in g:
        w = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        old, e = m.p[k][w], 1e-5
        m.p[k][w] = old + e
        up = m.gradients(keys, targets)[0]
        m.p[k][w] = old - e
        down = m.gradients(keys, targets)[0]
        m.p[k][w] = old
        assert abs((up - down) / 2 / e - g[k][w]) < 1e-4
    one = np.repeat(keys[:1], 50, 0)
    total = sum(np.exp(m.log_probs(np.repeat(keys[:1], len(b), 0), np.where(np.arange(32) == 3, b[:, None], -1), m.tables())[:, 3]).sum() for b in np.array_split(np.arange(IDS), 20))
    assert len(one) and abs(total - 1) < 1e-3


def test_lm_base_and_edge_rows(spark, edge, empty):
    rows = edge_rows()
    got = lm_scoring.score_texts(edge, fold("doc_id", 5) == 1, steps=5, batch=8).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    tokens = [[*WORD.findall(low(r[1])), "\0end"] for r in rows]
    c = Counter(w for r, t in zip(rows, tokens) if not held(r[0]) for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted(((r[0], held(r[0]), len(t), sum(w in c for w in t), n, round(sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 6)) for r, t in zip(rows, tokens)), key=repr)
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=repr) == want
    assert all(r.score < 0 for r in got)
    assert lm_scoring.score_texts(empty, fold("doc_id", 5) == 1, steps=1).count() == 0


def test_long_text_scores_as_short():
    from factloom.llm.attention import AttentionModel

    rnd = np.random.default_rng(3)
    m = AttentionModel(np.ones(2304))
    ids = rnd.integers(1, 2304, 140_000)
    whole = lm_scoring._score_texts(m, m.tables(), [ids])[0]
    keys, targets, _ = lm_scoring.windows(ids, np.array([len(ids)]))
    plain = sum(m.log_probs(keys[i : i + 256], targets[i : i + 256], m.tables()).sum(dtype=float) for i in range(0, len(keys), 256)) / np.log(10)
    assert abs(whole - plain) < 1e-3 * abs(plain)


def test_repeated_texts_are_scored_once(monkeypatch):
    from factloom.llm.attention import AttentionModel

    rnd = np.random.default_rng(5)
    m = AttentionModel(np.ones(2304))
    texts = [rnd.integers(1, 2304, n) for n in (40, 3, 90)]
    want = lm_scoring._score_texts(m, m.tables(), texts)
    scored, plain = [], lm_scoring._score_texts
    monkeypatch.setattr(lm_scoring, "_score_texts", lambda *a, **k: scored.append(len(a[2])) or plain(*a, **k))
    seen = {}
    got = [lm_scoring._score_once(m, m.tables(), [texts[i] for i in pick], None, seen) for pick in ((0, 1, 0, 0), (2, 1, 2))]
    assert np.allclose(np.concatenate(got), want[[0, 1, 0, 0, 2, 1, 2]], rtol=1e-5) and scored == [2, 1]


def test_lm_score_learns_from_all_training_texts(spark):
    rnd, words = random.Random(7), ["apple", "river", "stone", "cloud"]
    ordered = [" ".join(words * 20) for _ in range(300)]
    shuffled = [" ".join(rnd.sample(words * 20, 80)) for _ in range(300)]  # the same words, so the same id counts
    found = []
    for texts in (ordered, shuffled):
        rows = spark.createDataFrame([(0, " ".join(words * 20)), *((i + 1, t) for i, t in enumerate(texts))], "doc_id long, text string")
        got = lm_scoring.score_texts(rows, F.col("doc_id") == 0, attention_windows=1, steps=1, batch=1).where("doc_id = 0").first()
        found.append(got.score)
    assert found[0] > found[1] + 10


def test_attention_learns_from_all_training_windows(spark):
    """What follows "stone" depends on the word before it, which pair counts do not tell; no window is drawn for the start."""
    rnd, whole, swapped = random.Random(8), ["apple stone cloud", "river stone light"], ["apple stone light", "river stone cloud"]
    train = [" ".join(rnd.choice(whole) for _ in range(40)) for _ in range(400)]
    rows = spark.createDataFrame([(0, " ".join(whole * 20)), (-1, " ".join(swapped * 20)), *((i + 1, t) for i, t in enumerate(train))], "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm_scoring.score_texts(rows, F.col("doc_id") <= 0, attention_windows=1, steps=1, batch=1).where("doc_id <= 0").collect()}
    assert got[0] > got[-1] + 10


def test_every_window_is_learned_from_once():
    """Windows in ranges, of texts longer and shorter than one, are those of all texts at once."""
    import pyarrow as pa

    rnd, path = np.random.default_rng(4), subwords.default_ranks()
    vocabulary = lm_scoring.Vocabulary({int(i): 9 for i in range(300, 1500)}, path)
    texts = [rnd.integers(300, 1500, n).astype("<u2").tobytes() for n in (5, 0, 700, 33, 64, 1, 400, 20)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.binary())], ["ids"])
    want = lm_scoring.windows(*lm_scoring._model_ids(batch.column(0), vocabulary), None)
    drawn = lm_scoring.windows(*lm_scoring._model_ids(batch.column(0), vocabulary), lm_scoring._drawn(batch.column(0), 0.4))
    for most in (3, 1 << 14):
        parts = list(lm_scoring.all_windows([batch], vocabulary, 0.4, most))
        keys, targets, own = (np.concatenate(x) for x in zip(*parts))
        assert (keys == want[0]).all() and (targets == want[1]).all() and max(len(x[0]) for x in parts) <= most
        assert (keys[own] == drawn[0]).all() and (targets[own] == drawn[1]).all() and 0 < own.sum() < len(own)


def test_mixture_weights_follow_the_likelier_side():
    """Weights from steps of the ratio equal those by EM over the targets one by one."""
    from factloom.llm.attention import CONTEXT, IDS

    rnd = np.random.default_rng(2)
    keys, targets, _ = lm_scoring.windows(rnd.integers(1, 9, 4000), np.array([4000]))
    before = keys[:, CONTEXT:].ravel()
    pairs, counts = np.unique(before * IDS + targets.ravel(), return_counts=True)
    frequencies = np.bincount(targets.ravel(), minlength=IDS)
    own = np.log(rnd.uniform(0.02, 0.4, targets.shape))
    m = lm_scoring.PairMixture(pairs, counts, frequencies)
    m.fit(m.seen(keys, targets, own))
    n, size, w = m.table[before, targets.ravel()] - 1, m.size[before], np.full(m.SIZES, 0.5)
    pair = (n + m.SMOOTH * m.base[targets.ravel()]) / (m.before[before] - 1 + m.SMOOTH)
    for _ in range(20):
        taken = w[size] * pair / (w[size] * pair + (1 - w[size]) * np.exp(own.ravel()))
        w = (np.bincount(size, taken, m.SIZES) + 0.5) / (np.bincount(size, minlength=m.SIZES) + 1)
    assert np.abs(m.weight - w).max() < 0.01


def test_words_are_encoded_once_and_alike():
    """Ids by the words' table, cleared on the way, equal those of each word on its own; white space beyond ASCII too."""
    import pyarrow as pa
    from factloom.llm.kernel import text_words

    rnd = random.Random(6)
    path = subwords.default_ranks()
    parts = ["Das", "isn't", "x\u00a0", "\u00a0y", "\u2003", "na\u00efve", "42nd", "...", "\u4e2d\u6587", "supercalifragilistic"]
    texts = [None, "", " \n"] + [" ".join(rnd.choice(parts) + str(rnd.randrange(40)) * rnd.randrange(2) for _ in range(rnd.randrange(60))) for _ in range(80)]
    table = lm_scoring.WordIds(path, most=30)
    vocabulary = lm_scoring.Vocabulary({int(i): 9 for i in range(300, 1500)}, path)
    for _ in range(3):
        for row, sizes, raw, starts, lengths, hashes in text_words(pa.array(texts)):
            bpe, per = table.ids(raw, starts, lengths, *lm_scoring.distinct(hashes))
            want = [subwords.encode(" " + w, path) for t in texts[row : row + len(sizes)] for w in WORD.findall(low(t))]
            assert bpe.tolist() == np.concatenate(want).tolist() and per.tolist() == [len(x) for x in want]
            ids, size = vocabulary.ids(bpe, np.r_[0, np.cumsum(per)][np.cumsum(sizes)])
            assert size.sum() == len(ids) and (ids[np.cumsum(size) - 1] == 0).all() and (ids == 0).sum() == len(texts)
            assert size.tolist()[:3] == [1, 1, 1]


def test_drawn_windows_follow_the_text(spark):
    """About the asked number of windows, the same whatever the partitions; far windows of a long text among them."""
    rnd = random.Random(9)
    rows = [(i, " ".join(rnd.choice(["red", "blue", "green"]) for _ in range(200))) for i in range(300)] + [(999, " ".join(f"n{k}" for k in range(20_000)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    path = subwords.default_ranks()
    found = []
    for parts in (1, 5):
        table = lm_scoring.encoded(docs.repartition(parts).select("text"), path).cache()
        sums = {r["k"]: r["n"] for r in table.where("kind = 2").groupBy("k").agg(F.sum("n").alias("n")).collect()}
        shipped = spark.sparkContext.broadcast(lm_scoring.Vocabulary(sums, path))
        total = sum(sums.values()) / 32
        found.append(lm_scoring.sample_windows(table.where("kind = 0").select("ids"), shipped, 0.1))
        assert 0.07 * total < len(found[-1][0]) < 0.13 * total
    assert all((a == b).all() for a, b in zip(*found))


def test_pair_mixture_is_a_distribution():
    from factloom.llm.attention import IDS, AttentionModel

    rnd = np.random.default_rng(1)
    m = AttentionModel(np.ones(IDS))
    pairs = np.unique(rnd.integers(0, IDS * IDS, 5000))
    keep, pair = lm_scoring.PairMixture(pairs, rnd.integers(1, 50, len(pairs)), rnd.integers(0, 9, IDS)).tables()
    assert np.abs(keep + pair.reshape(IDS, IDS).sum(1) - 1).max() < 1e-4
    keys, targets, _ = lm_scoring.windows(rnd.integers(1, IDS, 40), np.array([40]))
    got = lm_scoring.mixed_log_probs(m, keys, targets, m.tables(), (keep, pair))
    assert (got[targets < 0] == 0).all() and (got[targets >= 0] < 0).all()


def test_attention_starts_from_pair_counts():
    """An attention that adds nothing gives the smoothed counts; a window that is learned from is left out of them; gradients hold over them."""
    from factloom.llm.attention import CONTEXT, IDS, AttentionModel, PairOffsets, windows

    rnd = np.random.default_rng(3)
    ids = rnd.integers(1, 60, 416)
    keys, targets, _ = windows(ids, np.array([416]))
    before, live = keys[:, CONTEXT:], targets >= 0
    pairs, counts = np.unique(before[live] * IDS + targets[live], return_counts=True)
    frequencies = np.bincount(ids, minlength=IDS)
    m = AttentionModel(frequencies, PairOffsets(pairs, counts, frequencies))
    drawn = {k: m.p[k] for k in "CU"}
    m.p |= {k: np.zeros_like(v) for k, v in drawn.items()}
    table, base = np.zeros((IDS, IDS)), (frequencies + 0.5) / (frequencies + 0.5).sum()
    table.flat[pairs] = counts
    n, total = table[before, targets], table.sum(1)[before]
    want = np.log((n + 8 * base[targets]) / (total + 8))
    assert np.abs(m.log_probs(keys, targets, m.tables()) - want)[live].max() < 1e-3
    less = np.log((n - 1 + 8 * base[targets]) / (total - 1 + 8))
    assert np.abs(m.learn(keys, targets)[0] - less)[live].max() < 1e-3 and (less < want - 0.1)[live].any()
    m.p = {k: v.astype(np.float64) for k, v in (m.p | drawn).items()}
    _, g = m.gradients(keys, targets)
    for k in g:
        w = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        old, e = m.p[k][w], 1e-3
        m.p[k][w] = old + e
        up = m.gradients(keys, targets)[0]
        m.p[k][w] = old - e
        assert abs((up - m.gradients(keys, targets)[0]) / 2 / e - g[k][w]) < 1e-3
        m.p[k][w] = old
