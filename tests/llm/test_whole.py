"""Cases in which a stage or an operator once did less than the whole job."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from tests.llm.test_operators import SF, frame
from tidemark.llm import exact_dedup, near_copies, quality, toxicity


def test_pipeline_near_duplicates_by_similarity(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    root = brute.similar([(r.doc_id, r.text) for r in docs.collect()])
    got = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert got.columns == docs.columns
    # 1 and 177: similarity 0.83, fingerprints 9 bits apart
    assert root[177] == 1 and {r.doc_id for r in got.collect()} == {i for i, r in root.items() if i == r}


@pytest.mark.parametrize(("chunk", "most"), [(256, 32 << 20), (3, 32 << 20), (3, 0)])
def test_near_copies_large_group(spark, monkeypatch, chunk, most):
    monkeypatch.setattr(near_copies, "CHUNK", chunk)
    monkeypatch.setattr(near_copies, "BROADCAST_BYTES", most)
    rng = random.Random(5)
    rows = []
    for g in range(3):
        base = [f"g{g}w{k}" for k in range(120)]
        for _ in range(25):
            words = list(base)
            for at in rng.sample(range(120), rng.randrange(5)):
                words[at] = f"x{rng.random()}"
            rows.append((rng.randrange(10**9), " ".join(words), "en", "s", 0))
    rows += [(1, "", "en", "s", 0), (2, " \n", "en", "s", 0), (3, "one word more", "en", "s", 0), (4, None, "en", "s", 0)]
    root = brute.similar([(r[0], r[1] or "") for r in rows])
    got = near_copies.without_near_copies(frame(spark, rows))
    assert sorted(r.doc_id for r in got.collect()) == sorted(i for i, r in root.items() if i == r)
    assert near_copies.without_near_copies(frame(spark, rows).limit(0)).collect() == []


@pytest.mark.parametrize("chunk", [256, 4])
def test_near_copies_in_chains_and_half_alike(spark, monkeypatch, chunk):
    """Chains whose ends aren't alike, and families that share half their shingles."""
    monkeypatch.setattr(near_copies, "CHUNK", chunk)
    rng = random.Random(8)
    rows, half = [], [f"h{k}" for k in range(60)]
    for g in range(6):
        words = half + [f"g{g}w{k}" for k in range(rng.choice([30, 60, 90]))]
        for _ in range(14):
            words = list(words)
            words[rng.randrange(len(words))] = f"x{rng.random()}"
            rows.append((rng.randrange(10**9), " ".join(words), "en", "s", 0))
    root = brute.similar([r[:2] for r in rows])
    got = near_copies.without_near_copies(frame(spark, rows))
    assert sorted(r.doc_id for r in got.collect()) == sorted(i for i, r in root.items() if i == r)
    assert 6 <= len(set(root.values())) < len(rows)


@pytest.mark.parametrize("chunk", [256, 4])
def test_near_copies_named_by_simhash(spark, monkeypatch, chunk):
    """Without any band the components of fingerprints name candidates, and each is compared in full."""
    own = near_copies.sketches
    monkeypatch.setattr(near_copies, "sketches", lambda *a, **k: own(*a, **k).withColumn("keys", F.array().cast("array<long>")))
    monkeypatch.setattr(near_copies, "CHUNK", chunk)
    rng = random.Random(11)
    texts = []
    for g in range(4):
        base = [f"g{g}w{k}" for k in range(300)]
        for changed in [0] * 2 + [1] * 6 + [2] * 6 + [12] * 3:
            words = list(base)
            for at in rng.sample(range(300), changed):
                words[at] = f"x{rng.random()}"
            texts.append(" ".join(words))
    rng.shuffle(texts)
    fps = brute.near({i: brute.fingerprint(t, 5) for i, t in enumerate(texts)})
    want = {}
    for i in fps:  # alike within one component of fingerprints
        want |= brute.similar([(j, texts[j]) for j in fps if fps[j] == i], similarity=0.95)
    got = near_copies.without_near_copies(frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)]), similarity=0.95)
    assert sorted(r.doc_id for r in got.collect()) == sorted(i for i, r in want.items() if i == r)
    assert len(set(fps.values())) < len(set(want.values())) < len(set(texts))


def test_near_copies_of_one_text_take_linear_work(spark, monkeypatch):
    """Two thousand near copies: a few comparisons each, not a thousand."""
    seen = []
    own = near_copies._verified

    def counted(units, at, similarity, **options):
        if "set" in units.columns:
            seen.append(units.count())
        return own(units, at, similarity, **options)

    monkeypatch.setattr(near_copies, "_verified", counted)
    monkeypatch.setattr(near_copies, "CHUNK", 64)
    rng = random.Random(3)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for i in range(2_000):
        words = list(base)
        words[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(words), "en", "s", 0))
    assert [r.doc_id for r in near_copies.without_near_copies(frame(spark, rows)).collect()] == [0]
    assert sum(seen) < 20 * len(rows)


def test_no_usable_labels_keep_documents(spark):
    docs = frame(spark, [(i, f"plain words {i}", "en", "s", 0) for i in range(4)])
    schema = "doc_id long, toxic int"
    for rows in ([], [(99, 1), (98, 0)], [(0, 1), (1, 1)]):
        lexicon = toxicity.learn(docs, spark.createDataFrame(rows, schema))
        assert all(r.score < 0.5 for r in toxicity.score(docs, lexicon).collect())
        assert toxicity.without_toxic(docs, lexicon).count() == 4


def test_exact_dedup_twice_on_one_state(spark, tmp_path):
    path, state = str(tmp_path / "t"), f"file://{tmp_path}/state"
    frame(spark, [(5, "a b", "", "", 0), (6, "d", "", "", 0)]).write.parquet(path)
    exact_dedup.exact_dedup(spark, path, state_dir=state).collect()
    frame(spark, [(3, "a  b", "", "", 0), (9, "c", "", "", 0)]).write.mode("append").parquet(path)
    out = exact_dedup.exact_dedup(spark, path, state_dir=state).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in out) == [(3, 3, 2, True), (5, 3, 2, False), (6, 6, 1, True), (9, 9, 1, True)]


@pytest.mark.parametrize(("bits", "most"), [(256, 32 << 20), (256, 0), (4, 0)])
def test_exact_dedup_calls_on_one_state(spark, tmp_path, monkeypatch, bits, most):
    """Each call over the files so far equals brute force; the second needs no old file without a hit."""
    monkeypatch.setattr(exact_dedup, "BROADCAST_BYTES", most)
    path, state = str(tmp_path / "t"), f"file://{tmp_path}/state"
    parts = [[(i, f"text  {i % 40}", "en", "s", 0) for i in range(60, 90)], [(i, f"alone {i}", "en", "s", 0) for i in range(5)], [(i, f"text {i % 40}", "en", "s", 0) for i in range(20, 60, 2)]]
    seen = []
    for k, part in enumerate(parts):
        frame(spark, part).coalesce(1).write.mode("append").parquet(path)
        seen += [(r[0], r[1]) for r in part]
        if bits == 256 and k == 2:
            for f in (tmp_path / "t").iterdir():
                if f.suffix == ".parquet" and spark.read.parquet(str(f)).filter("text like 'alone%'").count():
                    f.unlink()
        out = exact_dedup.exact_dedup(spark, path, state_dir=state, digest_bits=bits).collect()
        want = brute.groups(seen)
        assert {r.doc_id: (r.keep_id, r.group_size, r.text_sha256) for r in out} == want and len(out) == len(want)
        assert all(r.kept == (r.doc_id == r.keep_id) for r in out)
    again = exact_dedup.exact_dedup(spark, path, state_dir=state, digest_bits=bits).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, out))


def _naive(text, lexicon):
    """Each entry looked for at each place, each exception beside it."""
    folded = toxicity.fold(text)
    spared = [(a, a + len(p) - 1) for p in lexicon.exceptions for a in range(len(folded)) if folded.startswith(p, a)]
    total = 0.0
    for at in range(len(folded)):
        best = max((w for t, w in lexicon.terms.items() if folded.startswith(t, at)), default=0.0)
        if best > 0 and not any(a <= at < b for a, b in spared):
            total += best
    return total, len(folded.split())


def test_matcher_against_naive():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 5)))
    for _ in range(60):
        terms = {(f" {word()} " if rng.random() < 0.5 else f" {word()}"): rng.choice([1.0, 2.0, 4.0]) for _ in range(8)}
        phrases = [f" {' '.join(word() for _ in range(rng.randint(1, 3)))} " for _ in range(6)]
        lexicon = toxicity.Lexicon(terms, phrases)
        machine = lexicon.automaton()
        for _ in range(20):
            text = " ".join(word() for _ in range(rng.randint(0, 40)))
            assert toxicity.measure(text, machine) == _naive(text, lexicon)
    lexicon = toxicity.Lexicon({" a": 1.0}, [" a b ", " b a "])
    assert toxicity.measure("a b " * 50_000 + "a c a", lexicon.automaton()) == (1.0, 100_003)  # spans in plenty


def test_toxicity_learns_long_beginnings_and_many_entries(spark):
    """No entry is lost by its number or its length: only by evidence."""
    long_ = "abcdefghijklmnopqrstuvw"
    rows = [(i, f"{long_}{'xyzuv'[i % 5]} plain", "", "", 0) for i in range(50)]
    rows += [(100 + i, f"{long_[:9]}other words", "", "", 0) for i in range(50)]
    many = ["".join(chr(97 + (k // 26**j) % 26) for j in range(3)) for k in range(6_000)]
    rows += [(200 + i, " ".join(many), "", "", 0) for i in range(10)]
    labels = spark.createDataFrame([(r[0], int(r[0] < 50 or r[0] >= 200)) for r in rows], "doc_id long, toxic int")
    lexicon = toxicity.learn(frame(spark, rows), labels)
    folded = toxicity.fold(long_).strip()
    assert f" {folded[:10]}" in lexicon.terms
    assert len({t for t in lexicon.terms if len(t) == 5}) > 5_000


def _grown(x, y, trees, depth, bins, rate, ridge, least):
    """Boosting a row and a cut at a time: (feature, threshold) or a value for each node of each tree."""
    edges = [sorted(set(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1]))) for c in x.T]
    total = [float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))] * len(y)
    out = []
    for _ in range(trees):
        p = [1 / (1 + np.exp(-t)) for t in total]
        g, h = [a - b for a, b in zip(y, p, strict=True)], [a * (1 - a) for a in p]
        nodes, cuts, values = {0: list(range(len(y)))}, {}, {}
        for node in range(2 ** (depth + 1) - 1):
            rows = nodes.get(node, [])
            if node >= 2**depth - 1:
                values[node] = rate * sum(g[i] for i in rows) / (sum(h[i] for i in rows) + ridge)
                for i in rows:
                    total[i] += values[node]
                continue
            worth = lambda part: sum(g[i] for i in part) ** 2 / (sum(h[i] for i in part) + ridge)  # noqa: B023, E731
            best, cut = 1e-6, None
            for j in range(x.shape[1]):
                for e in edges[j]:
                    left, right = [i for i in rows if x[i, j] <= e], [i for i in rows if x[i, j] > e]
                    if min(len(left), len(right)) >= least and (gain := worth(left) + worth(right) - worth(rows)) > best * (1 + 1e-12):
                        best, cut = gain, (j, e)
            if cut:
                cuts[node] = cut
                nodes[2 * node + 1], nodes[2 * node + 2] = [i for i in rows if x[i, cut[0]] <= cut[1]], [i for i in rows if x[i, cut[0]] > cut[1]]
            else:
                nodes[2 * node + 1] = rows
        out.append((cuts, values))
    return out


def test_trees_against_naive_growth():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(160, 3))
    y = ((x[:, 0] + 0.5 * x[:, 1] > 0.2) ^ (rng.random(160) < 0.1)).astype(float)
    options = {"trees": 4, "depth": 2, "bins": 12, "rate": 0.3, "ridge": 1.0, "least": 8}
    model, size = quality.fit(x, y, **options), 7
    for t, (cuts, values) in enumerate(_grown(x, y, **options)):
        for node in range(3):
            j, e = cuts.get(node, (0, np.inf))
            assert (model.feature[t * size + node], model.threshold[t * size + node]) == (j, e)
        assert all(abs(model.value[t * size + node] - values[node]) < 1e-9 for node in range(3, 7))


def test_classifiers_learn_from_one_row_of_an_id(spark, monkeypatch):
    """However often a labelled id is repeated, the driver gets one row of it."""
    docs = frame(spark, [(i % 4, f"text {i % 8} of words", "en", "s", 0) for i in range(400)])
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(4)], "doc_id long, quality int, toxic int")
    seen = []
    own = quality.fit
    monkeypatch.setattr(quality, "fit", lambda x, y, **k: seen.append(len(y)) or own(x, y, **k))
    quality.learn(docs, labels)
    assert seen == [4] and toxicity.learn(docs, labels) == toxicity.learn(docs.dropDuplicates(["doc_id", "text"]), labels)
