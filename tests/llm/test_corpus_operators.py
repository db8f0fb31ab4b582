"""Duplicates, repeats, classifiers and the pipeline against brute force."""

import collections
import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from corvane.llm import classifier, longrepeats, neardup, toxicity
from corvane.llm.arrowtext import BASE, flat, mix
from corvane.llm.graph import components

from .conftest import prose


def key(row):
    return repr(tuple(row))


def removed(texts, length):
    raw = [t.encode() for _, t in texts]
    seen = collections.Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for (d, _), b in zip(texts, raw):
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(b) else 0
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats(odd, empty, texts):
    assert sorted(map(key, removed(texts, 200))) == sorted(map(key, longrepeats.remove_repeats(odd).collect()))
    assert longrepeats.remove_repeats(empty).count() == 0
    kept = longrepeats.without_repeats(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count() and kept.where("text is null").count() == 2


def test_repeats_of_crowded_anchors(spark, monkeypatch):
    monkeypatch.setattr(longrepeats, "VARIANTS", 3)
    rng = random.Random(1)
    passage = prose(9, 60)
    docs = [(i, prose(rng.randrange(10**6), 20 + i % 5) + " " + passage[i % 3 :] + " " + prose(rng.randrange(10**6), 15)) for i in range(40)] + [(99, "日本語テスト" * 60)]
    got = longrepeats.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(map(key, removed(docs, 200))) == sorted(map(key, got))


@pytest.mark.parametrize("letters", [2, 3, 20])
def test_matching_statistics(letters):
    rng = random.Random(letters)
    for n in (1, 2, 9, 60):
        t = bytes(rng.randrange(letters) for _ in range(n))
        best = [max([next((k for k in range(n) if max(i, j) + k >= n or t[i + k] != t[j + k]), 0) for j in range(n) if j != i], default=0) for i in range(n)]
        index = longrepeats.RunIndex(np.frombuffer(t, np.uint8))
        assert index.matching_statistics().tolist() == best and index.restored().tolist() == list(t)


def test_only_tied_suffixes_are_sorted_again(monkeypatch):
    whole, sizes = np.argsort, []
    text = np.frombuffer((prose(1, 2000) + prose(2, 80) + prose(3, 2000) + prose(2, 80)).encode(), np.uint8)
    monkeypatch.setattr(longrepeats.np, "argsort", lambda x, *a, **b: sizes.append(len(x)) or whole(x, *a, **b))
    order, ranks = longrepeats.suffix_array(text)
    raw = text.tobytes()
    assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
    assert len(sizes) == len(ranks) > 5 and all(a > b for a, b in zip(sizes, sizes[1:])) and sizes[3] < len(raw) / 10


def test_no_string_runs_over_the_joint_of_two_spans():
    x, y = prose(1, 40).encode()[:150], prose(2, 40).encode()[:150]
    assert longrepeats.repeated_strings([x + b"\0" + y, b"a" + x, y + b"b"], [1, 1, 1], [102, 1, 1]) == [[], [], []]
    assert longrepeats.repeated_strings([x + b"\0" + y, b"a" + x + b"\0" + y], [1, 1], [102, 103]) == [[(0, 102)], [(1, 103)]]


def test_near_duplicates(odd, empty, texts):
    rows = neardup.near_duplicates(odd).collect()
    by = collections.defaultdict(set)
    for r in rows:
        by[r.doc_id].add(r.class_id)
    assert len(rows) == len(texts) and by[4] == by[5] == by[6] == {4} and by[1] == by[2] and by[3] == {3} and by[9] == {9}
    kept = neardup.first_of_each(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 3, 4, 7, 8, 9, 10, 11, 12, 13, 14, 15]
    assert neardup.near_duplicates(empty).count() == 0


def test_near_duplicates_like_brute_force(spark):
    rng = random.Random(7)
    docs = []
    for g in range(12):
        words = prose(100 + g, 150).split()
        for _ in range(6):
            own = list(words)
            for _ in range(rng.choice([0, 1, 2, 3, 6, 12])):
                own[rng.randrange(len(own))] = f"new{rng.random()}"
            docs.append((len(docs), " ".join(own)))
    found = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    sets = [collections.Counter(tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)) for _, t in docs]
    frequency = collections.Counter(g for s in sets for g in s)
    weight = lambda s, g: s[g] * (1 + np.log((len(docs) + 1) / frequency[g]) / np.log(len(docs) + 2))
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            both = sets[a].keys() | sets[b].keys()
            least = sum(min(weight(sets[a], g), weight(sets[b], g)) for g in both if g in sets[a] and g in sets[b])
            most = sum(max(weight(s, g) if g in s else 0 for s in (sets[a], sets[b])) for g in both)
            if least / most >= 0.8:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    assert found == {d: root(d) for d, _ in docs}


@pytest.mark.parametrize("copies", [40, 300])
def test_near_duplicates_of_large_buckets(spark, monkeypatch, copies):
    monkeypatch.setattr(neardup, "BLOCK", 64)  # several blocks a bucket
    rng = random.Random(11)
    base, chain = prose(300, 200).split(), [f"c{i}" for i in range(200)]
    docs = []
    for _ in range(copies):
        own = list(base)
        for _ in range(rng.choice([0, 1, 2, 4, 8])):
            own[rng.randrange(len(own))] = f"new{rng.random()}"
        docs.append((len(docs), " ".join(own)))
    for i in range(60):  # likeness over others
        docs.append((len(docs), " ".join(chain[: 200 - i] + [f"d{j}" for j in range(i)])))
    docs = list({t: d for d, t in docs}.items())
    rows = spark.createDataFrame([(d, t) for t, d in docs], "doc_id long, text string")
    sets = [collections.Counter(tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)) for t, _ in docs]
    held = collections.Counter(g for s in sets for g in s)
    weights = [{g: c * (1 + np.log((len(docs) + 1) / held[g]) / np.log(len(docs) + 2)) for g, c in s.items()} for s in sets]
    links, edges = collections.Counter(), []
    for a in range(len(docs)):
        for b in range(a):
            least = sum(min(w, weights[b][g]) for g, w in weights[a].items() if g in weights[b])
            if least / (sum(weights[a].values()) + sum(weights[b].values()) - least) >= 0.8 - 1e-9:
                links[docs[a][1]] += 1
                links[docs[b][1]] += 1
                edges.append((docs[a][1], docs[b][1]))
    label = {d: d for _, d in docs}
    while any(label[a] != label[b] for a, b in edges):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    found = {r.doc_id: (r.class_id, r.n_links) for r in neardup.near_duplicates(rows).collect()}
    assert found == {d: (label[d], links[d]) for _, d in docs}


def test_near_duplicates_weigh_by_true_frequencies(spark):
    rng = random.Random(13)
    new = lambda k: " ".join(f"{rng.getrandbits(36):x}" for _ in range(k))
    passage = new(178)  # 174 shingles in 200 of 2,000 texts, 15 own ones: weighted Jaccard 0.79
    docs = [f"{passage} {new(15)}" for _ in range(2)] + [f"{passage} {new(1100)}" for _ in range(198)] + [new(1100) for _ in range(1800)]
    rows = neardup.near_duplicates(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"))
    assert rows.where("n_links > 0 or class_id <> doc_id").count() == 0


def shuffled_rows(spark, run) -> int:
    """Rows that the stages of run's jobs write for others."""
    sc, group = spark.sparkContext, f"group{random.random()}"
    sc.setJobGroup(group, "")
    try:
        run()
    finally:
        sc._jsc.clearJobGroup()
    tracker, store = sc.statusTracker(), sc._jsc.sc().statusStore()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    return sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages)


@pytest.mark.parametrize("least_bits, size", [(5, 0), (1, 100 << 20)])
def test_shingles_are_counted_in_ranges(spark, monkeypatch, least_bits, size):
    monkeypatch.setattr(neardup, "LEAST_BITS", least_bits)
    docs = [prose(i, 400) for i in range(60)] * 3 + [prose(100, 300) + f" end{i}" for i in range(40)] + [prose(i, 200) for i in range(20)] + ["", " \n", None, "two words"]
    texts = spark.createDataFrame([(t,) for t in docs], "text string").repartition(3)  # three workers' sums
    held = collections.Counter(neardup.weighted(*flat(pa.array(docs)))[0].tolist())
    rows = []
    moved = shuffled_rows(spark, lambda: rows.extend(neardup.shingle_counts(texts, size).collect()))
    assert len(rows) == len({r.shingle for r in rows}) and {r.shingle: r.held for r in rows} == {x: n for x, n in held.items() if n > 1}
    assert moved < len(held) / 10  # not a row for each
    assert neardup.shingle_counts(texts.limit(0), 0).count() == 0


def test_signatures_like_plain_sampling(monkeypatch):
    monkeypatch.setattr(neardup, "TOGETHER", 64)  # texts begin and end within parts, at their bounds, and run over several
    monkeypatch.setattr(neardup, "LEVELS", 3)
    sizes, rng = [1, 63, 64, 0, 200, 1, 0, 127, 30], np.random.default_rng(3)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    order = {v: neardup._order(v) for v in range(9)}
    shingle = np.concatenate([np.sort(rng.integers(0, 1 << 48, n, dtype=np.uint64)) for n in sizes])
    for highest in (1, 2, 9, 2):  # more levels than a worker keeps, and fewer again
        level = rng.integers(0, highest, len(doc))
        found = neardup.signatures(shingle, level, doc, len(sizes))
        for d, n in enumerate(sizes):
            bands = np.zeros(neardup.BANDS, np.uint64)
            for k in range(neardup.BANDS * neardup.ROWS if n else 0):
                x = shingle[doc == d] * np.uint64(pow(BASE, 2 * k + 3, 1 << 64))
                x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                rank = [int(order[v][k, int(z) >> 52]) << 32 | int(z) >> 20 & 0xFFFFFFFF for v, z in zip(level[doc == d].tolist(), x)]
                at = slice(k // neardup.ROWS, k // neardup.ROWS + 1)
                bands[at] = mix(bands[at] + np.array([min(rank) & 0xFFFFFFFF], np.uint64) * np.uint64(BASE) + np.uint64(k + 1))
            assert found[d].tolist() == bands.tolist()


def test_sampling_holds_little_besides_the_shingles():
    """Levels and places of levels are as long as a slice, working arrays are not."""
    shingle, level, doc = np.arange(1 << 20, dtype=np.uint64), np.zeros(1 << 20, np.int64), np.arange(1 << 20) >> 10
    neardup.signatures(shingle[:10], level[:10], level[:10], 1)
    tracemalloc.start()
    neardup.signatures(shingle, level, doc, 1 << 10)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 6 * shingle.nbytes


def test_components(spark):
    edges = [(i, i + 1) for i in range(30) if i != 14] + [(40, 41), (41, 42), (42, 40)]
    labels = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {labels[i] for i in range(15)} == {0} and {labels[i] for i in range(15, 31)} == {15} and labels[42] == 40
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.fixture(scope="module")
def marked(spark):
    rude = ["grubworm", "slimebag", "dunderhead", "muckraker"]
    rows = []
    for i in range(400):
        text, toxic, good = prose(i, 80), i % 5 == 0, i % 3 != 0
        if toxic:
            text += f" You {rude[i % 4].title()}, {rude[(i // 5) % 4]}!"
        if not good:
            text = " ".join(w + "%%%" for w in text.split())
        rows.append((i, text, int(good), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")


def test_toxicity(marked, odd, empty):
    rows = toxicity.score_documents(marked.select("doc_id", "text"), marked).join(marked.select("doc_id", "toxic"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 400 and len(held) > 40 and all(r.predicted == r.toxic for r in held) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.evidence for r in held)
    assert toxicity.score_documents(odd, marked).count() == odd.count() and toxicity.score_documents(empty, marked).count() == 0
    kept = toxicity.without_toxic(odd, marked)  # 10 and 15 are labelled toxic here: each is its own nearest example
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == sorted(d or 0 for d, in odd.select("doc_id").collect() if d not in (10, 15))
    none = toxicity.score_documents(odd, marked.limit(0)).collect()
    assert {r.score for r in none} == {0.5}


@pytest.mark.parametrize("long", [0, 8, 512])
def test_nearest_is_exact(monkeypatch, long):
    monkeypatch.setattr(toxicity, "LONG", long)
    rng = np.random.default_rng(2)
    rows = [(np.sort(rng.choice(60, rng.integers(1, 9), replace=False)), None) for _ in range(700)]
    rows = [(t, rng.integers(1, 4, len(t)).astype(float)) for t, _ in rows]
    group = rng.integers(0, 200, 700).astype(np.uint64)
    labels, idf = rng.integers(0, 2, 700), rng.random(60) + 0.5
    index = toxicity.Index(np.arange(60, dtype=np.uint64), idf, rows, labels, list(range(700)), group, np.ones(700))
    whole = np.zeros((700, 60))
    for i, (t, n) in enumerate(rows):
        whole[i, t] = (1 + np.log(n)) * idf[t]
    whole /= np.sqrt((whole**2).sum(1, keepdims=True))
    asked = rows[:150]
    owner, which, count = np.repeat(np.arange(150), [len(t) for t, _ in asked]), np.concatenate([t for t, _ in asked]), np.concatenate([n for _, n in asked])
    for without in (None, group[:150]):
        cosines, places = index.nearest(owner, which, count, 150, without)
        votes = index.votes(cosines, places)
        for i in range(150):
            plain = np.round(whole @ whole[i], 10)
            if without is not None:
                plain[group == group[i]] = -1
            own = [j for j in np.lexsort((np.arange(700), -plain))[: index.k].tolist() if plain[j] > 0]
            assert [index.ids[p] for p in places[i] if p >= 0] == own and np.allclose(cosines[i][: len(own)], plain[own])
            free = (index.k - len(own)) * toxicity.FAR**2
            assert np.isclose(votes[i], ((plain[own] ** 2 * labels[own]).sum() + free * labels.mean()) / ((plain[own] ** 2).sum() + free))


def test_toxicity_scores_are_those_of_plain_cosines(spark, marked):
    """The whole query's scores and evidence, by dense vectors without any index."""
    import re
    import zlib

    docs = {r.doc_id: r for r in marked.collect()}
    words = {d: collections.Counter(re.findall(r"[^\W\d_]+", r.text.lower())) for d, r in docs.items()}
    known = sorted(d for d in docs if zlib.crc32(str(d).encode()) % 5)
    terms = sorted({w for d in known for w in words[d]})
    held = collections.Counter(w for x in words.values() for w in x)
    idf = np.array([np.log((1 + len(docs)) / (1 + held[w])) for w in terms])
    rows = {d: np.array([(1 + np.log(words[d][w])) if words[d][w] else 0 for w in terms]) * idf for d in docs}
    rows = {d: x / (np.sqrt((x * x).sum()) or 1) for d, x in rows.items()}
    label = np.array([docs[d].toxic for d in known])
    k = max(toxicity.FEWEST, min(toxicity.NEIGHBOURS, len(known) // toxicity.SPREAD))
    shingled = {d: {tuple(docs[d].text.split()[i : i + 5]) for i in range(len(docs[d].text.split()) - 4)} for d in docs}

    def vote(d, loo):
        plain = np.round([rows[e] @ rows[d] for e in known], 10)
        if loo:
            plain[known.index(d)] = -1
        own = [j for j in np.lexsort((np.arange(len(known)), -plain))[:k] if plain[j] > 0]
        weight, free = plain[own] ** 2, (k - len(own)) * toxicity.FAR**2
        return ((weight * label[own]).sum() + free * label.mean()) / (weight.sum() + free), [known[j] for j in own[:5]]

    assert len({frozenset(x) for x in shingled.values()}) == len(docs)  # no like texts
    places, chances = toxicity.calibrate(np.array([vote(d, True)[0] for d in known]), label.astype(float), np.ones(len(known)))
    rows_found = toxicity.score_documents(marked.select("doc_id", "text"), marked).collect()
    assert len(rows_found) == len(docs)
    for r in rows_found:
        want, evidence = vote(r.doc_id, False)
        assert np.isclose(r.score, np.interp(want, places, chances)) and r.evidence == evidence
    assert {docs[e].toxic for r in rows_found for e in r.evidence} == {0, 1}


def test_few_telling_words_make_a_text_toxic(spark):
    """Texts of a subject share many words, toxic ones of any subject one of six: plain cosines, as score_documents has them, find the subject."""
    rude = ["grubworm", "slimebag", "dunderhead", "muckraker", "wretch", "lout"]
    subject = lambda i: " ".join(chr(97 + i // 5 % 20) * 3 + chr(97 + (i + k) % 16) * 2 for k in range(12))
    texts = [f"{prose(5000 + i, 150)} {subject(i)} {rude[i // 5 % 6] if i % 5 == 0 else ''} {prose(6000 + i, 50)}" for i in range(600)]
    rows = spark.createDataFrame([(i, t, int(i % 5 == 0)) for i, t in enumerate(texts)], "doc_id long, text string, toxic int")
    found = {r.doc_id for r in toxicity.score_documents(rows.select("doc_id", "text"), rows).where("score < 0.5").collect()}
    kept = {r.doc_id for r in toxicity.without_toxic(rows.select("doc_id", "text"), rows).collect()}
    clean = {i for i in range(600) if i % 5}
    assert len(found - clean) > 12 and kept == clean


def test_telling_words_by_a_plain_ratio():
    rows, labels = [(np.array(t), None) for t in ([0, 1], [0, 1], [0, 2], [2], [1], [1])], np.array([1, 1, 1, 0, 0, 0])
    group = np.array([1, 2, 3, 4, 5, 5], np.uint64)  # the last two are copies
    got = toxicity.telling(rows, labels, group, 4)
    for term, (one, none) in enumerate([(3, 0), (2, 1), (1, 1), (0, 0)]):
        table = np.array([[one, 3 - one], [none, 2 - none]], float)
        want = table.sum(1, keepdims=True) * table.sum(0) / 5
        ratio = 2 * sum(x * np.log(x / e) for x, e in zip(table.ravel(), want.ravel()) if x)
        assert np.isclose(got[term], np.sqrt(ratio))


def test_classifier(marked, odd, empty):
    rows = classifier.score_documents(marked.select("doc_id", "text"), marked).join(marked.select("doc_id", "quality"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 80 and np.mean([r.predicted == r.quality for r in held]) > 0.95 and all(0 <= r.score <= 1 for r in rows)
    assert classifier.score_documents(odd, marked).count() == odd.count() and classifier.score_documents(empty, marked).count() == 0
    assert {r.score for r in classifier.score_documents(odd, marked.limit(0)).collect()} == {0.5}


def test_pipeline(spark, marked, tmp_path):
    docs = marked.selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "length(text) AS n_chars").unionByName(marked.where("doc_id = 1").selectExpr("doc_id + 1000 AS doc_id", "text", "'en' AS lang", "'s' AS source", "length(text) AS n_chars"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    marked.selectExpr("doc_id", "quality", "toxic").write.parquet(str(tmp_path / "labels.parquet"))
    kept = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    want = {r.doc_id for r in marked.where("toxic = 0 AND quality = 1").collect()}
    assert kept == want
    current = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        current = stage(spark, current, str(tmp_path))
        assert current.columns == docs.columns


def test_classifier_scores_are_those_of_a_plain_forward_pass(marked):
    import zlib

    docs = {r.doc_id: r for r in marked.collect()}

    def counted(text):
        raw = text.encode()
        seen = collections.Counter(b for buckets, _ in classifier.features(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])) for b in buckets.tolist())
        count = np.array([seen[b] for b in sorted(seen)], np.float32)
        return np.array(sorted(seen), np.int32), count / max(1.0, float(count.sum()))

    known = sorted(str(d) for d in docs if zlib.crc32(str(d).encode()) % 3 != 1)
    labels = np.array([docs[int(d)].quality for d in known])
    model = classifier.train([counted(docs[int(d)].text) for d in known], labels, len(known) / (2 * np.bincount(labels)))
    for r in classifier.score_documents(marked.select("doc_id", "text"), marked).collect():
        buckets, share = counted(docs[r.doc_id].text)
        odds = (share @ model.vectors[buckets]) @ model.output + model.bias
        assert abs(r.score - np.exp(odds[1]) / np.exp(odds).sum()) < 1e-3 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_pipeline_stages_against_plain_versions(spark, marked, tmp_path):
    import duckdb
    import public_tokenizers
    from tokenizers import Tokenizer

    from corvane.llm import quality_rules

    marked.selectExpr("doc_id", "quality", "toxic").write.parquet(str(tmp_path / "labels.parquet"))
    passage, near = prose(901, 60), prose(902, 200).split()
    texts = [r.text for r in marked.where("doc_id < 60").orderBy("doc_id").collect()] + [prose(800 + i, 40) + " " + passage + " " + prose(850 + i, 30) for i in range(4)]
    texts += [" ".join(near[:i] + ["changed"] + near[i:]) for i in (0, 90, 199)] + [texts[1], "one two", "ab " * 90]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    run = lambda name, df: stages[name](spark, df, str(tmp_path))
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    table = lambda df: spark.createDataFrame(df.collect(), docs.schema)

    clean = table(run("toxicity", docs))
    assert ids(clean) == sorted(r.doc_id for r in toxicity.score_documents(docs, marked).collect() if r.score < 0.5) and 0 < clean.count() < docs.count()

    good, documents = table(run("quality_rules", clean)), clean.toPandas()  # noqa: F841
    con = duckdb.connect()
    con.register("documents", documents)
    assert ids(good) == sorted(d for d, kept in con.sql(f"SELECT doc_id, kept FROM ({quality_rules.oracle()})").fetchall() if kept) and 0 < good.count() < clean.count()

    once, rows = table(run("near_duplicates", good)), [(r.doc_id, r.text) for r in good.collect()]
    sets = {d: collections.Counter(tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)) for d, t in rows}
    held = collections.Counter(g for s in sets.values() for g in s)
    label = {d: d for d, _ in rows}
    for _ in rows:
        for a, x in sets.items():
            for b, y in sets.items():
                rare = lambda g: 1 + np.log((len(rows) + 1) / held[g]) / np.log(len(rows) + 2)
                least = sum(min(n, y[g]) * rare(g) for g, n in x.items() if g in y)
                most = sum(max(x[g], y[g]) * rare(g) for g in x.keys() | y.keys())
                if a < b and least / most >= 0.8 and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
        if all(label[label[d]] == label[d] for d in label):
            break
    assert ids(once) == sorted(d for d in label if label[d] == d) and once.count() < good.count()

    cut, rows = table(run("repeats", once)), [(r.doc_id, r.text) for r in once.collect()]
    plain = {d: (n - gone, digest) for d, n, gone, _, digest in removed(rows, 200)}
    assert {r.doc_id: (len(r.text.encode()), hashlib.sha256(r.text.encode()).hexdigest()) for r in cut.collect()} == plain and all(r.n_chars == len(r.text) for r in cut.collect())
    assert any(n < len(t.encode()) for (d, t), (n, _) in zip(rows, (plain[d] for d, _ in rows)))

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    packed, sequences = run("packing", cut).collect(), collections.defaultdict(list)
    assert sorted((r.doc_id, r.length) for r in packed) == sorted((r.doc_id, len(library.encode(r.text, add_special_tokens=False).ids) + 1) for r in cut.collect())
    for r in packed:
        sequences[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in x) <= 4096 and sorted(x)[0][0] == 0 for x in sequences.values())
