"""Each operator against brute force on small fixtures, with nulls, empty texts, repeats, clashing names and empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kithline.llm import bpe_automaton, decontaminate, html_text, jaccard_join, langid, line_dedup, quality, suffix_dedup, token_counts, toxicity
from kithline.llm.components import components

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
VOCAB = [a + b for a in ("ba", "ke", "lo", "mi", "nu", "pra", "sté", "tu") for b in ("n", "rt", "s", "la", "qui", "x", "ö")]


def words(rnd, n):
    return [rnd.choice(VOCAB) for _ in range(n)]


def corpus(seed=5):
    """Random texts, exact and near copies, shared passages, and odd rows."""
    rnd = random.Random(seed)
    texts = [" ".join(words(rnd, rnd.randint(1, 120))) + ("\n" if i % 3 else " ") + " ".join(words(rnd, 40)) for i in range(40)]
    passage = " ".join(words(rnd, 90))
    for i in range(10):
        texts.append(texts[i])
        near = texts[20 + i].split(" ")
        near[len(near) // 2] = f"other{i}"
        texts.append(" ".join(near))
        texts.append(" ".join(words(rnd, 30)) + "\n" + passage + "\n" + " ".join(words(rnd, 5)))
    texts += [None, None, "", "   \n\t", "one", "one", "one two three", "aaa " * 300, "x" * 1500, "Ünïcödé 世界   nbsp \x0b vt"]
    return texts


def frame(spark, texts, more=False):
    """Documents; with more, columns of names that operators use themselves."""
    rows = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)
    if more:
        rows = rows.withColumns({c: F.lit("clash") for c in ("n_words", "score", "spans", "found", "longest", "k1", "h", "set", "held_out", "kept", "n_lines", "label")})
    return rows


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 107), (107, 103), (200, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(31)) and got[103] == got[107] == got[100] == 100 and got[200] == 200


# 4 and 5

SPECIAL = ["<|endoftext|>", "a<|endoftext|><|startoftext|> B", "don't WE'LL", "aaaaaaaaaaaa !!!!!!!! ....", "ΑΣ Σ", "é ﬁ İ ß", "नमस्ते दुनिया", "  \n\n x \t\t", "1234567 ½ ²", "😀😀"]


def test_bpe_is_the_librarys(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = corpus() + SPECIAL
    got = {r.doc_id: r for r in bpe_automaton.encode_texts(frame(spark, texts, True), with_ids=True).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert (got[i].n_tokens, got[i].ids, got[i].decoded) == (len(ids), ids, text)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe_automaton.encode_texts(empty(spark)).count() == 0


def test_automaton_accepts_one_path():
    """On a tiny vocabulary: among all segmentations of a word, the automaton takes BPE's only."""
    merges = [("a", "b"), ("a", "a"), ("ab", "a"), ("b", "b"), ("aa", "ab")]
    vocab = {s: i for i, s in enumerate(["a", "b", *(u + v for u, v in merges)])}
    machine = bpe_automaton.TokenAutomaton(vocab, merges)

    def bpe(word):
        parts = list(word)
        while True:
            ranks = [(merges.index(p), i) for i, p in enumerate(zip(parts, parts[1:])) if p in merges]
            if not ranks:
                return parts
            _, i = min(ranks)
            parts[i : i + 2] = ["".join(parts[i : i + 2])]

    def splits(word):
        if not word:
            yield []
        for n in range(1, len(word) + 1):
            if word[:n] in vocab:
                for rest in splits(word[n:]):
                    yield [vocab[word[:n]], *rest]

    for n in range(1, 10):
        for k in range(2**n):
            word = "".join("ab"[k >> i & 1] for i in range(n))
            accepted = [p for p in splits(word) if all(machine.arc(x, y) for x, y in zip(p, p[1:]))]
            assert len(accepted) == 1 and machine.decode(accepted[0]) == bpe(word) == machine.decode(machine.encode_word(word))


def test_token_counts_are_the_librarys(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = corpus() + SPECIAL
    for r in token_counts.count_tokens(frame(spark, texts, True)).collect():
        t = texts[r.doc_id] or ""
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 512)
    assert token_counts.count_tokens(empty(spark)).count() == 0


# 3

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def base_brute(t):
    w = SPACED.findall(t or "")
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if SPACED.search(line):
            dup += line in seen
            seen.add(line)
    n = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    inside = {j for i in range(len(w) - 4) if n[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), dup, len(inside)


def test_quality_base_and_verdict(spark):
    texts = corpus() + ["a b#\na b#\n\n\n c|d <e>", "l\nl\nl"]
    docs = frame(spark, texts, True)
    labels = spark.createDataFrame([(i, int(i % 2), 0) for i in range(30)] + [(None, 1, 0), (31, None, 0)], "doc_id bigint, quality int, toxic int")
    trees = quality.fit(docs, labels)
    rows = quality.judge(docs, trees).collect()
    for r in rows:
        want = base_brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r.base_failed and r.kept)
    kept = {r.doc_id for r in quality.keep(docs, trees).collect()}
    assert kept == {r.doc_id for r in rows if r.kept} and quality.keep(docs, trees).columns == docs.columns
    assert quality.judge(empty(spark), quality.fit(empty(spark), labels)).count() == 0


def test_trees_learn_and_keep_order():
    from kithline.llm import boosted_trees

    rnd = np.random.default_rng(0)
    x = rnd.random((3000, 3))
    y = ((x[:, 0] + 0.3 * rnd.random(3000) > 0.6) ^ (x[:, 1] > 0.9)).astype(float)
    model = boosted_trees.fit(x[:2000], y[:2000], [1, 0, 0])
    assert ((model.probability(x[2000:]) > 0.5) == y[2000:]).mean() > 0.85
    grid = rnd.random((200, 3))
    up = grid.copy()
    up[:, 0] = np.minimum(1, up[:, 0] + rnd.random(200) * 0.5)
    assert (model.margin(up) >= model.margin(grid) - 1e-9).all()
    assert boosted_trees.fit(x[:0], y[:0], [0, 0, 0]).probability(x[:2]).tolist() == [0.5, 0.5]


# 1 and 2


def test_toxicity_learns_and_ignores_ids(spark):
    rnd = random.Random(2)
    bad = ["vile", "nasty", "rotten"]
    texts, labels = [], []
    for i in range(400):
        w = words(rnd, 40)
        toxic = i % 5 == 0
        if toxic:
            for k in range(3):
                w[k * 7] = rnd.choice(bad)
        texts.append(" ".join(w))
        labels.append((i, 1, int(toxic)))
    texts += [None, "", "...", texts[0], texts[0]]
    docs = frame(spark, texts, True)
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(docs, table)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == len(texts)
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert np.mean([got[i].predicted == labels[i][2] for i in held]) > 0.95
    assert got[400].score == got[401].score == got[402].score == model.silent and got[403].score == got[404].score == got[0].score
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert toxicity.score(empty(spark), model).count() == 0
    assert got[403].evidence[0] in (0, 403, 404) or got[0].held_out
    blank = toxicity.fit(docs, table.limit(0))
    assert {r.score for r in toxicity.score(docs, blank).collect()} == {0.0}


def dense_vectors(model, rows, n_docs):
    """The definition, term by term: (1 + log tf) x idf x relevance, words that nobody has in the length only."""
    place = {int(t): j for j, t in enumerate(model.terms)}
    out, rest = np.zeros((n_docs, len(place))), np.zeros(n_docs)
    for d, t, tf, whole in zip(*rows):
        w = 1 + np.log(tf)
        if int(t) in place:
            out[d, place[int(t)]] = w * model.weigh[place[int(t)]]
        elif whole:
            rest[d] += (w * model.unknown) ** 2
    return out / np.maximum(np.sqrt((out**2).sum(1) + rest), 1e-12)[:, None]


def nearest_votes(model, similarity):
    similarity = np.round(similarity, 9)
    best = [i for i in np.argsort(-similarity, kind="stable")[: toxicity.NEIGHBOURS] if similarity[i] > 0]
    w = similarity[best] ** 2 * model.weight[best]
    return best, (w * model.label[best]).sum() / w.sum() if len(best) else -1.0


def test_votes_and_calibration_are_those_of_a_full_scan():
    import pyarrow as pa

    rnd = random.Random(3)
    texts = [" ".join(words(rnd, rnd.randint(3, 40)) + (["vile", "nastily"] if i % 3 == 0 else []) * rnd.randint(0, 2)) for i in range(260)]
    label = np.array([float(i % 3 == 0) for i in range(200)])
    weight = np.where(label == 1, 1.0, 4.0)
    example = toxicity.term_counts(pa.array(texts[:200]))
    model = toxicity.index(list(range(200)), label, weight, *example)
    new = np.array(model.ids)
    by_text = dense_vectors(model, example, 200)[new]
    # weights: idf over the documents that examples stand for
    j = int(np.searchsorted(model.terms, example[1][0]))
    own = np.isin(np.arange(200), example[0][example[1] == example[1][0]])
    idf = np.log((weight.sum() + 1) / (weight[own].sum() + 1)) + 1
    assert np.isclose(model.weigh[j], idf * toxicity.relevance(np.array([label[own].sum()]), np.array([(1 - label[own]).sum()]), label.sum(), 200 - label.sum())[0])
    # calibration: the isotonic fit of leave-one-out votes, by its max-min formula
    votes = []
    for i in range(200):
        similarity = by_text @ by_text[i]
        similarity[i] = 0
        votes.append(nearest_votes(model, similarity)[1])
    x = np.round(votes, 9)
    levels = sorted(set(x))
    sums = np.array([[(model.weight * model.label)[x == v].sum(), model.weight[x == v].sum()] for v in levels])
    mean = lambda a, b: sums[a : b + 1, 0].sum() / sums[a : b + 1, 1].sum()
    fitted = [max(min(mean(a, b) for b in range(i, len(levels))) for a in range(i + 1)) for i in range(len(levels))]
    assert np.allclose([model.calibrated(v) for v in levels], fitted, atol=1e-6)
    # scores and evidence of other texts, of an example and of a text of unknown words
    asked = [*texts[200:], texts[5], "zzz qqq", ""]
    p, evidence = model.score(pa.array(asked))
    vectors = dense_vectors(model, toxicity.term_counts(pa.array(asked)), len(asked))
    for i in range(len(asked)):
        best, vote = nearest_votes(model, by_text @ vectors[i])
        assert np.isclose(p[i], model.calibrated(vote), atol=1e-6) and evidence[i] == [model.ids[k] for k in best[:3]]
    assert 5 in evidence[60] and evidence[61] == evidence[62] == []


def test_search_is_that_of_a_full_scan(monkeypatch):
    """Blocks, rows of frequent terms and both bounds against all similarities; also with no frequent terms at all."""
    rnd = np.random.default_rng(1)
    n = 900
    term = np.minimum(rnd.zipf(1.3, (n, 30)), 4000).astype(np.uint64)
    term[::40] = term[1::40][: len(term[::40])]  # copies
    doc = np.repeat(np.arange(n), 30)
    rows = (*toxicity._counted(doc, term.ravel()),)
    rows = (*rows, np.ones(len(rows[0]), bool))
    label = (rnd.random(n) < 0.3).astype(float)
    for often in (512, 40, 0):
        monkeypatch.setattr(toxicity, "FREQUENT", often)
        model = toxicity.index(list(range(n)), label, np.ones(n), *rows)
        assert model.rows.shape[1] <= often and (often == 0) == (model.rows.shape[1] == 0)
        full = dense_vectors(model, rows, n)[np.array(model.ids)]
        for k in (1, 15, 100, 2000):
            for i in range(0, n, 37):
                some = np.flatnonzero(full[i])
                best, similarity = model.search(some, full[i, some], k, without=i if k == 15 else -1)
                want = np.round(full @ full[i], 9)
                if k == 15:
                    want[i] = 0
                order = np.argsort(-want, kind="stable")[:k]
                order = order[want[order] > 0]
                assert np.allclose(similarity, want[order], atol=2e-9) and len(set(best.tolist()) ^ set(order.tolist())) <= 2


def test_toxicity_odd_rows(spark):
    texts = [f"{w} {x}" for w in ("vile trash", "fine day") for x in VOCAB] * 2
    docs = frame(spark, texts).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    twice = [(f"d{i}", 1, y) for i in range(len(texts)) for y in ({0, 1} if i % 10 == 0 and i % 112 < 56 else {int(i % 112 < 56)})] + [(None, 1, 1), ("d1", 1, None), ("d1", 1, 7)]
    table = spark.createDataFrame(twice, "doc_id string, quality int, toxic int")
    runs = [{(r.doc_id, r.score) for r in toxicity.score(docs.repartition(n), toxicity.fit(docs.repartition(n), table.repartition(n))).collect()} for n in (1, 3)]
    assert runs[0] == runs[1] and all((s >= 0.3) == (int(d[1:]) % 112 < 56) for d, s in runs[0])


def test_language_id(spark):
    rnd = random.Random(4)
    sounds = {"aa": ["ba", "la", "ma"], "bb": ["üt", "kö", "zsch"], "cc": ["ñi", "ció", "rre"]}
    rows = []
    for i in range(240):
        lang = ["aa", "bb", "cc"][i % 3]
        rows.append((i, " ".join("".join(rnd.choice(sounds[lang]) for _ in range(rnd.randint(1, 4))) for _ in range(30)), lang if i % 10 else None, "s", 0))
    rows += [(240, None, "aa", "s", 0), (241, "12 34 !!", "aa", "s", 0), (242, "", None, "s", 0), (None, "balama", "aa", "s", 0), (244, "世界", "aa", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit(1)).withColumn("rejected", F.lit("x"))
    got = {r.doc_id: r for r in langid.identify(docs, langid.fit(docs)).collect()}
    assert all(got[i].lang_pred == ["aa", "bb", "cc"][i % 3] and 0 <= got[i].score <= 1 for i in range(240))
    assert [got[i].lang_pred for i in (240, 241, 242)] == ["und"] * 3 and got[None].lang_pred == "aa" and got[None].held_out is False
    assert got[244].lang_pred in sounds and got[244].rejected
    none = langid.identify(docs, langid.fit(empty(spark)))
    assert {r.lang_pred for r in none.collect()} == {"und"} and langid.identify(empty(spark), langid.fit(docs)).count() == 0


def test_centroids_and_cosines(spark):
    """Vectors by the rule, cell by cell; centres are means of the texts nearest to them; the nearest centre names the language."""
    from kithline.llm.textscan import mix

    def vector(text):
        raw, n = b" " + text.encode() + b" ", Counter()
        fold = lambda b: b | 32 if chr(b).isalpha() and b < 128 else b if b >= 128 else 32
        for i in range(1, len(raw) - 1):
            if raw[i] >= 128 or chr(raw[i]).isalpha():
                code = fold(raw[i - 1]) << 16 | fold(raw[i]) << 8 | fold(raw[i + 1])
                n[int(mix(np.array([code], np.uint64))[0]) >> 52] += 1
        return n

    rnd = random.Random(11)
    texts = [" ".join(words(rnd, 12)) + (" été ñandú" if i % 2 else " The Cat") for i in range(60)]
    docs = frame(spark, texts).withColumn("lang", F.expr("if(doc_id % 2 = 1, 'x', 'y')"))
    model = langid.fit(docs)
    learnt = [i for i in range(60) if zlib.crc32(str(i).encode()) % 4 != 2]
    n = [vector(t) for t in texts]
    df = Counter(c for i in learnt for c in n[i])
    idf = np.array([np.log((len(learnt) + 1) / (df[c] + 1)) + 1 for c in range(langid.DIMENSIONS)])
    v = np.array([[np.log1p(x[c]) for c in range(langid.DIMENSIONS)] for x in n]) * idf
    v /= np.linalg.norm(v, axis=1)[:, None]
    assert model.languages == ["x", "y"] and np.allclose(model.idf, idf)
    for j, name in enumerate("xy"):
        own, centre = v[[i for i in learnt if i % 2 != j]], model.centre[model.language == j]
        nearest = (own @ centre.T).argmax(1)
        for k in range(len(centre)):
            mean = own[nearest == k].mean(0)
            assert np.allclose(centre[k], mean / np.linalg.norm(mean), atol=1e-5)
    cosine = v @ model.centre.T
    for r in langid.identify(docs, model).collect():
        assert np.isclose(r.score, cosine[r.doc_id].max(), atol=1e-5) and r.lang_pred == model.languages[model.language[cosine[r.doc_id].argmax()]]
        assert r.rejected == bool(cosine[r.doc_id].max() < model.floor["xy".index(r.lang_pred)])


# 6

FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def jaccard_brute(texts):
    sets = []
    for t in texts:
        w = SPACED.findall((t or "").translate(FOLD))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize("tight", [False, True])
def test_jaccard_join(spark, monkeypatch, tight):
    texts = corpus()
    rnd = random.Random(9)
    base = words(rnd, 200)
    for i in range(25):  # a chain of near copies, each a few words from the one before
        base = base[:]
        for _ in range(3):
            base[rnd.randrange(200)] = f"w{i}"
        texts.append(" ".join(base))
    if tight:  # regions of small blocks for every cell, no seeds to speak of, joined lists
        for k, v in (("CELL", 0), ("REGION_SETS", 5), ("HASHES", 1), ("MOST_SENT", 0), ("BLOCK_SETS", 3)):
            monkeypatch.setattr(jaccard_join, k, v)
        monkeypatch.setattr(jaccard_join.named, "__defaults__", (0,))
        monkeypatch.setattr(jaccard_join.whole_sets, "__defaults__", (0,))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(frame(spark, texts, True)).collect()}
    assert got == jaccard_brute(texts)


def test_jaccard_join_deals_crowded_cells_again(spark, monkeypatch):
    """A passage that the sketch can't tell from the rest must not send its documents to a region."""
    rnd = random.Random(4)
    passage = words(rnd, 40)
    texts = [" ".join([f"v{rnd.randrange(9999)}" for _ in range(80)] + passage + [f"v{rnd.randrange(9999)}" for _ in range(80)]) for _ in range(150)]
    texts += [t + " more" for t in texts[:20]]
    for k, v in (("CELL", 4), ("SKETCH_BITS", 6), ("SLICE_BITS", 6), ("REGION_SETS", 5)):
        monkeypatch.setattr(jaccard_join, k, v)
    seen, links = [], jaccard_join.region_links
    monkeypatch.setattr(jaccard_join, "region_links", lambda members, *a: seen.append(members.select("set").distinct().count()) or links(members, *a))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(frame(spark, texts)).collect()}
    assert got == jaccard_brute(texts)
    assert sum(seen) < 40


def test_regions_are_solved_in_lots(spark, monkeypatch):
    """Blocks of a large region copy its sets many times; a lot of blocks may copy only about as many sets as there are documents."""
    rnd = random.Random(9)
    passage = words(rnd, 40)
    texts = [" ".join([f"v{rnd.randrange(9999)}" for _ in range(20)] + passage + [f"v{rnd.randrange(9999)}" for _ in range(20)]) for _ in range(60)]
    texts += [t + " more" for t in texts[:9]]
    for k, v in (("CELL", 0), ("REGION_SETS", 5), ("DEALS", 1)):
        monkeypatch.setattr(jaccard_join, k, v)
    rows, write, classic = [], jaccard_join.written, spark._jvm.org.apache.spark.sql.classic.Dataset

    def counted(df, name="t", narrow=False):
        if name == "region-links":  # what the blocks get: the rows that the solver reads
            rows.append(classic.ofRows(spark._jsparkSession, df._jdf.queryExecution().analyzed().children().head()).count())
        return write(df, name, narrow)

    monkeypatch.setattr(jaccard_join, "written", counted)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(frame(spark, texts)).collect()}
    assert got == jaccard_brute(texts)
    assert len(rows) > 1 and max(rows) <= 3 * len(texts)


def shuffle_files(spark):
    return [f for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f]


@pytest.mark.parametrize("write", ["kithline.llm.common:written", "kithline.operators.store:kept"])
def test_written_frames_leave_no_shuffle_files(spark, write):
    import importlib
    import time

    module, name = write.split(":")
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, set_to = set(shuffle_files(spark)), spark.conf.get(key, None)
    got = getattr(importlib.import_module(module), name)(spark.range(10_000).repartition(5, "id").groupBy((F.col("id") % 7).alias("k")).count(), "t")
    for _ in range(20):
        left = set(shuffle_files(spark)) - before
        if not left:
            break
        time.sleep(0.3)
    assert not left and got.count() == 7 and spark.conf.get(key, None) in (set_to, "false")


def test_jaccard_join_odd_tables(spark):
    assert jaccard_join.join(empty(spark)).count() == 0
    text = "a b c d e f g h"
    rows = spark.createDataFrame([(5, text, None, None, 0), (5, "x y z u v w", None, None, 0), (3, "x y z u v w", None, None, 0), (9, text, None, None, 0), (None, text, None, None, 0)], DOCS)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in jaccard_join.join(rows).collect())
    assert [g[2] for g in got] == [3, 3, 3, 3, None]
    assert {r.doc_id for r in jaccard_join.distinct(rows).collect()} == {3, None}


# 7


def suffix_brute(texts, n):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + n] for b in raw for i in range(len(b) - n + 1))
    out = {}
    for d, b in enumerate(raw):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                gone[i : i + n] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[d] = (len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("options", [{}, {"group": 1}, {"most_sent": 0, "group": 2}])
def test_suffix_dedup(spark, options):
    texts = corpus()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.cut(frame(spark, texts, True), **options).collect()}
    assert got == suffix_brute(texts, 400)


def test_suffix_dedup_empty_and_sliced(spark, monkeypatch):
    assert suffix_dedup.cut(empty(spark)).count() == 0
    rnd = np.random.default_rng(3)
    text = rnd.integers(97, 123, 9000).astype(np.uint8)
    whole = suffix_dedup.anchors_of(text)
    monkeypatch.setattr(suffix_dedup, "_SLICE", 1500)
    cut = suffix_dedup.anchors_of(text)
    starts = lambda a: {(s, int(h)) for h, lo, hi in zip(a[0], a[2], a[3]) for s in range(lo, hi + 1)}
    assert starts(whole) == starts(cut) and len({s for s, _ in starts(whole)}) == 9000 - 399


# 8


def chunks_brute(t):
    lines = t.split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    out, start = [], 0
    for i in range(len(lines)):
        if (h[i] + 31 * (h[i - 1] if i else 0)) % 3 == 0 or i + 1 == len(lines):
            out.append(lines[start : i + 1])
            start = i + 1
    return out


def lines_brute(texts):
    chunks = {i: chunks_brute(t) for i, t in enumerate(texts) if t is not None}
    where = defaultdict(list)
    for i, cs in chunks.items():
        for k, c in enumerate(cs):
            if len(c) >= 2 and len("\n".join(c)) >= 40:
                where["\n".join(c)].append((i, k))
    gone = {p for ps in where.values() for p in sorted(ps)[1:]}
    return {i: "\n".join("\n".join(c) for k, c in enumerate(cs) if (i, k) not in gone) for i, cs in chunks.items()}


def test_line_dedup(spark):
    rnd = random.Random(8)
    pool = [[" ".join(words(rnd, 8)) for _ in range(rnd.randint(3, 8))] for _ in range(6)]
    texts = ["\n".join(x for _ in range(3) for x in (rnd.choice(pool) if rnd.random() < 0.6 else [" ".join(words(rnd, 6)) for _ in range(4)])) for _ in range(40)]
    texts += [None, "", "\n\n\n", texts[0], texts[0], "a\n" * 50]
    docs = frame(spark, texts, True)
    out = line_dedup.clean(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: r.text for r in out.collect()}
    want = lines_brute(texts)
    assert got == {i: want.get(i) for i in range(len(texts))} and sum(map(len, want.values())) < sum(len(t or "") for t in texts)
    assert line_dedup.report(empty(spark)).count() == 0
    counts = docs.withColumns({"n_lines": F.lit(111), "n_removed": F.lit(222), "n_chunks_removed": F.lit(333)})
    assert {tuple(r) for r in line_dedup.clean(counts).select("n_lines", "n_removed", "n_chunks_removed").collect()} == {(111, 222, 333)}
    odd = spark.createDataFrame([(None, texts[0], "x", "y", 1), (7, texts[0], "x", "y", 1)], DOCS)
    assert {r.doc_id: len(r.text) for r in line_dedup.clean(odd).collect()}[7] > 0


# 9

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination_brute(texts, items):
    out = {}
    windows = []
    for item, t in items:
        w = ALNUM.findall((t or "").translate(FOLD))
        m = min(len(w), 13)
        windows += [(item, tuple(w[i : i + m])) for i in range(len(w) - m + 1) if m]
    for d, t in enumerate(texts):
        w = ALNUM.findall((t or "").translate(FOLD))
        hit, found = set(), set()
        for item, win in windows:
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit.update(range(i, i + len(win)))
                    found.add(item)
        ids = sorted(str(i) for i in found if i is not None)
        out[d] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


def test_decontamination(spark, monkeypatch):
    rnd = random.Random(6)
    texts = corpus()
    items = [(i, " ".join(words(rnd, 25))) for i in range(6)] + [(6, "short item"), (7, ""), (8, None), (None, " ".join(words(rnd, 20))), (9, "tu" * 3), (10, items_text := " ".join(words(rnd, 13)))]
    texts += [f"{texts[i]} {items[i][1]}! tail" for i in range(6)] + ["A Short, item", items[9][1].upper(), items_text[:-3], f"{items_text} {items_text}", "z " * 500 + items[0][1]]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = contamination_brute(texts, items)
    docs = frame(spark, texts, True)
    row = lambda r: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)
    assert {r.doc_id: row(r) for r in decontaminate.judge(docs, bench).collect()} == want
    monkeypatch.setattr(decontaminate.blocks, "__defaults__", (60,))  # several blocks of items
    assert decontaminate.blocks(bench)[0] > 2
    assert {r.doc_id: row(r) for r in decontaminate.judge(docs, bench).collect()} == want
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, v in want.items() if not v[4]}
    assert decontaminate.judge(empty(spark), bench).count() == 0
    assert {r.n_hit for r in decontaminate.judge(docs, bench.limit(0)).collect()} == {0}


def test_longest_match_has_its_place(spark):
    item = " ".join(f"i{k}" for k in range(40))
    text = "p q r " + " ".join(f"i{k}" for k in range(5, 30)) + " s"
    place = lambda r: (r.longest_item_id, r.longest_first_word, r.longest_item_word, r.longest_words)
    got = decontaminate.judge(frame(spark, [text, "none", None, f"{text} {text}"]), spark.createDataFrame([(4, item)], "item_id bigint, text string")).orderBy("doc_id").collect()
    assert [place(r) for r in got] == [(4, 3, 5, 25), (None, None, None, 0), (None, None, None, 0), (4, 3, 5, 25)]
    named = decontaminate.judge(frame(spark, [text]).withColumn("doc_id", F.lit("d")), spark.createDataFrame([("b", item), ("a", item), (None, item)], "item_id string, text string")).first()
    assert (named.doc_id, named.n_items) == ("d", 2) and place(named) == ("a", 3, 5, 25)


# 10


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<p>a<p>b", "a\n\nb"), ("<ul><li>x<li>y<ul><li>z</ul></ul>", "- x\n- y\n  - z"), ("<ol start=9><li>a<li>b</ol>", "9. a\n10. b"), ("a <b>b</b>c&amp;&eacute;", "a bc&é"),
        ("<table><tr><th>N<th>V<tr><td>long<td>1</table>", "N     V\nlong  1"), ("<head><title>t</title></head>x<script>var a='<p>'</script><style>p{}</style>", "x"),
        ("<div hidden>n</div><p style='color:red; DISPLAY : none'>n</p>y", "y"), ("<pre>\n a\n  b\n</pre>c", " a\n  b\n\nc"), ("one<br>two<br><br>three", "one\ntwo\n\nthree"),
        ("<details><summary>s</summary>n<p>n</details><details open><summary>t</summary>y</details>", "s\nt\ny"), ("<!-- c --><td>cell</td>", "cell"), ("<blockquote>q</blockquote>", "  q"),
        ("<select><option>a<option>b</select>", "a\nb"), ("", ""), ("<p", ""), ("</p></div>x", "x"), ("<dl><dt>t<dd>d<dt>u</dl>", "t\n  d\nu"), ("  a \n\t b  ", "a b"),
        ("<p>a <svg class=i/> b</p>", "a b"), ("<div>x<svg/>y</div>", "xy"), ("<p>a<svg><title>t</title><path d=1 /><text x=1>v</text><g><text>w</text></g></svg>b</p>", "a v wb"),
        ("<p>n <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>tex</annotation></math> m</p>", "n x=1 m"), ("<svg><foreignObject><p>in</p></foreignObject></svg>out", "in\n\nout"),
        ("<textarea><b>a</b> &amp; c</textarea>", "<b>a</b> & c"), ("<div style='visibility:hidden'>n<span style='visibility: visible'>y</span>n</div>z", "y\nz"),
        ("<table><tr><td rowspan=2>A<td>1<tr><td>2</table>", "A  1\n   2"), ("<table><tr><td colspan=2>wide<td>c<tr><td>a<td>b<td>d</table>", "wide     c\na     b  d"),
        ("<table><tr><td rowspan=0>A<td>1<tr><td>2<tr><td>3</table>", "A  1\n   2\n   3"), ("<svg><g>", ""), ("<div>a<svg></div>b", "a\nb"), ("<svg><p>x</p>y", "x\n\ny"), ("<p>x</svg>y</math>", "xy"),
    ],
)
def test_html_layout(html, text):
    got = html_text.render(html)
    assert got.strip("\n") == text.strip("\n") or (html == "<p" and got in ("", "<p"))


def test_html_pages(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a<p>b"), (2, "u", None), (3, "u", "<div>" * 30000 + "deep"), (3, "u", "x")], "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))
    got = sorted((r.page_id, r.text, r.n_chars, r.n_lines) for r in html_text.extract(pages).collect())
    assert got == [(1, "a\n\nb", 4, 3), (2, "", 0, 0), (3, "deep", 4, 1), (3, "x", 1, 1)]
    assert html_text.extract(pages.limit(0)).count() == 0
