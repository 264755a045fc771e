"""The ten operators and the pipeline on small fixtures, against brute force."""

import collections
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from grovespark.llm import exact_dedup, language_id, lm_graph, lm_model as lm, lm_scoring, mixing, ngram_join, packing, quality_classifier, quality_rules, sharding, textops, tokens, toxicity

SF = "/root/testdata/sf0.001"
W = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{k % 977}" for k in range(30_000))
TEXTS = [None, "", " ", "\t\n ", "a", "A  b", "a b", "One two three four five", "one two three four FIVE", LONG, LONG + " end", "é ß 日本 語", "x" * 5000, "1 2 3 4 5 6", "a\u0085b c", "<|endoftext|> it's  odd\n\n text ", "same same same same same same same"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts (one longer than a slice), repeated rows, null ids, and extra columns, one of which differs by case alone."""
    rows = [(k, t, "en" if k % 2 else None, "s" if k % 3 else None, 0) for k, t in enumerate(TEXTS)]
    rows += [(3, TEXTS[3], "en", "s", 0), (None, "a b", None, None, None), (None, None, None, None, None), (90, LONG, "de", "t", 1), (91, "a b", "de", "t", 1), (92, "alpha beta " * 100_000, "en", "s", 1)]
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "text AS digest", "doc_id AS Text_", "1 AS kept", "n_chars AS TEXT")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def fold(i, n):
    return -1 if i is None else zlib.crc32(str(i).encode()) % n


# --- Text primitives ----------------------------------------------------------------------------------


def test_words_and_hashes_do_not_depend_on_place():
    texts = pa.array(TEXTS * 3)
    seen = collections.defaultdict(set)
    for s in textops.slices(texts, 2000):
        w = s.words()
        for i in range(s.n):
            want = [x.encode() for x in W.findall(s.text(i).decode())]
            own = slice(w.bounds[i], w.bounds[i + 1])
            assert [s.data[a:b].tobytes() for a, b in zip(w.starts[own], w.ends[own])] == want
            for x, h in zip(want, w.hashes()[own].tolist()):
                seen[x].add(h)
    assert all(len(h) == 1 for h in seen.values()) and len({min(h) for h in seen.values()}) == len(seen)


def test_ids_are_those_of_the_tokenizer(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = np.random.default_rng(1)
    marks = ["<|endoftext|>", "a <|endoftext|> b", "x<|endoftext|><|endoftext|>\ny", "<|endoftext|", "w <|END|> w", "a. <|endoftext|>. b"]
    texts = marks + [x or "" for x in TEXTS] + ["".join(rng.choice(list("ab.,'s \n\t1é "), 12)) for _ in range(300)] + [r.text for r in docs.limit(60).collect()]
    code, got = tokens.coder(tokens.default_path()), []
    for s in textops.slices(pa.array(texts), 5000):
        ids, n = code.encode(s)
        got += np.split(ids, np.cumsum(n)[:-1])
    assert [x.tolist() for x in got] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


# --- 1, 5: classifiers -----------------------------------------------------------------------------------


def test_network_gradients_lower_the_loss_and_temperature_calibrates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, quality_classifier.WIDTH))
    y = (x[:, 0] + x[:, 1] > 0).astype(float)
    net = quality_classifier.fit(x, y)
    assert ((net.scores(x) > 0.5) == y).mean() > 0.95 and 0.25 <= net.temperature <= 8
    assert quality_classifier.fit(x[:0], y[:0]).scores(x[:1]) == pytest.approx(0.5)


def test_classifiers_learn_and_cover_odd_rows(spark, docs, labels, odd, none):
    for run, column, least in ((quality_classifier.classify, "quality", 0.9), (toxicity.toxicity, "toxic", 0.85)):
        got = run(docs, labels).toPandas()
        assert len(got) == docs.count() and got.score.between(0, 1).all()
        assert (got.held_out == [fold(i, 5) == 0 for i in got.doc_id]).all()
        m = got.merge(labels.toPandas(), on="doc_id")
        assert (m.predicted == m[column]).mean() >= least
        out = run(odd, labels).toPandas()
        assert len(out) == odd.count() and out.score.between(0, 1).all()
        assert run(none, labels).count() == 0
        assert run(odd, labels.limit(0)).count() == odd.count()


def test_word_vectors_pools_and_scores_by_brute_force(spark, odd):
    q, size, dim = quality_classifier, quality_classifier.VOCAB, quality_classifier.DIM
    texts = [r.text[:400] if r.text else r.text for r in odd.collect()]
    data = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    key = {}  # the two row keys of a word, by the word alone
    for w in {w for t in texts for w in W.findall(t or "")}:
        key[w] = [int(k[0]) for k in q.rows_of(next(textops.slices(pa.array([w]))))[1]]
    want = np.zeros((size, dim))
    for t in texts:
        own = W.findall(t or "")
        for a, b in ((a, b) for a in range(len(own)) for b in range(len(own)) if 0 < abs(a - b) <= q.WINDOW):
            for row in key[own[a]]:
                for k in key[own[b]]:
                    want[row % size, (k >> 33) % dim] += 1 - 2 * (k >> 32 & 1)
    got = q.word_vectors(data)
    norm = np.linalg.norm(want, axis=1, keepdims=True)
    assert np.abs(got - want / np.maximum(norm, 1e-9)).max() < 1e-6
    rng = np.random.default_rng(1)
    net = q.Network(rng.normal(size=q.WIDTH), rng.random(q.WIDTH), rng.normal(size=(q.WIDTH, q.HIDDEN)), rng.normal(size=q.HIDDEN), rng.normal(size=q.HIDDEN), 0.3, 1.7)
    x = np.concatenate([q.pooled(s, got) for s in textops.slices(pa.array(texts), 300)])
    for t, p, score in zip(texts, x, net.scores(x)):
        own = W.findall(t or "")
        parts, likes = [], []
        for k in (0, 1):
            v = np.array([got[key[w][k] % size] for w in own]).reshape(-1, dim).astype(float)
            parts += [v.mean(0), v.std(0)] if own else [np.zeros(dim)] * 2
            likes.append(sum(a @ b for a, b in zip(v, v[1:])) / max(len(own) - 1, 1))
        full = np.concatenate([*parts, likes])
        assert np.abs(full - p).max() < 1e-3
        hidden = [math.tanh(sum((full[i] - net.shift[i]) * net.scale[i] * net.w1[i, j] for i in range(q.WIDTH)) + net.b1[j]) for j in range(q.HIDDEN)]
        assert score == pytest.approx(1 / (1 + math.exp(-(np.dot(hidden, net.w2) + net.b2) / net.temperature)), abs=2e-3)


def test_noisy_or_by_brute_force(spark, odd, labels, monkeypatch):
    rng = np.random.default_rng(2)
    weights = rng.normal(0, 1, 1 << toxicity.BITS).astype(np.float32)
    monkeypatch.setattr(toxicity, "learn", lambda *_: (weights, -3.0))
    texts = [r.text[:2000] if r.text else r.text for r in odd.collect()] + ["One two. Three!\nfour five\n\nsix? (seven), eight", "no end.\nnext", "a.b c."]
    data = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    logit = {}
    for w in {w for t in texts for w in W.findall(t or "")}:
        logit[w] = float(sum(weights[f[0]] for f in toxicity.Sentences(next(textops.slices(pa.array([w])))).features()))
    got = {r.doc_id: r for r in toxicity.toxicity(data, labels).collect()}
    for k, t in enumerate(texts):
        sentences, before = [], None
        for m in W.finditer(t or ""):
            if before is None or before.group()[-1] in ".!?" or t[m.start() - 1] == "\n":
                sentences.append([])
            sentences[-1].append(m)
            before = m
        chance = [1 / (1 + math.exp(-max(-40, min(40, -3.0 + sum(logit[m.group()] for m in s))))) for s in sentences]
        assert got[k].score == pytest.approx(1 - math.prod(1 - p for p in chance), abs=1e-5)
        spans = [(len(t[: s[0].start()].encode()), len(t[: s[-1].end()].encode())) for s, p in zip(sentences, chance) if p >= 0.5]
        assert [(o.start, o.end) for o in got[k].offending] == spans


def test_toxicity_locates_the_sentence(spark):
    rng = np.random.default_rng(3)
    word = lambda: "w" + str(rng.integers(60))
    rows, marks = [], []
    for i in range(240):
        s = [" ".join(word() for _ in range(8)) + "." for _ in range(5)]
        if i % 3 == 0:
            s[2] = "you rotten " + s[2]
        rows.append((i, " ".join(s)))
        marks.append((i, int(i % 3 == 0)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert all(got[i].predicted == t for i, t in marks)
    for i, t in rows[::3]:
        assert ["rotten" in t.encode()[s.start : s.end].decode() for s in got[i].offending] == [True]


# --- 2: language model ---------------------------------------------------------------------------------


def test_attention_gradients_and_whole_probabilities():
    rng = np.random.default_rng(0)
    ids, sizes = rng.integers(0, 3000, 90), np.array([0, 5, 50, 35])
    known = lm.ids_of(np.bincount(rng.zipf(1.3, 20000) % 4000, minlength=lm.VOCAB))
    counts = np.zeros((lm.INPUTS, lm.COLUMNS), np.int64)
    np.add.at(counts, (known.row[ids[:-1]], known.column[ids[1:]]), 3)
    t = lm.tables(known, counts)
    p = {k: v.astype(np.float64) for k, v in lm.start().items()}
    p["out"] = rng.normal(0, 0.3, p["out"].shape)
    inputs, aims, of = lm.windows(sizes)
    text = lm.padded(ids, sizes)
    rows = known.row[text]
    rows[0] = lm.PAD
    rows, cls, valid = rows[inputs], t.cls[text[aims]], aims > 0
    assert sorted(aims[aims > 0].tolist()) == sorted(set(aims[aims > 0].tolist())) and valid.sum() == 90 + 4  # each token once
    pairs = t.pairs.astype(np.float64)
    loss = lambda: -(lm.log_classes(p, pairs, rows, cls) * valid).sum() / valid.sum()
    grad = lm.gradients(p, pairs, rows, cls, valid)
    for k in lm.NAMES:
        for _ in range(3):
            at = tuple(rng.integers(n) for n in p[k].shape) if k != "embed" else (int(rng.choice(rows[rows != lm.PAD])), int(rng.integers(lm.WIDTH)))
            keep = p[k][at]
            p[k][at] = keep + 1e-5
            up = loss()
            p[k][at] = keep - 1e-5
            down = loss()
            p[k][at] = keep
            assert grad[k][at] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-7), k
    # By the definition: softmax of masked scores, and probabilities of all ids that sum to 1.
    x = p["embed"][rows[2]] + p["place"]
    k, v = np.split(x @ p["wkv"], 2, axis=1)
    for j in (0, 5, lm.STRIDE - 1):
        at = lm.LEAD + j
        seen = [i for i in range(at + 1) if rows[2][i] != lm.PAD]
        w = np.exp((x[at] @ p["wq"]) @ k[seen].T / math.sqrt(lm.WIDTH))
        h = np.tanh(x[at] + (w / w.sum()) @ v[seen] @ p["wo"])
        z = t.pairs[rows[2][at]] + h @ p["out"]
        own = z - np.log(np.exp(z).sum())
        assert lm.log_classes(p, pairs, rows[2:3], cls[2:3])[0, j] == pytest.approx(own[cls[2, j]])
        every = np.exp(own[t.cls] + t.share + t.inner[rows[2][at], np.minimum(known.column, lm.HEAD)])
        assert every.sum() == pytest.approx(1, abs=1e-4)


def _batch(rng, texts: int):
    """Rows, classes and valid targets of windows of random texts, some of them empty, and bigram logits."""
    sizes = rng.integers(0, 60, texts)
    sizes[::5] = 0
    inputs, aims, _ = lm.windows(sizes)
    rows = np.append(lm.PAD, rng.integers(0, lm.PAD, int((sizes + 2).sum())))
    return rows[inputs], rng.integers(0, lm.CLASSES, aims.shape), aims > 0, rng.normal(0, 2, (lm.INPUTS + 1, lm.CLASSES)).astype(np.float32)


def test_graphs_compute_what_the_model_defines():
    rng = np.random.default_rng(4)
    p = lm.start()
    p["out"] = rng.normal(0, 0.3, p["out"].shape).astype(np.float32)
    double = {k: v.astype(np.float64) for k, v in p.items()}
    for texts in (1, 3, 40):  # the first is one window, nearly all padding
        rows, cls, valid, pairs = _batch(rng, texts)
        want, got = lm.gradients(double, pairs.astype(np.float64), rows, cls, valid), lm_graph.gradients(p, pairs, rows, cls, valid)
        assert set(got) == set(lm.NAMES)
        for k in lm.NAMES:
            assert got[k] == pytest.approx(want[k], rel=1e-3, abs=1e-6), k
        logs = lm_graph.log_classes(p, pairs, rows, cls)
        assert logs[valid] == pytest.approx(lm.log_classes(double, pairs.astype(np.float64), rows, cls)[valid], abs=1e-4)
        assert (logs == lm_graph.log_classes(p, pairs, rows, cls)).all()


def test_adam_by_the_definition():
    rng = np.random.default_rng(5)
    adam, p = lm.Adam(lm.start(), 4e-3), {k: v.astype(np.float64) for k, v in lm.start().items()}
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    for step in range(1, 8):
        g = {k: rng.normal(0, 1e-3, x.shape) * (rng.random(x.shape) < 0.5) for k, x in p.items()}
        adam.move({k: x.astype(np.float32) for k, x in g.items()})
        for k, x in g.items():
            m[k], v[k] = 0.9 * m[k] + 0.1 * x, 0.99 * v[k] + 0.01 * x * x
            p[k] -= 4e-3 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        assert all(np.abs(adam.p[k] - p[k]).max() < 1e-5 for k in lm.NAMES)


def test_scores_come_from_the_graphs_and_agree_with_the_plain_sums(monkeypatch):
    """op2 went past its CPU budget on numpy's sums of windows; none of a text's score may come from these any more, and it stays the same."""
    rng = np.random.default_rng(6)
    sizes = np.append(rng.integers(0, 900, 30), [0, 1, lm.STRIDE - 1, lm.STRIDE])
    ids = rng.zipf(1.3, int(sizes.sum())) % 4000
    known = lm.ids_of(np.bincount(ids, minlength=lm.VOCAB))
    counts = np.zeros((lm.INPUTS, lm.COLUMNS), np.int64)
    np.add.at(counts, (known.row[ids[:-1]], known.column[ids[1:]]), 1)
    tables, params = lm.tables(known, counts), lm.start()
    params["out"] = rng.normal(0, 0.3, params["out"].shape).astype(np.float32)
    with monkeypatch.context() as m:
        m.setattr(lm, "attend", None)
        got = lm_scoring.log_scores(known, tables, params, ids, sizes)
    monkeypatch.setattr(lm_scoring, "lm_graph", lm)
    assert got == pytest.approx(lm_scoring.log_scores(known, tables, params, ids, sizes), rel=1e-5)


def test_attention_beats_bigrams_on_held_out_documents(spark):
    """The score of every document is what its windows say; without attention it is clearly worse."""
    data = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    chunks = lm_scoring.coded(data, tokens.default_path())
    known, tables, params = lm_scoring.train(chunks)
    again = lm_scoring.train(chunks)[2]
    assert all((params[k] == again[k]).all() for k in lm.NAMES)
    none = params | {"out": np.zeros_like(params["out"])}
    sums, many = np.zeros(2), 0
    for r in chunks.select("docs", "sizes", "ids").collect():
        held = np.frombuffer(r.docs, np.int64).reshape(4, -1)[2] == 1
        sizes = np.frombuffer(r.sizes, np.int32).astype(np.int64)
        ids = np.frombuffer(r.ids, np.uint16).astype(np.int64)[np.repeat(held, sizes)]
        sums += [lm_scoring.log_scores(known, tables, x, ids, sizes[held]).sum() / math.log(10) for x in (params, none)]
        many += len(ids) + int(held.sum())
    with_attention, bigrams = sums / many
    assert with_attention > bigrams + 0.02, (with_attention, bigrams)


@pytest.mark.parametrize("which", ["docs", "odd", "none"])
def test_base_scores_by_brute_force(which, request):
    data = request.getfixturevalue(which)
    rows = [(r.doc_id, W.findall(low(r.text)) + [None]) for r in data.collect()]
    train = collections.Counter(t for i, own in rows if fold(i, 7) != 2 for t in own)
    n, v = sum(train.values()), len(train)
    want = sorted((str(i), len(t), sum(train[x] > 0 for x in t), n, round(sum(math.log10((train[x] + 1) / (n + v + 1)) for x in t), 4)) for i, t in rows)
    got = [r for r in lm_scoring.score(data).collect()]
    ids = lambda i: "None" if i is None or i != i else str(int(i))
    for g, w in zip(sorted((ids(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), want):
        assert g[:4] == w[:4] and g[4] == pytest.approx(w[4], abs=1e-3)
    assert len(got) == len(want) and all(r.score < 0 for r in got)


# --- 3, 4: duplicates -------------------------------------------------------------------------------------


def test_cuckoo_index_inserts_deletes_and_resizes():
    index, live = exact_dedup.CuckooIndex(4), {}
    rng = np.random.default_rng(0)
    for k in range(3000):
        digest = hashlib.sha256(str(int(rng.integers(900))).encode()).digest()
        if rng.random() < 0.3:
            assert index.delete(digest) == (live.pop(digest, None) is not None)
        else:
            index.insert(digest, k)
            live[digest] = k
    assert dict(index.items()) == live and index.resizes > 0 and all(index.get(d) == v for d, v in live.items())
    assert index.get(b"\0" * 32) is None


def test_exact_dedup_by_sql_and_on_odd_rows(docs, odd, none):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    cols = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, exact_dedup.exact_dedup(docs).select(cols).collect())) == sorted(con.sql(f"SELECT {', '.join(cols)} FROM ({exact_dedup.OP3_SQL})").fetchall())
    got = exact_dedup.exact_dedup(odd).collect()
    body = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    rows = odd.collect()
    groups = collections.Counter(body(r.text) for r in rows)
    assert len(got) == len(rows) and sum(r.kept for r in got) == len(groups)
    assert {r.text_sha256: r.group_size for r in got} == {hashlib.sha256(b.encode()).hexdigest(): n for b, n in groups.items()}
    assert exact_dedup.exact_dedup(none).count() == 0


def brute_classes(rows):
    sets = []
    for _, t in rows:
        w = W.findall(low(t))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    ids = collections.defaultdict(list)
    for k, (i, _) in enumerate(rows):
        ids[find(k)].append(i)
    least = {k: min((i for i in v if i is not None), default=None) for k, v in ids.items()}
    return sorted((str(i), len(sets[k]), str(least[find(k)] if sets[k] else i)) for k, (i, _) in enumerate(rows))


def classes(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngram_join.jaccard_classes(df).collect())


def test_jaccard_classes_by_brute_force(spark, odd, none):
    rng = np.random.default_rng(4)
    rows, base = [], [[f"b{g}_{k}" for k in range(60)] for g in range(3)]
    passage = [f"p{k}" for k in range(40)]
    for i in range(130):  # near copies around the threshold, shared passages, short and odd texts
        g = i % 4
        if g < 3:
            w = list(base[g])
            for k in rng.choice(60, int(rng.integers(0, 5)), replace=False):
                w[k] = f"x{i}_{k}"
            w = w[: int(rng.integers(45, 61))] if i % 5 == 0 else w
        else:
            w = passage + [f"o{i % 7}_{k}" for k in range(int(rng.integers(3, 14)))]
        rows.append((i, " ".join(w)))
    data = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_classes(rows)
    assert classes(data) == want
    keep = ngram_join.STARS, ngram_join.FREQUENT, ngram_join.BLOCK, ngram_join.HOT
    try:  # pairs of frequent shingles, with and without the last step alone, in small blocks, with hot sets
        ngram_join.FREQUENT, ngram_join.BLOCK, ngram_join.HOT = 3, 5, 0.02
        for ngram_join.STARS in (0, 2):
            assert classes(data) == want
        ngram_join.FREQUENT = 1  # no single shingles at all
        out, links = ngram_join.classes_and_links(data)
        assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in out.collect()) == want
        assert not any(r.single for x in links for r in x.collect()) and sum(x.count() for x in links) > 50
    finally:
        ngram_join.STARS, ngram_join.FREQUENT, ngram_join.BLOCK, ngram_join.HOT = keep
    assert classes(odd) == brute_classes([(r.doc_id, r.text) for r in odd.collect()])
    assert classes(none) == []


def test_similar_sets_share_a_key():
    rng = np.random.default_rng(5)
    met = single = 0
    for _ in range(4000):
        n = int(rng.integers(1, 200))
        tokens = np.sort(rng.choice(1 << 40, n + 80, replace=False)).astype(np.uint64)  # in the order of all sets
        often = np.arange(len(tokens)) >= rng.choice([0, 3, len(tokens) // 9, len(tokens)])  # the last ones
        a = np.sort(rng.choice(len(tokens), n, replace=False))
        b = np.sort(np.concatenate([a[rng.random(n) < 0.9], rng.choice(np.setdiff1d(np.arange(len(tokens)), a), int(rng.integers(0, 10)), replace=False)]))
        common = len(np.intersect1d(a, b))
        if 100 * common >= 75 * (len(a) + len(b) - common) and not np.array_equal(a, b):  # equal sets are one node
            (ka, ra, sa), (kb, rb, sb) = (ngram_join.set_keys(len(x), tokens[x], often[x]) for x in (a, b))
            both, i, j = np.intersect1d(ka, kb, return_indices=True)
            assert (np.minimum(ra[i], rb[j]) >= common).any()
            met, single = met + 1, single + bool((i < sa).any())
            assert len(ka) <= 9 * (n // 4 + 4)
    assert met > 1000 and met - single > 200


# --- 6, 7, 9 -----------------------------------------------------------------------------------------------


def jump_one(key, n):
    b, j = -1, 0
    key %= 1 << 64
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_hash_and_slots(docs, odd, none):
    keys = np.array([0, 1, -5, 12345, 2**63 - 1, -(2**63)])
    assert sharding.jump(keys, 40).tolist() == [jump_one(int(k), 40) for k in keys]
    for data in (docs, odd):
        got = sharding.shard(data).toPandas()
        rows = data.collect()
        assert len(got) == len(rows) and sorted(got["size"]) == sorted(len((r.text or "").encode()) + 16 for r in rows)
        assert sorted(got.text_crc32) == sorted(zlib.crc32((r.text or "").encode()) for r in rows)
        assert all(sorted(s) == list(range(len(s))) for _, s in got.groupby("shard").slot)
        moved = got[got.shard != got.grown_shard]
        assert (moved.grown_shard == 40).all()
    assert sharding.shard(none).count() == 0


def test_quality_counts_by_brute_force(docs, labels, odd, none):
    for data in (docs, odd):
        rows = {}
        for r in data.collect():
            t = r.text or ""
            w = W.findall(t)
            runs = collections.Counter(zip(w, w[1:], w[2:]))
            covered = {k + j for k in range(len(w) - 2) if runs[tuple(w[k : k + 3])] > 1 for j in range(3)}
            lines = [x for x in t.split("\n") if W.search(x)]
            bad = len(w) < 50 or 100 * len(covered) > 50 * len(w)
            rows[r.doc_id, t] = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), bad)
        got = quality_rules.quality_rules(data, labels.where("quality = 1"), carry=True).collect()
        assert len(got) == data.count()
        for r in got:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == rows[r.doc_id, r.document["_c1"] or ""]
            assert r.kept == (not r.base_failed and r.llr >= quality_rules.THRESHOLD)
    m = quality_rules.quality_rules(docs, labels.where("quality = 1")).toPandas().merge(labels.toPandas(), on="doc_id")
    assert m[(m.quality == 1) & ~m.base_failed].kept.all() and not m[m.quality == 0].kept.any()
    assert quality_rules.quality_rules(none, labels.limit(0)).count() == 0


def ppm(texts):
    """Nats of a byte after up to three others, by the definition: counts, escapes, exclusion."""
    seen = collections.defaultdict(collections.Counter)
    for t in texts:
        wide = b"\n\n\n" + t.encode()
        for k in range(3, len(wide)):
            for n in range(4):
                seen[wide[k - n : k]][wide[k]] += 1

    def prob(context, byte):
        own = seen.get(context)
        if own is None:
            return prob(context[1:], byte) if context else 1 / 256
        escape = len(own) if len(own) < 256 else 0
        total = sum(own.values()) + escape
        if byte in own:
            return own[byte] / total
        below = (lambda c: prob(context[1:], c)) if context else (lambda c: 1 / 256)
        return escape / total * below(byte) / (1 - sum(below(c) for c in own))

    return lambda t: -sum(math.log(prob((b"\n\n\n" + t)[k : k + 3], c)) for k, c in enumerate(t))


def test_code_lengths_by_brute_force(spark, odd, docs):
    rows = [(r.doc_id, r.text and r.text[:300], r.lang) for r in docs.limit(40).collect()] + [(r.doc_id, r.text and r.text[:300], r.lang) for r in odd.collect()]
    langs = sorted({x for _, _, x in rows if x})
    cost = {x: ppm([t for i, t, y in rows if x == y and t and fold(i, 4) != 2]) for x in langs}
    want = sorted((str(i), t or "", min((cost[x]((t or "").encode()), x) for x in langs)) for i, t, _ in rows)
    data = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for entries in (language_id.ENTRIES, 700):
        parts = language_id.turns(language_id.context_counts(data.where("lang IS NOT NULL AND text <> ''").select("text", "lang"), langs), len(langs), entries)
        assert np.sum(parts, axis=0).tolist() == np.ones((len(langs), 256)).tolist() and (len(parts) == 1) == (entries > 700)
        out = language_id.language_id(data, entries)
        got = sorted((str(r.doc_id), r.code_length, r.lang_pred) for r in out.collect() if r.code_length is not None)
        near = sorted((i, c, x) for i, t, (c, x) in want if any(ch.isalpha() for ch in t))
        assert [(i, x) for i, _, x in got] == [(i, x) for i, _, x in near]
        assert [c for _, c, _ in got] == pytest.approx([c for _, c, _ in near], rel=1e-4, abs=1e-3)


def test_codes_do_not_depend_on_pieces():
    s = next(textops.slices(pa.array(["ab", "", "cdefgh", None, "i"])))
    whole = language_id.codes(s)
    assert whole.tolist() == [int.from_bytes(x, "big") for x in (b"\n\n\na", b"\n\nab", b"\n\n\nc", b"\n\ncd", b"\ncde", b"cdef", b"defg", b"efgh", b"\n\n\ni")]
    assert np.concatenate([language_id.codes(s, k, k + 1) for k in range(len(s.data))]).tolist() == whole.tolist()


def test_languages(docs, odd, none):
    got = language_id.language_id(docs).toPandas().merge(docs.toPandas()[["doc_id", "lang"]], on="doc_id")
    held = got[got.held_out]
    assert len(got) == docs.count() and (held.lang_pred == held.lang).mean() > 0.95 and got.score.between(0, 1).all()
    out = language_id.language_id(odd).collect()
    text = {(r.doc_id, r.text) for r in odd.collect()}
    assert len(out) == len(odd.collect()) and all(r.lang_pred == "und" for r in out if r.doc_id in (0, 1, 2, 3, 13)) and text
    assert language_id.language_id(none).count() == 0 and {r.lang_pred for r in language_id.language_id(odd.drop("lang")).collect()} == {"und"}


# --- 8, 10 -------------------------------------------------------------------------------------------------


def test_mixing(spark, docs, odd, none):
    assert mixing.targets([10, 100, 1000], [3.0, 1.0, 2.0]) == pytest.approx([20, 200, 1445])
    assert sorted(mixing.permuted(np.arange(1000), 1000, 9).tolist()) == list(range(1000))
    image = mixing.permuted(np.arange(77), 77, 5)
    assert [mixing.place_of(int(x), 77, 5) for x in image] == list(range(77))
    tiny = spark.createDataFrame([(k, "w " * n, "en", s, n) for k, (s, n) in enumerate([("a", 6), ("b", 40), ("c", 100), ("d", 40_000), ("e", 0), ("f", 1), ("c", 29)])], SCHEMA)
    for data in (docs, odd, tiny):
        (out, slots), rows = mixing.mix(data), data.collect()
        got = out.toPandas()
        assert len(got) == len(rows) and sorted(got["size"]) == sorted(len(W.findall(r.text or "")) for r in rows)
        assert (got.taken <= 2 * got["size"]).all() and (got.taken >= 0).all()
        by = got.groupby("source", dropna=False).agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"), own=("size", "sum"))
        assert (by["size"] == by.own).all() and ((by.taken - by.target).abs() <= 0.5).all()
        again = mixing.mix(data)[0].toPandas()
        assert sorted(map(str, got.values.tolist())) == sorted(map(str, again.values.tolist()))
        # Slot by slot: each takes a block's first words from the documents that hold them.
        slot = slots.toPandas()
        taken = collections.Counter()
        for no, own in got[got["size"] > 0].groupby("source_no"):
            words = np.zeros(int(own["size"].sum()), int)
            for x in slot[slot.source_no == no].itertuples():
                words[x.block * mixing.BLOCK : x.block * mixing.BLOCK + x.words] += 1
                assert x.held == len(words[x.block * mixing.BLOCK :][: mixing.BLOCK]) >= x.words > 0
            assert words.max() <= 2 and sorted(slot[slot.source_no == no].slot) == list(range((slot.source_no == no).sum()))
            for r in own.itertuples():
                taken[no, r.first] = words[r.first : r.first + r.size].sum()
        assert all(taken[r.source_no, r.first] == r.taken for r in got[got["size"] > 0].itertuples())
        assert (slot.groupby("out_shard").size().sort_index()[:-1] == mixing.SHARD).all()
    assert mixing.mix(none)[0].count() == 0


def test_shards_are_drawn_alike_in_any_range():
    totals = np.array([5, 0, 70_000, 1, 130_000, 9999])
    whole = list(mixing.draw(totals, 4096, 0, 10**9))
    assert len(whole) == -(-int(totals.sum()) // 4096) and (sum(x[1] for x in whole) == totals).all()
    at = np.zeros(6, np.int64)
    for k, (shard, many, before) in enumerate(whole):
        assert shard == k and (before == at).all() and (many.sum() == 4096 or k == len(whole) - 1)
        at += many
    part = list(mixing.draw(totals, 4096, 7, 11))
    assert [(s, m.tolist(), b.tolist()) for s, m, b in part] == [(s, m.tolist(), b.tolist()) for s, m, b in whole[7:11]]
    spread = np.array([x[1][2] for x in whole[:-1]])  # a multinomial varies by the root of its mean
    assert 0.5 < spread.std() / math.sqrt(4096 * 1 / 3 * 2 / 3) < 1.6
    huge = [next(iter(mixing.draw(np.array([3 * 10**11, 10**11, 7]), 4096, s, s + 1))) for s in (0, 10**7, 9 * 10**7)]
    assert all(m.sum() == 4096 and b.sum() == s * 4096 for s, m, b in huge)


def test_packing_round_trip(docs, odd, none):
    code = tokens.coder(tokens.default_path())
    for data in (docs, odd):
        rows = data.collect()
        got = packing.pack(data).toPandas()
        want = []
        for r in rows:
            ids, _ = code.encode(next(textops.slices(pa.array([r.text], pa.string()))))
            ids = ids.tolist() + [2]
            head = (len(ids) - 1) % 1024 + 1
            cuts = [0, *range(head, len(ids) + 1, 1024)]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                want.append((str(r.doc_id), k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
        ids = ["None" if i != i or i is None else str(int(i)) for i in got.doc_id]
        assert sorted(zip(ids, got.piece, got.start, got.length, got.ids_crc32)) == sorted(want)
        for _, s in got.sort_values("offset").groupby("sequence_id"):
            assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 1024
        assert got.sequence_id.nunique() <= math.ceil(got.length.sum() / 1024) * 1.02 + 2
    assert packing.pack(none).count() == 0


def test_plans_use_every_piece_once():
    rng = np.random.default_rng(0)
    for _ in range(20):
        h = np.bincount(rng.integers(1, 65, 300), minlength=65)
        used = np.zeros(65, int)
        for items, n in packing.best_plan(h):
            assert sum(items) <= 64
            for x in items:
                used[x] += n
        assert (used == h).all()
    assert packing.plan(np.bincount([40, 14, 6, 4], minlength=65)) == [((40, 14, 6, 4), 1)]


# --- The pipeline ------------------------------------------------------------------------------------------


def test_pipeline_by_brute_force(spark, labels):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept, stages = docs, dict(corpus_pipeline.STAGES)
    rows = {r.doc_id: r.text for r in docs.collect()}
    kept = stages["quality_rules"](spark, kept, SF)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert ids == {r.doc_id for r in quality_rules.quality_rules(docs, labels.where("quality = 1")).where("kept").collect()}
    kept = stages["exact_dedup"](spark, kept, SF)
    first = {}
    for i in sorted(ids):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", rows[i]), i)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(first.values())
    kept = stages["ngram_jaccard_join"](spark, kept, SF)
    want = [int(i) for i, _, c in brute_classes([(i, rows[i]) for i in sorted(first.values())]) if i == c]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)
    # Copies of whole documents: the whole part of taken / size, the rest drawn so that a source's words are what the mix takes.
    mixed = stages["mixing"](spark, kept, SF)
    times = collections.Counter(r.doc_id for r in mixed.collect())
    gap, most = collections.Counter(), collections.Counter()
    for r in mixing.mix(kept)[0].collect():
        n = times.pop(r.doc_id, 0)
        assert (r.taken == 0 and n == 0) if not r["size"] else r.taken // r["size"] <= n <= -(-r.taken // r["size"])
        gap[r.source] += n * r["size"] - r.taken
        most[r.source] = max(most[r.source], r["size"])
    assert not times and all(abs(gap[s]) <= 2 * most[s] for s in gap)
    out = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.piece, r.length) for r in out.collect()) == sorted((r.doc_id, r.piece, r.length) for r in packing.pack(mixed).collect())


def test_stages_tell_rows_apart(spark):
    """Rows that share an id, null ids, and a column that differs from another by case alone."""
    rng = np.random.default_rng(6)
    text = lambda n: " ".join(f"t{x}" for x in rng.integers(0, 10**6, n))
    one, two = text(60), text(60)
    rows = [(1, one), (1, two), (None, one + " tail"), (None, two + " end"), (None, text(60)), (5, text(60)), (5, "x " + one), (7, None), (7, ""), (None, None)]
    data = spark.createDataFrame([(i, t, "en", "s", k) for k, (i, t) in enumerate(rows)], SCHEMA).selectExpr("*", "n_chars AS N_Chars")
    stages = dict(corpus_pipeline.STAGES)
    out = stages["ngram_jaccard_join"](spark, data, SF)
    assert out.columns == data.columns
    assert sorted(r[4] for r in out.collect()) == [0, 1, 4, 5, 7, 8, 9]  # of a class the smallest id; texts without words stay
    mixed = collections.Counter(r[4] for r in stages["mixing"](spark, data, SF).collect())
    sizes = {k: len(W.findall(t or "")) for k, (_, t) in enumerate(rows)}
    assert abs(sum(sizes[k] * n for k, n in mixed.items()) - 1.5 * sum(sizes.values())) <= 62 and all(n <= 2 and sizes[k] for k, n in mixed.items())
    assert stages["best_fit_packing"](spark, data, SF).count() == len(rows)


def test_dedup_stage_with_repeated_rows(spark, odd):
    out = dict(corpus_pipeline.STAGES)["exact_dedup"](spark, odd, SF)
    assert out.columns == odd.columns
    assert out.count() == len({re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in odd.collect()})


def test_mixing_stage_meets_targets_with_long_documents(spark):
    rng = np.random.default_rng(1)
    hot = [("s01", int(n)) for n in rng.integers(200, 3000, 60)]
    rows = [(k, s, n) for k, (s, n) in enumerate(hot + [(f"s{i:02d}", int(n)) for i in range(20) if i != 1 for n in rng.integers(100, 2300, 10)])]
    data = spark.createDataFrame([(k, "w " * n, "en", s, 2 * n) for k, s, n in rows], SCHEMA)
    want = {r.source: r.target for r in mixing.mix(data)[0].select("source", "target").distinct().collect()}
    sizes = {s: [n for _, x, n in rows if x == s] for s in want}
    assert want["s01"] < 0.4 * sum(sizes["s01"])
    got = collections.defaultdict(list)
    for r in dict(corpus_pipeline.STAGES)["mixing"](spark, data, SF).collect():
        got[r.source].append(r.n_chars // 2)
    for s, goal in want.items():
        assert abs(sum(got[s]) - goal) <= 1.5 * max(sizes[s]), s
    assert any(n >= 1500 for n in got["s01"])


def test_every_window_moves_the_weights_once(spark):
    for many in (0, 1, 2, 65, 1000):
        both = np.concatenate([lm_scoring.turns(many, 7, 3, t) for t in range(lm_scoring.ROUNDS)])
        assert sorted(both.tolist()) == list(range(many))
    # A number is a subword or two, and all windows but those of the first batch move the rows of their inputs.
    data = spark.createDataFrame([(k, str(k), "en", "s", 0) for k in range(600)], SCHEMA).coalesce(1)
    chunks = lm_scoring.coded(data, tokens.default_path())
    _, _, params = lm_scoring.train(chunks)
    assert (params["embed"] != lm.start()["embed"]).any(1).sum() > 300


def test_sparse_counts_round_trip():
    at, many = np.array([3, 900, 2**31]), np.array([5, 7 * 2**31 + 2, 2**33])
    got = lm_scoring._dense(np.frombuffer(lm_scoring._sparse(at, many), np.uint8))
    assert got[0].tolist() == at.tolist() and got[1].tolist() == many.tolist()


def test_frequent_ids_have_rows_and_bigrams_of_their_own():
    known = lm.ids_of(np.arange(lm.VOCAB, 0, -1))
    assert len(set(known.row[:1900].tolist())) == 1900 and len(set(known.column[:2000].tolist())) == 2000
    assert known.column.max() == lm.COLUMNS - 1 and known.row.max() == lm.INPUTS - 1 and known.rank[lm.END] == 0


def test_sums_of_three_are_indexed_under_counts():
    # 75 longer first lengths have no exact complement.
    h = np.bincount([500, 300, 120, 104, *range(421, 496)], minlength=1025)
    assert ((500, 300, 120, 104), 1) in packing.plan(h)
    # The index agrees with its counts after any consumption.
    rng = np.random.default_rng(2)
    index = packing.SumIndex(np.bincount(rng.integers(1, 65, 90), minlength=65))
    while index.h.any():
        items = [int(x) for x in rng.choice(np.flatnonzero(index.h), 3)]
        if index.has(items):
            assert index.take(items) > 0
        else:
            index.take(items[:1])
        have = np.flatnonzero(index.h)
        for s in range(65):
            pairs = [(int(a), s - int(a)) for a in have if 2 * a >= s > a and index.h[s - a]]
            assert index.live[s] == len(pairs)
            exact = [p for p in pairs if p[0] != p[1] or index.h[p[0]] > 1]
            assert index.pair(s, []) == (list(max(exact)) if exact else None)
