"""Each operator on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, odd columns."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from deltaspan.llm import ann, dedup, language, lm, mixing, pieces, quality, stages, token_output, topk, toxicity
from deltaspan.llm.common import chosen, spans

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "one", "ß 😀 的 x", "a\n\nb  c\t d", "long " * 20_000, "<|endoftext|> a", " leading", "x" * 3000]


def documents(spark, texts, more=""):
    rng = random.Random(1)
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "é", None])) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], DOCS)
    return df.withColumn("score.x", F.lit(1)).withColumn("key", F.lit("k")).withColumn("score", F.lit(2.0)) if more else df


def words(n, seed, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{min(int(rng.paretovariate(0.8)), vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    return documents(spark, [*ODD, *(words(60, i) for i in range(20)), words(60, 3)], "more").cache()


# --- token ids


def test_segments_round_trip():
    rng = np.random.default_rng(1)
    for _ in range(60):
        lengths = rng.integers(0, 200, rng.integers(1, 20))
        ids = rng.integers(0, 2 ** rng.integers(1, 33), lengths.sum(), dtype=np.uint64).astype(np.uint32)
        ids[rng.random(len(ids)) < 0.05] = 2**32 - 1
        s = token_output.Segment(token_output.encode_segment(ids, lengths, 64, float(rng.random())))
        assert (s.ids() == ids).all()
        cut = np.split(ids, np.cumsum(lengths)[:-1])
        i = int(rng.integers(len(lengths)))
        assert (s.document(i) == cut[i]).all()
    with pytest.raises(ValueError):
        token_output.Segment(b"x" * 64)


def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        text = f.read()
    return text, Tokenizer.from_str(text)


def test_pieces_of_texts_encode_as_whole_texts():
    model, t = library()
    ids = token_output._Ids(model, limit=50)
    rng = random.Random(2)
    texts = ["".join(rng.choice(["a", "b", " ", "  ", "\n", "\t", "th", "e", "'s", "ing", ".", "!", "1", "的", "😀", " x", "\xa0", "<|endoftext|>"]) for _ in range(rng.randint(0, 25))) for _ in range(2000)]
    assert token_output.encode_texts(texts, ids) == [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]


def test_words_of_letters_encode_as_the_library_does():
    model, t = library()
    rng = random.Random(4)
    words = ["the", "Été", "ñandú", "ЖЖ", "λόγος", "ªº", "ǅ", "ʰa", "a\u0301", "Ա", "的", "I'm", "don't", "x1", "½", "a,", "é.", "well;", "so!?", "z" * 300, ".", ",a", "a:b", "ﬁ", "K", "ſ", "µ"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", "\n"]) for _ in range(rng.randint(0, 12))) + rng.choice(words) for _ in range(2000)]
    for limit in (20, 1_000_000):
        assert token_output.encode_texts(texts, token_output._Ids(model, limit=limit)) == [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]


def test_added_tokens_are_the_librarys():
    model, t = library()
    texts = ["hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|>b c", "a <|endoftext| > b", "plain words"]
    assert t.encode(texts[0], add_special_tokens=False).ids == [31373, 220, 50256, 995]
    whole = [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    assert token_output.encode_texts(texts, token_output._Ids(model)) == whole


def test_a_tokenizer_that_cuts_elsewhere_gets_whole_texts():
    model, t = library()
    ids = token_output._Ids(model)
    ids.starts[:] = False
    texts = ["some words here", "and some more"]
    assert token_output.encode_texts(texts, ids) == [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    assert not ids.cuts


def test_token_output(spark, odd, tmp_path):
    model, t = library()
    docs = odd.unionByName(odd.limit(3)).unionByName(odd.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    token_output.write_ids(spark, docs, model, str(tmp_path / "ids"), segment_ids=500)
    found = sorted((tuple(r)[:4] for r in token_output.read_ids(spark, str(tmp_path / "ids")).collect()), key=lambda r: r[1])
    # In ascending order of id, each document starting where the one before ends.
    assert [r[0] for r in found] == sorted((r[0] for r in found), key=lambda i: (i is not None, i))
    assert [r[1] for r in found] == [0, *np.cumsum([r[2] for r in found])[:-1].tolist()]
    wanted = [(r.doc_id, np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")) for r in docs.collect()]
    assert Counter((r[0], r[2], r[3]) for r in found) == Counter((i, len(ids), zlib.crc32(ids.tobytes())) for i, ids in wanted)
    token_output.write_ids(spark, odd.limit(0), model, str(tmp_path / "none"))
    assert token_output.read_ids(spark, str(tmp_path / "none")).count() == 0


# --- pieces


def test_agenda_against_the_library(spark, odd):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=pieces.public_model())
    e = pieces.Encoder(pieces.public_model(), check=False, limit=100)
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a", "b", " ", "  ", "▁", "th", "e", "ing", "\n", "ß", "😀", ".", "1", "的", "\t", "\x00"]) for _ in range(rng.randint(0, 25))) for _ in range(2000)]
    for text, (ids, decoded, _) in zip(texts, e.batch(texts)):
        wanted = sp.encode(text)
        assert ids == ",".join(map(str, wanted)).encode() and decoded == sp.decode(wanted) == e.vocabulary.decode(wanted)
    rows = {r.doc_id: r for r in pieces.encode_documents(odd, pieces.public_model(), with_ids=True).collect()}
    for r in odd.collect():
        wanted = sp.encode(r.text or "")
        got = rows[r.doc_id]
        assert got.agrees and got.ids == wanted and got.n_tokens == len(wanted)
        assert got.decoded_sha256 == hashlib.sha256(sp.decode(wanted).encode()).hexdigest()
    assert pieces.encode_documents(odd.limit(0), pieces.public_model()).count() == 0


# --- mixing


def mixed_by_hand(rows):
    size = Counter()
    for _, text, source in rows:
        size[source] += len((text or "").split())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full = sum(size.values()), set()
    while True:
        rest = [s for s in order if s not in full]
        left = total - sum(3 * size[s] for s in full)
        target = {s: 3.0 * size[s] if s in full else left * weight[s] / sum(weight[x] for x in rest) for s in order}
        over = {s for s in rest if target[s] > 3 * size[s]}
        if not over:
            return size, target
        full |= over


def test_mixing(spark, odd):
    docs = odd.unionByName(odd.limit(5))
    got = mixing.mixed_sizes(docs).collect()
    assert sorted(got, key=str) == sorted(mixing.mixed_sizes(docs.repartition(7)).collect(), key=str)
    rows = docs.select("doc_id", "text", "source").collect()
    size, target = mixed_by_hand(rows)
    source = {r.doc_id: r.source for r in rows}
    taken = Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == size[s] and r.target == pytest.approx(target[s]) and r.taken <= 3 * r.size
        assert r.taken >= r.size * min(3, int(target[s] / size[s] + 1e-9))
        taken[s] += r.taken
    most = max(r.size for r in got)
    assert all(abs(taken[s] - target[s]) <= most for s in size)
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    assert Counter(out.agg(F.sum(mixing.size_of(F.col("text")))).first()[0:1]) == Counter([sum(r.taken for r in got)])
    assert mixing.mixed_sizes(odd.limit(0)).count() == 0
    empty = mixing.mixed_sizes(odd.where("text is null")).first()
    assert (empty["size"], empty.target, empty.taken) == (0, 0.0, 0)


def test_equal_rows_at_the_cut(spark):
    rows = [(7, "a b c", "s1")] * 1000 + [(1, "x " * 50, "s2"), (2, "y " * 40, "s2"), (None, "z", None), (9, "", "s2"), (10, None, "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    size, target = mixed_by_hand(rows)
    taken = Counter()
    for r in mixing.mixed_sizes(docs).collect():
        taken[next(s for s in size if size[s] == r.source_size)] += r.taken
    assert all(abs(taken[s] - target[s]) <= 50 for s in size) and abs(taken["s1"] - target["s1"]) <= 3
    out = mixing.mix_documents(docs)
    found = Counter()
    for r in out.collect():
        found[r.source] += len((r.text or "").split())
    assert found == +taken
    again = mixing.mix_documents(docs.repartition(5)).groupBy("source").agg(F.sum(mixing.size_of(F.col("text"))).alias("n")).collect()
    assert {r.source: r.n for r in again} == dict(found)


def test_a_rest_of_nothing_takes_nothing(spark):
    # One source: its target is its own size, so the rest is 0 and texts without words get no further epoch.
    docs = spark.createDataFrame([(1, "", "s"), (2, "a b", "s"), (3, None, "s")], "doc_id long, text string, source string")
    assert sorted(r.doc_id for r in mixing.mix_documents(docs).collect()) == [1, 2, 3]


# --- classifiers


def test_toxicity_learns_words():
    rng = random.Random(4)
    sample = []
    for i in range(600):
        text = words(60, i)
        toxic = rng.random() < 0.2
        if toxic:
            at = rng.randint(0, len(text.split()) - 1)
            text = " ".join([*text.split()[:at], rng.choice(["Idiot,", "clown", "loser!"]), *text.split()[at:]])
        sample.append((text, int(toxic), rng.choice(["en", "de", None])))
    model = toxicity.fit(sample[:400])
    scorer = toxicity.Scorer(model.parts)
    score = scorer.scores([scorer.words.of(t) for t, _, _ in sample[400:]])
    y = np.array([v for _, v, _ in sample[400:]])
    assert ((score >= 0.3) == y).mean() > 0.95
    long = scorer.scores([scorer.words.of(("w1 " * 50_000) + "idiot"), scorer.words.of(""), scorer.words.of("w1 " * 50_000)])
    assert long[0] > 0.3 > max(long[1:])
    text = " ".join(words(3000, 5).split()[:2990] + ["you", "idiot", "clown"])
    parts = toxicity.Scorer(toxicity.fit(sample[:400]).parts)
    one, many = parts.logits([parts.words.of(text)]), [parts.logits([parts.words.of(text)], w) for w in (7, 100, 2993)]
    assert all(np.allclose(one, m, atol=1e-5) for m in many)
    one = toxicity.fit([("a", 0, None)] * 5)
    assert 0 <= toxicity.Scorer(one.parts).scores([np.zeros(0, np.int64)])[0] < 0.3


def test_scores_keep_rows_and_names(spark, odd):
    model = toxicity.fit([("good words", 0, "en"), ("bad idiot", 1, "en")] * 20)
    out = toxicity.score_documents(odd, model)
    assert out.select("row_.*").columns == odd.columns and out.count() == odd.count()
    assert out.where("score_ is null or score_ < 0 or score_ > 1").count() == 0
    assert toxicity.score_documents(odd.limit(0), model).count() == 0
    model = quality.fit([(words(50, i), 1, None) for i in range(30)] + [("BUY! " * 30, 0, None), ("a | b | " * 30, 0, None)] * 10)
    out = quality.score_documents(odd, model)
    assert out.count() == odd.count() and out.where("score_ is null").count() == 0
    assert quality.fit([]).scores(np.zeros((1, quality.N_RAW)))[0] == pytest.approx(0.5)


def test_quality_orders_pairs():
    good, bad = [words(80, i, 5000) for i in range(150)], [(words(4, i) + " ") * 30 for i in range(40)]
    sample = [(t, 1, None) for t in good[:100]] + [(t, 0, None) for t in bad[:25]]
    model = quality.fit(sample)
    score = lambda texts: model.scores(np.array([quality.features(t) for t in texts]))
    assert score(good[100:]).min() > model.threshold > score(bad[25:]).max()


def test_long_texts_have_the_same_features(monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["a", "B ", "é", "\n", " ", "!", "7", "|", "\u2003", "w1 w1 ", "\x1c"]) for _ in range(4000)) for _ in range(5)] + [" ", "x" * 50, "a\nb\na\nb"]
    for text in texts:
        for size in (1, 10, 1000, 10**6):
            monkeypatch.setattr(quality, "spans", lambda t, mark=None, size=size: spans(t, mark, size))
            assert quality.long_features(text) == pytest.approx(quality.features(text))


def test_spans_keep_words_whole():
    text = "one  two\tthree\n\nfour " * 50
    for size in (1, 5, 64, 10_000):
        for t in (text, text.encode()):
            parts = list(spans(t, size=size))
            assert t[:0].join(parts) == t and [w for p in parts for w in p.split()] == t.split()


def test_bradley_terry_recovers_weights():
    rng = np.random.default_rng(5)
    w = np.array([1.0, -2.0, 0.5])
    x = rng.normal(size=(4000, 2, 3))
    first = rng.random(4000) < 1 / (1 + np.exp(-(x[:, 0] - x[:, 1]) @ w))
    better, worse = np.where(first[:, None], x[:, 0], x[:, 1]), np.where(first[:, None], x[:, 1], x[:, 0])
    assert np.allclose(quality.bradley_terry(better, worse), w, atol=0.2)


def test_language(spark, odd):
    rng = random.Random(6)
    syllables = {"en": ["the", "ing", "wh", "th"], "de": ["sch", "ung", "ei", "ß"], "fr": ["eau", "ent", "é", "ou"], "es": ["ción", "ado", "ll", "ñ"], "zz": ["zaq", "xu", "qi"]}
    make = lambda g: " ".join("".join(rng.choice(syllables[g]) for _ in range(3)) for _ in range(20))
    model = language.fit([(make(g), g) for g in syllables for _ in range(40)])
    assert model.families["only zz"] == ["zz"]
    texts = [(make(g), g) for g in syllables for _ in range(10)]
    lang, score = model.predict([t for t, _ in texts])
    assert lang == [g for _, g in texts] and all(0 <= s <= 1 for s in score)
    assert model.predict([None, "", "12 !?", "² ½ Ⅻ", "é"])[0][:4] == ["und"] * 4
    assert language.fit([]).predict(["text"]) == (["und"], [0.0])
    assert language.identify(odd, model).count() == odd.count()
    assert language.training_rows(odd.limit(0)) == []


def test_many_languages_and_long_texts(spark, monkeypatch):
    rows = [(i, f"word{i % 80} " * 3, f"l{i % 80:02d}") for i in range(1600)]
    sample = language.training_rows(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_rows=400)
    taken = Counter(g for _, g in sample)
    assert len(taken) == 80 and set(taken.values()) == {5}
    model = language.fit(sample)
    assert model.predict(["word79 word79"])[0] == ["l79"]
    text = "".join(random.Random(1).choice("abc é") for _ in range(5000))
    whole = language.vector(text)
    for span in (1, 7, 1000, 5001):
        monkeypatch.setattr(language, "SPAN", span)
        assert np.array_equal(language.vector(text), whole)


# --- searches


def vectors(spark, x, ids=None):
    rows = [(int(i), [float(a) for a in v]) for i, v in zip(ids if ids is not None else range(len(x)), x)]
    rows += [(900_000, None), (900_020, [float("nan")] * x.shape[1]), (900_040, [None] * x.shape[1]), (None, [1.0] * x.shape[1]), (900_060, [1.0])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1)).withColumn("score", F.lit(2))


def brute(x, ids, k, zero=False):
    out = {}
    for i in np.flatnonzero(np.array(ids) % 20 == 0):
        s = x @ x[i]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i] and (x[j].any() or not zero)][:k]
        if x[i].any() or not zero:
            out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def listed(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, float(r.score)))
    return out


def test_top_k_with_ties_and_copies(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 8))
    x[50:150] = x[50]  # a hundred copies
    x[200:230] = np.round(x[200:230])
    whole = np.floor(64 * x)
    got = listed(topk.top_k(vectors(spark, x)))
    assert got == brute(whole, np.arange(300), 20)
    few = listed(topk.top_k(vectors(spark, x[:5])))
    assert few == brute(whole[:5], np.arange(5), 20)
    assert topk.top_k(vectors(spark, x).where("embedding is null")).count() == 0


def repeated(rows, k, zero=False):
    """The best k of all rows of a query id against rows of other ids, as SQL gives them."""
    rows = sorted({(i, tuple(v)) for i, v in rows})
    out = {}
    for q in {i for i, v in rows if i % 20 == 0}:
        scores = [(-sum(a * b for a, b in zip(v, w)), j) for i, v in rows if i == q for j, w in rows if j != q]
        out[q] = [(j, -s) for s, j in sorted(scores)[:k]]
    return out


def test_ids_with_several_vectors(spark):
    rng = np.random.default_rng(17)
    rows = [(i, [int(a) for a in rng.integers(-9, 9, 6)]) for i in range(60)]
    rows += [(20, [m * a for a in rows[20][1]]) for m in range(2, 60)] + [(20, rows[7][1]), (7, rows[20][1]), (40, rows[20][1]), (13, rows[5][1])]
    df = spark.createDataFrame([(i, [a / 64 for a in v]) for i, v in rows], "vec_id long, embedding array<double>")
    want = repeated(rows, 20)
    got = listed(topk.top_k(df))
    assert got == {q: [(j, float(s)) for j, s in v] for q, v in want.items()}
    whole = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in rows], "vec_id long, embedding array<double>")
    assert listed(ann.nearest(whole, share=1.0, per_list=10)) == {q: [(j, float(s)) for j, s in v] for q, v in want.items()}


@pytest.mark.parametrize("huge", [1e9, 3e16, 1e150, 1e306])
def test_any_finite_component(spark, huge):
    rng = np.random.default_rng(18)
    x = [[float(a) for a in v] for v in rng.normal(size=(90, 5))]
    x[3][0] = x[20][0] = huge
    x[21] = [-huge, 1.0, huge, 0.5, 0.25]
    x[40][2] = -huge / 3
    whole = [[math.floor(64 * a) if abs(64 * a) < 2**53 else int(64 * a) for a in v] for v in x]
    want = repeated(list(enumerate(whole)), 20)
    got = listed_whole(topk.top_k(spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>")))
    assert got == {q: [(j, min(max(s, -(2**63)), 2**63 - 1)) for j, s in v] for q, v in want.items()}


def listed_whole(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_blocks_are_skipped_only_where_they_may_be(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "HEAD", 8)
    rng = np.random.default_rng(19)
    x = rng.normal(size=(900, 8)) * rng.pareto(1.5, size=(900, 1))
    assert listed(topk.top_k(vectors(spark, x), 3)) == brute(np.floor(64 * x), np.arange(900), 3)


def test_nearest_recall(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[100:140] = x[100]
    x[7] = 0
    ids = np.arange(3000)
    want = brute(x, ids, 20, zero=True)
    got = listed(ann.nearest(vectors(spark, x, ids)))
    assert got.keys() == want.keys()
    hit = [len({a for a, _ in got[q]} & {a for a, _ in want[q]}) / 20 for q in want]
    assert np.mean(hit) >= 0.9
    scores = {(int(q), v): s for q in want for v, s in got[q]}
    assert all(abs(s - float(x[q] @ x[v])) < 1e-12 for (q, v), s in scores.items())
    assert all(len(v) == 20 for v in got.values())
    few = listed(ann.nearest(vectors(spark, x[:5])))
    assert {q: [a for a, _ in v] for q, v in few.items()} == {q: [a for a, _ in v] for q, v in brute(x[:5], ids[:5], 20).items()}
    assert ann.nearest(vectors(spark, x).where("embedding is null")).count() == 0


@pytest.mark.parametrize("centres", [0, 200])
def test_recall_holds_as_tables_grow(spark, tmp_path, centres):
    rng = np.random.default_rng(20)
    for n in (4000, 50_000):
        x = rng.normal(size=(n, 32)) * (0.3 if centres else 1.0)
        x += rng.normal(size=(centres, 32))[rng.integers(0, centres, n)] if centres else 0.0
        table = pa.table({"vec_id": np.arange(n) * 20 + (np.arange(n) % (n // 100) > 0), "embedding": list(x)})
        pq.write_table(table, tmp_path / f"{n}.parquet", row_group_size=5000)
        df = spark.read.parquet(str(tmp_path / f"{n}.parquet"))
        got = {q: {v for v, _ in found} for q, found in listed(ann.nearest(df)).items()}
        ids = table["vec_id"].to_numpy()
        places = np.flatnonzero(ids % 20 == 0)
        score = x[places] @ x.T
        score[np.arange(len(places)), places] = -np.inf
        best = np.argpartition(-score, 20, axis=1)[:, :20]
        assert len(got) == len(places) == 100
        assert np.mean([len(got[int(ids[p])] & set(ids[b].tolist())) / 20 for p, b in zip(places, best)]) >= 0.9


# --- language model


def test_forward_against_all_paths():
    rng = np.random.default_rng(9)
    c = lm.Config(states=3, shapes=2)
    m = lm.Model(c, [b"a", b"b"], np.array([5.0, 3.0]), 12, 4, 2, np.array([2.5, 1.5]))
    m.begin()
    m.update(rng.random(3), rng.random((3, 3)), rng.random(m.emit.shape) * 50)
    seqs = [rng.integers(0, 5, n).astype(np.int32) for n in (1, 4, 6, 2, 4)]
    for ids, lengths, x in lm.groups(seqs):
        for place, value in zip(ids, lm.forward(m, lengths, x)):
            a = m.start * m.emit[seqs[place][0]]
            for t in seqs[place][1:]:
                a = (a @ m.move) * m.emit[t]
            assert value == pytest.approx(np.log(a.sum()))
    start, move, emit, before = lm.expected(m, seqs)
    assert start.sum() == pytest.approx(5) and emit.sum() == pytest.approx(sum(map(len, seqs))) and move.sum() == pytest.approx(sum(map(len, seqs)) - 5)
    for cells in (1, 3):  # windows of one and more words, all sequences or some
        parts = [lm.expected_long(m, s, cells) for s in seqs]
        for whole, part in zip((start, move, emit, before), zip(*parts)):
            assert np.allclose(whole, sum(part))
        assert all(np.allclose(a, b) for a, b in zip(lm.expected(m, seqs, cells), (start, move, emit, before)))
    for block in (1, 2, 5):
        for ids, lengths, x in lm.groups(seqs):
            assert np.allclose(lm.forward(m, lengths, x, block=block), lm.forward(m, lengths, x))
    m.emit, m.move, m.start = emit / emit.sum(0), move / move.sum(1, keepdims=True), start / start.sum()
    assert lm.expected(m, seqs)[3] >= before - 1e-9
    assert m.base().sum() == pytest.approx(1)


def test_language_model(spark, odd):
    odd = odd.unionByName(odd.limit(2).withColumn("text", F.concat(F.lit("w1 "), F.repeat(F.lit("y"), 100), F.lit(" w1 w2 "), F.repeat(F.lit("Y"), 100))))
    config = lm.Config(frequent=30, listed=60, sample_docs=10, sample_rounds=3, corpus_rounds=1)
    usable = lambda i: F.coalesce(i, F.lit(0)) % 5 != 1
    model, counts = lm.fit(odd, usable=usable, config=config)
    assert model.words and model.size == 30
    got = sorted((tuple(r) for r in lm.score_documents(odd, model, counts).collect()), key=lambda r: (r[0], r[1], r[4]))
    tokens = [(r.doc_id, [*(r.text or "").encode().lower().split(), b""]) for r in odd.collect()]
    c = Counter(t for i, ts in tokens if i % 5 != 1 for t in ts)
    n, v = sum(c.values()), len(c)
    log = lambda t: np.log10((c[t] + 0.5) / (n + 0.5 * (v + 1)))
    table = {w: k for k, w in enumerate(model.words[:30])}
    shape = lambda t: lm.Shapes(64)[lm.key_of(t)[-3:]]
    mass = np.full(64, 0.5)
    for t in c:
        if t and lm.key_of(t) not in table:
            mass[shape(t)] += c[t] + 0.5
    want = []
    for i, ts in tokens:
        total, a = 0.0, model.start
        for k, t in enumerate(ts):
            place = 30 if t == b"" else table.get(lm.key_of(t), 31 + shape(t))
            a = (a @ model.move if k else a) * model.emit[place] * (1.0 if place <= 30 else (c[t] + 0.5) / mass[place - 31])
            total, a = total + np.log10(a.sum()), a / a.sum()
        want.append((i, len(ts), sum(t in c for t in ts), n, sum(map(log, ts)), total))
    want.sort(key=lambda r: (r[0], r[1], r[4]))
    assert all(a == pytest.approx(b) for a, b in zip(got, want, strict=True))
    model, counts = lm.fit(odd.limit(0), usable=usable, config=config)
    assert lm.score_documents(odd, model, counts).count() == odd.count()


# --- near-duplicates


def test_registers():
    c = dedup.Config()
    s = dedup.Sketch(c)
    rng = np.random.default_rng(10)
    for n in (100, 450, 3000):
        pool = np.unique(rng.integers(0, 2**63, 2 * n, dtype=np.uint64))
        a, b = np.sort(pool[: int(n * 1.1)]), np.sort(pool[int(n * 0.1) : int(n * 1.2)])
        x, y = dedup.registers(s.of(a), c), dedup.registers(s.of(b), c)
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        kind = max(set(x) & set(y))
        assert abs(float(dedup.estimate(x[kind], y[kind], c)) - true) < 0.12
    v = np.sort(rng.integers(0, 2**63, 100, dtype=np.uint64))[::-1]
    assert (np.diff(dedup.compress(v, 10).astype(int) >> 10) >= 0).all()


def grouped_by_hand(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 2]) for i in range(max(1, len(w) - 1))} if w else set())
    name = list(range(len(texts)))

    def root(i):
        while name[i] != i:
            i = name[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                name[b] = a
    return [(len(s), root(i)) for i, s in enumerate(sets)]


def families():
    """Exact copies, chains of edits, a shared passage, copies in other case and space, tiny texts."""
    rng = random.Random(11)
    texts = [None, "", " \t ", "one", "ONE", "one two", "one  two\n", "long " * 30_000]
    for f in range(6):
        base = words(150, f, 100_000).split()
        texts += [" ".join(base)] * 4
        for _ in range(25):
            base = list(base)
            for _ in range(rng.randint(1, 12)):
                base[rng.randrange(len(base))] = f"e{rng.random()}"
            texts.append(" ".join(base).upper() if rng.random() < 0.3 else "  ".join(base))
    passage = " ".join(f"p{i}" for i in range(120))
    texts += [passage + " " + " ".join(f"q{k}x{i}" for i in range(25 + k % 7)) for k in range(60)]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("config", [dedup.Config(), dedup.Config(split=60), dedup.Config(group=4000, chunk=3)])
def test_near_duplicates(spark, config):
    texts = families()
    got = {r.doc_id: r for r in dedup.near_duplicates(documents(spark, texts, "more"), config).collect()}
    for i, (n, root) in enumerate(grouped_by_hand(texts)):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (n, root, i == root)


def test_near_duplicates_odd_rows(spark, odd):
    assert dedup.near_duplicates(odd.limit(0)).count() == 0
    rows = odd.unionByName(odd.limit(4)).unionByName(odd.withColumn("doc_id", F.lit(None).cast("long")).limit(12))
    out = dedup.near_duplicates(rows)
    assert out.count() == rows.count()
    assert out.where("doc_id is null and (component_id is not null or kept)").count() == 0


def test_rows_that_share_an_id(spark):
    a, b = words(80, 1, 5000), words(80, 2, 5000)
    rows = [(5, a), (5, b), (11, b + " more"), (3, a), (20, "x y z"), (20, None), (20, ""), (20, "x y z"), (None, b), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("i_", F.lit(1)).withColumn("gone_id", F.lit(1)).withColumn("print", F.lit("p"))
    got = sorted(tuple(r) for r in dedup.near_duplicates(docs.where("doc_id is not null")).collect())
    n = lambda t: len({*zip(t.split(), t.split()[1:])})
    assert got == sorted([(5, n(a), 3, False), (5, n(b), 5, True), (11, n(b) + 1, 5, False), (3, n(a), 3, True), (20, 2, 20, True), (20, 2, 20, True), (20, 0, 20, True), (20, 0, 20, True), (4, 0, 4, True)])
    stage = stages.one_of_each_group(spark, docs, "")
    assert stage.columns == docs.columns
    out = sorted(((r.doc_id, r.text) for r in stage.collect()), key=str)
    assert out == sorted([(5, b), (3, a), (20, "x y z"), (20, None), (20, ""), (None, b), (4, "")], key=str)


def test_frequent_keys_join_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(dedup, "frequent", lambda n: 1)
    texts = families()
    got = {r.doc_id: r for r in dedup.near_duplicates(documents(spark, texts)).collect()}
    assert all((got[i].n_shingles, got[i].component_id) == x for i, x in enumerate(grouped_by_hand(texts)))


def test_components(spark):
    rng = random.Random(12)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    name = {x: x for e in edges for x in e}

    def root(i):
        while name[i] != i:
            i = name[i]
        return i

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        name[y] = x
    linked = {x for a, b in edges if a != b for x in (a, b)}
    for one_task in (0, 400_000):
        got = {r.node: r.component for r in dedup.components(spark.createDataFrame(edges, "a long, b long"), one_task).collect()}
        assert got == {x: root(x) for x in linked}


# --- pipeline


def test_pipeline(spark, tmp_path):
    rng = random.Random(13)
    texts, quality_, toxic = [], [], []
    for i in range(160):
        good, bad = rng.random() < 0.8, rng.random() < 0.2
        text = words(80, i, 3000) if good else "BUY!! NOW!! " * 40
        texts.append(text + (" idiot" if bad else ""))
        quality_.append(int(good))
        toxic.append(int(bad))
    texts += texts[:30] + [None, ""]
    folder = str(tmp_path / "t")
    docs = documents(spark, texts)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, q, t) for i, (q, t) in enumerate(zip(quality_, toxic))], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    out = corpus_pipeline.run(spark, folder)
    kept = {i for i in range(160) if quality_[i] and not toxic[i]}
    ids = {r.doc_id for r in out.collect()}
    assert len(ids & set(range(160)) - kept) <= 2 and len(ids & kept) >= 0.5 * len(kept)
    once = stages.one_of_each_group(spark, docs.unionByName(docs.limit(3)), folder)
    assert once.columns == docs.columns
    want = {root for n, root in grouped_by_hand(texts)} | {i for i, t in enumerate(texts) if not t}
    assert sorted(r.doc_id for r in once.collect()) == sorted(want)


def test_chosen_is_bounded_and_stable(spark):
    df = spark.range(20_000)
    a = [r.id for r in chosen(df, "id", 50, "s").collect()]
    b = [r.id for r in chosen(df.repartition(5), "id", 50, "s").collect()]
    assert a == b and len(a) == 50 and len(chosen(df.limit(10), "id", 50, "s").collect()) == 10
