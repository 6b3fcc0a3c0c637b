"""Registered queries of this subpackage against their SQL or, over whole tables, against plain Python."""

import hashlib
import zlib

import numpy as np
import pytest
from compare import DATA, connect, same
from test_llm import brute, grouped_by_hand, listed, mixed_by_hand

import corpus_pipeline
from deltaspan.llm import pieces, quality, registry, toxicity
from deltaspan.llm.common import table

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables")
TEN, HUNDRED = DATA.parent / "sf0.01", DATA.parent / "sf0.1"


def texts(folder=DATA, columns="doc_id, text"):
    return connect(folder).sql(f"select {columns} from documents order by doc_id").fetchall()


def rows(spark, name, folder=DATA):
    found = registry.QUERIES[name](spark, str(folder)).collect()
    assert len(found) == len(texts(folder)) and len({r.doc_id for r in found}) == len(found)
    return {r.doc_id: r for r in found}


def rest(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def auc(score, y):
    score, y = np.array(score), np.array(y)
    above = score[y == 1][:, None] - score[y == 0][None, :]
    return ((above > 0) + 0.5 * (above == 0)).mean()


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, name):
    same(registry.QUERIES[name](spark, str(DATA)), registry.ORACLES[name])


def test_all_operators_are_registered():
    assert {n.split("_")[0] for n in registry.QUERIES} == {f"op{i}" for i in range(1, 11)}


@pytest.mark.parametrize("name, label, n, left, folder, floor", [("op1_toxicity", "toxic", 4, 2, HUNDRED, 0.93), ("op5_quality", "quality", 5, 0, TEN, 0.93)])
def test_classifiers_on_rows_held_out(spark, name, label, n, left, folder, floor):
    got = rows(spark, name, folder)
    assert all(r.held_out == (rest(i, n) == left) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for i, r in got.items())
    known = [(got[i].score, y) for i, y in connect(folder).sql(f"select doc_id, {label} from labels").fetchall() if got[i].held_out]
    assert auc(*zip(*known)) >= floor


def test_language(spark):
    got = rows(spark, "op2_language", TEN)
    assert all(r.held_out == (rest(i, 3) == 1) and 0 <= r.score <= 1 for i, r in got.items())
    known = [(got[i].lang_pred, g, t) for i, t, g in texts(TEN, "doc_id, text, lang") if g is not None and got[i].held_out]
    assert all((p == "und") == (not any(map(str.isalpha, t or ""))) for p, _, t in known)
    assert np.mean([p == g for p, g, t in known if p != "und"]) >= 0.98


def test_token_output(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t, start = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    got = rows(spark, "op3_token_output")
    for i, text in texts():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        assert tuple(got[i])[:4] == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def library_pieces(text):
    ids = LIBRARY.encode(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()


def setup_module():
    global LIBRARY
    import sentencepiece

    LIBRARY = sentencepiece.SentencePieceProcessor(model_proto=pieces.public_model())


def test_pieces(spark):
    got = rows(spark, "op7_pieces")
    for i, text in texts():
        assert tuple(got[i]) == (i, *library_pieces(text), True)


def test_nearest(spark):
    found = connect(TEN).sql("select vec_id, embedding from embeddings where embedding is not null").fetchall()
    ids, x = np.array([i for i, _ in found]), np.array([v for _, v in found], float)
    want, got = brute(x, ids, 20, zero=True), listed(registry.QUERIES["op8_ann"](spark, str(TEN)))
    assert got.keys() == want.keys()
    assert np.mean([len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / 20 for q in want]) >= 0.9
    place = {int(i): k for k, i in enumerate(ids)}
    assert all(s == pytest.approx(float(x[place[q]] @ x[place[v]]), abs=1e-12) for q in got for v, s in got[q])


def test_language_model(spark):
    from collections import Counter

    got, tokens = rows(spark, "op9_lm", TEN), {i: [*(t or "").encode().lower().split(), b""] for i, t in texts(TEN)}
    c = Counter(t for i, ts in tokens.items() if rest(i, 5) != 1 for t in ts)
    n, v = sum(c.values()), len(c)
    for i, ts in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (rest(i, 5) == 1, len(ts), sum(t in c for t in ts), n)
        assert r.base_score == pytest.approx(sum(np.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts))
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_near_duplicates(spark):
    got, given = rows(spark, "op10_dedup"), texts()
    ids = [i for i, _ in given]
    for i, (n, root) in zip(ids, grouped_by_hand([t for _, t in given])):
        assert tuple(got[i])[:4] == (i, n, ids[root], i == ids[root])


def test_pipeline_against_plain_python(spark):
    folder = str(DATA)
    docs, given = table(spark, folder, "documents"), texts(columns="doc_id, text, lang, source")
    good = quality.fit_on(spark, docs, folder)
    kept = [r for r, s in zip(given, good.scores(np.array([quality.features(t or "") for _, t, _, _ in given]))) if s >= good.threshold]
    bad = toxicity.fit_on(spark, docs, folder)
    scorer = toxicity.Scorer(bad.parts)
    score = scorer.scores([scorer.words.of(t or "") for _, t, _, _ in kept])
    kept = [r for r, s in zip(kept, score) if s < bad.by_lang.get(r[2], bad.threshold)]
    kept = [r for k, (r, (_, root)) in enumerate(zip(kept, grouped_by_hand([t for _, t, _, _ in kept]))) if k == root]
    out = corpus_pipeline.run(spark, folder).collect()
    by_id = {r[0]: r for r in kept}
    assert {r.doc_id for r in out} <= by_id.keys()
    size, target = mixed_by_hand([(i, t, s) for i, t, _, s in kept])
    times, taken = {}, dict.fromkeys(size, 0)
    for r in out:
        _, text, _, source = by_id[r.doc_id]
        assert tuple(r)[:4] == (r.doc_id, *library_pieces(text))
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
        taken[source] += len((text or "").encode().split())
    most = max(len((t or "").split()) for _, t, _, _ in kept)
    assert all(abs(taken[s] - target[s]) <= most for s in size)
    for i, _, _, s in kept:
        whole = min(3, int(target[s] / size[s] + 1e-9)) if size[s] else 0
        assert whole <= times.get(i, 0) <= min(3, whole + 1)
