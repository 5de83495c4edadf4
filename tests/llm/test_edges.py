"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns for every operator."""

import re
import zlib
from collections import Counter
from itertools import chain

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from roomflow.llm.common import Stage

public_tokenizers = pytest.importorskip("public_tokenizers")

LONG = "the wordy thing " * 4000
ROWS = [(1, None, "en"), (2, "", "en"), (3, "a b c d e f", "en"), (3, "a b c d e f", "en"), (None, "x y z", None), (5, LONG, "en"), (6, LONG + "tail", "en"), (7, "1234 !!", "de"), (8, "der die das und", "de"), (9, "É😀 \x00 ẞ", None)]
CLASH = ["start", "score", "rank", "size", "node", "part", "tie", "slot", "row_number", "component_id", "found", "at"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    return df.withColumns({c: F.lit("clash") for c in CLASH})


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(3, 1), (5, 0), (6, 0), (8, 1), (9, None), (None, 1), (77, 1)], "doc_id long, toxic int")


def test_token_file(spark, docs, none):
    from roomflow.llm.token_file import read_tokens, write_tokens

    path = public_tokenizers.path("word_bpe_49k.json")
    got = read_tokens(write_tokens(docs, Stage(spark, "t"), "s", path)).toPandas()
    assert len(got) == len(ROWS) and (got.n_tokens >= 1).all()
    ordered = got.sort_values("start")
    assert ordered.start.tolist() == [0, *ordered.n_tokens.cumsum().tolist()[:-1]]
    assert all(ids[-1] == 2 for ids in got.ids) and got[got.doc_id.isin([1, 2])].n_tokens.tolist() == [1, 1]
    assert read_tokens(write_tokens(none, Stage(spark, "t"), "s", path)).count() == 0


def test_pieces(docs, none):
    from roomflow.llm.piece_bpe import encode_decode

    path = public_tokenizers.path("piece_bpe_32k.model")
    got = encode_decode(docs, path).toPandas()
    texts = {r[0]: r[1] or "" for r in ROWS}
    assert len(got) == len(ROWS) and all(r.decoded == texts[None if r.doc_id != r.doc_id else r.doc_id] for r in got.itertuples())
    assert encode_decode(none, path).count() == 0


def test_near_documents(spark, docs, none):
    from roomflow.llm.set_join import near_duplicates

    got = near_duplicates(docs, Stage(spark, "n"), size=5).toPandas()
    assert len(got) == len(ROWS) and got[got.doc_id == 3].component_id.tolist() == [3, 3]
    assert got.set_index("doc_id").component_id.get(6) == 6  # 3 of 4 shingles are shared
    assert got[got.doc_id.isin([1, 2])].n_shingles.tolist() == [0, 0]
    assert got[got.doc_id.isna()].kept.tolist() == [False]
    assert near_duplicates(none, Stage(spark, "n"), size=5).count() == 0


def test_near_documents_null_and_repeated_ids(spark):
    from corpus_pipeline import near_dedup

    from roomflow.llm.set_join import near_duplicates

    a, b, c, d = (" ".join(f"{w}{i}" for i in range(60)) for w in "abcd")
    rows = [(1, a), (5, a + " x"), (5, b), (7, b), (8, b + " y"), (None, c), (None, c), (None, c + " z"), (9, d), (9, d), (None, d), (None, None), (2, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_duplicates(df, Stage(spark, "n"), size=5)
    assert sorted(got.where("doc_id IN (7, 8)").toPandas().component_id) == [5, 5]
    assert sorted(got.where("doc_id = 5").toPandas().component_id) == [1, 5]
    assert got.count() == len(rows) and got.where("doc_id IS NULL AND kept").count() == 0
    kept = sorted(((r["doc_id"] or 0, (r["text"] or "")[:2]) for r in near_dedup(spark, df, None).collect()))
    assert kept == [(0, ""), (0, "c0"), (1, "a0"), (2, ""), (5, "b0"), (9, "d0")]


def test_near_documents_large_groups(spark):
    """A dense group beyond a node's size, chains, and a word pair that all documents share, against brute force."""
    from test_operators import near_brute

    from roomflow.llm.set_join import near_duplicates

    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(700):
        w = list(base)
        for k in rng.choice(120, rng.integers(0, 22), replace=False):
            w[k] = f"x{rng.integers(1 << 30)}"
        texts.append(" ".join(["of the", *w]))
    chain = [f"c{i}" for i in range(60)]
    for i in range(20):
        texts.append(" ".join(["of the", *chain[i : i + 40]]))
    for _ in range(900):
        texts.append(" ".join(["of the", *(f"y{x}" for x in rng.integers(1 << 30, size=rng.integers(2, 12)))]))
    order = rng.permutation(len(texts))
    df = spark.createDataFrame([(int(i), texts[k]) for i, k in enumerate(order)], "doc_id long, text string")
    _, top = near_brute(list(range(len(texts))), [texts[k] for k in order], 2)
    got = near_duplicates(df, Stage(spark, "n"), size=2).toPandas().set_index("doc_id").component_id.to_dict()
    assert sum(got[i] != top[i] for i in top) == 0


def test_toxicity(spark, docs, none, labels):
    from roomflow.llm.toxicity import fit_toxicity, score_toxicity

    got = score_toxicity(docs, fit_toxicity(docs, labels)).toPandas()
    assert len(got) == len(ROWS) and got.score.between(0, 1).all()
    assert score_toxicity(docs, fit_toxicity(none, labels)).count() == len(ROWS)
    assert score_toxicity(none, fit_toxicity(docs, labels.where("false"))).count() == 0


def test_toxicity_held_out(spark, sf):
    """Held-out documents on sf0.1: nearly all toxic ones are caught, whatever their language, and hardly any other."""
    from roomflow.llm.queries import QUERIES

    big = sf.replace("sf0.001", "sf0.1")
    got = QUERIES["op4_toxicity"](spark, big).join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").join(spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    got = got[got.held_out]
    assert (got.toxic == 1).sum() > 100
    assert got[got.predicted == 1].toxic.mean() > 0.85 and got[got.toxic == 1].predicted.mean() > 0.8
    assert got[(got.toxic == 1) & (got.lang != "en")].predicted.mean() > 0.7


def test_toxicity_windows():
    """Every different word has a window; gains are the differences of compressed lengths; toxic stems gain with new endings too."""
    import zstandard

    from roomflow.llm import toxicity

    plain = [[f"plain{(i * k) % 97}" for k in range(40)] + ["scound", "scoundly"] * (i % 7 == 0) for i in range(60)]
    nasty = [[*w, "rotten", f"scoundrel{i % 5}"] for i, w in enumerate(plain[:30])]
    assert toxicity.telling_words(nasty, plain) == [f"scoundrel{i}" for i in range(5)] + ["rotten"]
    own, other = toxicity._dictionaries(nasty, plain)
    assert b" SCOUnd " in other and b"ROTTen" in own
    model = toxicity.ToxicityModel(own, other)
    assert len({len(c) for c in model.contents.values()}) == 1
    assert toxicity.words_of("Plain3, plain5 -- rotten!! Scoundrel plain3") == ["plain3", "plain5", "rotten", "scoundrel"]
    params = zstandard.ZstdCompressionParameters(min_match=toxicity.MATCH, strategy=zstandard.STRATEGY_BTLAZY2, window_log=17, hash_log=17, chain_log=17, search_log=6, write_content_size=0, write_checksum=0, write_dict_id=0)
    for word in ("rotten", "scoundrel3", "scoundrelling", "scound"):
        sizes = {n: len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(c, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params).compress(toxicity.window(word))) for n, c in model.contents.items()}
        assert model.gain(word) == (sizes["ordinary"] - sizes["toxic"], sizes["neutral"] - sizes["toxic"])
    assert model.gain("rotten")[0] >= 2 and model.gain("scoundrelling")[0] >= 1 and model.gain("scoundly")[0] <= 0 and model.gain("plain3") == (0, 0)


@pytest.mark.parametrize("most", [(1400, 4500), (60, 60)])
def test_toxicity_keeps_the_odds_of_the_labels(spark, monkeypatch, most):
    """Where texts tell nothing, the score is the share of toxic labels, below the bounds of the fit and above them."""
    from roomflow.llm import toxicity

    monkeypatch.setattr(toxicity, "TOXIC_DOCS", most[0])
    monkeypatch.setattr(toxicity, "ORDINARY_DOCS", most[1])
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{k}" for k in rng.integers(0, 50, 40)), int(i % 10 == 0)) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    scores = toxicity.score_toxicity(df, toxicity.fit_toxicity(df, df)).toPandas().score
    assert 0.07 < scores.mean() < 0.13


def test_spots(spark, docs, none):
    from roomflow.llm.spots import fingerprints, near_pairs

    got = fingerprints(docs).toPandas()
    assert len(got) == len(ROWS) and got.near_edited.between(0, 1).all() and got.near_next.between(0, 1).all()
    assert got[got.doc_id == 3].fingerprint.nunique() == 1
    assert fingerprints(none).count() == 0
    one = fingerprints(docs.where("doc_id = 8")).first()
    assert one["near_next"] == 1.0
    pairs, members = near_pairs(docs, Stage(spark, "s"))
    assert {(r["a"], r["b"]) for r in pairs.collect()} <= {(5, 6)} and members.count() == len(ROWS) - 1
    assert near_pairs(none, Stage(spark, "s"))[1].count() == 0


def test_spots_parts(spark):
    """Ranges follow the order of (id, hash), also where one id or null holds a third of all rows."""
    from roomflow.llm.spots import with_next

    rows = [(None if i % 3 == 0 else 5 if i % 3 == 1 else i, f"text {i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = with_next(df, "doc_id", "text", rows_in_part=50)
    sizes = [r["count"] for r in got.groupBy("part").count().collect()]
    assert max(sizes) <= 200 and len(sizes) > 20
    got = got.select("id", "tie", "text", "next_text").orderBy(F.desc("id"), F.desc("tie")).collect()
    assert [r["next_text"] for r in got] == [r["text"] for r in got[1:] + got[:1]]
    ones = [" ".join(["the"] * 20000), "the " * 5000 + "cat sat"]
    assert with_next(spark.createDataFrame(list(enumerate(ones)), "doc_id long, text string"), "doc_id", "text").count() == 2


def test_url_rules(spark):
    from roomflow.llm.queries import URL_RULES
    from roomflow.llm.url_rules import judge

    urls = [None, "", "nothing", "http://", "HTTP://WWW.Example.COM/en/x?y#z", "http://example.com/en/1", "http://a.b.example.com/en/", "http://example.com", "http://com/", "http://notexample.com/en/", "http://x.net/es/1", "http://x.net/fr", "http://net/fr/", "x://y.com?q=/en/"]
    df = spark.createDataFrame([(i, u, "c") for i, u in enumerate(urls)], "page_id long, url string, key string").union(spark.createDataFrame([(4, urls[4], "c")], "page_id long, url string, key string"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in judge(df, URL_RULES, Stage(spark, "u")).collect()}
    assert judge(df, URL_RULES, Stage(spark, "u")).count() == len(urls) + 1
    assert got[4] == ("www.example.com", "/en/x", "www.example.com/en/", "allow") and got[5][2:] == ("example.com/en/", "block") and got[6][2:] == ("example.com/en/", "block")
    assert got[7] == ("example.com", "", None, "allow") and got[8][2] == "com/" and got[9][2] == "com/" and got[10][2:] == ("net/es/", "block") and got[11][2] is None and got[12][2] == "net/fr/"
    assert got[0][:2] == got[1][:2] == got[2][:2] == got[3][:2] == ("", "") and got[13][:2] == ("y.com", "")
    assert judge(df.where("false"), URL_RULES, Stage(spark, "u")).count() == 0


def test_packing(spark, docs, none):
    from roomflow.llm.packing import pack

    path = public_tokenizers.path("byte_bpe_50k.json")
    got = pack(docs, Stage(spark, "p"), path).toPandas()
    assert set(got.doc_id.dropna()) == {1, 2, 3, 5, 6, 7, 8, 9} and got.doc_id.isna().sum() == 1
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 1024
    assert pack(none, Stage(spark, "p"), path).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=33, max_size=33), st.integers(0, 3))
def test_slots_cover(counts, zeroes):
    from roomflow.llm.packing import Slots

    counts = np.array([0, *counts[1:]])
    counts[1 : 1 + zeroes * 8] = 0
    slots = Slots(counts, 32, unit=4)
    length = np.repeat(np.arange(33), counts)
    rank = np.concatenate([np.arange(n) for n in counts]).astype(np.int64)
    sequence, offset = slots.place(length, rank)
    for s in np.unique(sequence):
        k = np.argsort(offset[sequence == s])
        o, n = offset[sequence == s][k], length[sequence == s][k]
        assert o.tolist() == [0, *np.cumsum(n)[:-1].tolist()] and n.sum() <= 32


def test_language(docs, none):
    from roomflow.llm.langid import fit, identify

    got = identify(docs, fit(docs)).toPandas().set_index("doc_id")
    assert len(got) == len(ROWS) and got.score.between(0, 1).all()
    assert got.loc[1].lang_pred == got.loc[2].lang_pred == got.loc[7].lang_pred == "und" and got.loc[5].lang_pred == "en"
    assert set(identify(docs, fit(none)).toPandas().lang_pred) == {"und"}
    assert identify(none, fit(docs)).count() == 0


def test_language_brute_force(spark):
    """Counts, backoff and scores against a plain version."""
    from roomflow.llm import langid

    rng = np.random.default_rng(2)
    parts = {"xx": ["ba", "bo", "ka"], "yy": ["ti", "re", "ka"], "zz": ["ömm", "üll", "ti"]}
    make = lambda k, n: " ".join("".join(rng.choice(parts[k], rng.integers(1, 4))) for _ in range(n))
    rows = [(i, make(k, int(rng.integers(0, 30))), k) for i in range(90) for k in [list(parts)[i % 3]]] + [(900, None, "xx"), (901, "½ ² ① ⁵ Ⅷ 12", "yy"), (902, "x½y", None), (903, "qq " * 50, None), (904, "neverseenword katiömm", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.identify(df, langid.fit(df)).collect()}
    words = lambda t: "".join(c if c.isalpha() else " " for c in (t or "").lower()).split()
    grams = lambda w, o: [w] if o == 0 else [f"\x02{w}\x03"[i : i + o] for i in range(len(w) + 3 - o)]
    tables = {o: {k: Counter() for k in parts} for o in (0, *langid.ORDERS)}
    for i, t, k in rows:
        if k and zlib.crc32(str(i).encode()) % 5:
            for w in words(t):
                for o in tables:
                    tables[o][k].update(grams(w, o))
    for i, t, _ in rows:
        total = np.zeros(3)
        for w in words(t):
            for o in tables:
                known = [g for g in grams(w, o) if any(g in c for c in tables[o].values())]
                if known:
                    every = set().union(*tables[o].values())
                    size = [sum(c.values()) + langid.SMOOTH * len(every) for c in tables[o].values()]
                    logs = np.log([[(tables[o][k][g] + langid.SMOOTH) / n for k, n in zip(parts, size, strict=True)] for g in known])
                    total += np.clip((logs - logs.mean(axis=1, keepdims=True)).mean(axis=0), -langid.MOST_FOR_A_WORD, langid.MOST_FOR_A_WORD)
                    break
        n = len(words(t))
        if not n:
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0)
            continue
        share = np.exp((total - total.max()) * min(1, langid.EVIDENCE / n))
        share /= share.sum()
        assert got[i]["lang_pred"] == list(parts)[int(share.argmax())] and got[i]["score"] == pytest.approx(share.max(), abs=1e-4)


def test_language_held_out(spark, sf):
    from roomflow.llm.queries import QUERIES

    got = QUERIES["op8_language"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.95


def test_vectors(spark):
    from roomflow.llm.vectors import near_vectors

    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 1), (2, v, 1), (2, v, 1), (3, [2.0, 4.0, 6.0], 1), (4, v, 2), (5, v, None), (6, None, 1), (7, [0.0, 0.0, 0.0], 1), (8, [1.0, None, 3.0], 1), (9, [float("nan"), 1.0, 1.0], 1), (10, [float("inf"), 1.0, 1.0], 1), (11, [], 1), (None, v, 1), (12, [1.0, 2.0], 1), (13, [-1.0, -2.0, -3.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("size", F.lit("c")).withColumn("rep", F.lit(0))
    got = near_vectors(df, Stage(spark, "v")).toPandas()
    assert len(got) == len(rows)
    g = got.drop_duplicates("vec_id").set_index("vec_id")
    assert g.loc[[1, 2, 3]].n_links.tolist() == [3, 3, 3] and g.loc[[1, 2, 3]].component_id.tolist() == [1, 1, 1]
    assert (g.loc[[4, 5, 6, 7, 8, 9, 10, 11, 12, 13]].n_links == 0).all()
    assert near_vectors(df.where("false"), Stage(spark, "v")).count() == 0


def test_vectors_large_bucket(spark):
    from roomflow.llm.vectors import near_vectors

    rng = np.random.default_rng(3)
    x = np.concatenate([rng.standard_normal(16) + 0.07 * rng.standard_normal((700, 16)), rng.standard_normal((600, 16))])
    df = spark.createDataFrame([(i, r.tolist(), 0) for i, r in enumerate(x)], "vec_id long, embedding array<double>, label int")
    n = np.sqrt((x * x).sum(axis=1))
    link = (x @ x.T) / (n[:, None] * n[None, :]) >= 0.98
    np.fill_diagonal(link, False)
    got = near_vectors(df, Stage(spark, "v")).toPandas().set_index("vec_id").sort_index()
    assert abs(got.n_links.to_numpy() - link.sum(axis=1)).sum() <= 2e-4 * link.sum()


def test_sharding(spark, docs, none):
    from roomflow.llm.feistel import Permutation, shard_rows

    got = shard_rows(docs, Stage(spark, "f"), 4).toPandas()
    assert len(got) == len(ROWS) and got.groupby("shard").slot.agg(["count", "max"]).eval("count == max + 1").all()
    assert shard_rows(none, Stage(spark, "f"), 4).count() == 0
    for n in (1, 2, 3, 5, 64, 65, 1000):
        p = Permutation(n, 9)
        assert sorted(p.forward(np.arange(n)).tolist()) == list(range(n)) and (p.backward(p.forward(np.arange(n))) == np.arange(n)).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=300))
def test_words_round_trip(ids):
    from roomflow.llm.token_file import pack_words, unpack_words

    v = np.array(ids, np.uint64)
    assert (unpack_words(*pack_words(v), len(v)) == v).all()


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from(list("ab AB.,!'\n\t\x1c\xa0éÉσΣ▁中😀<|endoftext|>1")), max_size=60))
def test_chunks_equal_whole(text):
    import sentencepiece

    from roomflow.llm.chunks import encoder
    from roomflow.llm.piece_bpe import memo

    for name, leading in (("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)):
        e = encoder(public_tokenizers.path(name), leading)
        assert e.encode([text])[0].tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert memo(public_tokenizers.path("piece_bpe_32k.model")).encode([text])[0].tolist() == sp.encode(text)


def test_components_chain(spark):
    from roomflow.llm.components import components

    links = spark.range(1, 3000).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b")).repartition(16)
    got = components(links, Stage(spark, "c")).toPandas()
    assert len(got) == 3000 and (got.component == 0).all()


def test_components_in_shares(spark, monkeypatch):
    """Links of many shares, with links of a node with itself, repeated ones and nulls."""
    from roomflow.llm import components as operator

    monkeypatch.setattr(operator, "SHARE", 100)
    rows = [(i, i - 1) for i in range(1, 900) if i % 90] + [(5000, 5000), (7, 8), (7, 8), (None, 3), (4, None)]
    links = spark.createDataFrame(rows, "a long, b long").repartition(9)
    got = {r.node: r.component for r in operator.components(links, Stage(spark, "c")).collect()}
    assert got == {i: i - i % 90 for i in range(900)} | {5000: 5000}
    assert operator.components(links.where("false"), Stage(spark, "c")).count() == 0


def test_near_documents_tasks_follow_rows(spark, docs):
    """A small table does not pay for each of a shuffle's partitions in every step."""
    from roomflow.llm.set_join import near_duplicates

    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    sc, group = spark.sparkContext, f"near-{id(docs)}"
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        sc.setJobGroup(group, group)
        assert near_duplicates(docs, Stage(spark, "n"), size=5).count() == len(ROWS)
        told = sc.statusTracker()
        stages = {i for job in told.getJobIdsForGroup(group) for i in told.getJobInfo(job).stageIds}
        done = sum(x.numCompletedTasks for i in stages if (x := told.getStageInfo(i)))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert 0 < done < 700, done


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    frames, names = docs, docs.columns
    for name, step in corpus_pipeline.STAGES[:-1]:
        after = Stage(spark, "test").write(step(spark, frames, sf), name)
        assert after.columns == names and 0 < after.count() <= frames.count()
        assert after.join(frames, "doc_id", "left_anti").isEmpty()
        frames = after
    from test_operators import near_brute

    kept = frames.toPandas()
    _, top = near_brute(kept.doc_id.tolist(), kept.text.tolist(), 5)
    assert all(i == t for i, t in top.items())
    pieces = corpus_pipeline.run(spark, sf).toPandas()
    assert set(pieces.doc_id) == set(kept.doc_id) and (pieces.groupby("doc_id").length.sum() == pieces.groupby("doc_id").doc_tokens.first()).all()


def test_pipeline_edges(spark, sf, tmp_path):
    """Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns in every stage."""
    import corpus_pipeline

    words = [f"word{i}" for i in range(60)]
    rows = [(1, None, "en"), (2, "", "en"), (3, " ".join(words), "en"), (3, " ".join(words), "en"), (4, " ".join(words + ["more"]), None), (None, "only letters here", None), (5, "12 34 ½", "en"), (6, LONG, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit("clash") for c in CLASH})
    steps = dict(corpus_pipeline.STAGES)
    spark.createDataFrame([(3, 0), (6, 0)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    place, empty = str(tmp_path), docs.where("false")
    kept = steps["toxicity"](spark, docs, place)
    assert kept.columns == docs.columns and kept.count() == len(rows)  # no toxic label: nothing goes
    told = steps["language"](spark, docs, place)
    assert told.columns == docs.columns and sorted((r["doc_id"] or 0) for r in told.collect()) == [0, 3, 3, 4, 6]
    lone = steps["near_dedup"](spark, docs, place)
    assert lone.columns == docs.columns and sorted((r["doc_id"] or 0) for r in lone.collect()) == [0, 1, 2, 3, 5, 6]
    packed = steps["packing"](spark, docs, place).toPandas()
    assert packed[packed.start == 0].doc_tokens.min() == 1 and (packed.start == 0).sum() == len(rows)
    for name, step in corpus_pipeline.STAGES:
        assert step(spark, empty, place).count() == 0, name
