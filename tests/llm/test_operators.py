"""The numbered queries against brute force over whole tables."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def docs(sf):
    return pq.read_table(f"{sf}/documents.parquet").to_pandas().sort_values("doc_id").reset_index(drop=True)


@pytest.fixture(scope="module")
def q():
    from roomflow.llm.queries import QUERIES

    return QUERIES


def _components(ids, links):
    top = {i: i for i in ids}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        top[y] = x
    return {i: find(i) for i in ids}


def _crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op1(spark, sf, docs, q):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = q["op1_token_file"](spark, sf).toPandas().set_index("doc_id")
    start = 0
    for r in docs.itertuples():
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 2]
        assert tuple(got.loc[r.doc_id][["start", "n_tokens", "ids_crc32"]]) == (start, len(ids), _crc(ids))
        start += len(ids)
    assert len(got) == len(docs)


def test_op2(spark, sf, docs, q):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = q["op2_pieces"](spark, sf).toPandas().set_index("doc_id")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in docs.itertuples():
        ids = sp.encode(r.text or "")
        assert tuple(got.loc[r.doc_id]) == (len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids)))
    assert len(got) == len(docs)


def _sets(texts, size):
    out = []
    for t in texts:
        w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        out.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    return out


def near_brute(ids, texts, size, percent=80):
    sets = dict(zip(ids, _sets(texts, size), strict=True))
    held, common, links = defaultdict(list), defaultdict(int), []
    for i, s in sets.items():
        for x in s:
            held[x].append(i)
    for group in held.values():
        for k, a in enumerate(group):
            for b in group[k + 1 :]:
                common[a, b] += 1
    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            links.append((a, b))
    return sets, _components(ids, links)


def test_op3(spark, sf, docs, q):
    sets, top = near_brute(docs.doc_id, docs.text, 2)
    got = q["op3_near_documents"](spark, sf).toPandas().set_index("doc_id")
    assert len(got) == len(docs)
    assert {i: len(s) for i, s in sets.items()} == got.n_shingles.to_dict()
    assert top == got.component_id.to_dict()
    assert (got.kept == (got.index == got.component_id)).all()


def brute_spots(text):
    """Signatures: an anchor with the next two words that aren't anchors."""
    from roomflow.llm.spots import ANCHORS

    words = re.sub(r"[\W_]+", " ", text.lower()).split()
    found = set()
    for i, w in enumerate(words):
        if w in ANCHORS and len(chain := [x for x in words[i + 1 :] if x not in ANCHORS][:2]) == 2:
            found.add((w, *chain))
    return found or {" ".join(words) or text}


def test_op5(spark, sf, docs, q):
    spots = lambda text: brute_spots(text)

    down = docs.sort_values("doc_id", ascending=False).reset_index(drop=True)
    texts = [t or "" for t in down.text]
    got = q["op5_spots"](spark, sf).toPandas().set_index("doc_id")
    assert len(got) == len(docs)
    for i, (d, t) in enumerate(zip(down.doc_id, texts, strict=True)):
        after, k, r = texts[(i + 1) % len(texts)], len(t) // 3, got.loc[d]
        edited = t[: len(t) - k] + after[:k]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = spots(t), spots(edited), spots(after)
        like = lambda x, y: len(x & y) / len(x | y)
        assert r.near_edited == pytest.approx(like(a, b), abs=1e-9) and r.near_next == pytest.approx(like(a, c), abs=1e-9)
    again = down.assign(f=[got.loc[d].fingerprint for d in down.doc_id]).groupby("text").f.nunique()
    assert (again == 1).all()


def test_op5_pairs(spark, sf, docs):
    """Near pairs of representatives and their members against all pairs, with copies and an element that all documents share."""
    from roomflow.llm.common import Stage
    from roomflow.llm.spots import near_pairs

    texts = [t or "" for t in docs.text] + [f"the common passage the word{k} other{k}" for k in range(40)] + ["the same text of all copies"] * 5
    texts += [" ".join(f"the w{i} x{i}" for i in range(30 + k % 3)) for k in range(8)]
    ids = list(range(len(texts)))
    pairs, members = near_pairs(spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string"), Stage(spark, "s"), least=0.8, block=16)
    sets = [frozenset(brute_spots(t)) for t in texts]
    first = {}
    for i, s in zip(ids, sets, strict=True):
        first.setdefault(s, i)
    assert {r["id"]: r["representative"] for r in members.collect()} == {i: first[s] for i, s in zip(ids, sets, strict=True)}
    reps = [(i, s) for s, i in first.items()]
    want = {(min(i, j), max(i, j)): len(s & t) / len(s | t) for k, (i, s) in enumerate(reps) for j, t in reps[:k] if len(s & t) >= 0.8 * len(s | t)}
    got = {(r["a"], r["b"]): r["likeness"] for r in pairs.collect()}
    assert got == pytest.approx(want) and len(want) > 3


def test_op6(spark, sf, q):
    from roomflow.llm.queries import URL_RULES

    pages = pq.read_table(f"{sf}/pages.parquet").to_pandas()
    got = q["op6_url_rules"](spark, sf).toPandas().set_index("page_id")
    for r in pages.itertuples():
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", r.url or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        assert tuple(got.loc[r.page_id]) == (host, path, best[1], best[2])
    assert len(got) == len(pages)


def test_op7(spark, sf, docs, q):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = q["op7_packing"](spark, sf).toPandas()
    ids = {r.doc_id: [*t.encode(r.text or "", add_special_tokens=False).ids, 0] for r in docs.itertuples()}
    for d, pieces in got.sort_values("start").groupby("doc_id"):
        at = 0
        for p in pieces.itertuples():
            assert p.start == at and p.doc_tokens == len(ids[d]) and p.ids_crc32 == _crc(ids[d][at : at + p.length])
            at += p.length
        assert at == len(ids[d])
    assert set(got.doc_id) == set(ids)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 1024
    assert got.sequence_id.nunique() == got.sequence_id.max() + 1
    assert got.length.sum() / (1024 * got.sequence_id.nunique()) > 0.95


def test_op9(spark, sf, q):
    t = pq.read_table(f"{sf}/embeddings.parquet").to_pandas()
    got = q["op9_near_vectors"](spark, sf).toPandas().set_index("vec_id")
    v = np.stack(t.embedding).astype(float)
    n = np.sqrt((v * v).sum(axis=1))
    link = ((v @ v.T) / (n[:, None] * n[None, :]) >= 0.98) & (t.label.to_numpy()[:, None] == t.label.to_numpy()[None, :])
    np.fill_diagonal(link, False)
    ids = t.vec_id.tolist()
    top = _components(ids, [(ids[a], ids[b]) for a, b in np.argwhere(link)])
    assert got.n_links.to_dict() == dict(zip(ids, link.sum(axis=1).tolist(), strict=True))
    assert got.component_id.to_dict() == top


def test_op10(spark, sf, docs, q):
    from roomflow.llm.feistel import Permutation

    got = q["op10_sharding"](spark, sf).toPandas().set_index("doc_id")
    assert len(got) == len(docs)
    p = Permutation(len(docs), 17)
    for row, r in enumerate(docs.itertuples()):
        raw, g = (r.text or "").encode(), got.loc[r.doc_id]
        assert (g["size"], g["text_crc32"], g["law"], g["row_number"]) == (len(raw) + 8, zlib.crc32(raw), "rows", row)
        assert p.row(int(g["shard"]), int(g["slot"]), 24) == row
    counts = got.groupby("shard").slot.agg(["count", "max"])
    assert len(counts) == 24 and counts["count"].max() - counts["count"].min() <= 1 and (counts["max"] + 1 == counts["count"]).all()
    assert got.grown_shard.isna().all()
