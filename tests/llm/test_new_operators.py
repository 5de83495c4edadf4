"""Filter audit, suffix tree and Merkle manifest against brute force, and their edge cases."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from roomflow.llm.common import Stage

LONG = "the wordy thing " * 4000
ROWS = [(1, None, "a", "en"), (2, "", "a", "en"), (3, "A b c d e f", "b", "en"), (3, "A b c d e f", "b", "en"), (None, "x Y z", None, None), (None, "x Y z", "", None), (5, LONG, "b", "en"), (6, LONG, "a", None), (4, LONG, None, "de"), (8, "der $ die\x0bdas und", "c", "de"), (9, "É😀 \x00 ẞ", "c", None), (0, "x Y z", "c", "xx")]
CLASH = ["tree", "idx", "n", "level", "leaf", "path", "root", "block", "part", "mask", "key", "bucket", "chunk", "data", "tokens", "batch", "id", "step", "held_out", "row_number"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, s, g, len(t) if t is not None else None) for i, t, s, g in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").withColumns({c: F.lit("clash") for c in CLASH})


@pytest.fixture(scope="module")
def corpus():
    """Sentences with habits, so that some contexts tell the next word, and copies of some."""
    draw = random.Random(5)
    nouns, verbs = [f"noun{i}" for i in range(12)], [f"verb{i}" for i in range(12)]
    out = []
    for i in range(160):
        words = []
        for _ in range(draw.randrange(1, 12)):
            k = draw.randrange(12)
            words += ["The", "é" + nouns[k], verbs[k] if draw.random() < 0.8 else draw.choice(verbs), draw.choice(["so", "then"])]
        out.append((i, " ".join(words)))
    return [*out, *((i + 500, out[i][1]) for i in range(20)), (900, ""), (901, None)]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def suffix_tree(rows, depth, least, gain):
    """The same tree from plain counts: {doc_id: (held_out, tokens, known, N, base, score)} and its states."""
    from roomflow.llm.suffix_tree import WEIGHTS

    tokens = [(i, zlib.crc32(str(i).encode()) % 7 == 2, [*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), None]) for i, t in rows]
    words = Counter(w for _, held, ws in tokens if not held for w in ws)
    total, contexts, grams, states = sum(words.values()), Counter(), Counter(), {}

    def context(ws, at, k):
        return tuple(["^", *ws][at + 1 - k : at + 1]) if at + 1 >= k else None

    def chance(c, w):
        if not c:
            return (words[w] + 1) / (total + len(words) + 1)
        q = chance(c[1:], w)
        if c not in states:
            return q
        pull = states[c] * contexts[c]
        return (grams[c, w] + pull * q) / (contexts[c] + pull)

    for _, held, ws in tokens:
        for at, w in enumerate(ws):
            for k in range(1, depth + 1):
                if not held and (c := context(ws, at, k)):
                    contexts[c] += 1
                    grams[c, w] += 1
    for k in range(1, depth + 1):
        sums = {}
        for (c, w), n in grams.items():
            if len(c) == k and contexts[c] >= least and (k == 1 or c[1:] in states):
                q, seen = chance(c[1:], w), contexts[c]
                row = sums.setdefault(c, [0.0] * len(WEIGHTS))
                for i, r in enumerate(WEIGHTS):
                    row[i] += n * (math.log((n - 1 + r * seen * q) / (seen - 1 + r * seen)) - math.log(q))
        states |= {c: WEIGHTS[row.index(max(row))] for c, row in sums.items() if max(row) > gain}
    out = {}
    for i, held, ws in tokens:
        found = [max((c for k in range(depth + 1) if (c := context(ws, at, k)) is not None and (not c or c in states)), key=len) for at in range(len(ws))]
        base = sum(math.log10((words[w] + 1) / (total + len(words) + 1)) for w in ws)
        out[i] = (held, len(ws), sum(words[w] > 0 for w in ws), total, base, sum(math.log10(chance(c, w)) for c, w in zip(found, ws, strict=True)))
    return out, states


@pytest.mark.parametrize(("depth", "small"), [(1, False), (2, True), (3, False)])
def test_suffix_tree(spark, corpus, monkeypatch, depth, small):
    from roomflow.llm import suffix_tree as operator

    docs = spark.createDataFrame(corpus, "doc_id long, text string").repartition(3)
    if small:  # chunks of a few documents and many buckets
        monkeypatch.setattr(operator, "BUCKET_KEYS", 40)
        monkeypatch.setattr(operator, "CHUNK_TOKENS", 300)
        monkeypatch.setattr(operator, "SPLIT_BYTES", 200)
        docs = docs.repartition(9)
    want, states = suffix_tree(corpus, depth, 4, 2.0)
    assert {len(c) for c in states} == set(range(1, depth + 1))
    got = {r.doc_id: r for r in operator.score(docs, Stage(spark, "t"), depth=depth, least=4, gain=2.0).collect()}
    assert set(got) == set(want)
    for i, (held, n, known, total, base, score) in want.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert abs(r.base_score - base) < 1e-8 and abs(r.score - score) < 1e-8
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)  # contexts help on unseen documents


def test_suffix_tree_edges(spark, docs):
    from roomflow.llm.suffix_tree import score

    got = score(docs, Stage(spark, "t"), least=2, gain=0.1).collect()
    assert len(got) == len(ROWS)
    want = suffix_tree([r[:2] for r in ROWS], 2, 2, 0.1)[0]
    for r in got:
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][1:4] and abs(r.base_score - want[r.doc_id][4]) < 1e-6 and math.isfinite(r.score)
    assert score(docs.where("false"), Stage(spark, "t")).count() == 0
    alone = score(docs.where("doc_id = 8"), Stage(spark, "t"), folds=1, fold=0).first()  # nothing to learn from
    assert (alone.train_tokens, alone.base_score, alone.score, alone.n_known) == (0, 0.0, 0.0, 0)


def merkle(rows, fan):
    """doc_id -> (leaf, subroot, root, proof, folded) for rows of (doc_id, source, lang, n_chars, text) without repeats."""
    def h(*x):
        return hashlib.sha256("".join(x).encode()).hexdigest()

    def leaf(values):
        return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    def climb(hashes):
        """Root and for each node its siblings as (before, after), level by level."""
        paths, places, level = [[] for _ in hashes], list(range(len(hashes))), list(hashes)
        while len(level) > 1:
            for path, at in zip(paths, places, strict=True):
                run = level[at - at % fan : at - at % fan + fan]
                path.append(("".join(run[: at % fan]), "".join(run[at % fan + 1 :])))
            level = [h(*level[i : i + fan]) for i in range(0, len(level), fan)]
            places = [p // fan for p in places]
        return level[0], paths

    groups = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, (r[1] or "").encode(), r[0] is not None, r[0] or 0, leaf(r))):
        groups.setdefault(r[1], []).append(r)
    trees = {g: climb([leaf(r) for r in held]) for g, held in groups.items()}
    root, above = climb([t[0] for t in trees.values()])
    out = {}
    for (held, (subroot, paths)), rest in zip(((groups[g], trees[g]) for g in groups), above, strict=True):
        for r, path in zip(held, paths, strict=True):
            other = leaf((*r[:4], lower(r[4]) if r[4] is not None else None)) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else leaf(r)
            for before, after in path + rest:
                other = h(before, other, after)
            out[r] = (leaf(r), subroot, root, h(*(b + a for b, a in path + rest)), other)
    return out


@pytest.mark.parametrize("fan", [2, 3, 16])
def test_merkle(spark, fan):
    from roomflow.llm.merkle import verify

    rows = [(i * 3, None if i % 11 == 0 else f"s{i % 3 if i % 2 else 0}", "en" if i % 4 else None, i, f"Text {i} É") for i in range(90)] + [(1000, "alone", "de", 3, "X"), (1001, "", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = {r.doc_id: r for r in verify(docs, Stage(spark, "m"), fan=fan).collect()}
    want = merkle(rows, fan)
    assert len(got) == len(rows)
    for r in rows:
        g = got[r[0]]
        assert (g.leaf, g.subroot, g.root, g.proof_sha256, g.folded_root) == want[r], r
        assert g.verified == (g.folded_root == g.root)
    assert 0 < sum(not g.verified for g in got.values()) < 40


def test_merkle_edges(spark, docs):
    from roomflow.llm.merkle import build, root_of, verify

    got = verify(docs, Stage(spark, "m"), fan=2).collect()
    assert len(got) == len(ROWS) and len({r.root for r in got}) == 1
    want = {x[0]: x for x in merkle([(i, s, g, len(t) if t is not None else None, t) for i, t, s, g in ROWS], 2).values()}
    assert {r.leaf for r in got} == set(want) and {r.root for r in got} == {x[2] for x in want.values()}
    assert root_of(build(docs, Stage(spark, "m"), fan=2)).collect() == [(got[0].root,)]  # the same whatever the partitions
    assert verify(docs.where("false"), Stage(spark, "m")).count() == 0 and root_of(build(docs.where("false"), Stage(spark, "m"))).count() == 0
    one = verify(docs.where("doc_id = 8"), Stage(spark, "m")).first()
    assert one.leaf == one.subroot == one.root and one.proof_sha256 == hashlib.sha256(b"").hexdigest()


def audited(rows, labels):
    """(part, order, step) -> the eight sums, from definitions."""
    def fails(i, text):
        t, w = text or "", re.findall(r"[^\x20\x09-\x0D]+", text or "")
        return (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search(r"[#$%&*|]", t)), any(j is not None and i is not None and j < i and (u or "") == t for j, u, *_ in rows))

    judged = [(s or "", fails(i, t), i in labels and labels[i][0], i in labels and labels[i][1]) for i, t, s, *_ in rows]
    out = {}
    for order in itertools.permutations(range(5)):
        for part in {j[0] for j in judged}:
            own, before = [j for j in judged if j[0] == part], set()
            for step, f in enumerate(order):
                gone = [j for j in own if any(j[1][b] for b in before)]
                now = [j for j in own if j[1][f] and not any(j[1][b] for b in before)]
                out[part, "".join("ABCDE"[i] for i in order), step + 1] = [len(own) - len(gone) - len(now), len(now), sum(j[1][f] for j in gone), sum(j[1][f] and sum(j[1]) == 1 for j in own), sum(j[2] for j in now), sum(j[3] for j in now)]
                before.add(f)
    shapley = Counter()
    for (part, order, step), row in out.items():
        shapley[part, order[step - 1]] += row[1]
    return {k: (*row, shapley[k[0], k[1][k[2] - 1]]) for k, row in out.items()}


def as_dict(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def test_filter_audit(spark, docs, tmp_path):
    """Files that come later hold smaller ids, so what was counted is taken back; the same counters as from definitions after each run."""
    from roomflow.llm.filter_audit import FilterAudit, interactions

    labels = spark.createDataFrame([(3, 1, 0), (5, 1, 1), (4, 0, 1), (4, 1, 0), (9, None, 1), (None, 1, 1), (77, 1, 1)], "doc_id long, quality int, toxic int")
    known = {3: (1, 0), 5: (1, 1), 4: (1, 1), 9: (0, 1), 77: (1, 1)}
    path, folder = str(tmp_path / "docs"), f"{Stage(spark, 'audit').path}/run"
    audit = FilterAudit(spark, path, labels, folder, batches=2)
    seen = []
    for ids in ([6, 8, 3], [5, 9, 1, None], [4, 0, 2]):
        part = docs.where(F.col("doc_id").isin([i for i in ids if i is not None]) | (F.col("doc_id").isNull() & F.lit(None in ids)))
        part.coalesce(2).write.mode("append").parquet(path)
        seen += [r for r in ROWS if r[0] in ids]
        audit.advance()
        assert as_dict(interactions(audit.counters())) == audited(seen, known)
    assert len(seen) == len(ROWS)
    audit.advance()  # nothing new
    assert as_dict(interactions(audit.counters())) == audited(ROWS, known)


def test_filter_audit_empty(spark, docs, tmp_path):
    from roomflow.llm.filter_audit import audit

    path = str(tmp_path / "none")
    docs.where("false").write.parquet(path)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit(spark, path, labels, Stage(spark, "audit")).count() == 0
