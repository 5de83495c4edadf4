"""The queries of the numbered operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomflow.llm.common import Stage


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from roomflow.llm.token_file import read_tokens, write_tokens

    segments = write_tokens(_table(spark, sf_dir, "documents"), Stage(spark, "tokens"), "segments", public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_tokens(segments, with_ids=False)


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from roomflow.llm.piece_bpe import encode_decode

    done = encode_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_near_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roomflow.llm.set_join import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), Stage(spark, "near"), size=2, percent=80)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roomflow.llm.toxicity import fit_toxicity, score_toxicity

    docs = _table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, _table(spark, sf_dir, "labels")))


def op5_spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roomflow.llm.spots import fingerprints

    return fingerprints(_table(spark, sf_dir, "documents"))


URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roomflow.llm.url_rules import judge

    return judge(_table(spark, sf_dir, "pages"), URL_RULES, Stage(spark, "urls"), default="allow")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from roomflow.llm.packing import pack

    pieces = pack(_table(spark, sf_dir, "documents"), Stage(spark, "packing"), public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=0)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roomflow.llm.langid import fit, identify

    docs = _table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))


def op9_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roomflow.llm.vectors import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"), Stage(spark, "vectors"), threshold=0.98)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roomflow.llm.feistel import shard_rows

    return shard_rows(_table(spark, sf_dir, "documents"), Stage(spark, "shards"), shards=24)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roomflow.llm.filter_audit import audit

    return audit(spark, f"{sf_dir}/documents.parquet", _table(spark, sf_dir, "labels"), Stage(spark, "audit"))


def op12_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roomflow.llm.suffix_tree import score

    return score(_table(spark, sf_dir, "documents"), Stage(spark, "suffixes"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roomflow.llm.merkle import verify

    return verify(_table(spark, sf_dir, "documents"), Stage(spark, "merkle"), fan=16)


QUERIES = {f.__name__: f for f in (op1_token_file, op2_pieces, op3_near_documents, op4_toxicity, op5_spots, op6_url_rules, op7_packing, op8_language, op9_near_vectors, op10_sharding, op11_filter_audit, op12_suffix_tree, op13_merkle)}

_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)

def _crc(value: str) -> str:
    """CRC-32 of a number's decimal text in SQL, bit by bit."""
    bits = "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)"
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split({value}::VARCHAR, ''), lambda d: ascii(d)::BIGINT)), lambda c, b: {bits}), 4294967295)"


def _fields(text: str) -> str:
    return " || ".join(f"CASE WHEN {f} IS NULL THEN '-' ELSE strlen({f}::VARCHAR) || ':' || {f} END" for f in ("doc_id", "source", "lang", "n_chars", text))


_BEFORE = "array_to_string(hs[:idx % 16], '')"
_AFTER = "array_to_string(hs[idx % 16 + 2:], '')"

ORACLE_SQL = {
    "op6_url_rules": f"""
        WITH parts AS (
            SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        split AS (
            SELECT page_id, lower(regexp_extract(rest, '^[^/?#]*')) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
        rules(h, p, v) AS (VALUES {_RULES}),
        ranked AS (
            SELECT page_id, host, path, h || p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC NULLS LAST) AS nth
            FROM split LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
        SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM ranked WHERE nth = 1""",
    "op9_near_vectors": """
        WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
        good AS (SELECT * FROM v WHERE label IS NOT NULL AND list_dot_product(e, e) > 0),
        links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id
            WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98),
        reach(vec_id, seen) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.seen = l.a),
        counts AS (SELECT a, count(*) AS n FROM links GROUP BY a),
        tops AS (SELECT vec_id, min(seen) AS component_id FROM reach GROUP BY vec_id)
        SELECT t.vec_id, coalesce(n, 0) AS n_links, component_id, t.vec_id = component_id AS kept FROM tops t LEFT JOIN counts ON a = t.vec_id""",
    "op3_near_documents": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+'), lambda x: x <> '') AS w FROM documents),
        sets AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words),
        classes AS (SELECT list_sort(s) AS s, min(doc_id) AS rep FROM sets GROUP BY 1),
        held AS (SELECT rep, len(s) AS n, unnest(s) AS x FROM classes),
        seen AS (SELECT x, count(*) AS c FROM held GROUP BY x),
        ranked AS (SELECT rep, n, held.x, row_number() OVER (PARTITION BY rep ORDER BY c, held.x) AS nth FROM held JOIN seen USING (x)),
        rare AS (SELECT rep, n, x FROM ranked WHERE nth <= n - ceil(n * 0.8) + 1),
        maybe AS (SELECT DISTINCT a.rep AS a, b.rep AS b FROM rare a JOIN rare b ON a.x = b.x AND a.rep < b.rep AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n),
        linked AS (
            SELECT a, b FROM maybe JOIN classes p ON p.rep = a JOIN classes q ON q.rep = b
            WHERE 100 * len(list_intersect(p.s, q.s)) >= 80 * (len(p.s) + len(q.s) - len(list_intersect(p.s, q.s)))),
        both_ways AS (SELECT a, b FROM linked UNION SELECT b, a FROM linked),
        reach(rep, seen) AS (SELECT rep, rep FROM classes UNION SELECT r.rep, l.b FROM reach r JOIN both_ways l ON r.seen = l.a),
        tops AS (SELECT rep, min(seen) AS top FROM reach GROUP BY rep)
        SELECT d.doc_id, len(d.s)::BIGINT AS n_shingles, CASE WHEN len(d.s) = 0 THEN d.doc_id ELSE top END AS component_id, d.doc_id = CASE WHEN len(d.s) = 0 THEN d.doc_id ELSE top END AS kept
        FROM sets d JOIN classes c ON list_sort(d.s) = c.s JOIN tops USING (rep)""",
    "op11_filter_audit": r"""
        WITH RECURSIVE texts AS (
            SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') AS w,
                min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id FROM documents),
        known AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
        failed AS (
            SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(first_id < d.doc_id, false)] AS f
            FROM texts d LEFT JOIN known k ON d.doc_id = k.doc_id),
        sets AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY part, f),
        orders(o) AS (SELECT [i] FROM range(1, 6) r(i) UNION ALL SELECT list_append(o, i) FROM orders, range(1, 6) r(i) WHERE NOT list_contains(o, i)),
        steps AS (SELECT array_to_string(list_transform(o, lambda i: chr(64 + i::INT)), '') AS filter_order, s::INT AS step, o[s] AS i, o[:s - 1] AS before FROM orders, range(1, 6) r(s) WHERE len(o) = 5),
        told AS (
            SELECT part, filter_order, step, i, sum(CASE WHEN NOT f[i] AND NOT early THEN n ELSE 0 END) AS kept, sum(CASE WHEN f[i] AND NOT early THEN n ELSE 0 END) AS removed,
                sum(CASE WHEN f[i] AND early THEN n ELSE 0 END) AS redundant, sum(CASE WHEN f[i] AND len(list_filter(f, lambda x: x)) = 1 THEN n ELSE 0 END) AS unique_fails,
                sum(CASE WHEN f[i] AND NOT early THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN f[i] AND NOT early THEN toxic ELSE 0 END) AS toxic_lost
            FROM (SELECT *, len(list_filter(before, lambda b: f[b])) > 0 AS early FROM sets, steps) GROUP BY ALL)
        SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
            good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, i))::BIGINT AS shapley FROM told""",
    "op13_merkle": f"""
        WITH RECURSIVE marked AS (
            SELECT doc_id, source, lang, n_chars, text, coalesce({_crc("doc_id")} % 5 = 0, false) AS hit FROM documents),
        both_texts AS (
            SELECT *, CASE WHEN hit THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS other FROM marked),
        hashed AS (
            SELECT doc_id, source, sha256({_fields("text")}) AS leaf, sha256({_fields("other")}) AS other_leaf FROM both_texts),
        leaves AS (
            SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM hashed),
        tree(source, level, idx, n, h) AS (
            SELECT source, 0, idx, n, leaf FROM leaves
            UNION ALL SELECT source, level + 1, idx // 16, (max(n) + 15) // 16, sha256(string_agg(h, '' ORDER BY idx)) FROM tree WHERE n > 1 GROUP BY source, level, idx // 16),
        runs AS (SELECT source, level, idx // 16 AS run, list(h ORDER BY idx) AS hs FROM tree WHERE n > 1 GROUP BY ALL),
        subroots AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM tree WHERE n = 1),
        top(level, idx, n, h) AS (
            SELECT 0, idx, n, subroot FROM subroots
            UNION ALL SELECT level + 1, idx // 16, (max(n) + 15) // 16, sha256(string_agg(h, '' ORDER BY idx)) FROM top WHERE n > 1 GROUP BY level, idx // 16),
        top_runs AS (SELECT level, idx // 16 AS run, list(h ORDER BY idx) AS hs FROM top WHERE n > 1 GROUP BY ALL),
        low(doc_id, source, leaf, level, idx, n, proof, folded) AS (
            SELECT doc_id, source, leaf, 0, idx, n, '', other_leaf FROM leaves
            UNION ALL SELECT doc_id, f.source, leaf, f.level + 1, idx // 16, (n + 15) // 16, proof || {_BEFORE} || {_AFTER}, sha256({_BEFORE} || folded || {_AFTER})
            FROM low f JOIN runs r ON f.source IS NOT DISTINCT FROM r.source AND f.level = r.level AND idx // 16 = r.run WHERE n > 1),
        high(doc_id, leaf, subroot, level, idx, n, proof, folded) AS (
            SELECT doc_id, leaf, subroot, 0, s.idx, s.n, proof, folded FROM low f JOIN subroots s ON f.source IS NOT DISTINCT FROM s.source WHERE f.n = 1
            UNION ALL SELECT doc_id, leaf, subroot, f.level + 1, idx // 16, (n + 15) // 16, proof || {_BEFORE} || {_AFTER}, sha256({_BEFORE} || folded || {_AFTER})
            FROM high f JOIN top_runs r ON f.level = r.level AND idx // 16 = r.run WHERE n > 1)
        SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = h AS verified
        FROM high CROSS JOIN (SELECT h FROM top WHERE n = 1) WHERE n = 1""",
}
