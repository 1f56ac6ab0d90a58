"""The registered queries of the operators, and DuckDB SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import (
    bpe, centroids, chat, decontaminate, langid, license_scan, merkle, mixing, pii, simhash, token_store, topk, url_filter,
)
from palimpsest.session import table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: A page that holds one of these words puts its URL on the blocked list, for all pages with that canonical URL.
LISTING_WORDS = ("casino", "viagra", "jackpot")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    bad = F.lower("html").rlike("|".join(LISTING_WORDS))
    return url_filter.judge_urls(pages, pages.filter(bad).select("url"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), TOKENIZER)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    base = F.sha2(pii.span_text(F.col("base")), 256).alias("base_sha256")
    return found.select("doc_id", *counts, base, pii.span_text(F.concat("base", "added")).alias("spans"))


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store_and_read(table(spark, sf_dir, "documents"), TOKENIZER)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    record = spark.range(1).select(
        F.lit(-1).cast("long").alias("conv_id"), F.to_json(F.struct(F.lit(said).alias("prompt"), F.lit(said).alias("completion"))).alias("record")
    )
    extra = chat.turns_of_records(record).select("conv_id", F.inline("turns"))
    rows = chat.turns_of_rows(table(spark, sf_dir, "conversations"))
    back = chat.read_turns(chat.format_turns(rows.unionByName(extra)))
    turns_text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss_text = F.array_join("loss_texts", "")
    texts = back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), turns_text.alias("t"), loss_text.alias("l"), "formatted_chars")
    return texts.select(
        "conv_id", "n_turns", F.sha2("t", 256).alias("turns_sha256"), F.char_length("l").cast("long").alias("loss_chars"),
        F.sha2("l", 256).alias("loss_sha256"), "formatted_chars",
    )


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: Columns of documents in the order in which a leaf holds them.
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    tampered = [F.translate(c, upper, lower) if c == "text" else F.col(c) for c in LEAF_COLUMNS]
    hit = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    candidate = F.when(hit, F.unhex(merkle.leaf_digest(*tampered)))
    leaf = merkle.leaf_digest(*map(F.col, LEAF_COLUMNS))
    found = merkle.proofs(docs, F.col("source"), F.col("doc_id"), leaf, {"candidate": candidate})
    received = F.coalesce(F.lower(F.hex("carried.candidate")), F.col("leaf"))
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    return found.select(
        F.col("key").alias("doc_id"), "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), merkle.fold(received, F.col("path")).alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.with_inertia(*centroids.cluster(table(spark, sf_dir, "embeddings")))


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            op1_url_filter, op2_decontaminate, op3_license_scan, op4_top_k, op5_bpe, op6_pii, op7_token_store, op8_simhash,
            op9_language, op10_chat, op11_mixing, op12_merkle, op13_centroids,
        )
    }


_OP1_SQL = r"""
WITH u AS (
  SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), c AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') END AS canon FROM p
), rules(verdict, rhost, rpath) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), best AS (
  SELECT s.host, s.path, max_by(r.rhost || r.rpath, length(r.rhost || r.rpath)) AS rule, max_by(r.verdict, length(r.rhost || r.rpath)) AS verdict
  FROM (SELECT DISTINCT host, path FROM p) s JOIN rules r ON (s.host = r.rhost OR ends_with(s.host, '.' || r.rhost)) AND starts_with(s.path, r.rpath)
  GROUP BY 1, 2
), listed AS (
  SELECT DISTINCT canon FROM c WHERE canon IS NOT NULL AND regexp_matches(lower(html), 'casino|viagra|jackpot')
)
SELECT c.page_id, c.host, c.path, b.rule, coalesce(b.verdict, CASE WHEN l.canon IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, l.canon IS NOT NULL AS listed
FROM c LEFT JOIN best b ON b.host = c.host AND b.path = c.path LEFT JOIN listed l ON l.canon = c.canon
"""

_OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, r.vec_id, CAST(list_sum(list_transform(list_zip(q.v, r.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v r ON q.vec_id % 100 = 0 AND q.vec_id <> r.vec_id AND len(q.v) = len(r.v)
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""

_OP10_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), e AS (
  SELECT *, regexp_replace(regexp_replace(replace(text, '\', '\\'), '<(\||/?s>|</?SYS>>|/SYS>>)', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g') AS body FROM rows
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(body) + length(role) + 17) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


_OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('11:' || coalesce(CAST(doc_id AS VARCHAR), '-')) AS key FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT source, source_size, 2 * source_size AS most, ([5, 2, 1])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s
), f AS (
  SELECT coalesce(sum(most) OVER o, 0) AS limits, coalesce(sum(weight) OVER o, 0) AS weights FROM w
  WINDOW o AS (ORDER BY most / weight ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT max((CAST(1.5 AS DOUBLE) * (SELECT sum(source_size) FROM w) - limits) / ((SELECT sum(weight) FROM w) - weights)) AS level FROM f
), t AS (
  SELECT source, source_size, least(CAST(most AS DOUBLE), (SELECT level FROM level) * weight) AS target FROM w
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
         CASE WHEN t.source_size > 0 THEN CAST(floor(t.target) AS BIGINT) // t.source_size ELSE 0 END AS epochs,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id NULLS FIRST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(budget - epochs * source_size - before, size)) AS BIGINT) AS taken FROM p
"""

#: Levels of runs that the SQL unrolls for a source, and for the tree over sources: 16^5 leaves and 16^3 sources.
_OP12_LEVELS, _OP12_TOP = 5, 3
_CRC32 = """xor(4294967295, list_reduce(list_transform(range(length(CAST(doc_id AS VARCHAR))), lambda i: CAST(ord(substr(CAST(doc_id AS VARCHAR), CAST(i + 1 AS BIGINT), 1)) AS BIGINT)),
  lambda crc, c: list_reduce(range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(crc, c)), CAST(4294967295 AS BIGINT)))"""


def _op12_sql() -> str:
    def part(c: str) -> str:
        return f"coalesce(CAST(octet_length(encode(CAST({c} AS VARCHAR))) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(part(text if c == "text" else c) for c in LEAF_COLUMNS) + ")"

    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps = [
        f"l AS (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN {_CRC32} % 5 = 0 THEN {leaf(low)} END AS candidate FROM documents)",
        "a AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS j FROM l)",
    ]

    def climb(name: str, group: str, first: str, levels: int) -> str:
        """Tables {name}0 ... of (group, j, digest); a level of one node stays as it is. Returns the last one's name."""
        steps.append(f"{name}0 AS ({first})")
        for k in range(levels):
            steps.append(f"{name}n{k} AS (SELECT *, count(*) OVER (PARTITION BY {group}) AS size FROM {name}{k})")
            steps.append(
                f"{name}{k + 1} AS (SELECT {group}, j // 16 AS j, CASE WHEN any_value(size) > 1 THEN sha256(string_agg(digest, '' ORDER BY j)) ELSE any_value(digest) END AS digest FROM {name}n{k} GROUP BY {group}, j // 16)"
            )
            steps.append(
                f"{name}s{k} AS (SELECT x.{group}, x.j, coalesce(string_agg(y.digest, '' ORDER BY y.j) FILTER (y.j < x.j), '') AS lft, coalesce(string_agg(y.digest, '' ORDER BY y.j) FILTER (y.j > x.j), '') AS rgt, any_value(x.size) AS size"
                f" FROM {name}n{k} x JOIN {name}n{k} y ON x.{group} IS NOT DISTINCT FROM y.{group} AND x.j // 16 = y.j // 16 GROUP BY x.{group}, x.j)"
            )
        return f"{name}{levels}"

    tops = climb("d", "source", "SELECT source, j, leaf AS digest FROM a", _OP12_LEVELS)
    steps.append(f"r AS (SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i FROM {tops})")
    root = climb("t", "one", "SELECT 1 AS one, i AS j, subroot AS digest FROM r", _OP12_TOP)
    joins, lefts = [], []
    for k in range(_OP12_LEVELS):
        joins.append(f"JOIN ds{k} ON ds{k}.source IS NOT DISTINCT FROM a.source AND ds{k}.j = a.j // {16**k}")
        lefts.append(f"ds{k}")
    for k in range(_OP12_TOP):
        joins.append(f"JOIN ts{k} ON ts{k}.j = r.i // {16**k}")
        lefts.append(f"ts{k}")
    proof = " || ".join(f"{s}.lft || {s}.rgt" for s in lefts)
    # one level after the other, as nesting them would repeat what is folded so far
    body = ", ".join(steps)
    sides = ", ".join(f"{s}.lft AS l{i}, {s}.rgt AS r{i}, {s}.size AS z{i}" for i, s in enumerate(lefts))
    body += f", f0 AS (SELECT a.doc_id, a.leaf, r.subroot, {root}.digest AS root, sha256({proof}) AS proof_sha256, coalesce(a.candidate, a.leaf) AS folded_root, {sides} FROM a JOIN r ON r.source IS NOT DISTINCT FROM a.source JOIN {root} ON true {' '.join(joins)})"
    for i in range(len(lefts)):
        body += f", f{i + 1} AS (SELECT * REPLACE (CASE WHEN z{i} > 1 THEN sha256(l{i} || folded_root || r{i}) ELSE folded_root END AS folded_root) FROM f{i})"
    return f"WITH {body} SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM f{len(lefts)}"


def _op13_sql(k: int = centroids.K, rounds: int = centroids.ROUNDS) -> str:
    steps = [
        "v AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings "
        "WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS c, v AS m FROM v QUALIFY c < {k})",
    ]
    for r in range(rounds + 1):
        steps.append(
            f"a{r} AS MATERIALIZED (SELECT id, any_value(vec_id) AS vec_id, min_by(c, d * {k} + c) AS c, min(d) AS d FROM (SELECT id, vec_id, c, CAST(list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM v JOIN c{r} ON true) GROUP BY id)"
        )
        if r < rounds:
            steps.append(
                f"e{r} AS (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range(64)) AS i FROM a{r} JOIN v USING (id)) GROUP BY c, i)"
            )
            steps.append(f"n{r} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM e{r} GROUP BY c)")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c, coalesce(n{r}.m, c{r}.m) AS m FROM c{r} LEFT JOIN n{r} USING (c))")
    last = f"a{rounds}"
    return (
        "WITH " + ", ".join(steps) + f" SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256 FROM {last} JOIN c{rounds} USING (c)"
    )


def oracle_sql() -> dict:
    return {
        "op1_url_filter": _OP1_SQL, "op4_top_k": _OP4_SQL, "op10_chat": _OP10_SQL, "op11_mixing": _OP11_SQL, "op12_merkle": _op12_sql(), "op13_centroids": _op13_sql(),
    }
