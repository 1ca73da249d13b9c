"""The opN queries: thin digests of the operators over the driver's whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens.llm import chat, mixing, outliers, ownership, packing, periodic, quality_knn, sharding, simhash, substring_cover, topk, turn_repair, warc

SHARD_BYTES = 1 << 20


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def fit_quality(spark: SparkSession, sf_dir: str) -> quality_knn.LatentVotes:
    """The classifier of op1: fitted on labelled documents that are not held out."""
    labels = _table(spark, sf_dir, "labels").filter(F.coalesce(~held_out(), F.lit(False)))
    return quality_knn.fit(_table(spark, sf_dir, "documents"), labels.select("doc_id", "quality"))


def op1_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality_knn.classify(docs, fit_quality(spark, sf_dir))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")


def op2_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_cover.remove_repeats(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT r, unnest(range(1, len(w) - 33)) AS i, w FROM d WHERE len(w) >= 35),
win AS (SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM p),
twice AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS j FROM win WHERE h IN (SELECT h FROM twice)),
lists AS (SELECT r, list(j) AS js FROM gone GROUP BY r),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d),
kept AS (SELECT words.r, string_agg(word, ' ' ORDER BY words.j) AS t FROM words
         LEFT JOIN gone ON gone.r = words.r AND gone.j = words.j WHERE gone.j IS NULL GROUP BY words.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(js), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN lists ON lists.r = d.r LEFT JOIN kept ON kept.r = d.r
"""


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    added = F.explode(F.array(*[F.struct(F.lit(t).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(said).alias("text"))
                                for t, role in ((0, "user"), (1, "assistant"))]))
    turns = _table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    turns = turns.unionByName(spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), added.alias("t")).select("conv_id", "t.*"))
    out = chat.format_conversations(turns).withColumn("back", chat.read_back(F.col("formatted")))
    heard = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    lost = chat.loss_text(F.col("segments"))
    return out.select("conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(heard, 256).alias("turns_sha256"),
                      F.length(lost).cast("long").alias("loss_chars"), F.sha2(lost, 256).alias("loss_sha256"),
                      F.length("formatted").cast("long").alias("formatted_chars"))


# block marks: <|im_start|> 12, <|im_role|> 11, <|im_end|> 10; <|im_next|> 11 between turns of a block
OP3_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(text) + length(text) - length(replace(text, '\', ''))
             + len(regexp_extract_all(text, '<\||<s>|</s>|<SYS>|</SYS>|<bos>|<eos>|<pad>|<unk>|<start_of_turn>|<end_of_turn>|\[INST\]|\[/INST\]')) AS n,
             lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM t)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
       CAST(sum(n + CASE WHEN before IS DISTINCT FROM role THEN 33 + length(role) ELSE 11 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def op4_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.assign_shards(docs, limit=SHARD_BYTES)


OP4_SQL = f"""
WITH d AS (SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS bytes,
                  right(CAST(CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '~')), 1, 15)) AS BIGINT) AS BIT)::VARCHAR, 60) AS bits
           FROM documents),
x AS (SELECT *, unnest(range(0, 61)) AS depth FROM d),
s AS (SELECT depth, substr(bits, 1, depth) AS shard, sum(bytes) AS shard_bytes, count(*) AS shard_docs FROM x GROUP BY ALL),
fit AS (SELECT * FROM s WHERE shard_bytes <= {SHARD_BYTES} OR shard_docs = 1),
leaf AS (SELECT a.* FROM fit a LEFT JOIN fit b ON b.depth = a.depth - 1 AND b.shard = substr(a.shard, 1, a.depth - 1)
         WHERE b.depth IS NULL)
SELECT doc_id, bytes, leaf.shard, CAST(shard_bytes AS BIGINT) AS shard_bytes, CAST(shard_docs AS BIGINT) AS shard_docs
FROM d JOIN leaf ON substr(d.bits, 1, leaf.depth) = leaf.shard
"""


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, sf_dir, "documents"))


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64)
    return topk.top_k(vectors, vectors.filter(F.col("id") % 20 == 0), 20)


OP6_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS HUGEINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
             coalesce(list_sum(list_transform(range(1, least(len(q.v), len(c.v)) + 1), lambda i: q.v[i] * c.v[i])), 0) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, CAST(score AS BIGINT) AS score FROM r WHERE rank <= 20
"""


def op7_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "copies", "source")


def op8_rule_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.rule_verdicts(_table(spark, sf_dir, "documents"))


def op9_warc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write_archive(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return warc.read_archive(spark, path, "page_id long, payload_bytes long, payload_digest string, record_type string, "
                             "refers_to long", verify=True)


OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT html, max(page_id) AS first FROM p GROUP BY html)
SELECT page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes, sha1(p.html) AS payload_digest,
       CASE WHEN strlen(p.html) >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(p.html) >= 1000 AND page_id <> first THEN first END AS refers_to
FROM p JOIN g ON g.html = p.html
"""


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_harmonic_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op11_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a source is the owner, its documents of one language are a repository
    docs = ownership.find_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))
    base = F.filter("spans", lambda s: s["kind"] < 3)

    def count(test):
        return F.size(F.filter("spans", test)).cast("long")

    def of_kind(k):
        return count(lambda s: s["kind"] == k)

    return docs.select(
        "doc_id", *[of_kind(k).alias(f"n_{name}") for k, name in enumerate(ownership.KINDS[:3])],
        F.sha2(ownership.span_text(base), 256).alias("base_sha256"), ownership.span_text(F.col("spans")).alias("spans"),
        count(lambda s: s["live"]).alias("n_live"), count(lambda s: s["owners"] > 1).alias("n_copied"))


def _op11_sql() -> str:
    name = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word) for word in ("password", "passwd", "secret", "token", "api_?key"))
    patterns = [rf"""({name})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", "()(AKIA[A-Z0-9]+)", "()([0-9a-f]{24,})", "()([A-Za-z0-9+/_=-]{20,})"]
    found = " UNION ALL ".join(f"""
    SELECT r, {kind} AS kind, regexp_split_to_array(t, '{p}') AS gaps, regexp_extract_all(t, '{p}') AS hits, regexp_extract_all(t, '{p}', 2) AS vals
    FROM d WHERE regexp_matches(t, '{p}')""" for kind, p in enumerate(patterns))
    name_of = "CASE kind WHEN 0 THEN 'assign' WHEN 1 THEN 'access' WHEN 2 THEN 'hex' ELSE 'owned' END || ':' || a || ':' || b"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, lang, coalesce(text, '') AS t FROM documents),
m AS ({found}),
e AS (SELECT *, unnest(range(1, len(hits) + 1)) AS n FROM m),
p AS (SELECT r, kind, vals[n] AS val, length(hits[n]) AS chars, CAST(list_sum(list_transform(gaps[1:n], lambda x: length(x))) AS BIGINT)
             + CAST(coalesce(list_sum(list_transform(hits[1:n - 1], lambda x: length(x))), 0) AS BIGINT) AS a FROM e),
f AS (SELECT *, a + chars AS b FROM p WHERE length(val) >= CASE kind WHEN 0 THEN 6 WHEN 1 THEN 20 WHEN 2 THEN 24 ELSE 0 END),
owners AS (SELECT val, count(DISTINCT coalesce('+' || source, '-')) AS owners FROM f JOIN d ON d.r = f.r GROUP BY val),
live AS (SELECT f.*, owners, owners <= 1 AND NOT regexp_matches(f.val, '(?i)example|sample|dummy|placeholder|changeme|xxxx|your_|1234567|abcdef')
                AND len(regexp_extract_all(f.val, '[A-Za-z][0-9]|[0-9][A-Za-z]')) >= 4 AND len(list_distinct(string_split(f.val, ''))) >= 10 AS live
         FROM f JOIN owners ON owners.val = f.val),
kept AS (SELECT * FROM live x WHERE kind < 3 OR live AND NOT EXISTS (SELECT 1 FROM f y WHERE y.r = x.r AND y.kind < 3 AND y.a < x.b AND x.a < y.b)),
s AS (SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
             string_agg({name_of}, ',' ORDER BY a, kind) FILTER (kind < 3) AS base, string_agg({name_of}, ',' ORDER BY a, kind) AS spans,
             count(*) FILTER (live) AS n_live, count(*) FILTER (owners > 1) AS n_copied FROM kept GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM d LEFT JOIN s ON s.r = d.r
"""


OP11_SQL = _op11_sql()


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turn_repair.damaged(_table(spark, sf_dir, "conversations"))
    edits = turn_repair.repair_turns(rows, absent=F.col("absent"))
    return turn_repair.conversation_digests(edits).withColumnRenamed("conv", "conv_id")


def _op12_sql() -> str:
    """The same edits as a recursive table over the rows' positions: per conversation and state
    (0 nothing, 1 system, 2 user, 3 assistant) the least (cost, letters, text) so far."""
    def step(state: str, cost: str, letter: str, line: str | None = None) -> str:
        said = f" || chr(10) || {line}" if line else ""
        return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {state}.t{said}}}"

    def least(*options: str) -> str:
        return f"list_min([{', '.join(options)}])"

    def when(test: str, option: str) -> str:
        return f"CASE WHEN {test} THEN {option} END"

    own, before_u = "o.role || ':' || o.text", ("s0", "s1", "s3")
    n0 = step("s0", "3", "D")
    n1 = least(step("s1", "3", "D"), when("NOT o.must AND o.was = 's'", step("s0", "o.cut", "K", own)))
    n2 = least(step("s2", "3", "D"), *[when("NOT o.must AND o.was = 'u'", step(s, "o.cut", "K", own)) for s in before_u],
               *[when("NOT o.must", step(s, "2 + o.cut", "R", "'user:' || o.text")) for s in before_u])
    n3 = least(step("s3", "3", "D"), when("NOT o.must AND o.was = 'a'", step("s2", "o.cut", "K", own)),
               when("NOT o.must", step("s2", "2 + o.cut", "R", "'assistant:' || o.text")))
    m2 = least("s2", *[step(s, "2", "I", "'user:'") for s in before_u])
    m3 = least("s3", step("s2", "2", "I", "'assistant:'"))
    byte = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)"
    none = "{'c': 1000000, 'a': '', 't': ''}"
    return rf"""
WITH RECURSIVE base AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
act AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(key, ''), lambda x: CAST(ascii(x) AS BIGINT))),
                        lambda c, b: {byte}), 4294967295) % 20 AS act FROM base),
hurt AS (SELECT conv_id, turn, CASE WHEN act = 4 THEN 'user' ELSE role END AS role,
                CASE act WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                unnest(range(CASE WHEN act = 3 THEN 2 ELSE 1 END)) AS copy FROM act WHERE act <> 0),
sorted AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
                  regexp_extract(text, '([^ 	-
])[ 	-
]*$', 1) AS last FROM hurt),
nth AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth,
               left(role, 1) AS was, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS prior FROM sorted),
o AS (SELECT *, CASE WHEN last = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
             fault IN ('blank', 'duplicate') AS must, CAST(fault = 'truncated' AS INTEGER) AS cut FROM nth),
walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, {{'c': 0, 'a': '', 't': ''}} AS s0, {none} AS s1,
         {{'c': 2, 'a': 'I', 't': chr(10) || 'user:'}} AS s2, {{'c': 4, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}} AS s3
  FROM (SELECT DISTINCT conv_id FROM o)
  UNION ALL
  SELECT conv_id, i, s0, s1, s2, {m3} AS s3 FROM (
    SELECT conv_id, i, s0, s1, {m2} AS s2, s3 FROM (
      SELECT w.conv_id, o.i, {n0} AS s0, {n1} AS s1, {n2} AS s2, {n3} AS s3
      FROM walk w JOIN o ON o.conv_id IS NOT DISTINCT FROM w.conv_id AND o.i = w.i + 1))),
done AS (SELECT conv_id, {least("s0", "s3")} AS r FROM walk
         WHERE i = (SELECT max(i) FROM o WHERE o.conv_id IS NOT DISTINCT FROM walk.conv_id)),
stats AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
                 count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                 count(*) FILTER (prior IS NOT NULL AND prior || was NOT IN ('su', 'ua', 'au')) AS illegal FROM o GROUP BY conv_id)
SELECT ids.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(r.c, 0) AS BIGINT) AS cost,
       coalesce(r.a, '') AS audit, sha256(coalesce(substr(r.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids
LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN stats ON stats.conv_id IS NOT DISTINCT FROM ids.conv_id
"""


OP12_SQL = _op12_sql()


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic.with_periodic_tails(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic.find_runs(docs)
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("short"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.withColumn("top", top).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("top.back")).alias("start"), F.col("top.length").alias("length"),
        (-F.col("top.short")).alias("period"), F.expr("(1000 * top.length) div (-top.short)").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_quality_votes, op2_repeated_passages, op3_chat_format, op4_extendible_shards, op5_simhash, op6_topk_search,
    op7_weighted_mix, op8_rule_outliers, op9_warc_pages, op10_harmonic_pack, op11_secret_ownership, op12_turn_repair, op13_periodic_runs)}
ORACLE: dict[str, str] = {"op2_repeated_passages": OP2_SQL, "op3_chat_format": OP3_SQL, "op4_extendible_shards": OP4_SQL,
                          "op6_topk_search": OP6_SQL, "op9_warc_pages": OP9_SQL, "op11_secret_ownership": OP11_SQL,
                          "op12_turn_repair": OP12_SQL}
