"""Fixture views over the driver's tables, as SQL text runnable by Spark and DuckDB.

Each view maps the driver's generic tables onto the shapes the feedback jobs consume
(wide question table, annotations by two annotators, grading replies, prompts, ...).
Most texts run unchanged in both engines; where dialects differ a view carries one text
per engine. Spark registers them as temp views over the parquet scans, so Catalyst still
prunes columns and pushes filters into the scans through the view definitions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


@dataclass(frozen=True)
class View:
    deps: tuple[str, ...]
    spark: str
    duck: str | None = None  # None: same text as Spark

    def text(self, engine: str) -> str:
        return self.spark if engine == "spark" or self.duck is None else self.duck


_V_MCQ = """
WITH l AS (SELECT l_orderkey, (l_linenumber - 1) % 4 + 1 AS slot, min(l_partkey) AS pk FROM lineitem
           GROUP BY l_orderkey, (l_linenumber - 1) % 4 + 1)
SELECT o_orderkey AS id, concat('Which part fits order ', o_orderkey, '?') AS question, o_custkey % 50 AS construct_id,
  CASE WHEN o_orderkey % 97 = 0 THEN 'x' ELSE CAST(o_orderkey % 4 + 1 AS STRING) END AS correct_no,
  max(CASE WHEN slot = 1 THEN p_name END) AS answer1, max(CASE WHEN slot = 2 THEN p_name END) AS answer2,
  max(CASE WHEN slot = 3 THEN p_name END) AS answer3, max(CASE WHEN slot = 4 THEN p_name END) AS answer4,
  max(CASE WHEN slot = 1 THEN p_type END) AS explanation1, max(CASE WHEN slot = 2 THEN p_type END) AS explanation2,
  max(CASE WHEN slot = 3 THEN p_type END) AS explanation3, max(CASE WHEN slot = 4 THEN p_type END) AS explanation4,
  substr(md5(concat('sc:', o_orderkey)), 1, 1) < '8' AS script_clean, substr(md5(concat('cl:', o_orderkey)), 1, 1) < 'c' AS cleaned,
  substr(md5(concat('df:', o_orderkey)), 1, 1) < '4' AS discuss_flag, substr(md5(concat('im:', o_orderkey)), 1, 1) < '2' AS image_needed
FROM orders LEFT JOIN l ON o_orderkey = l_orderkey LEFT JOIN part ON pk = p_partkey GROUP BY o_orderkey, o_custkey
"""

_V_ANNOTATED_A = """
SELECT d.doc_id AS row_id, CAST(floor(d.doc_id / 12) AS BIGINT) AS qid,
  concat('Question ', CAST(floor(d.doc_id / 12) AS BIGINT)) AS question, concat('c', CAST(floor(d.doc_id / 12) AS BIGINT)) AS correct_answer,
  source AS explanation, concat('d', CAST(floor(d.doc_id / 4) AS BIGINT) % 3) AS distractor, text AS feedback,
  CASE d.doc_id % 4 WHEN 0 THEN 'gold' WHEN 1 THEN 'random' WHEN 2 THEN 'knn' ELSE 'zs' END AS method,
  CAST(1 - coalesce(quality, CASE WHEN substr(md5(concat('q:', d.doc_id)), 1, 1) < 'c' THEN 1 ELSE 0 END) AS DOUBLE) AS incorrect,
  CAST(coalesce(toxic, CASE WHEN substr(md5(concat('t:', d.doc_id)), 1, 1) < '2' THEN 1 ELSE 0 END) AS DOUBLE) AS reveal,
  CAST(CASE WHEN substr(md5(concat('su:', d.doc_id)), 1, 1) < 'a' THEN 1 ELSE 0 END AS DOUBLE) AS suggestions,
  CAST(CASE WHEN substr(md5(concat('mi:', d.doc_id)), 1, 1) < '7' THEN 1 ELSE 0 END AS DOUBLE) AS misconceptions,
  CAST(CASE WHEN substr(md5(concat('po:', d.doc_id)), 1, 1) < 'd' THEN 1 ELSE 0 END AS DOUBLE) AS positive
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
"""

_V_ANNOTATED_B = """
SELECT row_id, qid, question, correct_answer, explanation, distractor, feedback, method,
  CASE WHEN substr(md5(concat('n:', row_id)), 1, 2) < '10' THEN NULL WHEN substr(md5(concat('bin:', row_id)), 1, 1) < '2' THEN 1 - incorrect ELSE incorrect END AS incorrect,
  CASE WHEN substr(md5(concat('n:', row_id)), 1, 2) < '10' THEN NULL WHEN substr(md5(concat('bre:', row_id)), 1, 1) < '2' THEN 1 - reveal ELSE reveal END AS reveal,
  CASE WHEN substr(md5(concat('n:', row_id)), 1, 2) < '10' THEN NULL WHEN substr(md5(concat('bsu:', row_id)), 1, 1) < '2' THEN 1 - suggestions ELSE suggestions END AS suggestions,
  CASE WHEN substr(md5(concat('n:', row_id)), 1, 2) < '10' THEN NULL WHEN substr(md5(concat('bmi:', row_id)), 1, 1) < '2' THEN 1 - misconceptions ELSE misconceptions END AS misconceptions,
  CASE WHEN substr(md5(concat('n:', row_id)), 1, 2) < '10' THEN NULL WHEN substr(md5(concat('bpo:', row_id)), 1, 1) < '2' THEN 1 - positive ELSE positive END AS positive
FROM v_annotated_a
"""

_V_REPLY = """
SELECT row_id, concat('1. ', CASE WHEN incorrect = 1 THEN 'Yes' ELSE 'No' END, chr(10), '2. Because of it.', chr(10), 'Answer: ',
  CASE WHEN reveal = 1 THEN 'Yes.' ELSE 'No.' END, chr(10), '3. ', CASE WHEN suggestions = 1 THEN 'Yes' ELSE 'No' END, chr(10),
  CASE WHEN row_id % 11 = 0 THEN 'no grade' ELSE concat('4. ', CASE WHEN misconceptions = 1 THEN 'Yes' ELSE 'No' END) END, chr(10),
  '5. ', CASE WHEN positive = 1 THEN 'Yes' ELSE 'No' END) AS response FROM v_annotated_a
"""

_V_PROMPT = """
SELECT conv_id * 100 + turn AS row_id, text AS prompt, substr(md5(text), 1, 1) < '8' AS is_cached FROM conversations WHERE role = 'user'
"""

_V_REWARD = """
SELECT event_id AS row_id, event_id % 5 AS epoch, value AS reward FROM events
"""

# Source rows in the "expanded" shape: question, wrong answer and a feedback text, of every document.
_V_EXPANDED = """
SELECT row_id, qid, question, correct_answer, explanation, distractor, feedback
FROM v_annotated_a
"""

# Generated feedback of the three prompting methods, keyed to the source row they answer.
_V_GENERATED = """
SELECT g.row_id, o.row_id AS src_row_id, g.qid, g.question, g.correct_answer, g.explanation, g.distractor,
  o.feedback AS feedback, g.feedback AS generated_feedback, g.method,
  concat('Question: ', g.question, chr(10), 'Feedback:') AS prompt
FROM v_annotated_a g JOIN v_annotated_a o
  ON o.qid = g.qid AND o.distractor = g.distractor AND o.method = 'gold'
WHERE g.method <> 'gold'
"""

# Likert grading replies: one line per category; some rows miss the fourth score, some carry two
# scores on one line, out-of-range scores and a sixth score.
_V_REPLY_LIKERT = """
SELECT row_id, concat(
  'Accuracy: reads fine. Score: ', CAST(CAST(2 - incorrect AS INTEGER) AS STRING), chr(10),
  'Revealing: Score: ', CAST(CAST(2 - reveal AS INTEGER) AS STRING), chr(10),
  'Suggestions: ', CASE WHEN row_id % 17 = 0 THEN 'Score: 9' ELSE concat('Score: ', CAST(CAST(1 + 2 * suggestions AS INTEGER) AS STRING)) END, chr(10),
  CASE WHEN row_id % 7 = 0 THEN 'Misconception: unclear' WHEN row_id % 5 = 0 THEN 'Misconception: Score: 2'
       ELSE concat('Misconception: Score: ', CAST(CAST(1 + 2 * misconceptions AS INTEGER) AS STRING)) END, chr(10),
  'Positive: Score: ', CAST(CAST(1 + 2 * positive AS INTEGER) AS STRING),
  CASE WHEN row_id % 13 = 0 THEN ' then Score: 1' ELSE '' END,
  CASE WHEN row_id % 19 = 0 THEN concat(chr(10), 'Extra: Score: 2') ELSE '' END) AS response
FROM v_annotated_a
"""

_LOGIT_METHOD = "CASE label % 4 WHEN 0 THEN 'gold' WHEN 1 THEN 'random' WHEN 2 THEN 'knn' ELSE 'zs' END"
_TRUTH_BITS = ", ".join(
    f"CASE WHEN substr(md5(concat('t{i}:', vec_id)), 1, 1) < '8' THEN 1.0D ELSE 0.0D END" for i in range(5)
)

# Two reward models' logits: elements 1-5 and 6-10 of each embedding, times 10.
_V_LOGITS_SPARK = f"""
SELECT 'm1' AS model, vec_id AS row_id, transform(slice(embedding, 1, 5), x -> CAST(x AS DOUBLE) * 10) AS logits,
  array({_TRUTH_BITS}) AS truth, {_LOGIT_METHOD} AS method FROM embeddings
UNION ALL
SELECT 'm2' AS model, vec_id AS row_id, transform(slice(embedding, 6, 5), x -> CAST(x AS DOUBLE) * 10) AS logits,
  array({_TRUTH_BITS}) AS truth, {_LOGIT_METHOD} AS method FROM embeddings
"""
_V_LOGITS_DUCK = f"""
SELECT 'm1' AS model, vec_id AS row_id, list_transform(embedding[1:5], lambda x: CAST(x AS DOUBLE) * 10) AS logits,
  list_value({_TRUTH_BITS.replace('1.0D', 'CAST(1.0 AS DOUBLE)').replace('0.0D', 'CAST(0.0 AS DOUBLE)')}) AS truth,
  {_LOGIT_METHOD} AS method FROM embeddings
UNION ALL
SELECT 'm2' AS model, vec_id AS row_id, list_transform(embedding[6:10], lambda x: CAST(x AS DOUBLE) * 10) AS logits,
  list_value({_TRUTH_BITS.replace('1.0D', 'CAST(1.0 AS DOUBLE)').replace('0.0D', 'CAST(0.0 AS DOUBLE)')}) AS truth,
  {_LOGIT_METHOD} AS method FROM embeddings
"""

# Token vectors of text pairs: the rows of one embeddings.label form one text; pair p compares
# the text of label p (prediction) with the text of the next label (reference).
_V_TOKEN_VECTORS = """
SELECT CAST(label AS BIGINT) AS pair_id, 'pred' AS side, vec_id AS pos, embedding AS vec FROM embeddings
UNION ALL
SELECT CAST((label + (SELECT max(label) FROM embeddings)) % ((SELECT max(label) FROM embeddings) + 1) AS BIGINT) AS pair_id,
  'ref' AS side, vec_id AS pos, embedding AS vec FROM embeddings
"""

VIEWS: dict[str, View] = {
    "v_mcq": View((), _V_MCQ),
    "v_annotated_a": View((), _V_ANNOTATED_A),
    "v_annotated_b": View(("v_annotated_a",), _V_ANNOTATED_B),
    "v_reply": View(("v_annotated_a",), _V_REPLY),
    "v_prompt": View((), _V_PROMPT),
    "v_reward": View((), _V_REWARD),
    "v_expanded": View(("v_annotated_a",), _V_EXPANDED),
    "v_generated": View(("v_annotated_a",), _V_GENERATED),
    "v_reply_likert": View(("v_annotated_a",), _V_REPLY_LIKERT),
    "v_logits": View((), _V_LOGITS_SPARK, _V_LOGITS_DUCK),
    "v_token_vectors": View((), _V_TOKEN_VECTORS),
}


def _closure(names) -> list[str]:
    out: list[str] = []

    def visit(n):
        for d in VIEWS[n].deps:
            visit(d)
        if n not in out:
            out.append(n)

    for n in names:
        visit(n)
    return out


_REGISTERED: dict[tuple[int, str], str] = {}  # (session id, temp view) -> data folder it was registered for


def _base_tables_of(names) -> list[str]:
    import re

    used = set()
    for n in names:
        words = set(re.findall(r"[a-z_]+", VIEWS[n].text("spark").lower()))
        used |= words & set(BASE_TABLES)
    return sorted(used)


def _register(spark: SparkSession, name: str, sf_dir: str, make) -> None:
    key = (id(spark), name)
    if _REGISTERED.get(key) == sf_dir and spark.catalog.tableExists(name):
        return
    make().createOrReplaceTempView(name)
    _REGISTERED[key] = sf_dir


def register_tables(spark: SparkSession, sf_dir: str, names=BASE_TABLES) -> None:
    """Temp views over the driver's parquet tables (registered once per session and folder)."""
    for t in names:
        _register(spark, t, sf_dir, lambda t=t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Register the tables of ``sf_dir`` that ``name`` reads, plus ``name`` and its dependencies; return it."""
    closure = _closure([name])
    register_tables(spark, sf_dir, _base_tables_of(closure))
    for n in closure:
        _register(spark, n, sf_dir, lambda n=n: spark.sql(VIEWS[n].text("spark")))
    return spark.table(name)


def packed_annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``v_annotated_a`` with its feedback as ``pack`` makes it, packed where the documents are read:
    the join with the labels moves packed texts."""
    from feedlens.functions.pack import pack

    register_tables(spark, sf_dir, _base_tables_of(["v_annotated_a"]))
    spark.table("documents").withColumn("text", pack("text")).createOrReplaceTempView("documents_packed")
    return spark.sql(VIEWS["v_annotated_a"].text("spark").replace("FROM documents d", "FROM documents_packed d"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def duck_with(names, body: str) -> str:
    """Prefix ``body`` with CTEs for the named views (DuckDB dialect)."""
    names = _closure(names)
    if not names:
        return body
    stripped = body.lstrip()
    if stripped[:5].upper() == "WITH ":
        body = ",\n" + stripped[5:]
    else:
        body = "\n" + body
    ctes = ",\n".join(f"{n} AS ({VIEWS[n].text('duck').strip()})" for n in names)
    return f"WITH {ctes}{body}"
