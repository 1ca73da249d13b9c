"""Queries: file hand-off, run columns, response cache, generation, normalisation, system comparison."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedlens.catalog.build_q import SQL_EXPANDED_SPLITS, SQL_CA, SQL_EL, SQL_OK, _sql_expand, expanded_splits
from feedlens.catalog.registry import DIGITS, query, r6, sr6
from feedlens.functions import prompts as pr
from feedlens.functions.parse import parse_binary, sql_parse_binary_ctes
from feedlens.operators import agreement as ag
from feedlens.operators import mcq
from feedlens.plans import evaluate as ev
from feedlens.rubric import BINARY_LABELS as LAB, FLIPPED_LABELS as FL
from feedlens.session import shared_dir
from feedlens.sources import cache as cc
from feedlens.sources import files as fl
from feedlens.sources.arrow_files import read_arrow, write_arrow
from feedlens.sources.views import view
from feedlens.streaming import generation as gen

ANN_SCHEMA = T.StructType([
    T.StructField("row_id", T.LongType()), T.StructField("qid", T.LongType()),
    T.StructField("question", T.StringType()), T.StructField("correct_answer", T.StringType()),
    T.StructField("explanation", T.StringType()), T.StructField("distractor", T.StringType()),
    T.StructField("feedback", T.StringType()), T.StructField("method", T.StringType()),
    *[T.StructField(l, T.DoubleType()) for l in LAB],
])


# ---- file hand-off ------------------------------------------------------------------------------

@query("scan_csv_roundtrip", ("v_annotated_a",), "SELECT * FROM v_annotated_a")
def scan_csv_roundtrip(spark, sf):
    """Annotated table written as CSV (quoted multi-line cells) and scanned back with its schema."""
    path = shared_dir(spark, "csv") + "/annotated"
    fl.write_csv(view(spark, sf, "v_annotated_a"), path)
    return fl.read_csv(spark, path, ANN_SCHEMA, na_columns=LAB)


@query("sink_roundtrip", ("v_mcq",), SQL_EXPANDED_SPLITS + " SELECT * FROM ex")
def sink_roundtrip(spark, sf):
    """Expanded splits written as Parquet partitioned by split, read back whole."""
    path = shared_dir(spark, "splits") + "/expanded"
    fl.write_table(expanded_splits(spark, sf), path, partition_by=["split"])
    return fl.read_table(spark, path)


@query("split_filter", ("v_mcq",), SQL_EXPANDED_SPLITS + " SELECT * FROM ex WHERE split = 'val'")
def split_filter(spark, sf):
    """One split selected from the partitioned table (partition pruning at the scan)."""
    path = shared_dir(spark, "splits") + "/expanded"
    fl.write_table(expanded_splits(spark, sf), path, partition_by=["split"])
    return fl.select_partition(fl.read_table(spark, path), split="val")


@query("export_arrow", ("v_mcq",), f"WITH {SQL_EL}, {SQL_CA}, {SQL_OK} {_sql_expand('ok')}")
def export_arrow(spark, sf):
    """Expanded rows handed off as Arrow IPC files under a committed manifest, read back."""
    path = shared_dir(spark, "arrow") + "/expanded"
    rows = mcq.expand(mcq.eligible(view(spark, sf, "v_mcq")))
    write_arrow(rows, path)
    return read_arrow(spark, path, rows.schema)


@query("run_columns", ("v_generated",), "SELECT row_id, method, 'code-davinci-002' AS model, 2 AS k, false AS sol, "
       "true AS rubric FROM v_generated")
def run_columns(spark, sf):
    g = view(spark, sf, "v_generated").select("row_id", "method")
    return fl.with_run_columns(g, model="code-davinci-002", k=2, sol=False, rubric=True)


# ---- response cache -------------------------------------------------------------------------------

MODEL, MAX_TOKENS = "gpt-4", 300
_SEED_SQL = ("seed AS (SELECT DISTINCT prompt, 'cached:' || substr(md5(prompt), 1, 8) AS response FROM v_prompt "
             "WHERE is_cached)")


def _seeded_cache(spark, sf, system_message=None):
    """A cache root holding one version: the prompts marked as cached."""
    root = shared_dir(spark, "cache")
    p = view(spark, sf, "v_prompt").filter("is_cached").select("prompt").distinct()
    seed = cc.with_key(p, MODEL, MAX_TOKENS, system_message).withColumn(
        "response", F.concat(F.lit("cached:"), F.substring(F.md5("prompt"), 1, 8)))
    cc.save_cache(spark, seed, root)
    return root


@query("cache_lookup", ("v_prompt",), f"WITH {_SEED_SQL} SELECT p.row_id, p.prompt, s.response, s.response IS NULL AS "
       "to_send FROM v_prompt p LEFT JOIN seed s ON s.prompt = p.prompt")
def cache_lookup(spark, sf):
    root = _seeded_cache(spark, sf)
    prompts = cc.with_key(view(spark, sf, "v_prompt").select("row_id", "prompt"), MODEL, MAX_TOKENS, None)
    out = cc.answers(spark, root, prompts)
    return out.select("row_id", "prompt", "response", F.col("response").isNull().alias("to_send"))


@query("cache_merge", ("v_prompt",), f"""WITH {_SEED_SQL},
own AS (SELECT DISTINCT prompt, 'new:' || substr(md5(prompt), 1, 8) AS response FROM v_prompt WHERE substr(md5(prompt), 2, 1) < '8')
SELECT prompt, response FROM own UNION ALL SELECT prompt, response FROM seed WHERE prompt NOT IN (SELECT prompt FROM own)""")
def cache_merge(spark, sf):
    root = _seeded_cache(spark, sf)
    p = view(spark, sf, "v_prompt").filter(F.substring(F.md5("prompt"), 2, 1) < "8").select("prompt").distinct()
    own = cc.with_key(p, MODEL, MAX_TOKENS, None).withColumn(
        "response", F.concat(F.lit("new:"), F.substring(F.md5("prompt"), 1, 8)))
    cc.save_cache(spark, own, root)
    cc.compact(spark, root)
    return cc.load_cache(spark, root).select("prompt", "response")


@query("generate_cached", ("v_prompt",), f"""WITH {_SEED_SQL}
SELECT p.row_id, p.prompt, coalesce(s.response, 'Check the step again (' || substr(md5(p.prompt), 1, 8) || ').') AS response
FROM v_prompt p LEFT JOIN seed s ON s.prompt = p.prompt""")
def generate_cached(spark, sf):
    """Prompts answered from the cache; the rest sent once each to the (stub) client."""
    root = _seeded_cache(spark, sf)
    prompts = view(spark, sf, "v_prompt").select("row_id", "prompt")
    out = gen.generate(spark, prompts, gen.stub_writer, root, model=MODEL, max_tokens=MAX_TOKENS)
    return out.select("row_id", "prompt", "response")


def _sql_stub_grade(p: str) -> str:
    h = f"md5({p})"
    lines = [f"'{i + 1}. ' || CASE WHEN ('0x' || substr({h}, {i + 1}, 1))::INTEGER < 8 THEN 'Yes' ELSE 'No' END"
             for i in range(5)]
    lines[3] = f"CASE WHEN substr({h}, 6, 1) = '0' THEN 'I am not sure.' ELSE {lines[3]} END"
    return " || chr(10) || ".join(f"({l})" for l in lines)


@query("annotate", ("v_annotated_a",), "WITH rep AS (SELECT row_id, " + _sql_stub_grade(pr.sql_annotation_prompt(False))
       + " AS response FROM v_annotated_a),\n" + sql_parse_binary_ctes("rep").strip()
       + "\nSELECT rid AS row_id, " + ", ".join(f"l{i} AS {n}" for i, n in enumerate(LAB)) + " FROM parsed")
def annotate(spark, sf):
    """Grade every row with the (stub) grader and parse the replies into the five labels."""
    a = view(spark, sf, "v_annotated_a").select("row_id", pr.annotation_prompt(False).alias("prompt"))
    root = shared_dir(spark, "cache")
    out = gen.generate(spark, a, gen.stub_grader, root, model=MODEL, max_tokens=MAX_TOKENS,
                       system_message=pr.EXPERT_SYSTEM)
    p = out.select("row_id", parse_binary("response").alias("p"))
    return p.select("row_id", *[F.col("p.labels")[i].alias(l) for i, l in enumerate(LAB)])


# The stand-in encoder in SQL: md5-hashed lower-case words counted in 64 slots, over the vector length.
@query("encode_stub", ("v_expanded",), f"""WITH t AS (SELECT row_id, {pr.sql_prompt_input(False)} AS txt FROM v_expanded),
w AS (SELECT row_id, unnest(regexp_extract_all(lower(txt), '[a-z0-9]+')) AS w FROM t),
c AS (SELECT row_id, CAST(('0x' || substr(md5(w), 1, 8)) AS BIGINT) % 64 AS slot, CAST(count(*) AS DOUBLE) AS n
      FROM w GROUP BY row_id, slot),
m AS (SELECT row_id, map(list(slot), list(n)) AS mp, sqrt(sum(n * n)) AS len FROM c GROUP BY row_id)
SELECT t.row_id, CASE WHEN m.row_id IS NULL THEN list_transform(range(64), lambda i: CAST(0.0 AS DOUBLE))
  ELSE list_transform(range(64), lambda i: round(coalesce(m.mp[i], 0.0) / m.len, {DIGITS})) END AS vec
FROM t LEFT JOIN m ON t.row_id = m.row_id""")
def encode_stub(spark, sf):
    """Unit vectors of prompt inputs from the plugged-in encoder (stub: hashed bag of words);
    components reported to ``DIGITS`` places like every other double."""
    from feedlens.functions.encode import encoder_udf, hashed_bow
    e = view(spark, sf, "v_expanded")
    vec = encoder_udf(hashed_bow, 64)(pr.prompt_input(False))
    return e.select("row_id", F.transform(vec, lambda x: F.round(x, DIGITS)).alias("vec"))


# ---- evaluation inputs ------------------------------------------------------------------------------

@query("normalise_results", ("v_expanded", "v_generated"), """
SELECT 'og' AS source, row_id, feedback, CAST(NULL AS VARCHAR) AS gen_prompt FROM v_expanded
UNION ALL SELECT 'icl', row_id, generated_feedback, NULL FROM v_generated
UNION ALL SELECT 'ft', row_id, generated_feedback, prompt FROM v_generated
UNION ALL SELECT 'retrieved', e.row_id, g.generated_feedback, g.prompt FROM v_expanded e JOIN v_generated g
  ON g.src_row_id = e.row_id AND g.method = 'knn'""")
def normalise_results(spark, sf):
    og = view(spark, sf, "v_expanded")
    g = view(spark, sf, "v_generated")
    cols = ["source", "row_id", "feedback", "gen_prompt"]
    a = ev.normalise(og, "og").withColumn("source", F.lit("og")).select(*cols)
    b = ev.normalise(g, "icl").withColumn("source", F.lit("icl")).select(*cols)
    c = ev.normalise(g.withColumnRenamed("generated_feedback", "prediction"), "ft").withColumn(
        "source", F.lit("ft")).select(*cols)
    res = g.filter(F.col("method") == "knn").select(F.col("src_row_id").alias("row_id"),
                                                    F.col("generated_feedback").alias("pred"), "prompt")
    answered = og.join(res.select("row_id"), "row_id", "left_semi")  # an item may lack the method's answer
    d = ev.normalise(res, "retrieved", original=answered).withColumn("source", F.lit("retrieved")).select(*cols)
    return a.unionByName(b).unionByName(c).unionByName(d)


@query("zip_join", ("v_annotated_b",), "SELECT a.row_id, a.incorrect AS incorrect_a, b.incorrect AS incorrect_b "
       "FROM v_annotated_a a JOIN v_annotated_b b ON a.row_id = b.row_id")
def zip_join(spark, sf):
    a = view(spark, sf, "v_annotated_a").select("row_id", F.col("incorrect").alias("incorrect_a"))
    b = view(spark, sf, "v_annotated_b").select(F.col("row_id").alias("_b"), F.col("incorrect").alias("incorrect_b"))
    return ev.zip_join(a, b, "row_id", "_b").drop("_b")


SYSTEMS_A = {"gold": "human", "zs": "zs", "random": "sft", "knn": "dpo"}
SYSTEMS_B = {"knn": "dpo_abl", "zs": "gpt4"}
SYSTEMS = ["human", "zs", "sft", "dpo", "dpo_abl", "gpt4"]
_SCORE = "(1 - incorrect) * ((1 - incorrect) + (1 - reveal) + suggestions + misconceptions + positive) / 5.0"


def _sys_case(m: dict) -> str:
    return "CASE method " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in m.items()) + " END"


@query("system_compare", ("v_annotated_b",), f"""WITH s AS (
  SELECT qid, distractor, {_sys_case(SYSTEMS_A)} AS system, {_SCORE} AS score FROM v_annotated_a
  UNION ALL SELECT qid, distractor, {_sys_case(SYSTEMS_B)}, {_SCORE} FROM v_annotated_b WHERE method IN ('knn', 'zs')),
w AS (SELECT qid, distractor, """ + ", ".join(f"max(CASE WHEN system = '{s}' THEN score END) AS {s}" for s in SYSTEMS)
       + """ FROM s GROUP BY qid, distractor)
SELECT qid, distractor, """ + ", ".join(f"{sr6(s)} AS {s}" for s in SYSTEMS)
       + " FROM w WHERE zs < dpo AND sft < dpo AND dpo_abl <= dpo")
def system_compare(spark, sf):
    def scored(df, mapping):
        m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
        f = ag.flip_labels(df)
        return f.filter(F.col("method").isin(*mapping)).select(
            "qid", "distractor", m[F.col("method")].alias("system"), ag.gated_score(FL).alias("score"))
    s = scored(view(spark, sf, "v_annotated_a"), SYSTEMS_A).unionByName(
        scored(view(spark, sf, "v_annotated_b"), SYSTEMS_B))
    w = ev.desirable(ev.system_scores(s, systems=SYSTEMS))
    return w.select("qid", "distractor", *[r6(c).alias(c) for c in SYSTEMS])
