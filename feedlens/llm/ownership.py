"""Secrets in texts, told apart by how many owners hold them.

Base spans are the leftmost non-overlapping matches of three patterns (``assign``: a credential
name, ``:`` or ``=`` and a value; ``access``: an access key id; ``hex``: a long hexadecimal run)
that are long enough. They always stay. A fourth pattern, any long run of letters, digits and
``+/_=-``, gives candidates only.

Method. The hash of every value, base or candidate, is counted over the corpus by distinct
(owner, repository) pairs, then by distinct owners. A value that more than ``max_owners`` owners
hold is widely copied: a documentation example, a license line, a copied file. A value of few
owners that looks live (letters and digits that alternate, many different characters, no
placeholder word) is owner-specific. Owner-specific candidates outside the base spans become
``owned`` spans; for base spans the verdict is reported beside them.

Layout. DataFrame expressions only. Each text is read once; what goes on is one slim row per
document, with its matches as pieces of a split, so that positions are a running sum. It is
written to the shared folder. Counting shuffles distinct (hash, owner, repository) rows, which
every map task makes first, so a value that stands in a third of all documents travels once per
task and owner. Verdicts return by a join on the hash; hashes with at least a 1,024th of all
matches, 1,024 of them at most, are broadcast, so no hot hash is a join key.

Defined cases: null and empty texts have no span; spans of one start are ordered by kind. A null
owner or repository is an owner or repository of its own. Repeated rows are rows of their own,
and one owner's repeats count once. An empty table stays empty. All columns but those named are
ignored. A span covers the whole match, name and quotes included; the value is its group 2.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlens.operators.hot import join_counted
from feedlens.sources.files import materialize

# fixed values: the three base patterns, their kinds in order and their least lengths
KINDS = ("assign", "access", "hex", "owned")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"()(AKIA[A-Z0-9]+)"
HEX = r"()([0-9a-f]{24,})"
LEAST = (6, 20, 24)

CANDIDATE = r"()([A-Za-z0-9+/_=-]{20,})"
PLACEHOLDER = r"(?i)example|sample|dummy|placeholder|changeme|xxxx|your_|1234567|abcdef"
ALTERNATES = r"[A-Za-z][0-9]|[0-9][A-Za-z]"


def looks_live(value: Column, least_chars: int = 10, least_changes: int = 4) -> Column:
    """Whether a value looks like a drawn credential and not like a word, path or placeholder."""
    changes = F.size(F.split(value, ALTERNATES, -1)) - 1
    kinds = F.size(F.array_distinct(F.split(value, "")))
    return ~value.rlike(PLACEHOLDER) & (changes >= least_changes) & (kinds >= least_chars)


def _pieces(text: Column, pattern: str, kind: int) -> Column:
    """(kind, n, gap before the match, its length, its value) per match of ``pattern``."""
    found = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"),
                         F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("value"))
    made = F.transform(found, lambda f, n: F.struct(
        F.lit(kind).alias("kind"), n.alias("n"), F.length(f["gap"]).alias("gap"), F.length(f["hit"]).alias("chars"), f["value"].alias("value")))
    none = F.array().cast("array<struct<kind:int,n:int,gap:int,chars:int,value:string>>")
    return F.when(text.rlike(pattern), made).otherwise(none)


def matches(docs: DataFrame, text: str, owner: Column, repository: Column) -> tuple[DataFrame, DataFrame]:
    """(documents as written: row, doc, owner, repository, pieces; one row per kept match)."""
    body = F.coalesce(F.col(text), F.lit(""))
    pieces = F.concat(*[_pieces(F.col("body"), p, k) for k, p in enumerate((ASSIGN, ACCESS, HEX, CANDIDATE))])
    slim = docs.select("doc", owner.alias("owner"), repository.alias("repository"), body.alias("body"))
    slim = materialize(slim.select(F.monotonically_increasing_id().alias("row"), "doc", "owner", "repository", pieces.alias("pieces")), "secrets")
    each = slim.filter(F.size("pieces") > 0).select("row", "owner", "repository", F.explode("pieces").alias("p")).select("row", "owner", "repository", "p.*")
    before = Window.partitionBy("row", "kind").orderBy("n")
    end = F.sum(F.col("gap") + F.coalesce("chars", F.lit(0)).cast("long")).over(before)
    each = each.withColumn("end", end).filter("chars IS NOT NULL").withColumn("start", F.col("end") - F.col("chars"))
    least = F.element_at(F.array(*[F.lit(n) for n in (*LEAST, 0)]), F.col("kind") + 1)
    return slim, each.filter(F.length("value") >= least).withColumn("hash", F.sha2("value", 256)).drop("n", "gap", "chars")


def ownership(found: DataFrame) -> DataFrame:
    """(hash, spots, repositories, owners) of each value."""
    pairs = found.groupBy("hash", "owner", "repository").agg(F.count("*").alias("spots"))
    owners = pairs.groupBy("hash", "owner").agg(F.sum("spots").alias("spots"), F.count("*").alias("repositories"))
    return owners.groupBy("hash").agg(F.sum("spots").alias("spots"), F.sum("repositories").alias("repositories"), F.count("*").alias("owners"))


def find_secrets(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", owner: Column | None = None,
                 repository: Column | None = None, max_owners: int = 1) -> DataFrame:
    """One row per document: the id, and spans, an array of (start, kind, end, owners,
    repositories, live) by start and kind. Start and end count code points, end exclusive."""
    owner = F.col("source") if owner is None else owner
    repository = F.struct("source", "lang") if repository is None else repository
    named = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"), owner.alias("owner"), repository.alias("repository"))
    slim, found = matches(named, "text", F.col("owner"), F.col("repository"))
    found = materialize(found, "secrets-found")
    counts = materialize(ownership(found), "secrets-owners")
    spans = join_counted(found, counts, ["hash"], "spots").withColumn("live", (F.col("owners") <= max_owners) & looks_live(F.col("value")))
    spans = spans.filter("kind < 3 OR live").withColumn("base_end", F.when(F.col("kind") < 3, F.col("end"))).withColumn(
        "base_start", F.when(F.col("kind") < 3, F.col("start")))
    ahead = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    behind = Window.partitionBy("row").orderBy(F.desc("start"), F.asc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    free = ((F.coalesce(F.max("base_end").over(ahead), F.lit(0)) <= F.col("start"))
            & (F.coalesce(F.min("base_start").over(behind), F.col("end")) >= F.col("end")))
    spans = spans.withColumn("free", free).filter("kind < 3 OR free")
    one = F.struct("start", "kind", "end", "owners", "repositories", "live")
    each = spans.groupBy("row").agg(F.array_sort(F.collect_list(one)).alias("spans"))
    none = F.array().cast(each.schema["spans"].dataType)
    some = slim.filter(F.size("pieces") > 0).select("row", "doc").join(each, "row", "left").select("doc", F.coalesce("spans", none).alias("spans"))
    rest = slim.filter(F.size("pieces") == 0).select("doc", none.alias("spans"))
    return rest.unionByName(some).withColumnRenamed("doc", id_col)


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    kind = lambda s: F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))), ",")
