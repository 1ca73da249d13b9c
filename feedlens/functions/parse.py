"""Grading replies -> rubric labels, as higher-order column expressions (no Python per row).

Yes/no replies are folded line by line with ``aggregate``; the state is the index of the
current numbered item and the label array. Rules per line, in order:
  * a line starting with ``<next item number>.`` advances the item index;
  * ``<n>. Yes`` at the line start, or ``Answer: Yes`` / ``Answer: Yes.`` at the line end,
    sets the current label to 1 (``No`` likewise to 0);
  * the index starts before the first item, where writes land on the last label;
  * unset labels stay 0.5; if any is unset after the fold, the label at the final index is
    set to 0 (source behaviour). ``strict=True`` instead turns unset labels into NULL.
Likert replies: the first ``Score: <digits>`` of each line, in order, scaled ``(s-1)/(max-1)``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedlens.rubric import LIKERT_MAX_SCORES

N_LABELS = 5


def _target(idx: Column, n: int) -> Column:
    """Python list index semantics for -1 (last label)."""
    return F.when(idx < 0, idx + F.lit(n)).otherwise(idx)


def parse_binary(response, n: int = N_LABELS, strict: bool = False) -> Column:
    """Struct ``(labels ARRAY<DOUBLE>, n_missing INT)`` parsed from a yes/no grading reply."""
    resp = F.col(response) if isinstance(response, str) else response
    init = F.struct(F.lit(-1).alias("idx"), F.array_repeat(F.lit(0.5), n).alias("lab"))

    def step(acc, line):
        idx = acc["idx"]
        nidx = F.when(line.startswith(F.concat((idx + 2).cast("string"), F.lit("."))), idx + 1).otherwise(idx)
        item = F.concat((nidx + 1).cast("string"), F.lit(". "))
        yes = (line.startswith(F.concat(item, F.lit("Yes"))) | line.endswith("Answer: Yes")
               | line.endswith("Answer: Yes."))
        no = (line.startswith(F.concat(item, F.lit("No"))) | line.endswith("Answer: No")
              | line.endswith("Answer: No."))
        tgt = _target(nidx, n)
        lab = F.transform(acc["lab"], lambda x, i: F.when((i == tgt) & yes, F.lit(1.0))
                          .when((i == tgt) & no, F.lit(0.0)).otherwise(x))
        return F.struct(nidx.alias("idx"), lab.alias("lab"))

    def finish(acc):
        lab = acc["lab"]
        missing = F.size(F.filter(lab, lambda x: x == 0.5))
        if strict:
            out = F.transform(lab, lambda x: F.when(x != 0.5, x))
        else:
            tgt = _target(acc["idx"], n)
            out = F.when(missing > 0, F.transform(lab, lambda x, i: F.when(i == tgt, F.lit(0.0)).otherwise(x))
                         ).otherwise(lab)
        return F.struct(out.alias("labels"), missing.alias("n_missing"))

    return F.aggregate(F.split(resp, "\n"), init, step, finish)


def parse_likert(response, max_scores=LIKERT_MAX_SCORES, strict: bool = False) -> Column:
    """Struct ``(labels ARRAY<DOUBLE>, n_missing INT)`` from a Likert grading reply."""
    resp = F.col(response) if isinstance(response, str) else response
    found = F.filter(F.transform(F.split(resp, "\n"), lambda l: F.regexp_extract(l, r"Score: (\d+)", 1)),
                     lambda s: s != "")
    vals = []
    for i, mx in enumerate(max_scores):
        s = F.try_element_at(found, F.lit(i + 1)).try_cast("int")
        v = (s - 1).cast("double") / F.lit(float(mx - 1))
        if strict:
            v = F.when(s.between(1, mx), v)
        else:
            v = F.coalesce(v, F.lit(0.5))
        vals.append(v)
    missing = F.greatest(F.lit(len(max_scores)) - F.size(found), F.lit(0))
    return F.struct(F.array(*vals).alias("labels"), missing.alias("n_missing"))


# ---- DuckDB counterparts ------------------------------------------------------------------

def sql_parse_binary_ctes(src: str, id_col: str = "row_id", resp: str = "response", n: int = N_LABELS,
                          strict: bool = False) -> str:
    """CTEs ``pb_lines``, ``pb_fold`` and ``parsed`` (rid, l0..l{n-1}, n_missing)."""
    labs = [f"l{i}" for i in range(n)]
    tgt = f"CASE WHEN nidx < 0 THEN nidx + {n} ELSE nidx END"
    upd = ", ".join(f"CASE WHEN {tgt} = {i} AND isyes THEN 1.0 WHEN {tgt} = {i} AND isno THEN 0.0 ELSE {l} END"
                    for i, l in enumerate(labs))
    missing = " + ".join(f"CAST({l} = 0.5 AS INTEGER)" for l in labs)
    ftgt = f"CASE WHEN idx < 0 THEN idx + {n} ELSE idx END"
    if strict:
        fin = ", ".join(f"CASE WHEN {l} <> 0.5 THEN {l} END AS {l}" for l in labs)
    else:
        fin = ", ".join(f"CASE WHEN nm > 0 AND {ftgt} = {i} THEN 0.0 ELSE {l} END AS {l}" for i, l in enumerate(labs))
    return f"""
pb_lines AS (SELECT {id_col} AS rid, string_split({resp}, chr(10)) AS lines FROM {src}),
pb_fold AS (
  WITH RECURSIVE s(rid, k, idx, {', '.join(labs)}) AS (
    SELECT rid, 0, -1, {', '.join(['CAST(0.5 AS DOUBLE)'] * n)} FROM pb_lines
    UNION ALL
    SELECT rid, k + 1, nidx, {upd} FROM (
      SELECT t.*, starts_with(line, CAST(nidx + 1 AS VARCHAR) || '. Yes') OR ends_with(line, 'Answer: Yes')
               OR ends_with(line, 'Answer: Yes.') AS isyes,
             starts_with(line, CAST(nidx + 1 AS VARCHAR) || '. No') OR ends_with(line, 'Answer: No')
               OR ends_with(line, 'Answer: No.') AS isno
      FROM (SELECT s.*, p.lines[s.k + 1] AS line,
              CASE WHEN starts_with(p.lines[s.k + 1], CAST(s.idx + 2 AS VARCHAR) || '.') THEN s.idx + 1 ELSE s.idx END AS nidx
            FROM s JOIN pb_lines p ON s.rid = p.rid WHERE s.k < len(p.lines)) t))
  SELECT s.* FROM s JOIN pb_lines p ON s.rid = p.rid WHERE s.k = len(p.lines)),
parsed AS (SELECT rid, {fin}, nm AS n_missing FROM (SELECT *, {missing} AS nm FROM pb_fold))"""


def sql_parse_likert(resp: str = "response", max_scores=LIKERT_MAX_SCORES, strict: bool = False) -> tuple[str, list[str]]:
    """(select-list of labels l0.., expression for n_missing) over a relation having ``sc``.

    ``sc`` must be defined as the list of found scores (see ``sql_likert_scores``).
    """
    outs = []
    for i, mx in enumerate(max_scores):
        s = f"TRY_CAST(sc[{i + 1}] AS INTEGER)"
        v = f"CAST({s} - 1 AS DOUBLE) / {float(mx - 1)}"
        outs.append(f"CASE WHEN {s} BETWEEN 1 AND {mx} THEN {v} END" if strict else f"coalesce({v}, 0.5)")
    return f"greatest({len(max_scores)} - len(sc), 0)", outs


def sql_likert_scores(resp: str = "response") -> str:
    return (f"list_filter(list_transform(string_split({resp}, chr(10)), lambda l: regexp_extract(l, 'Score: (\\d+)', 1)), "
            "lambda s: s <> '')")
