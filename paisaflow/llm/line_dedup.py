"""Removing boilerplate lines: those that many sites have, however often each has them.

Spread is a count of distinct sites per line, so a line repeated within one site stays. Every task
folds its lines into HyperLogLog sketches per line hash, and sketches merge by aggregation; the
sites of a line are never listed, and a line with a third of all rows is one sketch per task. The
estimate settles all lines but those near the threshold, whose sites are then counted exactly.
Removed lines go back to their documents by number, in one join with the texts.

Lines end at ``\\n`` and are compared without ``[\\x20\\x09-\\x0D]`` at either end; blank lines are
never removed. Null or empty text has no lines. A null source is a site of its own. A null
``doc_id`` is as any other; rows that repeat ``doc_id`` and text lose the same lines. Empty table:
empty result. Other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from paisaflow.llm.frames import documents
from paisaflow.session import cut, forget

MIN_SITES = 5
LOG_REGISTERS = 10
DEVIATIONS = 4
_BLANK = " \t\n\x0b\x0c\r"


def site_lines(docs: DataFrame) -> DataFrame:
    """Every line that is not blank: doc_id, fp, its number, a digest and the site; stored."""
    parts = F.split(F.col("text"), "\n")
    return cut(docs.filter("text <> ''").select(
        "doc_id", F.xxhash64("text").alias("fp"), "source", F.posexplode(parts).alias("line_no", "line")
    ).select(
        "doc_id", "fp", "line_no", F.btrim("line", F.lit(_BLANK)).alias("line"),
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null")).alias("site"),
    ).filter("line <> ''").select(
        "doc_id", "fp", "line_no", F.unhex(F.md5(F.col("line").cast("binary"))).alias("line"), "site"
    ))


def widespread(lines: DataFrame, min_sites: int) -> DataFrame:
    """The lines of at least ``min_sites`` sites: by sketch, near the threshold by exact count."""
    spread = cut(lines.groupBy("line").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LOG_REGISTERS))).alias("sites")
    ))
    band = 1 + math.ceil(DEVIATIONS * 1.04 / math.sqrt(1 << LOG_REGISTERS) * min_sites)
    near = cut(spread.filter(F.abs(F.col("sites") - min_sites) <= band).select("line"))
    counted = lines.join(near, "line", "left_semi").groupBy("line").agg(
        F.count_distinct("site").alias("sites")
    ).filter(F.col("sites") >= min_sites).select("line")
    found = cut(spread.filter(F.col("sites") > min_sites + band).select("line").unionByName(counted))
    forget(spread, near)
    return found


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """doc_id, n_lines, n_removed and the text that stays, for every row."""
    lines = site_lines(docs)
    gone = cut(lines.join(widespread(lines, min_sites), "line", "left_semi").groupBy(
        F.col("doc_id").alias("g_doc"), F.col("fp").alias("g_fp")
    ).agg(F.collect_set("line_no").alias("gone")))
    forget(lines)
    own = docs.select("doc_id", "text", F.xxhash64("text").alias("fp")).join(
        # the same plan at every size: documents with removed lines are never few for long
        gone.hint("merge"),
        F.col("doc_id").eqNullSafe(F.col("g_doc")) & (F.col("fp") == F.col("g_fp")), "left",
    )
    parts = F.when(F.col("text") != "", F.split("text", "\n")).otherwise(F.array().cast("array<string>"))
    kept = F.when(
        F.col("gone").isNull(), F.coalesce("text", F.lit(""))
    ).otherwise(F.array_join(F.filter(parts, lambda x, i: ~F.array_contains("gone", i)), "\n"))
    return own.select(
        "doc_id", F.coalesce(F.size(parts), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), kept.alias("kept"),
    )


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir)).select(
        "doc_id", "n_lines", "n_removed", F.octet_length("kept").cast("long").alias("n_kept_bytes"),
        F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"),
    )


OP5_SQL = f"""
with parts as (
  select doc_id, source, text,
    case when coalesce(text, '') = '' then [] else string_split(text, chr(10)) end as p from documents
), lines as (
  select doc_id, source, i, p[i] as line, trim(p[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as plain
  from (select doc_id, source, p, unnest(range(1, len(p) + 1)) as i from parts)
), wide as (
  select plain from lines where plain <> '' group by plain
  having count(distinct source) + max(case when source is null then 1 else 0 end) >= {MIN_SITES}
), judged as (
  select doc_id, i, line, plain in (select plain from wide) as is_gone from lines
), kept as (
  select doc_id, count(*) as n_lines, sum(case when is_gone then 1 else 0 end) as n_removed,
    coalesce(string_agg(line, chr(10) order by i) filter (where not is_gone), '') as kept
  from judged group by doc_id
)
select d.doc_id, cast(coalesce(k.n_lines, 0) as bigint) as n_lines, cast(coalesce(k.n_removed, 0) as bigint) as n_removed,
  cast(octet_length(encode(coalesce(k.kept, ''))) as bigint) as n_kept_bytes, sha256(coalesce(k.kept, '')) as kept_sha256
from documents d left join kept k using (doc_id)
"""
