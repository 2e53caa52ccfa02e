"""The corpus operators' queries, each over its whole table with production parameters, and the SQL of those that have one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import scratch
from . import op1_lines, op2_pack, op3_pii, op4_mix, op5_shard, op6_bwt, op7_toxic, op8_media, op9_jaccard, op10_decon
from .common import table


def op1_lines_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op1_lines.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2("kept", 256).alias("kept_sha256"))


def op2_pack_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        model = f.read()
    path = scratch(spark, "tokens")
    op2_pack.write(table(spark, sf_dir, "documents"), path, model, vocabulary=49_408, end_id=2)
    return op2_pack.read_digest(spark, path)


def op3_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_pii.digest(table(spark, sf_dir, "documents"))


def op4_mix_pivotal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_mix.mix(table(spark, sf_dir, "documents"))


def op5_shard_jump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_shard.shard(table(spark, sf_dir, "documents"))


def op6_bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_bwt.dedup(table(spark, sf_dir, "documents")).drop("kept")


def op7_toxic_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_toxic.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_media_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rendered vectors, and an edited copy of each hundredth of them; `copy_of` has the copy's original."""
    images = op8_media.render(table(spark, sf_dir, "embeddings"))
    found = op8_media.classes(images.unionByName(op8_media.edited(images)))
    return found.withColumn("copy_of", F.when(F.col("image_id") < 0, -1 - F.col("image_id")))


def op9_jaccard_rtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_jaccard.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op10_decon_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_decon.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OWN = (
    op1_lines_suffix, op2_pack_tokens, op3_pii_disclosure, op4_mix_pivotal, op5_shard_jump,
    op6_bwt_dedup, op7_toxic_lexicon, op8_media_descriptors, op9_jaccard_rtree, op10_decon_template,
)

def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of the mix is no chance: sizes and targets."""
    return op4_mix.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", F.round("target", 6).alias("target"))


#: Line runs of one, two and three lines; the last line feed of a kept text falls as in the operator.
_OP1 = r"""
with l as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 as i
  from documents),
w as (
  select doc_id, i, line as a, lead(line, 1) over d as b, lead(line, 2) over d as c, n as na, lead(n, 1) over d as nb
  from (select *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as n from l) window d as (partition by doc_id order by i)),
later as (
  select doc_id, i, 3 as n from (
    select doc_id, i, row_number() over (partition by a, b, c order by doc_id, i) as turn from w where c is not null) where turn > 1
  union all
  select doc_id, i, 2 from (
    select doc_id, i, na + nb as words, row_number() over (partition by a, b order by doc_id, i) as turn from w where b is not null) where turn > 1 and words >= 50
  union all
  select doc_id, i, 1 from (
    select doc_id, i, na as words, row_number() over (partition by a order by doc_id, i) as turn from w) where turn > 1 and words >= 50),
gone as (select distinct doc_id, i + d as i from later, (values (0), (1), (2)) s(d) where d < n),
flag as (
  select l.doc_id, l.i, l.line, g.i is not null as gone from l left join gone g on g.doc_id = l.doc_id and g.i = l.i),
runs as (
  select *, case when gone and not coalesce(lag(gone) over (partition by doc_id order by i), false) then 1 else 0 end as new_run from flag)
select doc_id, count(*) as n_lines, cast(sum(case when gone then 1 else 0 end) as bigint) as n_removed, cast(sum(new_run) as bigint) as n_runs,
  sha256(coalesce(string_agg(case when not gone then line end, chr(10) order by i), '')) as kept_sha256
from runs group by doc_id
"""

#: Sizes by words, sources in order with their weights; the level at which sources stop is found from the running sums.
_MIX = r"""
with d as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
o as (select *, [5.0, 2.0, 1.0][1 + (row_number() over (order by source nulls last) - 1) % 3] as weight, 3.0 * source_size as most, sum(source_size) over () as everything from s),
r as (
  select *, cast(most as double) / weight as reach,
    (everything - coalesce(sum(most) over before, 0)) / cast(sum(weight) over () - coalesce(sum(weight) over before, 0) as double) as level
  from o window before as (order by most / weight, source nulls last rows between unbounded preceding and 1 preceding)),
t as (select source, source_size, least(cast(most as double), weight * coalesce((select level from r where level <= reach order by reach, source nulls last limit 1), 1e300)) as target from r)
select doc_id, d.source, size, source_size, round(target, 6) as target from d join t on d.source is not distinct from t.source
"""

#: Every string of 50 bytes with the smallest document that it starts in, as hexadecimal digits.
_OP6 = r"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) as x from documents),
p as (select doc_id, len(x) // 2 as n, p, substring(x, 2000 * p + 1, 2098) as y from (select doc_id, x, unnest(generate_series(0, (len(x) // 2 - 1) // 1000)) as p from d where len(x) > 0)),
b as (select doc_id, n, y, 1000 * p + j as i, j from (select *, unnest(generate_series(0, least(999, n - 1 - 1000 * p))) as j from p)),
w as (select doc_id, i, substring(y, 2 * j + 1, 100) as s from b where i + 50 <= n),
later as (select doc_id, i from w join (select s, min(doc_id) as least from w group by s having count(*) > 1) using (s) where least < doc_id),
near as (select b.doc_id, b.i, substring(y, 2 * j + 1, 2) as byte, max(l.i) over (partition by b.doc_id order by b.i) as last from b left join later l on l.doc_id = b.doc_id and l.i = b.i),
flag as (select *, coalesce(i - last < 50, false) as gone from near),
run as (select *, gone and not coalesce(lag(gone) over (partition by doc_id order by i), false) as fresh from flag),
out as (
  select doc_id, count(*) as n_bytes, sum(gone::int) as n_removed, sum(fresh::int) as n_spans, sha256(unhex(coalesce(string_agg(case when not gone then byte end, '' order by i), ''))) as kept_sha256
  from run group by doc_id)
select d.doc_id, cast(coalesce(n_bytes, 0) as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, cast(coalesce(n_spans, 0) as bigint) as n_spans,
  coalesce(kept_sha256, sha256('')) as kept_sha256
from d left join out using (doc_id)
"""

#: Distinct shingles of three words, pairs that share one with their intersections, and the components of what is similar enough.
_OP9 = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
shingles as (
  select distinct doc_id, s from (
    select doc_id, unnest(case when len(w) >= 3 then list_transform(generate_series(1, len(w) - 2), lambda i: hash(w[i], w[i + 1], w[i + 2])) when len(w) > 0 then [hash(w)] else [] end) as s from words)),
n as (select doc_id, count(*) as n from shingles group by doc_id),
same as (select doc_id, min(doc_id) over (partition by body) as rep from (select doc_id, list(s order by s) as body from shingles group by doc_id)),
one as (select s.* from shingles s join same using (doc_id) where doc_id = rep),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as both_ from one a join one b on a.s = b.s and a.doc_id < b.doc_id group by all),
links as (select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 100 * both_ >= 90 * (x.n + y.n - both_)),
edges as (select a, b from links union all select b, a from links union all select rep, doc_id from same where rep <> doc_id union all select doc_id, rep from same where rep <> doc_id),
reach as (select doc_id as u, doc_id as v from same union select u, b from reach join edges on a = v),
least as (select u, min(v) as component_id from reach group by u)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(component_id, d.doc_id) as component_id
from documents d left join n using (doc_id) left join least on u = d.doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in (*OWN, mix_targets)}


def oracle_sql() -> dict[str, str]:
    return {"op1_lines_suffix": _OP1, "op6_bwt_dedup": _OP6, "op9_jaccard_rtree": _OP9, "mix_targets": _MIX}
