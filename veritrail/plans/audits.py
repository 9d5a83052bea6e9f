"""Queries of the checks of annotated collections. Documents stand for themselves, words of their texts for annotated spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritrail.operators import audit
from veritrail.operators.spans import starts
from veritrail.plans.base import query, rounded, table


def docs(spark, d):
    i = F.col("doc_id")
    return table(spark, d, "documents").select("doc_id", F.element_at(F.array(*map(F.lit, ["train", "val", "test"])), (i % 3 + 1).cast("int")).alias("split"), "text")


def spans(spark, d):
    """Every word of every document but each seventh, labelled by its length; a ninth of the places are off by one. Documents are dealt
    by id before they are words, which then need no shuffle of their own."""
    words = table(spark, d, "documents").where("doc_id % 7 <> 0").select("doc_id", "text").repartition("doc_id").select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "text"))
    each = starts(words, ["doc_id"], "pos")
    start = F.col("start") + F.col("pos") + F.when((F.col("doc_id") + F.col("pos")) % 9 == 0, 1).otherwise(0)
    label = F.element_at(F.array(*map(F.lit, ["issue_date", "gross_amount", "party", "note"])), (F.least(F.length("text"), F.lit(11)) / 3 + 1).cast("int"))
    return each.select("doc_id", "pos", label.alias("label"), start.cast("int").alias("start"), (start + F.length("text")).cast("int").alias("end"), "text")


SPANS = """dd as (select doc_id, (['train', 'val', 'test'])[doc_id % 3 + 1] as split, text from documents),
wd as (select doc_id, string_split(text, ' ') as w from documents where doc_id % 7 <> 0), we as (select doc_id, unnest(w) as text, generate_subscripts(w, 1) - 1 as pos from wd),
sp as (select doc_id, pos, (['issue_date', 'gross_amount', 'party', 'note'])[least(length(text), 11) // 3 + 1] as label, (coalesce(sum(length(text) + 1) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), 0) + case when (doc_id + pos) % 9 = 0 then 1 else 0 end)::int as start, text from we)"""


@query(f"with {SPANS} select split, count(*) as n from dd group by rollup (split)")
def agg_doc_counts(spark, d):
    return audit.document_counts(docs(spark, d))


@query(f"""with {SPANS}, p as (select label, doc_id, count(*) as n from sp group by all), t as (select count(*) as n from dd)
select label, sum(p.n)::bigint as n_spans, round(1 - count(*)::double / max(t.n), 9) as empty_share, min(p.n) as least, quantile_cont(p.n::double, 0.5) as median, max(p.n) as most, min(p.n) = 1 and max(p.n) = 1 as flat from p, t group by label""")
def agg_density(spark, d):
    return rounded(audit.density(docs(spark, d), spans(spark, d)), "empty_share")


@query(f"with {SPANS}, f as (select * from dd order by doc_id limit 60) select count(*) as checked, count(*) filter (substr(f.text, start + 1, length(sp.text)) <> sp.text) as mismatched from sp join f using (doc_id)")
def agg_offset(spark, d):
    """The report looks at the first sixty documents."""
    return audit.offsets(docs(spark, d), spans(spark, d))


@query(f"with {SPANS} select count(*) as checked, count(*) filter (substr(dd.text, start + 1, length(sp.text)) <> sp.text) as mismatched from sp join dd using (doc_id)")
def agg_offset_all(spark, d):
    return audit.offsets(docs(spark, d), spans(spark, d), None)


@query(f"""with {SPANS}, t as (select coalesce(sum(len(regexp_extract_all(text, '\\b(?:\\d{{1,2}}[/-]\\d{{1,2}}[/-]\\d{{2,4}}|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\\.?\\s+\\d{{1,2}},?\\s+\\d{{4}})\\b'))), 0)::bigint as dates,
  coalesce(sum(len(regexp_extract_all(text, '\\$\\s?\\d[\\d,]*(?:\\.\\d{{2}})?'))), 0)::bigint as money from dd), g as (select count(*) filter (label = 'issue_date') as gd, count(*) filter (label = 'gross_amount') as gm from sp)
select 'dates' as kind, dates as in_text, gd as in_gold, round(case when gd = 0 then 'inf'::double else dates::double / gd end, 9) as ratio from t, g union all select 'money', money, gm, round(case when gm = 0 then 'inf'::double else money::double / gm end, 9) from t, g""")
def agg_underannot(spark, d):
    return rounded(audit.under_annotation(docs(spark, d), spans(spark, d)), "ratio")


@query(f"""with {SPANS}, p as (select doc_id, count(distinct label) as n from sp group by doc_id), c as (select coalesce(p.n, 0) as n_labels, count(*) as n_docs from dd left join p using (doc_id) group by 1), o as (select count(distinct label) as o from sp)
select g.n::int as n_labels, coalesce(n_docs, 0)::bigint as n_docs, o::int as of, case when g.n = o then 'full' when g.n = 0 then 'none' else 'some' end as coverage from o, range(0, 5) g(n) left join c on c.n_labels = g.n where g.n <= o""")
def agg_doc_coverage(spark, d):
    return audit.document_coverage(docs(spark, d), spans(spark, d))


@query(f"""with {SPANS}, p as (select label, doc_id, count(*) as n, count(distinct text) as u from sp group by all), l as (select label, quantile_cont(n::double, 0.5) as median, avg(1 - u::double / n) as repeated from p group by label)
select label, median, round(repeated, 9) as repeated, case when median >= 5 and repeated >= 0.2 then 'tabular' when median >= 5 then 'many' else 'flat' end as verdict from l""")
def agg_tabular(spark, d):
    return rounded(audit.tabular(spans(spark, d)), "repeated")


@query(f"""with {SPANS}, p as (select doc_id, label, count(*) as n, string_agg(text, '|' order by pos) filter (k <= 4) as v from (select *, row_number() over (partition by doc_id, label order by pos) as k from sp) group by all)
select dd.doc_id, split, length(dd.text) as length, coalesce(sum(n) over (partition by dd.doc_id), 0)::bigint as n_spans, label, coalesce(n, 0) as n, v as values, md5(substr(dd.text, 1, 400)) as "window" from dd left join p using (doc_id)""")
def agg_review(spark, d):
    """What there is to read by eye, of all documents."""
    return audit.review(docs(spark, d), spans(spark, d)).withColumn("values", F.array_join("values", "|")).withColumn("window", F.md5(F.col("window").cast("binary")))
