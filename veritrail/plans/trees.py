"""Queries of JSON trees: labels of every kind of pair, leaves, keys, and where values lie among tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritrail.functions import udtfs
from veritrail.operators import locate, reports, trees
from veritrail.operators.ranges import spread
from veritrail.plans.base import query, rounded, table


def pairs(spark, d, gold, extracted, schema: str, name: str = "orders"):
    """Rows of a table with gold and extracted as JSON texts."""
    return table(spark, d, name).select(F.col("o_orderkey").alias("doc_id"), F.lit(schema).alias("schema"), gold.alias("gold"), extracted.alias("extracted"))


LEAF = '{"properties": {"s": {"evaluation_config": "string_exact"}, "n": {"evaluation_config": "number_tolerance"}, "c": {"evaluation_config": "string_case_insensitive"}, "o": {"properties": {"deep": {"evaluation_config": "integer_exact"}}}, "odd": {"evaluation_config": "nobody_knows"}}}'


def leaf_pairs(spark, d):
    k = F.col("o_orderkey")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    gold = text('{"s": "', F.col("o_orderstatus"), '", "n": ', F.col("o_custkey"), ', "c": "', F.col("o_orderpriority"), '", "o": {"deep": ', k, '}, "odd": "x"}')
    s = F.when(k % 5 == 0, "null").when(k % 5 == 1, '""').when(k % 5 == 2, '"Z"').otherwise(F.concat(F.lit('"'), "o_orderstatus", F.lit('"')))
    n = F.when(k % 3 == 0, text('"', F.col("o_custkey"), '"')).when(k % 3 == 1, text(F.col("o_custkey") * 2)).otherwise(text(F.col("o_custkey"), ".0"))
    got = text('{"s": ', s, ', "n": ', n, ', "c": " ', F.lower("o_orderpriority"), '", "o": ', F.when(k % 4 == 0, "{}").otherwise(text('{"deep": "', k, '"}')), ', "extra": "more"}')
    return pairs(spark, d, gold, got, LEAF)


LEAVES = """lp as (select o_orderkey as doc_id, o_custkey, o_orderkey % 5 as k5, o_orderkey % 3 as k3, o_orderkey % 4 as k4 from orders),
lv as (select doc_id, 's' as path_str, case when k5 in (0, 1) then 'omission' when k5 = 2 then 'value_mismatch' else 'match' end as error_type, 'exact' as strategy from lp
union all select doc_id, 'n', case when k3 = 1 and o_custkey > 0 then 'value_mismatch' else 'match' end, 'number' from lp union all select doc_id, 'c', 'match', 'case_insensitive' from lp
union all select doc_id, 'o.deep', case when k4 = 0 then 'omission' else 'match' end, 'exact' from lp union all select doc_id, 'odd', 'omission', 'auto' from lp union all select doc_id, 'extra', 'hallucination', 'auto' from lp)"""


@query(f"with {LEAVES} select doc_id, path_str, error_type, strategy, error_type in ('omission', 'match', 'value_mismatch') as gold_present, error_type in ('hallucination', 'match', 'value_mismatch') as extracted_present from lv")
def tree_match(spark, d):
    """Nested objects, missing and unknown keys, blanks, and a strategy a field."""
    out = trees.label_trees(leaf_pairs(spark, d))
    return out.select("doc_id", "path_str", "error_type", F.col("comparison_strategy").alias("strategy"), "gold_present", "extracted_present")


def in_sql(spark, text: str, **tables):
    """A query's text with the table functions, over tables that are passed as its parameters."""
    udtfs.register(spark)
    return spark.sql(text, **{name: spread(t) for name, t in tables.items()})


@query(f"with {LEAVES} select doc_id, path_str, error_type, strategy from lv")
def udtf_labels(spark, d):
    """tree_match as a lateral call from SQL."""
    return in_sql(spark, "select p.doc_id, l.path_str, l.error_type, l.comparison_strategy as strategy from {pairs} p, lateral tree_labels(p.schema, p.gold, p.extracted) l", pairs=leaf_pairs(spark, d))


@query(f"with {LEAVES} select doc_id, count(*) as n_total, count(*) filter (error_type <> 'match') as n_errors from lv group by doc_id")
def udtf_label_counts(spark, d):
    """A table argument, a partition a document, which deals the rows."""
    udtfs.register(spark)
    return spark.sql("select * from tree_label_counts(table(select doc_id, schema, gold, extracted from {pairs}) partition by doc_id)", pairs=leaf_pairs(spark, d))


@query(f"with {LEAVES} select doc_id, path_str, (error_type <> 'match')::int as is_error from lv where path_str in ('n', 's')")
def tree_leaf(spark, d):
    return trees.label_trees(leaf_pairs(spark, d)).where("path_str in ('n', 's')").select("doc_id", "path_str", "is_error")


@query(f"with {LEAVES} select distinct path_str, strategy from lv")
def tree_strategy(spark, d):
    """Known, missing and unknown ways to evaluate."""
    return trees.label_trees(leaf_pairs(spark, d)).select("path_str", F.col("comparison_strategy").alias("strategy")).distinct()


@query(f"with {LEAVES} select distinct path_str, replace(path_str, '.', '/') as path from lv")
def tree_path(spark, d):
    return trees.label_trees(leaf_pairs(spark, d)).select("path_str", F.array_join("path", "/").alias("path")).distinct()


@query(f"with {LEAVES} select doc_id, count(*) as n_total, count(*) filter (error_type <> 'match') as n_errors, count(*) filter (error_type = 'hallucination') as n_hallucinations, count(*) filter (error_type = 'omission') as n_omissions, count(*) filter (error_type = 'value_mismatch') as n_value_mismatches, 0::bigint as n_type_mismatches, round(avg((error_type <> 'match')::int), 9) as error_rate from lv group by doc_id")
def tree_entry(spark, d):
    """Labels with the counts of each document."""
    return rounded(reports.label_counts(trees.label_trees(leaf_pairs(spark, d)), ["doc_id"]), "error_rate")


ARRAYS = '{"properties": {"tags": {"evaluation_config": "array_llm", "items": {"type": "string", "evaluation_config": "string_semantic"}}, "crew": {"items": {"type": "object", "properties": {"r": {"evaluation_config": "string_exact"}}}}}}'


def array_pairs(spark, d):
    k, p = F.col("o_orderkey"), F.col("o_orderpriority")
    gold = F.concat(F.lit('{"tags": ["'), p, F.lit('", "B"], "crew": [{"r": "a"}, {"r": "'), "o_orderstatus", F.lit('"}]}'))
    tags = F.when(k % 4 == 0, F.concat(F.lit('["b", "'), F.lower(p), F.lit('"]'))).when(k % 4 == 1, '["c"]').when(k % 4 == 2, "[]").otherwise(F.concat(F.lit('["B", "B", "'), p, F.lit('"]')))
    crew = F.when(k % 3 == 0, '[{"r": "a"}]').when(k % 3 == 1, F.concat(F.lit('[{"r": "x"}, {"r": "'), "o_orderstatus", F.lit('"}, {"r": "new"}]'))).otherwise("null")
    return pairs(spark, d, gold, F.concat(F.lit('{"tags": '), tags, F.lit(', "crew": '), crew, F.lit("}")), ARRAYS)


@query("select o_orderkey as doc_id, case o_orderkey % 4 when 1 then 'value_mismatch' when 2 then 'omission' else 'match' end as error_type, 'set_fuzzy' as strategy from orders")
def tree_prim_array(spark, d):
    """Arrays of scalars are one field, compared as sets without case."""
    out = trees.label_trees(array_pairs(spark, d)).where("path_str = 'tags'")
    return out.select("doc_id", "error_type", F.col("comparison_strategy").alias("strategy"))


@query("""with o as (select o_orderkey as doc_id, o_orderkey % 3 as k from orders) select doc_id, 'crew.0.r' as path_str, case k when 0 then 'match' when 1 then 'value_mismatch' else 'omission' end as error_type from o
union all select doc_id, 'crew.1.r', case k when 1 then 'match' else 'omission' end from o union all select doc_id, 'crew.2.r', 'hallucination' from o where k = 1""")
def tree_is_obj_array(spark, d):
    """Arrays of objects are compared place by place."""
    return trees.label_trees(array_pairs(spark, d)).where("path_str <> 'tags'").select("doc_id", "path_str", "error_type")


MEMBERS = '{"properties": {"m": {"x-match-mode": "set_membership", "items": {"evaluation_config": "string_case_insensitive"}}}}'


def member_pairs(spark, d):
    k, p = F.col("o_orderkey"), F.col("o_orderpriority")
    gold = F.when(k % 5 == 4, '{"m": []}').otherwise(F.concat(F.lit('{"m": ["'), p, F.lit('", "b", " "]}')))
    return pairs(spark, d, gold, F.concat(F.lit('{"m": ["'), F.lower(p), F.lit('", "'), F.col("o_orderstatus"), F.lit('", "", "'), p, F.lit('"]}')), MEMBERS)


@query("""with o as (select o_orderkey as doc_id, o_orderkey % 5 = 4 as none from orders) select doc_id, 'm.0' as path_str, case when none then 'hallucination' else 'match' end as error_type from o
union all select doc_id, 'm.1', case when none then 'hallucination' else 'value_mismatch' end from o union all select doc_id, 'm.2', 'omission' from o union all select doc_id, 'm.3', case when none then 'hallucination' else 'match' end from o
union all select doc_id, 'm.gold1', 'unmatched' from o where not none""")
def tree_set_member(spark, d):
    """A row an extracted element, and gold elements that none equals."""
    p = member_pairs(spark, d)
    return trees.label_trees(p).select("doc_id", "path_str", "error_type").unionByName(trees.unmatched_gold(p).withColumn("error_type", F.lit("unmatched")))


#: Gold and extracted containers and scalars, S and N standing for a text and a number of the order, and what becomes of them.
CELLS = [("{}", "null", "match"), ("null", "{}", None), ("{}", "S", "hallucination"), ("S", "{}", "omission"), ("[]", "null", "type_mismatch"), ("[]", "S", "type_mismatch"), ("S", "[]", "type_mismatch"), ("S", "[N]", "type_mismatch"), ("null", "[N]", "hallucination"), ("[N]", "null", "omission"), ("[]", '{"a": N}', "type_mismatch"), ("{}", "[N]", "hallucination"), ("[N]", "{}", "omission"), ("[]", "{}", "match"), ("{}", "[]", "match"), ('{"a": N}', "S", "type_mismatch"), ("[N, 2]", '{"a": N}', "type_mismatch")]


def cells(spark, d):
    o = table(spark, d, "orders")
    kinds = F.array(*[F.struct(F.lit(g).alias("g"), F.lit(e).alias("e")) for g, e, _ in CELLS])
    text, number = F.concat(F.lit('"'), "o_orderpriority", F.lit('"')), F.col("o_custkey").cast("string")
    filled = lambda c: F.concat(F.lit('{"v": '), F.replace(F.replace(c, F.lit("N"), number), F.lit("S"), text), F.lit("}"))
    x = F.element_at(kinds, (F.col("o_orderkey") % len(CELLS) + 1).cast("int"))
    return o.select(F.col("o_orderkey").alias("doc_id"), F.lit("{}").alias("schema"), filled(x["g"]).alias("gold"), filled(x["e"]).alias("extracted"))


def _cell_values(some) -> str:
    return ", ".join(f"({i}, '{w}')" for i, (_, _, w) in enumerate(CELLS) if w and some(w))


@query(f"select o_orderkey as doc_id, 'n/a' as strategy from orders join (values {_cell_values(lambda w: w == 'type_mismatch')}) v(i, w) on o_orderkey % {len(CELLS)} = i")
def tree_type_mismatch(spark, d):
    return trees.label_trees(cells(spark, d)).where("error_type = 'type_mismatch'").select("doc_id", F.col("comparison_strategy").alias("strategy"))


@query(f"select o_orderkey as doc_id, w as error_type from orders join (values {_cell_values(lambda w: w != 'type_mismatch')}) v(i, w) on o_orderkey % {len(CELLS)} = i")
def tree_empty_like(spark, d):
    """An empty or missing side takes the other's shape."""
    return trees.label_trees(cells(spark, d)).where("error_type <> 'type_mismatch'").select("doc_id", "error_type")


ANY = '{"properties": {"v": {"anyOf": [{"type": "array", "items": {"type": "string"}}, {"type": "string", "evaluation_config": "string_exact"}, {"type": "null"}]}}}'


@query("select o_orderkey as doc_id, case o_orderkey % 4 when 0 then 'set_fuzzy' when 1 then 'exact' when 2 then 'auto' else 'auto' end as strategy, case o_orderkey % 4 when 0 then 'match' when 1 then 'value_mismatch' when 2 then 'hallucination' else 'match' end as error_type from orders")
def tree_anyof(spark, d):
    """The variant of gold's type; of no type that is listed, the first."""
    k = F.col("o_orderkey") % 4
    gold = F.when(k == 0, '{"v": ["a"]}').when(k == 1, '{"v": "a"}').when(k == 2, '{"v": null}').otherwise('{"v": 5}')
    got = F.when(k == 0, '{"v": ["A"]}').when(k == 1, '{"v": "A"}').when(k == 2, '{"v": "b"}').otherwise('{"v": "5.0"}')
    return trees.label_trees(pairs(spark, d, gold, got, ANY)).select("doc_id", F.col("comparison_strategy").alias("strategy"), "error_type")


@query("""with o as (select o_orderkey as doc_id, o_custkey, o_orderstatus, o_totalprice > 200000 as big from orders) select doc_id, pos, path_str, kind, value from (
select doc_id, 0 as pos, 'a.0' as path_str, 'integer' as kind, o_custkey::varchar as value from o union all select doc_id, 1, 'a.1.s', 'string', o_orderstatus from o union all select doc_id, 2, 'a.1.b', 'boolean', case when big then 'True' else 'False' end from o
union all select doc_id, 3, 'n', 'null', null from o union all select doc_id, 4, 'f', 'number', '0.5' from o)""")
def tree_leaves(spark, d):
    """In the order of the document; empty containers have none."""
    text = F.concat(F.lit('{"e": [], "a": ['), "o_custkey", F.lit(', {"s": "'), "o_orderstatus", F.lit('", "b": '), F.when(F.col("o_totalprice") > 200000, "true").otherwise("false"), F.lit('}], "n": null, "f": 0.5, "g": {}}'))
    return trees.tree_leaves(table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), text.alias("t")), "t")


def key_trees(spark, d):
    k = F.col("o_orderkey")
    expected = F.lit('{"properties": {"a": {"type": "object", "properties": {"b": {"type": "string"}}}, "l": {"type": "array", "items": {"type": "object", "properties": {"c": {}}}}, "z": {"type": "string"}}}')
    got = F.when(k % 4 == 0, '{"a": {"b": 1}, "l": [{"c": 1}, {}], "z": 0}').when(k % 4 == 1, '{"a": {"b": 1}, "l": [{"c": 1, "d": 2}], "z": 0}').when(k % 4 == 2, '{"a": {"b": 1}, "l": []}').otherwise('{"A": 1}')
    rows = table(spark, d, "orders").select(k.alias("doc_id"), expected.alias("schema"), got.alias("tree"))
    e = trees.key_path_arrays(rows, "schema", schema=True).withColumnRenamed("keys", "expected")
    return e.join(trees.key_path_arrays(rows, "tree").withColumnRenamed("keys", "got"), "doc_id")


@query("select o_orderkey as doc_id, 'a a.b l l[].c z' as expected, case o_orderkey % 4 when 0 then 'a a.b l l[].c z' when 1 then 'a a.b l l[].c l[].d z' when 2 then 'a a.b l' else 'A' end as got from orders")
def tree_keytree(spark, d):
    return key_trees(spark, d).select("doc_id", F.array_join("expected", " ").alias("expected"), F.array_join("got", " ").alias("got"))


@query("""select o_orderkey as doc_id, case o_orderkey % 4 when 2 then 'l[].c z' when 3 then 'a a.b l l[].c z' else '' end as missing, case o_orderkey % 4 when 1 then 'l[].d' when 3 then 'A' else '' end as extra,
case o_orderkey % 4 when 2 then 0.6 when 3 then 0.0 else 1.0 end::double as overlap, case o_orderkey % 4 when 0 then 'green' when 1 then 'amber' when 2 then case when o_orderkey % 3 = 0 then 'inconclusive' else 'red' end else 'red' end as verdict from orders""")
def set_keytree(spark, d):
    return reports.key_agreement(key_trees(spark, d), F.col("doc_id") % 3 == 0).select("doc_id", F.array_join("missing", " ").alias("missing"), F.array_join("extra", " ").alias("extra"), "overlap", "verdict")


LOCATED = """with o as (select o_orderkey as doc_id, o_orderkey::varchar as a, lower(o_orderpriority) as b from orders), p as (select *, 4 + 6 as a0 from o),
q as (select *, a0 + length(a) as a1, a0 + length(a) + 6 as b0, a0 + length(a) + 6 + length(b) as b1 from p), r as (select *, b1 + 15 as t0, b1 + 19 as t1, b1 + 25 as c0 from q)
select doc_id, path_str, kind, is_empty, char_start::int as char_start, char_end::int as char_end, least(char_start // 3, n // 3)::int as start, greatest(least(char_end // 3, n // 3), least(char_start // 3 + 1, n // 3 + 1))::int as past from (
select doc_id, 'a' as path_str, 'integer' as kind, false as is_empty, a0 as char_start, a1 as char_end, c0 + length(a) + 3 - 1 as n from r union all select doc_id, 'b', 'string', false, b0, b1, c0 + length(a) + 3 - 1 from r
union all select doc_id, 'n', 'null', true, b1, b1, c0 + length(a) + 3 - 1 from r union all select doc_id, 't', 'boolean', false, t0, t1, c0 + length(a) + 3 - 1 from r union all select doc_id, 'c', 'string', false, c0, c0 + length(a), c0 + length(a) + 3 - 1 from r)"""


@query(LOCATED)
def tree_locate(spark, d):
    """Tokens of three characters; the order's number stands twice, and is found in its turn."""
    return locate.locate_fields(outputs(spark, d)).select("doc_id", "path_str", "kind", "is_empty", "char_start", "char_end", "start", "past")


def outputs(spark, d):
    a, b = F.col("o_orderkey").cast("string"), F.lower("o_orderpriority")
    body = F.concat(F.lit('{"a": '), a, F.lit(',"b":"'), b, F.lit('","n":null,"t":true,"c":"'), a, F.lit('"}'))
    text = F.concat(F.lit("Ok: "), body, F.lit("."))
    parsed = F.concat(F.lit('{"a": '), a, F.lit(', "b": "'), b, F.lit('", "n": null, "t": true, "c": "'), a, F.lit('"}'))
    tokens = F.filter(F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / 3).cast("int")), lambda i: F.substring(text, i * 3 + 1, F.lit(3))), lambda x: x != "")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), parsed.alias("parsed"), body.alias("candidate"), tokens.alias("tokens"))


@query(LOCATED)
def udtf_locations(spark, d):
    return in_sql(spark, "select o.doc_id, l.path_str, l.kind, l.is_empty, l.char_start, l.char_end, l.start, l.past from {outputs} o, lateral tree_locations(o.parsed, o.candidate, o.tokens) l", outputs=outputs(spark, d))
