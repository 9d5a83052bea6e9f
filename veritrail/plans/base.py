"""What queries are made of: the register, and the driver's tables in the parts that operators need, in Spark and in SQL.

Labels stand on events, activations and log-probabilities on embeddings, gold values and texts on documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_made: dict = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        _made[f.__name__.rstrip("_")] = f
        if sql:
            _sql[f.__name__.rstrip("_")] = sql
        return f

    return keep


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark, sf_dir: str) -> DataFrame:
    """Events as scored fields: an error's score is its value."""
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.col("value").alias("score"), (F.col("event_type") == "error").cast("int").alias("y"), (F.col("event_type") == "click").cast("int").alias("still"))


EVENTS = "e as (select event_id, user_id, value as score, (event_type = 'error')::int as y, (event_type = 'click')::int as still from events)"


def rounded(df: DataFrame, *cols: str, digits: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


def as_double(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in cols})


def labels(spark, d: str) -> DataFrame:
    """Events as labels of fields: k of their props decides what went wrong."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.when(k % 10 < 5, "match").when(k % 10 < 7, "value_mismatch").when(k % 10 == 7, "omission").when(k % 10 == 8, "hallucination").otherwise("type_mismatch")
    e = table(spark, d, "events").select(F.concat(F.lit("u"), "user_id").alias("doc_id"), F.when(F.col("user_id") % 4 < 3, F.concat(F.lit("d"), F.col("user_id") % 4)).alias("domain"), F.col("event_id").alias("pos"), F.concat("event_type", F.lit("."), "event_id", F.lit(".f"), k % 7).alias("path_str"), k.alias("k"), kind.alias("error_type"), F.col("value").alias("score"))
    gold = F.when(F.col("error_type") == "hallucination", None).otherwise(F.concat(F.lit("value "), "k"))
    got = F.when(F.col("error_type") == "match", F.concat(F.lit("value "), "k")).when(F.col("error_type") == "omission", None).otherwise(F.concat(F.lit("other "), F.col("k") + 1))
    return e.select("doc_id", "domain", "pos", "path_str", (F.col("error_type") != "match").cast("int").alias("is_error"), "error_type", F.when(F.col("k") % 11 != 0, F.col("error_type") != "omission").alias("extracted_present"), gold.alias("gold_value"), got.alias("extracted_value"), "score", "k")


LABELS = """kk as (select *, (props ->> '$.k')::int as k from events),
le as (select 'u' || user_id as doc_id, case when user_id % 4 < 3 then 'd' || (user_id % 4) end as domain, event_id as pos, event_type || '.' || event_id || '.f' || (k % 7) as path_str, k, value as score,
  case when k % 10 < 5 then 'match' when k % 10 < 7 then 'value_mismatch' when k % 10 = 7 then 'omission' when k % 10 = 8 then 'hallucination' else 'type_mismatch' end as error_type from kk),
lab as (select doc_id, domain, pos, path_str, (error_type <> 'match')::int as is_error, error_type, case when k % 11 <> 0 then error_type <> 'omission' end as extracted_present,
  case when error_type <> 'hallucination' then 'value ' || k end as gold_value, case error_type when 'match' then 'value ' || k when 'omission' then null else 'other ' || (k + 1) end as extracted_value, score, k from le)"""


def vector_labels(spark, d: str) -> DataFrame:
    """Embeddings as fields of twenty documents."""
    v = F.col("vec_id")
    return table(spark, d, "embeddings").select(F.concat(F.lit("u"), v % 20).alias("doc_id"), F.concat(F.lit("p."), v).alias("path_str"), (F.col("label") == 1).cast("int").alias("is_error"), (v % 7 != 0).alias("extracted_present"), v.alias("pos"))


def activations(spark, d: str) -> DataFrame:
    """Halves of embeddings as layers 1 and 2; every eleventh field lacks the second."""
    v = F.col("vec_id")
    layers = F.array(*[F.struct(F.lit(i + 1).alias("layer"), F.slice("embedding", 1 + 32 * i, 32).alias("vec")) for i in range(2)])
    rows = table(spark, d, "embeddings").select(F.concat(F.lit("u"), v % 20).alias("doc_id"), F.concat(F.lit("p."), v).alias("path_str"), v.alias("pos"), F.explode(layers).alias("x"))
    return rows.select("doc_id", "path_str", "pos", "x.layer", "x.vec").where("layer = 1 or pos % 11 <> 0")


VECTORS = """vlab as (select 'u' || (vec_id % 20) as doc_id, 'p.' || vec_id as path_str, (label = 1)::int as is_error, vec_id % 7 <> 0 as extracted_present, vec_id as pos from embeddings),
act as (select 'u' || (vec_id % 20) as doc_id, 'p.' || vec_id as path_str, vec_id as pos, layer::int as layer, embedding[1 + 32 * (layer - 1) : 32 * layer] as vec from embeddings, range(1, 3) l(layer) where layer = 1 or vec_id % 11 <> 0)"""


def logprob_documents(spark, d: str) -> DataFrame:
    """Embeddings as the log-probabilities of documents' tokens."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.transform("embedding", lambda x: -F.abs(x.cast("double"))).alias("token_logprobs"))


def logprob_spans(spark, d: str) -> DataFrame:
    """Four fields a document, some beyond its tokens and some empty."""
    v, j = F.col("doc_id"), F.col("j")
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("j"))
    start = (7 * v + 13 * j) % 70 - 3
    return rows.select("doc_id", F.concat(F.lit("p"), "j").alias("path_str"), start.alias("start"), (start + (v + j) % 9).alias("past"), ((v + j) % 3 == 0).cast("int").alias("is_error"))


SPANS = """ldoc as (select vec_id as doc_id, list_transform(embedding, lambda x: -abs(x::double)) as token_logprobs from embeddings),
lspan as (select vec_id as doc_id, 'p' || j as path_str, (7 * vec_id + 13 * j) % 70 - 3 as start, (7 * vec_id + 13 * j) % 70 - 3 + (vec_id + j) % 9 as past, ((vec_id + j) % 3 = 0)::int as is_error from embeddings, range(0, 4) r(j)),
lcut as (select *, greatest(0, least(start, len(token_logprobs))) as lo, greatest(greatest(0, least(start, len(token_logprobs))), least(past, len(token_logprobs))) as hi from lspan join ldoc using (doc_id)),
lscore as (select doc_id, path_str, is_error, case when hi > lo then list_avg(token_logprobs[lo + 1 : hi]) else 'nan'::double end as mean_logprob, case when hi > lo then list_min(token_logprobs[lo + 1 : hi]) else 'nan'::double end as min_logprob from lcut)"""


def gold_values(spark, d: str) -> DataFrame:
    """Five fields a document: a piece of its text, a number, a long passage, nothing, and what is not there."""
    i, j = F.col("doc_id"), F.col("j")
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "n_chars", (i % 40).alias("item_id"))
    rows = docs.join(F.broadcast(table(spark, d, "benchmark").select("item_id", F.substring("text", 1, 200).alias("passage"))), "item_id", "left").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(4))))
    gold = F.when(j == 0, F.substring("text", 1, 20)).when(j == 1, F.col("n_chars").cast("string")).when(j == 2, F.col("passage")).when((j == 3) & (i % 2 == 0), None).when(j == 3, "  ").otherwise("zzz qqq")
    return rows.select("doc_id", F.col("lang").alias("domain"), F.concat(F.lit("p"), "j").alias("path_str"), gold.alias("gold_value"), F.when(i % 3 == 0, F.concat(gold, F.lit("."))).otherwise(F.concat(F.lit("x"), j)).alias("extracted_value"), ((i + j) % 2).cast("int").alias("is_error"))


#: How a parser that writes markup spells these; the ampersand first.
ENTITIES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")]


def texts(spark, d: str) -> DataFrame:
    """Whole documents as a parser writes them that spells marks as entities; every thirteenth has no text."""
    text = F.col("text")
    for mark, entity in ENTITIES:
        text = F.replace(text, F.lit(mark), F.lit(entity))
    return table(spark, d, "documents").where("doc_id % 13 <> 0").select("doc_id", text.alias("text"))


def entities_sql(c: str, decode: bool) -> str:
    """c with its marks spelt as entities, or with these decoded."""
    for mark, entity in reversed(ENTITIES) if decode else ENTITIES:
        a, b = (x.replace("'", "''") for x in ((entity, mark) if decode else (mark, entity)))
        c = f"replace({c}, '{a}', '{b}')"
    return c


def norm_sql(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(translate(regexp_replace(lower({c}), '\u00ad\\s*', '', 'g'), '‐‑‒–—―−', '-------'), '[,$]', '', 'g'), '\\s+', ' ', 'g'))"


NUMERAL = "'[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?'"
GOLD = f"""gv as (select doc_id, lang as domain, 'p' || j as path_str, case j when 0 then substr(d.text, 1, 20) when 1 then n_chars::varchar when 2 then substr(b.text, 1, 200) when 3 then case when doc_id % 2 = 0 then null else '  ' end else 'zzz qqq' end as gold_value, j, (doc_id + j) % 2 as is_error
  from documents d left join benchmark b on b.item_id = d.doc_id % 40, range(0, 5) r(j)),
gl as (select * exclude (j), case when doc_id % 3 = 0 then gold_value || '.' else 'x' || j end as extracted_value from gv),
pt as (select doc_id, {entities_sql("text", False)} as text from documents where doc_id % 13 <> 0 and text is not null and text <> ''),
tx as (select doc_id, {norm_sql(entities_sql("text", True))} as t from pt),
gn as (select gl.*, t, trim(gold_value) as raw, {norm_sql(entities_sql("gold_value", True))} as v from gl left join tx using (doc_id)),
gw as (select *, list_filter(string_split(v, ' '), lambda w: length(w) > 4) as words from gn),
gm as (select *, case when t is null then 'doc_text_unavailable' when raw is null or raw = '' then 'empty_gold' when length(raw) > 80 then case when len(words) = 0 then 'too_long_unchecked' else 'too_long_wordmatch' end
  when v = '' then 'empty_gold' when regexp_full_match(v, {NUMERAL}) then 'numeric' else 'normalized_substr' end as method from gw),
gf as (select doc_id, domain, path_str, gold_value, extracted_value, is_error, method, coalesce(case method when 'too_long_wordmatch' then len(list_filter(words, lambda w: contains(t, w))) >= 0.6 * len(words)
  when 'numeric' then contains(t, v) or contains(t, (v::double)::varchar) or (v::double = floor(v::double) and contains(t, v::double::bigint::varchar)) when 'normalized_substr' then contains(t, v) else false end, false) as present from gm)"""


def weights(spark) -> DataFrame:
    """A fixed probe for each layer: places in turn speak for and against an error."""
    return spark.createDataFrame([(i, [(1.0 if j % 2 else -1.0) * (1 + j % 3) for j in range(32)], 0.25 * i) for i in (1, 2)], "layer int, beta array<double>, bias double")


PROBE = """pw as (select layer::int as layer, list_transform(range(0, 32), lambda j: (case when j % 2 = 1 then 1.0 else -1.0 end) * (1 + j % 3)::double) as beta, 0.25 * layer as bias from range(1, 3) l(layer)),
ps as (select a.doc_id, a.path_str, a.pos, a.layer, 1 / (1 + exp(-(list_sum(list_transform(list_zip(a.vec, pw.beta), lambda z: z[1]::double * z[2])) + pw.bias))) as p from act a join pw on a.layer = pw.layer)"""


def queries() -> dict:
    return dict(_made)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
