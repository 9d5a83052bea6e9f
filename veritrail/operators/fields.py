"""Labels, activations, token log-probabilities, texts and caches of fields, filtered and joined.

Fields are rows (doc_id, path_str, ...). Filters stay expressions that reach the scan; joins are equi-joins on the field or
the document, which the planner broadcasts where a side is small by its statistics.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritrail.functions import expressions as X
from veritrail.functions import model_text as T

FIELD = ["doc_id", "path_str"]


def present(labels: DataFrame) -> DataFrame:
    """Fields that were extracted; a null flag counts as true."""
    return labels.where(F.coalesce("extracted_present", F.lit(True)))


def allowed(domain: Column, include: Iterable[str] | None = None, exclude: Iterable[str] | None = None) -> Column:
    """Whether a domain is let through; None is no list. A null domain is not in a list: kept out by include, let through by exclude."""
    out = F.lit(True) if include is None else F.coalesce(domain.isin(*include), F.lit(False))
    return out if exclude is None else out & ~F.coalesce(domain.isin(*exclude), F.lit(False))


def of_documents(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.join(docs.select("doc_id"), "doc_id", "left_semi")


def with_all_layers(fields: DataFrame, activations: DataFrame, layers: list[int]) -> DataFrame:
    """Fields whose activations are there at every layer asked for."""
    some = activations.where(F.col("layer").isin(*layers)).groupBy(*FIELD).agg(F.count_distinct("layer").alias("n")).where(F.col("n") == len(set(layers)))
    return fields.join(some.select(*FIELD), FIELD, "left_semi")


def without_leaves(fields: DataFrame, dropped: DataFrame) -> DataFrame:
    """Fields whose leaf is not listed for their source in dropped(source, leaf)."""
    gone = dropped.select(F.col("source").alias("_source"), F.col("leaf").alias("_leaf"))
    return fields.join(gone, (F.col("source") == F.col("_source")) & (X.leaf_name(F.col("path_str")) == F.col("_leaf")), "left_anti")


def with_logprobs(docs: DataFrame) -> DataFrame:
    """Documents that parsed and have log-probabilities."""
    return docs.where(F.col("parse_error").isNull() & (F.size(F.coalesce("token_logprobs", F.array().cast("array<double>"))) > 0))


def finite(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows with neither null nor NaN in the columns; before any sort, since the JVM puts NaN last."""
    for c in columns:
        rows = rows.where(F.col(c).isNotNull() & ~F.isnan(c))
    return rows


def finite_places(rows: DataFrame, vec: str = "vec") -> DataFrame:
    """rows with vec cut to the places that are never null or NaN in any row; all places if every one is somewhere."""
    bad = F.transform(vec, lambda x: (x.isNull() | F.isnan(x.cast("double"))).cast("int"))
    marks = rows.select(F.posexplode(bad).alias("pos", "bad")).groupBy("pos").agg(F.max("bad").alias("bad")).where("bad = 0")
    good = marks.agg(F.array_sort(F.collect_list("pos")).alias("_good"))  # one place a feature
    return rows.crossJoin(F.broadcast(good)).withColumn(vec, F.when(F.size("_good") == 0, F.col(vec)).otherwise(F.transform("_good", lambda i: F.get(vec, i)))).drop("_good")


def short_gold(labels: DataFrame, longest: int = 60) -> DataFrame:
    return labels.where(F.col("gold_value").isNotNull() & (F.length("gold_value") <= longest))


def candidates(labels: DataFrame, fixable: DataFrame, activations: DataFrame, include_correct: bool = True) -> DataFrame:
    """Extracted fields with an activation; of errors only those in fixable(doc_id, path_str), unless that is empty, which is no
    filter; of right ones all or none."""
    any_fixable = F.broadcast(fixable.limit(1).agg((F.count("*") > 0).alias("_any")))
    marked = present(labels).join(fixable.select(*FIELD).distinct().withColumn("_fix", F.lit(True)), FIELD, "left").crossJoin(any_fixable)
    error = F.col("is_error") == 1
    rows = marked.where(F.when(error, F.col("_fix").isNotNull() | ~F.col("_any")).otherwise(F.lit(include_correct))).drop("_fix", "_any")
    return rows.join(activations.select(*FIELD).distinct(), FIELD, "left_semi")


def flagged(rows: DataFrame, threshold: float = 0.5, score: str = "probe_score") -> DataFrame:
    return rows.where(F.col(score) >= threshold)


def usable_folds(labels: DataFrame) -> DataFrame:
    """(doc_id, n, n_errors) of documents with both classes."""
    return labels.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.col("is_error").cast("long")).alias("n_errors")).where("n_errors between 1 and n - 1")


def silent_failures(labels: DataFrame, longest: int = 30) -> DataFrame:
    """Extracted errors with short values, neither of which holds the other."""
    a, b = X.folded(F.col("gold_value")), X.folded(F.col("extracted_value"))
    short = (F.length("gold_value") <= longest) & (F.length("extracted_value") <= longest)
    return present(labels).where((F.col("is_error") == 1) & short & ~F.contains(a, b) & ~F.contains(b, a))


def extraction_with_gold(extractions: DataFrame, gold: DataFrame, schemas: DataFrame) -> DataFrame:
    """(doc_id, domain, schema, gold, extracted) of parsed extractions with gold; the schema is the domain's, null if it has none."""
    parsed = extractions.where(F.col("parse_error").isNull() & F.col("extracted").isNotNull())
    return parsed.join(gold.select("doc_id", "gold"), "doc_id").join(schemas, "domain", "left").select("doc_id", "domain", "schema", "gold", "extracted")


def with_activations(labels: DataFrame, activations: DataFrame) -> DataFrame:
    """A row for each label and layer; array paths of labels meet no activation, which has their elements' paths."""
    return labels.join(activations.select(*FIELD, "layer", "vec"), FIELD)


def with_span_logprobs(labels: DataFrame, spans: DataFrame, docs: DataFrame) -> DataFrame:
    """labels with mean_logprob and min_logprob over each field's span(start, past) of the document's token_logprobs."""
    rows = labels.join(spans.select(*FIELD, "start", "past"), FIELD).join(docs.select("doc_id", "token_logprobs"), "doc_id")
    return rows.select(*labels.columns, X.span_logprob(F.col("token_logprobs"), F.col("start"), F.col("past")).alias("_s")).select(*labels.columns, "_s.*")


def candidate_scores(labels: DataFrame, scores: DataFrame, spans: DataFrame, docs: DataFrame) -> DataFrame:
    """labels with probe_score, and min_logprob where span and log-probabilities are there, else NaN."""
    rows = labels.join(scores.select(*FIELD, "probe_score"), FIELD).join(spans.select(*FIELD, "start", "past"), FIELD, "left").join(docs.select("doc_id", "token_logprobs"), "doc_id", "left")
    low = X.span_logprob(F.col("token_logprobs"), F.col("start"), F.col("past"))["min_logprob"]
    return rows.select(*labels.columns, "probe_score", F.coalesce(low, F.lit(float("nan"))).alias("min_logprob"))


def split_key(cache: DataFrame, key: str = "key") -> DataFrame:
    """doc_id and path_str of keys "doc::path", split at the first "::"."""
    at = F.instr(F.col(key), "::")
    return cache.withColumn("doc_id", F.substring(F.col(key), F.lit(1), at - 1)).withColumn("path_str", F.substring(F.col(key), at + 2, F.length(key))).where(at > 0).drop(key)


def field_key(doc_id: Column, path: Column) -> Column:
    return F.concat_ws("::", doc_id, path)


def layer_key(path: Column, layer: Column) -> Column:
    return F.concat(path, F.lit("__layer"), layer.cast("string"))


def cached_labels(cache: DataFrame, labels: DataFrame) -> DataFrame:
    """Regenerated values joined with their fields' labels; values of unknown fields are dropped."""
    return split_key(cache).join(labels.drop("new_value"), FIELD)


def with_probe_score(rows: DataFrame, scores: DataFrame, missing: float = 0.0) -> DataFrame:
    return rows.join(scores.select(*FIELD, F.col("probe_score").alias("_p")), FIELD, "left").withColumn("p_err", F.coalesce("_p", F.lit(missing))).drop("_p")


def not_cached(rows: DataFrame, cache: DataFrame) -> DataFrame:
    """What a run that goes on has yet to do."""
    return rows.join(split_key(cache).select(*FIELD), FIELD, "left_anti")


def set_members(fields: DataFrame) -> DataFrame:
    """(doc_id, path_str, idx, value, gold_idx): each element of extracted with the first place of gold that equals it without
    case, null if none does; fields has arrays gold and extracted. Blank elements meet nothing."""
    e = fields.select(*FIELD, F.posexplode("extracted").alias("idx", "value"))
    g = fields.select(*FIELD, F.posexplode("gold").alias("gold_idx", "g")).select(*FIELD, "gold_idx", X.folded(F.col("g")).alias("_k")).where("_k <> ''")
    first = g.groupBy(*FIELD, "_k").agg(F.min("gold_idx").alias("gold_idx"))
    return e.withColumn("_k", X.folded(F.col("value"))).join(first, [*FIELD, "_k"], "left").select(*FIELD, "idx", "value", "gold_idx")


def unmatched_gold(fields: DataFrame) -> DataFrame:
    """(doc_id, path_str, gold_idx, value): gold elements that no extracted element equals, not blank."""
    g = fields.select(*FIELD, F.posexplode("gold").alias("gold_idx", "value")).withColumn("_k", X.folded(F.col("value"))).where("_k <> ''")
    e = fields.select(*FIELD, F.explode("extracted").alias("v")).select(*FIELD, X.folded(F.col("v")).alias("_k")).distinct()
    return g.join(e, [*FIELD, "_k"], "left_anti").drop("_k")


def positions(fields: DataFrame) -> DataFrame:
    """(doc_id, path_str, idx, gold, extracted): two arrays side by side, the shorter one filled up with nulls."""
    return fields.select(*FIELD, F.posexplode(F.arrays_zip("gold", "extracted")).alias("idx", "z")).select(*FIELD, "idx", "z.gold", "z.extracted")


def keys(fields: DataFrame) -> DataFrame:
    """(doc_id, path_str, key, gold, extracted): two maps side by side, over the keys of either."""
    both = F.array_sort(F.array_union(F.map_keys("gold"), F.map_keys("extracted")))
    rows = fields.select(*FIELD, "gold", "extracted", F.explode(both).alias("key"))
    return rows.select(*FIELD, "key", F.col("gold")[F.col("key")].alias("gold"), F.col("extracted")[F.col("key")].alias("extracted"))


def gold_in_texts(fields: DataFrame, texts: dict[str, DataFrame], longest: int = X.LONG_TEXT, entities: bool = True) -> DataFrame:
    """fields (doc_id, ..., gold_value) with present_<name> and method_<name> for each of several texts (doc_id, text) of a document:
    whether gold stands there. Documents without text, and fields without document, say doc_text_unavailable.

    What to look for is worked out once, field by field; a document's fields then meet a text as one row, and an automaton of
    all their needles reads the text once. Texts go nowhere else."""
    row = F.struct(*[F.col(f"`{c}`") for c in fields.columns]).alias("row")
    wanted = fields.select(row, "doc_id", X.needles(F.col("gold_value"), longest, entities).alias("n"))
    met = wanted.where("doc_id is not null").groupBy("doc_id").agg(F.collect_list(F.struct("row", "n")).alias("values"))  # one document's
    for name, some in texts.items():
        some = some.where("text is not null and text <> '' and doc_id is not null").select("doc_id", F.col("text").alias("_text"))
        hits = F.coalesce(X.standing(F.col("_text"), F.transform("values", lambda v: v["n"]["needles"])), F.array().cast("array<int>"))
        met = met.join(some, "doc_id", "left").withColumn(f"hits_{name}", hits).drop("_text")
    hits = [f"hits_{name}" for name in texts]
    met = met.select(F.explode(F.arrays_zip("values", *hits)).alias("x")).select("x.values.row", "x.values.n", *[f"x.{h}" for h in hits])
    out = met.unionByName(wanted.where("doc_id is null").select("row", "n", *[F.lit(None).cast("int").alias(h) for h in hits]))
    found = [c for name in texts for c in ((F.col(f"hits_{name}").isNotNull() & (F.col(f"hits_{name}") >= F.col("n.least"))).alias(f"present_{name}"), F.when(F.col(f"hits_{name}").isNull(), "doc_text_unavailable").otherwise(F.col("n.method")).alias(f"method_{name}"))]
    return out.select(*[F.col(f"row.`{c}`") for c in fields.columns], *found)


def gold_in_text(fields: DataFrame, texts: DataFrame, longest: int = X.LONG_TEXT, entities: bool = True) -> DataFrame:
    """fields (doc_id, ..., gold_value) with present and method, as gold_in_texts has them for one text."""
    return gold_in_texts(fields, {"": texts}, longest, entities).withColumnsRenamed({"present_": "present", "method_": "method"})


def agreement(fields: DataFrame, samples: DataFrame) -> DataFrame:
    """fields (doc_id, path_str, value) with agreement, the share of their document's samples (doc_id, text: what a model wrote) whose
    value at the path is the same, and n_samples; NaN without samples. A sample is plain JSON of an object; others, fenced
    ones too, are none. A sample is parsed once, whatever the number of fields; fields without document have no samples.

    Samples and fields are shuffled as one table and sorted by document, samples first, so that a task holds the samples of one
    document at a time; texts that can't be objects stay behind."""
    texts = samples.where(F.col("doc_id").isNotNull() & T.may_be_object(F.col("text"))).select("doc_id", "text")
    both = fields.where("doc_id is not null").select("doc_id", "path_str", "value").unionByName(texts, allowMissingColumns=True)
    sorted_ = both.repartition("doc_id").sortWithinPartitions("doc_id", F.col("text").isNull())
    rows = sorted_.mapInArrow(T.agreeing, both.drop("text").schema.add("same", "integer").add("of", "integer"))
    lost = fields.where("doc_id is null").select("doc_id", "path_str", "value", F.lit(0).alias("same"), F.lit(0).alias("of"))
    share = F.when(F.col("of") > 0, F.col("same") / F.col("of")).otherwise(F.lit(float("nan")))
    return rows.unionByName(lost).select("doc_id", "path_str", "value", share.alias("agreement"), F.col("of").cast("long").alias("n_samples"))


def last_label(labels: DataFrame, order: str = "pos") -> DataFrame:
    """Of several labels of a field the last one."""
    rest = [c for c in labels.columns if c not in FIELD]
    return labels.groupBy(*FIELD).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*FIELD, "_r.*")


def first_of(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The first row of each key; combined before the shuffle, so that a hot key is none."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def best_of(rows: DataFrame, keys: list[str], score: str, *ties: str) -> DataFrame:
    """The row of the largest score of each key, the first by ties; NaN and null are no scores."""
    some = finite(rows, score).withColumn("_s", -F.col(score).cast("double"))
    return first_of(some, keys, "_s", *ties).drop("_s")


def at_most(rows: DataFrame, keys: list[str], n: int, *order: str) -> DataFrame:
    """The first n rows of each key; the limit goes before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def find_document(docs: DataFrame, part: str | None) -> DataFrame:
    """The first document whose id holds `part`, or the first of all."""
    some = docs if part is None else docs.where(F.contains("doc_id", F.lit(part)))
    return some.orderBy("doc_id").limit(1)


def common_documents(runs: dict[str, DataFrame]) -> DataFrame:
    """doc_ids that are usable folds in every run of labels."""
    out = None
    for labels in runs.values():
        ids = usable_folds(labels).select("doc_id")
        out = ids if out is None else out.intersect(ids)
    return out


def lost_documents(runs: dict[str, DataFrame]) -> DataFrame:
    """(run, doc_id): usable folds of each run that others lack."""
    shared, out = common_documents(runs), None
    for name, labels in runs.items():
        gone = usable_folds(labels).select(F.lit(name).alias("run"), "doc_id").join(shared, "doc_id", "left_anti").select("run", "doc_id")
        out = gone if out is None else out.unionByName(gone)
    return out


def pooled(sources: dict[str, DataFrame], dropped: DataFrame, allow: DataFrame | None = None) -> DataFrame:
    """Labels of several sources as one table, without the leaves dropped for their source, of allowed documents."""
    out = None
    for name, labels in sources.items():
        rows = labels.withColumn("source", F.lit(name))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    out = without_leaves(out, dropped)
    return out if allow is None else of_documents(out, allow)
