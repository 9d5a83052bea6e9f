"""JSON trees as rows: leaves, key paths, and labels from walking gold and extracted trees side by side."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from json.encoder import encode_basestring_ascii

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from veritrail.functions.values import FUZZY_THRESHOLD, NUMBER_TOLERANCE, compare, folded
from veritrail.operators.ranges import spread

#: Schema keys that choose a strategy.
EVALUATION = {
    "string_exact": "exact", "string_case_insensitive": "case_insensitive", "string_fuzzy": "fuzzy", "string_semantic": "fuzzy",
    "integer_exact": "exact", "number_tolerance": "number", "boolean_exact": "exact", "array_llm": "fuzzy",
}
JSON_TYPES = {type(None): "null", bool: "boolean", int: "integer", float: "number", str: "string", list: "array", dict: "object"}
SCALARS = {"string", "number", "integer", "boolean"}
LABEL = "path array<string>, path_str string, is_error int, error_type string, comparison_strategy string, gold_present boolean, extracted_present boolean, gold_value string, extracted_value string"
#: Nesting beyond this is a type mismatch.
DEEPEST = 200


def present(v) -> bool:
    if isinstance(v, str):
        return not (not v or v.isspace())
    return v is not None and not (isinstance(v, (list, dict)) and not v)


def dumped(v) -> str:
    """json.dumps, at once for what most leaves are."""
    if v is None:
        return "null"
    kind = type(v)
    return encode_basestring_ascii(v) if kind is str else str(v) if kind is int else json.dumps(v)


def leaves(tree) -> Iterator[tuple[list, object]]:
    """Scalars in document order with their paths; empty containers give none."""
    stack = [([], tree)]
    while stack:
        path, v = stack.pop()
        if isinstance(v, (dict, list)):
            items = list(v.items() if isinstance(v, dict) else enumerate(v))
            stack.extend((path + [k], x) for k, x in reversed(items))
        else:
            yield path, v


def key_paths(tree) -> set[str]:
    """Dotted paths of every key, list places written as []."""
    out, stack = set(), [("", tree)]
    while stack:
        at, v = stack.pop()
        if isinstance(v, dict):
            for k, x in v.items():
                path = f"{at}.{k}" if at else k
                out.add(path)
                stack.append((path, x))
        elif isinstance(v, list):
            stack.extend((f"{at}[]", x) for x in v)
    return out


def schema_paths(schema) -> set[str]:
    """Key paths that a schema's properties and items imply, written as key_paths writes them."""
    out, stack = set(), [("", schema)]
    while stack:
        at, node = stack.pop()
        for k, sub in (node.get("properties", {}) if isinstance(node, dict) else {}).items():
            path = f"{at}.{k}" if at else k
            out.add(path)
            if isinstance(sub, dict) and sub.get("type") == "object":
                stack.append((path, sub))
            elif isinstance(sub, dict) and sub.get("type") == "array" and isinstance(sub.get("items"), dict) and sub["items"].get("type") == "object":
                stack.append((f"{path}[]", sub["items"]))
    return out


class Labeller:
    """Rows that say, field by field, how an extracted tree departs from gold under a schema. unmatched: paths of gold elements
    that no element of an array matched by membership equals, of the last tree labelled."""

    def __init__(self, fuzzy_threshold: float = FUZZY_THRESHOLD, number_tolerance: float = NUMBER_TOLERANCE):
        self.limits = {"fuzzy_threshold": fuzzy_threshold, "number_tolerance": number_tolerance}
        self.unmatched: list[str] = []

    @staticmethod
    def row(path, gold, extracted, verdict, strategy, has_gold, has_extracted) -> dict:
        keys = [p if type(p) is str else str(p) for p in path]
        return {"path": keys, "path_str": ".".join(keys), "is_error": int(verdict != "match"), "error_type": verdict, "comparison_strategy": strategy, "gold_present": has_gold, "extracted_present": has_extracted, "gold_value": dumped(gold), "extracted_value": dumped(extracted)}

    @staticmethod
    def strategy(schema, default: str) -> str:
        return EVALUATION.get((schema or {}).get("evaluation_config"), default)

    @staticmethod
    def variant(schema, gold):
        """The branch of anyOf for gold's type, else its first."""
        options = (schema or {}).get("anyOf")
        if not options:
            return schema
        return next((o for o in options if o.get("type") == JSON_TYPES[type(gold)]), options[0])

    @staticmethod
    def verdict(has_gold: bool, has_extracted: bool, equal) -> str:
        if has_gold != has_extracted:
            return "omission" if has_gold else "hallucination"
        return "match" if not has_gold or equal() else "value_mismatch"

    def label(self, schema, gold, extracted) -> Iterator[dict]:
        """Children of objects come in the order of their keys, of arrays by place."""
        self.unmatched = []
        stack = [(schema, gold, extracted, [], 0)]
        while stack:
            node, g, e, path, depth = stack.pop()
            node = self.variant(node, g) if node else node
            kinds = {type(g), type(e)}
            if dict not in kinds and list not in kinds and depth <= DEEPEST:
                yield self.leaf(node, g, e, path)  # what most pairs are
                continue
            members = bool(node) and node.get("x-match-mode") == "set_membership"
            if depth > DEEPEST:
                yield self.mismatch(path, g, e)
            elif dict in kinds:
                below = self.objects(node, g, e, path)
                if isinstance(below, dict):
                    yield below
                else:
                    stack.extend((s, a, b, p, depth + 1) for s, a, b, p in reversed(below))
            elif list in kinds:
                one = list(kinds) == [list]
                if members:
                    yield from self.members((node or {}).get("items") or {}, g if isinstance(g, list) else [], e if isinstance(e, list) else [], path)
                elif one or g is None and e or e is None and g:
                    for x in self.arrays(node, g or [], e or [], path):
                        if isinstance(x, dict):
                            yield x
                        else:
                            stack.extend((s, a, b, p, depth + 1) for s, a, b, p in reversed(x))
                else:
                    yield self.mismatch(path, g, e)
            else:
                yield self.leaf(node, g, e, path)

    def mismatch(self, path, g, e) -> dict:
        return self.row(path, g, e, "type_mismatch", "n/a", present(g), present(e))

    def leaf(self, node, g, e, path) -> dict:
        how = self.strategy(node, "auto") if node else "auto"
        has_gold, has_extracted = present(g), present(e)
        if has_gold and has_extracted:
            verdict = "match" if compare(g, e, how, **self.limits) else "value_mismatch"
        else:
            verdict = self.verdict(has_gold, has_extracted, None)
        return self.row(path, g, e, verdict, how, has_gold, has_extracted)

    def objects(self, node, g, e, path):
        """Pairs to go on with, or a row. An empty or missing side takes the other's shape."""
        if isinstance(g, dict) and isinstance(e, dict):
            inner = (node or {}).get("properties", {})
            return [(inner.get(k), g.get(k), e.get(k), [*path, k]) for k in sorted({*g, *e})]
        like = lambda x: {} if isinstance(x, dict) else [] if isinstance(x, list) else None
        if g is None or g == {} and isinstance(g, dict):
            return [(node, like(e), e, path)]
        if e is None or e == {} and isinstance(e, dict):
            return [(node, g, like(g), path)]
        return self.mismatch(path, g, e)

    def arrays(self, node, g: list, e: list, path):
        items = (node or {}).get("items") or {}
        kind = items.get("type")
        first = next((x for x in g + e if x is not None), None)
        if kind == "object" or kind not in SCALARS and isinstance(first, dict):
            at = lambda xs, i: xs[i] if i < len(xs) else None
            yield [(items, at(g, i), at(e, i), [*path, i]) for i in range(max(len(g), len(e)))]
            return
        sets = [{"" if v is None else folded(v) for v in side} for side in (g, e)]
        has = bool(g), bool(e)
        yield self.row(path, g, e, self.verdict(*has, lambda: sets[0] == sets[1]), f"set_{self.strategy(items, 'fuzzy')}", *has)

    def members(self, items, g: list, e: list, path):
        """A row for each extracted element: whether any gold element equals it."""
        how = self.strategy(items, "case_insensitive")
        real = [(n, x) for n, x in enumerate(g) if present(x)]
        met = set()
        for i, x in enumerate(e):
            hit = next(((n, y) for n, y in real if compare(y, x, how, **self.limits)), None) if present(x) else None
            met |= {hit[0]} if hit else set()
            word = "omission" if not present(x) else "match" if hit else "value_mismatch" if real else "hallucination"
            yield self.row([*path, i], hit[1] if hit else None, x, word, f"set_membership_{how}", bool(real), present(x))
        self.unmatched += [".".join(map(str, [*path, f"gold{n}"])) for n, _ in real if n not in met]


def parsed(text):
    try:
        return json.loads(text) if text else None
    except ValueError:
        return None


@lru_cache(1000)
def parsed_schema(text):
    """Schemas repeat, so a worker keeps them; nothing may write to one."""
    return parsed(text)


def walked(pairs: DataFrame, schema, rows, fuzzy_threshold: float, number_tolerance: float) -> DataFrame:
    """Columns of `rows(labeller, schema, gold, extracted)`, a list of tuples, with the doc_id, for every pair. Schemas repeat, so
    each text is parsed once a task."""

    def run(batches):
        labeller, trees = Labeller(fuzzy_threshold, number_tolerance), {}
        for b in batches:
            who, out = [], []
            for i, (text, gold, extracted) in enumerate(zip(*(b.column(c).to_pylist() for c in ("schema", "gold", "extracted")))):
                if text not in trees:
                    trees = {**trees, text: parsed(text)} if len(trees) < 1000 else {text: parsed(text)}
                made = rows(labeller, trees[text], parsed(gold), parsed(extracted))
                who += [i] * len(made)
                out += made
            columns = list(zip(*out)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(who, pa.int64())), *[pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(columns, schema)]], ["doc_id", *schema.names])

    some = spread(pairs.select("doc_id", "schema", "gold", "extracted"))
    whole = some.select("doc_id").schema
    for f in schema:
        whole = whole.add(f)
    return some.mapInArrow(run, whole)


def label_trees(pairs: DataFrame, fuzzy_threshold: float = FUZZY_THRESHOLD, number_tolerance: float = NUMBER_TOLERANCE) -> DataFrame:
    """Labels of pairs(doc_id, schema, gold, extracted), the last three JSON texts; no shuffle. Texts that are no JSON count as null.
    Counts a document come from reports.label_counts, gold elements without an equal from unmatched_gold."""
    schema = StructType.fromDDL(LABEL)
    rows = lambda walker, s, g, e: [tuple(r.values()) for r in walker.label(s, g, e)]
    return walked(pairs, schema, rows, fuzzy_threshold, number_tolerance)


def unmatched_gold(pairs: DataFrame, fuzzy_threshold: float = FUZZY_THRESHOLD, number_tolerance: float = NUMBER_TOLERANCE) -> DataFrame:
    """(doc_id, path_str): gold elements of arrays matched by membership that no extracted element equals."""

    def rows(walker, s, g, e):
        for _ in walker.label(s, g, e):
            pass
        return [(p,) for p in walker.unmatched]

    return walked(pairs, StructType.fromDDL("path_str string"), rows, fuzzy_threshold, number_tolerance)


def tree_leaves(docs: DataFrame, column: str) -> DataFrame:
    """(doc_id, pos, path_str, kind, value) of every leaf of a JSON column; texts as Python writes the values."""

    def run(batches):
        for b in batches:
            who, out = [], []
            for i, text in enumerate(b.column(column).to_pylist()):
                made = [(n, ".".join(map(str, p)), JSON_TYPES[type(v)], None if v is None else str(v)) for n, (p, v) in enumerate(leaves(parsed(text)) if text else ())]
                who += [i] * len(made)
                out += made
            pos, path, kind, value = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(who, pa.int64())), pa.array(pos, pa.int32()), *[pa.array(c, pa.string()) for c in (path, kind, value)]], ["doc_id", "pos", "path_str", "kind", "value"])

    some = spread(docs.select("doc_id", column))
    return some.mapInArrow(run, some.select("doc_id").schema.add("pos", "integer").add("path_str", "string").add("kind", "string").add("value", "string"))


def key_path_arrays(docs: DataFrame, column: str, schema: bool = False) -> DataFrame:
    """(doc_id, keys) of a JSON column's key paths, sorted; of those its schema implies where the column holds schemas."""

    @F.pandas_udf("array<string>")
    def paths(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sorted((schema_paths if schema else key_paths)(parsed(t))))

    return spread(docs.select("doc_id", column)).select("doc_id", paths(column).alias("keys"))
