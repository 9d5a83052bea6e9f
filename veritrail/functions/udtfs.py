"""Table functions for SQL: trees' labels and leaves, and where values lie among tokens, as rows of a lateral call.

    register(spark)
    select p.doc_id, l.* from pairs p, lateral tree_labels(p.schema, p.gold, p.extracted) l
    select * from tree_label_counts(table(pairs) partition by doc_id)
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from veritrail.functions.values import FUZZY_THRESHOLD, NUMBER_TOLERANCE
from veritrail.operators.locate import LOCATION, locate
from veritrail.operators.trees import JSON_TYPES, LABEL, Labeller, leaves, parsed, parsed_schema


KINDS = {"string": StringType(), "int": IntegerType(), "boolean": BooleanType(), "array<string>": ArrayType(StringType())}


def columns(text: str) -> StructType:
    """Names and kinds as a type; made without a session, which where a function is analysed there is none."""
    out = StructType()
    for column in text.split(", "):
        name, kind = column.strip().split(" ")
        out = out.add(name, KINDS[kind])
    return out


def texts_only(*arguments: AnalyzeArgument) -> None:
    """JSON and text come as strings; anything else is an error as the query is planned."""
    wrong = [str(a.dataType) for a in arguments if not isinstance(a.dataType, StringType)]
    if wrong:
        raise ValueError(f"JSON texts are asked for, not {', '.join(wrong)}")


@udtf
class TreeLabels:
    """tree_labels(schema, gold, extracted [, fuzzy_threshold [, number_tolerance]]): a row a field."""

    @staticmethod
    def analyze(schema: AnalyzeArgument, gold: AnalyzeArgument, extracted: AnalyzeArgument, *limits: AnalyzeArgument) -> AnalyzeResult:
        texts_only(schema, gold, extracted)
        if len(limits) > 2 or not all(x.isConstantExpression for x in limits):
            raise ValueError("two constants at most: fuzzy_threshold and number_tolerance")
        return AnalyzeResult(columns(LABEL))

    def __init__(self):
        self.schemas: dict = {}

    def eval(self, schema, gold, extracted, fuzzy_threshold=FUZZY_THRESHOLD, number_tolerance=NUMBER_TOLERANCE):
        if schema not in self.schemas:
            self.schemas = {**self.schemas, schema: parsed(schema)} if len(self.schemas) < 1000 else {schema: parsed(schema)}
        for row in Labeller(float(fuzzy_threshold), float(number_tolerance)).label(self.schemas[schema], parsed(gold), parsed(extracted)):
            yield tuple(row.values())


@udtf
class TreeLabelCounts:
    """tree_label_counts(table(...) partition by ...): fields and errors of each partition's rows (schema, gold, extracted), with the
    first row's doc_id."""

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("a table is asked for")
        names = {f.name: f.dataType for f in rows.dataType}
        missing = {"doc_id", "schema", "gold", "extracted"} - set(names)
        if missing:
            raise ValueError(f"the table lacks {sorted(missing)}")
        return AnalyzeResult(StructType().add("doc_id", names["doc_id"]).add("n_total", LongType()).add("n_errors", LongType()))

    def __init__(self):
        self.doc, self.total, self.errors, self.labeller = None, 0, 0, Labeller()

    def eval(self, row):
        self.doc = row["doc_id"] if self.doc is None else self.doc
        for label in self.labeller.label(parsed_schema(row["schema"]), parsed(row["gold"]), parsed(row["extracted"])):
            self.total += 1
            self.errors += label["is_error"]

    def terminate(self):
        yield self.doc, self.total, self.errors


@udtf
class TreeLeaves:
    """tree_leaves(json): (pos, path_str, kind, value) of every leaf, texts as Python writes the values."""

    @staticmethod
    def analyze(tree: AnalyzeArgument) -> AnalyzeResult:
        texts_only(tree)
        return AnalyzeResult(columns("pos int, path_str string, kind string, value string"))

    def eval(self, tree):
        for pos, (path, value) in enumerate(leaves(parsed(tree)) if tree else ()):
            yield pos, ".".join(map(str, path)), JSON_TYPES[type(value)], None if value is None else str(value)


@udtf
class TreeLocations:
    """tree_locations(parsed, candidate, tokens): where leaves lie among tokens, as locate.locate_fields has it."""

    @staticmethod
    def analyze(tree: AnalyzeArgument, candidate: AnalyzeArgument, tokens: AnalyzeArgument) -> AnalyzeResult:
        texts_only(tree, candidate)
        return AnalyzeResult(columns(LOCATION))

    def eval(self, tree, candidate, tokens):
        if tree is not None:
            for pos, row in enumerate(locate(json.loads(tree), candidate or "", list(tokens or []))):
                yield pos, *row


TABLE_FUNCTIONS = {"tree_labels": TreeLabels, "tree_label_counts": TreeLabelCounts, "tree_leaves": TreeLeaves, "tree_locations": TreeLocations}


def register(spark: SparkSession) -> None:
    """Names for SQL; registering again replaces them."""
    for name, function in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, function)
