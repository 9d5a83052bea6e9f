"""Where models come in. The library has none: a caller gives a factory, which is called once a task on an executor, and what it
makes is asked for texts or vectors, a batch of rows at a time. The stubs here are deterministic and stand in for tests."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from veritrail.functions.model_text import parse_output
from veritrail.operators.locate import locate
from veritrail.operators.probes import scored
from veritrail.operators.ranges import spread

OUTPUT = "text string, tokens array<string>, token_logprobs array<double>, finish_reason string"


class Generator(Protocol):
    """Answers prompts (system, user): for each its text, its tokens, their log-probabilities, and stop or length."""

    def generate(self, prompts: list[tuple[str, str]]) -> Iterable[tuple[str, list[str], list[float], str]]: ...


class Embedder(Protocol):
    """Vectors of values as the model would hold them at a layer, were they its answer for a field of a document."""

    def embed(self, rows: list[tuple[str, str, str]], layer: int) -> Iterable[list[float]]: ...


class StubGenerator:
    """Reads "name: value" lines of the prompt into an object; a token is a character, less likely the later it comes."""

    def __init__(self, most: int = 10_000):
        self.most = most

    def generate(self, prompts):
        for _, user in prompts:
            text = json.dumps(dict(re.findall(r"(?m)^(\w+): (.*)$", user)))
            cut = text[: self.most]
            yield cut, list(cut), [-1 / (n + 1) for n in range(len(cut))][::-1], "length" if len(text) > self.most else "stop"


class StubEmbedder:
    """Characters of the value, digits in it, and the layer."""

    def embed(self, rows, layer):
        for _, _, value in rows:
            yield [float(len(value or "")), float(sum(c.isdigit() for c in value or "")), float(layer)]


class StateGenerator(Protocol):
    """As Generator, asked for layers too: also gives, for each layer, the hidden vector of every step, step 0 being the prompt's
    own pass. The last steps may be missing."""

    def generate(self, prompts: list[tuple[str, str]], layers: list[int]) -> Iterable[tuple[str, list[str], list[float], str, dict[int, Sequence]]]: ...


class StubStates:
    """As StubGenerator; a step's vector is the layer, the step from 0 on and the token's code, and a layer n lacks the last
    2 * (n - 1) steps."""

    def __init__(self, most: int = 10_000):
        self.answers = StubGenerator(most)

    def generate(self, prompts, layers):
        for text, tokens, logprobs, finish in self.answers.generate(prompts):
            steps = [(-1, 0), *enumerate(map(ord, tokens))]
            yield text, tokens, logprobs, finish, {n: [[float(n), float(i), float(c)] for i, c in steps[: max(0, len(steps) - 2 * (n - 1))]] for n in layers}


def generated(prompts: DataFrame, factory: Callable[[], Generator], batch: int = 16) -> DataFrame:
    """prompts (system, user, ...) with OUTPUT in place of the prompt. A null prompt has no answer; other columns are kept."""
    rest = [c for c in prompts.columns if c not in ("system", "user")]
    names = [c.split()[0] for c in OUTPUT.split(", ")]

    def run(frames):
        model = factory()
        for f in frames:
            out: list[tuple] = [(None, None, None, None)] * len(f)
            asked = [i for i, u in enumerate(f["user"]) if u is not None]
            for s in range(0, len(asked), batch):
                some = asked[s : s + batch]
                for i, answer in zip(some, model.generate([(f["system"].iloc[i], f["user"].iloc[i]) for i in some])):
                    out[i] = answer
            yield pd.concat([f[rest].reset_index(drop=True), pd.DataFrame(out, columns=names)], axis=1)

    schema = prompts.select(*rest).schema
    whole = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in schema], OUTPUT])
    return spread(prompts.select("system", "user", *rest)).mapInPandas(run, whole)


EXTRACTED = """text string, finish_reason string, generated_tokens int, token_logprobs array<double>, parsed_json string, parse_error string,
 fields array<struct<pos: int, path_str: string, kind: string, value: string, is_empty: boolean, start: int, past: int, states: array<struct<layer: int, tokens: array<array<float>>>>>>"""
POSITIONS = ("last", "mean", "all")


def span_states(vectors: np.ndarray, start: int, past: int, generated: int, position: str) -> list | None:
    """Of a layer's vectors by generated token those of a span, cut to the tokens there are: all, the last or their mean; None if
    the layer has none of them."""
    low = max(0, min(start, generated - 1))
    high = max(low + 1, min(past, generated))
    low, high = min(low, len(vectors) - 1), min(high, len(vectors))
    if low < 0 or high <= low:
        return None
    span = vectors[low:high]
    return (span if position == "all" else span[-1:] if position == "last" else span.mean(0, keepdims=True)).tolist()


def extracted(prompts: DataFrame, factory: Callable[[], StateGenerator], layers: list[int], position: str = "last", batch: int = 4) -> DataFrame:
    """prompts (system, user, ...) with EXTRACTED in place of the prompt: what the model wrote, the object read from it, and every
    leaf of it with its span of tokens and, by layer, the hidden states there, reduced to `position`.

    The step of the prompt is skipped and states are cut to what was generated. Texts, tokens and whole states live only
    within a batch of prompts on the executor that asked the model; reduced vectors leave it, and only prompts are
    shuffled, to be dealt evenly. A null prompt is a document without text (finish_reason error); an answer that is no JSON has no fields, and
    a leaf without states in any layer is left out. Write the result before using it twice: each use asks the model.
    """
    if position not in POSITIONS:
        raise ValueError(position)
    rest = [c for c in prompts.columns if c not in ("system", "user")]
    kinds = StructType.fromDDL(EXTRACTED)

    def answer(text, tokens, logprobs, finish, states):
        tree, error, candidate = parse_output(text)
        done, n = [], len(tokens)
        by_layer = {k: np.asarray(v, np.float32)[1 : 1 + n] for k, v in states.items()}
        for pos, (path, kind, value, empty, start, past, _, _) in enumerate(locate(tree, candidate, tokens) if error is None else ()):
            found = [(k, span_states(v, start, past, n, position)) for k, v in sorted(by_layer.items()) if len(v)]
            found = [{"layer": k, "tokens": v} for k, v in found if v]
            if found:
                done.append(dict(zip(("pos", "path_str", "kind", "value", "is_empty", "start", "past", "states"), (pos, path, kind, value, empty, start, past, found))))
        return text, finish, n, list(logprobs), None if error else json.dumps(tree, ensure_ascii=False), error, done

    def run(batches):
        model, schema = factory(), to_arrow_schema(kinds)
        for b in batches:
            system, user = b.column("system").to_pylist(), b.column("user").to_pylist()
            asked = [i for i, u in enumerate(user) if u is not None]
            out = [(None, "error", 0, None, None, "document has no text", [])] * len(user)
            for s in range(0, len(asked), batch):
                some = asked[s : s + batch]
                for i, made in zip(some, model.generate([(system[i], user[i]) for i in some], layers)):
                    out[i] = answer(*made)
            columns = [pa.array(c, f.type) for c, f in zip(zip(*out), schema)] if out else [pa.array([], f.type) for f in schema]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in rest], *columns], [*rest, *schema.names])

    whole = prompts.select(*rest).schema
    for f in kinds:
        whole = whole.add(f)
    return spread(prompts.select("system", "user", *rest)).mapInArrow(run, whole)


def activation_rows(documents: DataFrame, position: str = "last") -> DataFrame:
    """(doc_id, pos, path_str, value, is_empty, layer, vec) of extracted documents; with all positions tokens instead of vec."""
    each = documents.select("doc_id", F.explode("fields").alias("f")).select("doc_id", "f.*").withColumn("s", F.explode("states"))
    vec = F.col("s.tokens").alias("tokens") if position == "all" else F.col("s.tokens")[0].alias("vec")
    return each.select("doc_id", "pos", "path_str", "value", "is_empty", "start", "past", "s.layer", vec)


def reembedded(candidates: DataFrame, factory: Callable[[], Embedder], weights: DataFrame, layer: int) -> DataFrame:
    """candidates (doc_id, path_str, value, ...) with p: the probe's score of each value's own vector. What the model can't embed (it
    yields None) has no score."""
    rest = list(candidates.columns)

    def run(frames):
        model = factory()
        for f in frames:
            vectors = list(model.embed(list(f[["doc_id", "path_str", "value"]].itertuples(index=False, name=None)), layer))
            yield f.assign(layer=layer, vec=vectors)

    whole = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in candidates.schema], "layer int, vec array<double>"])
    return scored(spread(candidates).mapInPandas(run, whole), weights.select("layer", "beta", "bias"), ["layer"]).select(*rest, "p")
