"""What models write, read: JSON in prose, values at paths of JSON trees and of their schemas, prompts to ask for them.

Python functions over one text or tree, and vectorised functions over columns of them.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from veritrail.functions.values import compare

_thinking = re.compile(r"(?s)<think>.*?</think>")
_fenced = re.compile(r"(?is)```(?:json)?\s*(\{.*?\})\s*```")
_mark = re.compile(r'(?s)\\.|["{}]')


def balanced(text: str, start: int) -> str | None:
    """From the brace at start to the one that closes it; braces in strings and what follows a backslash don't count."""
    depth, quoted = 0, False
    for m in _mark.finditer(text, start):
        mark = m[0]
        if mark == '"':
            quoted = not quoted
        elif not quoted and mark in "{}":
            depth += 1 if mark == "{" else -1
            if not depth:
                return text[start : m.end()]
    return None


def strip_to_json(text: str) -> str:
    """The object in a text: after any thinking, in a code fence, or the first whose braces balance; else the text, trimmed."""
    text = _thinking.sub("", text.strip()).strip()
    fence, brace = _fenced.search(text), text.find("{")
    return fence[1].strip() if fence else (balanced(text, brace) if brace >= 0 else None) or text


# Why there is no tree.
NO_TEXT, NO_JSON = "model produced no text (None)", "no JSON content found in output"


def parse_output(text: str | None) -> tuple[object, str | None, str]:
    """(tree, error, candidate): error says why there is no tree."""
    if text is None:
        return None, NO_TEXT, ""
    candidate = strip_to_json(text)
    if not candidate.strip():
        return None, NO_JSON, candidate
    try:
        return json.loads(candidate), None, candidate
    except ValueError as e:
        return None, f"{type(e).__name__}: {e}", candidate


def parse_value(raw: str):
    """A value that a model was asked for: JSON, also between back-ticks; else, and for null, the text itself."""
    for text in (raw, raw.strip("`").strip()):
        try:
            if (value := json.loads(text)) is not None:
                return value
        except ValueError:
            pass
    return raw


def path_segments(path: str) -> list[str | int]:
    return [int(s) if re.fullmatch(r"-?\d+", s) else s for s in path.split(".")]


@lru_cache(1 << 12)
def path_steps(path: str) -> tuple[tuple[str, bool], ...]:
    """Steps of a dotted path, and whether each may be a place of a list."""
    return tuple((s, bool(re.fullmatch(r"-?\d+", s))) for s in path.split("."))


def at_path(tree, path: str):
    """The value at a dotted path; null where a step leads nowhere. Places of a list may count from its end."""
    for step, place in path_steps(path):
        if isinstance(tree, dict):
            tree = tree.get(step)
        elif isinstance(tree, list) and place and -len(tree) <= int(step) < len(tree):
            tree = tree[int(step)]
        else:
            return None
    return tree


def parent_of(tree, path: str) -> dict:
    """What holds the leaf of a path: parent (None where a step leads nowhere), key, and of the last list on the way its name,
    the place taken in it and its length."""
    steps = path_segments(path)
    out = {"parent": None, "key": str(steps[-1]), "list_name": None, "index": None, "length": None}
    for n, step in enumerate(steps[:-1]):
        if isinstance(tree, list):
            if not isinstance(step, int):
                return out
            out |= {"list_name": str(steps[n - 1]) if n else "(list)", "index": step, "length": len(tree)}
            if not 0 <= step < len(tree):
                return out
            tree = tree[step]
        elif isinstance(tree, dict):
            tree = tree.get(str(step), {})
        else:
            return out
    return out | {"parent": tree}


def resolved(node, root):
    """What a chain of $ref comes to; a circle comes to nothing."""
    met = set()
    while isinstance(node, dict) and isinstance(ref := node.get("$ref"), str):
        if ref in met:
            return {}
        met.add(ref)
        node = root
        for name in ref.removeprefix("#").strip("/").split("/"):
            node = node.get(name, {}) if isinstance(node, dict) else {}
    return node if isinstance(node, dict) else {}


def schema_at(schema: dict, path: str) -> dict:
    """The schema's node for a path of the data: digits go to items, other steps to a property, of the items if need be; of
    anyOf the first variant that is not null. {} where a step leads nowhere."""
    node = resolved(schema, schema)
    for step in path.split("."):
        items = resolved(node.get("items"), schema)
        if step.isdigit():
            node = items
        else:
            own = node.get("properties", {})
            node = resolved(own[step] if step in own else items.get("properties", {}).get(step), schema)
    kinds = [v for v in node.get("anyOf", ()) if v.get("type") != "null"]
    return resolved(kinds[0], schema) if kinds else node


# Prompts: (system, user) with slots; a caller may give others.
EXTRACT = (
    "You read documents and return what they say as one JSON object. Use null for what is not in the document. Return the object alone.",
    "{schema_part}# Document\n\n{document}\n\n# JSON object\n",
)
TARGETED = (
    "You read a document and return the value of one field, as JSON. Return null if the document does not say it. Return the value alone.",
    "# Field\n{path}\nType: {type}\n{notes}\n\n# Document\n\n{document}\n\n# Value\n",
)
CORRECT = (
    "You are given a document and a record from it with one field left blank. Return that field's value as JSON, null if the document does not say it, and nothing else.",
    "# Record\n{record}\n{place}\n# Blank field\n{key}\nType: {type}\n{notes}\n\n# Document\n\n{document}\n\n{rule}# Value\n",
)
VERIFY = (
    "You check a value that was read from a document. Answer with one word: True if the document bears it out, else False.",
    "# Field\n{path}: {notes}\n\n# Value\n{value}\n\n# Document\n\n{document}\n\n# True or False\n",
)
# Characters of a record, and of a document, that go into a prompt; what marks the blank.
MOST_RECORD, MOST_DOCUMENT, BLANK = 1500, 600_000, "<FILL_THIS>"


def schema_notes(node: dict) -> str:
    """What a schema's node says of a field, a line each."""
    words = {"description": "Description", "evaluation_config": "Matching", "enum": "Allowed values", "format": "Format"}
    lines = [f"{word}: {json.dumps(node[k], ensure_ascii=False) if k == 'enum' else node[k]}" for k, word in words.items() if node.get(k)]
    return "\n".join(lines) or "Description: (none in schema)"


def extraction_prompt(document: str, schema: dict | None = None, templates: tuple[str, str] = EXTRACT) -> tuple[str, str]:
    part = f"# Schema\n{json.dumps(schema, ensure_ascii=False, indent=2)}\n\n" if schema is not None else ""
    return templates[0], templates[1].format(schema_part=part, document=document)


def targeted_prompt(document: str, schema: dict, path: str, templates: tuple[str, str] = TARGETED) -> tuple[str, str]:
    node = schema_at(schema, path)
    return templates[0], templates[1].format(path=path, type=node.get("type", "(unspecified)"), notes=schema_notes(node), document=document[:MOST_DOCUMENT])


def verification_prompt(document: str, schema: dict, path: str, value, templates: tuple[str, str] = VERIFY) -> tuple[str, str]:
    return templates[0], templates[1].format(path=path, notes=schema_at(schema, path).get("description", ""), value=value, document=document)


def correction_prompt(document: str, tree, schema: dict, path: str, templates: tuple[str, str] = CORRECT) -> tuple[str, str]:
    """Asks for one field with the rest of its record at hand; in a list, says which item the record is."""
    at, node = parent_of(tree, path), schema_at(schema, path)
    record = {**(at["parent"] if isinstance(at["parent"], dict) else {}), at["key"]: BLANK}
    place = rule = ""
    if at["list_name"] is not None:
        of = f" of {at['length']}" if at["length"] else ""
        place = f"\nThe record is item {at['index'] + 1}{of} of the list {at['list_name']}.\n"
        rule = f"Return one {node.get('type', 'value')} for that item only.\n\n"
    text = json.dumps(record, ensure_ascii=False, indent=2)[:MOST_RECORD]
    return templates[0], templates[1].format(record=text, place=place, key=at["key"], type=node.get("type", "(unspecified)"), notes=schema_notes(node), document=document[:MOST_DOCUMENT], rule=rule)


def texts(*names: str) -> StructType:
    out = StructType()
    for name in names:
        out = out.add(name, StringType())
    return out


def _dumped(x) -> str | None:
    return None if x is None else json.dumps(x, ensure_ascii=False)


@F.pandas_udf(texts("parsed", "error", "candidate"))
def parsed_output(text: pd.Series) -> pd.DataFrame:
    rows = [parse_output(t) for t in text]
    return pd.DataFrame({"parsed": [_dumped(t) if e is None else None for t, e, _ in rows], "error": [e for _, e, _ in rows], "candidate": [c for _, _, c in rows]})


@F.pandas_udf(StringType())
def parsed_value(raw: pd.Series) -> pd.Series:
    """JSON of the value in an answer."""
    return raw.map(lambda t: None if t is None else json.dumps(parse_value(t), ensure_ascii=False))


@F.pandas_udf(StringType())
def value_at(tree: pd.Series, path: pd.Series) -> pd.Series:
    """JSON of the value at a path of a JSON text; none where there is none, or the text is no JSON."""

    def get(t, p):
        try:
            return _dumped(at_path(json.loads(t), p))
        except (TypeError, ValueError):
            return None

    return pd.Series([None if p is None else get(t, p) for t, p in zip(tree, path)], dtype="object")


@F.pandas_udf(texts("parent", "key", "list_name").add("index", IntegerType()).add("length", IntegerType()))
def parent_at(tree: pd.Series, path: pd.Series) -> pd.DataFrame:
    rows = [parent_of(json.loads(t), p) for t, p in zip(tree, path)]
    out = pd.DataFrame([{**r, "parent": _dumped(r["parent"])} for r in rows], columns=["parent", "key", "list_name", "index", "length"])
    return out.astype({"index": "Int32", "length": "Int32"})


@F.pandas_udf(StringType())
def schema_node(schema: pd.Series, path: pd.Series) -> pd.Series:
    """JSON of the schema's node for a path. Schemas repeat, so each text is parsed once a batch."""
    trees = {t: json.loads(t) for t in schema.dropna().unique()}
    return pd.Series([None if t is None or p is None else json.dumps(schema_at(trees[t], p), ensure_ascii=False) for t, p in zip(schema, path)], dtype="object")


def may_be_object(text: Column) -> Column:
    """False for texts that are no plain JSON of an object: something printable stands before the first brace or after the last."""
    return text.rlike(r"^[^!-~]*\{") & text.rlike(r"\}[^!-~]*$")


def objects(column: pa.Array) -> list:
    """Python values of a column; texts by way of numpy, which is several times as fast."""
    return column.to_numpy(zero_copy_only=False).tolist() if pa.types.is_string(column.type) else column.to_pylist()


def agreeing(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """Fields (doc_id, path_str, value) with same and of: in how many of their document's samples that are objects the path has the
    same value, and of how many. Rows come by document, its samples (text) before its fields (null text)."""
    verdicts: dict = {}

    def same(value, other) -> bool:
        if type(other) is not str:
            return compare(value, other, "auto", number_tolerance=0.0)
        verdict = verdicts.get(pair := (value, other))
        if verdict is None:  # texts repeat, and may be dates
            if len(verdicts) > 100_000:
                verdicts.clear()
            verdict = verdicts[pair] = compare(value, other, "auto", number_tolerance=0.0)
        return verdict

    doc, trees = None, []
    for b in batches:
        alike, of = [], []
        for d, path, value, text in zip(*(objects(b.column(c)) for c in ("doc_id", "path_str", "value", "text"))):
            if d != doc:
                doc, trees = d, []
            if text is None:
                n = 0
                for t in trees:
                    n += same(value, at_path(t, path))
                alike.append(n)
                of.append(len(trees))
                continue
            try:
                tree = json.loads(text.strip())
            except ValueError:
                continue
            if isinstance(tree, dict):
                trees.append(tree)
        asked = b.filter(b.column("text").is_null()).select(["doc_id", "path_str", "value"])
        yield asked.append_column("same", pa.array(alike, pa.int32())).append_column("of", pa.array(of, pa.int32()))


@F.pandas_udf(texts("system", "user"))
def correction_prompts(document: pd.Series, tree: pd.Series, schema: pd.Series, path: pd.Series) -> pd.DataFrame:
    schemas = {t: json.loads(t) for t in schema.unique()}
    return pd.DataFrame([correction_prompt(d, json.loads(t), schemas[s], p) for d, t, s, p in zip(document, tree, schema, path)], columns=["system", "user"])


@F.pandas_udf(texts("system", "user"))
def extraction_prompts(document: pd.Series, schema: pd.Series) -> pd.DataFrame:
    """Prompts for whole documents; a null schema is left out of the prompt."""
    schemas = {t: None if t is None else json.loads(t) for t in schema.unique()}
    return pd.DataFrame([extraction_prompt(d, schemas[s]) for d, s in zip(document, schema)], columns=["system", "user"])


@F.pandas_udf(texts("system", "user"))
def targeted_prompts(document: pd.Series, schema: pd.Series, path: pd.Series) -> pd.DataFrame:
    schemas = {t: json.loads(t) for t in schema.unique()}
    return pd.DataFrame([targeted_prompt(d, schemas[s], p) for d, s, p in zip(document, schema, path)], columns=["system", "user"])


@F.pandas_udf(texts("system", "user"))
def verification_prompts(document: pd.Series, schema: pd.Series, path: pd.Series, value: pd.Series) -> pd.DataFrame:
    schemas = {t: json.loads(t) for t in schema.unique()}
    return pd.DataFrame([verification_prompt(d, schemas[s], p, v) for d, s, p, v in zip(document, schema, path, value)], columns=["system", "user"])
