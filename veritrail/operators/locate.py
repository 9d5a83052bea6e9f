"""Where the values of a JSON object lie among the tokens of the text it was read from."""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame

from veritrail.operators.ranges import spread
from veritrail.operators.trees import JSON_TYPES, leaves

LOCATION = "pos int, path_str string, kind string, value string, is_empty boolean, start int, past int, char_start int, char_end int"


def search_text(value) -> str | None:
    """A leaf as JSON text has it, strings without quotes; None for what leaves no trace."""
    if value is None or value == "" and isinstance(value, str):
        return None
    return value if isinstance(value, str) else json.dumps(value)


def locate(tree, text: str, tokens: list[str]) -> Iterator[tuple]:
    """Rows of LOCATION but pos, for the leaves found one after another: each is sought after the one before. text is the JSON
    within the tokens' text, or stands alone if it is not in there. Leaves without a trace get a token at the cursor;
    others that are not found are left out."""
    starts = [0, *accumulate(map(len, tokens))][:-1]
    offset, cursor = max(0, "".join(tokens).find(text)), 0

    def token(at: int) -> int:
        return max(0, bisect_right(starts, at) - 1)

    for path, value in leaves(tree):
        wanted = search_text(value)
        if wanted is None:
            begin = end = cursor
        else:
            found = text.find(wanted, max(0, cursor - offset))
            if found < 0:
                continue
            begin, end = offset + found, offset + found + len(wanted)
        first = token(begin)
        past = max(token(end), min(first + 1, len(tokens)))
        shown = None if value is None else value if isinstance(value, str) else json.dumps(value)
        yield ".".join(map(str, path)), JSON_TYPES[type(value)], shown, wanted is None, first, past, begin, end
        cursor = end


def locate_fields(outputs: DataFrame) -> DataFrame:
    """(doc_id, LOCATION) of outputs (doc_id, parsed, candidate, tokens): the JSON of the object, the text it was read from, and
    the generated tokens. Texts that are no JSON give no rows. The cursor is state within a document, so a document is one
    Python call; no shuffle."""
    names = [c.split()[0] for c in LOCATION.split(", ")]

    def run(frames):
        for f in frames:
            rows = []
            for doc, parsed, candidate, tokens in f.itertuples(index=False):
                if parsed is not None:
                    rows += [(doc, i, *r) for i, r in enumerate(locate(json.loads(parsed), candidate or "", list(tokens) if tokens is not None else []))]
            yield pd.DataFrame(rows, columns=["doc_id", *names])

    kind = outputs.schema["doc_id"].dataType.simpleString()
    return spread(outputs.select("doc_id", "parsed", "candidate", "tokens")).mapInPandas(run, f"doc_id {kind}, {LOCATION}")
