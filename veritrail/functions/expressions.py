"""Leaf comparison and text functions as native columns; all stay inside the JVM."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType

from veritrail.functions import values
from veritrail.functions.values import FUZZY_THRESHOLD, NUMBER_TOLERANCE, PUNCTUATION

PERIOD = f"(?i){values.PERIOD}"
SPACE = r"[\s\p{Z}\x1c-\x1f\x85]"  # what Python strips
# Groups of words that mean the same, leaf names of long free text, and the length from which text is long.
SYNONYMS = (
    ("usd", "dollars", "us dollars", "u.s. dollars", "$", "us$"),
    ("eur", "euros", "euro", "€"),
    ("gbp", "pounds", "british pounds", "£", "pounds sterling"),
    ("true", "yes"),
    ("false", "no"),
)
UNSCORABLE = ("borrowing_request", "use_of_proceeds", "authorized_officer_definition")
LONG_TEXT = 80
# Dash characters that count as "-".
DASHES = "‐‑‒–—―−"


def folded(c: Column) -> Column:
    return F.lower(strip(c))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def nothing(c: Column) -> Column:
    return c.isNull() | (c == "")


def either_nothing(g: Column, e: Column, same: Column) -> Column:
    """Null and '' equal each other and nothing else."""
    return F.when(nothing(g) | nothing(e), nothing(g) & nothing(e)).otherwise(same)


def same_folded(g: Column, e: Column) -> Column:
    return either_nothing(g, e, folded(g) == folded(e))


def tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.translate(c, PUNCTUATION, " " * len(PUNCTUATION))), r"\s+"), lambda t: t != ""))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def same_fuzzy(g: Column, e: Column, threshold: float = FUZZY_THRESHOLD) -> Column:
    a, b = tokens(g), tokens(e)
    return either_nothing(g, e, F.size(F.array_intersect(a, b)) >= F.size(F.array_union(a, b)) * F.lit(threshold))


def number(c: Column) -> Column:
    """A text's number once commas and dollar signs are gone, in Python's grammar: underscores between digits, inf and nan."""
    bare = strip(F.regexp_replace(c, "[,$]", ""))
    return F.when(bare.rlike(f"^{values.NUMBER}$"), F.regexp_replace(bare, "_", "").try_cast("double"))


def looks_numeric(c: Column) -> Column:
    return F.coalesce(number(c).isNotNull(), F.lit(False))


def let(value: Column, then) -> Column:
    """then(value) with value worked out once; then may hold no Python function."""
    return F.transform(F.array(value), then)[0]


def both_numbers(g: Column, e: Column, tolerance: float) -> Column:
    """Whether e lies within a share of g, or of one where g is zero; NaN lies nowhere. Null if a side is no number."""

    def near(n: Column) -> Column:
        a, b = n["a"], n["b"]
        same = a == b
        if tolerance:  # 0 times infinity would be NaN, which the JVM takes for the largest number
            same = same | (F.abs(a - b) <= tolerance * F.when(a == 0, F.lit(1.0)).otherwise(F.abs(a)))
        return F.when(a.isNotNull() & b.isNotNull(), ~F.isnan(a) & ~F.isnan(b) & same)

    return let(F.struct(number(g).alias("a"), number(e).alias("b")), near)


def same_number(g: Column, e: Column, tolerance: float = NUMBER_TOLERANCE) -> Column:
    """Within a share of gold, or of one where gold is zero; texts that are no numbers equal nothing."""
    return either_nothing(g, e, F.coalesce(both_numbers(g, e, tolerance), F.lit(False)))


#: Directives of Python's date formats: as the JVM writes them, and what texts have there.
DIRECTIVES = {"%Y": ("y", r"\d{4}"), "%m": ("M", r"\d{1,2}"), "%d": ("d", r"\d{1,2}"), "%H": ("H", r"\d{1,2}"), "%M": ("m", r"\d{1,2}"), "%S": ("s", r"\d{1,2}"), ".%f": ("[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]", r"\.\d{1,6}"), "%B": ("MMMM", "[A-Za-z]+"), "%b": ("MMM", "[A-Za-z]+"), " ": (" ", r"\s+"), "T": ("'T'", "T"), "Z": ("'Z'", "Z")}


def date_patterns() -> dict[str, list[str]]:
    """values.DATE_FORMATS as the JVM writes them, by the pattern of the texts that a format reads."""
    out: dict[str, list[str]] = {}
    for form in values.DATE_FORMATS:
        parts = re.findall(r"\.%f|%[A-Za-z]|.", form)
        pattern = "".join(DIRECTIVES[p][1] if p in DIRECTIVES else re.escape(p) for p in parts)
        out.setdefault(f"^{pattern}$", []).append("".join(DIRECTIVES.get(p, (p,))[0] for p in parts))
    return out


def date(c: Column) -> Column:
    """Time of a text in one of the fixed formats, by built-in functions; null for fiscal periods and for all else, which
    values.date reads one by one."""
    s = strip(c)
    flat = F.initcap(F.regexp_replace(s, r"\s+", " "))  # month names count in any case
    known = F.lit(None).cast("timestamp_ntz")
    for pattern, forms in date_patterns().items():
        text = s if "T" in pattern else flat
        known = F.when(s.rlike(pattern), F.coalesce(*[F.expr("null").cast("timestamp_ntz"), *[F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in forms]])).otherwise(known)
    return F.when(~F.coalesce(period(s), F.lit(False)), known)


@F.pandas_udf(BooleanType())
def _same_loose_date(g, e):
    return pd.Series([None if a is None or b is None else values.same_date(a, b) for a, b in zip(g, e)], dtype="object")


def same_date(g: Column, e: Column) -> Column:
    """Equal times, or without case where one is none. Pairs that look like dates, but of which a side is in no fixed
    format, go to Python; others send it nulls."""
    native = let(F.struct(date(g).alias("a"), date(e).alias("b")), lambda d: F.when(d["a"].isNotNull() & d["b"].isNotNull(), d["a"] == d["b"]))
    dated = lambda c: c.rlike(r"(?s)\d[/-]\d|[A-Za-z]{3}.*\d|\d.*[A-Za-z]{3}") & ~period(c)
    loose = dated(g) & dated(e) & native.isNull()
    return either_nothing(g, e, F.coalesce(native, _same_loose_date(F.when(loose, g), F.when(loose, e)), folded(g) == folded(e)))


def same_auto(g: Column, e: Column, tolerance: float = NUMBER_TOLERANCE) -> Column:
    """As numbers if both are, else as dates if both are, else without case; texts only."""
    return either_nothing(g, e, F.coalesce(both_numbers(g, e, tolerance), same_date(g, e)))


def same_exact(g: Column, e: Column, g_kind: Column | None = None, e_kind: Column | None = None) -> Column:
    """Texts of values as Python writes them, with their kinds (null, boolean, integer, number, string): equal texts, and next
    to a boolean of another kind without case; NaN equals nothing of its kind."""
    if g_kind is None:
        return either_nothing(g, e, g == e)
    loose = (g_kind != e_kind) & ((g_kind == "boolean") | (e_kind == "boolean"))
    nan = (g_kind == "number") & (e_kind == "number") & (F.lower(g) == "nan")
    return either_nothing(g, e, F.when(nan, False).when(loose, F.lower(g) == F.lower(e)).otherwise(g == e))


def same_url(g: Column, e: Column) -> Column:
    return either_nothing(g, e, url(g) == url(e))


def same_email(g: Column, e: Column) -> Column:
    return either_nothing(g, e, email(g) == email(e))


def compare(g: Column, e: Column, strategy: Column | str, fuzzy_threshold: float = FUZZY_THRESHOLD, number_tolerance: float = NUMBER_TOLERANCE) -> Column:
    """Texts by the strategy of the row; an unknown strategy raises."""
    by = {"exact": same_exact(g, e), "case_insensitive": same_folded(g, e), "fuzzy": same_fuzzy(g, e, fuzzy_threshold), "number": same_number(g, e, number_tolerance), "url": same_url(g, e), "email": same_email(g, e), "date": same_date(g, e), "auto": same_auto(g, e, number_tolerance)}
    if isinstance(strategy, str):
        if strategy not in by:
            raise ValueError(f"unknown strategy {strategy!r}")
        return by[strategy]
    out = F.raise_error(F.concat(F.lit("unknown strategy "), F.coalesce(strategy, F.lit("null")))).cast("boolean")
    for name, same in by.items():
        out = F.when(strategy == name, same).otherwise(out)
    return out


def unlinked(c: Column) -> Column:
    return F.regexp_replace(strip(c), r"(?s)^\[([^\]]+)\]\([^)]+\).*$", "$1")


def url(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(unlinked(c)), r"^(https?://)?(www\.)?", ""), "/$", "")


def email(c: Column) -> Column:
    return strip(F.regexp_replace(F.lower(unlinked(c)), "^mailto:", ""))


def period(c: Column) -> Column:
    return c.rlike(PERIOD)


def norm_set(c: Column) -> Column:
    return F.coalesce(folded(c), F.lit(""))


def norm_span(c: Column) -> Column:
    """White space collapsed, ends trimmed, trailing ' .,;:' gone."""
    return F.regexp_replace(F.trim(F.regexp_replace(c, r"\s+", " ")), "[ .,;:]+$", "")


def same_set(a: Column, b: Column) -> Column:
    clean = lambda x: F.array_sort(F.array_distinct(F.transform(x, norm_set)))
    return clean(a) == clean(b)


@F.pandas_udf(StringType())
def _unescaped(text):
    import html

    return text.map(lambda t: None if t is None else html.unescape(t))


def unescaped(c: Column) -> Column:
    """HTML entities decoded; texts without an ampersand never leave the JVM."""
    return F.coalesce(_unescaped(F.when(F.contains(c, F.lit("&")), c)), c)


def norm_text(c: Column, entities: bool = True) -> Column:
    """Entities decoded, lower case, soft hyphens (with blanks after them), commas and dollar signs gone, dashes alike, white
    space collapsed."""
    c = F.regexp_replace(F.lower(unescaped(c) if entities else c), f"\u00ad{SPACE}*", "")
    c = F.translate(c, DASHES, "-" * len(DASHES))
    return F.regexp_replace(strip(F.regexp_replace(c, "[,$]", "")), f"{SPACE}+", " ")


def renderings(c: Column) -> Column:
    """How Python may write the number that a text spells: the text, the float, and the integer if it is one; empty for others."""
    n = number(c)
    plain = n.cast("decimal(38,18)").cast("string")
    short = F.regexp_replace(F.regexp_replace(plain, "0+$", ""), "[.]$", ".0")
    ordinary = (F.abs(n) < 1e16) & ((F.abs(n) >= 1e-4) | (n == 0))
    as_float = F.when(ordinary, short).otherwise(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(n.cast("string")), "[.]0e", "e"), "e([0-9])", "e+$1"), "e-([0-9])$", "e-0$1"), "inity", ""))
    whole = F.when((F.abs(n) < 1e22) & (n == F.floor(n)), n.cast("decimal(38,0)").cast("string"))
    return F.when(n.isNotNull(), F.filter(F.array(c, as_float, whole), lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>"))


def needles(value: Column, longest: int = LONG_TEXT, entities: bool = True) -> Column:
    """struct(method, needles, least): what to look for in a normal text to find a gold value, how many of the needles have to
    stand there, and the name of the way.

    empty_gold; for values of over `longest` characters too_long_wordmatch, by six in ten of the words of over four
    characters, or too_long_unchecked without such words; numeric, by any rendering; normalized_substr."""

    def made(s):
        raw, v = s["raw"], s["v"]
        words, forms = F.filter(F.split(v, " "), lambda w: F.length(w) > 4), renderings(v)
        return F.struct(
            F.when(raw.isNull() | (raw == ""), "empty_gold").when(F.length(raw) > longest, F.when(F.size(words) == 0, "too_long_unchecked").otherwise("too_long_wordmatch")).when(v == "", "empty_gold").when(F.size(forms) > 0, "numeric").otherwise("normalized_substr").alias("method"),
            words.alias("words"), forms.alias("forms"), v.alias("v"),
        )

    def chosen(s):
        some = F.when(s["method"] == "too_long_wordmatch", s["words"]).when(s["method"] == "numeric", s["forms"]).when(s["method"] == "normalized_substr", F.array(s["v"])).otherwise(F.array().cast("array<string>"))
        return F.struct(s["method"].alias("method"), some.alias("needles"), F.when(s["method"] == "too_long_wordmatch", F.size(s["words"]) * 0.6).otherwise(F.lit(1.0)).alias("least"))

    bare = strip(value)
    return let(let(F.struct(bare.alias("raw"), norm_text(bare, entities).alias("v")), made), chosen)


def value_in_text(value: Column, text: Column, longest: int = LONG_TEXT, entities: bool = True) -> Column:
    """struct(present, method): whether a gold value stands in a normal text (by norm_text), and how that was decided, as `needles`
    says. Reads the text once a needle: for many values of a document take fields.gold_in_text."""
    n = needles(value, longest, entities)
    hits = F.size(F.filter(n["needles"], lambda w: F.contains(text, w)))
    return F.struct(F.coalesce(hits >= n["least"], F.lit(False)).alias("present"), n["method"].alias("method"))


def searchable(text: str) -> str:
    """norm_text of one text, in Python."""
    import html

    t = (html.unescape(text) if "&" in text else text).lower()
    if "\u00ad" in t:
        t = re.sub("\u00ad\\s*", "", t)
    for d in DASHES:
        t = t.replace(d, "-")
    return " ".join(t.replace(",", "").replace("$", "").split())


@F.pandas_udf(ArrayType(IntegerType()))
def standing(text, needles):
    """How many of each list of needles stand in a text (null: null): one automaton of all its needles reads it once."""
    import ahocorasick

    def count(t, lists):
        if t is None:
            return None
        wanted = {n for some in lists for n in some}
        tree, found = ahocorasick.Automaton(), set()
        for n in wanted:
            tree.add_word(n, n)
        if wanted:
            tree.make_automaton()
            for _, n in tree.iter(searchable(t)):
                found.add(n)
                if len(found) == len(wanted):
                    break
        return [sum(n in found for n in some) for some in lists]

    return pd.Series([count(t, lists) for t, lists in zip(text, needles)], dtype=object)


def value_findable(value: Column, text: Column, longest: int = LONG_TEXT, entities: bool = True) -> Column:
    """As value_in_text; no_text where there is none."""
    found = value_in_text(value, text, longest, entities)
    return F.struct((text.isNotNull() & found["present"]).alias("present"), F.when(text.isNull(), "no_text").otherwise(found["method"]).alias("method"))


def unquoted(c: Column) -> Column:
    """Trimmed, without one pair of equal quotes around it."""
    s = strip(c)
    return F.when(s.rlike("(?s)^(\".*\"|'.*')$") & (F.length(s) > 1), strip(F.substring(s, F.lit(2), F.length(s) - 2))).otherwise(s)


def norm_lenient(c: Column) -> Column:
    """Lower case, without blanks and marks at the ends, double blanks once made single."""
    return F.replace(F.regexp_replace(strip(F.lower(c)), "^[.,;:'\" ]+|[.,;:'\" ]+$", ""), F.lit("  "), F.lit(" "))


def synonyms(a: Column, b: Column) -> Column:
    """Two normal texts of one group of words that mean the same."""
    out = F.lit(False)
    for group in SYNONYMS:
        out = out | a.isin(*group) & b.isin(*group)
    return out


def strict_ok(g: Column, e: Column) -> Column:
    """Equal by numbers without tolerance, dates, or without case, once quotes around are gone."""
    return F.coalesce(same_auto(unquoted(g), unquoted(e), 0.0), F.lit(False))


def lenient_ok(g: Column, e: Column) -> Column:
    """strict_ok, or synonyms, or one holds the other where both have four characters."""
    a, b = norm_lenient(unquoted(g)), norm_lenient(unquoted(e))
    held = (F.length(a) >= 4) & (F.length(b) >= 4) & (F.contains(a, b) | F.contains(b, a))
    return strict_ok(g, e) | F.coalesce(synonyms(a, b) | held, F.lit(False))


def ok(g: Column, e: Column, mode: str) -> Column:
    return {"strict": strict_ok, "lenient": lenient_ok}[mode](g, e)


def leaf_name(path: Column) -> Column:
    return F.element_at(F.split(path, "[.]"), -1)


def scorable(path: Column, gold: Column, longest: int = LONG_TEXT, unscorable: tuple = UNSCORABLE) -> Column:
    """Neither a leaf known for long free text nor a gold value that is long."""
    return ~leaf_name(path).isin(*unscorable) & (F.coalesce(F.length(gold), F.lit(0)) <= longest)


def classify(gold: Column, extracted: Column, in_first: Column, in_second: Column) -> Column:
    """Why an error came about, given whether gold stands in the texts of two parsers."""
    return (F.when(gold.isNull() | (strip(gold) == ""), "empty_gold").when(lenient_ok(gold, extracted), "matcher_artifact").when(~in_first & ~in_second, "gold_not_in_text")
        .when(in_first & ~in_second, "in_first_only").when(in_second & ~in_first, "in_second_only").otherwise("present_model_wrong"))


def search_text(kind: Column, value: Column) -> Column:
    """What a leaf looks like in JSON text: null for nulls and empty strings; 0 and false do have a form."""
    return F.when((kind == "null") | (kind == "string") & (value == ""), None).when(kind == "boolean", F.lower(value)).otherwise(value)


def p_true(raw: Column) -> Column:
    """1 where the answer begins with true, else 0; none for none."""
    return F.startswith(F.lower(strip(raw)), F.lit("true")).cast("double")


def truncated(c: Column, most: int) -> Column:
    """The first `most` characters; all if most is not positive."""
    return F.when(F.length(c) > most, F.substring(c, 1, most)).otherwise(c) if most > 0 else c


def has_content(kind: Column, value: Column) -> Column:
    """Neither null nor a blank string nor an empty container ("[]" or "{}" of kind array or object)."""
    return ~(kind.isNull() | (kind == "null") | (kind == "string") & (strip(value) == "") | kind.isin("array", "object") & value.isin("[]", "{}"))


def segments(path: Column) -> Column:
    """array<struct(key, index)>: index is null for keys, key for places of a list (digits, dashes before them allowed)."""
    return F.transform(F.split(path, "[.]"), lambda s: F.struct(F.when(~s.rlike("^-*[0-9]+$"), s).alias("key"), F.when(s.rlike("^-?[0-9]+$"), s.try_cast("int")).alias("index")))


def domain_of(doc_id: Column) -> Column:
    return F.substring_index(doc_id, "__", 2)


def doc_id(domain: Column, stem: Column) -> Column:
    """Id of a document: its domain with / as __, and its file's stem with characters that file systems refuse as _."""
    return F.concat(F.replace(domain, F.lit("/"), F.lit("__")), F.lit("__"), F.regexp_replace(stem, r'[ /\\:*?"<>|]', "_"))


def handcrafted(value: Column, path: Column) -> dict[str, Column]:
    """Seven features of a field's text (null: empty) and path."""
    value = F.coalesce(value, F.lit(""))
    return {
        "n_chars": F.length(value),
        "n_words": F.size(F.filter(F.split(value, r"\s+"), lambda w: w != "")),
        "depth": F.size(F.split(path, "[.]")) - 1,
        "has_digit": value.rlike("[0-9]").cast("int"),
        "has_upper": value.rlike("[A-Z]").cast("int"),
        "n_commas": F.length(value) - F.length(F.replace(value, F.lit(","), F.lit(""))),
        "path_chars": F.length(path),
    }


def sigmoid(z: Column) -> Column:
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_norm(v: Column) -> Column:
    n = F.sqrt(dot(v, v))
    return F.when(n == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / n))


def token_starts(tokens: Column) -> Column:
    """Where each token begins in their concatenation."""
    return F.transform(F.sequence(F.lit(1), F.size(tokens)), lambda i: F.aggregate(F.slice(tokens, F.lit(1), i - 1), F.lit(0), lambda n, t: n + F.length(t)))


def char_to_token(starts: Column, offset: Column) -> Column:
    """Place of the last token that begins at or before offset; 0 if there is none."""
    return F.greatest(F.lit(0), F.size(F.filter(starts, lambda s: s <= offset)) - 1)


def pinned(x: Column, n: Column) -> Column:
    return F.greatest(F.lit(0), F.least(x, n))


def span_logprob(logprobs: Column, start: Column, past: Column) -> Column:
    """struct(mean_logprob, min_logprob) of the tokens from start to before past, cut to those there are; NaN if none."""
    n = F.size(logprobs)
    lo = pinned(start, n)
    inside = F.slice(logprobs, lo + 1, F.greatest(lo, F.least(past, n)) - lo)
    some, nan = F.size(inside) > 0, F.lit(float("nan"))
    mean = F.aggregate(inside, F.lit(0.0), lambda s, x: s + x) / F.size(inside)
    return F.struct(F.when(some, mean).otherwise(nan).alias("mean_logprob"), F.when(some, F.array_min(inside)).otherwise(nan).alias("min_logprob"))


def last_or_mean(tokens: Column, how: str) -> Column:
    """One vector of an array of token vectors: the last, or the mean by place."""
    if how == "last":
        return F.element_at(tokens, -1)
    places = F.sequence(F.lit(0), F.size(tokens[0]) - 1)
    return F.transform(places, lambda i: F.aggregate(tokens, F.lit(0.0), lambda s, v: s + F.get(v, i).cast("double")) / F.size(tokens))
