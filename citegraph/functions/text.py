"""Column expressions on identifiers, texts, vectors and spans; all of them stay within the JVM."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no weight, in English and in Python source.
ENGLISH = "the a an is are was were be been of to in on for with and or not it this that i we you does do did how what where which when why can should would if then else from by as at but so than into about".split()
PYTHON = "def class return self import none true false pass raise try except finally with as lambda yield assert del global nonlocal await async".split()

IDENTIFIER = "[A-Za-z_][A-Za-z0-9_]*"
#: Between a lower-case letter or digit and a capital, and before the last capital of an acronym.
BOUNDARY = "(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"


def split_identifier(name: Column) -> Column:
    """The whole name and its parts at underscores and camel-case boundaries, lower-case, each once, in order."""
    parts = F.flatten(F.transform(F.split(name, "_"), lambda p: F.split(p, BOUNDARY)))
    return F.filter(F.array_distinct(F.transform(F.concat(F.array(name), parts), F.lower)), lambda p: p != "")


def tokenize(text: Column, drop_stopwords: bool = True, min_length: int = 2) -> Column:
    """The bag of identifier parts of a text, in order; null gives an empty bag."""
    names = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(IDENTIFIER), F.lit(0))
    # Most words of prose have neither a boundary nor an underscore and need no splitting.
    plain = F.regexp_like(F.coalesce(text, F.lit("")), F.lit("_|[a-z0-9][A-Z]|[A-Z][A-Z][a-z]"))
    parts = F.when(plain, F.flatten(F.transform(names, split_identifier))).otherwise(F.transform(names, F.lower))
    keep = lambda p: F.length(p) >= min_length
    if drop_stopwords:
        stop = sorted({*ENGLISH, *PYTHON})
        keep = lambda p: (F.length(p) >= min_length) & ~p.isin(stop)
    return F.filter(parts, keep)


def tokenize_query(text: Column) -> Column:
    """Queries are cut like documents."""
    return tokenize(text)


def chunk_id(path: Column, qualified_name: Column, start_line: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("::", path, qualified_name, start_line.cast("string")).cast("binary")), 1, 16)


def citation(path: Column, start_line: Column, end_line: Column) -> Column:
    return F.concat(path, F.lit(":"), start_line.cast("string"), F.lit("-"), end_line.cast("string"))


def line_count(start_line: Column, end_line: Column) -> Column:
    return end_line - start_line + 1


def header(signature: Column, name: Column) -> Column:
    return F.coalesce(F.nullif(signature, F.lit("")), name)


def retrieval_text(qualified_name: Column, signature: Column, docstring: Column, source: Column) -> Column:
    """What is indexed of a chunk; empty parts are left out."""
    return F.concat_ws("\n", *[F.nullif(c, F.lit("")) for c in (qualified_name, signature, docstring, source)])


def estimate_tokens(source: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(source) / 4).cast("int"))


def l2_normalise(vector: Column) -> Column:
    """The vector at length 1; a zero vector stays as it is."""
    wide = vector.cast("array<double>")
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(F.array(norm), lambda n: F.transform(wide, lambda x: x / F.when(n == 0, 1.0).otherwise(n)))[0]


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def spans_overlap(start: Column, end: Column, lo: Column, hi: Column) -> Column:
    return (start <= hi) & (lo <= end)


def resolve_relative(token: Column, module: Column) -> Column:
    """An import's dotted path with leading dots resolved against the importing module: one dot is its package, each further one the package above."""
    rest = F.ltrim(token, F.lit("."))
    dots = F.length(token) - F.length(rest)
    parts = F.split(module, r"\.")
    base = F.slice(parts, F.lit(1), F.greatest(F.lit(0), F.size(parts) - dots))
    joined = F.array_join(F.concat(base, F.when(rest != "", F.array(rest)).otherwise(F.array().cast("array<string>"))), ".")
    return F.when(dots == 0, token).otherwise(joined)


def prompt_hash(model: str, messages: list[dict], **params) -> str:
    """sha256 of the request as JSON with sorted keys and no blanks."""
    return hashlib.sha256(json.dumps({"model": model, "messages": messages, "params": params}, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def extract_json(text: str | None) -> dict | None:
    """The first JSON object of a text: a fenced one if it parses, else the first balanced braces that do."""
    if not text:
        return None
    decoder = json.JSONDecoder()
    fenced = re.search(r"```(?:json)?\s*(\{.*?\})\s*```", text, re.S)
    places = [m.start() for m in re.finditer(r"\{", text)]
    if fenced:
        places.insert(0, fenced.start(1))
    for at in places:
        try:
            found, _ = decoder.raw_decode(text, at)
        except json.JSONDecodeError:
            continue
        return found
    return None


def condense(payload: dict, items: int = 5, letters: int = 600) -> dict:
    """A payload with long lists and strings cut, and how much was."""
    lists = {k: v for k, v in payload.items() if isinstance(v, list)}
    short = {k: v[:items] for k, v in lists.items()} | {k: v if len(v) <= letters else f"{v[:letters]} ..." for k, v in payload.items() if isinstance(v, str)}
    left_out = {f"{k}_truncated": n for k, v in lists.items() if (n := len(v) - items) > 0}
    return payload | short | left_out
