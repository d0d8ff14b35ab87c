"""Column functions on titles, metadata, fingerprints, model outputs and prompts."""

from __future__ import annotations

import json
from collections.abc import Mapping
from string import Formatter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The token pattern and the pattern of an identifier folder.
TOKEN = r"[A-Za-z0-9]+|[^A-Za-z0-9 \t\r\n]"
UUID = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def let(value: Column, body) -> Column:
    """body(value), with value computed once for the row however often body uses it."""
    return F.transform(F.array(value), body)[0]


def _parts(text: Column, separator: str) -> Column:
    return F.filter(F.transform(F.split(text, separator), lambda x: F.trim(x)), lambda x: x != "")


def clean_authors(raw: Column) -> Column:
    """Names: split at semicolons if there are any, else at commas unless the word "and" joins names; null if empty."""
    raw = F.nullif(F.trim(raw), F.lit(""))
    commas = raw.contains(",") & ~F.lower(raw).contains(" and ")
    return F.when(raw.contains(";"), _parts(raw, ";")).when(commas, _parts(raw, ",")).when(raw.isNotNull(), F.array(raw))


def clean_keywords(raw: Column) -> Column:
    raw = F.nullif(F.trim(raw), F.lit(""))
    return F.when(raw.isNotNull(), _parts(raw, ","))


def sanitize_title(title: Column) -> Column:
    """A file name: separators become dashes, wildcard and quote characters go, dashes neither repeat nor stand at the ends."""
    dashed = F.translate(title, '/\\:|*?"<>', "----")
    return F.btrim(F.regexp_replace(dashed, "-{2,}", "-"), F.lit("-"))


def front_matter(fields: Mapping[str, Column], lists: Mapping[str, Column] | None = None) -> Column:
    """A YAML block of plain scalars, then of lists; null fields are left out. Values are written as they are, unquoted."""
    lines = [F.concat(F.lit(f"{k}: "), v.cast("string")) for k, v in fields.items()]
    for k, v in (lists or {}).items():
        rows = F.array_join(F.transform(v, lambda x: F.concat(F.lit("- "), x)), "\n")
        lines.append(F.when(F.size(v) > 0, F.concat(F.lit(f"{k}:\n"), rows)))
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n\n"))


def split_front_matter(text: Column) -> tuple[Column, Column]:
    """(front matter with its closing blank line, or empty; the rest)."""
    front = F.regexp_extract(text, r"(?s)^(---\n.*?\n---\n\n)", 1)
    return front, F.substring(text, F.length(front) + 1, F.length(text))


def file_fingerprint(name: Column, path: Column) -> Column:
    return F.sha2(F.concat_ws(":", name, path), 256)


def content_fingerprint(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 16)


def chunk_fingerprint(content: Column) -> Column:
    return F.sha2(content, 256)


def semantic_fingerprint(bubble_id: Column, note_id: Column, version: Column) -> Column:
    """Hash of compact JSON with sorted keys."""
    body = F.to_json(F.struct(bubble_id.alias("bubble_id"), note_id.alias("note_id"), version.alias("semantic_version")))
    return F.sha2(body, 256)


@F.pandas_udf(T.StringType())
def canonical_json(documents: pd.Series) -> pd.Series:
    """JSON with sorted keys, spaces after separators and ASCII escapes; null where it does not parse."""

    def one(x):
        try:
            return json.dumps(json.loads(x), sort_keys=True)
        except (TypeError, ValueError):
            return None

    return documents.map(one)


def object_hash(document: Column) -> Column:
    """Hash of canonical JSON; of the text itself where it is no JSON."""
    return F.md5(F.coalesce(canonical_json(document), document))


def merged_metadata(provided: Mapping[str, Column], read: Mapping[str, Column]) -> dict[str, Column]:
    """Fields of both; a provided value that is not null wins over the one read from the document."""
    names = [*read, *(n for n in provided if n not in read)]
    return {n: F.coalesce(*[m[n] for m in (provided, read) if n in m]) for n in names}


def valid_query(json_: Column) -> Column:
    """A translated query of a model's output: rewritten, domain, subject, subqueries (text, domain, subject). Null if rewritten is
    missing or any subquery has no text."""
    subs = F.coalesce(F.try_variant_get(json_, "$.subqueries", "array<struct<text:string,domain:string,subject:string>>"), F.array().cast("array<struct<text:string,domain:string,subject:string>>"))
    rewritten = F.try_variant_get(json_, "$.rewritten", "string")
    whole = F.struct(
        rewritten.alias("rewritten"),
        F.coalesce(F.try_variant_get(json_, "$.domain", "array<string>"), F.array_compact(F.array(F.try_variant_get(json_, "$.domain", "string")))).alias("domain"),
        F.coalesce(F.try_variant_get(json_, "$.subject", "array<string>"), F.array_compact(F.array(F.try_variant_get(json_, "$.subject", "string")))).alias("subject"),
        subs.alias("subqueries"),
    )
    return F.when(rewritten.isNotNull() & F.forall(subs, lambda s: s["text"].isNotNull()), whole)


def valid_metadata(json_: Column) -> Column:
    """File metadata of a model's output: title, domain, subject, authors, keywords; null if any is missing."""
    one = {n: F.try_variant_get(json_, f"$.{n}", "string") for n in ("title", "domain", "subject")}
    many = {n: F.try_variant_get(json_, f"$.{n}", "array<string>") for n in ("authors", "keywords")}
    there = F.lit(True)
    for c in (*one.values(), *many.values()):
        there = there & c.isNotNull()
    return F.when(there, F.struct(*[c.alias(n) for n, c in (one | many).items()]))


def slug(name: Column) -> Column:
    return F.lower(F.replace(name, F.lit(" "), F.lit("_")))


def slug_collisions(names: DataFrame, column: str) -> DataFrame:
    """(slug, names): slugs that several different names share."""
    rows = names.select(slug(F.col(column)).alias("slug"), F.col(column).alias("name")).distinct()
    return rows.groupBy("slug").agg(F.count("*").alias("names")).where("names > 1")


def preview(content: Column, length: int, ellipsis: str = "") -> Column:
    cut = F.concat(F.substring(content, 1, length), F.lit(ellipsis))
    return F.when(F.length(content) > length, cut).otherwise(F.coalesce(content, F.lit("")))


def has_uuid_part(parts: Column) -> Column:
    return F.exists(parts, lambda p: p.rlike(UUID))


def model_kind(name: Column) -> Column:
    return F.when(F.lower(name).contains("embed"), F.lit("embedding")).otherwise(F.lit("chat"))


def links(html: Column, prefix: str) -> Column:
    """Sorted different targets of links below a prefix, without it; empty ones are left out."""
    found = F.regexp_extract_all(html, F.lit('<a [^>]*href="([^"]*)"'), F.lit(1))
    below = F.filter(found, lambda h: h.startswith(prefix))
    last = F.transform(below, lambda h: F.element_at(F.split(F.substring(h, F.lit(len(prefix) + 1), F.length(h)), "/"), -1))
    return F.array_sort(F.array_distinct(F.filter(last, lambda x: x != "")))


def human_bytes(n: Column) -> Column:
    """One decimal, halves up, and a unit, B to TB, steps of 1024."""

    def shown(power: int, unit: str) -> Column:
        return F.format_string(f"%.1f {unit}", F.floor(n / 1024.0**power * 10 + 0.5) / 10.0)

    out = shown(4, "TB")
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB"), (0, "B")):
        out = F.when(n < 1024.0 ** (power + 1), shown(power, unit)).otherwise(out)
    return out


def json_tiers(output: Column) -> list[Column]:
    """What may be the JSON of a model's output: all of it, a fenced block, the widest braces."""
    fenced = F.regexp_extract(output, r"(?s)```json\s*(\{.*?\})\s*```", 1)
    return [output, fenced, F.regexp_extract(output, r"(?s)\{.*\}", 0)]


def json_from_output(output: Column, tiers: int = 3) -> Column:
    """The first of the tiers that parses to an object, as VARIANT; null if none does."""
    parsed = [F.when(F.trim(t).startswith("{"), F.try_parse_json(t)) for t in json_tiers(output)[:tiers]]
    return F.coalesce(*parsed) if len(parsed) > 1 else parsed[0]


def file_status(converted: Column, embedded: Column) -> Column:
    return F.when(embedded == 1, F.lit("completed")).when(converted == 1, F.lit("processing")).otherwise(F.lit("pending"))


def fill_template(template: str, slots: Mapping[str, Column]) -> Column:
    """The template with its {named} slots filled; doubled braces are plain ones. Text that fills a slot is not read again."""
    out = []
    for plain, name, _, _ in Formatter().parse(template):
        out.append(F.lit(plain))
        if name is not None:
            out.append(F.coalesce(slots[name].cast("string"), F.lit("")))
    return F.concat(*out)


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN))
