"""Text expressions: counting, cutting, choosing excerpts, prompts and answers of the deciding model."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpusloom import config as C

# Words that make a paragraph worth quoting.
TERMS = (
    "registry docker network actions runner webhook branch protect review api cloudformation endpoint authentication token s3 kms iam helm "
    "kustomization gitrepository receiver sops secret bootstrap install configuration build lock pin architecture arm amd64"
).split()
# Fixed value: the shape of a deciding model's answer.
ANSWER = r"(?isU)DECISION:\s*(SAVE|CONSOLIDATE|SKIP)\s*\n(?:TARGET_ID:\s*(.+?)\s*\n)?REASON:\s*(.+)"


def word_count(t: Column) -> Column:
    return F.size(F.filter(F.split(t, r"(?U)\s+"), lambda x: x != ""))


def words(t: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(t), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def truncated(t: Column, limit: int = C.MODEL_INPUT_CHARS) -> Column:
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit), F.lit(C.TRUNCATED))).otherwise(t)


def long_enough(t: Column, least: int = C.MIN_ARTICLE_CHARS) -> Column:
    return F.coalesce(F.length(t) >= least, F.lit(False))


def sha256(t: Column) -> Column:
    return F.sha2(t.cast("binary"), 256)


def document(u: Column, title: Column, body: Column) -> Column:
    """A stored document: two header lines, a rule, a blank line, the body."""
    return F.concat(F.lit("URL: "), F.coalesce(u, F.lit("")), F.lit("\nTitle: "), F.coalesce(title, F.lit("")), F.lit("\n" + C.RULE + "\n\n"), F.coalesce(body, F.lit("")))


def body_of(doc: Column) -> Column:
    """What follows the first rule and blank line of a stored document; all of it when there is none."""
    return F.coalesce(F.try_element_at(F.split(doc, C.RULE + "\n\n", 2), F.lit(2)), doc)


def bundle_entry(title: Column, u: Column, text: Column) -> Column:
    return F.concat(F.lit("\n\n---\n# "), title, F.lit("\n\nSource: "), u, F.lit("\n\n"), text, F.lit("\n"))


def bundle_sections(t: Column) -> Column:
    return F.size(F.split(t, "\n\nSource: https://")) - 1


def chunks(text: str | None, limit: int = C.EMBED_INPUT_CHARS) -> list[str]:
    """Pieces for the embedder, each cut at the last paragraph end, line end or blank within the limit, else hard.

    A boundary at the very start counts as none. Blank pieces are left out.
    """
    rest, out = (text or "").strip(), []
    while len(rest) > limit:
        at = next((p for mark in ("\n\n", "\n", " ") if (p := rest.rfind(mark, 0, limit)) >= 0), -1)
        at = at if at > 0 else limit
        out.append(rest[:at].strip())
        rest = rest[at:].strip()
    return [x for x in [*out, rest] if x]


def chunk_table(df: DataFrame, text: str, keep: list[str], limit: int = C.EMBED_INPUT_CHARS) -> DataFrame:
    """A row per piece: ``keep``, chunk_no from 1, chunk."""

    @F.pandas_udf("array<string>")
    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda t: chunks(t, limit))

    return df.select(*keep, F.posexplode(cut(F.col(text))).alias("_i", "chunk")).select(*keep, (F.col("_i") + 1).alias("chunk_no"), "chunk")


def excerpt(text: Column, limit: int = C.EXCERPT_CHARS) -> Column:
    """Short texts whole; else the paragraphs with most distinct terms that fit together, in their order; else the start.

    Paragraphs are taken by falling number of terms, then by place; one that would reach the limit is passed over and
    later ones are still tried. All of it is array functions, so no text leaves the JVM.
    """
    low = lambda p: F.lower(p)
    hits = lambda p: sum((F.contains(low(p), F.lit(t)).cast("int") for t in TERMS), F.lit(0))
    paragraphs = F.transform(F.split(text, "\n\n"), lambda p, i: F.struct((-hits(p)).alias("worth"), i.alias("place"), F.length(p).alias("size"), p.alias("body")))
    start = F.struct(F.lit(0).alias("size"), F.expr("cast(array() as array<struct<place:int,body:string>>)").alias("kept"))
    fits = lambda acc, p: acc["size"] + p["size"] < limit
    step = lambda acc, p: F.when(fits(acc, p), F.struct((acc["size"] + p["size"]).alias("size"), F.array_append(acc["kept"], F.struct(p["place"].alias("place"), p["body"].alias("body"))).alias("kept"))).otherwise(acc)
    kept = F.aggregate(F.array_sort(paragraphs), start, step)["kept"]
    joined = F.array_join(F.transform(F.array_sort(kept), lambda k: k["body"]), "\n\n")
    return F.when(F.length(text) <= limit, text).when(joined != "", joined).otherwise(F.substring(text, 1, limit))


def parse_decision(answer: Column) -> Column:
    """decision, target_id and reason of a model's answer.

    The word in any case, an optional TARGET_ID with anything but REASON after its colon, and a REASON to the end that
    is not empty; an answer of any other shape means SAVE. A target of blanks is none.
    """
    word = F.upper(F.regexp_extract(answer, ANSWER, 1))
    got = F.coalesce(word != "", F.lit(False))
    bare = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    target = F.nullif(bare(F.regexp_extract(answer, ANSWER, 2)), F.lit(""))
    reason = bare(F.regexp_extract(answer, ANSWER, 3))
    return F.struct(F.when(got, word).otherwise("SAVE").alias("decision"), F.when(got, target).alias("target_id"), F.when(got, reason).otherwise(C.NO_MATCH_REASON).alias("reason"))


def similar_block(hits: Column) -> Column:
    """Text of the recalled documents, an array of (similarity, doc_id, title, content), for the deciding model."""
    one = lambda h: F.concat(F.lit("ID: "), h["doc_id"], F.lit("\nTitle: "), F.coalesce(h["title"], F.lit("")), F.lit("\nSimilarity: "), F.format_number(h["similarity"], 2), F.lit("\n"), F.substring(h["content"], 1, C.PREVIEW_CHARS))
    return F.when(F.size(hits) > 0, F.array_join(F.transform(hits, one), "\n---\n")).otherwise("No similar documents in memory yet.")


def decide_prompt(u: Column, title: Column, text: Column, hits: Column) -> Column:
    return F.concat(F.lit("New page "), u, F.lit(" titled "), F.coalesce(title, F.lit("")), F.lit("\n\n"), F.substring(text, 1, C.EXCERPT_CHARS), F.lit("\n\nStored documents like it:\n"), similar_block(hits), F.lit("\n\nAnswer with the lines DECISION, TARGET_ID if consolidating, and REASON."))


def clean_prompt(u: Column, title: Column, text: Column) -> Column:
    """The prompt for a cleaning model; the text is cut to what the model takes."""
    return F.concat(F.lit("Give back only the body text of this page: headings, paragraphs, lists and code, without menus, banners, side bars and footers.\n\nURL: "), u, F.lit("\nTitle: "), F.coalesce(title, F.lit("")), F.lit("\n\n"), truncated(text))


def merge_prompt(target: Column, old: Column, u: Column, title: Column, new: Column) -> Column:
    """The prompt for a merging model."""
    return F.concat(F.lit("Merge these two texts into one body, each fact once, and give back only that.\n\nStored as "), target, F.lit(":\n"), F.coalesce(old, F.lit("")), F.lit("\n\nNew, from "), u, F.lit(" titled "), F.coalesce(title, F.lit("")), F.lit(":\n"), new)


def streamed_answer(body: Column) -> Column:
    """text and error of a server-sent-events body of a model.

    Only ``data:`` lines count; text deltas of choice 0 are joined. Without an end mark and a finish reason, with an
    error event, a spent token budget or nothing but blanks, there is an error and no text.
    """
    schema = "choices array<struct<index:int,delta:struct<content:string,reasoning_content:string>,finish_reason:string>>, error string"
    data = F.transform(F.filter(F.split(body, r"\r?\n"), lambda x: x.startswith("data:")), lambda x: F.trim(F.substring(x, 6, 1 << 30)))
    events = F.transform(F.filter(data, lambda x: x != "[DONE]"), lambda x: F.from_json(x, schema))
    choices = F.flatten(F.transform(events, lambda e: F.filter(F.coalesce(e["choices"], F.expr("array()").cast("array<struct<index:int,delta:struct<content:string,reasoning_content:string>,finish_reason:string>>")), lambda c: F.coalesce(c["index"], F.lit(0)) == 0)))
    text = F.array_join(F.transform(choices, lambda c: F.coalesce(c["delta"]["content"], F.lit(""))), "")
    reason = F.try_element_at(F.filter(F.transform(choices, lambda c: c["finish_reason"]), lambda r: r.isNotNull()), F.lit(-1))
    error = (
        F.when(F.exists(events, lambda e: e["error"].isNotNull()), "error event")
        .when(~F.array_contains(data, "[DONE]") | reason.isNull(), "stream interrupted")
        .when(reason == "length", "token budget exhausted")
        .when(F.trim(text) == "", "empty answer")
    )
    return F.struct(F.when(error.isNull(), text).alias("text"), error.alias("error"))


def model_matches(wanted: Column, have: Column) -> Column:
    """``have`` (an array of model names) holds the wanted name or a tag of it."""
    return F.exists(have, lambda m: (m == wanted) | F.startswith(m, F.concat(wanted, F.lit(":"))))

