"""The agent: clean, embed, recall, decide, then save, consolidate or skip.

Cleaner, embedder, decider and merger are plain functions that can be replaced by ones that call a model.
``decide_batch`` decides one batch against a memory; a stream of batches is folded by ``streaming.agent``. Within
a batch, later pages with an earlier page's text are skipped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.config import Config
from corpusloom.functions import html as H
from corpusloom.functions import text as T
from corpusloom.functions.model import generate
from corpusloom.operators import vectors as V
from corpusloom.session import materialize, numbered

DECISIONS = ("SAVE", "CONSOLIDATE", "SKIP", "ERROR")


def normal_body(text: Column) -> Column:
    """Text as the duplicate rule compares it: letter case and runs of blanks do not matter."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def rule_decider(similarity: Column, exact: Column, threshold: float) -> Column:
    """Stored text again: SKIP; close enough: CONSOLIDATE; else SAVE."""
    return F.when(exact, "SKIP").when(similarity >= threshold, "CONSOLIDATE").otherwise("SAVE")


def merge_lines(old: Column, new: Column) -> Column:
    """The old text's lines, then those of the new text that it lacks, in order."""
    have = F.split(old, "\n")
    more = F.filter(F.split(new, "\n"), lambda x: ~F.array_contains(have, x))
    return F.when(old.isNull() | (old == ""), new).otherwise(F.array_join(F.concat(have, more), "\n"))


def decide_batch(pages: DataFrame, memory: DataFrame, cfg: Config | None = None, embedder: Callable | None = None, decider: Callable = rule_decider) -> DataFrame:
    """url, seq, decision, target_id, reason, title, content, embedding, error of every page of a batch.

    ``pages`` has seq (the order of arrival), url, title and content. Blank pages are skipped, pages that cannot be
    embedded are errors whose raw content is kept. Recall looks into the memory and at the batch's earlier pages
    that are no repeats. Where the nearest of these is itself not saved, its own target is followed, on to a saved
    page of the batch, which is named by its url, or to a stored id.
    """
    cfg = cfg or Config()
    p = pages.select("seq", "url", "title", F.col("content").alias("content")).withColumn("body", normal_body(F.col("content")))
    blank = p.filter(F.coalesce(F.col("body"), F.lit("")) == "").select("seq", "url", F.lit("SKIP").alias("decision"), F.lit(None).cast("string").alias("target_id"), F.lit("No body content after cleaning").alias("reason"), "title", "content", F.lit(None).cast("array<double>").alias("embedding"), F.lit(None).cast("string").alias("error"))
    live = p.filter(F.coalesce(F.col("body"), F.lit("")) != "").withColumn("h", F.sha2(F.col("body").cast("binary"), 256))
    firsts = live.groupBy("h").agg(F.min("seq").alias("first_seq"))
    stored = memory.select(F.sha2(normal_body(F.col("content")).cast("binary"), 256).alias("h"), F.col("doc_id").alias("same_id")).groupBy("h").agg(F.min("same_id").alias("same_id"))
    live = live.join(firsts, "h").join(stored, "h", "left")
    fresh = live.filter((F.col("seq") == F.col("first_seq")) & F.col("same_id").isNull())
    emb = materialize(V.embedded(fresh, "content", ["seq", "url", "title", "content"], embedder, cfg.max_embed), "embedded")
    ok = emb.filter("error IS NULL")
    inside = V.nearest(ok, ok, "seq", "embedding", 1, cfg.similarity, before=True).select(F.col("query_id").alias("seq"), F.col("hit_id").alias("near_seq"), F.col("similarity").alias("s1"))
    numbered = memory.filter("embedding IS NOT NULL").select("doc_id", "embedding")
    outside = V.nearest(ok.select(F.col("seq").cast("string").alias("doc_id"), "embedding"), numbered, "doc_id", "embedding", 1, cfg.similarity, skip_self=False).select(F.col("query_id").cast("long").alias("seq"), F.col("hit_id").alias("far_id"), F.col("similarity").alias("s2"))
    best = emb.select("seq", "url", "error").join(inside, "seq", "left").join(outside.withColumn("seq", F.col("seq").cast(emb.schema["seq"].dataType)), "seq", "left")
    sim = F.greatest(F.coalesce("s1", F.lit(-1.0)), F.coalesce("s2", F.lit(-1.0)))
    far = F.coalesce("s2", F.lit(-1.0)) >= F.coalesce("s1", F.lit(-1.0))
    chosen = F.when(F.col("error").isNotNull(), "ERROR").otherwise(decider(sim, F.lit(False), cfg.similarity))
    found = best.select("seq", "url", chosen.alias("decision"), sim.alias("sim"), F.when(far, F.col("far_id")).alias("far_id"), F.when(~far, F.col("near_seq")).alias("near_seq"))
    found = materialize(found.withColumn("decision", F.when((F.col("decision") == "CONSOLIDATE") & F.col("far_id").isNull() & F.col("near_seq").isNull(), "SAVE").otherwise(F.col("decision"))), "found")
    roots = found.select(F.col("seq").alias("end"), F.when(F.col("decision") == "SAVE", F.col("url")).otherwise(F.col("far_id")).alias("target"))
    best = emb.join(found.select("seq", "decision", "sim"), "seq").join(chain_ends(found), "seq").join(roots, "end").withColumn("decision", F.when((F.col("decision") == "CONSOLIDATE") & F.col("target").isNull(), "SAVE").otherwise(F.col("decision")))
    new = best.select("seq", "url", "decision", F.when(F.col("decision") == "CONSOLIDATE", F.col("target")).alias("target_id"), F.when(F.col("decision") == "ERROR", F.col("error")).when(F.col("decision") == "CONSOLIDATE", F.format_string("similarity %.4f", "sim")).otherwise("Unique content").alias("reason"), "title", "content", "embedding", "error")
    again = live.filter((F.col("seq") != F.col("first_seq")) | F.col("same_id").isNotNull())
    again = again.select("seq", "url", F.lit("SKIP").alias("decision"), F.col("same_id").alias("target_id"), F.lit("Duplicate of an earlier page").alias("reason"), "title", "content", F.lit(None).cast("array<double>").alias("embedding"), F.lit(None).cast("string").alias("error"))
    return new.unionByName(again).unionByName(blank)


def cleaned(pages: DataFrame, cfg: Config, open_client: Callable | None = None) -> DataFrame:
    """seq, url, title, raw, content, error: pages with their cleaned text.

    With ``skip_clean`` the text stays as it is; with ``open_client`` a model cleans what it can take of it, and a page it
    fails on has an error and no content; without either the text stays too, for the callers extract the body.
    """
    raw = pages.select("seq", "url", "title", F.col("content").alias("raw"))
    if cfg.skip_clean or open_client is None:
        return raw.withColumn("content", F.col("raw")).withColumn("error", F.lit(None).cast("string"))
    blank = F.coalesce(F.trim("raw"), F.lit("")) == ""
    asked = raw.filter(~blank).withColumn("prompt", T.clean_prompt(F.col("url"), F.col("title"), F.substring("raw", 1, 1 << 30)))
    got = generate(asked, "prompt", open_client, ["seq", "url", "title", "raw"]).withColumnRenamed("answer", "content")
    return got.unionByName(raw.filter(blank).withColumn("content", F.col("raw")).withColumn("error", F.lit(None).cast("string")))


def decide_by_model(pages: DataFrame, memory: DataFrame, open_client: Callable, cfg: Config | None = None, embedder: Callable | None = None) -> DataFrame:
    """As ``decide_batch``, by a model: clean, embed, recall the ``top_k`` nearest that reach the threshold, ask, parse.

    Pages are decided against the memory alone, so a batch of one page gives the strictly sequential behaviour; of
    pages with the same cleaned text in a batch the later ones are skipped. An answer that can't be read means SAVE; a
    target that the memory does not have is refused and the page saved. A page that any step fails on is an ERROR and
    keeps its raw content.
    """
    cfg = cfg or Config()
    p = materialize(cleaned(pages, cfg, open_client), "cleaned").withColumn("body", F.coalesce(normal_body(F.col("content")), F.lit("")))
    none = lambda kind: F.lit(None).cast(kind)
    broken = p.filter("error IS NOT NULL").select("seq", "url", F.lit("ERROR").alias("decision"), none("string").alias("target_id"), F.col("error").alias("reason"), "title", F.col("raw").alias("content"), none("array<double>").alias("embedding"), "error")
    fine = p.filter("error IS NULL")
    first = fine.filter("body <> ''").groupBy("body").agg(F.min("seq").alias("first"))
    fine = fine.join(first, "body", "left")
    skipped = fine.filter("body = '' OR seq <> first").select("seq", "url", F.lit("SKIP").alias("decision"), none("string").alias("target_id"), F.when(F.col("body") == "", "No body content after cleaning").otherwise("Duplicate of an earlier page").alias("reason"), "title", "content", none("array<double>").alias("embedding"), none("string").alias("error"))
    emb = materialize(V.embedded(fine.filter("body <> '' AND seq = first"), "content", ["seq", "url", "title", "raw", "content"], embedder, cfg.max_embed), "embedded")
    ok = emb.filter("error IS NULL")
    near = V.nearest(ok.select(F.col("seq").cast("string").alias("doc_id"), "embedding"), memory.filter("embedding IS NOT NULL").select("doc_id", "embedding"), "doc_id", "embedding", cfg.top_k, cfg.similarity, skip_self=False)
    known = near.select(F.col("query_id").alias("q"), F.col("hit_id").alias("doc_id"), "similarity", "rank").join(memory.select("doc_id", "title", "content"), "doc_id")
    hits = known.groupBy("q").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "similarity", "doc_id", "title", "content"))), lambda h: F.struct(h["similarity"].alias("similarity"), h["doc_id"].alias("doc_id"), h["title"].alias("title"), h["content"].alias("content"))).alias("hits"))  # at most top_k a page
    asked = ok.join(hits, F.col("q") == F.col("seq").cast("string"), "left").withColumn("prompt", T.decide_prompt(F.col("url"), F.col("title"), F.col("content"), F.coalesce("hits", F.array().cast("array<struct<similarity:double,doc_id:string,title:string,content:string>>"))))
    said = materialize(generate(asked, "prompt", open_client, ["seq", "url", "title", "raw", "content", "embedding"]), "answers")
    parsed = said.filter("error IS NULL").withColumn("d", T.parse_decision(F.col("answer"))).select("seq", "url", "title", "content", "embedding", "d.*")
    parsed = parsed.join(memory.select(F.col("doc_id").alias("target_id"), F.lit(True).alias("there")), "target_id", "left")
    merge = (F.col("decision") == "CONSOLIDATE") & F.coalesce("there", F.lit(False))
    done = parsed.select("seq", "url", F.when(merge, "CONSOLIDATE").when(F.col("decision") == "SKIP", "SKIP").otherwise("SAVE").alias("decision"), F.when(merge, F.col("target_id")).alias("target_id"), "reason", "title", "content", "embedding", none("string").alias("error"))
    failed = emb.filter("error IS NOT NULL").select("seq", "url", "title", "raw", "error").unionByName(said.filter("error IS NOT NULL").select("seq", "url", "title", "raw", "error"))
    failed = failed.select("seq", "url", F.lit("ERROR").alias("decision"), none("string").alias("target_id"), F.col("error").alias("reason"), "title", F.col("raw").alias("content"), none("array<double>").alias("embedding"), "error")
    return done.unionByName(failed).unionByName(broken).unionByName(skipped)


def merged_by_model(decided: DataFrame, memory: DataFrame, open_client: Callable, at: Column | None = None) -> DataFrame:
    """Rows to upsert for the consolidated pages of a batch, merged by a model: the target's id, url and title, the merged
    text and the vector of the newest page, and error. Where the model fails, the lines are merged instead."""
    last = decided.filter("decision = 'CONSOLIDATE'").groupBy("target_id").agg(F.max_by(F.struct("url", "title", "content", "embedding"), "seq").alias("p"))
    old = memory.select(F.col("doc_id").alias("target_id"), F.col("content").alias("old"), F.col("url").alias("old_url"), F.col("title").alias("old_title"))
    asked = last.join(old, "target_id").select("target_id", "old", "old_url", "old_title", "p.content", "p.embedding", T.merge_prompt(F.col("target_id"), F.col("old"), F.col("p.url"), F.col("p.title"), F.col("p.content")).alias("prompt"))
    got = generate(asked, "prompt", open_client, ["target_id", "old", "old_url", "old_title", "content", "embedding"])
    body = F.coalesce("answer", merge_lines(F.col("old"), F.col("content")))
    return got.select(F.col("target_id").alias("doc_id"), body.alias("content"), "embedding", F.col("old_url").alias("url"), F.col("old_title").alias("title"), (F.lit(None) if at is None else at).cast("timestamp").alias("ts"), T.word_count(body).cast("int").alias("word_count"), "error")


def chain_ends(found: DataFrame) -> DataFrame:
    """seq, end of every page: the page at which following near_seq ends, which is itself if it is saved or has none.

    Each round doubles the steps followed and is written to the shared folder.
    """
    up = F.when(F.col("decision").isin("CONSOLIDATE", "SKIP"), F.col("near_seq"))
    ends = materialize(found.select("seq", F.coalesce(up, "seq").alias("end")), "chains")
    while True:
        ahead = ends.select(F.col("seq").alias("end"), F.col("end").alias("next"))
        ends = materialize(ends.join(ahead, "end").select("seq", F.col("next").alias("end"), (F.col("next") != F.col("end")).alias("moved")), "chains")
        if ends.filter("moved").isEmpty():
            return ends.select("seq", "end")


def saved_ids(decided: DataFrame, first_index: int = 0) -> DataFrame:
    """seq, url, title, doc_id: the new ids of saved pages."""
    saved = numbered(decided.filter("decision = 'SAVE'").select("seq", "url", "title"), ["seq"], "_n", first_index)
    return saved.select("seq", "url", "title", H.doc_name(F.col("_n"), F.col("title")).alias("doc_id"))


def error_rows(decided: DataFrame, first_index: int = 0) -> DataFrame:
    """doc_id, url, title, content of pages that failed: raw content under fresh ids, to be written and not upserted.

    ``first_index`` must lie past every id in use and those that ``saved_ids`` gives to the batch.
    """
    failed = numbered(decided.filter("decision = 'ERROR'").select("seq", "url", "title", "content"), ["seq"], "_n", first_index)
    return failed.select(H.doc_name(F.col("_n"), F.col("title")).alias("doc_id"), "url", "title", "content")


def memory_rows(decided: DataFrame, memory: DataFrame, first_index: int = 0, merger: Callable = merge_lines, at: Column | None = None) -> DataFrame:
    """Rows to upsert: saved pages under new ids, consolidated ones under their target's.

    A consolidated document keeps the target's url and title, gets the merged text and the vector of the newest
    page merged into it. Targets inside the batch become the id that their page is saved under; ``decide_batch``
    has followed chains of consolidation to the page that is saved. ``at`` is the time to note.
    """
    saved = decided.filter("decision = 'SAVE'")
    ids = saved_ids(decided, first_index)
    base = saved.join(ids.select("seq", "doc_id"), "seq")
    merged = decided.filter("decision = 'CONSOLIDATE'")
    links = merged.select("seq", F.col("target_id"), "url", "content", "embedding")
    to_new = links.join(ids.select(F.col("url").alias("target_id"), F.col("doc_id").alias("new_id")).dropDuplicates(["target_id"]), "target_id", "left")
    to_new = to_new.withColumn("doc_id", F.coalesce("new_id", "target_id"))
    old = memory.select("doc_id", F.col("content").alias("old"), F.col("url").alias("old_url"), F.col("title").alias("old_title"))
    add = to_new.groupBy("doc_id").agg(F.max(F.struct("seq", "embedding")).alias("last"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "content"))), lambda x: x["content"]), "\n").alias("more"))  # pages merged into one document
    out = base.select("doc_id", "url", "title", "content", "embedding", "seq").join(add, "doc_id", "full").join(old, "doc_id", "left")
    known = out.filter(F.col("content").isNotNull() | F.col("old").isNotNull())
    body = F.when(F.col("more").isNull(), F.col("content")).otherwise(merger(F.coalesce("content", "old"), F.col("more")))
    return known.select("doc_id", body.alias("content"), F.coalesce("last.embedding", "embedding").alias("embedding"), F.coalesce("url", "old_url").alias("url"), F.coalesce("title", "old_title").alias("title"), (F.lit(None) if at is None else at).cast("timestamp").alias("ts"), T.word_count(body).cast("int").alias("word_count"))


def results(decided: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """url, decision, doc_id, reason: one row per page. With ``ids`` a target of the batch has its new id, else its url."""
    if ids is None:
        return decided.select("url", "decision", F.col("target_id").alias("doc_id"), "reason")
    named = ids.select(F.col("url").alias("target_id"), F.col("doc_id").alias("new_id")).dropDuplicates(["target_id"])
    return decided.join(named, "target_id", "left").select("url", "decision", F.coalesce("new_id", "target_id").alias("doc_id"), "reason")


def recall(memory: DataFrame, queries: DataFrame, row_id: str, vector: str, k: int, threshold: float) -> DataFrame:
    """The k nearest stored vectors that reach the threshold, the threshold included."""
    return V.nearest(queries, memory, row_id, vector, k, threshold)


def merged_targets(pages: DataFrame, stored: DataFrame, target: str, order: str) -> DataFrame:
    """Merged bodies of pages with a known target: target id, url, title, content of the stored document.

    All pages of a target are merged into it one after another, by ``order``, then content; a content that comes again
    adds nothing, and neither does an empty one.
    """
    new = pages.filter((F.col(target).isNotNull()) & (F.col("content") != "")).groupBy(F.col(target).alias("doc_id"), "content").agg(F.min(order).alias("o"))
    new = new.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("o", "content"))).alias("more"))  # distinct texts that become one document
    j = new.join(stored.select("doc_id", "url", "title", F.col("content").alias("old")), "doc_id")
    return j.select("doc_id", "url", "title", F.aggregate("more", F.col("old"), lambda acc, x: merge_lines(acc, x["content"])).alias("content"))
