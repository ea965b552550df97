"""Neighbours of hits as a graph (D37): the tree of sections, references and the order of chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import question_terms, term_coverage

#: Neighbours of a hit, chunks of a question; words of questions that child sections answer.
EACH, ALL = 2, 36
CHILD_QUESTIONS = r"差异|处理|外币折算|保留|依据|需要保留"
NUMBERED = r"^\s*(\d+(?:\.\d+)*)[.、\s]"


def relevance(question: Column, text: Column, reason: Column) -> Column:
    """Coverage of the question's terms, 0.2 more for a child section that the question is after, 0.1 for a reference, 0.05 less for the chunk before or behind."""
    child = (reason == "child_section") & F.regexp_replace(question, r"\s+", "").rlike(CHILD_QUESTIONS)
    extra = F.when(child, 0.2).when(reason.isin("previous_chunk", "next_chunk"), -0.05).when(reason.startswith("referenced_"), 0.1).otherwise(0.0)
    return term_coverage(question_terms(question), text) + extra


def neighbour_edges(anchors: DataFrame, chunks: DataFrame, references: DataFrame) -> DataFrame:
    """(chunk_id, to_id, reason, turn) of every neighbour of the anchors (chunk_id), in the order child, parent, references, previous, next.

    chunks: document_id, pos, chunk_id, section_title; references: chunk_id, to_id, kind, turn.
    A section of one number has those under it as children, one of several the section above
    as parent; both by equality of numbers within the document.
    """
    doc = W.partitionBy("document_id").orderBy("pos", "chunk_id")
    number = F.nullif(F.regexp_extract(F.coalesce("section_title", F.lit("")), NUMBERED, 1), F.lit(""))
    c = chunks.select("document_id", "chunk_id", F.row_number().over(doc).alias("_at"), number.alias("_n"), F.lag("chunk_id").over(doc).alias("_before"), F.lead("chunk_id").over(doc).alias("_after"))
    a = anchors.select("chunk_id").distinct().join(c, "chunk_id")
    dotted = F.contains("_n", F.lit("."))
    others = c.select("document_id", F.col("chunk_id").alias("to_id"), F.col("_n").alias("_m"), F.col("_at").alias("turn"))
    under = others.filter(F.contains("_m", F.lit("."))).withColumn("_n", F.substring_index("_m", ".", 1))
    child = a.filter(~dotted).join(under, ["document_id", "_n"]).select("chunk_id", "to_id", F.lit("child_section").alias("reason"), F.lit(0).alias("_o"), "turn")
    above = a.filter(dotted).withColumn("_m", F.regexp_replace("_n", r"\.\d+$", ""))
    parent = above.join(others, ["document_id", "_m"]).select("chunk_id", "to_id", F.lit("parent_section").alias("reason"), F.lit(1).alias("_o"), "turn")
    refs = references.join(a.select("chunk_id"), "chunk_id").select("chunk_id", "to_id", F.concat(F.lit("referenced_"), "kind").alias("reason"), F.lit(2).alias("_o"), F.col("turn").cast("int").alias("turn"))
    before = a.select("chunk_id", F.col("_before").alias("to_id"), F.lit("previous_chunk").alias("reason"), F.lit(3).alias("_o"), F.lit(0).alias("turn"))
    after = a.select("chunk_id", F.col("_after").alias("to_id"), F.lit("next_chunk").alias("reason"), F.lit(4).alias("_o"), F.lit(0).alias("turn"))
    edges = child.union(parent).union(refs).union(before).union(after).filter("to_id is not null and to_id <> chunk_id")
    return edges.select("chunk_id", "to_id", "reason", F.struct("_o", "turn").alias("turn"))


def expand_graph(hits: DataFrame, chunks: DataFrame, references: DataFrame, clauses: DataFrame | None = None, each: int = EACH, most: int = ALL) -> DataFrame:
    """question_id, chunk_id, reason (null: a hit), anchor_id and pick (from 1).

    hits: question_id, question, chunk_id, rank, plain (a table's cell or calculation, which
    takes no neighbours). In rank order every hit not taken yet is taken with up to 2 of its
    neighbours that are not: references first, then by relevance, sections before the others;
    one without any relevance stays only as a section. Where a hit has places left, clauses
    (chunk_id, to_id, turn) that it cites in other documents fill them. At most 36 stay.

    A hit's neighbours are cut to what the fold over a question's hits can still reach (two
    more than all that the hits can take), so a section with many children costs no more.
    """
    hits = hits.select("question_id", "question", "chunk_id", "rank", F.coalesce("plain", F.lit(False)).alias("plain") if "plain" in hits.columns else F.lit(False).alias("plain"))
    once = hits.withColumn("_r", F.row_number().over(W.partitionBy("question_id", "chunk_id").orderBy("rank"))).filter("_r = 1").drop("_r")
    size = once.groupBy("question_id").agg(F.count("*").alias("_hits"))
    edges = neighbour_edges(once.filter("not plain"), chunks, references)
    text = chunks.select(F.col("chunk_id").alias("to_id"), F.concat_ws("\n", *[F.nullif(F.col(x), F.lit("")) for x in ("section_title", "embedding_text", "text") if x in chunks.columns]).alias("_t"))
    rated = once.filter("not plain").join(edges, "chunk_id").join(text, "to_id").withColumn("_score", relevance(F.coalesce("question", F.lit("")), F.col("_t"), F.col("reason"))).drop("_t")
    section = F.col("reason").isin("child_section", "parent_section")
    rated = rated.filter((F.col("_score") > 0) | section)
    order = F.struct((~F.col("reason").startswith("referenced_")).alias("a"), (-F.round("_score", 9)).alias("b"), (~section).alias("c"), F.col("turn").alias("d"), F.col("to_id").alias("id"), "reason")
    best = rated.groupBy("question_id", "chunk_id", "to_id").agg(F.min(order).alias("_o")).join(size, "question_id")
    near = best.withColumn("_n", F.row_number().over(W.partitionBy("question_id", "chunk_id").orderBy("_o"))).filter(F.col("_n") <= (each + 1) * F.col("_hits") + each)
    near = near.groupBy("question_id", "chunk_id").agg(F.transform(F.array_sort(F.collect_list("_o")), lambda o: F.struct(o["id"].alias("id"), o["reason"].alias("reason"))).alias("_near"))
    if clauses is None:
        cross = once.limit(0).select("question_id", "chunk_id", F.array().cast("array<string>").alias("_cross"))
    else:
        cited = once.filter("not plain").join(clauses, "chunk_id").join(size, "question_id").withColumn("_n", F.row_number().over(W.partitionBy("question_id", "chunk_id").orderBy("turn", "to_id"))).filter(F.col("_n") <= (each + 1) * F.col("_hits") + each)
        cross = cited.groupBy("question_id", "chunk_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "to_id"))), lambda x: x["to_id"]).alias("_cross"))
    rows = once.join(near, ["question_id", "chunk_id"], "left").join(cross, ["question_id", "chunk_id"], "left")
    none = F.array().cast("array<struct<id:string,reason:string>>")
    far = F.transform(F.coalesce("_cross", F.array().cast("array<string>")), lambda i: F.struct(i.alias("id"), F.lit("cross_document_referenced_clause").alias("reason")))
    hit = F.struct("rank", F.col("chunk_id").alias("id"), "plain", F.concat(F.coalesce("_near", none), far).alias("near"))
    lists = rows.groupBy("question_id").agg(F.array_sort(F.collect_list(hit), lambda a, b: F.when(a["rank"] != b["rank"], F.when(a["rank"] < b["rank"], -1).otherwise(1)).when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0)).alias("_hits"))
    kind = "array<struct<id:string,reason:string,anchor:string>>"
    one = lambda i, reason, anchor: F.array(F.struct(i.alias("id"), reason.alias("reason"), anchor.alias("anchor"))).cast(kind)

    def step(kept: Column, h: Column) -> Column:
        taken = F.concat(kept, one(h["id"], F.lit(None).cast("string"), h["id"]))
        new = F.slice(F.filter(h["near"], lambda x: ~F.exists(taken, lambda t: t["id"] == x["id"])), 1, each)
        more = F.concat(taken, F.transform(new, lambda x: F.struct(x["id"].alias("id"), x["reason"].alias("reason"), h["id"].alias("anchor"))).cast(kind))
        # A table's cell stays in any case; another hit that came as a neighbour is passed over.
        return F.when(h["plain"], taken).when(F.exists(kept, lambda t: t["id"] == h["id"]), kept).otherwise(more)

    kept = F.slice(F.aggregate("_hits", F.array().cast(kind), step), 1, most)
    return lists.select("question_id", F.posexplode(kept).alias("pick", "x")).select("question_id", F.col("x.id").alias("chunk_id"), F.col("x.reason").alias("reason"), F.col("x.anchor").alias("anchor_id"), (F.col("pick") + 1).alias("pick"))
