"""What a question's answer is written from: whole source units around its anchors, a budget over units, reserved clauses.

Chunks: document_id, pos (a number that orders a document), chunk_id, text, section_title,
token_count, indexed (null counts as true), table_id and table_role. Anchors are chunks that
were selected for a question. A unit reaches a bounded distance to both sides, so anchors
take their neighbours from a frame of bounded size over their document, never whole documents.
Chunks and anchors both grow with the corpus, and Spark takes a written table for as small as
its compressed files, so joins name their kind: no table of that size is sent to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import let
from .joins import checked_broadcast
from .lineage import written

#: How many chunks a unit looks for a definition's cue, a list's lead-in, further items; its size; a table's rows.
CUE_BACK, LEAD_BACK, ITEMS_AHEAD, MOST_CHUNKS, MOST_TOKENS, MOST_ROWS = 3, 8, 10, 12, 3600, 8
#: An item of a list, a heading, a numbered top heading, a major heading, a page's number, an exception.
ITEM = r"^\s*(?:[（(][一二三四五六七八九十百\d]+[）)]|[一二三四五六七八九十]+[、.]|\d+[.、\s])"
HEADING = r"^\s*第[\d一二三四五六七八九十百]+[条章节]"
TOP_HEADING = r"(?:^|\n)\s*([一二三四五六七八九十]+、[^\n]{1,80})"
MAJOR_HEADING = r"(?:^|\n)\s*([一二三四五六七八九十百]+[、.][^\n]{1,80}|第[一二三四五六七八九十百\d]+章[^\n]{0,80})"
PAGE_NUMBER, EXCEPTION, QUOTED_ITEM = r"^[\s—\-\d]+$", r"^(?:但|除)", r"(?m)^>\s*\d"
ORPHAN = r"^(?:但|除|.*?另有规定.*?除外)"
#: What leads a list, what a definition says, what questions for either say.
LEAD = r"[:：]\s*$|下列|以下|包括[:：]|分为[:：]|列明"
CUE = r"是指|系指|定义为|称为|是提供|是向"
ASKS_LIST = r"哪些|哪些方面|包括|列出|清单|下列|以下|分为|列明|完整"
ASKS_DEFINITION = r"定义|是什么|含义|界定|是指"


def described(chunks: DataFrame) -> DataFrame:
    """Chunks with what units are decided by: their place (_at), their place among chunks that are no page number (_item), headings."""
    known = {"indexed": "boolean", "table_id": "string", "table_role": "string", "section_title": "string"}
    c = chunks.select("*", *[F.lit(None).cast(k).alias(n) for n, k in known.items() if n not in chunks.columns]).withColumn("indexed", F.coalesce("indexed", F.lit(True)))
    text = F.coalesce("text", F.lit(""))
    doc = W.partitionBy("document_id").orderBy("pos", "chunk_id")
    so_far = doc.rowsBetween(W.unboundedPreceding, 0)
    bare = F.regexp_replace(F.coalesce("section_title", F.lit("")), r"\s+", "")
    page = text.rlike(PAGE_NUMBER)
    c = c.withColumn("_at", F.row_number().over(doc)).withColumn("_page", page).withColumn("_item", F.sum((~page).cast("int")).over(so_far)).withColumn("_bare", bare)
    run = F.sum((F.lag("_bare").over(doc).isNull() | (F.lag("_bare").over(doc) != F.col("_bare"))).cast("int")).over(doc)
    c = c.withColumn("_run", run)
    own = (F.col("_bare") != "") & F.contains(F.regexp_replace(text, r"\s+", ""), "_bare")
    titled = F.when(own & F.col("document_id").isNotNull(), F.struct("_at", "chunk_id", "indexed"))
    section = W.partitionBy("document_id", "_run").orderBy("_at").rowsBetween(W.unboundedPreceding, 0)
    first = lambda pattern, t: F.trim(F.regexp_extract(t, pattern, 1))
    tail = F.right(F.trim(text), F.lit(250))
    return c.select(
        "*", F.max(titled).over(section).alias("_title_at"), text.rlike(CUE).alias("_cue"), F.regexp_like(F.trim(text), F.lit(ITEM)).alias("_is_item"), tail.rlike(LEAD).alias("_lead"),
        F.trim(text).rlike(HEADING).alias("_heading"), first(TOP_HEADING, F.trim(text)).alias("_top"), first(TOP_HEADING, F.concat_ws("\n", text, "section_title")).alias("_own_top"), first(MAJOR_HEADING, text).alias("_major"),
        (F.trim(text).rlike(ITEM) | F.trim(text).rlike(QUOTED_ITEM) | F.trim(text).rlike(EXCEPTION)).alias("_marked"), F.trim(text).rlike(ORPHAN).alias("_orphan"),
    )


#: A chunk of a unit: its id and its place.
PART = "struct<chunk_id:string,_at:int>"
PEEK = ("chunk_id", "section_title", "indexed", "_at", "_cue", "_is_item", "_lead", "_heading", "_top", "_marked")


def with_neighbours(known: DataFrame, of: DataFrame) -> DataFrame:
    """The chunks that of (chunk_id) names, with _back: up to LEAD_BACK chunks before, and _ahead: up to ITEMS_AHEAD + 1 after that are no page number; nearest first, as structs (k, c)."""
    peek = F.when(F.col("document_id").isNotNull(), F.struct(*PEEK))
    doc = W.partitionBy("document_id")
    back = F.reverse(F.collect_list(peek).over(doc.orderBy("_at").rowsBetween(-LEAD_BACK, -1)))
    ahead = F.collect_list(F.when(~F.col("_page"), peek)).over(doc.orderBy("_item").rangeBetween(1, ITEMS_AHEAD + 1))
    ranked = lambda name: F.transform(name, lambda c, i: F.struct((i + 1).alias("k"), c.alias("c")))
    rows = known.join(of.select("chunk_id").distinct().withColumn("_named", F.lit(True)).hint("merge"), "chunk_id", "left")
    rows = rows.withColumn("_back", back).withColumn("_ahead", ahead).filter("_named").drop("_named")
    return rows.withColumn("_back", ranked("_back")).withColumn("_ahead", ranked("_ahead"))


def part(c: Column) -> Column:
    return F.struct(c["chunk_id"].alias("chunk_id"), c["_at"].alias("_at"))


def walk(rows: Column, stop: Column | None, take_and_stop, before_stop) -> Column:
    """A running stop over neighbours: struct(ids, cut), ids being PARTs. before_stop(c) ends the walk without a row, take_and_stop(c) after it; a row that isn't indexed ends it as cut."""
    start = F.struct(F.array().cast(f"array<{PART}>").alias("ids"), F.lit(False).alias("cut"), (stop if stop is not None else F.lit(False)).alias("done"))

    def step(a: Column, x: Column) -> Column:
        c = x["c"]
        ended = F.struct(a["ids"].alias("ids"), a["cut"].alias("cut"), F.lit(True).alias("done"))
        cut = F.struct(a["ids"].alias("ids"), F.lit(True).alias("cut"), F.lit(True).alias("done"))
        taken = F.struct(F.concat(a["ids"], F.array(part(c))).alias("ids"), a["cut"].alias("cut"), take_and_stop(c).alias("done"))
        return F.when(a["done"], a).when(before_stop(c), ended).when(~c["indexed"], cut).otherwise(taken)

    return F.aggregate(rows, start, step, lambda a: F.struct(a["ids"].alias("ids"), a["cut"].alias("cut")))


def items_ahead(rows: Column, opened: Column, own_top: Column) -> Column:
    """The list that follows: items until a heading or another top heading; the first must be an item; cut if it goes on beyond."""
    start = F.struct(F.array().cast(f"array<{PART}>").alias("ids"), F.lit(False).alias("cut"), (~opened).alias("done"), own_top.alias("top"))

    def step(a: Column, x: Column) -> Column:
        c = x["c"]
        state = lambda ids, cut, done, top: F.struct(ids.alias("ids"), cut.alias("cut"), done.alias("done"), top.alias("top"))
        top = F.when((a["top"] == "") & (c["_top"] != ""), c["_top"]).otherwise(a["top"])
        ends = c["_heading"] | ((c["_top"] != "") & (a["top"] != "") & (c["_top"] != a["top"])) | (~c["_marked"] & (F.size(a["ids"]) == 0))
        full = F.size(a["ids"]) >= ITEMS_AHEAD
        beyond = state(a["ids"], c["_is_item"], F.lit(True), a["top"])
        return (
            F.when(a["done"], a).when(full, beyond).when(ends, state(a["ids"], a["cut"], F.lit(True), a["top"])).when(~c["indexed"], state(a["ids"], F.lit(True), F.lit(True), a["top"]))
            .otherwise(state(F.concat(a["ids"], F.array(part(c))), a["cut"], F.lit(False), top))
        )

    return F.aggregate(rows, start, step, lambda a: F.struct(a["ids"].alias("ids"), a["cut"].alias("cut")))


def source_units(anchors: DataFrame, chunks: DataFrame) -> DataFrame:
    """The chunks of each anchor's unit in source order: question_id, anchor_id, chunk_id, place, unit_incomplete.

    anchors: question_id, chunk_id and question (null: any list is followed); whole_section
    asks for all up to the next major heading. An anchor without its definition's cue goes
    back up to 3 chunks of its section for it; an orphan item or exception up to 8 for its
    lead-in; a list's lead-in or, where a list is asked for, an item goes on for up to 10
    items until a heading; a table's row takes the other rows of a table of 2 to 8. The
    chunk in which the section's title stands comes along. A part that is not indexed cuts
    the unit, which is flagged. An anchor that no chunk has is a unit of its own.
    """
    known = written(described(chunks))
    asked = anchors.select(*[c for c in ("question_id", "chunk_id", "question", "whole_section") if c in anchors.columns])
    for c, kind in (("question", "string"), ("whole_section", "boolean")):
        asked = asked if c in asked.columns else asked.withColumn(c, F.lit(None).cast(kind))
    asked = asked.withColumn("_anchor", F.struct("question_id", "chunk_id"))
    at = asked.join(with_neighbours(known, asked).hint("merge"), "chunk_id", "left")
    q = F.regexp_replace(F.coalesce("question", F.lit("")), r"\s+", "")
    row = F.coalesce(F.col("table_role") == "row", F.lit(False))
    scope = F.coalesce("whole_section", F.lit(False))
    seeks = F.col("question").isNotNull() & q.rlike(ASKS_DEFINITION) & ~row & ~F.col("_cue")
    section = F.coalesce("section_title", F.lit(""))
    other = lambda c: (section != "") & (F.coalesce(c["section_title"], F.lit("")) != "") & (c["section_title"] != section)
    cue = walk(F.filter("_back", lambda x: x["k"] <= CUE_BACK), ~seeks, lambda c: c["_cue"], other)
    loose = ~row & ~scope
    lead = walk(F.col("_back"), ~(loose & (F.col("_is_item") | F.col("_orphan"))), lambda c: ~c["_is_item"], lambda c: F.lit(False))
    led = F.exists("_back", lambda x: (x["k"] == 1) & x["c"]["_lead"])
    opened = F.when(F.col("question").isNull() | q.rlike(ASKS_LIST), F.col("_lead") | F.col("_is_item")).when(q.rlike(ASKS_DEFINITION), F.col("_lead")).otherwise(F.col("_lead") | (F.col("_is_item") & led))
    ahead = items_ahead(F.col("_ahead"), loose & opened, F.col("_own_top"))
    found = at.select("_anchor", "document_id", "_at", "_major", scope.alias("_scope"), row.alias("_row"), "table_id", F.when(~row, F.col("_title_at")).alias("_title_at"), cue.alias("_p1"), lead.alias("_p2"), ahead.alias("_p3"))
    found = written(found)
    alone, found = found.filter("_at is null"), found.filter("_at is not null")
    own = F.struct(F.col("_anchor.chunk_id").alias("chunk_id"), "_at")
    cut = F.col("_p1.cut") | F.col("_p2.cut") | F.col("_p3.cut")
    near = found.select("_anchor", F.explode(F.array_distinct(F.concat(F.array(own), "_p1.ids", "_p2.ids", "_p3.ids"))).alias("_part"), cut.alias("cut"))
    rows = known.filter("table_role = 'row' and table_id is not null").groupBy("document_id", "table_id").agg(F.count("*").alias("_n"), F.collect_list(F.struct("chunk_id", "_at")).alias("_ids")).filter(F.col("_n").between(2, MOST_ROWS))
    tables = rows.join(checked_broadcast(found.filter("_row").select("_anchor", "document_id", "table_id"), merge=True), ["document_id", "table_id"]).select("_anchor", F.explode("_ids").alias("_part"), F.lit(False).alias("cut"))
    titled = found.filter("_title_at is not null").select("_anchor", F.when(F.col("_title_at.indexed"), part(F.col("_title_at"))).otherwise(own).alias("_part"), (~F.col("_title_at.indexed")).alias("cut"))
    scopes = checked_broadcast(found.filter("_scope").select("_anchor", "document_id", F.col("_at").alias("_from"), F.col("_major").alias("_own")), merge=True)
    later = known.select("document_id", "_at", "chunk_id", "indexed", "_major").join(scopes, "document_id").filter(F.col("_at") > F.col("_from"))
    ends = later.groupBy("_anchor").agg(F.min(F.when((F.col("_major") != "") & (F.col("_major") != F.col("_own")), F.col("_at"))).alias("_next"), F.min(F.when(~F.col("indexed"), F.col("_at"))).alias("_gap"))
    upto = F.least(F.coalesce("_next", F.lit(2**31 - 1)), F.coalesce("_gap", F.lit(2**31 - 1)))
    scoped = later.join(ends.hint("merge"), "_anchor").filter(F.col("_at") <= upto).filter("_next is null or _at < _next")
    scoped = scoped.select("_anchor", F.when(F.col("indexed"), F.struct("chunk_id", "_at")).otherwise(F.struct(F.col("_anchor.chunk_id").alias("chunk_id"), F.col("_from").alias("_at"))).alias("_part"), (~F.col("indexed")).alias("cut"))
    alone = alone.select("_anchor", own.alias("_part"), F.lit(False).alias("cut"))
    parts = near.union(tables).union(titled).union(scoped).union(alone)
    parts = parts.withColumn("unit_incomplete", F.max("cut").over(W.partitionBy("_anchor"))).dropDuplicates(["_anchor", "_part"])
    return parts.select("_anchor.question_id", F.col("_anchor.chunk_id").alias("anchor_id"), "_part.chunk_id", F.coalesce("_part._at", F.lit(1)).alias("place"), "unit_incomplete")


# ---- D48: a budget over units ----

STATE = "struct<kept:array<string>,n:int,tokens:long>"


def take(state: Column, items: Column, most: int, tokens: int) -> Column:
    """Items in order while they fit: one that is kept already is passed over, the first that doesn't fit ends it."""
    start = F.struct(state.alias("s"), F.lit(False).alias("done"))

    def step(a: Column, x: Column) -> Column:
        s = a["s"]
        over = (s["n"] >= most) | ((s["n"] > 0) & (s["tokens"] + x["cost"] > tokens))
        more = F.struct(F.concat(s["kept"], F.array(x["id"])).alias("kept"), (s["n"] + 1).alias("n"), (s["tokens"] + x["cost"]).alias("tokens"))
        return F.when(a["done"] | F.array_contains(s["kept"], x["id"]), a).when(over, F.struct(s.alias("s"), F.lit(True).alias("done"))).otherwise(F.struct(more.alias("s"), F.lit(False).alias("done")))

    return F.aggregate(items, start, step, lambda a: a["s"])


def take_whole(state: Column, unit: Column, most: int, tokens: int) -> Column:
    """A whole unit if all that is new of it fits and nothing of it was cut; a primary unit at least by its anchor, which then costs nothing."""
    new = F.filter(unit["items"], lambda x: ~F.array_contains(state["kept"], x["id"]))

    def of(new: Column) -> Column:
        cost = F.aggregate(new, F.lit(0).cast("long"), lambda a, x: a + x["cost"])
        fits = (state["n"] + F.size(new) <= most) & (state["tokens"] + cost <= tokens) & ~unit["cut"]
        whole = F.struct(F.concat(state["kept"], F.transform(new, lambda x: x["id"])).alias("kept"), (state["n"] + F.size(new)).alias("n"), (state["tokens"] + cost).alias("tokens"))
        anchor = unit["primary"] & (state["n"] < most) & ~F.array_contains(state["kept"], unit["anchor"]["id"])
        only = F.struct(F.concat(state["kept"], F.array(unit["anchor"]["id"])).alias("kept"), (state["n"] + 1).alias("n"), state["tokens"].alias("tokens"))
        return F.when(fits, whole).when(anchor, only).otherwise(state)

    return let(new, of)


def unit_budget(units: DataFrame, anchors: DataFrame, costs: DataFrame, most: int = MOST_CHUNKS, tokens: int = MOST_TOKENS) -> DataFrame:
    """question_id, chunk_id, pick (from 1) of the chunks that fit.

    anchors: question_id, chunk_id, rank, tags (requirements that it answers). In rank order a
    unit is primary if it brings a requirement that none before it has. With one primary unit
    at most, units enter whole: primaries, then the others. With more, every primary unit
    first places its anchor and one chunk of its first two; then units, primaries first, fill
    what is left chunk by chunk, those that were cut excepted. Both are folds with the chunks
    and tokens used so far as state; a question's units are bounded by its selection.
    """
    packed = packed_units(units, anchors, costs)
    zero = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("tokens")).cast(STATE)
    primaries = F.filter("_units", lambda u: u["primary"])
    ordered = F.concat(primaries, F.filter("_units", lambda u: ~u["primary"]))

    def pair(u: Column) -> Column:
        others = F.filter(F.slice(u["items"], 1, 2), lambda x: x["id"] != u["anchor"]["id"])
        return F.concat(F.array(u["anchor"]), F.slice(others, 1, 1))

    reserved = F.aggregate(primaries, zero, lambda s, u: take(s, pair(u), most, tokens))
    filled = F.aggregate(F.filter(ordered, lambda u: ~u["cut"]), reserved, lambda s, u: take(s, u["items"], most, tokens))
    whole = F.aggregate(ordered, zero, lambda s, u: take_whole(s, u, most, tokens))
    kept = F.when(F.size(primaries) > 1, filled).otherwise(whole)
    return packed.select("question_id", F.posexplode(kept["kept"]).alias("pick", "chunk_id")).withColumn("pick", F.col("pick") + 1)


def packed_units(units: DataFrame, anchors: DataFrame, costs: DataFrame) -> DataFrame:
    """One row per question: its units in rank order as structs (rank, anchor, items, primary, cut)."""
    tags = anchors.select("question_id", F.col("chunk_id").alias("anchor_id"), "rank", F.explode("tags").alias("tag"))
    first = tags.groupBy("question_id", "tag").agg(F.min(F.struct("rank", "anchor_id")).alias("_f"))
    new = first.select("question_id", F.col("_f.anchor_id").alias("anchor_id"), F.lit(True).alias("primary")).distinct()
    cost = costs.select("chunk_id", F.coalesce(F.nullif(F.col("token_count").cast("long"), F.lit(0)), F.greatest(F.floor(F.char_length("text") / 2), F.lit(1))).cast("long").alias("cost"))
    items = units.join(cost.hint("merge"), "chunk_id", "left").withColumn("cost", F.coalesce("cost", F.lit(1).cast("long")))
    item = F.struct(F.col("chunk_id").alias("id"), "cost")
    lists = items.groupBy("question_id", "anchor_id").agg(
        F.array_sort(F.collect_list(F.struct("place", item.alias("i")))).alias("_l"), F.max("unit_incomplete").alias("cut"), F.max(F.when(F.col("chunk_id") == F.col("anchor_id"), F.col("cost"))).alias("_ac")
    )
    ranked = anchors.select("question_id", F.col("chunk_id").alias("anchor_id"), "rank")
    one = lists.join(ranked.hint("merge"), ["question_id", "anchor_id"]).join(new.hint("merge"), ["question_id", "anchor_id"], "left")
    unit = F.struct("rank", F.struct(F.col("anchor_id").alias("id"), F.coalesce("_ac", F.lit(1).cast("long")).alias("cost")).alias("anchor"), F.col("_l.i").alias("items"), F.coalesce("primary", F.lit(False)).alias("primary"), "cut")
    return one.groupBy("question_id").agg(F.array_sort(F.collect_list(unit)).alias("_units"))


# ---- D41: reserved clauses ----


def reserve_clauses(selected: DataFrame, requirements: DataFrame, candidates: DataFrame, most: int = MOST_CHUNKS) -> DataFrame:
    """question_id, chunk_id, rank (from 1) and reserved, after each uncovered requirement took a front place.

    selected: question_id, chunk_id, rank, atomic (a calculation's block, which never gives
    way); requirements: question_id, requirement_id, pos; candidates: question_id,
    requirement_id, chunk_id, score, rank: chunks that answer a requirement, found in the
    documents it was answered from. In the order of pos a requirement that no selected chunk
    answers takes its candidate of best score (ties: least rank, then id) to the front; at
    capacity the last block that is not atomic gives way, and if all are, nothing changes.
    Later requirements see the places as earlier ones left them.
    """
    first = F.min(F.struct(-F.coalesce("score", F.lit(0.0)).cast("double"), F.coalesce("rank", F.lit(0)), "chunk_id"))
    known = selected.select("question_id", "chunk_id")
    covers = candidates.join(known.union(candidates.select("question_id", "chunk_id")).distinct(), ["question_id", "chunk_id"])
    best = covers.groupBy("question_id", "requirement_id").agg(first.alias("_b"), F.collect_set("chunk_id").alias("_all"))
    # Of all that answer a requirement only what may be selected matters: the selection and other requirements' candidates.
    front = best.select("question_id", F.col("_b.chunk_id").alias("chunk_id")).union(known).distinct().groupBy("question_id").agg(F.collect_set("chunk_id").alias("_may"))
    asks = requirements.join(best, ["question_id", "requirement_id"]).join(front, "question_id")
    asks = asks.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("pos", "requirement_id", F.col("_b.chunk_id").alias("id"), F.array_intersect("_all", "_may").alias("by")))).alias("_asks"))
    places = selected.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("chunk_id").alias("id"), F.coalesce("atomic", F.lit(False)).alias("atomic"), F.lit(False).alias("reserved")))).alias("_places"))
    kind = "array<struct<rank:int,id:string,atomic:boolean,reserved:boolean>>"
    both = places.join(asks, "question_id", "full").select("question_id", F.coalesce(F.col("_places").cast(kind), F.array().cast(kind)).alias("_places"), F.coalesce("_asks", F.array().cast(dict(asks.dtypes)["_asks"])).alias("_asks"))

    def step(s: Column, a: Column) -> Column:
        covered = F.exists(s, lambda x: F.array_contains(a["by"], x["id"]))
        at = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(s), F.lit(1))), F.lit(0), lambda m, i: F.when((i <= F.size(s)) & ~F.coalesce(F.get(s, i - 1)["atomic"], F.lit(True)), i).otherwise(m))
        rest = F.when(F.size(s) >= most, F.filter(s, lambda x, i: i != at - 1)).otherwise(s)
        place = F.array(F.struct(F.lit(0).alias("rank"), a["id"].alias("id"), F.lit(False).alias("atomic"), F.lit(True).alias("reserved"))).cast(kind)
        return F.when(covered | ((F.size(s) >= most) & (at == 0)), s).otherwise(F.concat(place, rest))

    out = both.select("question_id", F.posexplode(F.aggregate("_asks", F.col("_places"), step)).alias("rank", "x"))
    return out.select("question_id", F.col("x.id").alias("chunk_id"), (F.col("rank") + 1).alias("rank"), F.col("x.reserved").alias("reserved"))
