"""Splitting documents into linked chunks, and the lookup indexes read from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import ARTICLE, NUMERAL, cosine, join_units, let, numeral, token_count, token_units, words
from .joins import checked_broadcast

#: Chunk size, overlap, and what a continued piece begins with.
SIZE, OVERLAP, CONTINUED = 800, 80, "（承接上文）"
TARGET, ALIKE, CAPTION = 512, 0.62, 120
CONTINUED_TOKENS = 6
SENTENCE = r"(?s).+?(?:[。！？!?；;：:]|$)"


def split_windows(df: DataFrame, text_col: str = "text", size: int = SIZE, overlap: int = OVERLAP, prefix: str = CONTINUED, prefix_tokens: int = CONTINUED_TOKENS) -> DataFrame:
    """Windows of token units every size - overlap units; later ones carry the prefix and are shorter by it.

    Adds pos, piece and units (how many token units the piece takes from the text).
    """
    step = max(size - overlap, 1)

    def cut(t: F.Column) -> F.Column:
        pieces = F.transform(F.sequence(F.lit(0), F.size(t) - 1, F.lit(step)), lambda s: F.slice(t, s + 1, F.when(s == 0, size).otherwise(size - prefix_tokens)))
        return F.when(F.size(t) > 0, pieces).otherwise(F.array().cast("array<array<string>>"))

    out = df.select(*df.columns, F.posexplode(let(token_units(F.col(text_col)), cut)).alias("pos", "_p"))
    text = F.concat(F.when(F.col("pos") > 0, F.lit(prefix)).otherwise(F.lit("")), join_units(F.col("_p")))
    return out.select(*df.columns, "pos", text.alias("piece"), F.size("_p").alias("units"))


def split_sentences(df: DataFrame, text_col: str = "text") -> DataFrame:
    """One row per sentence, trimmed, empty ones left out."""
    parts = F.filter(F.transform(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(SENTENCE), F.lit(0)), lambda s: F.trim(s)), lambda s: s != "")
    return df.select(*df.columns, F.posexplode(parts).alias("pos", "sentence"))


def split_articles(blocks: DataFrame, text_col: str = "text") -> DataFrame:
    """Cuts a block at every line-start 第X条 or 第X条之Y; adds part_no, part, article (integer or null), article_label and level."""
    parts = F.filter(F.transform(F.split(F.col(text_col), rf"(?m)(?=^\s*{ARTICLE})"), lambda p: F.trim(p)), lambda p: p.rlike(r"\S"))
    out = blocks.select(*blocks.columns, F.posexplode(parts).alias("part_no", "part"))
    label = F.regexp_extract("part", rf"^\s*({ARTICLE})", 1)
    out = out.withColumn("article_label", F.nullif(label, F.lit("")))
    return out.withColumn("article", numeral(F.regexp_extract("article_label", rf"第({NUMERAL})条", 1))).withColumn("level", F.when(label != "", 3))


def group_blocks(blocks: DataFrame, doc: str = "doc_id", order: str = "order_index") -> DataFrame:
    """Sections of blocks (block_type heading, table, formula or paragraph; text; section_title).

    A heading opens a group; a table is its own and takes a group of at most CAPTION tokens
    right before it as its caption; a formula paragraph stands alone; a paragraph of another
    section than the running one opens a group; a group of headings only is left out.
    """
    w = W.partitionBy(doc).orderBy(order)
    kind, before = F.col("block_type"), F.lag("block_type").over(w)
    section = F.when(kind == "heading", F.col("text")).otherwise(F.col("section_title"))
    seen = F.last(section, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    alone = kind.isin("heading", "table", "formula") | before.isin("table", "formula")
    fresh = before.isNull() | alone | ((before == "paragraph") & F.col("section_title").isNotNull() & ~F.col("section_title").eqNullSafe(seen))
    rows = blocks.withColumn("_at", F.col(order)).withColumn("_fresh", fresh.cast("int")).withColumn("_section", section)
    rows = rows.withColumn("_g", F.sum("_fresh").over(w)).withColumn("_section", F.last("_section", ignorenulls=True).over(w))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.trim("text") != "", F.struct("_at", "text")))), lambda x: x["text"]), "\n\n")
    groups = rows.groupBy(doc, "_g").agg(
        body.alias("_text"), F.max_by("block_type", "_at").alias("_kind"), F.bool_or(kind != "heading").alias("_body"),
        F.max_by("_section", "_at").alias("section_title"), F.min("_at").alias("_first"),
    )
    v = W.partitionBy(doc).orderBy("_g")
    caption = (F.col("_kind") == "paragraph") & F.col("_body") & (token_count(F.col("_text")) <= CAPTION) & (F.lead("_kind").over(v) == "table")
    groups = groups.withColumn("_caption", F.coalesce(caption, F.lit(False)))
    above = F.when(F.lag("_caption").over(v), F.concat(F.lag("_text").over(v), F.lit("\n\n"))).otherwise(F.lit(""))
    text = F.when(F.col("_kind") == "table", F.concat(above, F.lit("表格：\n"), F.col("_text"))).otherwise(F.col("_text"))
    groups = groups.withColumn("text", text).filter(F.col("_body") & ~F.col("_caption") & (F.col("text") != ""))
    return groups.select(doc, F.col("_first").alias("group_index"), F.col("_kind").alias("block_type"), "section_title", "text")


def semantic_units(df: DataFrame, doc: str, text: str = "text", target: int = TARGET) -> DataFrame:
    """The units that C7 packs: paragraphs, those of more than target tokens by sentence; later paragraphs keep their break."""
    paragraphs = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n\n"), lambda p: F.trim(p)), lambda p: p != "")
    rows = df.select(doc, F.posexplode(paragraphs).alias("_p", "_t"))
    sentences = F.filter(F.transform(F.regexp_extract_all("_t", F.lit(SENTENCE), F.lit(0)), lambda s: F.trim(s)), lambda s: s != "")
    rows = rows.select(doc, "_p", F.posexplode(F.when(token_count(F.col("_t")) <= target, F.array("_t")).otherwise(sentences)).alias("_s", "_t"))
    unit = F.concat(F.when((F.col("_p") > 0) & (F.col("_s") == 0), F.lit("\n\n")).otherwise(F.lit("")), F.col("_t"))
    return rows.select(doc, F.row_number().over(W.partitionBy(doc).orderBy("_p", "_s")).alias("pos"), unit.alias("unit"))


def _fold_pieces(units: DataFrame, doc_col: str, order_col: str, text_col: str, facts: dict, cut) -> DataFrame:
    """Numbers the pieces of each document's units: cut(held, tail, unit) says where a new one begins.

    A running sum restarted at each cut is a fold, here over the array of a document's unit
    sizes; only sizes go through it. Adds _piece.
    """
    sized = units.withColumns(facts)
    names = list(facts)
    lists = sized.groupBy(doc_col).agg(F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("o"), *names, F.col(text_col).alias("t")))).alias("_u"))
    start = F.struct(F.lit(-1).alias("piece"), F.lit(0).alias("held"), F.lit(False).alias("tail"), F.array().cast("array<int>").alias("of"))

    def step(a, u):
        fresh = (a["piece"] < 0) | cut(a["held"], a["tail"], u)
        piece = F.when(fresh, a["piece"] + 1).otherwise(a["piece"])
        held = F.when(fresh, u["_n"]).otherwise(a["held"] + u["_n"] - (a["tail"] & u["_head"]).cast("int"))
        return F.struct(piece.alias("piece"), held.alias("held"), u["_tail"].alias("tail"), F.concat(a["of"], F.array(piece)).alias("of"))

    folded = lists.withColumn("_of", F.aggregate("_u", start, step, lambda a: a["of"]))
    return folded.select(doc_col, F.explode(F.arrays_zip("_u", "_of")).alias("z")).select(doc_col, F.col("z._of").alias("_piece"), "z._u.*")


def _edges(text: F.Column) -> dict:
    """A unit's tokens, and whether an ASCII word stands at either end: two such ends make one token."""
    return {"_n": token_count(text), "_head": text.rlike("^[a-zA-Z0-9_]"), "_tail": text.rlike("[a-zA-Z0-9_]$")}


def pack_units(units: DataFrame, doc_col: str, order_col: str, text_col: str, max_tokens: int = SIZE) -> DataFrame:
    """Consecutive units joined while they fit; a unit over the limit is cut into windows (C5) of its own.

    Returns doc, pos, piece and units (token units of the piece, without what a window repeats as prefix).
    """
    over = lambda a: a > max_tokens

    def cut(held, tail, u):
        return over(held) | over(held + u["_n"] - (tail & u["_head"]).cast("int"))

    rows = _fold_pieces(units, doc_col, order_col, text_col, _edges(F.col(text_col)), cut)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "t"))), lambda x: x["t"]), "")
    merged = rows.groupBy(doc_col, "_piece").agg(joined.alias("_t")).withColumn("_t", F.regexp_replace("_t", r"^\s+|\s+$", ""))
    merged = merged.withColumn("_n", token_count(F.col("_t"))).filter(F.col("_n") > 0)
    fits = merged.filter(~over(F.col("_n"))).select(doc_col, "_piece", F.lit(0).alias("_w"), F.col("_t").alias("piece"), F.col("_n").alias("units"))
    cuts = split_windows(merged.filter(over(F.col("_n"))).select(doc_col, "_piece", "_t"), "_t", max_tokens, min(OVERLAP, max_tokens // 2))
    every = fits.unionByName(cuts.select(doc_col, "_piece", F.col("pos").alias("_w"), "piece", "units"))
    return every.select(doc_col, (F.row_number().over(W.partitionBy(doc_col).orderBy("_piece", "_w")) - 1).alias("pos"), "piece", "units")


def semantic_pieces(paragraphs: DataFrame, doc_col: str, order_col: str, text_col: str, vector_col: str, max_tokens: int = SIZE, target: int = TARGET, alike: float = ALIKE) -> DataFrame:
    """Paragraphs joined by blank lines; a new piece begins at target tokens, where neighbours' cosine is below alike, or past the limit."""
    near = cosine(F.lag(vector_col).over(W.partitionBy(doc_col).orderBy(order_col)), F.col(vector_col))
    first = F.row_number().over(W.partitionBy(doc_col).orderBy(order_col)) == 1
    rows = paragraphs.withColumn("_near", near).withColumn("_far", ~first & (F.col("_near") < alike))
    facts = {"_n": token_count(F.col(text_col)), "_head": F.lit(False), "_tail": F.lit(False), "_far": F.col("_far")}

    def cut(held, tail, u):
        return (held >= target) | u["_far"] | (held + u["_n"] > max_tokens)

    folded = _fold_pieces(rows, doc_col, order_col, text_col, facts, cut)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "t"))), lambda x: x["t"]), "\n\n")
    return folded.groupBy(doc_col, F.col("_piece").alias("pos")).agg(F.trim(joined).alias("piece"), F.sum("_n").alias("units"), F.count("*").alias("paragraphs"))


def add_overlap(pieces: DataFrame, doc_col: str, pos_col: str = "pos", text_col: str = "piece", overlap: int = OVERLAP, max_tokens: int = SIZE) -> DataFrame:
    """Puts the longest run of the previous piece's last sentences within overlap tokens ahead, if it fits."""
    before = F.lag(text_col).over(W.partitionBy(doc_col).orderBy(pos_col))
    sentences = F.filter(F.transform(F.regexp_extract_all(F.coalesce(F.col("_before"), F.lit("")), F.lit(SENTENCE), F.lit(0)), lambda s: F.trim(s)), lambda s: s != "")
    start = F.struct(F.lit("").alias("t"), F.lit(False).alias("stop"))

    def step(a, s):
        longer = F.concat(s, a["t"])
        over = a["stop"] | (token_count(longer) > overlap)
        return F.struct(F.when(over, a["t"]).otherwise(longer).alias("t"), over.alias("stop"))

    tail = F.aggregate(F.reverse(sentences), start, step, lambda a: F.trim(a["t"]))
    joined = F.when(F.col("_tail") == "", F.col(text_col)).otherwise(F.concat("_tail", F.lit("\n\n"), F.col(text_col)))
    out = pieces.withColumn("_before", before).withColumn("_tail", tail).withColumn("_joined", joined)
    return out.withColumn("overlapped", F.when(token_count(F.col("_joined")) > max_tokens, F.col(text_col)).otherwise(F.col("_joined"))).drop("_before", "_tail", "_joined")


def link_chunks(pieces: DataFrame, doc_col: str, order_col: str = "pos") -> DataFrame:
    """C11: chunk_id and the ids before and after it in document order."""
    w = W.partitionBy(doc_col).orderBy(order_col)
    ids = pieces.withColumn("chunk_id", F.format_string("%s-%06d", F.col(doc_col).cast("string"), F.row_number().over(w)))
    return ids.withColumn("prev_id", F.lag("chunk_id").over(w)).withColumn("next_id", F.lead("chunk_id").over(w))


def section_numbers(blocks: DataFrame, title_col: str = "section_title") -> DataFrame:
    """Dotted or article number of a title, its parent and its level."""
    number = F.coalesce(F.nullif(F.regexp_extract(title_col, r"^\s*(\d+(?:\.\d+)*)[.、\s]", 1), F.lit("")), F.nullif(F.regexp_extract(title_col, rf"^\s*({ARTICLE})", 1), F.lit("")))
    parent = F.when(F.col("section_number").contains("."), F.regexp_replace("section_number", r"\.\d+$", ""))
    return blocks.withColumn("section_number", number).withColumn("parent_number", parent).withColumn("section_level", F.when(F.col("section_number").isNotNull(), F.regexp_count("section_number", F.lit(r"\.")) + 1))


def heading_paths(chunks: DataFrame, doc_col: str, order_col: str, level_col: str = "level", title_col: str = "title", depth: int = 3) -> DataFrame:
    """The path of headings above each row; a new upper heading clears the lower ones."""
    w = W.partitionBy(doc_col).orderBy(order_col)
    out, above = chunks, [F.lit(0)]
    for k in range(1, depth + 1):
        out = out.withColumn(f"_g{k}", F.sum(F.when(F.col(level_col) <= k, 1).otherwise(0)).over(w))
        inner = W.partitionBy(doc_col, *[F.col(f"_g{j}") for j in range(1, k)]).orderBy(order_col) if k > 1 else w
        out = out.withColumn(f"_h{k}", F.last(F.when(F.col(level_col) == k, F.col(title_col)), ignorenulls=True).over(inner))
    path = F.array_compact(F.array(*[F.col(f"_h{k}") for k in range(1, depth + 1)]))
    return out.withColumn("path", path).drop(*[f"_{p}{k}" for p in "gh" for k in range(1, depth + 1)])


#: What a defined term is written in, how it is introduced, and what may stand before it.
TERM = r"一-鿿A-Za-z0-9（）()"
DEFINITIONS = [
    ("所称", rf"所称([{TERM}]{{2,24}}?)(?=，是指|是指|，指|指的)"),
    ("简称", rf"简称[“\"‘’]?([{TERM}]{{2,20}}?)(?=[）)”\"‘’。；;，,\n]|$)"),
    ("是指", rf"([{TERM}]{{2,24}})(?=是指)"),
]
DEFINITION_PREFIXES = ["本办法所称", "本法所称", "本条例所称", "所称之", "所称", "本办法", "本法", "本条例", "前述", "上述", "下列", "之", "的"]


def extract_definitions(chunks: DataFrame, chunk_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """Terms introduced by 所称…是指, 简称… and …是指; one row per chunk and term, first kind wins."""
    prefixes = rf"^(?:(?:{'|'.join(DEFINITION_PREFIXES)})(?=.{{2,}}))*"
    found = []
    for rank, (kind, pattern) in enumerate(DEFINITIONS):
        raw = F.explode(F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(1)))
        term = F.regexp_replace("_raw", prefixes, "") if kind == "是指" else F.regexp_replace("_raw", r"^的+|[）)]+$", "")
        rows = chunks.select(chunk_col, F.col(text_col).alias("_text"), raw.alias("_raw")).withColumn("term", F.trim(term))
        snippet = F.trim(F.regexp_replace(F.substr("_text", F.expr("locate(_raw, _text)"), F.lit(120)), r"\s+", " "))
        found.append(rows.select(chunk_col, F.lit(rank).alias("_rank"), F.lit(kind).alias("kind"), "term", snippet.alias("snippet")))
    every = found[0].unionByName(found[1]).unionByName(found[2]).filter(F.char_length("term") >= 2)
    norm = F.regexp_replace(F.translate(F.lower(F.trim("term")), "（）：“”", "():"), r"\s+", "")
    every = every.withColumn("term_norm", norm)
    first = F.row_number().over(W.partitionBy(chunk_col, "term_norm").orderBy("_rank", "snippet"))
    return every.withColumn("_n", first).filter("_n = 1").drop("_n", "_rank")


def extract_clauses(chunks: DataFrame, chunk_col: str = "chunk_id", text_col: str = "text", title_col: str = "section_title") -> DataFrame:
    """C14: clause numbers at the text's start, then in the title, once each."""
    at_start = F.regexp_extract(F.coalesce(F.col(text_col), F.lit("")), r"^\s*第([一二三四五六七八九十百零\d]{1,4})条", 1)
    in_title = F.regexp_extract_all(F.coalesce(F.col(title_col), F.lit("")), F.lit(r"第([一二三四五六七八九十百零\d]{1,4})条"), F.lit(1))
    labels = F.array_distinct(F.concat(F.filter(F.array(at_start), lambda x: x != ""), in_title))
    rows = chunks.select(chunk_col, F.explode(labels).alias("label"))
    return rows.withColumn("clause_number", numeral(F.col("label"))).filter("clause_number is not null").dropDuplicates([chunk_col, "clause_number"]).drop("label")


def table_chunks(rows: DataFrame, table_col: str, row_col: str, headers_col: str, cells_col: str) -> DataFrame:
    """One sentence per data row; two cells read `A为x时，B为y`, more read `h=v` in order."""
    h, c = F.col(headers_col), F.col(cells_col)
    pairs = F.array_join(F.filter(F.zip_with(h, c, lambda a, b: F.when(b.isNotNull() & (b != ""), F.concat(a, F.lit("="), b))), lambda x: x.isNotNull()), "；")
    two = F.concat(h[0], F.lit("为"), c[0], F.lit("时，"), h[1], F.lit("为"), c[1])
    return rows.select(table_col, row_col, F.when(F.size(c) == 2, two).otherwise(pairs).alias("sentence"))


def table_summary(rows: DataFrame, table_col: str, title_col: str, headers_col: str) -> DataFrame:
    """One summary chunk per table: its title, its columns and how many rows it has."""
    got = rows.groupBy(table_col).agg(F.max(title_col).alias("_t"), F.max(headers_col).alias("_h"), F.count("*").alias("_n"))
    text = F.concat(F.lit("表格摘要："), F.coalesce("_t", F.lit("")), F.lit("；数据行数："), F.col("_n").cast("string"), F.lit("；列："), F.array_join("_h", "、"))
    return got.select(table_col, text.alias("summary"))


def is_toc(text: F.Column, title: F.Column) -> F.Column:
    """Five dot leaders, or two under a contents title."""
    leaders = F.regexp_count(text, F.lit(r"[.．…·]{3,}\s*\d+"))
    return (leaders >= 5) | ((leaders >= 2) & F.coalesce(title.contains("目录"), F.lit(False)))


def postings(df: DataFrame, key: str | list[str], text: F.Column, only: DataFrame | None = None) -> DataFrame:
    """Term weights from a text: 1 + ln(tf) per distinct word; with only, of the words in its column token.

    Of texts dealt by key, or by one of several, all that follows by key finds the words of a key in one place.
    """
    keys = [key] if isinstance(key, str) else key
    rows = df.select(*keys, F.explode(words(text)).alias("token"))
    if only is not None:
        rows = rows.join(checked_broadcast(only.select("token").distinct()), "token", "left_semi")
    return rows.groupBy(*keys, "token").agg((1 + F.log(F.count("*").cast("double"))).alias("weight"))

