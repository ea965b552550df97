"""Document metadata: field names and values in one form (B7), and fields inferred from a document's own text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let

#: Other names of fields.
FIELD_ALIASES = {
    "doc_id": "external_doc_id", "official_doc_id": "external_doc_id", "source_title": "title", "document_title": "title", "authority": "issuing_authority", "issuer": "issuing_authority",
    "publish_date": "publication_date", "published_at": "publication_date", "effective_at": "effective_date", "expiry_date": "expiration_date", "invalid_date": "expiration_date", "file_number": "document_number",
    "topic": "regulatory_topic", "category": "regulatory_topic", "column": "source_column", "source_page_url": "source_url", "page_url": "source_url", "url": "source_url", "download_url": "attachment_url",
    "file_url": "attachment_url", "status": "version_status", "supersedes": "supersedes_document_id", "标题": "title", "发文机关": "issuing_authority", "发布日期": "publication_date", "生效日期": "effective_date",
    "失效日期": "expiration_date", "文号": "document_number", "监管主题": "regulatory_topic", "业务领域": "business_domain", "栏目": "source_column", "来源页面URL": "source_url", "来源URL": "source_url", "附件URL": "attachment_url", "版本状态": "version_status",
}
#: States of versions, and other words for them.
VERSION_STATUSES = ("unknown", "current", "future", "repealed", "superseded", "draft")
STATUS_ALIASES = {"active": "current", "effective": "current", "invalid": "repealed", "废止": "repealed", "现行": "current"}
DATE_FIELDS, URL_FIELDS = ("publication_date", "effective_date", "expiration_date"), ("source_url", "attachment_url")
#: Authorities, and the words by which topics and businesses are told; the first that fits counts.
AUTHORITIES = ("国家金融监督管理总局", "中国银行保险监督管理委员会", "中国银保监会", "中国人民银行", "中国证券监督管理委员会", "国务院", "财政部")
TOPICS = {
    "反洗钱": ("反洗钱", "可疑交易", "客户尽职调查"), "资本监管": ("资本充足", "风险加权资产", "资本管理"), "风险分类": ("风险分类", "不良贷款"), "统计报送": ("统计报表", "填报说明", "监管报送", "统计制度"),
    "消费者权益保护": ("消费者权益", "消保", "投诉"), "支付结算": ("支付结算", "支付机构", "银行卡"), "信贷管理": ("贷款", "授信", "信贷"),
}
BUSINESSES = {"风险管理": ("风险", "不良", "资本充足"), "监管统计": ("统计", "报表", "报送", "填报"), "合规管理": ("合规", "禁止", "不得", "反洗钱"), "信贷业务": ("贷款", "授信", "信贷"), "支付业务": ("支付", "结算", "银行卡")}
#: Labels of dates, of an authority, a document's number; how many blocks and characters make head and foot.
PUBLISHED, EFFECTIVE, EXPIRED = ("发布日期", "公布日期", "发布于"), ("生效日期", "施行日期", "自"), ("失效日期", "废止日期", "有效期至")
DAY = r"((?:20\d{2})[年./-]\d{1,2}[月./-]\d{1,2}日?)"
AUTHORITY, NUMBER = r"(?:发文机关|发布机构|制定机关)\s*[：:]\s*([^\n；;]{2,80})", r"(?:[一-鿿A-Za-z]{1,18})[〔\[]\d{4}[〕\]]\d{1,6}号"
HEAD_BLOCKS, HEAD, FOOT = 20, 4000, 3000


def iso_date(text: Column, pattern: str) -> Column:
    part = lambda i: F.regexp_extract(text, pattern, i)
    return F.date_format(F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0")).try_cast("date"), "yyyy-MM-dd")


def normalize_metadata(kv: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """Adds field, normalized and error (null: fine; date, url or version_status) to rows of metadata.

    Field names by their aliases, as written; dates of this century as yyyy-mm-dd from
    dashes, slashes or 年月日; addresses need http(s), a host and no credentials; states of
    versions by their aliases; other values are trimmed. A blank value is null.
    """
    name, text = F.trim(F.col(key)), F.nullif(F.trim(F.col(value).cast("string")), F.lit(""))
    field = F.coalesce(F.create_map(*[F.lit(x) for kv_ in FIELD_ALIASES.items() for x in kv_])[name], name)
    day = iso_date(F.replace(F.translate(text, "/年月", "---"), F.lit("日"), F.lit("")), r"^(20\d{2})-(\d{1,2})-(\d{1,2})$")
    url = F.when(text.rlike(r"^(?i:https?)://[^/?#@\s]+(?:[/?#]|$)"), text)
    low = F.lower(text)
    status = let(F.coalesce(F.create_map(*[F.lit(x) for kv_ in STATUS_ALIASES.items() for x in kv_])[low], low), lambda s: F.when(s.isin(*VERSION_STATUSES), s))
    out = kv.withColumn("field", field).withColumn("normalized", F.when(F.col("field").isin(*DATE_FIELDS), day).when(F.col("field").isin(*URL_FIELDS), url).when(F.col("field") == "version_status", status).otherwise(text))
    kind = F.when(F.col("field").isin(*DATE_FIELDS), "date").when(F.col("field").isin(*URL_FIELDS), "url").when(F.col("field") == "version_status", "version_status")
    return out.withColumn("error", F.when(text.isNotNull() & F.col("normalized").isNull(), kind))


def labelled_date(text: Column, labels: Sequence[str]) -> Column:
    """The date behind the first of the labels that has one; behind 自 only if it says that something starts then."""
    found = lambda label: F.regexp_extract(text, (rf"自\s*{DAY}\s*起(?:施行|实施|生效)" if label == "自" else rf"{label}\s*[：:]?\s*{DAY}"), 1)
    first = F.coalesce(*[F.nullif(found(x), F.lit("")) for x in labels])
    return iso_date(first, r"(20\d{2})[年./-](\d{1,2})[月./-](\d{1,2})日?")


def first_known(text: Column, rules: dict[str, Sequence[str]]) -> Column:
    return F.coalesce(*[F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w)), F.lit(name)) for name, words in rules.items()])


def infer_metadata(docs: DataFrame, doc: str = "doc_id") -> DataFrame:
    """issuing_authority, document_number, dates, regulatory_topic and business_domain of each document; null where nothing is found.

    docs: doc_id, filename, text and head (array of the first blocks' texts, or null).
    Authority, number and publication are looked for in the head (its first blocks up to 4000
    characters, or that much text) and the last 3000 characters; a labelled authority counts
    before a named one; what the whole text says starts and ends its validity.
    """
    text = F.coalesce("text", F.lit(""))
    blocks = F.filter(F.transform(F.slice(F.coalesce("head", F.array().cast("array<string>")), 1, HEAD_BLOCKS), lambda b: F.trim(F.coalesce(b, F.lit("")))), lambda b: b != "")
    start = F.struct(F.array().cast("array<string>").alias("t"), F.lit(0).alias("n"))
    step = lambda a, b: F.when(a["n"] >= HEAD, a).otherwise(F.struct(F.concat(a["t"], F.array(b)).alias("t"), (a["n"] + F.char_length(b)).alias("n")))
    head = F.array_join(F.aggregate(blocks, start, step, lambda a: a["t"]), "\n")
    rows = docs.select(doc, text.alias("_t"), F.coalesce("filename", F.lit("")).alias("_f"), F.coalesce(F.nullif(head, F.lit("")), F.left(text, F.lit(HEAD))).alias("_h"), F.right(text, F.lit(FOOT)).alias("_e"))
    rows = rows.withColumn("_c", F.trim(F.regexp_replace("_t", r"\s+", " "))).withColumn("_l", F.nullif(F.trim(F.regexp_extract("_h", AUTHORITY, 1)), F.lit("")))
    known = lambda t: F.coalesce(*[F.when(F.contains(t, F.lit(a)), F.lit(a)) for a in AUTHORITIES])
    both = F.concat_ws("\n", "_h", "_e")
    authority = F.when(F.col("_l").isNotNull(), F.coalesce(known(F.col("_l")), F.col("_l"))).otherwise(known(both))
    about = F.concat_ws(" ", "_c", "_f")
    return rows.select(
        doc, authority.alias("issuing_authority"), F.nullif(F.regexp_extract("_h", NUMBER, 0), F.lit("")).alias("document_number"), labelled_date(F.concat_ws(" ", "_h", "_e"), PUBLISHED).alias("publication_date"),
        labelled_date(F.col("_c"), EFFECTIVE).alias("effective_date"), labelled_date(F.col("_c"), EXPIRED).alias("expiration_date"), first_known(about, TOPICS).alias("regulatory_topic"), first_known(about, BUSINESSES).alias("business_domain"),
    )
