"""Metadata in one form, and inferred from texts."""

from evidence_spark.operators import metadata


def test_fields_and_values_in_one_form(spark):
    rows = [
        ("发布日期", "2024年3月5日"), ("published_at", "2024/3/5"), ("publish_date", "2024-02-30"), ("publication_date", "1999-01-01"), ("status", " Active "), ("版本状态", "废止"), ("version_status", "gone"), ("url", "https://a.b/c?d"),
        ("page_url", "ftp://a"), ("file_url", "https://u:p@h/x"), ("category", " 反洗钱 "), ("other", " x "), ("title", ""), ("doc_id", None), ("effective_at", "2024-1-2 "), ("source_url", "HTTP://h"),
    ]
    got = {(r["key"], r["value"]): (r["field"], r["normalized"], r["error"]) for r in metadata.normalize_metadata(spark.createDataFrame(rows, "key string, value string")).collect()}
    want = [
        ("publication_date", "2024-03-05", None), ("publication_date", "2024-03-05", None), ("publication_date", None, "date"), ("publication_date", None, "date"), ("version_status", "current", None), ("version_status", "repealed", None),
        ("version_status", None, "version_status"), ("source_url", "https://a.b/c?d", None), ("source_url", None, "url"), ("attachment_url", None, "url"), ("regulatory_topic", "反洗钱", None), ("other", "x", None), ("title", None, None),
        ("external_doc_id", None, None), ("effective_date", "2024-01-02", None), ("source_url", "HTTP://h", None),
    ]
    assert got == dict(zip(rows, want, strict=True))


def test_inferred_fields(spark):
    body = "第一条 为加强资本管理。自2024年1月1日起施行。有效期至2029-12-31。" + "正文" * 3000
    docs = [
        (1, "资本办法.pdf", body + "中国人民银行 发布日期：2023.12.5", ["  ", "国家金融监督管理总局令", "银保监发〔2023〕12号"]), (2, "x.pdf", "发文机关：某省地方金融局；\n统计报表", None), (3, "贷款.pdf", None, None), (4, None, "发布机构: 财政部办公厅\n生效日期 2022/13/40", ["发布机构: 财政部办公厅"]),
        (5, "y", "施行日期：2021-2-3", []), (6, "z", "自2020年1月1日起算", None),
    ]
    got = {r["doc_id"]: tuple(r)[1:] for r in metadata.infer_metadata(spark.createDataFrame(docs, "doc_id int, filename string, text string, head array<string>")).collect()}
    assert got == {
        1: ("国家金融监督管理总局", "银保监发〔2023〕12号", "2023-12-05", "2024-01-01", "2029-12-31", "资本监管", None), 2: ("某省地方金融局", None, None, None, None, "统计报送", "监管统计"), 3: (None, None, None, None, None, "信贷管理", "信贷业务"),
        4: ("财政部", None, None, None, None, None, None), 5: (None, None, None, "2021-02-03", None, None, None), 6: (None,) * 7,
    }
    assert metadata.infer_metadata(spark.createDataFrame(docs, "doc_id int, filename string, text string, head array<string>").limit(0)).count() == 0
