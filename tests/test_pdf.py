from pyspark.sql import functions as F

from veritrace.operators import markup
from veritrace.plans import markup_queries, seeds


def plain(text):
    """What the fields' unescaping, mark by mark, makes of an escaped text."""
    raw = text.encode().decode("latin-1").replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)")
    for mark, char in (("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\\(", "("), ("\\)", ")"), ("\\\\", "\\")):
        raw = raw.replace(mark, char)
    return raw


def test_whole_texts(spark):
    texts = ["(a) b", "((nested (deep)) \\ x)", "back\\slash \\( end", "é ü 日本", "long (x) " * 20_000 + "ChatGPT", "y" * 300_000, "", None]
    df = spark.createDataFrame([(2 * k + 1, t) for k, t in enumerate(texts)], "target long, text string")
    fields = markup_queries.whole_pdfs(df).select("target", F.explode(markup.pdf_fields(F.col("latin"))).alias("x")).select("target", "x.k", "x.v")
    got = {r.target: r.v for r in fields.collect() if r.k == "/Producer"}
    assert got == {2 * k + 1: ("Acme (x) " + plain(t or "")).strip() for k, t in enumerate(texts)}


def test_all_documents_have_findings(spark):
    folder = "/root/testdata/sf0.001"
    want = {r.doc_id for r in seeds.table(spark, folder, "documents").select("doc_id").collect()}
    found = markup_queries.pdf_findings(spark, folder).collect()
    assert {r.target for r in found} == want


def plan(spark, name):
    from veritrace.plans import registry

    return registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_lowered_once(spark):
    assert plan(spark, "ai_marker_hits").count("lower(") <= 2  # documents and pages, or their union


def test_fields_are_looked_for_once(spark):
    assert plan(spark, "pdf_findings").count("|CreationDate)") <= 2  # names and values
