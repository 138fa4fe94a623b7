import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.sources import links


def one(spark, f, *values):
    row = spark.createDataFrame([values], [f"c{k}" for k in range(len(values))]).select(f(*(F.col(f"c{k}") for k in range(len(values)))).alias("x")).first()
    return row["x"]


@pytest.mark.parametrize(
    "f, given, wanted",
    [
        (T.mentions, "See Figs. 1-3, fig. S2a, Table 12, Eq. (4) and Figure 1234", ["Figure 1", "Figure S2", "Table 12", "Equation 4"]),
        (T.section_kind, "2. Materials and Methods", "methods"),
        (T.section_kind, "Summary", "abstract"),
        (T.section_kind, "Analysis", "discussion"),
        (T.section_kind, "Foo", None),
        (T.tokens, "studies training used classes class", ["study", "train", "classe", "class"]),
        (T.tokens, "état-of-the-art U-Net's", ["tat-of-the-art", "u-net'"]),
        (T.single_markers, "a [S1, S2] b [ H1;S10 ]", "a [S1][S2] b [H1][S10]"),
        (T.token_estimate, "", 1),
        (T.token_estimate, "12345678", 2),
        (T.word_count, "a b  c", 3),
        (T.slug, "Figure 3 (a)", "Figure_3_a"),
        (T.strip_numbering, "2.1 Results:", "Results"),
        (links.is_url, "  HTTPS://x", True),
        (links.candidate_urls, "https://arxiv.org/abs/2401.01234", ["https://arxiv.org/pdf/2401.01234", "https://arxiv.org/abs/2401.01234"]),
        (links.candidate_urls, "https://x.org/a", ["https://x.org/a"]),
        (links.candidate_urls, "https://www.biorxiv.org/content/10.1/2.full", ["https://www.biorxiv.org/content/10.1/2.full.pdf", "https://www.biorxiv.org/content/10.1/2.full"]),
        (links.is_public_host, "10.1.2.3", False),
        (links.is_public_host, "172.20.0.1", False),
        (links.is_public_host, "8.8.8.8", True),
        (links.is_public_host, "example.org", True),
    ],
)
def test_value(spark, f, given, wanted):
    assert one(spark, f, given) == wanted


@pytest.mark.parametrize("question, kind", [("What does Figure 3 show?", "visual"), ("Summarize this paper", "summary"), ("What are the limitations?", "critical"), ("Summarize Figure 2", "visual"), ("Hello", "general")])
def test_intent(spark, question, kind):
    assert one(spark, T.intent, question)["kind"] == kind


def test_pdf_link(spark):
    html = '<meta content="a/b.pdf" name="citation_pdf_url">'
    assert one(spark, links.pdf_link, html, "https://x.org/d/e?q") == "https://x.org/d/a/b.pdf"
    assert one(spark, links.pdf_link, "<p>", "https://x.org/d") is None
