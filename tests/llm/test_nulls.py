"""Null ids and null everything: no operator crashes or loses rows, and the results are the documented ones."""

from collections import Counter

from loomspan.llm.html_text import html_text
from loomspan.llm.line_dedup import line_dedup
from loomspan.llm.mixing import mix_sources
from loomspan.llm.packing import pack_documents
from loomspan.llm.quality import quality_rules
from loomspan.llm.simhash import simhash_dedup, simhash_groups
from loomspan.llm.substring_dedup import substring_dedup
from loomspan.llm.token_files import token_files
from loomspan.llm.tokens import tokenizer_path
from loomspan.llm.url_filter import RULES, filter_urls

from .conftest import SCHEMA
from .test_text_ops import got

LINE = "a shared line of more than twenty characters"


def test_null_columns(spark):
    rows = [(None, LINE, None, None, None), (None, None, None, None, None), (4, LINE, "en", "s", 1), (2, LINE, None, "s", None), (None, "other words here", "de", "s", 2)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert got(line_dedup(docs), "doc_id", "n_dropped") == Counter({(None, 1): 1, (None, 0): 2, (4, 0): 1, (2, 1): 1})
    assert got(quality_rules(docs), "doc_id", "kept") == Counter({(None, False): 3, (4, False): 1, (2, False): 1})
    assert got(substring_dedup(docs), "doc_id", "n_removed") == Counter({(None, 0): 3, (4, 0): 1, (2, 0): 1})
    groups = got(simhash_groups(docs), "doc_id", "component_id")
    assert groups[(None, 2)] == 1 and groups[(2, 2)] == groups[(4, 2)] == 1 and groups[(None, None)] == 2
    assert got(simhash_dedup(docs), "doc_id", "text") == Counter({(2, LINE): 1, (None, None): 1, (None, "other words here"): 1, (None, LINE): 1})
    assert all(r["copies"] >= 1 for r in mix_sources(docs, epochs=20.0).collect())
    assert sum(r["length"] for r in pack_documents(docs, tokenizer_path("word_bpe_49k.json")).collect()) > 5
    files = token_files(docs, tokenizer_path("byte_bpe_50k.json")).orderBy("start").collect()
    assert [r["doc_id"] for r in files] == [None, None, None, 2, 4]
    pages = spark.createDataFrame([(None, None, None), (1, None, "<p>x</p>")], "page_id long, url string, html string")
    assert html_text(pages).count() == 2 and filter_urls(pages, RULES).where("rule is null").count() == 2
