"""Schemas of inputs and intermediate tables, as DDL."""

PAGE = (
    "title STRING, ns STRING, id BIGINT, revision ARRAY<STRUCT<id: BIGINT, timestamp: STRING, "
    "contributor: STRUCT<username: STRING, id: BIGINT, ip: STRING>, comment: STRING, text: STRING>>"
)
REVISION = (
    "page_id BIGINT, page_title STRING, revision_id BIGINT, parent_revision_id BIGINT, timestamp STRING, user_id BIGINT, "
    "username STRING, is_anonymous BOOLEAN, is_bot BOOLEAN, raw_text STRING, raw_text_len INT, citation_count INT, "
    "clean_text_len INT, clean_text STRING"
)
_IN_PAGE = ", ".join(c.replace(" ", ": ", 1) for c in REVISION.split(", ")[2:])
PAGE_HISTORY = f"page_id BIGINT, title STRING, revisions ARRAY<STRUCT<{_IN_PAGE}>>"
ARTICLE_SCORES = "page_id STRING, title STRING, quality_score DOUBLE, n_tokens INT, n_users INT, iterations INT, converged BOOLEAN, citation_count INT"
AUTHOR_SCORES = "username STRING, score DOUBLE, pages INT"
LATEST = "id STRING, title STRING, raw_text STRING, citation_count INT"
SENTENCE_PAGES = (
    "page_id STRING, title STRING, paragraphs ARRAY<STRUCT<paragraph_id: INT, header: STRING, text_raw: STRING, text_clean: STRING, "
    "sentences: ARRAY<STRUCT<index: INT, text: STRING, has_citation: BOOLEAN>>>>"
)
EXAMPLES = "text STRING, label INT, perplexity_score DOUBLE"
