"""Record schemas and closed vocabularies."""

from __future__ import annotations

from pyspark.sql import types as T

SOURCE_FIELDS = (
    "publication_key source source_label source_record_id source_record_key record_url openalex_id title publication_date doi type language"
    " is_oa oa_status authors institutions institution_ids institution_countries institution_names_raw institution_affiliations_json abstract"
).split()

SOURCE_RECORD = T.StructType([T.StructField(f, T.BooleanType() if f == "is_oa" else T.StringType()) for f in SOURCE_FIELDS] + [T.StructField("_ord", T.LongType())])

# Export columns, in order.
EXPORT_COLUMNS = (
    "publication_key source source_count source_record_id source_record_keys record_url record_urls openalex_id authors title publication_date doi type language"
    " is_oa oa_status institutions institution_ids institution_countries institution_names_raw abstract"
    " sdg_model sdg_response sdg_formatted sdg_note source_provenance_json"
).split()
# Types that repositories name in other words.
OAI_TYPES = {
    "article": "article",
    "journalarticle": "article",
    "contributiontoperiodical": "article",
    "book": "book",
    "monograph": "book",
    "monography": "book",
    "editedcollection": "book",
    "bookpart": "book-chapter",
    "bookchapter": "book-chapter",
    "monographchapter": "book-chapter",
    "conferenceobject": "proceedings-article",
    "conferencepaper": "proceedings-article",
    "proceedingsarticle": "proceedings-article",
    "workingpaper": "report",
    "report": "report",
    "phdthesis": "dissertation",
    "doctoralthesis": "dissertation",
    "masterthesis": "dissertation",
    "bachelorthesis": "dissertation",
    "researchdata": "dataset",
    "dataset": "dataset",
    "recension": "review",
    "review": "review",
    "preprint": "preprint",
    "other": "other",
    "periodical": "other",
    "periodicalpart": "other",
}
DSPACE_TYPES = {
    "journalarticle": "article",
    "article": "article",
    "monography": "book",
    "monograph": "book",
    "book": "book",
    "monographychapter": "book-chapter",
    "monographchapter": "book-chapter",
    "bookchapter": "book-chapter",
}
ENTITY_KINDS = {"artistic": "artistic-work", "article": "article", "book": "book"}
ENTITY_TYPES = {"article": "Article", "book": "Book", "book-chapter": "Book", "artistic-work": "Artistic"}
DEFAULT_ENTITIES = ("Article", "Book", "Artistic")
# Publication types that sources offer.
WORK_TYPES = "article book book-chapter proceedings-article proceedings reference-entry report dissertation dataset software review editorial letter standard other".split()
OAI_WORK_TYPES = "article book book-chapter proceedings-article report dissertation dataset review preprint other".split()
# Fields that the works API is asked for.
WORK_FIELDS = "id display_name title publication_date doi abstract_inverted_index type language open_access authorships".split()
# End of the fixed values.

#: The cache's tables as they are declared.
CACHE_TABLES = {
    "works": """publication_key string, source string, source_record_id string, source_record_keys string, record_url string, record_urls string, openalex_id string,
        title string, publication_date string, doi string, type string, language string, is_oa boolean, oa_status string, authors string, institutions string, institution_ids string,
        institution_countries string, institution_names_raw string, institution_affiliations_json string, abstract string, source_count int, source_provenance_json string, updated_at timestamp""",
    "records": "source_record_key string, publication_key string, source string, source_label string, source_record_id string, record_url string, raw_json string, fetched_at timestamp",
    "results": "publication_key string, model string, text_hash string, sdg_response string, sdg_formatted string, sdg_note string, classified_at timestamp",
    "meta": "key string, value string",
}
