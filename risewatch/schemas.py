"""Explicit schemas of the engine's tables, and the fixed vocabularies they use."""

from __future__ import annotations

# Node types.
DOC_TYPES = ("Paper", "Patent", "Repo", "News")
TECH_TYPES = ("Technology", "Method", "Model", "Framework", "Dataset", "Institution", "Person")
NODE_TYPES = DOC_TYPES + ("Concept", "Author") + TECH_TYPES
DIRECTED_TYPES = ("Concept", "Technology", "Method", "Model", "Framework", "Dataset")

# Relations a document fragment may carry, technology pairs, and all edge relations.
FRAGMENT_RELATIONS = ("uses", "improves", "compares", "belongs_to", "targets", "competes", "causes")
PAIR_RELATIONS = ("uses", "improves", "compares", "targets", "competes", "causes")
EDGE_RELATIONS = (
    "belongs_to", "authored_by", "affiliated_with", "cites", "uses", "improves",
    "compares", "targets", "competes", "causes", "mentions",
)

# A name-only node type and the anchored type it may fold into.
MATCH_TARGET = {
    "Technology": "Concept",
    "Method": "Concept",
    "Model": "Concept",
    "Framework": "Concept",
    "Dataset": "Concept",
    "Institution": "Institution",
    "Person": "Author",
    "Author": "Author",
}

WORK = (
    "id string, source string, title string, doi string, publication_date string, abstract string, "
    "cited_by_count bigint, concepts array<struct<id:string,name:string,score:double>>, "
    "authorships array<struct<author:struct<id:string,name:string>,institutions:array<struct<id:string,name:string>>>>, "
    "referenced_works array<string>"
)
RAW_WORK = (
    "id string, title string, publication_date string, doi string, "
    "abstract_inverted_index map<string,array<int>>, cited_by_count bigint, "
    "concepts array<struct<id:string,display_name:string,score:double>>, "
    "authorships array<struct<author:struct<id:string,display_name:string>,"
    "institutions:array<struct<id:string,display_name:string>>>>, referenced_works array<string>"
)
RAW_DOI_WORK = (
    "DOI string, title array<string>, `container-title` array<string>, abstract string, subject array<string>, "
    "published struct<`date-parts`:array<array<int>>>, issued struct<`date-parts`:array<array<int>>>, "
    "created struct<`date-parts`:array<array<int>>>, author array<struct<given:string,family:string>>, "
    "reference array<struct<DOI:string>>"
)
PREPRINT = (
    "id string, source string, title string, doi string, abstract string, categories array<string>, "
    "authors array<struct<name:string>>, publication_date string"
)
RAW_PREPRINT = (
    "id string, title string, summary string, arxiv_doi string, published string, "
    "tags array<struct<term:string>>, authors array<struct<name:string>>"
)
PATENT = (
    "id string, source string, title string, abstract string, assignees array<string>, inventors array<string>, "
    "publication_date string, cpc array<string>, kind string"
)
NEWS = (
    "id string, source string, title string, text string, url string, themes array<string>, persons array<string>, "
    "organizations array<string>, tone double, publication_date string"
)
REPO = (
    "id string, source string, name string, description string, url string, stars bigint, topics array<string>, "
    "created_at string"
)
RAW_REPO = (
    "id bigint, full_name string, html_url string, description string, language string, topics array<string>, "
    "stargazers_count bigint, forks_count bigint, owner struct<login:string,type:string>, created_at string, "
    "pushed_at string, topic_id string, topic_label string, _window string, fetched_seq bigint"
)
RAW_FEED_ITEM = "link string, title string, summary string, published string, updated string"
NODE = (
    "id string, type string, entity_id string, name string, source string, pub_date string, doi string, "
    "kind string, url string, stars bigint, tone double"
)
TRIPLE = "head string, head_type string, relation string, tail string, tail_type string, time string, source string"
ACTIVITY = (
    "source string, topic_id string, topic_label string, window_start string, window_end string, "
    "activity_count string, collection_status string, error string"
)
FRAGMENTS = "triples array<struct<relation:string,tail:string,tail_type:string>>"
PAIRS = "pairs array<struct<head:string,relation:string,tail:string>>"
