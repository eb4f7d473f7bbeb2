"""Fixed schemas of the tables and JSON payloads; nothing is inferred."""

from __future__ import annotations

#: Atom feed entry as Spark's XML reader gives it (rowTag "entry").
FEED_ENTRY = """id string, title string, summary string, published string, updated string,
author array<struct<name string>>, category array<struct<_term string>>,
link array<struct<_href string, _rel string, _title string>>"""

CITATION_PAYLOAD = """paperId string, year int,
authors array<struct<authorId string, name string>>,
citations array<struct<paperId string>>, `references` array<struct<paperId string>>"""

EXTRACTION = "concepts string, methods string, datasets string"

REPORT = """emerging_directions array<struct<direction string, reasoning string, confidence string>>,
underexplored_gaps array<struct<gap string, reasoning string>>,
predicted_convergences array<struct<concept_a string, concept_b string, reasoning string>>,
time_horizon_months int, overall_confidence string"""

OPINION = """persona string, direction string, adoption_likelihood string, reasoning string,
key_concerns array<string>, key_enablers array<string>, confidence_score double"""

SIMULATION = """adoption_reports array<struct<direction string, rounds array<struct<round_number int,
opinions array<struct<persona string, direction string, adoption_likelihood string, reasoning string,
key_concerns array<string>, key_enablers array<string>, confidence_score double>>>>>>"""

PAPERS = """id bigint, arxiv_id string, semantic_scholar_id string, title string, abstract string,
authors array<string>, categories array<string>, published_at timestamp, ingested_at timestamp,
graph_processed_at timestamp, cooccurrence_processed_at timestamp"""
KEYWORD_COUNTS = "keyword string, category string, window_date timestamp, count bigint"
TREND_SCORES = "keyword string, category string, score double, trend_direction string, window_start timestamp, window_end timestamp"
