"""Explicit schemas (as Spark DDL text) of landed records and stored tables: nothing is inferred from data."""

from __future__ import annotations

EXPRESSIONS = (
    "for", "against", "abstain", "secret_voter", "president", "not_voting", "on_mission", "absent",
)


BALLOT = (
    "ballot_id string, chamber string, term int, ext_id string, ballot_date date, kind string, title string, "
    "description string, act_ref string, act_title string, is_final boolean, is_confidence boolean, "
    "is_secret boolean, n_for int, n_against int, n_abstain int, approved boolean, url string"
)
VOTE = "ballot_ext_id string, person_ext_id string, expression string, group_ext_id string"
SOURCE_COUNT = "ballot_ext_id string, group_ext_id string, expression string, n bigint"
MEMBER = "chamber string, person_ext_id string, first_name string, last_name string"
MEMBERSHIP = (
    "person_id string, kind string, party_id string, group_id string, office string, valid_from date, valid_to date"
)
GROUP_PARTY = "group_id string, party_id string, valid_from date, valid_to date"
PARTY_ROLE = "party_id string, role string, valid_from date, valid_to date"
GROUP_COUNTS = "ballot_id string, group_id string, n_for bigint, n_against bigint, n_abstain bigint, n_other bigint"
ACT_CORRECTION = "ballot_id string, act_ref string, act_title string, recorded_at timestamp"
POSITION = "subject_id string, statement_id string, value int, status string, confidence string"
SERIES = "subject string, metric string, quarter date, n bigint, d bigint"
DOCUMENT = (
    "document_id string, sha256 string, extraction int, source string, level string, url string, date date, "
    "pages int, pages_reread int"
)
PARAGRAPH = "document_id string, n int, page int, text string, reread boolean"
PROMISE = (
    "promise_id string, document_id string, para_from int, para_to int, quote string, measure string, "
    "horizon string, level string"
)
RAW_DOCUMENT = (
    "source string, level string, channel string, url string, domain string, title string, published_at timestamp, "
    "sha256 string, text string, text_expires_at timestamp, text_cleared_at timestamp, reserved boolean, "
    "subjects array<string>, suspicious string"
)
REPORT = "report_id bigint, url string, text string, contact string, origin string, trap string, created_at timestamp"
BINDINGS = "results struct<bindings: array<map<string, struct<type: string, value: string>>>>"
ARTICLES = "articles array<struct<url: string, title: string, seendate: string, domain: string>>"
VIOLATION = "check string, key string, detail string"
