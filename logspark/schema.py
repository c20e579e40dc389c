"""Schemas and fixed numbers of log events and control tables."""

from __future__ import annotations

# Level names by number, and their aliases.
LEVELS = ("Verbose", "Debug", "Information", "Warning", "Error", "Fatal")
LEVEL_ALIASES = {"trace": 0, "info": 2, "warn": 3, "critical": 5}
LEVEL_NUMBERS = {name.lower(): i for i, name in enumerate(LEVELS)} | LEVEL_ALIASES

LOG_EVENT = (
    "app_id string, day date, id bigint, ts timestamp, level int, template string, message string, exception string, "
    "event_type bigint, trace_id string, span_id string, source string, machine string, properties string"
)
RULE = (
    "id string, name string, app_id string, filter string, minimum_level int, trigger_type int, threshold_count int, "
    "threshold_window_minutes int, dedupe_key_template string, cooldown_minutes int, destination_id string, "
    "body_template_override string, max_fires_per_hour int, is_dry_run boolean, is_enabled boolean, "
    "auto_disabled_reason string, scope_changed_ts timestamp, last_fired_ts timestamp"
)
OCCURRENCE = (
    "rule_id string, dedupe_key string, window_start_ts timestamp, count int, first_seen_ts timestamp, "
    "last_seen_ts timestamp, sample_event string, last_fired_ts timestamp, ticket_url string"
)
DESTINATION = (
    "id string, name string, kind int, content_type string, body_template string, subject_template string, "
    "ticket_id_path string, ticket_url_path string, max_attempts int, rate_limit_per_hour int, is_enabled boolean, "
    "consecutive_failures int, circuit_open_until_ts timestamp"
)
DELIVERY = (
    "id string, destination_id string, rule_id string, app_id string, source int, event_type bigint, created_ts timestamp, "
    "attempt int, next_attempt_ts timestamp, status int, request_body string, subject string, response_status int, "
    "response_snippet string, ticket_id string, ticket_url string, error string"
)
ACK = "app_id string, scope string, through_ts timestamp, note string, acked_by string, created_ts timestamp"
TICKET_LINK = "id string, app_id string, event_type bigint, dedupe_key string, event_id string, ticket_id string, ticket_url string, delivery_id string, created_by string, created_ts timestamp"
APP = "id string, name string, retention_days int, max_size_mb int, minimum_level int, is_enabled boolean"
WIN_CURSOR = "machine string, channel string, last_record_id bigint, updated_ts timestamp"

PENDING, DELIVERED, FAILED, DEAD = 0, 1, 2, 3
BY_RULE, MANUAL, TEST = 0, 1, 2
EVERY_MATCH, THRESHOLD = 0, 1
