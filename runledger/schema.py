"""Names, kinds and column types of the tables: events, runs, timers, deliveries, inbox, schedules, buckets, edges.

Times are UTC milliseconds in long columns. JSON is text at rest and VARIANT in computation.
"""

from __future__ import annotations

# The kinds of events, and which of them a log holds.
PERSISTED_KINDS = (
    "RUN_FINISHED", "RUN_ERRORED", "STEP_FINISHED", "STEP_FAILED", "SIGNAL_AWAITED", "APPROVAL_REQUESTED", "SIGNAL_RESOLVED",
    "APPROVAL_RESOLVED", "NOW_RECORDED", "UUID_RECORDED", "COMPENSATION_REGISTERED", "COMPENSATION_STARTED",
    "COMPENSATION_COMPLETED", "COMPENSATION_FAILED", "STEP_RETRY_SCHEDULED", "STEP_ATTEMPT_STARTED",
)
OBSERVED_KINDS = ("RUN_STARTED", "STEP_STARTED", "STEP_PROGRESS", "CUSTOM", "STATE_DELTA")
EVENT_KINDS = PERSISTED_KINDS + OBSERVED_KINDS

# Statuses of runs and steps, overlap policies.
RUN_STATUSES = ("queued", "running", "paused", "finished", "errored", "aborted")
TERMINAL = ("finished", "errored", "aborted")
STEP_STATUSES = ("pending", "running", "success", "failed", "paused")
OVERLAP_POLICIES = ("skip", "allow", "buffer-one", "cancel-previous", "terminate-previous")

DEFAULT_POLICY = "skip"

TIMER = "__timer"
DEFAULT_LEASE_MS = 30_000

EVENTS = "run_id string, event_index long, event_type string, step_id string, name string, deadline long, body string, ts long"
RUNS = "run_id string, workflow_id string, workflow_version string, status string, wait_name string, wake_at long, lease_owner string, lease_expires_at long, created_at long, updated_at long"
EDGES = "src long, dst long"
